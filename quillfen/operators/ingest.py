"""Transforms applied while a table is loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfen.session import scalars

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, TEMPORAL)]


def type_group(data_type: T.DataType) -> str:
    if isinstance(data_type, NUMERIC):
        return "numeric"
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "text" if isinstance(data_type, T.StringType) else "other"


def cap_rows(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Keep at most `max_rows` rows; off by default."""
    return df if max_rows is None else df.limit(max_rows)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case snake names; a clash gets a numeric suffix."""
    seen: dict[str, int] = {}
    names = []
    for name in df.columns:
        clean = name.strip()
        for mark in " \n\r\t.-":
            clean = clean.replace(mark, "_")
        clean = clean.lower()
        seen[clean] = seen.get(clean, 0) + 1
        names.append(clean if seen[clean] == 1 else f"{clean}_{seen[clean]}")
    return df.toDF(*names)


def downcast(df: DataFrame, floats: bool = False) -> DataFrame:
    """Smallest integer type that holds each column's range; floats to 32 bit on request."""
    integral = [f.name for f in df.schema if isinstance(f.dataType, INTEGRAL)]
    bounds = {}
    if integral:
        row = df.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in integral]).first()
        bounds = {c: row[i] for i, c in enumerate(integral)}
    out = {}
    for c, (low, high) in bounds.items():
        if low is None:
            continue
        for data_type, bits in ((T.ByteType(), 7), (T.ShortType(), 15), (T.IntegerType(), 31)):
            if -(2**bits) <= low and high < 2**bits:
                out[c] = F.col(c).cast(data_type)
                break
    if floats:
        out.update({f.name: F.col(f.name).cast("float") for f in df.schema if isinstance(f.dataType, T.DoubleType)})
    return df.withColumns(out) if out else df


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def parse_timestamp(column: Column) -> Column:
    return column.try_cast("timestamp_ntz")


# Texts of this shape are numbers; others are not tried, because a failed parse is slow.
NUMBER_SHAPE = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)\s*$"


def parse_number(column: Column) -> Column:
    """Text as a double, null where it is not a number."""
    return F.when(column.rlike(NUMBER_SHAPE), F.trim(column).try_cast("double"))


# Boolean tokens.
TRUE_TOKENS = ("true", "yes", "1", "t", "y")
FALSE_TOKENS = ("false", "no", "0", "f", "n")


def parse_boolean(column: Column) -> Column:
    token = F.lower(F.trim(column))
    return F.when(token.isin(*TRUE_TOKENS), F.lit(True)).when(token.isin(*FALSE_TOKENS), F.lit(False))


def cast_columns(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Cast to int64 / float64 / string / boolean / datetime / category; bad values become null."""
    out = {}
    for name, target in targets.items():
        if name not in df.columns:
            continue
        column = F.col(name)
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        number = parse_number(column) if is_text else column.try_cast("double")
        if target == "int64":
            out[name] = number.try_cast("bigint")
        elif target == "float64":
            out[name] = number
        elif target in ("string", "category", "object"):
            out[name] = column.cast("string")
        elif target == "boolean":
            out[name] = parse_boolean(column) if is_text else column.try_cast("boolean")
        elif target == "datetime":
            out[name] = parse_timestamp(column)
        else:
            raise ValueError(f"unknown target type: {target}")
    return df.withColumns(out) if out else df


def value_range(df: DataFrame, column: str) -> tuple:
    row = scalars(df, low=F.min(column), high=F.max(column))
    return row["low"], row["high"]

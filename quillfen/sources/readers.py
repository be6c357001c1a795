"""File readers: delimited text, JSON, Parquet, Excel and free text."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfen.operators.ingest import parse_number
from quillfen.sources.records import has_open_lines, head_names, records, text_lines

# Tokens that mean "missing" by default.
DEFAULT_NA = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Separators tried in turn for free text.
SEPARATORS = (",", ";", "\t", "|")


# Encodings in which a line feed is not a byte of its own.
WIDE_ENCODINGS = ("UTF16", "UTF32", "UCS2", "UCS4")


def _raw(spark: SparkSession, path, sep: str, encoding: str, skip_rows: int, header: bool, multi_line: bool | None) -> DataFrame:
    """Text columns. Files without open quotes go to Spark's reader, others are cut into records by many tasks."""
    whole_files = len(sep) != 1 or re.sub(r"\W|_", "", encoding.upper()).startswith(WIDE_ENCODINGS)
    if whole_files and skip_rows:
        raise ValueError("skip_rows needs a separator of one character and an encoding of single-byte line feeds")
    if multi_line is None and not whole_files and not skip_rows:
        multi_line = has_open_lines(text_lines(spark, path, encoding), sep)
    if whole_files or not (multi_line or skip_rows):
        return spark.read.csv(
            path, sep=sep, encoding=encoding, header=header, inferSchema=False, mode="PERMISSIVE",
            escape='"', enforceSchema=False, multiLine=whole_files and multi_line is not False,
        )
    rows = records(spark, path, sep, encoding, skip_rows)
    heads = rows.filter("head").select("value").distinct().limit(2) if header else rows.filter("head").select("value").limit(1)
    names = head_names([row["value"] for row in heads.collect()], sep)
    if not names:  # no record at all
        return spark.createDataFrame([], T.StructType([]))
    if header:
        rows = rows.filter("not head")
    else:
        names = [f"_c{i}" for i in range(len(names))]
    parsed = F.from_csv("value", _ddl(names), {"sep": sep, "escape": '"', "multiLine": "true"})
    return rows.select(parsed.alias("r")).select("r.*")


def _ddl(names: Iterable[str]) -> str:
    return ", ".join(f"`{n.replace(chr(96), chr(96) * 2)}` string" for n in names)


def _parsed(column: Column, target: str) -> Column:
    """Typed value or null; only texts of the right shape are tried, because a failed cast is slow."""
    if target == "double":
        return parse_number(column)
    if target == "bigint":
        return F.when(column.rlike(r"^\s*[+-]?\d{1,19}\s*$"), column.try_cast("bigint"))
    if target == "boolean":
        word = F.lower(F.trim(column))
        return F.when(word == "true", F.lit(True)).when(word == "false", F.lit(False))
    return column.try_cast(target)


def infer_types(df: DataFrame, parse_dates: bool = True) -> DataFrame:
    """Narrowest type every non-null text value fits; found with one aggregate pass."""
    names = df.columns
    if not names:
        return df
    targets = ["bigint", "double", "boolean"] + (["timestamp_ntz"] if parse_dates else [])
    checks = []
    for i, n in enumerate(names):
        column = F.col(f"`{n}`")
        fits = [F.count(_parsed(column, t)).alias(t) for t in targets]
        checks.append(F.struct(F.count(column).alias("n"), *fits).alias(f"c{i}"))
    row = df.agg(*checks).first()
    out = []
    for i, n in enumerate(names):
        counts, column = row[i], F.col(f"`{n}`")
        chosen = next((t for t in targets if counts["n"] and counts[t] == counts["n"]), None)
        out.append((_parsed(column, chosen) if chosen else column).alias(n))
    return df.select(*out)


def read_delimited(
    spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8",
    na_values: Sequence[str] = (), keep_default_na: bool = True, skip_rows: int = 0,
    decimal: str = ".", parse_dates: bool = True, header: bool = True,
    schema: T.StructType | None = None, multi_line: bool | None = None,
) -> DataFrame:
    """CSV, TSV or TXT with custom missing tokens, decimal mark and skipped head lines.

    Quoted line breaks are part of their cell; many tasks read such a file. `multi_line` says whether there are any;
    by default one scan finds out, and False takes every line as a row.
    """
    raw = _raw(spark, path, sep, encoding, skip_rows, header, multi_line)
    missing = list(na_values) + (list(DEFAULT_NA) if keep_default_na else [])

    def clean(name: str) -> Column:
        column = F.col(f"`{name}`")
        if missing:
            column = F.when(F.trim(column).isin(missing), F.lit(None)).otherwise(column)
        if decimal != ".":
            number = f"^\\s*[+-]?\\d*{re.escape(decimal)}?\\d+\\s*$"
            column = F.when(column.rlike(number), F.replace(column, F.lit(decimal), F.lit("."))).otherwise(column)
        return column.alias(name)

    text = raw.select(*[clean(n) for n in raw.columns])
    if schema is not None:
        return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
    return infer_types(text, parse_dates)


def read_json(spark: SparkSession, path: str | list[str], records_array: bool = True) -> DataFrame:
    """Array-of-records files, or JSON lines (which Spark can split) with records_array=False."""
    return spark.read.json(path, multiLine=records_array)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_excel(
    spark: SparkSession, path: str, sheet: str | int = 0, na_values: Sequence[str] = (),
    keep_default_na: bool = True, skip_rows: int = 0, schema: T.StructType | str | None = None,
) -> DataFrame:
    """One worksheet per workbook, a task per workbook; needs openpyxl on the workers."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as missing:
        raise ImportError("reading Excel files needs openpyxl") from missing
    import io

    def sheet_of(content: bytes) -> pd.DataFrame:
        return pd.read_excel(
            io.BytesIO(content), sheet_name=sheet, na_values=list(na_values),
            keep_default_na=keep_default_na, skiprows=skip_rows, engine="openpyxl",
        )

    files = spark.read.format("binaryFile").load(path).select("content")
    if schema is None:
        head = sheet_of(files.first()["content"]).head(1000)
        schema = spark.createDataFrame(head).schema

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                yield sheet_of(content)

    return files.mapInPandas(parse, schema)


def best_separator(lines: DataFrame) -> str | None:
    """First separator that splits every line into the same number (>1) of fields; blank lines do not count."""
    line = F.col("value")
    found = {}
    for i, sep in enumerate(SEPARATORS):
        hits = F.length(line) - F.length(F.replace(line, F.lit(sep), F.lit("")))
        found[f"s{i}"] = F.struct(F.min(hits).alias("least"), F.max(hits).alias("most"))
    row = lines.filter(F.trim(line) != "").agg(*[c.alias(n) for n, c in found.items()]).first()
    fits = [sep for sep, s in zip(SEPARATORS, row) if s["least"] is not None and s["least"] == s["most"] > 0]
    return fits[0] if fits else None


def read_text_auto(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text if one separator fits all lines, else one `text` column."""
    lines = spark.read.text(path)
    sep = best_separator(lines)
    if sep is None:
        return lines.withColumnRenamed("value", "text")
    return read_delimited(spark, path, sep=sep)


def load_tables(spark: SparkSession, paths: Sequence[str], register: bool = True) -> dict[str, DataFrame]:
    """Named tables, one per file; a clash of names gets a numeric suffix."""
    readers = {
        ".csv": read_delimited,
        ".tsv": lambda s, p: read_delimited(s, p, sep="\t"),
        ".txt": read_text_auto,
        ".json": read_json,
        ".parquet": read_parquet,
        ".xlsx": read_excel,
        ".xls": read_excel,
    }
    tables: dict[str, DataFrame] = {}
    for path in paths:
        stem, extension = os.path.splitext(os.path.basename(path.rstrip("/")))
        name, n = stem, 1
        while name in tables:
            n += 1
            name = f"{stem}_{n}"
        if extension.lower() not in readers:
            raise ValueError(f"unsupported file type: {extension}")
        tables[name] = readers[extension.lower()](spark, path)
        if register:
            tables[name].createOrReplaceTempView(re.sub(r"\W", "_", name))
    return tables

"""Parsing and standardising text dates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfen.operators.ingest import TEMPORAL, text_columns

# The accepted formats, in order of preference.
FORMATS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy",
    "MM-dd-yyyy", "MM/dd/yyyy", "MM.dd.yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss",
    "dd-MMM-yyyy", "dd MMM yyyy", "MMM dd, yyyy", "dd-MMMM-yyyy", "dd MMMM yyyy", "MMMM dd, yyyy",
    "yyyyMMdd", "ddMMyyyy", "MMddyyyy",
)
OUTPUTS = {"iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "europe": "dd/MM/yyyy", "standard": "yyyy-MM-dd HH:mm:ss"}
# Shapes that make a text column a date candidate.
SHAPES = (
    r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}", r"\d{1,2}\s+\w+\s+\d{4}",
    r"\w+\s+\d{1,2},\s+\d{4}", r"\d{8}", r"\d{6}",
)
_LONGEST = 80  # without the blanks around it: no format is longer, nor is ISO text with nanoseconds and the longest zone name


def _shape(fmt: str) -> str:
    """Regular expression of the texts a format can read."""
    shape = re.escape(fmt)
    for token, part in (("yyyy", r"\d{4}"), ("MMMM", "[A-Za-z]{3,9}"), ("MMM", "[A-Za-z]{3}"), ("MM", r"\d{2}"),
                        ("dd", r"\d{2}"), ("HH", r"\d{2}"), ("mm", r"\d{2}"), ("ss", r"\d{2}")):
        shape = shape.replace(token, part)
    return rf"^\s*{shape}\s*$"


def parse_as(column: Column, fmt: str) -> Column:
    """Only texts of the right shape are tried, because a failed parse is slow."""
    return F.when(column.rlike(_shape(fmt)), F.try_to_timestamp(F.trim(column), F.lit(fmt))).cast("timestamp_ntz")


def parse_generic(column: Column) -> Column:
    """ISO text, as the engine itself reads it."""
    return F.when(F.length(F.trim(column)) <= _LONGEST, F.trim(column)).try_cast("timestamp_ntz")


def _skeleton(fmt: str) -> str:
    """Outline of the texts a format can read: digits as 9, words as a."""
    return re.sub(r"[yMdHms]", "9", re.sub(r"M{3,4}", "a", fmt))


def parse_any(column: Column) -> Column:
    """First format that fits; the outline of a text picks the few formats worth trying."""
    text = F.when((F.length(F.trim(column)) <= _LONGEST) & column.rlike(r"\d"), F.trim(column))
    digits = F.translate(text, "012345678", "999999999")
    outline = F.regexp_replace(digits, "[A-Za-z]+", "a")
    choices: dict[str, list[str]] = {}
    for fmt in FORMATS:
        choices.setdefault(_skeleton(fmt), []).append(fmt)

    # Every format is a constant, so its formatter is built once. The lambda binds text and outline, so that they are
    # made once and not in every branch; it is SQL text because a tree of so many calls is slow to build.
    tried = {s: ", ".join(f"try_to_timestamp(t.text, '{fmt}')" for fmt in formats) for s, formats in choices.items()}
    branches = " ".join(f"WHEN '{s}' THEN coalesce({calls})" for s, calls in tried.items())
    read = F.array(F.struct(text.alias("text"), outline.alias("outline")))
    fitting = F.call_function("transform", read, F.expr(f"t -> CASE t.outline {branches} END"))
    return F.coalesce(F.get(fitting, F.lit(0)).cast("timestamp_ntz"), parse_generic(column))


def detect_date_columns(df: DataFrame, share: float = 0.3) -> list[str]:
    """Timestamps, and text columns of which more than `share` starts like a date."""
    found = [f.name for f in df.schema if isinstance(f.dataType, TEMPORAL)]
    texts = text_columns(df)
    if texts:
        starts = "^(?:" + "|".join(SHAPES) + ")"
        row = df.agg(*[F.avg(F.col(f"`{c}`").rlike(starts).cast("double")).alias(f"c{i}") for i, c in enumerate(texts)]).first()
        found += [c for c, s in zip(texts, row) if s is not None and s > share]
    return [c for c in df.columns if c in found]


class DateRepair(NamedTuple):
    data: DataFrame
    report: DataFrame


def standardise_dates(df: DataFrame, columns: Sequence[str] | None = None, output: str = "auto") -> DateRepair:
    """Parse each column with its best format; optionally add formatted text."""
    columns = list(columns) if columns else detect_date_columns(df)
    texts = [c for c in columns if not isinstance(df.schema[c].dataType, TEMPORAL)]
    checks = [F.count(F.lit(1)).alias("rows")] + [F.count(c).alias(f"n_{c}") for c in columns]
    for c in texts:
        for i, f in enumerate(FORMATS):
            checks.append(F.count(parse_as(F.col(c), f)).alias(f"f{i}_{c}"))
        checks.append(F.count(parse_generic(F.col(c))).alias(f"g_{c}"))
    row = df.agg(*checks).first()
    out, report = {}, []
    for c in columns:
        method, fmt, hits = "already_datetime", df.schema[c].dataType.simpleString(), row[f"n_{c}"]
        if c in texts:
            rates = [row[f"f{i}_{c}"] for i in range(len(FORMATS))]
            best, generic = max(rates), row[f"g_{c}"]
            if best and best >= generic:
                method, fmt, hits = "format_specific", FORMATS[rates.index(best)], best
                out[c] = parse_as(F.col(c), fmt)
            else:
                method, fmt, hits = "generic_parsing", "infer", generic
                out[c] = parse_generic(F.col(c))
        rate = hits / row["rows"] if row["rows"] else 0.0
        report.append((c, method, fmt, rate, hits, row[f"n_{c}"] - hits, OUTPUTS.get(output, "keep_datetime")))
    data = df.withColumns(out) if out else df
    if output in OUTPUTS:
        data = data.withColumns({f"{c}_formatted": F.date_format(c, OUTPUTS[output]) for c in columns})
    schema = (
        "column string, method string, format string, success_rate double, converted_rows long, failed_rows long,"
        "output_format string"
    )
    return DateRepair(data, df.sparkSession.createDataFrame(report, schema))

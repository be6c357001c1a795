"""Delimited records with quoted line breaks, read by many tasks per file.

Whether a line break ends a record depends on all quotes before it in its file. Seen from one line, though, there are
only two cases, inside or outside of quotes, so a line is a map of two states and maps can be composed. A first pass
folds the maps of the lines of every file block; a prefix over the blocks of a file gives the state in which each block
begins; a second pass joins the lines of each record. Records that cross a block border are stitched from one piece
per block. Lines stay in the tasks that read them: what is shuffled is one row per block and the pieces at borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a line does to the state: bit 0 is the state after it when it starts outside of quotes, bit 1 when inside.
SAME, ENDS_OUTSIDE, SWAPS, ENDS_INSIDE = 2, 0, 1, 3
_BLOCK = "file bigint, start bigint"


def line_effect(line: Column, sep: str) -> Column:
    """The map of a line. A quote opens a field only at its start; a doubled quote within quotes is text."""
    other = f"[^{re.escape(sep)}]*+"
    inside = '[^"]*+(?:""[^"]*+)*+'
    field = f'(?:"{inside}"{other}|(?!"){other})'
    fields = f"(?:{re.escape(sep)}{field})*+$"
    from_outside = F.when(line.rlike(f"(?s)^{field}{fields}"), 0).otherwise(1)
    from_inside = F.when(line.rlike(f'(?s)^{inside}"{other}{fields}'), 0).otherwise(2)
    return F.when(line.contains('"'), from_outside + from_inside).otherwise(SAME).cast("byte")


def text_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(file, start, value): lines with the block they start in. Bad bytes are replaced; a carriage return stays."""
    utf8 = encoding.upper().replace("_", "-") in ("UTF-8", "UTF8")
    value = F.make_valid_utf8(F.col("value")) if utf8 else F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.text(path, lineSep="\n").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), value.alias("value")
    )


def has_open_lines(lines: DataFrame, sep: str) -> bool:
    """Whether any line leaves a quote open, so that some record goes on in the next line."""
    opens = line_effect(F.col("value"), sep).isin(SWAPS, ENDS_INSIDE)
    return bool(lines.filter(F.col("value").contains('"') & opens).limit(1).count())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
    """(block, first slice of it, slice) in the order of the lines."""
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column("file").to_numpy(), batch.column("start").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            block = (int(file[a]), int(start[a]))
            yield block, block != current, batch.slice(a, b - a)
            current = block


def _states(effect: np.ndarray, begin: int) -> np.ndarray:
    """State after each line: that of the last line which settles it, turned by the swaps since."""
    place = np.arange(len(effect))
    settles = (effect == ENDS_OUTSIDE) | (effect == ENDS_INSIDE)
    last = np.maximum.accumulate(np.where(settles, place, -1))
    swaps = np.cumsum(effect == SWAPS)
    known = last >= 0
    base = np.where(known, effect[last] == ENDS_INSIDE, begin)
    return (base + swaps - np.where(known, swaps[last], 0)) % 2


def block_starts(lines: DataFrame) -> DataFrame:
    """(file, start) of the blocks that begin within quotes; `lines` has (file, start, effect)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ends = None, [0, 1]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*block, *ends)], names=["file", "start", "outside", "inside"])

        for own, new, part in _blocks(batches):
            if new:
                if block is not None:
                    yield row()
                block, ends = own, [0, 1]
            effect = part.column("effect").to_numpy()
            ends = [int(_states(effect, state)[-1]) for state in ends]
        if block is not None:
            yield row()

    folded = lines.select("file", "start", "effect").mapInArrow(fold, f"{_BLOCK}, outside bigint, inside bigint")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    settled = F.col("outside") == F.col("inside")
    turned = F.when(~settled, F.col("outside")).otherwise(0)
    swaps = folded.withColumn("swaps", F.sum(turned).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(settled, F.struct("outside", "swaps")), ignorenulls=True).over(before)
    swaps = swaps.withColumn("last", last).withColumn("turned", F.coalesce(F.sum(turned).over(before), F.lit(0)))
    state = (F.coalesce("last.outside", F.lit(0)) + F.col("turned") - F.coalesce("last.swaps", F.lit(0))) % 2
    return swaps.filter(state == 1).select("file", "start")


def _cut(lines: DataFrame, skip_rows: int) -> DataFrame:
    """(file, start, piece, head, value): whole records (piece 0), and pieces that end (1) or begin (2) in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, state, seen, open_lines, ending, head = None, 0, 0, [], False, False

        def rows(values: list[str] | pa.Array, piece: int, heads: int = 0) -> pa.RecordBatch:
            n = len(values)
            column = values if isinstance(values, pa.Array) else pa.array(values, pa.string())
            first = np.zeros(n, bool)
            first[:heads] = True
            keys = [pa.array(np.full(n, key, np.int64)) for key in block]
            return pa.RecordBatch.from_arrays([*keys, pa.array(np.full(n, piece, np.int8)), pa.array(first), column], names=["file", "start", "piece", "head", "value"])

        def rest() -> Iterator[pa.RecordBatch]:
            if block is not None and open_lines:
                yield rows(["\n".join(open_lines)], 1 if ending else 2, int(head))

        for own, new, part in _blocks(batches):
            if new:
                yield from rest()
                block, state, seen, open_lines = own, int(part.column("inside")[0].as_py()), 0, []
                ending, head = bool(state), False
            if own[1] == 0 and seen < skip_rows:  # the head lines of a file are dropped by position
                dropped = min(skip_rows - seen, part.num_rows)
                seen += dropped
                part = part.slice(dropped)
                if not part.num_rows:
                    continue
            value, effect = part.column("value"), part.column("effect").to_numpy()
            first = own[1] == 0 and seen == skip_rows  # the first record of a file starts here
            if first and value[0].as_py().startswith("\ufeff"):
                value = pa.concat_arrays([pa.array([value[0].as_py()[1:]]), value.slice(1)])
            seen += part.num_rows
            after = _states(effect, state)
            before = np.concatenate([[state], after[:-1]])
            state = int(after[-1])
            whole = (before == 0) & (after == 0)
            if first and whole[0]:
                yield rows(value.slice(0, 1), 0, 1)
                whole[0] = False
            elif first:
                head = True
            if whole.any():
                yield rows(value.filter(pa.array(whole)), 0)
            for n in np.flatnonzero((before == 1) | (after == 1)).tolist():
                open_lines.append(value[n].as_py())
                if not after[n]:
                    yield rows(["\n".join(open_lines)], 1 if ending else 0, int(head))
                    open_lines, ending, head = [], False, False
        yield from rest()

    return lines.mapInArrow(run, f"{_BLOCK}, piece tinyint, head boolean, value string")


def records(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8", skip_rows: int = 0) -> DataFrame:
    """(file, head, value): one row per record that is not blank, `head` for the first of each file.

    A quote that is never closed leaves the rest of its file as one record. Files may be cut into any blocks.
    """
    lines = text_lines(spark, path, encoding)
    lines = lines.withColumn("effect", line_effect(F.col("value"), sep))
    if skip_rows:  # quotes in dropped lines do not count
        starts = block_starts(_without_head(lines, skip_rows))
    else:
        starts = block_starts(lines)
    placed = lines.join(starts.withColumn("inside", F.lit(1)), ["file", "start"], "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    cut = _cut(placed.select("file", "start", "inside", "effect", "value"), skip_rows)
    order = Window.partitionBy("file").orderBy("start", "piece").rowsBetween(Window.unboundedPreceding, 0)  # two rows per block at most
    pieces = cut.filter("piece > 0").withColumn("record", F.sum((F.col("piece") == 2).cast("int")).over(order))
    listed = F.array_sort(F.collect_list(F.struct("start", "piece", "value")))
    stitched = pieces.groupBy("file", "record").agg(F.max("head").alias("head"), listed.alias("pieces"))
    stitched = stitched.select("file", "head", F.array_join(F.transform("pieces", lambda p: p["value"]), "\n").alias("value"))
    made = cut.filter("piece = 0").select("file", "head", "value").unionByName(stitched)
    made = made.withColumn("value", F.regexp_replace("value", "\r$", ""))
    return made.filter(F.col("head") | (F.trim("value") != ""))


def _without_head(lines: DataFrame, skip_rows: int) -> DataFrame:
    """Lines with the effect of the first lines of each file taken away; only first blocks are walked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for _, new, part in _blocks(batches):
            seen = 0 if new else seen
            effect = part.column("effect").to_numpy().copy()
            effect[: max(0, skip_rows - seen)] = SAME
            seen += part.num_rows
            yield pa.RecordBatch.from_arrays([part.column("file"), part.column("start"), pa.array(effect, pa.int8())], names=["file", "start", "effect"])

    slim = lines.select("file", "start", "effect")
    first = slim.filter("start = 0").mapInArrow(run, f"{_BLOCK}, effect tinyint")
    return first.unionByName(slim.filter("start > 0"))


def head_names(heads: list[str], sep: str) -> list[str]:
    """Column names of a head record; blank and repeated names get their number."""
    import csv
    import io

    if len(set(heads)) > 1:
        raise ValueError("the files differ in their head records")
    names = next(csv.reader(io.StringIO(heads[0], newline=""), delimiter=sep), []) if heads else []
    folded = [name.lower() for name in names]
    return [f"_c{i}" if not name else f"{name}{i}" if folded.count(name.lower()) > 1 else name for i, name in enumerate(names)]

"""SimHash near-duplicates: pigeonhole blocks, a join on them, and a check of the Hamming distance.

Fingerprints collapse to distinct values first. 64 bits are cut into `d + c` blocks; two fingerprints with at most d
differing bits agree on at least c of them, so a join on every choice of c blocks finds every close pair. c grows with
the number of distinct fingerprints (2 blocks or 25 bits below four million, 3 or 32 bits below four billion, else 4),
so that chance meetings in a block stay few at any size; no bucket is capped.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfen.llm.common import packed, row_count, table, text_or_empty
from quillfen.llm.graph import components
from quillfen.session import cut_lineage

SEED = 42
PIECE = 1 << 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of all word shingles of a text in order; a shorter text is one shingle, a wordless one has none."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, "<u8")
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*[tokens[k:] for k in range(words)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), "<u8")


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned number; 0 without words."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    counts = np.zeros((8, 8), np.int64)
    for start in range(0, len(hashes), PIECE):
        lanes = hashes[start : start + PIECE].view(np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits.ravel(), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return run(text)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _blocks(number: int) -> list[int]:
    """Masks of `number` neighbouring blocks of the 64 bits, as even as possible."""
    edges = [round(64 * k / number) for k in range(number + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def close_pairs(prints: DataFrame, distance: int = 3, expected: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints of column `fp` that differ in at most `distance` bits.

    Every pair comes once: only from the first choice of blocks on which it agrees. `expected` is the number of
    fingerprints, counted if not given.
    """
    expected = row_count(prints) if expected is None else expected
    kept = 2 if expected < 1 << 22 else 3 if expected < 1 << 32 else 4
    masks = _blocks(distance + kept)
    choices = list(combinations(range(len(masks)), kept))
    keys = F.array(*[
        F.struct(F.lit(n).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(sum(masks[i] for i in choice)))).alias("k"))
        for n, choice in enumerate(choices)
    ])
    placed = prints.select("fp", F.explode(keys).alias("key")).select("fp", "key.c", "key.k")
    left, right = placed.alias("l"), placed.alias("r")
    differing = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    first = F.lit(False)
    for n, choice in enumerate(choices):
        earlier = [i for i in range(choice[-1]) if i not in choice]
        apart = F.lit(True)
        for i in earlier:
            apart = apart & (differing.bitwiseAND(F.lit(_signed(masks[i]))) != 0)
        first = first | ((F.col("l.c") == n) & apart)
    on = (F.col("l.c") == F.col("r.c")) & (F.col("l.k") == F.col("r.k")) & (F.col("l.fp") < F.col("r.fp"))
    return left.join(right, on & (F.bit_count(differing) <= distance) & first).select(
        F.col("l.fp").alias("a"), F.col("r.fp").alias("b")
    )


def grouped(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(fp, root) of every distinct fingerprint of column `fp`; root names its component."""
    distinct = cut_lineage(prints.select("fp").distinct())
    linked = components(close_pairs(distinct, distance))
    return distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: its key, `fingerprint` (16 hex digits) and `component_id`, the smallest key reachable.

    Null and wordless texts have fingerprint zero and are linked like any other. Repeated rows come back as often as
    they came in. A null key keeps its row and never names a component unless all keys of that component are null.
    """
    prints = cut_lineage(docs.select(F.col(key).alias("key"), fingerprints(text_or_empty(text), words).alias("fp")))
    roots = grouped(prints, distance)
    low = prints.groupBy("fp").agg(F.min("key").alias("low")).join(roots, "fp")
    names = low.groupBy("root").agg(F.min("low").alias("component_id"))
    named = low.select("fp", "root").join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """The documents with one row of every group of near-duplicates: that of the smallest key (nulls last).

    All columns of the input come back unchanged, whatever their names; exact repetitions of a row leave one.
    """
    rows = packed(docs)
    whole = F.xxhash64(*[F.col("row_").getField(name) for name in docs.columns])
    marked = rows.select("row_", F.col("row_").getField(key).alias("key"), whole.alias("whole"))
    prints = cut_lineage(marked.select("key", "whole", fingerprints(text_or_empty(F.col("row_").getField(text)), words).alias("fp")))
    first = F.min(F.struct(F.col("key").isNull().alias("late"), "key", "whole")).alias("best")
    low = prints.groupBy("fp").agg(first).join(grouped(prints, distance), "fp")
    best = low.groupBy("root").agg(F.min("best").alias("best")).select("best.key", "best.whole")
    kept = marked.alias("m").join(
        best.alias("b"), (F.col("m.whole") == F.col("b.whole")) & F.col("m.key").eqNullSafe(F.col("b.key"))
    )
    turn = F.expr("row_number() over (partition by m.whole, coalesce(m.key, 0), m.key is null order by m.whole)")
    return kept.select("row_", turn.alias("turn")).where("turn = 1").select("row_.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))

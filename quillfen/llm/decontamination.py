"""Benchmark decontamination by winnowing.

A window is `WINDOW` consecutive words of an item (a shorter item is one window of its own length L). Of the L - k + 1
word k-grams of a window, k = min(5, L), the one with the smallest hash is its fingerprint: the same words select the
same fingerprint in a document and in the benchmark, so every shared span of a window's length shares a fingerprint.
Documents are scanned once; a fixed-size bitmap of the benchmark's fingerprints keeps the others away from the join.
What passes joins the benchmark on (fingerprint, 128-bit digest of the window's words), and neighbouring windows grow
into spans. The bitmap has 2**24 bits at any size; it only saves work, the join decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillfen.llm.common import BoundedMemo, by_batches, packed, table, text_or_empty, worker_state
from quillfen.session import cut_lineage

WINDOW = 10
GRAM = 5
BITMAP_BITS = 24
MEMO = 300_000
CHUNK_WORDS = 200_000
# ASCII letters and digits and all other characters make words, capitals A-Z are lowered.
_FOLD = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
_HIT = pa.struct([("at", pa.int32()), ("words", pa.int32()), ("print", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])
HIT_DDL = "struct<at:int,words:int,print:bigint,d1:bigint,d2:bigint>"
_KEY = ["print", "d1", "d2"]


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def window_prints(hashes: np.ndarray, length: int) -> np.ndarray:
    """The winnowed fingerprint of every run of `length` word hashes."""
    gram = min(GRAM, length)
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    grams = np.full(len(hashes) - gram + 1, length, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0x100000001B3) + hashes[k : k + len(grams)]
    grams = _mixed(grams)
    count = len(hashes) - length + 1
    lowest = grams[:count].copy()
    for k in range(1, length - gram + 1):
        np.minimum(lowest, grams[k : k + count], out=lowest)
    return lowest


def _digest(words: list[bytes]) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _chunks(texts: list) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(first text, words, words of each text) of runs of texts; a run ends once it holds CHUNK_WORDS words."""
    first, words, sizes = 0, [], []
    for n, text in enumerate(texts):
        own = split_words(text)
        words += own
        sizes.append(len(own))
        if len(words) >= CHUNK_WORDS or n + 1 == len(texts):
            yield first, words, np.array(sizes)
            first, words, sizes = n + 1, [], []


def _found(texts: list, lengths: list[int], bitmap: np.ndarray | None) -> tuple[np.ndarray, pa.ListArray]:
    """Number of words and the windows of every text whose fingerprint is in the bitmap (all windows without one)."""
    memo = worker_state("word_hashes", lambda: BoundedMemo(xxhash.xxh64_intdigest, MEMO))
    counts, offsets = np.zeros(len(texts), np.int64), np.zeros(len(texts) + 1, np.int32)
    columns: list[list] = [[], [], [], [], []]
    for first, words, sizes in _chunks(texts):
        counts[first : first + len(sizes)] = sizes
        hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.cumsum(sizes) - sizes
        hits = []
        for length in lengths:
            prints = window_prints(hashes, length)
            if not len(prints):
                continue
            good = owner[: len(prints)] == owner[length - 1 :]
            if bitmap is None:  # a benchmark item: full windows, or one window of all its words
                good &= (sizes[owner[: len(prints)]] == length) | (length == WINDOW)
            else:
                slot = prints >> np.uint64(64 - BITMAP_BITS)
                good &= (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            at = np.flatnonzero(good)
            hits.append((at, np.full(len(at), length), prints[at].view(np.int64)))
        if not hits:
            continue
        at, length, prints = (np.concatenate([h[k] for h in hits]) for k in range(3))
        order = np.argsort(at, kind="stable")
        at, length, prints = at[order], length[order], prints[order]
        digests = [_digest(words[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        offsets[first + 1 : first + 1 + len(sizes)] = np.bincount(owner[at], minlength=len(sizes))
        for column, values in zip(columns, (at - begin[owner[at]], length, prints, [d[0] for d in digests], [d[1] for d in digests]), strict=True):
            column.append(np.asarray(values, np.int64))
    flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    arrays = [pa.array(values, field.type) for values, field in zip(flat, _HIT, strict=True)]
    return counts, pa.ListArray.from_arrays(pa.array(np.cumsum(offsets), pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(_HIT)))


def _scanned(rows: DataFrame, lengths: list[int], bitmap: np.ndarray | None) -> DataFrame:
    """The rows with their column `text` replaced by `n_words` and the array `hits`."""
    kept = [name for name in rows.columns if name != "text"]
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{name}` {types[name]}" for name in kept) + f", n_words bigint, hits array<{HIT_DDL}>"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hits = _found(batch.column("text").to_pylist(), lengths, bitmap)
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(counts), hits], names=[*kept, "n_words", "hits"])

    return by_batches(rows, work, schema)


class Benchmark:
    """The windows of a benchmark table, prepared for joins.

    Items of null id have windows that hit, but are in no item list; items without words have no window; items that
    repeat count once. Windows with the same set of items share a `set_id`, so that a long passage of many items
    brings its items to a document once, not once per window.
    """

    def __init__(self, items: DataFrame, item_id: str = "item_id", text: str = "text") -> None:
        rows = items.select(F.col(item_id).alias("item_id"), text_or_empty(text).alias("text")).distinct()
        seen = _scanned(rows, list(range(1, WINDOW + 1)), None)
        flat = seen.select("item_id", F.explode("hits").alias("h")).select("item_id", "h.words", *[f"h.{k}" for k in _KEY])
        self.pairs = cut_lineage(flat.distinct())
        mark = F.xxhash64("item_id")
        self.windows = cut_lineage(
            self.pairs.groupBy(*_KEY, "words")
            .agg(F.count("item_id").alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("item_id", F.lit(1))).alias("x"))
            .select(*_KEY, "words", F.sha2(F.concat_ws(":", "n", "s", "x"), 256).alias("set_id"))
        )
        chosen = self.windows.groupBy("set_id").agg(F.min(F.struct(*_KEY)).alias("w")).select("set_id", *[f"w.{k}" for k in _KEY])
        self.members = cut_lineage(self.pairs.where("item_id is not null").join(chosen, _KEY).select("set_id", "item_id"))
        self.lengths = sorted(r["words"] for r in self.windows.select("words").distinct().collect())
        slots = self.windows.select(F.shiftrightunsigned("print", 64 - BITMAP_BITS).alias("slot"))
        parts = slots.selectExpr("slot div 64 as word", "shiftleft(1L, cast(slot % 64 as int)) as bit")
        words = parts.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()  # 2**18 rows at most
        self.bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
        for row in words:
            self.bitmap[row["word"]] = np.uint64(row["bits"] & ((1 << 64) - 1))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = text_or_empty(text)
    return docs.select(F.col(key).alias("key"), F.xxhash64(key, own).alias("whole"), own.alias("text"))


def _matched(scanned: DataFrame, benchmark: Benchmark) -> DataFrame:
    hits = scanned.select("key", "whole", F.explode("hits").alias("h")).select("key", "whole", "h.at", *[f"h.{k}" for k in _KEY])
    return hits.join(benchmark.windows, _KEY).select("key", "whole", "at", "words", "set_id")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0).

    A null or empty text has no words and no hits. Rows that repeat get the same result each. An empty benchmark hits
    nothing. Documents of a null key are kept.
    """
    benchmark = Benchmark(items)
    scanned = cut_lineage(_scanned(_keyed(docs, key, text), benchmark.lengths, benchmark.bitmap))
    matched = cut_lineage(_matched(scanned, benchmark))
    doc = ["key", "whole"]
    end = F.col("at") + F.col("words")
    earlier = Window.partitionBy(*doc).orderBy("at", "words").rowsBetween(Window.unboundedPreceding, -1)
    fresh = matched.withColumn("before", F.coalesce(F.max(end).over(earlier), F.lit(0)))
    fresh = fresh.withColumn("new", F.greatest(F.lit(0), end - F.greatest("at", "before")))
    hit = fresh.groupBy(*doc).agg(F.sum("new").cast("long").alias("n_hit"))
    named = matched.select(*doc, "set_id").distinct().join(benchmark.members, "set_id").select(*doc, F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy(*doc).agg(F.count("item").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    h, n, s = hit.alias("h"), named.alias("n"), scanned.alias("s")

    def same(other: str) -> Column:
        return (F.col("s.whole") == F.col(f"{other}.whole")) & F.col("s.key").eqNullSafe(F.col(f"{other}.key"))

    return s.join(h, same("h"), "left").join(n, same("n"), "left").select(
        F.col("s.key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal runs of hit words: (key, first word, words after the last); overlapping or touching windows merge."""
    benchmark = Benchmark(items)
    matched = _matched(_scanned(_keyed(docs, key, text).distinct(), benchmark.lengths, benchmark.bitmap), benchmark)
    doc = Window.partitionBy("key", "whole").orderBy("at", "words")
    end = F.col("at") + F.col("words")
    opened = matched.withColumn("before", F.max(end).over(doc.rowsBetween(Window.unboundedPreceding, -1)))
    opened = opened.withColumn("run", F.count(F.when(F.col("before").isNull() | (F.col("at") > F.col("before")), 1)).over(doc))
    runs = opened.groupBy("key", "whole", "run").agg(F.min("at").alias("first_word"), F.max(end).alias("end_word"))
    return runs.select(F.col("key").alias(key), "first_word", "end_word")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a benchmark window, with all their columns."""
    benchmark = Benchmark(items)
    rows = packed(docs)
    own = text_or_empty(F.col("row_").getField(text))
    marked = rows.select("row_", F.col("row_").getField(key).alias("key"), F.xxhash64(F.col("row_").getField(key), own).alias("whole"))
    scanned = _scanned(_keyed(docs, key, text), benchmark.lengths, benchmark.bitmap)
    bad = cut_lineage(_matched(scanned, benchmark).select("key", "whole").distinct())
    m, b = marked.alias("m"), bad.alias("b")
    on = (F.col("m.whole") == F.col("b.whole")) & F.col("m.key").eqNullSafe(F.col("b.key"))
    return m.join(b, on, "left_anti").select("row_.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))

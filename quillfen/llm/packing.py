"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are powers of two: as many pieces of the longest length as fit,
then one piece for each binary digit of the rest. A piece is a sequence of its own, so no sequence crosses documents
and none is padded; sequences of equal length form a bucket, from which batches are drawn.

The pieces are written once, with their bucket sorted within each task, and numbered bucket by bucket afterwards:
counts per (bucket, written part) give the first number of each, so no text, id or piece is shuffled to be numbered.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from quillfen.llm.common import shared_folder, table, text_or_empty, worker_state

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONGEST, END_ID = 2048, 1
#: Ids that a task holds before it hands its pieces on.
HELD_IDS = 1 << 21


class Encoder:
    """The ids that the tokenizer of the vocabulary file gives, from the same vocabulary as ranks.

    Both libraries agree on every character (tested); the one by ranks is several times faster but gives up on white
    space of a million characters, which the tokenizer itself then takes.
    """

    def __init__(self, vocabulary: str, ranks: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        added = {token.content: number for number, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.by_ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=added)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.by_ranks.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def decomposed(count: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `count` ids; lengths are powers of two and never grow."""
    whole = count // longest * longest
    made = [(start, longest) for start in range(0, whole, longest)]
    for digit in range(longest.bit_length() - 2, -1, -1):
        if count & 1 << digit:
            made.append((whole, 1 << digit))
            whole += 1 << digit
    return made


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST, end: int = END_ID, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """(key, start, length, ids, doc_tokens, part, place) of every piece; ids are little-endian unsigned 32-bit integers.

    `part` is the task and `place` the position within (part, length). Null and empty texts have the end id alone, so
    they make one piece of length 1. Null keys stay null and repeated rows are packed as often as they occur. Any
    length of text is taken whole; a task holds the ids of one document or `HELD_IDS` at a time. Other columns of the
    documents are not read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_state(f"pack_ids:{vocabulary}:{ranks}", lambda: Encoder(vocabulary, ranks))
        part, places = TaskContext.get().partitionId(), {}
        rests = [decomposed(n, longest) for n in range(longest)]
        tail = end.to_bytes(4, "little")
        for batch in batches:
            own: list[list] = [[], [], [], [], [], []]
            held = 0

            def made(own: list[list], keys: pa.Array = batch.column("key")) -> pa.RecordBatch:
                rows_, starts, lengths, ids, totals, seats = own
                return pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows_, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64()), pa.array([part] * len(rows_), pa.int32()), pa.array(seats, pa.int64())],
                    names=["key", "start", "length", "ids", "doc_tokens", "part", "place"],
                )

            for n, value in enumerate(batch.column("text")):
                data = encode(value.as_py()).astype("<u4").tobytes() + tail
                total = len(data) // 4
                whole = total // longest * longest
                cuts = [(at, longest) for at in range(0, whole, longest)]
                cuts += [(whole + at, size) for at, size in rests[total - whole]]
                for start, size in cuts:
                    place = places.get(size, 0)
                    places[size] = place + 1
                    for column, item in zip(own, (n, start, size, data[4 * start : 4 * (start + size)], total, place), strict=True):
                        column.append(item)
                held += total
                if held >= HELD_IDS:
                    yield made(own)
                    own, held = [[], [], [], [], [], []], 0
            if own[0]:
                yield made(own)

    return rows.mapInArrow(run, f"key {kind}, start bigint, length int, ids binary, doc_tokens bigint, part int, place bigint")


def write(docs: DataFrame, folder: str, **options) -> None:
    """Write the pieces of `pieces` as Parquet, by length within each file, so that a bucket is read by its row groups."""
    pieces(docs, **options).sortWithinPartitions("length", "place").write.option("compression", "zstd").parquet(folder)


def numbered(written: DataFrame) -> DataFrame:
    """Replace part and place by `sequence_id`, gapless from 0, longest bucket first, and `offset`, the place in the sequence.

    The windows hold one row per (length, written part), dealt by length, and one row per length.
    """
    counts = written.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = written.groupBy("length").agg(F.count(F.lit(1)).alias("n"))  # as many rows as lengths: 12 by default
    buckets = buckets.select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("bucket_first"))
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_first"))
    firsts = firsts.join(F.broadcast(buckets), "length").select("length", "part", (F.col("part_first") + F.col("bucket_first")).alias("first"))
    number = (F.col("first") + F.col("place")).alias("sequence_id")
    kept = [name for name in written.columns if name not in ("part", "place")]
    return written.join(firsts, ["length", "part"]).select(*kept, number, F.lit(0).cast("long").alias("offset"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents from the written buckets; sequences are numbered after the checksums replaced the ids."""
    out = shared_folder(spark, "packing")
    write(table(spark, folder, "documents"), out)
    written = spark.read.parquet(out)
    length = F.col("length").cast("long").alias("length")
    made = numbered(written.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "part", "place"))
    return made.select("doc_id", "start", length, "ids_crc32", "doc_tokens", "sequence_id", "offset")

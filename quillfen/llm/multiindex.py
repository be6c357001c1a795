"""Embedding near-duplicates over an inverted multi-index.

Unit vectors are cut in halves; a codebook is trained on each half (k-means on a bounded sample), and the pairs of
codewords form a grid of cells. A vector lives in the cell of its nearest codewords and visits cells in the order of
the multi-sequence traversal, by the sum of the distances of its halves. How many cells it visits is measured: a
sample of vectors is compared with all rows by brute force, and the traversal goes on until the cells of the wanted
share of their partners have been reached; where too few have partners, drawn ones at the threshold count. What meets in a cell is verified by cosine in double precision.

Equal vectors collapse before and count as often as they occur. A cell with more rows than BLOCK is compared block
against block, so no task holds more than two blocks; nothing is capped. Tasks return link counts and, for components,
one edge from each linked vector to the smallest of its component within the task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfen.llm.common import table
from quillfen.llm.graph import components
from quillfen.session import cut_lineage

THRESHOLD = 0.9
SAMPLE = 20_000
QUERIES = 128
#: Ordinary queries with partners that suffice to measure recall, and the most vectors that are asked to find them.
ENOUGH, MOST_QUERIES = 64, 2048
RECALL = 0.999
#: Where fewer are seen: the share of drawn partners to be found, and partners drawn for each query.
EXPECTED, DRAWN = 0.99, 8
LEAST_CELLS = 4
PER_CELL = 16
CODEWORDS = 256
BLOCK = 1024
BATCH = 512


@dataclass
class Index:
    """Codebooks of both halves and the number of cells that a vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _squared(vectors[:, :half], self.first), _squared(vectors[:, half:], self.second)

    def cells(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The first `count` cells of the multi-sequence traversal of every vector, nearest first.

        A cell of ranks (a, b) is preceded by the (a + 1)(b + 1) - 1 cells of no larger ranks, so the first `count`
        cells are the smallest sums among ranks with (a + 1)(b + 1) <= count.
        """
        d1, d2 = self.distances(vectors)
        r1, r2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
        s1, s2 = np.take_along_axis(d1, r1, 1), np.take_along_axis(d2, r2, 1)
        a, b = np.meshgrid(np.arange(d1.shape[1]), np.arange(d2.shape[1]), indexing="ij")
        near = (a + 1) * (b + 1) <= count
        a, b = a[near], b[near]
        count = min(count, len(a))
        order = np.argsort(s1[:, a] + s2[:, b], axis=1, kind="stable")[:, :count]
        return (r1[np.arange(len(vectors))[:, None], a[order]] * len(self.second) + r2[np.arange(len(vectors))[:, None], b[order]]).astype(np.int32)


def _squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)


def _codebook(rows: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """Plain k-means from evenly spaced rows; a codeword that loses its rows stays where it is."""
    centres = rows[np.linspace(0, len(rows) - 1, words).astype(int)].copy()
    for _ in range(rounds):
        nearest = _squared(rows, centres).argmin(1)
        size = np.bincount(nearest, minlength=words)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, rows)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def distinct_vectors(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (key, vector or null), and the distinct usable vectors as (id, times, v).

    A vector is usable if it is not null or empty, has only finite components and is not all zero. `id` is the
    smallest key of the equal vectors.
    """
    v = F.col(vector).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    all_rows = rows.select(F.col(key).alias("key"), F.when(F.coalesce(good, F.lit(False)), v).alias("v"))
    # Adding zero turns a negative zero into zero, so that equal vectors have equal components.
    all_rows = all_rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    return all_rows, all_rows.where("v is not null and key is not null").groupBy("v").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("times"))


def _reached(ranks: np.ndarray, shares: np.ndarray, recall: float) -> int:
    """The visits that reach the wanted share of the partners, given by rank in ascending order."""
    return int(ranks[min(np.searchsorted(np.cumsum(shares), recall * shares.sum() - 1e-9), len(ranks) - 1)]) + 1


def _unseen_visits(index: Index, asked: np.ndarray, threshold: float) -> int:
    """Visits that find EXPECTED of the partners drawn at the threshold in random directions, where the rows show too few.

    A pair is found if either vector visits the home of the other one, so the nearer rank of both counts.
    """
    draw, near = np.random.default_rng(6), []
    for _ in range(DRAWN):
        aside = draw.standard_normal(asked.shape)
        aside -= (aside * asked).sum(1)[:, None] * asked
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        other = threshold * asked + (1 - threshold**2) ** 0.5 * aside / np.where(length > 1e-9, length, 1)
        both = []
        for own, partner in ((asked, other), (other, asked)):
            d1, d2 = index.distances(own)
            home = index.cells(partner, 1)[:, 0]
            at = np.arange(len(own))
            limit = d1[at, home // len(index.second)] + d2[at, home % len(index.second)]
            order = np.sort(d2, axis=1)
            both.append(np.array([np.searchsorted(order[k], limit[k] - d1[k] - 1e-12).sum() for k in at]))
        near.append(np.minimum(*both))
    ranks = np.sort(np.concatenate(near))
    return _reached(ranks, np.ones(len(ranks)), EXPECTED)


def fit(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, queries: int = QUERIES, recall: float = RECALL) -> Index | None:
    """Codebooks from `sample` rows of smallest hash, and the visits that reach the wanted recall.

    Recall is the mean over those of the asked vectors that have partners, and must hold for every magnitude of the
    number of partners on its own, so that a dense group does not speak for the ordinary ones. `queries` vectors are
    asked first, more up to MOST_QUERIES while fewer than ENOUGH ordinary ones with partners have been seen.
    """
    rows = vectors.select("v").orderBy(F.xxhash64("v")).limit(sample).toArrow()
    total = vectors.count()
    if not total:
        return None
    drawn = unit(_matrix(rows.column("v").combine_chunks()))
    words = int(np.clip(round((total / PER_CELL) ** 0.5), 1, min(CODEWORDS, len(drawn))))
    half = max(1, drawn.shape[1] // 2)
    index = Index(_codebook(drawn[:, :half], words), _codebook(drawn[:, half:], words), 1)
    while True:
        seen = _partners(vectors, index, drawn[:queries], threshold)
        sizes = {q: n for q, n in seen.groupby("query")["n"].sum().items()}
        largest = max(sizes.values(), default=0)
        ordinary = sum(n <= largest / 8 or largest <= ENOUGH for n in sizes.values())
        if ordinary >= ENOUGH or queries >= min(MOST_QUERIES, len(drawn)):
            break
        queries *= 4
    if len(seen):
        seen["share"] = seen["n"] / seen["query"].map(sizes)
        seen["magnitude"] = np.log2(seen["query"].map(sizes).to_numpy()).astype(int)
        for _, own in seen.groupby("magnitude"):
            own = own.sort_values("rank")
            index.visits = max(index.visits, _reached(own["rank"].to_numpy(), own["share"].to_numpy(), recall))
    # The sample may hold few pairs: visit twice as far, and a few cells at least.
    index.visits = max(2 * index.visits, LEAST_CELLS)
    if ordinary < ENOUGH and len(drawn) > ordinary and drawn.shape[1] > 1:
        index.visits = max(index.visits, _unseen_visits(index, drawn[:QUERIES], threshold))
    index.visits = min(index.visits, len(index.first) * len(index.second))
    return index


def _partners(vectors: DataFrame, index: Index, asked: np.ndarray, threshold: float) -> pd.DataFrame:
    """(query, rank, n): how many partners each asked vector has among all rows in the cell of every rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d1, d2 = index.distances(asked)
        cells = d1.shape[1] * d2.shape[1]
        ranks: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                own = unit(_matrix(whole.column("v").slice(at, BATCH)))
                home = index.cells(own, 1)[:, 0]
                cosine = own @ asked.T
                row, query = np.nonzero((cosine >= threshold) & (cosine < 1 - 1e-12))
                if not len(row):
                    continue
                found, counts = np.unique(query.astype(np.int64) * cells + home[row], return_counts=True)
                query, cell = np.divmod(found, cells)
                rank = np.empty(len(found), np.int64)
                for q in np.unique(query).tolist():
                    if q not in ranks:
                        order = np.argsort((d1[q][:, None] + d2[q][None, :]).ravel(), kind="stable")
                        ranks[q] = np.empty(cells, np.int32)
                        ranks[q][order] = np.arange(cells, dtype=np.int32)
                    rank[query == q] = ranks[q][cell[query == q]]
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(rank), pa.array(counts)], names=["query", "rank", "n"])

    counted = vectors.select("v").mapInArrow(run, "query bigint, rank bigint, n bigint")
    return counted.groupBy("query", "rank").agg(F.sum("n").alias("n")).toArrow().to_pandas()


def _placed(vectors: DataFrame, index: Index) -> DataFrame:
    """One row per vector and visited cell; the first visited cell is the vector's home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                raw = _matrix(batch.column("v"))
                cells = index.cells(unit(raw), index.visits)
                n, k = cells.shape
                packed_rows = np.repeat(np.array([r.tobytes() for r in unit(raw)], object), k)
                seen = np.repeat(np.array([np.sort(r[1:]).tobytes() for r in cells], object), k)
                seen[np.arange(n * k) % k != 0] = b""
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(np.repeat(np.arange(n), k))), batch.column("times").take(pa.array(np.repeat(np.arange(n), k))), pa.array(cells.ravel(), pa.int32()), pa.array(np.repeat(cells[:, 0], k), pa.int32()), pa.array(packed_rows, pa.binary()), pa.array(seen, pa.binary())],
                    names=["id", "times", "cell", "home", "v", "visits"],
                )

    kind = dict(vectors.dtypes)["id"]
    return vectors.select("id", "times", "v").mapInArrow(run, f"id {kind}, times bigint, cell int, home int, v binary, visits binary")


def _compared(rows: list[pa.RecordBatch], threshold: float) -> pa.RecordBatch:
    """Links among the rows of one cell (or of two of its blocks): (id, links, root) of every linked vector."""
    group = pa.Table.from_batches(rows)
    ids, times = group.column("id").to_numpy(), group.column("times").to_numpy()
    home, cell, turn = (group.column(n).to_numpy() for n in ("home", "cell", "block"))
    low, high = group.column("b1")[0].as_py(), group.column("b2")[0].as_py()
    vectors = np.frombuffer(b"".join(group.column("v").to_pylist()), np.float64).reshape(len(ids), -1)
    visits = [np.frombuffer(x, np.int32) for x in group.column("visits").to_pylist()]
    member = home == cell
    left = np.flatnonzero(member & (turn == low) | member & (turn == high)) if low == high else np.flatnonzero(turn == low)
    right = np.arange(len(ids)) if low == high else np.flatnonzero(turn == high)
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), BATCH):
        own = left[at : at + BATCH]
        r, c = np.nonzero(vectors[own] @ vectors[right].T >= threshold)
        a, b = own[r], right[c]
        keep = (a != b) & (member[a] | member[b])
        keep &= ~(member[a] & member[b]) | (a < b) if low == high else True
        a, b = a[keep], b[keep]
        mixed = np.flatnonzero(member[a] != member[b])
        if len(mixed):  # a pair that meets in both homes counts in the smaller cell
            m = np.where(member[a[mixed]], a[mixed], b[mixed])
            other = home[np.where(member[a[mixed]], b[mixed], a[mixed])]
            twice = np.array([o in visits[k] for k, o in zip(m.tolist(), other.tolist(), strict=True)], bool)
            drop = mixed[twice & (other < cell[0])]
            a, b = np.delete(a, drop), np.delete(b, drop)
        np.add.at(links, a, times[b])
        np.add.at(links, b, times[a])
        pairs.append((a, b))
    while True:  # smallest row within reach, by halving
        was = root.copy()
        for a, b in pairs:
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
        root = root[root]
        if (root == was).all():
            break
    found = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(links[found]), pa.array(ids[root[found]])], names=["id", "links", "root"])


def linked(vectors: DataFrame, index: Index, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, links, root) parts: links of a vector found in one comparison, and a vector it is connected with."""
    placed = _placed(vectors, index)
    hot = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    spread = placed.join(hot, "cell", "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("b1"), F.greatest(k, F.col("block")).alias("b2")),
    )
    spread = spread.withColumn("pair", F.explode(pairs)).select("id", "times", "cell", "home", "block", "v", "visits", "pair.b1", "pair.b2")
    dealt = spread.repartition("cell", "b1", "b2").sortWithinPartitions("cell", "b1", "b2", "id")
    kind = dict(vectors.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: tuple | None = None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("cell", "b1", "b2")], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                key = tuple(keys[a].tolist())
                if held and key != now:
                    made = _compared(held, threshold)
                    held = []
                    if made.num_rows:
                        yield made
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            made = _compared(held, threshold)
            if made.num_rows:
                yield made

    return dealt.mapInArrow(run, f"id {kind}, links bigint, root {kind}")


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: key, n_links (other vectors linked directly), component_id and kept (key = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of a null key, link with
    nothing and are their own component. Vectors of another length than the most frequent one are compared among
    their own length. Equal vectors link with each other. Keys are expected to be unique; rows that repeat a key come
    back as often as they came in and count as vectors of their own.
    """
    all_rows, distinct = distinct_vectors(rows, key, vector)
    all_rows, distinct = cut_lineage(all_rows), cut_lineage(distinct)
    lengths = [r["n"] for r in distinct.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    parts = [(own, index) for n in lengths if (index := fit(own := distinct.where(F.size("v") == n), threshold)) is not None]
    kind = dict(all_rows.dtypes)["key"]
    found = rows.sparkSession.createDataFrame([], f"id {kind}, links bigint, root {kind}")
    for own, index in parts:
        found = found.unionByName(linked(own, index, threshold, block))
    found = cut_lineage(found)
    roots = components(found.where("id != root"), "id", "root")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = distinct.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("root", "id").alias("root")
    )
    usable = all_rows.where("v is not null and key is not null").join(named, "v").select("key", "n", "root")
    alone = all_rows.where("v is null or key is null").select("key", F.lit(0).cast("long").alias("n"), F.col("key").alias("root"))
    return usable.unionByName(alone).select(
        F.col("key").alias(key), F.col("n").alias("n_links"), F.col("root").alias("component_id"), F.col("key").eqNullSafe(F.col("root")).alias("kept")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))

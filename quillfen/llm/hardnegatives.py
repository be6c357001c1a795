"""Hard negatives by Kronecker-packed products.

Components become integers. The components of several candidates are biased to be non-negative and put into separate
fields of one wide integer, so one multiplication by an anchor's component advances the products of all of them; the
sums never leave their fields, and the exact scores are unpacked and unbiased at the end. Wide integers live in
doubles, which hold integers below 2**53 exactly and multiply fastest; where a single field needs more bits, they are
Python integers of any length.

Rows are dealt into blocks of bounded size along an axis on which the rows of a label lie together. An anchor meets
the blocks of its label to find its positives, then all blocks to find the rows of other labels within the bands of
their scores. Within a task anchors stream past one block, and each leaves its first few rows of that block only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillfen.llm.common import table
from quillfen.session import cut_lineage

POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100
SCALE = 256
#: Components of a block at most, and rows at least where the tasks suffice.
BLOCK_COMPONENTS, BLOCK_ROWS = 1 << 23, 1024
#: Labels are counted by this many hash values, so the table of counts is bounded.
LABEL_BUCKETS = 1024
FIELDS = 64
_SCORES = 1 << 21
_EXACT = 53


class Packed:
    """Candidates (rows of integer-valued doubles) packed for exact products with anchors."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.count = rows, len(rows)
        self.bias = max(1.0, float(np.abs(rows).max(initial=0)))
        self.made: dict[tuple, np.ndarray] = {}

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The exact integer inner products, one row per anchor; 64-bit integers or, where those do not suffice, Python's."""
        bias, size = max(1.0, float(np.abs(anchors).max(initial=0))), self.rows.shape[1]
        width = (max(1, size) * 4 * int(bias) * int(self.bias)).bit_length()
        fields = _EXACT // width
        kind: type = np.float64
        if not fields:
            fields, kind = FIELDS, object
        wide = self._wide(width, fields, kind)
        own = _integers(anchors, kind) + _number(bias, kind)
        sums = own @ wide
        if kind is np.float64:
            sums = sums.astype(np.int64)
        mask = (1 << width) - 1
        whole = np.empty((len(anchors), wide.shape[1], fields), sums.dtype)
        for k in range(fields):
            whole[:, :, k] = (sums >> (width * k)) & mask
        out = whole.reshape(len(anchors), -1)[:, : self.count]
        exact = np.int64 if kind is np.float64 else object
        b, c = int(bias), int(self.bias)
        return out - c * _integers(anchors, exact).sum(1)[:, None] - b * _integers(self.rows, exact).sum(1)[None, :] - size * b * c

    def _wide(self, width: int, fields: int, kind: type) -> np.ndarray:
        """One column per group of `fields` neighbouring candidates, one row per component."""
        key = (width, fields, kind)
        if key not in self.made:
            self.made.clear()  # one packing is kept; anchors that need another width have it made anew
            groups = -(-self.count // fields)
            own = _integers(self.rows, kind) + _number(self.bias, kind)
            if groups * fields > self.count:
                own = np.concatenate([own, np.zeros((groups * fields - self.count, own.shape[1]), own.dtype)])
            own = own.reshape(groups, fields, -1)
            wide = own[:, 0].copy()
            for k in range(1, fields):
                wide = wide + own[:, k] * (2 ** (width * k) if kind is object else 2.0 ** (width * k))
            self.made[key] = np.ascontiguousarray(wide.T)
        return self.made[key]


def _number(value: float, kind: type) -> float | int:
    return int(value) if kind is object else float(value)


def _integers(rows: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return rows.astype(kind)
    return np.array([[int(x) for x in row] for row in rows], object).reshape(rows.shape)


def _binary(row: np.ndarray) -> bytes:
    """Integer-valued doubles in two bytes each where they fit, else in eight; the first byte says which."""
    narrow = not len(row) or np.abs(row).max() < 1 << 15
    return (b"\2" if narrow else b"\x08") + row.astype("<i2" if narrow else "<f8").tobytes()


def _row(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i2" if data[0] == 2 else "<f8", offset=1).astype(np.float64)


def integer_vectors(vectors: DataFrame, key: str, label: str, vector: str, anchor: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, size, data, anchor) of the rows that take part, each component x as floor(scale * x) of x as double.

    Rows with a null label, a null vector or a null or non-finite component are left out.
    """
    component = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), component.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    kind = dict(rows.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            offsets = lists.offsets.to_numpy()
            flat = np.floor(lists.values.to_numpy(zero_copy_only=False) * float(scale))
            sizes = np.diff(offsets)
            data = pa.array([_binary(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(sizes, pa.int32()), data, batch.column("anchor")], names=["id", "label", "size", "data", "anchor"])

    return rows.mapInArrow(run, f"id bigint, label {kind}, size int, data binary, anchor boolean")


class _Block:
    """The rows of one block by vector length, sorted by label and id; rows of equal id and label count once."""

    def __init__(self, rows: list[tuple]) -> None:
        self.parts: dict[int, tuple] = {}
        by_size: dict[int, dict] = {}
        for number, label, size, data in rows:
            own = by_size.setdefault(size, {})
            if (label, number) not in own or data < own[label, number]:
                own[label, number] = data
        for size, own in by_size.items():
            keys = sorted(own)
            ids = np.array([number for _, number in keys], np.int64)
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            slices: dict = {}
            for at, (label, _) in enumerate(keys):
                slices[label] = (slices.get(label, (at, at))[0], at + 1)
            matrix = np.array([_row(own[key]) for key in keys]).reshape(len(keys), size)
            self.parts[size] = (matrix, ids, place, slices, {})

    def packed(self, size: int, label: object = None) -> Packed:
        """The rows of a length, or of a length and label."""
        matrix, _, _, slices, made = self.parts[size]
        if label not in made:
            a, b = slices[label] if label is not None else (0, len(matrix))
            made[label] = Packed(matrix[a:b])
        return made[label]


def _leading(scores: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` highest scores, highest first, ties by place."""
    if len(scores) > 4 * most and scores.dtype != object:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        own = np.flatnonzero(scores >= least)
    else:
        own = np.arange(len(scores))
    order = sorted(own.tolist(), key=lambda n: (-scores[n], place[n])) if scores.dtype == object else own[np.lexsort((place[own], -scores[own]))]
    return np.array(order[:most], np.int64)


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, work, schema: str) -> DataFrame:
    """Let the anchors dealt to each block stream past its rows; `work(block, anchors)` yields result rows.

    A task holds one block of bounded size and a few anchors at a time.
    """
    extra = [name for name in anchors.columns if name not in rows.columns]
    kinds = dict(anchors.dtypes)
    own = rows.select("block", "id", "label", "size", "data", F.lit(0).alias("role"), *[F.lit(None).cast(kinds[name]).alias(name) for name in extra])
    both = own.unionByName(anchors.withColumn("role", F.lit(1)))
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        current, held, block = None, [], None
        for batch in batches:
            number = batch.column("block").to_numpy()
            role = batch.column("role").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(role) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if number[a] != current:
                    current, held, block = number[a], [], None
                part = batch.slice(a, b - a)
                columns = [part.column(name).to_pylist() for name in ("id", "label", "size", "data")]
                if role[a] == 0:
                    held += zip(*columns, strict=True)
                    continue
                if block is None:
                    block, held = _Block(held), []
                rest = [part.column(name).to_pylist() for name in extra]
                groups: dict[tuple, list] = {}
                for row in zip(*columns, *rest, strict=True):
                    if row[2] in block.parts:
                        groups.setdefault((row[2], row[1]), []).append(row)
                for (size, label), members in groups.items():
                    step = max(1, _SCORES // max(1, len(block.parts[size][0])))
                    for at in range(0, len(members), step):
                        made = list(work(block, size, label, members[at : at + step]))
                        if made:
                            kind = kind or pa.schema([(name, part.schema.field("label").type if name == "label" else pa.int64()) for name in names])
                            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*made, strict=True), kind, strict=True)], schema=kind)

    return both.repartition(blocks, "block").sortWithinPartitions("block", "role").mapInArrow(run, schema)


def _first_of(rows: DataFrame, group: list[str], most: int) -> DataFrame:
    """Rank from 1 within the group by (score descending, found id), up to `most`."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "found")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors' hard negatives.

    Scores are exact integer inner products; higher ones come first, ties by smaller id. An anchor's positives are its
    first other rows of the same label. For each, the negatives are the first rows of another label whose score lies
    between `low` and `high` hundredths of the positive's (none where that is negative).

    Rows with a null label, a null vector or a null or non-finite component take no part, null ids neither; vectors of
    another length than the anchor's do not meet it. Rows of equal id and label count once, with the smallest bytes of
    the vector where they differ. An empty table gives no rows. A score beyond 64 bits fails. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors.where(F.col(key).isNotNull()), key, label, vector, anchor, scale)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("label", "size"), F.lit(LABEL_BUCKETS)).cast("int"))
    counted = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("size")).collect()  # LABEL_BUCKETS rows at most
    total, longest = sum(r["rows"] for r in counted), max((r["size"] for r in counted), default=1)
    per_block = max(1, min(BLOCK_COMPONENTS // max(1, longest), max(BLOCK_ROWS, -(-total // (4 * spark.sparkContext.defaultParallelism)))))
    blocks = max(1, -(-total // per_block))
    places, start = [], 0
    for r in sorted(counted, key=lambda r: r["bucket"]):
        places.append((r["bucket"], start, r["rows"]))
        start += r["rows"]
    places = F.broadcast(spark.createDataFrame(places, "bucket int, start bigint, rows bigint"))

    def block(position: Column) -> Column:
        return F.floor((F.col("start") + position) / per_block).cast("int")

    placed = rows.join(places, "bucket").withColumn("block", block(F.pmod(F.xxhash64("id"), F.col("rows"))))
    dealt = placed.select("block", "id", "label", "size", "data")
    asked = placed.where("anchor").groupBy("id", "label", "size").agg(F.min("data").alias("data"), F.first("bucket").alias("bucket"))
    asked = cut_lineage(asked)
    own_blocks = F.explode(F.sequence(block(F.lit(0)), block(F.col("rows") - 1))).alias("block")
    kind = dict(rows.dtypes)["label"]

    def positive(block_: _Block, size: int, label_: object, members: list) -> Iterator[tuple]:
        _, ids, place, slices, _ = block_.parts[size]
        if label_ not in slices:
            return
        a, b = slices[label_]
        scores = block_.packed(size, label_).scores(np.stack([_row(m[3]) for m in members]))
        for member, own in zip(members, scores, strict=True):
            for at in _leading(own, place[a:b], positives + 1):  # one of them may be the anchor
                if ids[a + at] != member[0]:
                    yield member[0], label_, size, int(ids[a + at]), int(own[at])

    near = asked.join(places, "bucket").select(own_blocks, "id", "label", "size", "data")
    found = _met(dealt, near, blocks, positive, f"id bigint, label {kind}, size bigint, found bigint, score bigint")
    found = _first_of(found, ["id", "label", "size"], positives)
    bands = found.groupBy("id", "label", "size").agg(F.collect_list(F.struct("found", "score")).alias("positives"))  # `positives` each
    bands = asked.join(bands, ["id", "label", "size"]).select("id", "label", "size", "data", F.col("positives.found").alias("of"), F.col("positives.score").alias("scores"))
    bands = cut_lineage(bands)

    def negative(block_: _Block, size: int, label_: object, members: list) -> Iterator[tuple]:
        _, ids, place, slices, _ = block_.parts[size]
        scores = block_.packed(size).scores(np.stack([_row(m[3]) for m in members]))
        a, b = slices.get(label_, (0, 0))
        for member, own in zip(members, scores, strict=True):
            limits = [(least, most) for least, most in ((-(-low * s // 100), high * s // 100) for s in member[5]) if least <= most]
            if not limits:
                continue
            inside = (own >= min(limits)[0]) & (own <= max(most for _, most in limits))
            inside[a:b] = False
            at = np.flatnonzero(inside)
            for of, score in zip(member[4], member[5], strict=True):
                fit = at[(100 * own[at] >= low * score) & (100 * own[at] <= high * score)]
                for k in _leading(own[fit], place[fit], negatives):
                    yield member[0], label_, size, of, score, int(ids[fit[k]]), int(own[fit[k]])

    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    met = _met(dealt, bands.select(everywhere, "*"), blocks, negative, f"id bigint, label {kind}, size bigint, positive bigint, positive_score bigint, found bigint, score bigint")
    return _first_of(met, ["id", "label", "size", "positive"], negatives).select(
        F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("found").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth id; every seventh label is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return mine(rows, F.col("vec_id") % 100 == 0)

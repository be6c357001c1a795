"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfen.session import ensure_checkpoint_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def packed(rows: DataFrame) -> DataFrame:
    """The rows as one struct column `row_`, so that no computed column can clash with a name of theirs."""
    return rows.select(F.struct(*[rows[name] for name in rows.columns]).alias("row_"))


def by_batches(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch to the rows of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch)
            if made is not None and made.num_rows:
                yield made

    return rows.mapInArrow(run, schema)


def row_count(rows: DataFrame) -> int:
    return int(rows.agg(F.count(F.lit(1)).alias("rows")).first()["rows"])


def worker_state(name: str, make: Callable[[], object]) -> object:
    """A value that lives as long as the Python worker, so that later tasks of the worker find it again."""
    kept = sys.modules.setdefault("_quillfen_worker_state", types.ModuleType("_quillfen_worker_state"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


class BoundedMemo(dict):
    """A memo of `make(key)` in two generations of at most `limit` keys each; it only saves time.

    When the younger generation is full it becomes the older one; keys that are asked for again move back.
    """

    def __init__(self, make: Callable, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster names for checkpoints; executors and the driver share it."""
    ensure_checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

"""Writers: CSV with a header, JSON lines, and report tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A script's report table as CSV; complex columns are written as JSON text."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema
    ]
    write_csv(df.select(*flat), path, mode)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder; a temp folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="quillfen-")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")

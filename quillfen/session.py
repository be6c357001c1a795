"""Session helpers: defaults, size limits and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Above these sizes an operator leaves the one-task path for its distributed one.
ROWS_PER_TASK = "quillfen.rowsPerTask"
EXACT_VALUES = "quillfen.exactValues"
_DEFAULTS = {ROWS_PER_TASK: 2_000_000, EXACT_VALUES: 200_000}


def build_session(app: str = "quillfen", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the adaptive settings the operators rely on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def limit_of(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, str(_DEFAULTS[name])))


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; a temp folder only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="quillfen-checkpoint-")
        context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    ensure_checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def scalars(df: DataFrame, **aggregates: Column) -> dict:
    """Run one aggregate pass and return its single row as a dict."""
    row = df.agg(*[column.alias(name) for name, column in aggregates.items()]).first()
    return row.asDict() if row is not None else {}


def rounded(column: Column, digits: int) -> Column:
    """Half-to-even rounding of a double, as NumPy does it."""
    scale = float(10**digits)
    return F.rint(column.cast("double") * F.lit(scale)) / F.lit(scale)


def clock_micros(column: Column) -> Column:
    """Microseconds of a wall-clock time since 1970, whatever the session time zone."""
    clock = column.cast("timestamp_ntz")
    seconds = F.hour(clock) * 3600 + F.minute(clock) * 60
    micros = (F.extract(F.lit("SECOND"), clock) * 1_000_000).cast("long")
    return F.unix_date(F.to_date(clock)).cast("long") * 86_400_000_000 + seconds.cast("long") * 1_000_000 + micros


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null instead of failing on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))

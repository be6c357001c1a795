"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are drawn into a seeded order within their source and get the fractional rank (2 i + 1) / (2 n). Sorted by it, any
run of rows holds every source in its share of the whole, so equal cuts of that order follow the mixture. Ranks need
no global window: rows fall into buckets of about `PER_BUCKET` rows (by the leading digits of the draw within a source,
then by the fractional rank), counts of the buckets are summed up, and windows run inside buckets, which are even
because draws are uniform, however large a source is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillfen.llm.common import row_count, table, text_or_empty
from quillfen.session import cut_lineage

SHARDS = 16
SEED = 20
PER_BUCKET = 20_000


def shards(
    docs: DataFrame,
    count: int = SHARDS,
    seed: int = SEED,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    per_bucket: int = PER_BUCKET,
) -> DataFrame:
    """One row per document: key, size, text_crc32, law `rows`, shard, slot, grown_shard (null under this law).

    Row counts of shards differ by one at most; slots run from 0 without gaps in the order of the interleaving. A null
    source is a source of its own; a null text counts as empty (size 1). Rows of the same key and text are
    interchangeable and take their turns one after another. An empty table gives no rows.
    """
    own = text_or_empty(text)
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(own)))
    rows = cut_lineage(
        docs.select(
            F.col(key).alias("key"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("stratum"),
            F.col(source).isNull().alias("bare"),
            (F.octet_length(own) + 1).cast("long").alias("size"),
            F.crc32(own).alias("crc"),
            draw.alias("draw"),
        )
    )
    total = row_count(rows)
    buckets = total // per_bucket + 1
    lead = F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rows = rows.withColumn("bucket", F.floor(lead * buckets))

    within = ["stratum", "bare", "bucket"]
    line = Window.partitionBy("stratum", "bare").orderBy("bucket")
    sizes = rows.groupBy(*within).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(
        *within,
        (F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("stratum", "bare")).alias("of"),
    )
    turn = F.row_number().over(Window.partitionBy(*within).orderBy("draw", "key")) - 1
    ranked = rows.withColumn("turn", turn).join(sizes, within)
    rank = ((F.col("before") + F.col("turn")) * 2 + 1).cast("double") / (F.col("of") * 2).cast("double")
    ranked = ranked.select("key", "size", "crc", "draw", rank.alias("rank"))
    ranked = cut_lineage(ranked.withColumn("cell", F.least(F.floor(F.col("rank") * buckets), F.lit(buckets - 1))))

    cells = ranked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # one row per PER_BUCKET documents
    cells = cells.select("cell", (F.sum("n").over(order) - F.col("n")).alias("before"))
    turn = F.row_number().over(Window.partitionBy("cell").orderBy("rank", "draw", "key")) - 1
    placed = ranked.withColumn("turn", turn).join(cells, "cell").withColumn("place", F.col("before") + F.col("turn"))
    placed = placed.withColumn("shard", F.expr(f"place * {count} div {max(total, 1)}"))
    start = F.expr(f"(shard * {total} + {count - 1}) div {count}")
    return placed.select(
        F.col("key").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return shards(table(spark, folder, "documents"))


#: The CRC of a text is folded byte by byte through the table of the reflected polynomial 0xEDB88320.
SQL = f"""
WITH steps AS (SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(n)),
crc_table AS (SELECT list(v ORDER BY n) AS v FROM steps),
d AS (
  SELECT doc_id, source, coalesce(text, '') AS body, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
         md5('{SEED}' || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
r AS (SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY draw, doc_id) - 1) + 1)::DOUBLE
             / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS part FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY part, draw, doc_id) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, place * {SHARDS} // total AS shard FROM p)
SELECT doc_id, size,
       CAST(xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
            lambda c, b: xor(c >> 8, crc_table.v[1 + (xor(c, b) & 255)])), 4294967295) AS BIGINT) AS text_crc32,
       'rows' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(place - (shard * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s, crc_table
"""

"""Joining many tables along directed relationship links."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfen.session import ROWS_PER_TASK, cut_lineage, limit_of, scalars


@dataclass(frozen=True)
class Link:
    """One column pair from one table to another."""

    source: str
    source_column: str
    target: str
    target_column: str
    how: str | None = None
    alias: str | None = None


#: Hot keys up to this number are sent to all tasks (a few MB); more of them are joined like any table.
HOT_SENT = 100_000
_JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


def _free_name(taken: set[str], base: str) -> str:
    name, n = base, 0
    while name in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def join_pair(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, right_name: str,
    how: str = "inner", alias: str | None = None, indicator: bool = True, rows_per_task: int | None = None,
) -> DataFrame:
    """Equi-join in which null keys match null keys, clashing right columns get `_<table>`.

    A full join counts its keys first and deals those of more than `rows_per_task` rows (null among them) over
    several tasks, which the adaptive planner cannot do for it.
    """
    if alias:
        right, right_on = right.withColumnRenamed(right_on, alias), alias
    same_key = left_on == right_on
    clashes = {c: f"{c}_{right_name}" for c in right.columns if c in left.columns and c not in (left_on, right_on)}
    if right_on in left.columns and not same_key:
        clashes[right_on] = f"{right_on}_{right_name}"
    right = right.withColumnsRenamed(clashes)
    key = clashes.get(right_on, right_on)
    left_tag, right_tag, right_key = "_from_left", "_from_right", "_right_key"
    tagged_left = left.withColumn(left_tag, F.lit(1))
    tagged_right = right.withColumn(right_tag, F.lit(1)).withColumnRenamed(key, right_key)
    kinds = [side.schema[c].dataType for side, c in ((tagged_left, left_on), (tagged_right, right_key))]
    # Keys of unlike types are equal by a cast that counting by value cannot see; such joins are left to the planner.
    alike = kinds[0] == kinds[1] or all(isinstance(k, T.IntegralType) for k in kinds)
    if _JOIN_TYPES[how] == "full" and alike:
        limit = rows_per_task or limit_of(left.sparkSession, ROWS_PER_TASK)
        joined = _full_join(tagged_left, left_on, left_tag, tagged_right, right_key, right_tag, limit)
    else:
        joined = tagged_left.join(
            tagged_right, F.col(left_on).eqNullSafe(F.col(right_key)), _JOIN_TYPES[how]
        )
    columns = [F.col(c) for c in left.columns]
    if same_key:
        # One shared key column, as a merge on equal names gives.
        shared = F.when(F.col(left_tag).isNotNull(), F.col(left_on)).otherwise(F.col(right_key))
        columns = [shared.alias(c) if c == left_on else F.col(c) for c in left.columns]
    columns += [
        F.col(right_key).alias(c) if c == key else F.col(c)
        for c in right.columns if not (same_key and c == key)
    ]
    if indicator:
        name = _free_name({*left.columns, *right.columns}, f"_merge_{right_name}")
        columns.append(
            F.when(F.col(right_tag).isNull(), "left_only")
            .when(F.col(left_tag).isNull(), "right_only")
            .otherwise("both")
            .alias(name)
        )
    return joined.select(*columns)


def hot_keys(left: DataFrame, left_on: str, right: DataFrame, right_on: str, limit: int) -> DataFrame:
    """Keys of more than `limit` rows on a side: parts to deal the longer side over, which side, and whether both have it.

    There are at most rows / `limit` of them a side.
    """
    longest = F.greatest("left_rows", "right_rows")
    return key_histogram(left, left_on, right, right_on).where(longest > limit).select(
        F.col("key").alias("_hot_key"),
        F.ceil(longest / limit).cast("int").alias("_parts"),
        (F.col("left_rows") >= F.col("right_rows")).alias("_left_dealt"),
        ((F.col("left_rows") > 0) & (F.col("right_rows") > 0)).alias("_on_both"),
    )


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(field.dataType) for field in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _full_join(
    left: DataFrame, left_on: str, left_tag: str, right: DataFrame, right_on: str, right_tag: str, limit: int
) -> DataFrame:
    """Full outer join whose hot keys meet in parts: the longer side of a key is dealt, the other one is copied to all.

    Rows of a key that both sides have always match, so a copy that meets no row of its part is no unmatched row and
    goes. The part of a row follows from its values and its input partition, not from its place there: a task that runs
    again deals it the same way.
    """
    hot = cut_lineage(hot_keys(left, left_on, right, right_on, limit))
    known = hot.count()
    if not known:
        return left.join(right, F.col(left_on).eqNullSafe(F.col(right_on)), "full")
    hot = F.broadcast(hot) if known <= HOT_SENT else hot

    def dealt(side: DataFrame, on: str, longer: bool) -> DataFrame:
        values = [F.col(f.name) for f in side.schema.fields if _hashable(f.dataType)]
        placed = side.withColumn("_own", F.xxhash64(*values, F.spark_partition_id()))
        placed = placed.join(hot, F.col(on).eqNullSafe(F.col("_hot_key")), "left")
        here = (F.col("_left_dealt") == F.lit(longer)) | ~F.col("_on_both")
        one = F.array(F.pmod("_own", "_parts").cast("int"))
        parts = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(here, one)
        parts = parts.otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
        return placed.withColumn("_part", F.explode(parts)).drop("_own", "_hot_key", "_parts", "_left_dealt")

    a = dealt(left, left_on, True).withColumnsRenamed({"_part": "_left_part", "_on_both": "_left_both"})
    b = dealt(right, right_on, False).withColumnsRenamed({"_part": "_right_part", "_on_both": "_right_both"})
    same = F.col(left_on).eqNullSafe(F.col(right_on)) & (F.col("_left_part") == F.col("_right_part"))
    lonely = F.col(left_tag).isNull() | F.col(right_tag).isNull()
    copy = F.coalesce("_left_both", "_right_both", F.lit(False)) & lonely
    return a.join(b, same, "full").where(~copy).drop("_left_part", "_left_both", "_right_part", "_right_both")


class JoinGraph:
    """Named tables and links, folded breadth-first into one lazy plan."""

    def __init__(self, tables: Mapping[str, DataFrame]) -> None:
        self.tables = dict(tables)
        self.links: list[Link] = []

    def link(
        self, source: str, source_column: str, target: str, target_column: str,
        how: str | None = None, alias: str | None = None,
    ) -> JoinGraph:
        for table, column in ((source, source_column), (target, target_column)):
            if column not in self.tables[table].columns:
                raise ValueError(f"no column {column} in {table}")
        self.links.append(Link(source, source_column, target, target_column, how, alias))
        return self

    def steps(self, start: str) -> list[Link]:
        """Links in the order they are joined; every table is joined once."""
        visited, queue, order = {start}, deque([start]), []
        while queue:
            table = queue.popleft()
            for link in self.links:
                if link.source == table and link.target not in visited:
                    visited.add(link.target)
                    queue.append(link.target)
                    order.append(link)
        return order

    def build(self, start: str, how: str = "inner", indicator: bool = True, guard: bool = False) -> DataFrame:
        """All steps in one plan; `guard` counts keys before every step and refuses a join that explodes."""
        result = self.tables[start]
        for link in self.steps(start):
            if guard:
                refuse_explosion(result, link.source_column, self.tables[link.target], link.target_column, link.how or how)
            result = join_pair(
                result, self.tables[link.target], link.source_column, link.target_column,
                link.target, link.how or how, link.alias, indicator,
            )
        return result


def key_histogram(left: DataFrame, left_on: str, right: DataFrame, right_on: str) -> DataFrame:
    """Rows per key on both sides; nothing is multiplied out."""
    a = left.groupBy(F.col(left_on).alias("key")).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(F.col(right_on).alias("_key")).agg(F.count(F.lit(1)).alias("right_rows"))
    return a.join(b, F.col("key").eqNullSafe(F.col("_key")), "full").select(
        F.coalesce("key", "_key").alias("key"),
        F.coalesce("left_rows", F.lit(0)).alias("left_rows"),
        F.coalesce("right_rows", F.lit(0)).alias("right_rows"),
    )


def join_estimate(
    left: DataFrame, left_on: str, right: DataFrame, right_on: str, how: str = "inner", max_growth: int = 10
) -> DataFrame:
    """Exact output size, match rate and explosion flag of a join, before running it."""
    both = F.col("left_rows") * F.col("right_rows")
    lonely_left = F.when(F.col("right_rows") == 0, F.col("left_rows")).otherwise(F.lit(0))
    lonely_right = F.when(F.col("left_rows") == 0, F.col("right_rows")).otherwise(F.lit(0))
    rows = both
    if how in ("left", "outer", "full"):
        rows = rows + lonely_left
    if how in ("right", "outer", "full"):
        rows = rows + lonely_right
    sums = key_histogram(left, left_on, right, right_on).agg(
        F.sum("left_rows").alias("rows_before"),
        F.sum("right_rows").alias("right_rows"),
        F.sum(rows).alias("rows_after"),
    )
    return sums.withColumns(
        {
            "match_rate": F.try_divide(F.col("rows_after") * F.lit(100.0), F.col("rows_before")),
            "explodes": F.col("rows_after") > F.greatest("rows_before", "right_rows") * max_growth,
        }
    )


def refuse_explosion(left: DataFrame, left_on: str, right: DataFrame, right_on: str, how: str = "inner") -> None:
    row = scalars(join_estimate(left, left_on, right, right_on, how), explodes=F.bool_or("explodes"))
    if row["explodes"]:
        raise ValueError("join explodes: check key uniqueness")


def guarded_join(left: DataFrame, left_on: str, right: DataFrame, right_on: str, right_name: str, how: str = "inner"):
    """join_pair that refuses an exploding join."""
    refuse_explosion(left, left_on, right, right_on, how)
    return join_pair(left, right, left_on, right_on, right_name, how)


def key_overlap(left: DataFrame, left_on: str, right: DataFrame, right_on: str) -> DataFrame:
    """Exact Jaccard similarity of the two non-null key sets."""
    sides = key_histogram(left.dropna(subset=[left_on]), left_on, right.dropna(subset=[right_on]), right_on)
    shared = F.count_if((F.col("left_rows") > 0) & (F.col("right_rows") > 0))
    return sides.agg(
        shared.alias("shared_keys"),
        F.count(F.lit(1)).alias("all_keys"),
        F.try_divide(shared.cast("double"), F.count(F.lit(1)).cast("double")).alias("jaccard"),
    )


def key_cardinality(left: DataFrame, left_on: str, right: DataFrame, right_on: str) -> DataFrame:
    """many-to-many / many-to-one / one-to-many / one-to-one from uniqueness on each side."""
    sides = key_histogram(left, left_on, right, right_on)
    known = F.col("key").isNotNull()
    out = sides.agg(
        F.sum("left_rows").alias("left_rows"),
        F.count_if(known & (F.col("left_rows") > 0)).alias("left_unique"),
        F.sum("right_rows").alias("right_rows"),
        F.count_if(known & (F.col("right_rows") > 0)).alias("right_unique"),
    )
    many_left = F.col("left_unique") < F.col("left_rows")
    many_right = F.col("right_unique") < F.col("right_rows")
    return out.withColumn(
        "relationship",
        F.when(many_left & many_right, "many-to-many")
        .when(many_left, "many-to-one")
        .when(many_right, "one-to-many")
        .otherwise("one-to-one"),
    )


def preview_join(
    left: DataFrame, left_on: str, right: DataFrame, right_on: str, right_name: str,
    how: str = "inner", rows: int = 5000, seed: int = 42,
) -> DataFrame:
    """Join of a random sample of about `rows` rows from each side."""

    def sampled(df: DataFrame) -> DataFrame:
        total = df.count()
        return df if total <= rows else df.sample(rows / total, seed)

    return join_pair(sampled(left), sampled(right), left_on, right_on, right_name, how)


def save_table(df: DataFrame, name: str, persistent: bool = False) -> DataFrame:
    """Register a join result under a new name."""
    if persistent:
        df.write.mode("overwrite").saveAsTable(name)
        return df.sparkSession.table(name)
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def surviving_filters(df: DataFrame, filters: dict) -> dict:
    """Filters whose column still exists after a join result replaced the main table."""
    return {c: spec for c, spec in filters.items() if c in df.columns}

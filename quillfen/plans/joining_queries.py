"""Queries of joins, the relationship graph and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfen.operators.set_ops import preview_set_op, set_op
from quillfen.plans import join_graph as jg
from quillfen.plans.registry import Tables, query, rnd, sql_rnd

# Labels whose key is sometimes null, so that null keys meet null keys.
LEFT_SQL = "(SELECT CASE WHEN doc_id % 50 = 0 THEN NULL ELSE doc_id END AS k, lang FROM documents)"
RIGHT_SQL = "(SELECT CASE WHEN doc_id % 100 = 1 THEN NULL ELSE doc_id END AS k, quality FROM labels)"


def left_side(t: Tables):
    return t.documents.select(F.when(F.col("doc_id") % 50 != 0, F.col("doc_id")).alias("k"), "lang")


def right_side(t: Tables):
    return t.labels.select(F.when(F.col("doc_id") % 100 != 1, F.col("doc_id")).alias("k"), "quality")


def outcome(df):
    return df.groupBy("lang", "quality", "_merge_labels").agg(
        F.count(F.lit(1)).alias("rows"), F.count("k").alias("keys"), F.sum("k").alias("key_sum")
    )


def join_query(name: str, how: str, sql_how: str) -> None:
    sql = f"""SELECT lang, quality, CASE WHEN r.one IS NULL THEN 'left_only' WHEN l.one IS NULL THEN 'right_only'
          ELSE 'both' END AS _merge_labels, COUNT(*) AS rows,
        COUNT(CASE WHEN l.one IS NOT NULL THEN l.k ELSE r.k END) AS keys,
        CAST(SUM(CASE WHEN l.one IS NOT NULL THEN l.k ELSE r.k END) AS BIGINT) AS key_sum
      FROM (SELECT *, 1 AS one FROM {LEFT_SQL}) l {sql_how} JOIN (SELECT *, 1 AS one FROM {RIGHT_SQL}) r
        ON l.k IS NOT DISTINCT FROM r.k GROUP BY ALL"""

    @query(name, sql)
    def _(t: Tables):
        return outcome(jg.join_pair(left_side(t), right_side(t), "k", "k", "labels", how))


join_query("jn1_inner_join_null_keys", "inner", "INNER")
join_query("jn2_left_join", "left", "LEFT")
join_query("jn2_right_join", "right", "RIGHT")
join_query("jn2_outer_join", "outer", "FULL")


HOT_LEFT_SQL = """(SELECT CASE WHEN l_orderkey % 2 = 0 THEN NULL WHEN l_orderkey % 10 IN (1, 3, 5) THEN 1 ELSE l_orderkey END
        AS k, l_quantity AS quantity, 1 AS one FROM lineitem)"""
HOT_RIGHT_SQL = """(SELECT CASE WHEN o_orderkey = (SELECT MIN(o_orderkey) FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 != 0) THEN NULL
        ELSE o_orderkey END AS k, o_orderpriority AS priority, 1 AS one FROM orders WHERE o_orderkey % 3 != 0)"""


@query(
    "jn2_outer_hot_keys",
    f"""SELECT CASE WHEN r.one IS NULL THEN 'left_only' WHEN l.one IS NULL THEN 'right_only' ELSE 'both' END AS _merge_orders,
        COALESCE(l.k, r.k) IS NULL AS unknown, COUNT(*) AS rows, COUNT(quantity) AS items, COUNT(priority) AS found,
        CAST(SUM(COALESCE(l.k, r.k)) AS BIGINT) AS key_sum, CAST(SUM(quantity) AS BIGINT) AS pieces
      FROM {HOT_LEFT_SQL} l FULL JOIN {HOT_RIGHT_SQL} r ON l.k IS NOT DISTINCT FROM r.k GROUP BY ALL""",
)
def _(t: Tables):
    number = F.col("l_orderkey")
    key = F.when(number % 2 == 0, None).when((number % 10).isin(1, 3, 5), 1).otherwise(number)
    items = t.lineitem.select(key.cast("long").alias("k"), F.col("l_quantity").alias("quantity"))
    some = t.orders.filter("o_orderkey % 3 != 0")
    least = some.filter("o_orderkey % 2 = 0").agg(F.min("o_orderkey").alias("least")).first()["least"]
    some = some.select(F.nullif("o_orderkey", F.lit(least)).cast("long").alias("k"), F.col("o_orderpriority").alias("priority"))
    # Half of the items have no key and about 30 % one key: both are dealt over several tasks at any size.
    out = jg.join_pair(items, some, "k", "k", "orders", "outer", rows_per_task=2000)
    return out.groupBy("_merge_orders", F.col("k").isNull().alias("unknown")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("quantity").alias("items"), F.count("priority").alias("found"),
        F.sum("k").alias("key_sum"), F.sum("quantity").cast("long").alias("pieces"),
    )


@query(
    "jn3_match_indicator",
    """SELECT CASE WHEN o_custkey IS NULL THEN 'left_only' ELSE 'both' END AS _merge_orders, COUNT(*) AS rows
       FROM customer LEFT JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000) o
       ON c_custkey = o_custkey GROUP BY 1""",
)
def _(t: Tables):
    some = t.orders.filter("o_orderstatus = 'P' AND o_totalprice > 400000").select("o_custkey")
    out = jg.join_pair(t.customer.select("c_custkey"), some, "c_custkey", "o_custkey", "orders", "left")
    return out.groupBy("_merge_orders").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "jn4_conflict_renaming",
    """SELECT c.c_name AS name, s.s_name AS name_supplier, c.c_nationkey AS nation, s.s_suppkey AS id
       FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey WHERE c.c_custkey = s.s_suppkey""",
)
def _(t: Tables):
    c = t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), "c_custkey")
    s = t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    out = jg.join_pair(c, s, "nation", "nation", "supplier", indicator=False)
    return out.filter("c_custkey = id").drop("c_custkey")


@query(
    "jn5_key_alias",
    "SELECT o_orderkey, c_custkey AS buyer, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
)
def _(t: Tables):
    return jg.join_pair(
        t.orders, t.customer, "o_custkey", "c_custkey", "customer", alias="buyer", indicator=False
    ).select("o_orderkey", "buyer", "c_name")


@query(
    "jn7_guarded_graph",
    "SELECT n_name, COUNT(*) AS orders, TRUE AS refused FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)
def _(t: Tables):
    graph = jg.JoinGraph({"orders": t.orders, "customer": t.customer, "nation": t.nation})
    graph.link("orders", "o_custkey", "customer", "c_custkey").link("customer", "c_nationkey", "nation", "n_nationkey")
    refused = False
    try:
        jg.JoinGraph({"orders": t.orders, "lineitem": t.lineitem}).link("orders", "o_orderstatus", "lineitem", "l_linestatus").build("orders", guard=True)
    except ValueError:
        refused = True
    joined = graph.build("orders", indicator=False, guard=True)
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.lit(refused).alias("refused"))


@query(
    "jn6_join_graph",
    f"""SELECT r_name, n_name, COUNT(*) AS lines, {sql_rnd('SUM(l_quantity)', 2)} AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN part ON l_partkey = p_partkey GROUP BY r_name, n_name""",
)
def _(t: Tables):
    names = ("lineitem", "orders", "customer", "nation", "region", "part")
    graph = (
        jg.JoinGraph({n: getattr(t, n) for n in names})
        .link("lineitem", "l_orderkey", "orders", "o_orderkey")
        .link("lineitem", "l_partkey", "part", "p_partkey", how="left")
        .link("orders", "o_custkey", "customer", "c_custkey")
        .link("customer", "c_nationkey", "nation", "n_nationkey")
        .link("nation", "n_regionkey", "region", "r_regionkey")
    )
    return graph.build("lineitem", indicator=False).groupBy("r_name", "n_name").agg(
        F.count(F.lit(1)).alias("lines"), rnd(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "jn7_explosion_guard",
    """WITH l AS (SELECT c_nationkey k, COUNT(*) n FROM customer GROUP BY 1),
            r AS (SELECT s_nationkey k, COUNT(*) n FROM supplier GROUP BY 1)
       SELECT CAST((SELECT SUM(n) FROM l) AS BIGINT) AS rows_before, CAST((SELECT SUM(n) FROM r) AS BIGINT) AS right_rows,
              CAST(SUM(l.n * r.n) AS BIGINT) AS rows_after,
              SUM(l.n * r.n) > 10 * GREATEST((SELECT SUM(n) FROM l), (SELECT SUM(n) FROM r)) AS explodes
       FROM l JOIN r USING (k)""",
)
def _(t: Tables):
    return jg.join_estimate(t.customer, "c_nationkey", t.supplier, "s_nationkey").drop("match_rate")


@query(
    "jn8_match_rate",
    f"""SELECT {sql_rnd('100.0 * (SELECT COUNT(*) FROM documents JOIN labels USING (doc_id)) / (SELECT COUNT(*) FROM documents)', 6)}
        AS match_rate""",
)
def _(t: Tables):
    return jg.join_estimate(t.documents, "doc_id", t.labels, "doc_id").select(rnd("match_rate", 6).alias("match_rate"))


@query(
    "jn9_key_overlap",
    f"""WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels)
        SELECT COUNT(*) FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS shared_keys, COUNT(*) AS all_keys,
        {sql_rnd('COUNT(*) FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) / COUNT(*)', 6)} AS jaccard
        FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
)
def _(t: Tables):
    return jg.key_overlap(t.documents, "doc_id", t.labels, "doc_id").withColumn("jaccard", rnd("jaccard", 6))


@query(
    "jn10_key_cardinality",
    """SELECT CAST((SELECT COUNT(*) FROM orders) AS BIGINT) AS left_rows, (SELECT COUNT(DISTINCT o_custkey) FROM orders) AS left_unique,
       CAST((SELECT COUNT(*) FROM customer) AS BIGINT) AS right_rows, (SELECT COUNT(DISTINCT c_custkey) FROM customer) AS right_unique,
       'many-to-one' AS relationship""",
)
def _(t: Tables):
    return jg.key_cardinality(t.orders, "o_custkey", t.customer, "c_custkey")


@query("jn11_join_preview")
def _(t: Tables):
    return jg.preview_join(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "orders", "left").select(
        "l_orderkey", "l_linenumber", "_merge_orders"
    )


@query(
    "jn11_preview_facts",
    "SELECT true AS from_source, true AS same_again, true AS near_size, true AS marks_fit, COUNT(*) AS rows FROM lineitem",
)
def _(t: Tables):
    # What any preview must hold: its rows are rows of the join's left table, a seed gives them again, about 5 000 are
    # drawn, and a row is marked as met exactly where its order was drawn too.
    def shown() -> DataFrame:
        return jg.preview_join(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "orders", "left")

    def side(rows: DataFrame, own: int) -> DataFrame:
        return rows.groupBy("l_orderkey", "l_linenumber").agg(*[(F.count(F.lit(1)) if k == own else F.lit(0)).alias(f"n{k}") for k in range(3)])

    fits = (F.col("_merge_orders") == "both") == F.col("o_orderstatus").isNotNull()
    marks = shown().agg(F.bool_and(fits).alias("marks_fit"))
    sides = side(t.lineitem, 0).unionByName(side(shown(), 1)).unionByName(side(shown(), 2))
    per = sides.groupBy("l_orderkey", "l_linenumber").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(3)])
    rows, drawn = F.sum("n0"), F.sum("n1")
    wanted = F.least(rows, F.lit(5000))
    return per.agg(
        F.bool_and(F.col("n1") <= F.col("n0")).alias("from_source"), F.bool_and(F.col("n1") == F.col("n2")).alias("same_again"),
        (F.abs(drawn - wanted) <= 6 * F.sqrt(wanted)).alias("near_size"), rows.alias("rows"),
    ).withColumn("marks_fit", marks.scalar())


@query(
    "snk4_save_join_result",
    "SELECT n_name, COUNT(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
)
def _(t: Tables):
    joined = jg.join_pair(t.supplier, t.nation, "s_nationkey", "n_nationkey", "nation")
    saved = jg.save_table(joined, "supplier_nation")
    return saved.groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"))


# ---- set operations -----------------------------------------------------------

A_SQL = "(SELECT n_nationkey AS k, n_regionkey AS g FROM nation)"
B_SQL = "(SELECT c_nationkey AS k, CAST(c_custkey % 5 AS INTEGER) AS g FROM customer)"


def side_a(t: Tables):
    a = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("g"))
    return a.unionByName(a)


def side_b(t: Tables):
    return t.customer.select((F.col("c_custkey") % 5).cast("int").alias("g"), F.col("c_nationkey").alias("k"))


_TWICE = f"(SELECT * FROM {A_SQL} UNION ALL SELECT * FROM {A_SQL})"


@query("set1_union", f"SELECT k, g FROM {A_SQL} UNION SELECT k, g FROM {B_SQL}")
def _(t: Tables):
    return set_op(side_a(t), side_b(t), "union")


@query(
    "set2_union_all",
    f"""SELECT k, g, extra, COUNT(*) AS n FROM (SELECT k, g, NULL::INTEGER AS extra FROM {_TWICE}
        UNION ALL SELECT k, g, 1 FROM {B_SQL}) GROUP BY ALL""",
)
def _(t: Tables):
    wide = side_b(t).withColumn("extra", F.lit(1))
    both = set_op(wide, side_a(t), "union_all")
    return both.groupBy("k", "g", "extra").agg(F.count(F.lit(1)).alias("n"))


@query("set3_intersect", f"SELECT k, g FROM {A_SQL} INTERSECT SELECT k, g FROM {B_SQL}")
def _(t: Tables):
    return set_op(side_a(t), side_b(t), "intersect")


@query(
    "set4_except",
    f"""SELECT k, g FROM {_TWICE} a WHERE NOT EXISTS (SELECT 1 FROM {B_SQL} b WHERE b.g < 2
        AND a.k IS NOT DISTINCT FROM b.k AND a.g IS NOT DISTINCT FROM b.g)""",
)
def _(t: Tables):
    return set_op(side_a(t), side_b(t).filter("g < 2"), "except")


@query(
    "set5_positional",
    f"SELECT k, g FROM {A_SQL} INTERSECT SELECT g AS k, k AS g FROM {B_SQL}",
)
def _(t: Tables):
    return set_op(side_a(t), side_b(t), "intersect", match_by_name=False)


@query("set6_preview", f"SELECT k, g FROM {A_SQL} UNION SELECT k, g FROM {B_SQL}")
def _(t: Tables):
    return preview_set_op(side_a(t), side_b(t), "union", rows=None)


@query("set6_preview_sample", "SELECT TRUE AS from_sides, TRUE AS full, TRUE AS repeats")
def _(t: Tables):
    left, right = t.orders.select("o_orderkey", "o_custkey"), t.orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey")
    first, second = (preview_set_op(left, right, "union_all", rows=50) for _ in range(2))
    inside = set_op(first, left, "except").agg(F.count(F.lit(1)).alias("outside"), F.lit(0).alias("one"))
    rows = first.agg(F.count(F.lit(1)).alias("rows"), F.lit(0).alias("one"))
    changed = first.exceptAll(second).agg(F.count(F.lit(1)).alias("changed"), F.lit(0).alias("one"))
    return inside.join(rows, "one").join(changed, "one").select(
        (F.col("outside") == 0).alias("from_sides"), (F.col("rows") == 100).alias("full"), (F.col("changed") == 0).alias("repeats")
    )

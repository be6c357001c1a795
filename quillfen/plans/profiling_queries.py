"""Queries of profiles, data quality and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from quillfen.operators import correlation as cor
from quillfen.operators import profile as prf
from quillfen.operators import quality as ql
from quillfen.plans.registry import Tables, query, rnd, sql_rnd

# Orders with missing values, duplicate rows and a constant column.
DIRTY_SQL = """(SELECT o_orderkey, o_custkey, NULLIF(o_orderstatus, 'P') AS status, o_totalprice,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate, 'EUR' AS currency FROM orders
    UNION ALL SELECT o_orderkey, o_custkey, NULLIF(o_orderstatus, 'P'), o_totalprice,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END, 'EUR' FROM orders WHERE o_orderkey % 10 = 0)"""


def dirty(t: Tables):
    o = t.orders.select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_totalprice",
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("o_orderdate"), F.lit("EUR").alias("currency"),
    )
    return o.unionByName(o.filter("o_orderkey % 10 = 0"))


_MISS = "(COUNT(*) * 2 - COUNT(status) - COUNT(o_orderdate))"


@query(
    "prf1_dataset_summary",
    f"""WITH d AS (SELECT * FROM {DIRTY_SQL}) SELECT COUNT(*) AS row_count, 6 AS col_count, 'o_orderkey, o_custkey, o_totalprice' AS numeric_columns,
        'status, currency' AS categorical_columns, 'o_orderdate' AS datetime_columns, {_MISS} AS missing_count,
        {sql_rnd(f'100.0 * {_MISS} / (COUNT(*) * 6)')} AS missing_percentage,
        COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_count,
        {sql_rnd('100.0 * (COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM d))) / COUNT(*)')} AS duplicate_percentage FROM d""",
)
def _(t: Tables):
    out = prf.dataset_summary(dirty(t)).drop("estimated_mb", "column_types")
    return out.withColumns({c: rnd(c) for c in ("missing_percentage", "duplicate_percentage")})


@query(
    "prf2_validation",
    f"""WITH d AS (SELECT * FROM {DIRTY_SQL}) SELECT 'warning' AS level, 'duplicate rows' AS finding,
        {sql_rnd('COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM d))')} AS amount FROM d
        UNION ALL SELECT 'warning', 'missing values', {sql_rnd(f'100.0 * {_MISS} / (COUNT(*) * 6)')} FROM d
        UNION ALL SELECT 'warning', 'constant column: currency', 1.0""",
)
def _(t: Tables):
    return prf.validate_dataset(dirty(t)).withColumn("amount", rnd("amount"))


@query(
    "prf3_column_table",
    f"""WITH top AS (SELECT status FROM {DIRTY_SQL} WHERE status IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, status LIMIT 1)
        SELECT 'o_custkey' AS column, 'numeric' AS type, COUNT(o_custkey) AS non_null, 0.0::DOUBLE AS null_percent, COUNT(DISTINCT o_custkey) AS unique,
        {sql_rnd('AVG(o_custkey)')} AS mean FROM {DIRTY_SQL}
        UNION ALL SELECT 'status', 'text', COUNT(status), {sql_rnd('100.0 - 100.0 * COUNT(status) / COUNT(*)')}, COUNT(DISTINCT status), NULL FROM {DIRTY_SQL}
        UNION ALL SELECT 'o_orderdate', 'datetime', COUNT(o_orderdate), {sql_rnd('100.0 - 100.0 * COUNT(o_orderdate) / COUNT(*)')}, COUNT(DISTINCT o_orderdate), NULL FROM {DIRTY_SQL}""",
)
def _(t: Tables):
    out = prf.column_table(dirty(t)).filter("column IN ('o_custkey', 'status', 'o_orderdate')")
    return out.select("column", "type", "non_null", rnd("null_percent").alias("null_percent"), "unique", rnd("mean").alias("mean"))


def statistics_sql(column: str, table: str) -> str:
    parts = {
        "mean": f"AVG({column})", "std": f"STDDEV_SAMP({column})", "min": f"MIN({column})", "q25": f"quantile_cont({column}, 0.25)",
        "q50": f"quantile_cont({column}, 0.5)", "q75": f"quantile_cont({column}, 0.75)", "max": f"MAX({column})",
        "skew": f"SKEWNESS({column})", "kurtosis": f"KURTOSIS({column})",
    }
    measures = ", ".join(f"{sql_rnd(e)} AS {n}" for n, e in parts.items())
    return f"SELECT '{column}' AS column, COUNT({column}) AS count, {measures} FROM {table}"


@query(
    "prf4_statistics",
    " UNION ALL ".join(statistics_sql(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount"))
    + " UNION ALL " + statistics_sql("value", "events"),
)
def _(t: Tables):
    out = prf.statistics_table(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).unionByName(
        prf.statistics_table(t.events, ["value"])
    )
    return out.select("column", "count", *[rnd(c).alias(c) for c in out.columns[2:]])


@query(
    "prf5_missing_table",
    f"""SELECT 'status' AS column, COUNT(*) - COUNT(status) AS missing, {sql_rnd('100.0 - 100.0 * COUNT(status) / COUNT(*)')} AS percent FROM {DIRTY_SQL}
        UNION ALL SELECT 'o_orderdate', COUNT(*) - COUNT(o_orderdate), {sql_rnd('100.0 - 100.0 * COUNT(o_orderdate) / COUNT(*)')} FROM {DIRTY_SQL}""",
)
def _(t: Tables):
    return prf.missing_table(dirty(t)).withColumn("percent", rnd("percent"))


@query(
    "prf6_rich_summary",
    f"""WITH d AS (SELECT * FROM {DIRTY_SQL}), c AS (SELECT status, COUNT(*) n FROM d WHERE status IS NOT NULL GROUP BY 1)
        SELECT 'status' AS column, COUNT(*) - COUNT(status) AS missing, COUNT(DISTINCT status) AS unique,
        (SELECT string_agg(status || '=' || n, ', ' ORDER BY n DESC, status) FROM c) AS top_values, NULL::DOUBLE AS median, 'low_cardinality' AS distribution,
        {sql_rnd(f'0.7 * (100 - 100.0 * {_MISS} / (COUNT(*) * 6)) + 0.3 * 100 * 5 / 6')} AS quality_score FROM d
        UNION ALL SELECT 'currency', 0, 1, 'EUR=' || COUNT(*), NULL, 'low_cardinality', {sql_rnd(f'0.7 * (100 - 100.0 * {_MISS} / (COUNT(*) * 6)) + 0.3 * 100 * 5 / 6')} FROM d""",
)
def _(t: Tables):
    out = prf.rich_summary(dirty(t)).filter("column IN ('status', 'currency')")
    return out.select("column", "missing", "unique", "top_values", "median", "distribution", rnd("quality_score").alias("quality_score"))


@query(
    "prf7_top_values",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, value, count, CAST(rn AS INTEGER) AS rank FROM (SELECT CAST({c} AS VARCHAR) AS value, COUNT(*) AS count,
            ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR)) AS rn FROM part GROUP BY 1) WHERE rn <= 10"""
        for c in ("p_name", "p_brand", "p_type", "p_size")
    ),
)
def _(t: Tables):
    return prf.top_values(t.part, ["p_name", "p_brand", "p_type", "p_size"])


@query(
    "prf8_semantic_types",
    """SELECT * FROM (VALUES ('c_custkey', 'numeric'), ('c_name', 'categorical'), ('c_acctbal', 'currency'), ('c_mktsegment', 'categorical'),
       ('active', 'boolean'), ('order_status', 'stage'), ('tax_rate', 'percentage'), ('share', 'percentage'), ('joined', 'datetime'), ('seen', 'datetime'), ('row_id', 'id')) v("column", semantic_type)""",
)
def _(t: Tables):
    base = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").withColumns(
        {
            "active": F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("No"),
            "order_status": F.col("c_mktsegment"),
            "tax_rate": F.col("c_acctbal"),
            "share": F.col("c_custkey") % 101,
            "joined": F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")), "yyyy-MM-dd"),
            "seen": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")),
            "row_id": F.col("c_custkey").cast("string"),
        }
    )
    return prf.semantic_table(base).drop("junk")


@query(
    "prf9_junk_columns",
    """SELECT * FROM (VALUES ('event_id', true), ('ts', false), ('user_id', true), ('event_type', false), ('value', false), ('props', false)) v("column", junk)""",
)
def _(t: Tables):
    return prf.semantic_table(t.events).select("column", "junk")


def outlier_sql(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS column, COUNT(*) FILTER (WHERE {column} < a - 1.5 * (b - a) OR {column} > b + 1.5 * (b - a)) AS outliers, COUNT(*) AS n
        FROM {table}, (SELECT quantile_cont({column}, 0.25) a, quantile_cont({column}, 0.75) b FROM {table})"""


@query(
    "prf10_outlier_share",
    f"""SELECT "column", outliers, {sql_rnd('outliers / n', 6)} AS share, outliers / n > 0.01 AND outliers / n < 0.05 AS flagged
        FROM ({outlier_sql('events', 'value')} UNION ALL {outlier_sql('events', 'user_id')})""",
)
def _(t: Tables):
    return prf.outlier_table(t.events, ["value", "user_id"]).withColumn("share", rnd("share", 6))


@query(
    "prf11_negative_metrics",
    f"""SELECT 'profit' AS column, COUNT(*) FILTER (WHERE c_acctbal < 2000) AS negatives, {sql_rnd('COUNT(*) FILTER (WHERE c_acctbal < 2000) / COUNT(*)', 6)} AS share,
        COUNT(*) FILTER (WHERE c_acctbal < 2000) / COUNT(*) > 0.1 AS flagged FROM customer""",
)
def _(t: Tables):
    c = t.customer.select((F.col("c_acctbal") - 2000).alias("profit"), "c_acctbal")
    return prf.negative_table(c).withColumn("share", rnd("share", 6))


@query(
    "prf12_health_score",
    f"""WITH d AS (SELECT * FROM {DIRTY_SQL}), m AS (SELECT COUNT(*) AS n, 100.0 * {_MISS} / (COUNT(*) * 6) AS missing,
          100.0 * (COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM d))) / COUNT(*) AS dup FROM d)
        SELECT CAST(round_even(100 - missing * (CASE WHEN n > 10000 THEN 0.8 ELSE 0.4 END) - 0.2 * dup - 3 + 8, 0) AS INTEGER) AS score,
        CASE WHEN n > 10000 THEN 'transactional' ELSE 'general' END AS dataset_type, false AS capped, '' AS caps FROM m""",
)
def _(t: Tables):
    return ql.health_score(dirty(t))


@query(
    "prf13_dataset_type",
    """SELECT 'lineitem' AS name, CASE WHEN (SELECT COUNT(*) FROM lineitem) > 10000 THEN 'transactional' ELSE 'general' END AS kind
       UNION ALL SELECT 'flags', 'aggregated' UNION ALL SELECT 'part', 'general'""",
)
def _(t: Tables):
    tables = {"lineitem": t.lineitem, "flags": t.orders.select("o_orderstatus", "o_orderpriority"), "part": t.part.select("p_partkey", "p_name")}
    rows = [(n, ql.dataset_type(prf.profile(df, top=0, spread=False))) for n, df in tables.items()]
    return t.spark.createDataFrame(rows, "name string, kind string")


@query(
    "prf14_severity",
    """SELECT event_type, CASE WHEN r > 0.1 * f THEN 'critical' WHEN r > 0.05 * f THEN 'high' WHEN r > 0.01 * f THEN 'medium' ELSE 'low' END AS severity
       FROM (SELECT event_type, COUNT(*) FILTER (WHERE value > CASE event_type WHEN 'click' THEN 50 WHEN 'view' THEN 150 WHEN 'error' THEN 250 ELSE 400 END) / COUNT(*) AS r,
             (SELECT CASE WHEN COUNT(*) < 1000 THEN 1 WHEN COUNT(*) < 100000 THEN 2 ELSE 3 END FROM events) AS f FROM events GROUP BY 1)""",
)
def _(t: Tables):
    limit = F.when(F.col("event_type") == "click", 50).when(F.col("event_type") == "view", 150).when(F.col("event_type") == "error", 250).otherwise(400)
    shares = t.events.groupBy("event_type").agg(F.avg((F.col("value") > limit).cast("double")).alias("r")).collect()
    n = t.events.count()
    return t.spark.createDataFrame([(r["event_type"], ql.severity(r["r"], n)) for r in shares], "event_type string, severity string")


def issue_query(name: str, category: str, build, sql: str | None) -> None:
    @query(name, sql)
    def _(t: Tables):
        out = ql.issues(build(t), limit=1000, only=[category])
        return out.select("category", "columns", "severity", rnd("ratio", 6).alias("ratio"))


def sev(ratio: str, n: str, thresholds: tuple[float, float, float]) -> str:
    low, mid, high = sorted(thresholds)
    factor = f"(CASE WHEN {n} < 1000 THEN 1 WHEN {n} < 100000 THEN 2 ELSE 3 END)"
    return f"CASE WHEN {ratio} > {high} * {factor} THEN 'critical' WHEN {ratio} > {mid} * {factor} THEN 'high' WHEN {ratio} > {low} * {factor} THEN 'medium' ELSE 'low' END"


_STATUS_MISS, _DATE_MISS = "(1 - COUNT(status) / COUNT(*))", "(1 - COUNT(o_orderdate) / COUNT(*))"
issue_query(
    "prf15_issue_missing", "missing", dirty,
    f"""SELECT 'missing' AS category, 'status' AS columns, {sev(_STATUS_MISS, 'COUNT(*)', (0.05, 0.10, 0.20))} AS severity, {sql_rnd(_STATUS_MISS, 6)} AS ratio FROM {DIRTY_SQL}
        UNION ALL SELECT 'missing', 'o_orderdate', {sev(_DATE_MISS, 'COUNT(*)', (0.02, 0.05, 0.10))}, {sql_rnd(_DATE_MISS, 6)} FROM {DIRTY_SQL}""",
)
_DUP = "((COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM d))) / COUNT(*))"
issue_query(
    "prf16_issue_duplicates", "duplicates_exact", dirty,
    f"WITH d AS (SELECT * FROM {DIRTY_SQL}) SELECT 'duplicates_exact' AS category, '' AS columns, {sev(_DUP, 'COUNT(*)', (0.05, 0.10, 0.20))} AS severity, {sql_rnd(_DUP, 6)} AS ratio FROM d",
)
NAMES_SQL = "(SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN upper(p_name) || '  ' || CAST(p_partkey % 97 AS VARCHAR) WHEN p_partkey % 7 = 0 THEN ' ' || p_name || ' ' || CAST(p_partkey % 97 AS VARCHAR) ELSE p_name || ' ' || CAST(p_partkey % 97 AS VARCHAR) END AS label FROM part)"


def messy_names(t: Tables):
    tail = (F.col("p_partkey") % 97).cast("string")
    label = (
        F.when(F.col("p_partkey") % 6 == 0, F.concat(F.upper("p_name"), F.lit("  "), tail))
        .when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(" "), F.col("p_name"), F.lit(" "), tail))
        .otherwise(F.concat(F.col("p_name"), F.lit(" "), tail))
    )
    return t.part.select("p_partkey", label.alias("label")).union(t.part.select("p_partkey", label.alias("label")))


_TWICE = f"(SELECT * FROM {NAMES_SQL} UNION ALL SELECT * FROM {NAMES_SQL})"
_NEAR = f"""(SELECT SUM(n) FILTER (WHERE n > 1) FROM (SELECT COUNT(*) n FROM {_TWICE} GROUP BY trim(lower(label))))
    - (SELECT SUM(n) FILTER (WHERE n > 1) FROM (SELECT COUNT(*) n FROM {_TWICE} GROUP BY label))"""


@query("prf17_issue_near_duplicates", f"WITH d AS (SELECT * FROM {NAMES_SQL}) SELECT CAST((SELECT SUM(n) FILTER (WHERE n > 1) FROM (SELECT COUNT(*) n FROM d GROUP BY trim(lower(label)))) - (SELECT SUM(n) FILTER (WHERE n > 1) FROM (SELECT COUNT(*) n FROM d GROUP BY label)) AS BIGINT) AS near_duplicates")
def _(t: Tables):
    n = ql.near_duplicates(messy_names(t).dropDuplicates(["p_partkey"]), "label")
    return t.spark.createDataFrame([(n,)], "near_duplicates long")


def skewed(t: Tables):
    key = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        F.when(key % 20 == 0, "x").otherwise("y").alias("mostly"),
        F.when(key % 50 == 0, 1).otherwise(0).alias("flag"),
        (F.col("o_totalprice") - 60000).alias("price"),
        F.col("o_totalprice").alias("total"),
        F.when(key % 10 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("copy"),
        F.when(key % 3 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("shipped"),
    )


SKEWED_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN 'x' ELSE 'y' END AS mostly, CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS flag,
    o_totalprice - 60000 AS price, o_totalprice AS total, CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE o_totalprice END AS copy, o_orderdate,
    CASE WHEN o_orderkey % 3 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS shipped FROM orders)"""
issue_query(
    "prf18_issue_near_constant", "near_constant", skewed,
    f"""SELECT 'near_constant' AS category, 'mostly' AS columns, 'low' AS severity, {sql_rnd("COUNT(*) FILTER (WHERE mostly = 'y') / COUNT(*)", 6)} AS ratio FROM {SKEWED_SQL}
        UNION ALL SELECT 'near_constant', 'flag', 'low', {sql_rnd('COUNT(*) FILTER (WHERE flag = 0) / COUNT(*)', 6)} FROM {SKEWED_SQL}""",
)
issue_query(
    "prf11_issue_negative", "negative_values", skewed,
    f"SELECT 'negative_values' AS category, 'price' AS columns, {sev('COUNT(*) FILTER (WHERE price < 0) / COUNT(*)', 'COUNT(*)', (0.01, 0.05, 0.1))} AS severity, {sql_rnd('COUNT(*) FILTER (WHERE price < 0) / COUNT(*)', 6)} AS ratio FROM {SKEWED_SQL}",
)
issue_query(
    "prf19_issue_correlation", "high_correlation", skewed,
    f"SELECT 'high_correlation' AS category, 'price, total' AS columns, 'medium' AS severity, {sql_rnd('CORR(price, total)', 6)} AS ratio FROM {SKEWED_SQL}",
)
issue_query(
    "prf20_issue_redundant", "redundant_columns", skewed,
    f"SELECT 'redundant_columns' AS category, 'total, copy' AS columns, 'low' AS severity, {sql_rnd('AVG((total = copy)::INT)', 6)} AS ratio FROM {SKEWED_SQL}",
)
issue_query(
    "prf21_issue_mixed_dates", "date_format", skewed,
    f"SELECT 'date_format' AS category, 'shipped' AS columns, 'medium' AS severity, {sql_rnd("COUNT(*) FILTER (WHERE shipped <> 'soon') / COUNT(*)", 6)} AS ratio FROM {SKEWED_SQL}",
)
issue_query(
    "prf22_issue_outliers", "outliers", lambda t: t.events.select("value", "event_type"),
    f"SELECT 'outliers' AS category, 'value' AS columns, {sev('outliers / n', 'n', (0.05, 0.10, 0.20))} AS severity, {sql_rnd('outliers / n', 6)} AS ratio FROM ({outlier_sql('events', 'value')})",
)
issue_query(
    "prf23_issue_imbalance", "imbalance", skewed,
    f"SELECT 'imbalance' AS category, 'flag' AS columns, CASE WHEN COUNT(*) FILTER (WHERE flag = 0) / COUNT(*) > 0.95 THEN 'high' ELSE 'medium' END AS severity, {sql_rnd('COUNT(*) FILTER (WHERE flag = 0) / COUNT(*)', 6)} AS ratio FROM {SKEWED_SQL}",
)


@query("prf24_issue_ranking")
def _(t: Tables):
    return ql.issues(skewed(t).withColumn("o_orderdate", F.lit(None).cast("timestamp_ntz")))


@query(
    "prf25_characteristics",
    f"""WITH c AS (SELECT event_type, COUNT(*) n FROM events GROUP BY 1), u AS (SELECT props, COUNT(*) n FROM events GROUP BY 1)
        SELECT 'value' AS column, {sql_rnd('SKEWNESS(value)')} AS skew, NULL::DOUBLE AS imbalance_ratio, false AS high_cardinality, false AS temporal FROM events
        UNION ALL SELECT 'event_type', NULL, {sql_rnd('MAX(n) / MIN(n)', 2)}, false, false FROM c
        UNION ALL SELECT 'props', NULL, {sql_rnd('MAX(n) / MIN(n)', 2)}, COUNT(*) > 50, false FROM u
        UNION ALL SELECT 'ts', NULL, NULL, false, true""",
)
def _(t: Tables):
    out = prf.characteristics_table(t.events).filter("column IN ('value', 'event_type', 'props', 'ts')")
    return out.select("column", rnd("skew").alias("skew"), rnd("imbalance_ratio", 2).alias("imbalance_ratio"), "high_cardinality", "temporal")


@query(
    "prf26_complexity_score",
    f"""WITH s AS (SELECT COUNT(*) n, (ABS(SKEWNESS(value)) + ABS(SKEWNESS(user_id))) / 2 AS k FROM events)
        SELECT {sql_rnd("LEAST(10, ROUND(LEAST(2, LOG10(GREATEST(1, n / 1000)) * 0.5) + 0.4 + LEAST(2, ROUND(k, 2) * 0.5) + 1, 1) + LEAST(2, n * 44 / 1048576 / 100))", 3)} AS score FROM s""",
)
def _(t: Tables):
    score = prf.complexity_score(t.events.select("ts", "user_id", "event_type", "value"))
    return t.spark.createDataFrame([(score,)], "score double").select(rnd("score", 3).alias("score"))


@query(
    "prf27_readiness",
    f"""SELECT true AS valid, 'valid' AS reason, COUNT(*) AS rows, 6 AS columns, 3 AS numeric_columns, 2 AS categorical_columns, 1 AS datetime_columns,
        {sql_rnd(f'100.0 * {_MISS} / (COUNT(*) * 6)')} AS missing_percentage, false AS warns FROM {DIRTY_SQL}""",
)
def _(t: Tables):
    return prf.readiness(dirty(t)).withColumn("missing_percentage", rnd("missing_percentage"))


# ---- correlation -----------------------------------------------------------------

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def matrix_sql(table: str, columns: tuple[str, ...], function: str, diagonal: bool) -> str:
    cells = []
    for x in columns:
        for y in columns:
            value = "1.0::DOUBLE" if x == y and diagonal else sql_rnd(f"{function}({x}, {y})", 5)
            cells.append(f"SELECT '{x}' AS x, '{y}' AS y, {value} AS value FROM {table}")
            if x == y and diagonal:
                cells[-1] += " LIMIT 1"
                cells[-1] = f"({cells[-1]})"
    return " UNION ALL ".join(cells)


@query("cor1_pearson_matrix", matrix_sql("(SELECT NULLIF(l_discount, 0) AS l_discount, l_quantity, l_extendedprice, l_tax FROM lineitem WHERE l_discount <> 0)", NUMBERS, "CORR", True))
def _(t: Tables):
    lines = t.lineitem.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return cor.matrix(lines, NUMBERS).withColumn("value", rnd("value", 5))


_RANKS = "(SELECT " + ", ".join(
    f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in NUMBERS
) + " FROM lineitem)"


@query("cor2_spearman_matrix", matrix_sql(_RANKS, NUMBERS, "CORR", True))
def _(t: Tables):
    return cor.matrix(t.lineitem, NUMBERS, "spearman").withColumn("value", rnd("value", 5))


@query("cor3_covariance_matrix", matrix_sql("lineitem", NUMBERS, "COVAR_SAMP", False))
def _(t: Tables):
    return cor.matrix(t.lineitem, NUMBERS, "covariance").withColumn("value", rnd("value", 5))


@query(
    "cor4_significance",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS x, '{b}' AS y, {sql_rnd('r', 5)} AS r, n AS points, ABS(r * SQRT((n - 2) / (1 - r * r))) < 1.96 AS insignificant
            FROM (SELECT CORR({a}, {b}) AS r, COUNT(*) AS n FROM lineitem)"""
        for a, b in combinations(NUMBERS, 2)
    ),
)
def _(t: Tables):
    return cor.significance(t.lineitem, NUMBERS).drop("p_value").withColumn("r", rnd("r", 5))


@query("cor5_correlation_matrix", matrix_sql("part", ("p_partkey", "p_size", "p_retailprice"), "CORR", True))
def _(t: Tables):
    return cor.matrix(t.part, ("p_partkey", "p_size", "p_retailprice"), complete=False).withColumn("value", rnd("value", 5))


_ALL_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, CORR({a}, {b}) AS r FROM lineitem" for a, b in combinations(NUMBERS, 2)
)


@query("cor6_top_pairs", f"SELECT x, y, {sql_rnd('r', 5)} AS corr, 0 AS business_relevance FROM ({_ALL_PAIRS}) ORDER BY ABS(r) DESC LIMIT 3")
def _(t: Tables):
    return cor.top_pairs(t.lineitem, NUMBERS, 3).withColumn("corr", rnd("corr", 5))


@query(
    "cor6_top_pairs_business_first",
    f"""SELECT x, y, {sql_rnd('r', 5)} AS corr, CAST((x = 'l_discount')::INT + (y = 'l_discount')::INT AS INTEGER) AS business_relevance
        FROM ({_ALL_PAIRS}) ORDER BY 4 DESC, ABS(r) DESC LIMIT 4""",
)
def _(t: Tables):
    return cor.top_pairs(t.lineitem, NUMBERS, 4, business_terms=("disc",)).withColumn("corr", rnd("corr", 5))


@query(
    "cor7_target_correlation",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {sql_rnd(f'ABS(CORR({c}, l_extendedprice))', 5)} AS correlation_with_target FROM lineitem"
        for c in NUMBERS if c != "l_extendedprice"
    ),
)
def _(t: Tables):
    return cor.target_correlation(t.lineitem, NUMBERS, "l_extendedprice").withColumn(
        "correlation_with_target", rnd("correlation_with_target", 5)
    )


@query("cor8_price_quantity", f"SELECT {sql_rnd('CORR(l_extendedprice / l_quantity, l_quantity)', 5)} AS r FROM lineitem")
def _(t: Tables):
    lines = t.lineitem.withColumn("unit_price", F.col("l_extendedprice") / F.col("l_quantity"))
    return lines.agg(rnd(cor.pair_correlation("unit_price", "l_quantity"), 5).alias("r"))

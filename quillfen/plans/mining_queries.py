"""Queries of insight mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfen.operators import insights as ins
from quillfen.plans.registry import Tables, query, rnd, sql_rnd

# Prices differ by type and brand so that some segments stand out.
BASE_SQL = """(SELECT p_type, p_brand, p_name, p_size, p_retailprice * CASE p_type WHEN 'PROMO' THEN 9 WHEN 'SMALL' THEN 2 ELSE 1 END AS revenue,
    p_retailprice * CASE p_brand WHEN 'Brand#1' THEN 900 ELSE 1 END AS sales, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_size END AS price_code FROM part)"""
CATS, METRICS = ("p_type", "p_brand", "p_name"), ("revenue", "sales", "p_size")


def base(t: Tables):
    return t.part.select(
        "p_type", "p_brand", "p_name", "p_size",
        (F.col("p_retailprice") * F.when(F.col("p_type") == "PROMO", 9).when(F.col("p_type") == "SMALL", 2).otherwise(1)).alias("revenue"),
        (F.col("p_retailprice") * F.when(F.col("p_brand") == "Brand#1", 900).otherwise(1)).alias("sales"),
        F.when(F.col("p_type") != "PROMO", F.col("p_size")).alias("price_code"),
    )


SEGMENTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS category, {c} AS segment, '{m}' AS metric, SUM({m})::DOUBLE AS total, AVG({m}) AS mean, COUNT({m}) AS count,
        (SELECT AVG({m}) FROM d) AS overall, (SELECT COUNT(*) FROM d) AS rows FROM d GROUP BY 2"""
    for c in CATS for m in METRICS
)
HEAD = f"WITH d AS (SELECT * FROM {BASE_SQL}), s AS ({SEGMENTS})"
RELATIONS = f"""{HEAD}, a AS (SELECT *, total / SUM(total) OVER (PARTITION BY category, metric) AS share, mean / overall AS ratio,
      COUNT(*) OVER (PARTITION BY category, metric) AS groups FROM s),
    f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY category, metric ORDER BY share DESC) AS rn FROM a
      WHERE groups >= 3 AND count >= 0.05 * rows AND share >= 0.02 AND ratio >= 1.5),
    r AS (SELECT category, metric, segment, share, ratio, count, CASE WHEN share > 0.5 THEN 'dependency_risk' ELSE 'business_relationship' END AS type,
      CASE WHEN share > 0.5 THEN 2.5 ELSE 1.5 END::DOUBLE AS multiplier FROM f WHERE rn = 1)"""


@query(
    "ins1_relationships",
    f"{RELATIONS} SELECT category, metric, segment AS top_segment, {sql_rnd('share', 6)} AS share, {sql_rnd('ratio', 6)} AS ratio, count AS rows, type FROM r ORDER BY r.share * r.ratio DESC LIMIT 5",
)
def _(t: Tables):
    out = ins.relationships(base(t), CATS, METRICS, limit=5).drop("multiplier")
    return out.withColumns({"share": rnd("share", 6), "ratio": rnd("ratio", 6)})


@query(
    "ins1_segments",
    f"{HEAD} SELECT category, segment, metric, {sql_rnd('total', 2)} AS total, {sql_rnd('mean')} AS mean, count FROM s",
)
def _(t: Tables):
    out = ins.segment_table(base(t), CATS, METRICS)
    return out.withColumns({"total": rnd("total", 2), "mean": rnd("mean")})


@query("ins2_dependency_risk", f"{RELATIONS} SELECT category, metric, segment AS top_segment FROM r WHERE type = 'dependency_risk'")
def _(t: Tables):
    out = ins.relationships(base(t), CATS, METRICS)
    return out.filter("type = 'dependency_risk'").select("category", "metric", "top_segment")


PARETO = f"""{HEAD}, w AS (SELECT *, SUM(total) OVER (PARTITION BY category, metric ORDER BY total DESC, segment) / SUM(total) OVER (PARTITION BY category, metric) AS cum,
      ROW_NUMBER() OVER (PARTITION BY category, metric ORDER BY total DESC, segment) AS rn, COUNT(*) OVER (PARTITION BY category, metric) AS groups FROM s),
    p AS (SELECT category, metric, MAX(groups) AS groups, COUNT(*) FILTER (WHERE cum <= 0.8) + 1 AS pareto_point, MIN(cum) FILTER (WHERE cum > 0.8) AS concentration,
      MAX(segment) FILTER (WHERE rn = 1) AS top_item FROM w WHERE groups >= 5 GROUP BY 1, 2),
    k AS (SELECT *, CASE WHEN pareto_point = 1 THEN 'dependency_risk' WHEN pareto_point <= 3 THEN 'strong_pareto'
      WHEN pareto_point <= 5 THEN 'moderate_concentration' WHEN pareto_point >= 10 THEN 'healthy_distribution' END AS type FROM p),
    m AS (SELECT *, CASE type WHEN 'dependency_risk' THEN 2.5 WHEN 'strong_pareto' THEN 2.0 WHEN 'moderate_concentration' THEN 1.5 WHEN 'healthy_distribution' THEN 1.0 END::DOUBLE AS multiplier FROM k)"""


@query(
    "ins3_pareto",
    f"{PARETO} SELECT category, metric, groups, pareto_point, {sql_rnd('concentration', 6)} AS concentration, top_item, type, multiplier FROM m",
)
def _(t: Tables):
    return ins.pareto(base(t), CATS, METRICS).withColumn("concentration", rnd("concentration", 6))


@query(
    "ins4_missing_impact",
    f"""WITH d AS (SELECT * FROM {BASE_SQL}), x AS (SELECT AVG((price_code IS NULL)::INT) AS missing_share, AVG(revenue) FILTER (WHERE price_code IS NULL) AS a,
          AVG(revenue) FILTER (WHERE price_code IS NOT NULL) AS b FROM d)
        SELECT 'price_code' AS missing_column, 'revenue' AS metric, {sql_rnd('missing_share', 6)} AS missing_share, {sql_rnd('a')} AS mean_missing,
        {sql_rnd('b')} AS mean_present, {sql_rnd('(a - b) / ABS(b)', 6)} AS difference, 'missing_data_opportunity' AS type FROM x""",
)
def _(t: Tables):
    out = ins.missing_impact(base(t), ["price_code"], ["revenue", "p_size"]).drop("multiplier")
    return out.withColumns(
        {"missing_share": rnd("missing_share", 6), "mean_missing": rnd("mean_missing"), "mean_present": rnd("mean_present"), "difference": rnd("difference", 6)}
    )


@query(
    "ins5_best_per_metric",
    f"""{PARETO}, b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY multiplier DESC, category) AS rn FROM m WHERE type IS NOT NULL)
        SELECT category, metric, type, multiplier FROM b WHERE rn = 1 ORDER BY metric LIMIT 3""",
)
def _(t: Tables):
    return ins.best_per_metric(ins.pareto(base(t), CATS, METRICS), limit=3).select("category", "metric", "type", "multiplier")


@query("ins1_relationships_all", f"{RELATIONS} SELECT category, metric, segment AS top_segment, type FROM r")
def _(t: Tables):
    return ins.relationships(base(t), CATS, METRICS).select("category", "metric", "top_segment", "type")


@query(
    "ins6_ranking",
    f"""{PARETO} SELECT category, metric, type, {sql_rnd("multiplier * CASE type WHEN 'dependency_risk' THEN 10 WHEN 'strong_pareto' THEN 7 WHEN 'moderate_concentration' THEN 5 ELSE 3 END")} AS priority,
        {sql_rnd("CASE type WHEN 'dependency_risk' THEN 0.9 WHEN 'strong_pareto' THEN 0.7 WHEN 'moderate_concentration' THEN 0.5 ELSE 0.4 END", 6)} AS impact
        FROM m WHERE type IS NOT NULL ORDER BY priority DESC, impact DESC, metric, type, category LIMIT 5""",
)
def _(t: Tables):
    found = ins.pareto(base(t), CATS, METRICS).filter(F.col("type").isNotNull())
    out = ins.ranked(found, limit=5)
    return out.select("category", "metric", "type", rnd("priority").alias("priority"), rnd("impact", 6).alias("impact"))


@query("ins6_mine_all")
def _(t: Tables):
    out = ins.mine(base(t), CATS, METRICS, ["price_code"])
    return out.select("type", "category", "metric", rnd("priority").alias("priority"), rnd("impact").alias("impact"))


@query(
    "ins7_leader_ratio",
    f"""WITH m AS (SELECT event_type, AVG(value) AS mean, ROW_NUMBER() OVER (ORDER BY AVG(value) DESC) AS rn FROM events GROUP BY 1)
        SELECT MAX(event_type) FILTER (WHERE rn = 1) AS leader, {sql_rnd('MAX(mean) FILTER (WHERE rn = 1)')} AS first,
        {sql_rnd('MAX(mean) FILTER (WHERE rn = 2)')} AS second, {sql_rnd('MAX(mean) FILTER (WHERE rn = 1) / MAX(mean) FILTER (WHERE rn = 2)', 6)} AS ratio FROM m""",
)
def _(t: Tables):
    out = ins.leader_ratio(t.events, "event_type", "value")
    return out.withColumns({"first": rnd("first"), "second": rnd("second"), "ratio": rnd("ratio", 6)})


@query(
    "ins8_variation",
    f"""WITH e AS (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1), p AS (SELECT n / SUM(n) OVER () AS p, COUNT(*) OVER () AS k FROM e)
        SELECT 'value' AS "column", {sql_rnd('LEAST(1, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / ABS(MEDIAN(value)))', 6)} AS variation FROM events
        UNION ALL SELECT 'event_type', {sql_rnd('-SUM(p * LOG2(p + 1e-9)) / LOG2(MAX(k) + 1e-9)', 6)} FROM p""",
)
def _(t: Tables):
    return ins.variation_scores(t.events.select("value", "event_type")).withColumn("variation", rnd("variation", 6))

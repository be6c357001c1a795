"""Hand-written frames: empty, one row, all null, constant, ties, null keys, zero denominators."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillfen.functions import calc
from quillfen.operators import (
    business, calc as ordered_calc, charts, cleaning, cohorts, correlation, dates, features, filters, insights, profile,
    quality, sampling, textclean, timeseries,
)
from quillfen.operators.quantiles import cut_codes, quantiles
from quillfen.operators.set_ops import set_op
from quillfen.plans.join_graph import JoinGraph, join_pair
from quillfen.sources import readers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, column, sample=None):
    base = spark.createDataFrame(sample or [(1,)], "x int")
    return base.select(column).first()[0]


def test_registration_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 300 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_quantiles_of_empty_constant_and_null_columns(spark):
    empty = spark.createDataFrame([], "x double")
    assert quantiles(empty, ["x"], [0.5])["x"] == [None]
    df = spark.createDataFrame([(5.0, None), (5.0, None)], "x double, y double")
    got = quantiles(df, ["x", "y"], [0.1, 0.9])
    assert got == {"x": [5.0, 5.0], "y": [None, None]}


@pytest.mark.parametrize("bins", [4, 5, 10])
def test_quantile_codes_match_pandas(spark, bins):
    values = [0, 0, 0, 0, 1, 2, 3, 3, 3, 9, 11, 20]
    want = pd.qcut(pd.Series(values), bins, labels=False, duplicates="drop").tolist()
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    edges = quantiles(df, ["x"], [k / bins for k in range(bins + 1)])["x"]
    assert [r[0] for r in df.orderBy("i").select(cut_codes(F.col("x"), edges)).collect()] == want


def test_filters_never_match_nulls_unless_told(spark):
    df = spark.createDataFrame([(1, "nan"), (2, None), (3, "b")], "id int, s string")
    search = {"filters": {"s": {"type": "text", "search": "NAN"}}}
    assert rows(filters.apply_filters(df, search)) == [(1, "nan")]
    search["null_handling"] = {"s": "include"}
    assert [r[0] for r in rows(filters.apply_filters(df, search))] == [1, 2]
    assert filters.apply_filters(df, {}).count() == 3
    assert filters.filter_impact(df.limit(0), search).first()["kept_percent"] is None


def test_set_operations_keep_their_multiplicity(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "y"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([("x", 2), (None, 1)], "v string, k int")
    assert rows(set_op(a, b, "except")) == [(3, "y"), (3, "y")]
    assert rows(set_op(a, b, "intersect")) == [(1, None), (2, "x")]
    assert set_op(a, b, "union_all").count() == 7
    assert set_op(a, b, "union").count() == 3


def test_null_keys_join_each_other(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k int, x string")
    b = spark.createDataFrame([(None, "z"), (2, "w")], "k int, x string")
    inner = join_pair(a, b, "k", "k", "b")
    assert rows(inner) == [(None, "b", "z", "both"), (None, "c", "z", "both")]
    full = join_pair(a, b, "k", "k", "b", "outer")
    assert full.columns == ["k", "x", "x_b", "_merge_b"]
    assert sorted(r["_merge_b"] for r in full.collect()) == ["both", "both", "left_only", "right_only"]


def test_graph_joins_each_table_once(spark):
    t = spark.createDataFrame([(1, 1)], "a int, b int")
    g = JoinGraph({"x": t, "y": t, "z": t}).link("x", "a", "y", "a").link("y", "b", "z", "b").link("x", "b", "z", "b")
    assert [s.target for s in g.steps("x")] == ["y", "z"]
    assert g.build("x").count() == 1
    with pytest.raises(ValueError):
        g.link("x", "nope", "y", "a")


def test_duplicates_keep_first_last_none(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, None, 2), (4, None, 5), (5, "b", 0)], "id int, k string, v int")
    keep = lambda how: sorted(r["id"] for r in cleaning.remove_duplicates(df, ["k"], how, ["id"]).collect())
    assert keep("first") == [1, 3, 5]
    assert keep("last") == [2, 4, 5]
    assert keep(None) == [5]
    assert sorted(r["id"] for r in cleaning.duplicate_members(df, ["k"]).collect()) == [1, 2, 3, 4]


def test_imputation_strategies(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 4.0, None), (3, None, "a"), (4, 8.0, "b"), (5, None, None)], "i int, x double, s string")
    by = lambda d, c: [r[c] for r in d.orderBy("i").collect()]
    assert by(cleaning.fill_mean(df), "x") == [6.0, 4.0, 6.0, 8.0, 6.0]
    assert by(cleaning.fill_mode(df, ["s"]), "s") == ["a", "a", "a", "b", "a"]
    assert by(cleaning.interpolate(df, ["x"], ["i"]), "x") == [None, 4.0, 6.0, 8.0, 8.0]
    assert by(cleaning.fill_forward(df, ["s"], ["i"]), "s") == ["a", "a", "a", "b", "b"]
    assert cleaning.choose_strategies(df)["x"] == "drop_column"
    done = cleaning.impute(df)
    assert done.data.columns == ["i", "s"] and done.summary["columns_dropped"] == 1
    assert cleaning.impute(df, "drop_rows").data.count() == 1
    nothing = spark.createDataFrame([(None,)], "s string")
    assert cleaning.fill_mode(nothing, ["s"]).first()["s"] == "Unknown"


def test_type_detection_prefers_the_earlier_type(spark):
    df = spark.createDataFrame([("1", None), ("0", None), ("1", None)], "flag string, gone string")
    found = {r["column"]: r["detected_type"] for r in cleaning.detect_types(df).report.collect()}
    assert found == {"flag": "integer", "gone": "null_only"}


def test_dates_of_every_format(spark):
    day = dt.datetime(2021, 2, 3)
    texts = [(day.strftime(f),) for f in ("%Y-%m-%d", "%d/%m/%Y", "%d %b %Y", "%B %d, %Y", "%Y%m%d", "%d-%B-%Y")] + [("soon",), (None,)]
    df = spark.createDataFrame(texts, "s string")
    got = [r[0] for r in df.select(dates.parse_any(F.col("s"))).collect()]
    assert got[:6] == [day] * 6 and got[6:] == [None, None]
    padded = spark.createDataFrame([(" " * 200 + t[0] + " " * 200,) for t in texts[:6]], "s string")
    assert [r[0] for r in padded.select(dates.parse_any(F.col("s"))).collect()] == [day] * 6
    assert padded.select(dates.parse_generic(F.col("s"))).first()[0] == day


def test_split_handles_regex_delimiters(spark):
    df = spark.createDataFrame([("a|b",), ("c|",), ("d|e",), (None,)], "s string")
    out = cleaning.split_column(df, "s", "|")
    assert rows(out.data) == rows(spark.createDataFrame([("a", "b"), ("c", None), ("d", "e"), (None, None)], "x string, y string"))
    assert out.report["rows_with_missing_parts"] == 1


def test_masking_is_idempotent_enough_to_hide_everything(spark):
    df = spark.createDataFrame([("write a.b+c@x.org or d@y.io",)], "s string")
    masked = df.select(textclean.mask(F.col("s"), ["email"]).alias("s"))
    assert masked.first()[0] == "write ***@x.org or ***@y.io"
    assert masked.select(textclean.mask(F.col("s"), ["email"])).first()[0].count("***@") == 2


def test_profile_of_small_frames(spark):
    empty = spark.createDataFrame([], "a int, b string")
    p = profile.profile(empty)
    assert p.rows == 0 and p.columns["a"].distinct == 0
    assert quality.health_score(empty).first()["score"] == 0
    assert quality.issues(empty).first()["category"] == "empty"
    single = spark.createDataFrame([(1, "x", None)], "a int, b string, c double")
    assert profile.profile(single).columns["c"].nulls == 1
    assert profile.statistics_table(single, ["a"]).first()["std"] is None


def test_adjusted_moments_match_pandas(spark):
    values = [1.0, 2.0, 2.5, 7.0, 9.0, 30.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = profile.statistics_table(df, ["x"]).first()
    assert row["skew"] == pytest.approx(pd.Series(values).skew())
    assert row["kurtosis"] == pytest.approx(pd.Series(values).kurtosis())


def test_severity_scale():
    assert quality.severity(0.2, 10) == "critical"
    assert quality.severity(0.06, 10) == "high"
    assert quality.severity(0.06, 5_000) == "medium"
    assert quality.severity(0.06, 500_000) == "medium"
    assert quality.severity(0.001, 10) == "low"


def test_constant_columns_do_not_correlate(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    cells = {(r["x"], r["y"]): r["value"] for r in correlation.matrix(df, ["a", "b"]).collect()}
    assert cells[("a", "b")] is None and cells[("a", "a")] == 1.0
    assert correlation.significance(df, ["a", "b"]).first()["insignificant"]


def test_average_ranks_match_pandas(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = [r["r"] for r in correlation.average_rank(df, "x", "r").orderBy("i").collect()]
    want = pd.Series(values).rank().tolist()
    assert got[:3] + got[4:] == want[:3] + want[4:] and got[3] is None


def test_bins_sum_to_all_rows(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * F.col("id") % 97).cast("double"))
    assert charts.histogram(df, "x", 13).agg(F.sum("count")).first()[0] == 1000
    constant = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert charts.histogram(constant, "x", 5).first()["count"] == 2
    assert charts.density_curve(constant, "x").count() == 0


def test_pie_refuses_negative_values(spark):
    df = spark.createDataFrame([("a", -1.0), ("b", 2.0)], "n string, v double")
    with pytest.raises(ValueError):
        charts.pie_slices(df, "n", "v")
    slices = charts.pie_slices(spark.createDataFrame([(c,) for c in "aaaabbbccd"], "n string"), "n")
    folded = charts.limit_slices(slices, "n", limit=3).orderBy("position").collect()
    assert [(r["n"], r["value"]) for r in folded] == [("a", 4), ("b", 3), ("Other", 3)]
    assert charts.limit_slices(slices, "n", limit=4).count() == 4


def test_gauge_bounds(spark):
    df = spark.createDataFrame([(-3.0,)], "v double")
    row = charts.gauge(df, "v").first()
    assert (row["low"], row["high"]) == (-1.0, 1.0)


def test_gauge_scale_and_targets(spark):
    df = spark.createDataFrame([(4.0,), (6.0,)], "v double")
    assert tuple(charts.gauge(df, "v", target=15.0).first()) == (10.0, 0.0, 20.0, 15.0, 15.0, False)
    assert tuple(charts.gauge(df, "v", target=10.0, strict=True).first())[-1] is False
    assert tuple(charts.gauge(df, "v", target=10.0, polarity="lower").first())[-1] is True
    assert charts.gauge(df, "v", target=0.5).first().threshold == 6.0
    assert charts.gauge(df, "v", target=19.5).first().threshold == 14.0
    assert tuple(charts.gauge(df, "v", low=5.0, high=5.0).first())[1:3] == (4.5, 5.5)
    assert tuple(charts.gauge(df, "v", low=0.0, high=0.0).first())[1:3] == (-1.0, 1.0)
    assert tuple(charts.gauge(df.limit(0), "v").first())[:3] == (0.0, 0.0, 1.0)
    with pytest.raises(Exception, match="off the scale"):
        charts.gauge(df, "v", target=21.0).collect()


def test_time_buckets_match_pandas(spark):
    stamps = [dt.datetime(2023, 12, 30), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 20), dt.datetime(2024, 4, 2)]
    df = spark.createDataFrame(list(zip(stamps, [1.0, 2.0, 3.0, 4.0])), "d timestamp, v double")
    frame = pd.DataFrame({"d": stamps, "v": [1.0, 2.0, 3.0, 4.0]}).set_index("d")["v"]
    for unit, rule in (("D", "D"), ("W", "W"), ("M", "ME"), ("Q", "QE"), ("Y", "YE")):
        want = frame.resample(rule).sum()
        got = timeseries.time_buckets(df, "d", ["v"], unit, "sum").orderBy("d").collect()
        assert [r["d"] for r in got] == [x.date() for x in want.index], unit
        assert [r["v"] for r in got] == want.tolist(), unit


def test_retention_never_exceeds_everyone(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    cells = cohorts.matrix(cohorts.assign(orders, "o_custkey", "o_orderdate"), "o_custkey")
    assert cells.filter("retention > 100 OR retention IS NULL").count() == 0
    assert cells.filter("cohort_index = 0").agg(F.sum("customers")).first()[0] == orders.select("o_custkey").distinct().count()


def test_decomposition_of_a_pure_season(spark):
    season = [5.0, -1.0, -4.0, 0.0]
    data = [(dt.date(2020 + i // 4, 1 + 3 * (i % 4), 1), 100.0 + i + season[i % 4]) for i in range(24)]
    out = timeseries.decompose(spark.createDataFrame(data, "d date, v double"), "d", "v")
    assert out.period == 4
    assert out.components.agg(F.max(F.abs("residual"))).first()[0] < 1e-9
    assert timeseries.residual_outliers(out.components, 2.0).count() <= 24


def test_stateless_columns(spark):
    d = lambda text: F.lit(text).cast("timestamp_ntz")
    assert one(spark, calc.business_days(d("2024-01-05"), d("2024-01-09"))) == 2
    assert one(spark, calc.business_days(d("2024-01-06"), d("2024-01-08"))) == 0
    assert one(spark, calc.week_number(d("2021-01-03"))) == 53
    assert one(spark, calc.fiscal_quarter(d("2021-03-01"))) == 4
    assert one(spark, calc.return_on_investment(F.lit(1), F.lit(0))) is None
    assert one(spark, calc.percentage_change(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, calc.title_case(F.lit("o'neil 3rd mcX"))) == "O'Neil 3Rd Mcx"
    assert one(spark, calc.obfuscated_email(F.lit("abcdef@x.org"))) == "abc***@x.org"
    assert one(spark, calc.url_domain(F.lit("https://www.a.org/b?c"))) == "a.org"
    assert one(spark, calc.age_group(F.lit(0))) is None
    assert one(spark, calc.age_group(F.lit(18))) == "<18"
    assert one(spark, calc.time_of_day(F.lit(6))) == "Morning"
    assert one(spark, calc.logit(F.lit(1.0))) is None
    assert one(spark, calc.round_to(F.lit(12.5))) == 10.0


def test_rsi_matches_pandas(spark):
    price = pd.Series([10, 11, 11, 12, 10, 9, 9.5, 10, 11, 13, 12, 12, 12.5, 13, 14, 13.5, 13, 15], dtype=float)
    delta = price.diff()
    gain, loss = delta.where(delta > 0, 0).rolling(14).mean(), (-delta.where(delta < 0, 0)).rolling(14).mean()
    want = (100 - 100 / (1 + gain / loss)).tolist()
    df = spark.createDataFrame(list(enumerate(price)), "i int, p double")
    got = [r["r"] for r in ordered_calc.rsi(df, "p", "r", ["i"]).orderBy("i").collect()]
    assert got[:13] == [None] * 13
    assert got[13:] == pytest.approx(want[13:])


def test_rfm_scores_match_pandas(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    got = business.rfm(orders, "o_custkey", "o_orderdate", "o_totalprice").toPandas().set_index("o_custkey").sort_index()
    pdf = orders.toPandas()
    m = pdf.groupby("o_custkey").agg(last=("o_orderdate", "max"), f=("o_orderkey", "count"), v=("o_totalprice", "sum"))
    recency = (pdf["o_orderdate"].max() - m["last"]).dt.days
    assert (got["recency"] == recency).all()
    assert (got["R_score"] == 4 - pd.qcut(recency, 4, labels=False)).all()
    assert (got["M_score"] == 1 + pd.qcut(m["v"], 4, labels=False)).all()


def test_ab_with_equal_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    assert business.welch_test(df, "g", "v", "a", "b").first()["t_statistic"] is None
    lifts = {r["group"]: r["lift_vs_control"] for r in business.ab_groups(df, "g", "v").collect()}
    assert lifts == {"a": 0.0, "b": 0.0}


def test_stratified_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 7, "rare").otherwise("common"))
    first = sampling.stratified_fraction(df, "s", 0.1, seed=1)
    again = sampling.stratified_fraction(df.repartition(5), "s", 0.1, seed=1)
    assert rows(first) == rows(again)
    assert dict(first.groupBy("s").count().collect()) == {"rare": 1, "common": 100}


def test_insights_need_enough_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, revenue double")
    assert insights.relationships(df, ["c"], ["revenue"]).count() == 0
    assert insights.pareto(df, ["c"], ["revenue"]).count() == 0
    assert insights.leader_ratio(df, "c", "revenue").first()["ratio"] is None


def test_feature_families(spark):
    df = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "ab"[i % 2], float(i)) for i in range(40)],
        "id int, d timestamp, c string, y double",
    )
    out = features.engineer(df, target="y", exclude=["id"], order_by=["id"])
    assert {"d_is_month_end", "y_bin_5", "c_freq", "c_target_mean", "y_lag_7", "d_month_sin"} <= set(out.data.columns)
    assert out.data.count() == 40
    assert out.importance.first()["correlation_with_target"] == pytest.approx(1.0)


def test_nothing_is_capped(spark):
    wide = spark.range(40).select("id", *[(F.col("id") * (i + 2) % 37).alias(f"n{i}") for i in range(24)])
    wide = wide.withColumn("copy", F.when(F.col("id") < 38, F.col("n0")).otherwise(-1))
    found = {r["columns"] for r in quality.issues(wide, only=["redundant_columns"]).collect()}
    assert "n0, copy" in found
    texts = spark.createDataFrame([("a", "b", "c", "d", "e", "x,y,z,w")] * 3, [f"t{i}" for i in range(6)])
    assert cleaning.splittable_column(texts) == "t5"
    groups = spark.range(300).select((F.col("id") % 30).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    assert business.ab_groups(groups, "g", "v").count() == 30
    assert business.ab_groups(groups, "g", "v", control="7", limit=3).count() == 3
    assert "g_freq" in features.encode_category(groups, "g").columns
    assert features.encode_category(groups, "g", high=20).columns == groups.columns
    strata = groups.unionByName(spark.createDataFrame([(None, 1.0)], "g string, v double"))
    assert sampling.equal_allocation(strata, "g", 10).select("g").distinct().count() == 31


def test_separator_of_all_lines(spark, tmp_path):
    path = str(tmp_path / "ragged.txt")
    with open(path, "w") as out:
        out.write("a,b\n" + "1,2\n" * 150 + "1,2,3\n")
    assert readers.read_text_auto(spark, path).columns == ["text"]


def test_quoted_line_breaks(spark, tmp_path):
    path = str(tmp_path / "breaks.csv")
    with open(path, "w") as out:
        out.write('id,note\n1,"line one\nline two"\n2,x\n')
    rows = readers.read_delimited(spark, path, multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "line one\nline two"), (2, "x")]


def test_head_lines_quotes_and_encoding(spark, tmp_path):
    path = str(tmp_path / "head.csv")
    with open(path, "wb") as out:
        out.write('note\n"a,b",c\n1,caf\xe9\n"a,b",c\n'.encode("latin-1"))
    frame = readers.read_delimited(spark, path, skip_rows=1, encoding="ISO-8859-1")
    assert frame.columns == ["a,b", "c"]
    assert sorted(map(tuple, frame.collect())) == [("1", "caf\xe9"), ("a,b", "c")]
    assert readers.read_delimited(spark, path, skip_rows=1).count() == 2

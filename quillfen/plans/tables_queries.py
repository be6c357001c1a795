"""Queries of the sources, sinks, ingest transforms and filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillfen.operators import filters as flt
from quillfen.operators import ingest
from quillfen.plans.registry import Tables, day, moment, query, rnd, sql_day, sql_moment, sql_rnd
from quillfen.sources import readers, writers

ORDERS_OUT = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(
    "src1_csv_scan",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {sql_day('o_orderdate')} AS o_day,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders""",
)
def _(t: Tables):
    path = writers.scratch_folder(t.spark, "csv")
    masked = F.when(F.col("o_orderkey") % 3 == 0, "missing!").otherwise(F.col("o_orderpriority"))
    writers.write_csv(t.orders.withColumn("priority", masked), path)
    back = readers.read_delimited(t.spark, path, na_values=["missing!"])
    return back.select(*ORDERS_OUT, day("o_orderdate").alias("o_day"), "priority")


@query(
    "src1_csv_scan_options",
    f"SELECT o_orderkey, {sql_rnd('o_totalprice', 2)} AS o_totalprice FROM orders",
)
def _(t: Tables):
    # Every file carries a head line to skip, decimal commas and semicolons.
    path = writers.scratch_folder(t.spark, "csv")
    price = F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    t.orders.select("o_orderkey", price.alias("price")).write.option("header", True).csv(path, sep=";")
    back = readers.read_delimited(t.spark, path, sep=";", decimal=",", skip_rows=1, header=False)
    return back.select(F.col("_c0").alias("o_orderkey"), rnd("_c1", 2).alias("o_totalprice"))


@query("src1_csv_multiline", "SELECT doc_id, lang, source, MD5(text) AS text_md5, LENGTH(text) AS chars FROM documents")
def _(t: Tables):
    # Texts hold line breaks; they are read back as cells, by as many tasks as the files have blocks.
    path = writers.scratch_folder(t.spark, "csv")
    rows = t.documents.select("doc_id", "lang", "source", "text")
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    rows.write.options(header=True, escape='"', quoteAll=True, **kept).csv(path)
    back = readers.read_delimited(t.spark, path, keep_default_na=False, parse_dates=False)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return back.select("doc_id", "lang", "source", F.md5(text.cast("binary")).alias("text_md5"), F.length(text).cast("long").alias("chars"))


@query("src2_json_scan", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(t: Tables):
    path = writers.scratch_folder(t.spark, "json")
    writers.write_json(t.customer, path)
    back = readers.read_json(t.spark, path, records_array=False)
    return back.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("src3_parquet_scan", "SELECT p_partkey, p_brand FROM part WHERE p_size > 25")
def _(t: Tables):
    return readers.read_parquet(t.spark, f"{t.folder}/part.parquet", ["p_partkey", "p_brand", "p_size"]).filter(
        "p_size > 25"
    ).drop("p_size")


@query("src5_text_fallback", "SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def _(t: Tables):
    path = writers.scratch_folder(t.spark, "text")
    t.customer.select("c_custkey", "c_mktsegment", "c_nationkey").write.option("header", True).csv(path, sep="|")
    return readers.read_text_auto(t.spark, path)


@query(
    "src13_multi_table_load",
    """SELECT 'nation' AS name, COUNT(*) AS rows FROM nation
       UNION ALL SELECT 'region', COUNT(*) FROM region UNION ALL SELECT 'part', COUNT(*) FROM part""",
)
def _(t: Tables):
    names = ("nation", "region", "part")
    tables = readers.load_tables(t.spark, [f"{t.folder}/{n}.parquet" for n in names])
    counts = [df.select(F.lit(n).alias("name"), F.lit(1).alias("one")) for n, df in tables.items()]
    rows = counts[0].union(counts[1]).union(counts[2])
    return rows.groupBy("name").agg(F.count("one").alias("rows"))


@query("snk1_csv_export", "SELECT s_suppkey, s_name FROM supplier")
def _(t: Tables):
    path = writers.scratch_folder(t.spark, "csv")
    writers.write_csv(t.supplier.select("s_suppkey", "s_name"), path)
    return t.spark.read.csv(path, header=True, schema="s_suppkey bigint, s_name string")


@query("snk2_json_export", "SELECT n_nationkey, n_name FROM nation")
def _(t: Tables):
    path = writers.scratch_folder(t.spark, "json")
    writers.write_json(t.nation.select("n_nationkey", "n_name"), path)
    return t.spark.read.schema("n_nationkey int, n_name string").json(path)


@query(
    "snk3_report_csv",
    "SELECT o_orderstatus, COUNT(*) AS orders FROM orders GROUP BY o_orderstatus",
)
def _(t: Tables):
    path = writers.scratch_folder(t.spark, "report")
    writers.write_report(t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders")), path)
    return t.spark.read.csv(path, header=True, schema="o_orderstatus string, orders bigint")


@query("ing1_row_cap", "SELECT LEAST(COUNT(*), 5000) AS rows FROM lineitem")
def _(t: Tables):
    return ingest.cap_rows(t.lineitem, 5000).agg(F.count(F.lit(1)).alias("rows"))


@query("ing2_dedup_on_load", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t: Tables):
    return ingest.drop_exact_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("ing3_normalise_names", "SELECT r_regionkey AS region_key, r_name AS r_name, r_name AS r_name_2 FROM region")
def _(t: Tables):
    return ingest.normalise_names(
        t.region.select(F.col("r_regionkey").alias(" Region Key"), F.col("r_name").alias("R-Name"), F.col("r_name").alias("r.name"))
    )


@query(
    "ing4_downcast",
    """SELECT 'l_linenumber' AS name, 'tinyint' AS type UNION ALL
       SELECT 'l_orderkey', CASE WHEN MAX(l_orderkey) < 128 THEN 'tinyint' WHEN MAX(l_orderkey) < 32768 THEN 'smallint'
                                 WHEN MAX(l_orderkey) < 2147483648 THEN 'int' ELSE 'bigint' END FROM lineitem""",
)
def _(t: Tables):
    small = ingest.downcast(t.lineitem.select("l_orderkey", "l_linenumber"))
    types = [F.struct(F.lit(c).alias("name"), F.max(F.typeof(c)).alias("type")) for c in small.columns]
    return small.agg(F.array(*types).alias("a")).select(F.explode("a").alias("r")).select("r.*")


@query("ing5_rename", "SELECT n_nationkey AS id, n_name AS label FROM nation")
def _(t: Tables):
    return ingest.rename_columns(t.nation.drop("n_regionkey"), {"n_nationkey": "id", "n_name": "label"})


@query("ing6_drop_columns", "SELECT n_nationkey, n_name FROM nation")
def _(t: Tables):
    return ingest.drop_columns(t.nation, ["n_regionkey", "not_there"])


@query(
    "ing7_cast",
    f"""SELECT event_id, CAST(value AS BIGINT) AS whole, CAST(user_id AS VARCHAR) AS label,
        TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, {sql_moment('ts')} AS at,
        CAST(NULL AS DOUBLE) AS bad FROM (SELECT *, trunc(value) AS v FROM events)""".replace(
        "CAST(value AS BIGINT)", "CAST(v AS BIGINT)"
    ),
)
def _(t: Tables):
    e = t.events.select(
        "event_id", F.col("value").alias("whole"), F.col("user_id").alias("label"),
        F.regexp_extract("props", "[0-9]+", 0).alias("k"), moment("ts").alias("at"),
        F.col("event_type").alias("bad"),
    )
    out = ingest.cast_columns(
        e, {"whole": "int64", "label": "string", "k": "float64", "at": "datetime", "bad": "float64"}
    )
    return out.withColumn("at", moment("at"))


# ---- filters ----------------------------------------------------------------

NULLABLE = "(SELECT o_orderkey, o_custkey, NULLIF(o_orderstatus, 'P') AS status, o_totalprice, o_orderdate FROM orders)"


def nullable(t: Tables):
    return t.orders.select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_totalprice", "o_orderdate"
    )


def filter_query(name: str, state: dict, where: str) -> None:
    @query(name, f"SELECT o_orderkey, status, o_totalprice FROM {NULLABLE} WHERE {where}")
    def _(t: Tables):
        return flt.apply_filters(nullable(t), state).select("o_orderkey", "status", "o_totalprice")


RANGE = {"type": "range", "min": 100000.0, "max": 200000.0}
IS_F = {"type": "categorical", "values": ["F"]}
filter_query("flt1_range", {"filters": {"o_totalprice": RANGE}}, "o_totalprice BETWEEN 100000 AND 200000")
filter_query("flt2_greater", {"filters": {"o_totalprice": {"type": "gt", "value": 300000}}}, "o_totalprice > 300000")
filter_query("flt2_less", {"filters": {"o_totalprice": {"type": "lt", "value": 50000}}}, "o_totalprice < 50000")
filter_query("flt3_membership", {"filters": {"status": IS_F}}, "status IN ('F')")
filter_query(
    "flt4_date_range",
    {"filters": {"o_orderdate": {"type": "date_range", "start": dt.datetime(1997, 1, 1), "end": dt.datetime(1997, 6, 30)}}},
    "o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'",
)
AS_OF = dt.datetime(2001, 7, 1)
for _preset, _start, _end in (
    ("last_7_days", "2001-06-24", "2001-07-01"), ("last_30_days", "2001-06-01", "2001-07-01"),
    ("last_90_days", "2001-04-02", "2001-07-01"), ("year_to_date", "2001-01-01", "2001-07-01"),
    ("last_year", "2000-01-01", "2000-12-31"),
):
    filter_query(
        f"flt5_{_preset}",
        {"filters": {"o_orderdate": flt.date_preset(_preset, AS_OF)}},
        f"o_orderdate BETWEEN TIMESTAMP '{_start}' AND TIMESTAMP '{_end}'",
    )


@query("flt6_text_contains", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ther')")
def _(t: Tables):
    return flt.apply_filters(t.documents, {"filters": {"text": {"type": "text", "search": "Ther"}}}).select("doc_id")


@query("flt6_text_contains_case", "SELECT doc_id FROM documents WHERE contains(text, 'Ther')")
def _(t: Tables):
    spec = {"type": "text", "search": "Ther", "case_sensitive": True}
    return flt.apply_filters(t.documents, {"filters": {"text": spec}}).select("doc_id")


@query("flt7_text_regex", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}', 'i')")
def _(t: Tables):
    spec = {"type": "text", "use_regex": True, "pattern": "[0-9]{3}-[0-9]{4}"}
    return flt.apply_filters(t.documents, {"filters": {"text": spec}}).select("doc_id")


@query("flt7_bad_regex", "SELECT page_id FROM pages WHERE contains(lower(html), '<li')")
def _(t: Tables):
    spec = {"type": "text", "use_regex": True, "pattern": "(<", "search": "<LI"}
    return flt.apply_filters(t.pages, {"filters": {"html": spec}}).select("page_id")


filter_query(
    "flt8_or_on_column",
    {"filters": {"o_totalprice": {"type": "or", "conditions": [{"type": "lt", "value": 20000}, {"type": "gt", "value": 450000}]}}},
    "o_totalprice < 20000 OR o_totalprice > 450000",
)

_FENCES = """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, value FROM events, q WHERE """


@query("flt9_iqr_exclude", _FENCES + "value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def _(t: Tables):
    e = t.events.select("event_id", "value")
    return flt.apply_filters(e, {"filters": {"value": flt.outlier_filter(e, "value")}})


@query("flt9_iqr_keep_only", _FENCES + "value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def _(t: Tables):
    e = t.events.select("event_id", "value")
    return flt.apply_filters(e, {"filters": {"value": flt.outlier_filter(e, "value", keep_only=True)}})


BOTH = {"o_totalprice": RANGE, "status": IS_F}
IN_RANGE = "o_totalprice BETWEEN 100000 AND 200000"
filter_query("flt10_and", {"filters": {**BOTH, "unknown": IS_F}}, f"{IN_RANGE} AND status = 'F'")
filter_query("flt11_or", {"filters": BOTH, "logic_mode": "OR"}, f"{IN_RANGE} OR status = 'F'")
filter_query(
    "flt12_or_of_ands",
    {
        "filters": {**BOTH, "o_custkey": {"type": "lt", "value": 50}},
        "logic_mode": "OR",
        "logic_groups": [["o_totalprice", "status"], ["o_custkey"]],
    },
    f"({IN_RANGE} AND status = 'F') OR o_custkey < 50",
)
filter_query(
    "flt13_null_policy",
    {"filters": BOTH, "null_handling": {"status": "include"}},
    f"{IN_RANGE} AND (status = 'F' OR status IS NULL)",
)
filter_query(
    "flt13_null_separate",
    {"filters": BOTH, "null_handling": {"status": "separate", "o_totalprice": "separate"}},
    f"{IN_RANGE} AND (status = 'F' OR status IS NULL)",
)


@query(
    "flt14_filter_impact",
    f"""SELECT COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE {IN_RANGE} AND status = 'F') AS rows_after,
        {sql_rnd(f"100.0 * COUNT(*) FILTER (WHERE {IN_RANGE} AND status = 'F') / COUNT(*)", 6)} AS kept_percent
        FROM {NULLABLE}""",
)
def _(t: Tables):
    return flt.filter_impact(nullable(t), {"filters": BOTH}).withColumn("kept_percent", rnd("kept_percent", 6))


@query(
    "flt15_view",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200",
)
def _(t: Tables):
    return flt.view(t.orders, ["o_orderkey", "o_totalprice"], "o_totalprice", True, 200, ("o_orderkey",))

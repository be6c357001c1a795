"""Queries of text normalisation, personal data, near-equal values and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfen.functions import text as tx
from quillfen.operators import fuzzy, sampling
from quillfen.operators import textclean as tc
from quillfen.plans.registry import Tables, query, rnd, sql_rnd


def step_query(name: str, column, expression, sql: str) -> None:
    @query(name, f"SELECT p_partkey, {sql} AS cleaned FROM part")
    def _(t: Tables):
        return t.part.select("p_partkey", expression(column()).alias("cleaned"))


def part_name():
    return F.col("p_name")


step_query(
    "cln24_encoding",
    lambda: F.concat(F.lit("cafÃ© â€œ"), part_name(), F.lit("â€ itâ€™s â€¢ seÃ±or")), tx.fix_encoding,
    """'café "' || p_name || '" it''s • señor'""",
)
step_query(
    "cln25_whitespace",
    lambda: F.concat(F.lit("  \t"), F.replace(part_name(), F.lit(" "), F.lit("  \n ")), F.lit(" ")), tx.squeeze, "p_name",
)
step_query(
    "cln26_typos",
    lambda: F.concat(F.lit("recieve "), part_name(), F.lit(" tommorow seperate recieved tomorow.")), tx.fix_typos,
    "'receive ' || p_name || ' tomorrow separate recieved tomorrow.'",
)
step_query(
    "cln27_abbreviations",
    lambda: F.concat(part_name(), F.lit(" St.Louis St. Paul Dept.7 Inc.")), tx.expand_abbreviations,
    "p_name || ' StreetLouis St. Paul Department7 Inc.'",
)


@query(
    "cln28_casing",
    """SELECT c_custkey, 'O''Neil 3Rd ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS customer_name, lower(c_name) AS email, c_name AS note FROM customer""",
)
def _(t: Tables):
    name = F.concat(F.lit("o'NEIL 3rd "), F.col("c_mktsegment"))
    return t.customer.select(
        "c_custkey", tx.case_by_name(name, "customer_name").alias("customer_name"),
        tx.case_by_name(F.col("c_name"), "email").alias("email"), tx.case_by_name(F.col("c_name"), "note").alias("note"),
    )


@query(
    "cln29_special_characters",
    r"""SELECT doc_id, md5(regexp_replace(text, '[^\p{L}\p{N}_\t\n\v\f\r .\-@,;:''"]', '', 'g')) AS cleaned FROM documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", F.md5(tx.strip_special(F.col("text")).cast("binary")).alias("cleaned"))


@query(
    "cln30_boolean_tokens",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'True' WHEN 'view' THEN 'False' WHEN 'error' THEN 'Enabled' WHEN 'signup' THEN 'Disabled' ELSE event_type END AS cleaned FROM events",
)
def _(t: Tables):
    kind = F.col("event_type")
    token = F.when(kind == "click", "YES").when(kind == "view", "f").when(kind == "error", "Active").when(kind == "signup", "off").otherwise(kind)
    return t.events.select("event_id", tx.standard_tokens(token).alias("cleaned"))


@query(
    "cln31_normalisation_report",
    f"""SELECT 'p_brand' AS "column", COUNT(*) AS changed_rows, 100.0::DOUBLE AS percent FROM part
        UNION ALL SELECT 'p_name', COUNT(*), 100.0::DOUBLE FROM part UNION ALL SELECT 'p_type', 0, 0.0::DOUBLE FROM part
        UNION ALL SELECT 'note', COUNT(*) FILTER (WHERE p_partkey % 3 = 0), {sql_rnd('100.0 * COUNT(*) FILTER (WHERE p_partkey % 3 = 0) / COUNT(*)')} FROM part""".replace(
        "0, 0.0::DOUBLE FROM part UNION", "0, 0.0::DOUBLE UNION").replace("SELECT 'p_type', 0, 0.0::DOUBLE FROM part", "SELECT 'p_type', 0, 0.0::DOUBLE"),
)
def _(t: Tables):
    note = F.when(F.col("p_partkey") % 3 == 0, "so  wierd").otherwise("fine")
    out = tc.normalise_text(t.part.select("p_name", "p_brand", "p_type", note.alias("note"))).report
    return out.withColumn("percent", rnd("percent"))


@query("cln31_normalised_documents")
def _(t: Tables):
    return tc.normalise_text(t.documents.select("doc_id", "text"), ["text"]).data


def pii_share_sql(column: str, table: str) -> str:
    patterns = {
        "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "phone": r"(\+\d{1,3}[-.]?)?\(?\d{3}\)?[-.]?\d{3}[-.]?\d{4}\b",
        "ssn": r"\b\d{3}-\d{2}-\d{4}\b", "credit_card": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b",
        "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    }
    return " UNION ALL ".join(
        f"SELECT '{column}' AS \"column\", '{k}' AS pii_type, {sql_rnd(f'AVG(regexp_matches({column}, $${p}$$)::INT)', 6)} AS share FROM {table}"
        for k, p in patterns.items()
    )


@query("cln32_pii_shares", pii_share_sql("text", "documents"))
def _(t: Tables):
    shares = tc.pattern_shares(t.documents, ["text"]).filter("pii_type NOT IN ('name', 'address')")
    return shares.withColumn("share", rnd("share", 6))


@query(
    "cln32_pii_detection",
    """SELECT * FROM (VALUES ('c_name', 'name'), ('contact', 'email'), ('c_phone', 'phone, ssn'), ('c_street', 'address')) v("column", kinds)""",
)
def _(t: Tables):
    key = F.col("c_custkey")
    people = t.customer.select(
        "c_name", F.concat(F.lit("write to u"), key.cast("string"), F.lit("@example.com")).alias("contact"),
        F.concat(F.lit("123-45-"), (key % 9000 + 1000).cast("string")).alias("c_phone"), F.lower("c_mktsegment").alias("c_street"),
    )
    found = tc.detect_pii(people)
    return t.spark.createDataFrame([(c, ", ".join(k)) for c, k in found.items()], "column string, kinds string")


_TEN = "CAST(1000000000 + c_custkey AS VARCHAR)"


@query(
    "cln33_masking",
    f"""SELECT c_custkey, 'x***@example.com' AS email, '***-***-' || right({_TEN}, 4) AS phone, '***-**-' || CAST(c_custkey % 9000 + 1000 AS VARCHAR) AS ssn,
        '**** **** **** ' || CAST(c_custkey % 9000 + 1000 AS VARCHAR) AS card, '10.' || CAST(c_custkey % 250 AS VARCHAR) || '.***.***' AS ip,
        'C***#0***' AS name, '*** Main Street' AS address FROM customer""",
)
def _(t: Tables):
    key, four = F.col("c_custkey"), (F.col("c_custkey") % 9000 + 1000).cast("string")
    ten = (key + 1_000_000_000).cast("string")
    return t.customer.select(
        "c_custkey",
        tc.mask(F.concat(F.lit("x<u.1+"), key.cast("string"), F.lit("@example.com")), ["email"]).alias("email"),
        tc.mask(ten, ["phone"]).alias("phone"), tc.mask(F.concat(F.lit("123-45-"), four), ["ssn"]).alias("ssn"),
        tc.mask(F.concat(F.lit("4111 1111-1111"), four), ["credit_card"]).alias("card"),
        tc.mask(F.concat(F.lit("10."), (key % 250).cast("string"), F.lit(".3.44")), ["ip_address"]).alias("ip"),
        tc.mask(F.col("c_name"), ["name"]).alias("name"), tc.mask(F.concat(key.cast("string"), F.lit(" Main Street")), ["address"]).alias("address"),
    ).withColumn("email", F.replace(F.col("email"), F.lit("x<"), F.lit("x")))


@query(
    "cln33_masked_documents",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([A-Za-z0-9._%+-]+)@', '***@', 'g'), '(\d{3})[-.]?\d{3}[-.]?(\d{4})', '***-***-\2', 'g')) AS masked FROM documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", F.md5(tc.mask(F.col("text"), ["email", "phone"]).cast("binary")).alias("masked"))


@query(
    "cln34_pii_report",
    f"""SELECT 'c_name' AS "column", 'name' AS kinds, COUNT(*) AS changed_rows, 100.0::DOUBLE AS percent FROM customer
        UNION ALL SELECT 'contact', 'email', COUNT(*) FILTER (WHERE c_custkey % 4 = 0), {sql_rnd('100.0 * COUNT(*) FILTER (WHERE c_custkey % 4 = 0) / COUNT(*)')} FROM customer""",
)
def _(t: Tables):
    key = F.col("c_custkey")
    contact = F.when(key % 4 == 0, F.concat(F.lit("u"), key.cast("string"), F.lit("@example.com"))).otherwise("none")
    return tc.sanitise_pii(t.customer.select("c_name", contact.alias("contact"))).report.withColumn("percent", rnd("percent"))


# ---- near-equal values ---------------------------------------------------------------


def misspelt(t: Tables):
    key = F.col("p_partkey")
    label = (
        F.when(key % 5 == 1, F.upper("p_name")).when(key % 5 == 2, F.concat(F.lit(" "), F.replace(part_name(), F.lit(" "), F.lit("  "))))
        .when(key % 5 == 3, F.concat(F.substring("p_name", 1, 3), F.substr(part_name(), F.lit(5))))
        .when(key % 5 == 4, F.concat("p_name", F.lit(" Inc")))
        .otherwise(part_name())
    )
    return t.part.select("p_partkey", label.alias("label"))


@query("cln35_fuzzy_clusters")
def _(t: Tables):
    return fuzzy.fuzzy_duplicates(misspelt(t), ["label"], order_by=["p_partkey"]).report


@query("cln35_fuzzy_marked_rows")
def _(t: Tables):
    return fuzzy.fuzzy_duplicates(misspelt(t), ["label"], order_by=["p_partkey"]).data


@query("cln35_fuzzy_summary")
def _(t: Tables):
    return fuzzy.summary(fuzzy.fuzzy_duplicates(misspelt(t), ["label"], order_by=["p_partkey"]).report)


# Spellings of one sound each; the first was seen first.
FAMILIES = (
    ("catherine", "kathryn", "katharine"),
    ("physics", "fysiks", "fizicks"),
    ("night", "knight", "nite"),
    ("jackson", "jaxon"),
    ("schema", "skeema"),
)


@query(
    "cln35_phonetic",
    """WITH f(name, head, turn) AS (VALUES """
    + ", ".join(f"('{name}', '{family[0]}', {k})" for k, family in enumerate(FAMILIES) for name in family)
    + f"""), v AS (SELECT DISTINCT name || ' ' || p_type AS value, head || ' ' || p_type AS head
            FROM part JOIN f ON p_partkey % {len(FAMILIES)} = turn)
        SELECT value, COUNT(*) OVER (PARTITION BY head) AS members FROM v""",
)
def _(t: Tables):
    # Every part type in all spellings of one family; the spellings share a code, the families do not.
    names = F.array(*[F.array(*map(F.lit, family)) for family in FAMILIES])
    spelt = F.explode(F.element_at(names, (F.col("p_partkey") % len(FAMILIES) + 1).cast("int")))
    rows = t.part.select("p_partkey", "p_type", spelt.alias("name"))
    rows = rows.select("p_partkey", F.concat_ws(" ", "name", "p_type").alias("value"))
    found = fuzzy.fuzzy_duplicates(rows, ["value"], order_by=["p_partkey"], phonetic=True).report
    sizes = found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))
    return found.join(sizes, "cluster_id").select(F.col("original_value").alias("value"), "members")


@query("cln37_schema_match")
def _(t: Tables):
    return fuzzy.match_schemas(t.customer, t.supplier).mapping


@query("cln37_unmatched_columns")
def _(t: Tables):
    return fuzzy.match_schemas(t.part, t.supplier).unmatched


# ---- sampling ---------------------------------------------------------------------------


@query("smp1_random_fraction")
def _(t: Tables):
    return sampling.random_fraction(t.lineitem, 0.1).select("l_orderkey", "l_linenumber")


@query("smp1_fraction_facts", "SELECT true AS from_source, true AS same_again, true AS other_seed_differs, true AS near_tenth, COUNT(*) AS rows FROM lineitem")
def _(t: Tables):
    # What any tenth must hold: it is part of the table, a seed gives it again, and its size lies within six deviations.
    first, again, other = (sampling.random_fraction(t.lineitem, 0.1, seed).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")) for seed in (42, 42, 43))
    total = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    sides = [x.select("l_orderkey", "l_linenumber", F.struct(*[(F.col("n") if k == j else F.lit(0)).alias(f"n{k}") for k in range(4)]).alias("s")) for j, x in enumerate((total, first, again, other))]
    both = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])
    per = both.groupBy("l_orderkey", "l_linenumber").agg(*[F.sum(f"s.n{k}").alias(f"n{k}") for k in range(4)])
    rows, drawn = F.sum("n0"), F.sum("n1")
    return per.agg(
        F.bool_and(F.col("n1") <= F.col("n0")).alias("from_source"), F.bool_and(F.col("n1") == F.col("n2")).alias("same_again"),
        F.bool_or(F.col("n1") != F.col("n3")).alias("other_seed_differs"),
        (F.abs(drawn - rows * 0.1) <= 6 * F.sqrt(rows * 0.09)).alias("near_tenth"), rows.alias("rows"),
    )


@query(
    "smp2_stratified_fraction",
    "SELECT o_orderpriority, CAST(CEIL(COUNT(*) * 0.3::DOUBLE) AS BIGINT) AS rows FROM orders GROUP BY 1",
)
def _(t: Tables):
    out = sampling.stratified_fraction(t.orders, "o_orderpriority", 0.3)
    return out.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "smp2_automatic_stratum",
    "SELECT 'kind' AS stratum, true AS sampled",
)
def _(t: Tables):
    kind = F.when(F.col("user_id") == 3, "rare").otherwise("common")
    s = sampling.smart_sample(t.events.select("event_id", kind.alias("kind"), "value"), size_threshold=100)
    return t.spark.createDataFrame([(s.stratum, s.sampled)], "stratum string, sampled boolean")


@query(
    "smp3_adaptive_fraction",
    f"""WITH s AS (SELECT COUNT(*) n, (ABS(SKEWNESS(value)) + ABS(SKEWNESS(user_id))) / 2 AS k FROM events),
        c AS (SELECT LEAST(10, ROUND(LEAST(2, LOG10(GREATEST(1, n / 1000)) * 0.5) + 0.4 + LEAST(2, ROUND(k, 2) * 0.5) + 1, 1) + LEAST(2, n * 44 / 1048576 / 100)) AS score, n FROM s)
        SELECT {sql_rnd('LEAST(0.8, GREATEST(0.3, LEAST(0.9, 1 - 0.08 * score)))', 3)} AS fraction, n > 100 AS sampled FROM c""",
)
def _(t: Tables):
    s = sampling.smart_sample(t.events.select("ts", "user_id", "event_type", "value"), size_threshold=100)
    return t.spark.createDataFrame([(s.fraction, s.sampled)], "fraction double, sampled boolean").withColumn("fraction", rnd("fraction", 3))


@query("smp4_equal_allocation", "SELECT event_type, 200::BIGINT AS rows FROM events GROUP BY 1")
def _(t: Tables):
    out = sampling.equal_allocation(t.events, "event_type", 1000)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("smp5_diverse_head", "SELECT 20::BIGINT AS rows")
def _(t: Tables):
    return sampling.diverse_head(t.events.select("event_type", "value")).agg(F.count(F.lit(1)).alias("rows"))

"""Personal data by patterns and by information theory, with DataFrame functions only.

Base kinds are found by patterns over whole texts. Each distinct base value is a protected entity. All terms of the
texts that mention it are its candidates: over the whole corpus, with document counts c(.) of N, a term t discloses an entity e to the degree PMI(e; t) / IC(e), where PMI = log(N c(e, t) / (c(e) c(t))) and
IC(e) = log(N / c(e)); 1 means that the term gives the entity away whenever it is seen. Co-occurrence must be seen in
at least LEAST_TEXTS different texts, outside of mentions, so the words of one text, however often it is copied, disclose nothing. Terms
that reach GENERALISE are generalised, terms that reach REMOVE removed, wherever they occur.

c(e, t) is at most c(e), so a degree g needs c(t) <= N^(1 - g) c(e)^g: more frequent terms never meet the entity. Equal
texts are folded before entities meet terms; counts grow with mentions and the rare terms beside them, never with
pairs of terms.
Patterns are possessive and start at the border of a run, so long runs of digits or letters cost linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfen.llm.common import packed, row_count, table, text_or_empty
from quillfen.session import cut_lineage

LEAST_TEXTS = 3
GENERALISE, REMOVE = 0.85, 0.97
#: Dictionaries up to so many terms are broadcast (a term is a run of letters, 100 bytes at most here); larger ones join.
BROADCAST_TERMS = 200_000
KINDS = ["email", "ip", "card", "phone"]
TERM_KINDS = ["term_generalised", "term_removed"]
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term_generalised": "[TERM]", "term_removed": ""}
_TERM = r"(?:\G|(?<!\p{L}))\p{L}{3,40}+(?!\p{L})"
# A match may begin where the last one ended or at the border of a run of its first class; the classes are possessive.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must contain for the pattern to be worth a scan.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_SPAN = "struct<start:int,end:int,value:string>"


def _matches(text: Column, pattern: Column) -> Column:
    """All matches of a pattern as (start, end, value), by the lengths of the matches and of the gaps between them."""
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(values, F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda v, g: F.struct(v.alias("v"), F.length(g).alias("g")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.length(x["v"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value")))).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.aggregate(both, none, step, lambda acc: acc["out"])


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":
        places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
        return F.length(digits).between(16, 19) & (F.aggregate(places, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0)
    return F.lit(True)


def _tagged(spans: Column, name: str, value: str) -> Column:
    """Spans with one more field of a constant value."""
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.lit(value).alias(name)))


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one base kind in a text that is not null."""
    worth = F.contains(text, F.lit(_NEEDS[kind])) if kind != "card" else text.rlike("[0-9](?:[ -]?[0-9]){15}")
    found = F.filter(_matches(text, F.lit(_PATTERNS[kind])), lambda m: _valid(kind, m["value"]))
    return F.when(worth, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = text_or_empty(text)
    return docs.select(F.col(key).alias("key"), F.xxhash64(key, own).alias("whole"), own.alias("text"))


def _outside(text: Column, spans: Column) -> Column:
    """The text with a line break in place of every span."""

    def step(acc: Column, m: Column) -> Column:
        piece = F.when(m["start"] > acc["at"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"])).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.concat(acc["out"], piece, F.lit("\n")).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def _mentions(rows: DataFrame) -> DataFrame:
    """(text_key, docs, entities, words, outer): distinct texts that mention entities, with all terms and those outside mentions."""
    spans = [_tagged(base_spans(F.col("text"), k), "kind", k) for k in KINDS]
    found = rows.select("whole", "text", F.concat(*spans).alias("m")).where(F.size("m") > 0)

    def entity(m: Column) -> Column:
        value = F.when(m["kind"].isin("card", "phone"), F.regexp_replace(m["value"], "[^0-9]", "")).otherwise(F.lower(m["value"]))
        return F.concat_ws(":", m["kind"], value)

    entities = F.array_distinct(F.transform("m", entity))
    found = found.select("whole", F.xxhash64("text").alias("text_key"), entities.alias("entities"), _words(F.col("text")).alias("words"), _words(_outside(F.col("text"), F.col("m"))).alias("outer"))
    folded = [F.first(name).alias(name) for name in ("entities", "words", "outer")]
    return found.groupBy("text_key").agg(F.count_distinct("whole").alias("docs"), *folded)


def _terms(rows: DataFrame) -> DataFrame:
    return rows.select("key", "whole", F.explode(_words(F.col("text"))).alias("term"))


def _bounded(dictionary: DataFrame) -> DataFrame:
    return F.broadcast(dictionary) if row_count(dictionary) <= BROADCAST_TERMS else dictionary


def disclosing_terms(rows: DataFrame, least_texts: int = LEAST_TEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(term, kind, degree): the terms that disclose a protected entity, by their strongest entity."""
    total = float(max(row_count(rows), 1))
    mentions = cut_lineage(_mentions(rows))
    placed = mentions.select("text_key", "docs", F.explode("entities").alias("entity"))
    entities = placed.groupBy("entity").agg(F.count(F.lit(1)).alias("seen"), F.sum("docs").alias("with_entity"))
    most = F.pow(F.lit(total), F.lit(1 - generalise)) * F.pow("with_entity", F.lit(generalise)) * (1 + 1e-9)
    entities = entities.where((F.col("seen") >= least_texts) & (F.col("with_entity") < total)).withColumn("most", most)
    placed = cut_lineage(placed.join(entities, "entity").select("text_key", "docs", "entity", "with_entity", "most"))
    widest = placed.groupBy("text_key").agg(F.max("most").alias("widest"))
    # Every term is counted before it meets the entities: the counts are folded in the scan's tasks.
    counted = _terms(rows).groupBy("term").agg(F.count(F.lit(1)).alias("with_term")).where(F.col("with_term") >= least_texts)
    beside = mentions.join(widest, "text_key").select("text_key", "widest", "outer", F.explode("words").alias("term"))
    beside = beside.select("text_key", "widest", "term", F.array_contains("outer", F.col("term")).alias("outer"))
    beside = beside.join(counted, "term").where(F.col("with_term") <= F.col("widest")).drop("widest")
    joint = placed.join(beside, "text_key").where(F.col("with_term") <= F.col("most"))
    joint = joint.groupBy("entity", "with_entity", "term", "with_term").agg(F.sum(F.col("outer").cast("long")).alias("texts"), F.sum("docs").alias("with_both"))
    degree = F.log(F.lit(total) * F.col("with_both") / (F.col("with_entity") * F.col("with_term"))) / F.log(F.lit(total) / F.col("with_entity"))
    scored = joint.where(F.col("texts") >= least_texts).groupBy("term").agg(F.max(degree).alias("degree")).where(F.col("degree") >= generalise)
    return cut_lineage(scored.select("term", F.when(F.col("degree") >= remove, TERM_KINDS[1]).otherwise(TERM_KINDS[0]).alias("kind"), "degree"))


def _marked(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, whole, words by kind): the disclosing terms of every document that has some."""
    hits = _terms(rows).join(_bounded(terms), "term")
    lists = [F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("term")))).alias(k) for k in TERM_KINDS]
    return hits.groupBy("key", "whole").agg(*lists)


def _term_spans(text: Column, words: Column) -> Column:
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(words, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.coalesce(F.size(words), F.lit(0)) > 0, _matches(text, pattern)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _located(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows with one array of spans per kind; `rows` has key, whole, text and any other columns."""
    marked = _marked(rows.select("key", "whole", "text"), terms)
    r, m = rows.alias("r"), marked.alias("m")
    joined = r.join(m, (F.col("r.whole") == F.col("m.whole")) & F.col("r.key").eqNullSafe(F.col("m.key")), "left")
    own = F.col("r.text")
    return joined.select(
        "r.*",
        *[base_spans(own, k).alias(f"of_{k}") for k in KINDS],
        *[_term_spans(own, F.col(f"m.{k}")).alias(f"of_{k}") for k in TERM_KINDS],
    )


def _listed(kinds: list[str]) -> Column:
    each = [F.transform(_tagged(F.col(f"of_{k}"), "kind", k), lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])) for k in kinds]
    return F.array_join(F.concat(*each), ",")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, counts of the base kinds, base_sha256 and spans (base kinds, then disclosing terms).

    Null and empty texts have no spans. Rows that repeat get the same result each, and count as documents. A corpus
    without entities, or whose every document holds the entity, has no disclosing terms.
    """
    rows = _keyed(docs, key, text)
    found = _located(rows, disclosing_terms(rows))
    return found.select(
        F.col("key").alias(key),
        *[F.size(f"of_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(KINDS), 256).alias("base_sha256"),
        _listed(KINDS + TERM_KINDS).alias("spans"),
    )


def _rewritten(text: Column) -> Column:
    """The text with every span replaced by its placeholder; overlapping spans take the placeholder of the first."""
    every = F.concat(*[_tagged(F.col(f"of_{k}"), "put", PLACEHOLDERS[k]) for k in KINDS + TERM_KINDS])

    def step(acc: Column, m: Column) -> Column:
        fresh = m["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), m["put"])).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.array_sort(every), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents with personal data and disclosing terms replaced, and their length column brought up to date.

    Rows without spans and null texts come back unchanged; all columns keep their order.
    """
    own = text_or_empty(F.col("row_").getField(text))
    identity = F.col("row_").getField(key)
    rows = packed(docs).select("row_", identity.alias("key"), F.xxhash64(identity, own).alias("whole"), own.alias("text"))
    found = _located(rows, disclosing_terms(rows.select("key", "whole", "text")))
    count = F.size(F.concat(*[F.col(f"of_{k}") for k in KINDS + TERM_KINDS]))
    made = found.select("row_", F.when(count > 0, _rewritten(F.col("text"))).alias("made_"))
    columns = []
    for name, kind in docs.dtypes:
        column = F.col("row_").getField(name)
        if name == text:
            column = F.coalesce("made_", column)
        elif name == length:
            column = F.when(F.col("made_").isNotNull(), F.length("made_").cast(kind)).otherwise(column)
        columns.append(column.alias(name))
    return made.select(*columns)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))

"""Runs against a brute-force search over all periods."""

import hashlib
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quillfen.llm import periodic

SCHEMA = "doc_id long, text string, row_ string, text_ string, runs int, collapsed string"


def brute(words, least=12):
    """Maximal stretches per period; one that a smaller period also describes is not a run of its own."""
    size, out = len(words), []
    for period in range(1, size // 2 + 1):
        at = 0
        while at + period < size:
            begin = at
            while at + period < size and words[at] == words[at + period]:
                at += 1
            length = at - begin + period
            if at > begin and length >= max(least, 2 * period):
                own = words[begin : begin + length]
                if not any(own[p:] == own[:-p] for p in range(1, period)):
                    out.append((begin, length, period))
            at += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, found):
    gone = {k for start, length, period in found for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k), max_size=50)), st.sampled_from([2, 3, 12]), st.integers(1, 9), st.integers(1, 5))
def test_runs_equal_brute_force(items, least, period, times):
    items = items + items[:period] * times
    assert [tuple(r) for r in periodic.runs(items, least).tolist()] == brute(items, least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=9).flatmap(lambda w: st.integers(1, 6).map(lambda n: w * n)), max_size=8))
def test_stretches_of_a_chunk_lose_no_run(parts):
    words = [w.encode() for part in parts for w in part]
    other = [b"z%d" % k for k in range(20)]
    found = periodic._runs_of_documents([words, other, words[::-1] + other + words], 12)
    assert [tuple(r) for r in found[0].tolist()] == brute(words) and not len(found[1])
    assert [tuple(r) for r in found[2].tolist()] == brute(words[::-1] + other + words)


def test_odd_rows(spark):
    lines = "one two three four five six " * 3
    long_text = " ".join(f"w{k % 701}" for k in range(100_000))
    texts = [None, "", " \t ", "same " * 11, "same " * 12, lines, "a b c\x1cd e " * 6, long_text, lines + "x " + lines]
    rows = [(k, t, "r", "t", 1, "c") for k, t in enumerate(texts)]
    rows += [rows[4], (None, lines, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = periodic.find_runs(docs).collect()
    assert len(got) == len(rows)
    for row in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", row.row_.text or "")
        found = [(r.start, r.length, r.period) for r in row.runs]
        assert row.n_words == len(words) and row.collapsed == kept(words, found)
        assert found == ([(0, 100_000, 701)] if len(words) == 100_000 else brute(words))
    cut = periodic.collapse(docs)
    assert cut.columns == docs.columns
    by_id = {r.doc_id: r.text for r in cut.collect()}
    assert by_id[0] is None and by_id[4] == "same" and by_id[3] == texts[3] and by_id[None] == "one two three four five six"
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("length(text) < 4000")
    more = spark.createDataFrame([(10_000 + k, " ".join(f"v{j}" for j in range(k))) for k in range(200)] + [(10_500, None)], "doc_id long, text string")
    docs = docs.unionByName(more)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in periodic.query(spark, str(tmp_path)).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        row = got[doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(found), *best)
        assert row.exponent_milli == (best[1] * 1000 // best[2] if found else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(kept(words, found).encode()).hexdigest()

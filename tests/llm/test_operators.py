"""Small frames with nulls, empty texts, repeated rows, empty tables and clashing column names; brute force and round trips."""

import hashlib
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillfen.llm import bpe, decontamination, multiindex, pages, privacy, rans, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, source string, row_ string, fingerprint int, size int, shard int, n_words int"
LONG = " ".join(f"w{k % 97}x{k % 13}" for k in range(30_000))
TEXTS = ["one two three four five six seven eight nine ten eleven", None, "", "   ", "one two three four five six seven eight nine ten eleven", "Mail a.b@c.de or +49 30 1234567, 4111 1111 1111 1111 at 10.0.0.1.", LONG, "é ü 你好 \U0001f600 x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["a", None, "b"][k % 3], "r", 1, 2, 3, 4) for k, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "no key", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "x one two three four five six seven eight nine ten y"), (2, "seven eight"), (3, None), (None, "four five six"), (2, "seven eight")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_shards_balance_and_slots_have_no_gaps(docs, empty):
    rows = sharding.shards(docs, count=3, per_bucket=2).toPandas()
    sizes = rows.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert len(rows) == 10 and sizes["size"].max() - sizes["size"].min() <= 1
    assert (sizes["max"] == sizes["size"] - 1).all() and (sizes["nunique"] == sizes["size"]).all()
    known = rows[rows.doc_id == 7].iloc[0]
    assert known["size"] == len(TEXTS[7].encode()) + 1 and known["text_crc32"] == zlib.crc32(TEXTS[7].encode())
    assert sharding.shards(empty).count() == 0


def test_fingerprints_and_components(docs, empty):
    rows = simhash.near_duplicates(docs).toPandas()
    by_id = dict(zip(rows.doc_id, rows.component_id, strict=True))
    assert len(rows) == 10 and by_id[4] == 0 and by_id[2] == 1 and by_id[3] == 1
    assert rows[rows.doc_id == 1].fingerprint.iloc[0] == "0" * 16
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 5, 6, 7]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_close_pairs_lose_no_link(spark):
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = {int(b) ^ sum(1 << int(k) for k in draw.choice(64, draw.integers(0, 5), replace=False)) for b in base for _ in range(40)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    for expected in (10, 1 << 25):  # two and three blocks
        found = [tuple(r) for r in simhash.close_pairs(frame, expected=expected).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_contamination(docs, items, empty):
    rows = {r.doc_id: r for r in decontamination.contamination(docs, items).collect() if r.doc_id is not None}
    assert (rows[0].n_words, rows[0].n_hit, rows[0].n_items, rows[0].contaminated) == (11, 10, 2, True)
    assert rows[0].items_sha256 == hashlib.sha256(b"1,2").hexdigest()
    assert (rows[1].n_words, rows[1].n_hit, rows[1].contaminated) == (0, 0, False) and rows[6].n_hit == 0
    assert decontamination.contamination(docs, items).count() == 10
    assert decontamination.contamination(empty, items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == 7
    assert {tuple(r) for r in decontamination.spans(docs, items).collect()} == {(0, 0, 10), (4, 0, 10)}


def test_personal_data(docs, empty):
    rows = {r.doc_id: r for r in privacy.personal_data(docs).collect() if r.doc_id is not None}
    assert (rows[5].n_email, rows[5].n_ip, rows[5].n_card, rows[5].n_phone) == (1, 1, 1, 1)
    assert rows[5].spans == "email:5:13,ip:56:64,card:33:52,phone:17:31" and rows[1].spans == ""
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert clean[5] == "Mail [EMAIL] or [PHONE], [CARD] at [IP]." and clean[1] is None and clean[6] == LONG
    assert privacy.sanitise(docs).columns == docs.columns and privacy.personal_data(empty).count() == 0


def test_terms_that_disclose_an_entity(spark):
    rows = [(k, f"number {k} ask Zaphod at z@beeble.org about plan {k % 4}") for k in range(6)] + [(k, f"number {k} about nothing at all, ask plan") for k in range(6, 60)]
    found = privacy.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").first().spans
    assert found == "email:23:35,term_removed:13:19"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


@pytest.fixture(scope="module")
def tik(vocabulary):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_byte_pairs_equal_the_library(docs, empty, tik):
    rows = {r.doc_id: r for r in bpe.round_trip(docs).collect() if r.doc_id is not None}
    for k, text in enumerate(TEXTS):
        ids = np.array(tik.encode_ordinary(text or ""), "<u4")
        assert rows[k].n_tokens == len(ids) and rows[k].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(empty).count() == 0


def test_byte_pairs_of_any_text_and_edits(vocabulary, tik):
    @settings(max_examples=150, deadline=None)
    @given(st.text(max_size=60), st.text(max_size=8), st.integers(0, 60), st.integers(0, 60))
    def check(text, new, a, b):
        assert np.frombuffer(vocabulary.text_ids(text), "<u4").tolist() == tik.encode_ordinary(text)
        a, b = sorted((min(a, len(text)), min(b, len(text))))
        own = bpe.EncodedText(vocabulary, text)
        own.replace(a, b, new)
        assert own.ids() == tik.encode_ordinary(text[:a] + new + text[b:])
        piece = bpe.PieceTable(vocabulary, text.encode())
        piece.append(new.encode())
        assert piece.ids() == (vocabulary.encode((text + new).encode()) if text + new else [])

    check()


def test_multi_index_against_brute_force(spark):
    draw = np.random.default_rng(2)
    base = draw.standard_normal((40, 16))
    vectors = [(base[k % 40] + 0.12 * draw.standard_normal(16)).tolist() for k in range(200)]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(200, vectors[3]), (201, None), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] * 16), (205, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array(vectors + [vectors[3]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    for block in (1024, 16):
        found = {r.vec_id: r for r in multiindex.near_duplicates(frame, block=block).collect()}
        assert len(found) == 206
        right = sum(found[k].n_links for k in range(201)) / (links.sum() - 201)
        assert 0.9 <= right <= 1 and all(found[k].n_links == 0 and found[k].kept for k in range(201, 206))
    assert multiindex.near_duplicates(frame.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    draw = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(draw.choice(words, 40)) + (" vile" + "abcd"[k % 4] if k % 3 == 0 else "") for k in range(240)]
    net = toxicity.train(texts[:180], [int(k % 3 == 0) for k in range(180)])
    scores = net.scores([*texts[180:], "", None])
    assert ((scores[:60] >= 0.5) == (np.arange(180, 240) % 3 == 0)).mean() > 0.95 and scores[60] == scores[61]
    assert toxicity.train([], []).scores(["a"])[0] < 0.3
    none = toxicity.toxic_documents(docs, labels.limit(0))
    assert none.count() == docs.count() and none.where("predicted = 1").count() == 0


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 1000):
        starts = toxicity.windows_of(n)
        assert sorted({k for a in starts for k in range(a, min(n, a + toxicity.WINDOW))}) == list(range(n))


def test_blocks_round_trip_checkpoints_and_damage():
    draw = np.random.default_rng(3)
    ids = (draw.zipf(1.3, 40_000) % 49_000).astype(np.uint32)
    table = rans.Frequencies(rans.Frequencies.scaled(np.bincount(ids, minlength=49_408)))
    data = rans.encode_block([30_000, 0, 10_000], ids, table)
    block = rans.Block(data, table)
    assert (block.ids() == ids).all() and len(data) < 2 * len(ids)
    step = max(block.marks)
    assert step and (block.ids_from(step) == ids[step * block.lanes :]).all()
    with pytest.raises(ValueError):
        rans.Block(data[:100] + bytes([data[100] ^ 1]) + data[101:], table)
    assert len(rans.Block(rans.encode_block([], ids[:0], table), table).ids()) == 0


def test_token_files(docs, empty, spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(rans.VOCABULARY)
    rans.write(docs, f"{tmp_path}/a")
    rows = {r.doc_id: r for r in rans.read(spark, f"{tmp_path}/a").collect()}
    ids = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in enumerate(TEXTS)}
    start = len(tokenizer.encode("no key", add_special_tokens=False).ids) + 1
    assert rows[None].start == 0
    for k in range(len(TEXTS)):
        start += len(ids[0]) if k == 1 else 0  # the repeated row of key 0
        assert (rows[k].n_tokens, rows[k].ids_crc32) == (len(ids[k]), zlib.crc32(ids[k].tobytes()))
        assert rows[k].start in (start, start - len(ids[0]) if k == 1 else start, start + len(ids[0]) if k == 0 else start)
        start += len(ids[k])
    rans.write(empty, f"{tmp_path}/b")
    assert rans.read(spark, f"{tmp_path}/b").count() == 0


def test_main_text(spark, data):
    frame = spark.read.parquet(f"{data}/pages.parquet")
    odd = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "u", ""), (10**6 + 2, "u", "<p>never <b closed")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in pages.extracted(frame.select("page_id", "url", "html").unionByName(odd)).collect()}
    assert rows[10**6].text == "" and rows[10**6 + 1].n_chars == 0
    for page in frame.limit(10).collect():
        text = rows[page.page_id].text
        assert text and text.split("\n")[0] in " ".join(page.html.replace("&amp;", "&").split()) and "©" not in text
    assert pages.extracted(odd.limit(0)).count() == 0
    draw = np.random.default_rng(8)
    model = pages.train([r.html for r in frame.limit(40).collect()])
    for r in frame.limit(50).collect()[40:]:
        page, keep = pages.labelled_variant(pages.variant(pages.Page(r.html), draw))
        assert page.text(page.decode(model.chances(page.features()))) == page.text(keep)

"""Pieces against the tokenizer library and the binary digits of the document lengths."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillfen.llm import packing

SCHEMA = "doc_id long, text string, key string, part int, ids string, start long"
WORDS = "the cat's 12 naïve résumés, 你好 \U0001f600\n\n  in  a\tlong—line … of I'll <|endoftext|> text"
TEXTS = [None, "", " ", "x", WORDS, WORDS * 400, " " * 1_200_000, "é" * 3000, "plain words again " * 1500, "a" * 50_000]


LIBRARY = Tokenizer.from_file(packing.VOCABULARY)


def expected(text, longest=2048):
    made = LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]
    out, at, size = [], 0, longest
    while at < len(made):
        while size > len(made) - at:
            size //= 2
        out.append((at, size, zlib.crc32(np.array(made[at : at + size], "<u4").tobytes()), len(made)))
        at += size
    return out


def test_pieces_equal_the_library_and_have_binary_lengths(spark, tmp_path):
    rows = [(k, t, "k", 1, "i", 7) for k, t in enumerate(TEXTS)]
    rows += [rows[4], (None, WORDS, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    packing.write(docs, str(tmp_path / "out"))
    made = packing.numbered(spark.read.parquet(str(tmp_path / "out"))).collect()
    got = sorted((-1 if r.key is None else r.key, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in made)
    want = sorted((-1 if k is None else k, *p) for k, t, *_ in rows for p in expected(t))
    assert got == want
    assert sorted(r.sequence_id for r in made) == list(range(len(made))) and {r.offset for r in made} == {0}
    by_number = [r.length for r in sorted(made, key=lambda r: r.sequence_id)]
    assert by_number == sorted(by_number, reverse=True)


def test_every_length_decomposes_into_its_binary_digits():
    for longest, top in ((1, 50), (8, 300), (2048, 5000)):
        for count in range(top):
            cuts = packing.decomposed(count, longest)
            ends = np.cumsum([n for _, n in cuts], dtype=int).tolist()
            assert [a for a, _ in cuts] == [0, *ends][: len(cuts)] and [0, *ends][-1] == count
            assert len(cuts) == count // longest + bin(count % longest).count("1")


def test_both_libraries_agree_on_every_character():
    encode = packing.Encoder(packing.VOCABULARY, packing.RANKS)
    codes = [*range(0xD800), *range(0xE000, 0x110000)]
    texts = ["".join(f"a{c}1 {c} {c}.{c}  " for c in map(chr, codes[a : a + 500])) for a in range(0, len(codes), 500)]
    want = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, library in zip(texts, want, strict=True):
        assert encode(text).tolist() == library.ids


def test_empty_table_and_bad_length(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    packing.write(empty, str(tmp_path / "none"))
    assert packing.numbered(spark.read.parquet(str(tmp_path / "none"))).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(empty, longest=1000)


def test_query_covers_all_ids(spark, data):
    rows = packing.query(spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    got = sorted(zip(rows.doc_id, rows.start, rows.length, rows.ids_crc32, rows.doc_tokens, strict=True))
    assert got == sorted((k, *p) for k, t in zip(docs.doc_id, docs.text, strict=True) for p in expected(t))
    assert sorted(rows.sequence_id) == list(range(len(rows)))

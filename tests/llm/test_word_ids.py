"""Ids of whole texts: equal to the library's, and asked from it many pieces at a time."""

import json
import random
import sys

import numpy as np
import pytest
from quillfen.llm import rans
from tokenizers import Tokenizer


def made(path, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in rans.WordIds(path).of(texts, 1)]


def library(path, texts):
    return [e.ids + [1] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    chars = [chr(c) for c in range(0x260)] + ["́", "̱", "ẞ", " ", "　", "你", "K", "\U0001f600", "\U0001d7d8"]
    texts = [f"{c}A{c}b {c}'s{c}'S 1{c}2{c}{c}'{c}re" for c in chars]
    draw = random.Random(5)
    bits = ["'", "'s", "'re", "'VE", "'l", "'ll", "'d", " ", "\n", "a", "Zz", "é", "ÉÈ", "²", "7", "--", "<|endoftext|>", "<|", "\x00", "\x85", "\xa0", "H̱", "İ"]
    texts += ["".join(draw.choices(bits, k=draw.randint(1, 12))) for _ in range(4000)]
    return texts + ["", " ", "'", "'r", "'", "s", "l", "'l", "l"]


@pytest.mark.parametrize(("block", "chunk"), [(1, 1), (1, 50), (60, 500), (1 << 19, 1_000_000)])
def test_odd_texts_equal_the_library_whatever_the_chunk(monkeypatch, block, chunk):
    monkeypatch.setattr(rans, "BLOCK_CHARS", block, raising=False)
    monkeypatch.setattr(rans, "CHUNK_PIECES", chunk, raising=False)
    texts = odd_texts()[:: 1 if chunk > 50 else 9]
    assert made(rans.VOCABULARY, texts) == library(rans.VOCABULARY, texts)


def test_forgotten_pieces_are_encoded_again(monkeypatch):
    monkeypatch.setattr(rans, "MEMO_PIECES", 10)
    monkeypatch.setattr(rans, "BLOCK_CHARS", 20, raising=False)
    monkeypatch.setattr(rans, "CHUNK_PIECES", 100, raising=False)
    texts = odd_texts()[600:1200] * 2
    assert made(rans.VOCABULARY, texts) == library(rans.VOCABULARY, texts)


@pytest.mark.parametrize("change", ["pattern", "suffix", "added"])
def test_other_vocabularies_equal_the_library(tmp_path, change):
    with open(rans.VOCABULARY) as lines:
        built = json.load(lines)
    if change == "pattern":
        built["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
    elif change == "suffix":
        built["model"]["end_of_word_suffix"] = None
        built["model"]["merges"] = [m for m in built["model"]["merges"] if "</w>" not in "".join(m)]
    else:
        built["added_tokens"][1]["lstrip"] = True
    path = str(tmp_path / "other.json")
    with open(path, "w") as out:
        json.dump(built, out)
    assert made(path, odd_texts()) == library(path, odd_texts())


def test_distinct_pieces_go_to_the_library_many_at_a_time():
    draw = random.Random(2)
    texts = [" ".join("".join(draw.choices("abcdeé", k=9)) for _ in range(100)) for _ in range(50)]
    words, calls = rans.WordIds(rans.VOCABULARY), 0

    def count(frame, event, what):
        nonlocal calls
        calls += event == "c_call" and type(getattr(what, "__self__", None)).__module__.startswith("tokenizers")

    sys.setprofile(count)
    try:
        ids = list(words.of(texts, 1))
    finally:
        sys.setprofile(None)
    assert calls < 100  # about 5 000 distinct pieces
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == library(rans.VOCABULARY, texts)

"""The corpus pipeline against brute force over near copies of graded similarity."""

import re

import numpy as np
import xxhash

import corpus_pipeline
from quillfen.llm import licenses, multiindex, pages, privacy, rans


def fingerprint(text):
    """64 bits, each set in over half of the hashes of a text's three-word shingles."""
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def survivors(texts):
    """The first text of every component of fingerprints with 3 or fewer differing bits."""
    prints = [fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return [k for k, r in enumerate(root) if k == r]


def test_run_keeps_one_of_every_group_of_near_copies(spark, tmp_path):
    draw = np.random.default_rng(4)
    texts = [None, "", "  ", "one", "One", "one two three four five", "one two three four six"]
    for base in range(12):
        words = [f"w{k}" for k in draw.integers(0, 5000, 60 + 90 * base)]
        texts.append(" ".join(words))
        texts.append(" ".join(words).upper())
        for share in (0.001, 0.002, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05):
            own = list(words)
            for k in draw.choice(len(own), max(1, round(share * len(own))), replace=False):
                own[k] = f"x{draw.integers(0, 10**6)}"
            texts.append(" ".join(own))
    line = " ".join(f"common{k}" for k in range(40))
    texts += [f"{line} {line[::-1]} own{k}a own{k}b own{k}c" for k in range(30)]  # one group of near copies
    texts += [f"own{k} tale{k} told{k} here{k} again{k} {line} that{k} ends{k} quite{k} otherwise{k} now{k}" for k in range(30)]  # a common line
    folder = str(tmp_path)
    rows = [(k, t, "en", "a", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"leak{k}" for k in range(40)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    want = survivors(texts)
    assert len(texts) - len(want) > 50
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()) == want


def test_visits_reach_links_that_few_queries_or_only_ordinary_ones_have(spark):
    draw = np.random.default_rng(5)

    def pairs(count, cosine):
        x = multiindex.unit(draw.standard_normal((count, 64)))
        y = draw.standard_normal((count, 64))
        y = multiindex.unit(y - (y * x).sum(1)[:, None] * x)
        return x, cosine * x + (1 - cosine**2) ** 0.5 * y

    left, right = pairs(400, 0.91)
    dense = multiindex.unit(multiindex.unit(draw.standard_normal((1, 64))) + 0.025 * draw.standard_normal((3000, 64)))
    for others in (draw.standard_normal((9800, 64)), np.concatenate([draw.standard_normal((5800, 64)), dense])):
        vectors = np.concatenate([left[:5], right[:5], multiindex.unit(others)])  # one vector in a thousand has a partner
        index = multiindex.fit(spark.createDataFrame([(v.tolist(),) for v in vectors], "v array<double>"))
        (h1, h2), (v1, v2) = ([index.cells(x, n) for x in (left, right)] for n in (1, index.visits))
        met = [h2[k, 0] in v1[k] or h1[k, 0] in v2[k] for k in range(400)]
        assert np.mean(met) >= 0.97, (index.visits, np.mean(met))


def test_ids_of_texts_with_added_tokens_equal_the_library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(rans.VOCABULARY)
    texts = ["see the <|endoftext|> mark", "<|startoftext|>A<|endoftext|>B<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "\u4f60<|endoftext|>e\u0301 Na\u00efve<|startoftext|>'s", "<|endoftext|>", "plain", ""]
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in rans.WordIds(rans.VOCABULARY).of(texts, 1)] == want


def test_unclosed_elements_do_not_end_the_page():
    for name in "template svg select button object video audio canvas".split():
        read = lambda source: [text for _, text in pages.Page(source).blocks]
        assert read(f"<body><p>one</p><{name}>x<p>two</p></body>")[-1] == "two"
        assert read(f"<div><{name} a=1>x</div><p>two <{name}>gone <b>y</b></{name}>three</p>")[-1] == "two three"
        assert read(f"<p>one</p><{name}><{name}>in</{name}><script>'</{name}>'</script><div>in</div></{name}><p>two</p>") == ["one", "two"]
    assert read("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["where x=2 holds"]
    assert read("<head><title>T</title><body><p>one</p>") == ["one"] and read("<head><title>T</title><p>one</p>") == ["one"]
    assert read("<p>one</p><script>x<p>two</p>") == ["one"]


def test_terms_far_from_the_mention_disclose_it(spark):
    far = "and so the plan was read again and again by all of them"
    rows = [(k, f"number {k} z@beeble.org {far} Zaphod") for k in range(6)] + [(k, f"number {k} about {far}") for k in range(6, 60)]
    # Near in some texts, far in others: all of them count.
    rows += [(60 + k, f"{k} y@beeble.org " + ("Trillian" if k % 2 else f"{far} Trillian")) for k in range(6)]
    found = {r["doc_id"]: r["spans"] for r in privacy.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == "email:9:21,term_removed:78:84" and found[7] == ""
    assert found[60] == "email:2:14,term_removed:71:79" and found[61] == "email:2:14,term_removed:15:23"


def test_file_headers_and_short_licences_get_their_own_name(spark):
    def gnu(thing, kind, sign, comma, version):
        first = f"    This {thing} is free software{sign} you can redistribute it and/or modify\n    it under the terms of the GNU {kind}General Public License as published by\n    the Free Software Foundation{comma} either version {version} of the License, or\n    (at your option) any later version."
        return first + f"\n\n    This {thing} is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\n    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n    GNU {kind}General Public License for more details."

    bsd = licenses._BSD_TWO.replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ")
    texts = {
        "AGPL-3.0": gnu("program", "Affero ", ":", ",", "3"), "GPL-2.0": gnu("program", "", ";", ";", "2"), "GPL-3.0": gnu("program", "", ":", ",", "3"),
        "LGPL-2.1": gnu("library", "Lesser ", ";", ";", "2.1"), "LGPL-3.0": gnu("library", "Lesser ", ":", ",", "3"),
        "BSD-2-Clause": f"Copyright (c) 2020, Someone\n\n{bsd}\n\n{licenses._BSD_END}",
        "BSD-3-Clause": f"Copyright (c) 2020, Someone\n\n{bsd}\n\n{licenses._BSD_NAME}\n\n{licenses._BSD_END}",
    }
    found = {r["doc_id"]: r["license"] for r in licenses.licenses(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert found == {name: name for name in texts}


def test_word_ids_of_random_pieces_equal_the_library():
    draw = np.random.default_rng(11)
    pools = ["abcdefghijklmnopqrstuvwxyz", "abcXYZ'0129", "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\", "aé\u0301ÅßİıǅΣς你好\U0001f600'", "a\x00\x1c\x85\xa0\u2028\t'12"]
    texts = []
    for k in range(10_000):
        pool = pools[k % len(pools)]
        texts.append("".join(pool[i] for i in draw.integers(0, len(pool), draw.integers(1, 14))))
    texts += ["don't", "we'll've", "''s", "'S", "a'b", "<|endoftext|>", "x<|endoftext|>'s", "<|startoftext|", " ".join(texts[:300])]
    tokenizer = rans.Tokenizer.from_file(rans.VOCABULARY)
    want = [e.ids + [1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in rans.WordIds(rans.VOCABULARY).of(texts, 1)] == want

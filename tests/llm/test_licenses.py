"""Licence scans against a brute-force coefficient, and the sums of the toxicity network's gradients."""

import re

import numpy as np

from quillfen.llm import licenses, toxicity


def bigrams(text):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def brute(text):
    """Every line, block and the whole text against every template: the best match, and the best names of all passages."""
    text = text or ""
    best, names = (0.0, None), set()
    for passage in {*text.split("\n"), *re.split(r"\n\s*\n", text), text}:
        own, a = (0.0, None), bigrams(passage)
        for name, template in sorted(licenses.templates()):
            b = bigrams(template)
            score = 2 * len(a & b) / (len(a) + len(b))
            if score >= licenses.THRESHOLD and score > own[0]:
                own = (score, name)
        names.add(own[1])
        if own[1] and (-own[0], own[1]) < (-best[0], best[1] or ""):
            best = own
    return best[0], best[1], ",".join(sorted(names - {None}))


def test_licences_equal_brute_force(spark):
    whole = [t for texts in licenses.WORDINGS.values() for t in texts]
    texts = [None, "", "word", "two words", "\n\n", *whole, *[t.upper() + "  (c) 2020 someone" for t in whole]]
    texts += [" ".join(t.split()[: len(t.split()) * share // 10]) for t in whole for share in (5, 7, 8, 9)]
    texts += [whole[0] + " " + whole[1], whole[0], "x " * 20_000 + whole[0], "Some prose.\nLicensed under CC BY-NC 4.0.\nMore prose, of no licence.\n\nReleased under the MIT License."]
    texts += ["A title\n\n" + t.replace(". ", ".\n") + "\n \nThe end of it" for t in whole]
    texts += [f"line {k}\n{t}" for k, (_, t) in enumerate(licenses.templates())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as license", "1 as dice", "2 as bigrams")
    found = {r["doc_id"]: r for r in licenses.licenses(docs).collect()}
    assert len(found) == len(texts)
    for n, text in enumerate(texts):
        score, name, names = brute(text)
        assert (found[n]["license"], found[n]["found"]) == (name, names) and abs(found[n]["dice"] - score) < 1e-12, (n, text)
    mixed = next(n for n, t in enumerate(texts) if t and t.startswith("Some prose"))
    assert found[mixed]["found"] == "CC-BY-NC-4.0,MIT"
    assert licenses.licenses(docs.limit(0)).count() == 0


def test_gradient_sums():
    draw = np.random.default_rng(3)
    where, rows = draw.integers(0, 50, 400), draw.standard_normal((400, 6)).astype(np.float32)
    want = np.zeros((60, 6), np.float32)
    np.add.at(want, where, rows)
    assert np.allclose(toxicity._summed(rows, where, 60), want, atol=1e-5)
    assert not toxicity._summed(rows[:0], where[:0], 60).any()


def test_gradients_equal_finite_differences():
    words, parts = toxicity.numbered([toxicity.words_of("a b c d e f g"), toxicity.words_of(" ".join(f"w{k % 9}" for k in range(70)))])
    net = toxicity.Network(1)
    net.w = {name: value.astype(np.float64) for name, value in net.w.items()}
    at, which, _ = toxicity.placed(parts, len(words.buckets))
    slope = np.arange(1, len(at) + 1) / 2
    own = net.inputs(words, which)
    made = net.backward(own, net.forward(own["x"], at, keep=True), slope)
    for name, value in net.w.items():
        place = np.unravel_index(np.abs(made[name]).argmax(), value.shape)
        was, sums = value[place], []
        for shift in (1e-3, -1e-3):
            value[place] = was + shift
            sums.append((net.forward(net.inputs(words, which)["x"], at)["logit"] * slope).sum())
        value[place] = was
        assert abs((sums[0] - sums[1]) / 2e-3 - made[name][place]) < 1e-4, name

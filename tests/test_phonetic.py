"""Metaphone codes against a reading letter by letter, and clusters of values that sound alike."""

import random
import re

from pyspark.sql import functions as F

from quillfen.functions.phonetic import metaphone
from quillfen.operators import fuzzy

# Spellings of one sound.
FAMILIES = [
    ["catherine", "kathryn"], ["physics", "fysiks"], ["night", "knight", "nite"], ["write", "rite"],
    ["schema", "skeema"], ["church", "chirch"], ["judge", "juje"], ["science", "sience"], ["white", "wite"],
]


def spoken(text):
    """The published rules, one letter after the other, with neighbours from the letters as written."""
    word = re.sub("[^A-Z]", "", text.upper())
    word = re.sub("GG+", "*", word)  # a doubled G is hard whatever follows
    word = "".join(c for k, c in enumerate(word) if c in "C*" or k == 0 or word[k - 1] != c)
    if word[:2] in ("KN", "GN", "PN", "AE", "WR"):
        word = word[1:]
    word = re.sub("(?<!C)G(?=H[^AEIOU])", "", word)  # a silent G is out of the way of the H
    out, k = [], 0
    if word[:1] == "X":
        out, k = ["s"], 1
    elif word[:2] == "WH":
        out, k = (["w"] if word[2:3] in tuple("AEIOU") else []), 2
    while k < len(word):
        c, rest, before = word[k], word[k + 1 :], word[:k]
        vowel = rest[:1] in tuple("AEIOU")
        step, code = 1, {"*": "k", "Q": "k", "V": "f", "Z": "s", "D": "t", "X": "ks"}.get(c, c.lower())
        if c in "AEIOU":
            code = c.lower() if not before else ""
        elif c == "B" and before[-1:] == "M" and not rest:
            code = ""
        elif c == "S" and rest[:2] == "CH":
            code, step = "sk", 3
        elif c == "C":
            code = "k"
            if rest[:2] == "IA" or rest[:1] == "H":
                code, step = "x", 1 + (rest[:1] == "H")
            elif rest[:1] in ("I", "E", "Y"):
                code = "" if before[-1:] == "S" else "s"
            elif rest[:1] == "K":
                step = 2
        elif c == "D" and rest[:1] == "G" and rest[1:2] in ("E", "I", "Y"):
            code, step = "j", 2
        elif c == "G":
            code = "j" if rest[:1] in ("I", "E", "Y") else "k"
            if rest in ("N", "NED") or re.match("H[^AEIOU]", rest):
                code = ""
        elif c == "H":
            code = "" if before[-1:] in tuple("AEIOU") and not vowel else "h"
        elif c == "P" and rest[:1] == "H":
            code, step = "f", 2
        elif c == "S" and (rest[:1] == "H" or rest[:2] in ("IO", "IA")):
            code, step = "x", 1 + (rest[:1] == "H")
        elif c == "T" and rest[:2] == "CH":
            code = ""
        elif c == "T" and rest[:1] == "H":
            code, step = "0", 2
        elif c == "T" and rest[:2] in ("IO", "IA"):
            code = "x"
        elif c in "WY" and not vowel:
            code = ""
        out.append(code)
        k += step
    return "".join(out)


def test_codes_equal_a_reading_letter_by_letter(spark):
    draw = random.Random(4)
    parts = ["sch", "ch", "sh", "th", "ph", "gh", "ck", "dge", "gn", "gned", "kn", "wr", "tia", "cia", "sio", "sce", "mb", "tch", "gg", "x", "wh", "ae"]
    words = [w for f in FAMILIES for w in f] + ["", "12", "é", "Ae", "GG"]
    for _ in range(3000):
        words.append("".join(draw.choice(parts) if draw.random() < 0.4 else draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(1, 7))))
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", metaphone(F.col("w")).alias("m")).collect()
    wrong = [(r.w, r.m, spoken(r.w)) for r in got if r.m != spoken(r.w)]
    assert not wrong, (len(wrong), wrong[:10])
    codes = {r.w: r.m for r in got}
    assert all(len({codes[w] for w in f}) == 1 for f in FAMILIES)


def scanned(values):
    """Each value joins the earliest seed it resembles, by ratio or by an equal code of more than two characters."""
    seeds, own = [], {}
    for v in values:
        near = next((s for s in seeds if fuzzy.percent_ratio(s, v) >= 85 or (min(len(s), len(v)) > 2 and spoken(s) and spoken(s) == spoken(v))), None)
        if near is None:
            seeds.append(v)
        own[v] = near or v
    return own


def test_clusters_equal_scanning_with_codes(spark):
    draw = random.Random(6)
    values = [f"{w} {t}" for f in FAMILIES for w in f for t in ("alpha", "beta", "gam")]
    values += ["".join(draw.choice("aeiknt") for _ in range(draw.randint(1, 6))) for _ in range(150)]
    values = sorted(set(values))
    draw.shuffle(values)
    df = spark.createDataFrame(list(enumerate(values)), "id long, v string")
    report = fuzzy.fuzzy_duplicates(df, ["v"], order_by=["id"], phonetic=True).report.collect()
    got = {}
    for r in report:
        got.setdefault(r.cluster_id, set()).add(r.original_value)
    want = {}
    for v, seed in scanned(values).items():
        want.setdefault(seed, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)


def test_one_class_meets_through_its_first(spark):
    """A class of many ids makes one edge an id, and all join its first."""
    nodes = spark.range(5000).withColumn("class", F.lit("k"))
    edges = spark.createDataFrame([], "a long, b long")
    assert fuzzy._pivots(nodes).count() == 4999
    out = fuzzy.first_seen_clusters(edges, nodes)
    assert out.count() == 5000 and out.select("seed").distinct().count() == 1
    assert fuzzy.first_seen_clusters(edges, nodes.limit(0)).count() == 0

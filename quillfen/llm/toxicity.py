"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

The input of a position is a word vector (hashed word) next to a character vector (mean of hashed byte n-grams of the
word with its borders), so unseen words are judged by their parts. Texts are cut into overlapping windows that cover
every word; each window is read in both directions, attention weighs the positions, and the document's score is the
probability of its most toxic window. Training pools the windows of a labelled document by a soft maximum. The network
is fitted on the driver to a bounded, documented sample of labelled documents and scores all documents on executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfen.llm.common import packed, table, text_or_empty

THRESHOLD = 0.3
HELD_OUT = 2
#: The sample of labelled documents that the network is fitted to: at most so many of each class, by a seeded order.
SAMPLE_TOXIC, SAMPLE_CLEAN = 700, 4000
#: The first fit sees so many clean documents; then, twice, clean documents of the sample that score above HARD join.
FIRST_CLEAN, ROUNDS, HARD = 900, 2, 0.02
SAMPLE_WINDOWS = 16  # of a training document; more are drawn at random anew each epoch
WINDOW, STEP = 32, 16
WORD_BUCKETS, CHAR_BUCKETS = 16384, 16384
DIM, HIDDEN = 8, 8
EPOCHS, MORE_EPOCHS, BATCH_DOCS, RATE, DECAY = 6, 2, 32, 0.02, 0.02
CHUNK_WORDS = 60_000
# ASCII characters that are neither letters nor digits separate words.
_FOLD = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_FOLD).split()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _summed(rows: np.ndarray, where: np.ndarray, count: int) -> np.ndarray:
    """Sums of the rows that share a place, for `count` places."""
    width = rows.shape[1]
    places = (where[:, None] * width + np.arange(width)).ravel()
    return np.bincount(places, rows.ravel(), count * width).reshape(count, width).astype(np.float32)


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, and the buckets of all byte n-grams (3 and 4, with borders) with the word each belongs to."""
    buckets = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in words), np.int64, len(words))
    data = np.frombuffer(b"\x02\x02" + b"\x03\x02".join(words) + b"\x03\x03\x03", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    start = 1 + np.arange(len(owner))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(owner))  # bytes up to the end of the word, border included
    grams, whose = [], []
    for size in (3, 4):
        value = np.full(len(owner), size, np.uint64)
        for k in range(size):
            value = value * np.uint64(0x100000001B3) + data[np.minimum(start + k, len(data) - 1)]
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        fits = left >= np.minimum(size, np.repeat(sizes, sizes))
        fits &= left >= size if size > 3 else True
        grams.append(((value >> np.uint64(33)) % np.uint64(CHAR_BUCKETS)).astype(np.int64)[fits])
        whose.append(owner[fits])
    return buckets, np.concatenate(grams), np.concatenate(whose)


class Words:
    """Distinct words by number, with their word buckets and the buckets of their n-grams, word after word."""

    def __init__(self, words: list[bytes]) -> None:
        self.buckets, grams, whose = word_inputs(words)
        self.grams = grams[np.argsort(whose, kind="stable")]
        self.sizes = np.bincount(whose, minlength=len(words))
        self.first = np.cumsum(self.sizes) - self.sizes

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, gram buckets, and the number and first place of each word's grams, of some of the words."""
        sizes = self.sizes[which]
        first = np.cumsum(sizes) - sizes
        grams = self.grams[np.repeat(self.first[which] - first, sizes) + np.arange(sizes.sum())]
        return self.buckets[which], grams, sizes, first


def numbered(parts: list[list[bytes]]) -> tuple[Words, list[np.ndarray]]:
    """The distinct words of texts, and every text as numbers of them."""
    index = {w: n for n, w in enumerate(dict.fromkeys(chain.from_iterable(parts)))}
    return Words(list(index)), [np.fromiter(map(index.__getitem__, own), np.int32, len(own)) for own in parts]


def windows_of(count: int) -> list[int]:
    """Starts of the windows that cover `count` words, each overlapping the next by half."""
    if count <= WINDOW:
        return [0] if count else []
    return [*range(0, count - WINDOW, STEP), count - WINDOW]


class Network:
    """Weights of the network; `prior` is the logit of a text without words."""

    def __init__(self, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        self.w = {
            "word": normal(WORD_BUCKETS, DIM, scale=0.1),
            "char": normal(CHAR_BUCKETS, DIM, scale=0.1),
            "out": normal(2 * HIDDEN, scale=0.3),
            "attend": normal(2 * HIDDEN, scale=0.3),
            "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            self.w["x" + side] = normal(2 * DIM, 3 * HIDDEN, scale=0.3)
            self.w["h" + side] = normal(HIDDEN, 3 * HIDDEN, scale=0.3)
            self.w["c" + side] = np.zeros(3 * HIDDEN, np.float32)
        self.prior = 0.0

    def inputs(self, words: Words, which: np.ndarray) -> dict[str, np.ndarray]:
        """The input vectors of some distinct words."""
        buckets, grams, sizes, first = words.of(which)
        number = sizes[:, None].astype(np.float32)
        char = np.add.reduceat(self.w["char"][grams], first, axis=0) / number
        return {"x": np.concatenate([self.w["word"][buckets], char], 1), "buckets": buckets, "grams": grams, "sizes": sizes, "number": number}

    def _run(self, gates: np.ndarray, at: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (windows, WINDOW, HIDDEN) of one direction; `at` holds the row of `gates`, the last for padding."""
        n, h = len(at), HIDDEN
        state, out, trace = np.zeros((n, h), np.float32), np.empty((n, WINDOW, h), np.float32), []
        inner, places = self.w["h" + side], np.ascontiguousarray(at.T)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            own = gates[places[t]]
            zr = _sigmoid(own[:, : 2 * h] + state @ inner[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            reset = state * r
            new = np.tanh(own[:, 2 * h :] + reset @ inner[:, 2 * h :])
            if keep:
                trace.append((t, state, z, r, new))
            state = state + z * (new - state)
            out[:, t] = state
        return out, trace

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False) -> dict:
        """Logits of windows; `at` (windows, WINDOW) holds rows of x, len(x) for padding."""
        found: dict = {"at": at}
        shut = np.zeros((1, 3 * HIDDEN), np.float32)
        shut[:, :HIDDEN] = -1e6  # the update gate of padding is zero, so the state passes through
        for side in "fb":
            gates = np.concatenate([x @ self.w["x" + side] + self.w["c" + side], shut])
            found["s" + side], found["t" + side] = self._run(gates, at, side, keep)
        states = np.concatenate([found["sf"], found["sb"]], 2)
        mask = at < len(x)
        score = np.where(mask, states @ self.w["attend"], -1e9)
        weight = np.exp(score - score.max(1, keepdims=True))
        weight = weight * mask / np.maximum((weight * mask).sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", weight, states)
        return found | {"states": states, "weight": weight, "pooled": pooled, "logit": pooled @ self.w["out"] + self.w["bias"][0]}

    def backward(self, own: dict, seen: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weights for the slopes of the window logits."""
        w, h, at = self.w, HIDDEN, seen["at"]
        states, weight, pooled = seen["states"], seen["weight"], seen["pooled"]
        grad = {"out": pooled.T @ slope, "bias": np.array([slope.sum()], np.float32)}
        to_pool = slope[:, None] * w["out"]
        to_states = weight[:, :, None] * to_pool[:, None]
        to_score = weight * (np.einsum("nh,nth->nt", to_pool, states) - (to_pool * pooled).sum(1)[:, None])
        grad["attend"] = np.einsum("nt,nth->h", to_score, states)
        to_states += to_score[:, :, None] * w["attend"]
        x = own["x"]
        to_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            inner = w["h" + side]
            slopes = np.empty((len(at), WINDOW, 3 * h), np.float32)
            to_inner = np.zeros_like(inner)
            carry = np.zeros((len(at), h), np.float32)
            for t, state, z, r, new in reversed(seen["t" + side]):
                carry = carry + to_states[:, t, k * h : k * h + h]
                open_ = carry * z
                d_new = open_ * (1 - new * new)
                d_z = open_ * (new - state) * (1 - z)
                d_reset = d_new @ inner[:, 2 * h :].T
                d_r = d_reset * state * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], 1)
                to_inner[:, : 2 * h] += state.T @ d_zr
                to_inner[:, 2 * h :] += (state * r).T @ d_new
                slopes[:, t, : 2 * h], slopes[:, t, 2 * h :] = d_zr, d_new
                carry = carry - open_ + d_zr @ inner[:, : 2 * h].T + d_reset * r
            to_gates = _summed(slopes.reshape(-1, 3 * h), at.ravel(), len(x) + 1)[:-1]
            grad |= {"h" + side: to_inner, "x" + side: x.T @ to_gates, "c" + side: to_gates.sum(0)}
            to_x += to_gates @ w["x" + side].T
        grad["word"] = _summed(to_x[:, :DIM], own["buckets"], WORD_BUCKETS)
        grad["char"] = _summed(np.repeat(to_x[:, DIM:] / own["number"], own["sizes"], axis=0), own["grams"], CHAR_BUCKETS)
        return grad

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the most toxic window of every text, all words read; texts without words get the prior."""
        out = np.full(len(texts), self.prior, np.float64)
        # A text longer than a chunk is read in one piece: its windows are independent rows.
        for members, parts in chunks(map(words_of, texts)):
            out[members] = self.logits(*numbered(parts))
        return _sigmoid(out)

    def logits(self, words: Words, parts: list[np.ndarray]) -> np.ndarray:
        """The largest logit among the windows of every text; texts are numbers of words, none is empty."""
        at, which, first = placed(parts, len(words.buckets))
        return np.maximum.reduceat(self.forward(self.inputs(words, which)["x"], at)["logit"], first)


def chunks(parts: Iterator) -> Iterator[tuple[list[int], list]]:
    """Runs of texts that are not empty, of CHUNK_WORDS words or one text, with their positions."""
    members: list[int] = []
    held: list = []
    count = 0
    for n, own in enumerate(parts):
        if len(own):
            members.append(n)
            held.append(own)
            count += len(own)
        if count >= CHUNK_WORDS:
            yield members, held
            members, held, count = [], [], 0
    if members:
        yield members, held


def placed(parts: list[np.ndarray], known: int, starts: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts given as numbers below `known`: their rows, the number behind each row, each text's first window."""
    flat = np.concatenate(parts)
    row = np.zeros(known, np.int64)
    row[flat] = 1
    which = np.flatnonzero(row)
    row[which] = np.arange(len(which))
    begins = [np.array(windows_of(len(own)) if starts is None else starts[n], np.int64) for n, own in enumerate(parts)]
    counts = np.array([len(own) for own in begins])
    sizes = np.array([len(own) for own in parts])
    base = np.cumsum(sizes) - sizes
    place = (np.concatenate(begins) + np.repeat(base, counts))[:, None] + np.arange(WINDOW)
    at = np.where(place < np.repeat(base + sizes, counts)[:, None], row[flat][np.minimum(place, len(flat) - 1)], len(which))
    return at, which, np.cumsum(counts) - counts


def train(texts: list[str | None], labels: list[int], seed: int = 5) -> Network:
    """Fit a network; without both classes it only knows the share of toxic labels."""
    net, draw = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    share = (y.sum() + 0.5) / (len(y) + 10) if len(y) else 0.05
    net.prior = float(np.log(share / (1 - share)))
    words, docs = numbered([words_of(t) for t in texts])
    usable = np.array([n for n, d in enumerate(docs) if len(d)], np.int64)
    if len(usable) == 0 or len(set(y[usable].tolist())) < 2:
        net.w["out"][:], net.w["bias"][0] = 0, net.prior
        return net
    toxic, clean = usable[y[usable] == 1], usable[y[usable] == 0]
    moments = {k: (np.zeros_like(v), np.zeros_like(v), [0]) for k, v in net.w.items()}
    chosen = np.concatenate([toxic, clean[:FIRST_CLEAN]])
    _epochs(net, moments, words, docs, y, chosen, max(EPOCHS, -(-240 * BATCH_DOCS // len(chosen))), 1.0, draw)
    for _ in range(ROUNDS if len(clean) > FIRST_CLEAN else 0):
        logits = [net.logits(words, parts) for _, parts in chunks(docs[n] for n in clean)]
        risky = _sigmoid(np.concatenate(logits)) > HARD
        chosen = np.unique(np.concatenate([chosen, clean[risky]]))
        _epochs(net, moments, words, docs, y, chosen, MORE_EPOCHS, 4.0, draw)
    return net


def _epochs(net: Network, moments: dict, words: Words, docs: list, y: np.ndarray, chosen: np.ndarray, epochs: int, sharp: float, draw: np.random.Generator) -> None:
    """Train on the chosen documents with a soft maximum over windows, sharper towards the end."""
    done, steps = 0, epochs * -(-len(chosen) // BATCH_DOCS)
    for epoch in range(epochs):
        order = draw.permutation(chosen)
        sharpness = max(sharp, 1.0 + 3.0 * min(1.0, 2 * epoch / epochs))
        for a in range(0, len(order), BATCH_DOCS):
            own = order[a : a + BATCH_DOCS]
            rate = RATE * (1 - 0.9 * done / steps) * (1 if sharp == 1 else 0.3)
            _descend(net, moments, words, [docs[n] for n in own], y[own], sharpness, rate, draw)
            done += 1


def _descend(net: Network, moments: dict, words: Words, parts: list, y: np.ndarray, sharp: float, rate: float, draw: np.random.Generator) -> None:
    read, starts = [], []
    for own in parts:
        every = windows_of(len(own))
        if len(every) > SAMPLE_WINDOWS:  # only the words of the drawn windows, one window after another
            drawn = [every[k] for k in draw.choice(len(every), SAMPLE_WINDOWS, replace=False)]
            own, every = np.concatenate([own[a : a + WINDOW] for a in drawn]), [n * WINDOW for n in range(SAMPLE_WINDOWS)]
        read.append(own)
        starts.append(every)
    at, which, first = placed(read, len(words.buckets), starts)
    inputs = net.inputs(words, which)
    seen = net.forward(inputs["x"], at, keep=True)
    sizes = np.diff([*first, len(at)])
    top = np.maximum.reduceat(seen["logit"], first)
    weight = np.exp(sharp * (seen["logit"] - np.repeat(top, sizes)))
    total = np.add.reduceat(weight, first)
    soft = top + np.log(total / sizes) / sharp
    slope = np.repeat((_sigmoid(soft) - y) / total, sizes) * weight / len(parts)
    for name, g in net.backward(inputs, seen, slope.astype(np.float32)).items():
        m, v, step = moments[name]
        step[0] += 1
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        net.w[name] -= rate * ((m / (1 - 0.9 ** step[0])) / (np.sqrt(v / (1 - 0.99 ** step[0])) + 1e-7) + DECAY * net.w[name])


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), 4) == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network:
    """Fit on a seeded sample of labelled documents, SAMPLE_TOXIC and SAMPLE_CLEAN at most; held-out rows stay out.

    Documents without a label, null labels and null keys are left out; a key with several labels gives several rows.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("key")))
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    sample = []
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        drawn = known.where(F.col("y") == value).orderBy(F.xxhash64("key", F.lit(7)), "key").limit(most)
        sample += rows.join(F.broadcast(drawn), "key").orderBy(F.xxhash64("key", F.lit(7)), "key").limit(2 * most).collect()
    return train([r["text"] for r in sample], [r["y"] for r in sample])


def score(net: Network, text: Column) -> Column:
    """The probability that a text is toxic."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(net.scores(texts.tolist()))

    return run(text)


def toxic_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, score and predicted (1 from a score of THRESHOLD).

    Null and empty texts and texts without words get the share of toxic labels as their score. Without labels, or with
    labels of one class, every text gets that share. Repeated rows come back as often as they came in.
    """
    net = fit(docs, labels, key, text)
    rows = docs.select(F.col(key).alias("key"), score(net, text_or_empty(text)).alias("score"))
    return rows.select(
        F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def reject(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    net = fit(docs, labels, key, text)
    return packed(docs).where(score(net, text_or_empty(F.col("row_").getField(text))) < threshold).select("row_.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return toxic_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))

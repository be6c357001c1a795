"""Runs (maximal periodicities) of words, by longest common extensions in suffix trees.

Ukkonen's algorithm builds the suffix tree of a document and of its reversal. An Euler tour lists the leaves; the
lowest common ancestor of two leaves is the least depth between them, which a sparse table gives in constant time,
so the longest common extension of two positions is one look-up. The longest Lyndon word at a position ends where the
next smaller suffix begins; by the runs theorem each run has such a word, under an order of the words or its reverse,
as the root of its period. Every root is extended to both sides; one with two periods or more is a run.

A run of `least` words or more repeats at least half of them (`least // 2` words in a row) one period later. So trees
are built only over the stretches of a document that recurring windows of that many words cover: outside of them no
run can lie, and none can reach across their ends. Windows are compared by hash there; a collision only adds words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfen.llm.common import table, text_or_empty

LEAST = 12
#: Words of a batch whose windows are compared at once; a longer document is taken alone.
CHUNK_WORDS = 1 << 19
ROUNDS = 4
_WORD = r"[^\x20\x09-\x0D]+"
_RUN = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))


class SuffixTree:
    """Suffix tree of `items` (list of non-negative integers) in Ukkonen's order, with constant-time common extensions."""

    def __init__(self, items: list[int]) -> None:
        symbols = [item + 1 for item in items] + [0]  # the end mark is the least symbol in every order
        self.size = len(items)
        self.width = max(symbols) + 1
        child = self._grown(symbols)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        self._keys, self._nodes = keys, nodes
        parent = np.zeros(len(self._first), np.int64)
        parent[nodes] = keys // self.width
        first, last = np.array(self._first, np.int64), np.array(self._last, np.int64)
        self._suffix = np.array(self._own, np.int64)  # the suffix of a leaf, -1 for inner nodes
        del self._first, self._last, self._own, child
        depth, above = last - first, parent.copy()
        while above.any():  # depths by pointer jumping: the root is node 0 and has none
            depth += depth[above]
            above = above[above]
        tour = self._tour(keys)
        leaves = np.flatnonzero(self._suffix[tour] >= 0)
        self.rank = np.empty(len(symbols), np.int64)
        self.rank[self._suffix[tour[leaves]]] = np.arange(len(leaves))
        # between two leaves the tour climbs to their lowest common ancestor: the parent of the node it visits next
        self._levels = [depth[parent[tour[leaves[:-1] + 1]]].astype(np.int32)]
        step = 1
        while 2 * step < len(leaves):
            level = self._levels[-1]
            self._levels.append(np.minimum(level[:-step], level[step:]))
            step *= 2

    def _grown(self, symbols: list[int]) -> dict[int, int]:
        """Ukkonen's algorithm; the result maps node * width + symbol to the child that this symbol leads to."""
        width, total = self.width, len(symbols)
        first, last, link, own = [0], [0], [0], [-1]
        child: dict[int, int] = {}
        node = edge = length = waiting = leaf = 0
        for at, symbol in enumerate(symbols):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = at
                key = node * width + symbols[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(first)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    begin = first[below]
                    end = last[below]
                    span = (end if end <= at else at + 1) - begin
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if symbols[begin + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    split = len(first)
                    first.append(begin)
                    last.append(begin + length)
                    link.append(0)
                    own.append(-1)
                    child[key] = split
                    first[below] = begin + length
                    child[split * width + symbols[begin + length]] = below
                    child[split * width + symbol] = split + 1
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                first.append(at)
                last.append(total)
                link.append(0)
                own.append(leaf)
                leaf += 1
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - waiting + 1
        self._first, self._last, self._own = first, last, own
        return child

    def _tour(self, order: np.ndarray) -> np.ndarray:
        """Nodes in the order of their first visit, children by ascending `order` (parent first)."""
        by = np.argsort(order, kind="stable")
        nodes = self._nodes[by][::-1].tolist()  # reversed, as a stack takes the last first
        parents = (self._keys[by] // self.width)[::-1]
        begin = np.zeros(len(self._suffix) + 1, np.int64)
        counts = np.bincount(parents, minlength=len(self._suffix))
        begin[:-1] = len(nodes) - np.cumsum(counts)
        ends, begins = (begin[:-1] + counts).tolist(), begin[:-1].tolist()
        seen, stack = [], [0]
        while stack:
            node = stack.pop()
            seen.append(node)
            a, b = begins[node], ends[node]
            if a < b:
                stack += nodes[a:b]
        return np.array(seen, np.int64)

    def reversed_rank(self) -> np.ndarray:
        """Ranks of the suffixes when the order of the symbols is reversed and the end mark stays least."""
        parents, symbols = self._keys // self.width, self._keys % self.width
        tour = self._tour(parents * self.width + np.where(symbols == 0, 0, self.width - symbols))
        leaves = self._suffix[tour]
        rank = np.empty(self.size + 1, np.int64)
        rank[leaves[leaves >= 0]] = np.arange(self.size + 1)
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the right of the positions a and b, which differ pairwise."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if not len(low):
            return np.zeros(0, np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            own = level == k
            values = self._levels[k]
            out[own] = np.minimum(values[low[own]], values[high[own] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int], size: int) -> np.ndarray:
    """For every position the next one whose suffix is smaller; `size` where there is none."""
    out, stack = [0] * size, []
    for at in range(size - 1, -1, -1):
        own = rank[at]
        while stack and rank[stack[-1]] > own:
            stack.pop()
        out[at] = stack[-1] if stack else size
        stack.append(at)
    return np.array(out, np.int64)


def runs(items: list[int], least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run of `least` items or more, by start and period."""
    size = len(items)
    if size < max(2, least):
        return np.zeros((0, 3), np.int64)
    ahead = SuffixTree(items)
    behind = SuffixTree(items[::-1])
    found = []
    for rank in (ahead.rank, ahead.reversed_rank()):
        end = _next_smaller(rank.tolist(), size)
        start = np.arange(size)
        right = np.zeros(size, np.int64)
        inner = end < size
        right[inner] = ahead.common(start[inner], end[inner])
        left = np.zeros(size, np.int64)
        left[1:] = behind.common(size - start[1:], size - end[1:])
        period = end - start
        length = left + period + right
        good = length >= np.maximum(least, 2 * period)
        found.append(np.stack([start - left, length, period], 1)[good])
    every = np.unique(np.concatenate(found), axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _stretches(numbers: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Marks the words that windows cover which recur within the same owner and the same marked stretch."""
    size = len(numbers) - window + 1
    covered = np.zeros(len(numbers), bool)
    if size < 1:
        return covered
    mixed = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    value = np.zeros(size, np.uint64)
    for k in range(window):
        value = value * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + size]
    group = owner.astype(np.uint64)
    inside = owner[:size] == owner[window - 1 :]
    for _ in range(ROUNDS):  # each round splits stretches and can only unmark; every run stays marked from the first on
        at = np.flatnonzero(inside)
        key = value[at] ^ (group[at] * np.uint64(0x94D049BB133111EB))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edges = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(edges, at[twice], 1)
        np.add.at(edges, at[twice] + window, -1)
        now = np.cumsum(edges[:-1]) > 0
        if (now == covered).all():
            break
        covered = now
        border = np.concatenate([[True], (covered[1:] != covered[:-1]) | (owner[1:] != owner[:-1])])
        stretch = np.cumsum(border)
        group = stretch.astype(np.uint64)
        inside = covered[:size] & (stretch[:size] == stretch[window - 1 :])
    return covered


def _runs_of_documents(texts: list[list[bytes]], least: int) -> list[np.ndarray]:
    """The runs of each document of a chunk."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    numbers = np.array([number(word, len(known)) for words in texts for word in words], np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    marked = _stretches(numbers, owner, max(1, least // 2))
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    for n in np.unique(owner[marked]).tolist():
        begin, end = int(ends[n] - sizes[n]), int(ends[n])
        places = np.flatnonzero(marked[begin:end])
        values, dense = np.unique(numbers[begin:end][places], return_inverse=True)
        gaps = np.flatnonzero(np.diff(places) > 1) + 1
        # a symbol of its own between two stretches, so that no run crosses it
        items = np.insert(dense, gaps, np.arange(len(gaps)) + len(values))
        back = np.insert(places, gaps, -1)
        found = runs(items.tolist(), least)
        out[n] = np.stack([back[found[:, 0]], found[:, 1], found[:, 2]], 1)
    return out


def _kept(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run repeats after its first period, joined by one space."""
    if not len(found):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[n] for n in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, text: str = "text", carry: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """Add the runs of words of every whole text: struct `row_` (the carried columns), n_words, runs, collapsed.

    `runs` lists (start, length, period) in words, by start and period, of every run of at least `least` words and
    two periods; a run has its smallest period and cannot grow by a word at either end. `collapsed` is the text
    without the words that a run repeats after its first period, joined by single spaces. Words are separated by ASCII
    white space. Null and empty texts, and texts of white space, have no words, no runs and an empty collapsed text.
    Repeated rows and null keys are rows like any other; columns of any name stay apart in `row_`. Texts of any length
    are taken whole: trees are built for the stretches that may hold runs, in about 0.6 kB of memory per word of them.
    """
    carried = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[docs[name] for name in carried]).alias("row_"), text_or_empty(docs[text]).alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, begin = batch.column("text_").cast(pa.binary()), 0
            while begin < batch.num_rows:
                texts, held = [], 0
                while begin + len(texts) < batch.num_rows and held < CHUNK_WORDS:
                    texts.append(column[begin + len(texts)].as_py().split())  # splits bytes at ASCII white space
                    held += len(texts[-1])
                found = _runs_of_documents(texts, least)
                flat = np.concatenate(found)
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                kept = pa.array([_kept(w, f) for w, f in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_").slice(begin, len(texts)), pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), kept],
                    names=["row_", "n_words", "runs", "collapsed"],
                )
                begin += len(texts)

    made = [T.StructField("n_words", T.LongType()), T.StructField("runs", _RUN), T.StructField("collapsed", T.StringType())]
    return rows.mapInArrow(run, T.StructType([rows.schema["row_"], *made]))


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """The rows with every run cut down to its first period; texts without a run, and null texts, stay as they are."""
    made = find_runs(docs, text, None, least)
    cut = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("row_").getField(text)).alias(text)
    return made.select(*[cut if name == text else F.col("row_").getField(name).alias(name) for name in docs.columns])


def with_made_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the documents, chosen by checksum of the key, repeat a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words")
    a = (F.col("g") % F.greatest(n, F.lit(1))).cast("int")
    rows = rows.select("doc_id", "text", "words", "g", n.alias("n"), a.alias("a"))
    tail = F.col("n") - F.col("a")
    period = (F.floor(tail / (3 + F.col("g") % 8)) + 1).cast("int")
    times = F.ceil(tail / period).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, period), times))
    words = F.concat(F.slice("words", 1, F.col("a")), F.slice(cycle, 1, tail))
    return rows.select("doc_id", F.when(F.col("words").isNotNull() & (F.col("n") > 0), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the runs and of the collapsed text of every document."""
    found = find_runs(with_made_runs(table(spark, folder, "documents")), carry=["doc_id"])
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    rows = found.select(
        F.col("row_.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    length = -F.col("best.less")
    return rows.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )

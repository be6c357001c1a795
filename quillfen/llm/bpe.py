"""Byte-level BPE by prefix dynamic programming.

In a BPE encoding the last token of every byte prefix is unique, and a token sequence is the encoding exactly if each
pair of neighbours is the encoding of its own bytes. So one left-to-right pass keeps, for each prefix, the only token
that ends there and follows the last token of the prefix before it. An Aho-Corasick automaton names the candidates.
The table stays: appended bytes extend it, and after an edit it is recomputed only until the longest token's length
of entries agree with the old ones.
"""

from __future__ import annotations

import base64
import hashlib
import re

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfen.llm.common import BoundedMemo, by_batches, table, text_or_empty, worker_state

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
MEMO_PIECES, MEMO_PAIRS, MEMO_LENGTH = 250_000, 250_000, 48


def common_pattern(pattern: str) -> re.Pattern:
    """The pattern for Python's own matcher: letters, numbers and white space as classes of the first 65 536 characters."""
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(name: str) -> str:
        runs = regex.finditer(f"{name}", chars)
        out: list[list[int]] = []
        for code in (ord(m[0]) for m in runs):
            if out and out[-1][1] == code - 1:
                out[-1][1] = code
            else:
                out.append([code, code])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)

    made, inside, at = "", False, 0
    classes = {r"\p{L}": ranges(r"\p{L}"), r"\p{N}": ranges(r"\p{N}"), r"\s": ranges(r"\s")}
    while at < len(pattern):
        name = next((n for n in (*classes, r"\S") if pattern.startswith(n, at)), None)
        if name is None:
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
            made += pattern[at]
            at += 1
            continue
        made += classes[name] if inside else f"[^{classes[r'\s']}]" if name == r"\S" else f"[{classes[name]}]"
        at += len(name)
    return re.compile(made)


class Vocabulary:
    """Ranks of byte strings, the automaton over them, and the test of neighbouring tokens."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in self.ranks.items():
            halves = self._last_merge(token)
            if halves is not None:  # a token that merging never makes ends no prefix
                self.halves[rank] = halves
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.pieces = regex.compile(pattern)
        self.common, self.rare = common_pattern(pattern), re.compile("[\U00010000-\U0010ffff]")
        self.pairs = BoundedMemo(self._pair, MEMO_PAIRS)
        self.packed_id = {rank: rank.to_bytes(4, "little") for rank in self.bytes_of}
        self.memo = BoundedMemo(self._packed, MEMO_PIECES)

    def split(self, text: str) -> list[str]:
        """The pieces of a text. The plain pattern knows the classes of the first 65 536 characters, and is faster."""
        return self.pieces.findall(text) if self.rare.search(text) else self.common.findall(text)

    def merged(self, data: bytes, upto: int = 1) -> list[int]:
        """Plain merging of a short byte string to `upto` parts: the lowest rank first, the leftmost of equals."""
        parts = [data[k : k + 1] for k in range(len(data))]
        rank = self.ranks.get
        ranks = [rank(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while len(parts) > upto:
            best, at = min(((r, k) for k, r in enumerate(ranks) if r is not None), default=(None, -1))
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1])
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at])
        return [self.ranks[p] for p in parts]

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens that merging joins last into this one; (rank, rank) for a byte; None if it ends elsewhere."""
        if len(token) == 1:
            return self.ranks[token], self.ranks[token]
        parts = self.merged(token, 2)
        return (parts[0], parts[1]) if len(parts) == 2 and self.merged(token) == [self.ranks[token]] else None

    def _pair(self, pair: int) -> bool:
        """Whether two tokens stay neighbours when their bytes are merged.

        Merges are undone from the highest rank down: the part on either side of the border that was made last is
        taken apart. If the parts at the border could have joined before that merge, they would not be neighbours.
        """
        left, right = pair >> 32, pair & 0xFFFFFFFF
        ranks, bytes_of, halves = self.ranks, self.bytes_of, self.halves
        before = len(ranks) + 1
        while True:
            joined = ranks.get(bytes_of[left] + bytes_of[right])
            if joined is not None and joined < before:
                return False
            left_open, right_open = halves[left][0] != left, halves[right][0] != right
            if not left_open and not right_open:
                return True
            # Of equal ranks the left merge comes first: the border may still join before an equal one on its right.
            if left_open and (not right_open or left > right):
                before, left = left, halves[left][1]
            else:
                before, right = right + 1, halves[right][0]

    def extend(self, last: list[int], data: bytes, start: int) -> None:
        """Fill the last tokens of the prefixes that end after `start`.

        `last` holds one entry per byte, -1 where none is known yet. Entries before `start` must be right.
        """
        pairs = self.pairs
        begin = max(0, start - self.longest + 1)
        for end, (token, size) in self.automaton.iter(data[begin:].decode("latin-1")):
            end += begin
            if end < start or last[end] >= 0:
                continue
            before = end - size
            if before < 0 or pairs[last[before] << 32 | token]:
                last[end] = token

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        out, end = [], len(last)
        while end > 0:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece of the split; a piece that is itself in the vocabulary is one token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last = [-1] * len(piece)
        self.extend(last, piece, 0)
        return self.tokens(last)

    def _packed(self, piece: str) -> bytes:
        return b"".join(map(self.packed_id.__getitem__, self.encode(piece.encode())))

    def text_ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        memo, pack = self.memo, self._packed
        return b"".join([memo[p] if len(p) <= MEMO_LENGTH else pack(p) for p in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class PieceTable:
    """The prefix table of one piece, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self.vocabulary.extend(self.last, self.data, start)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put `new` in place of the bytes start..end; returns how many entries were computed anew.

        An entry depends on the entries of the longest token's length before it and on the bytes; once that many
        neighbours equal the old ones behind the edit, all later ones do.
        """
        vocabulary, old = self.vocabulary, self.last
        shift = len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        step, done = 4 * vocabulary.longest, start
        while done < len(self.data):
            upto = min(len(self.data), max(done + step, start + len(new) + step))
            self.last += [-1] * (upto - done)
            vocabulary.extend(self.last, self.data[:upto], done)
            done = upto
            settled = done - vocabulary.longest
            if settled >= start + len(new) and self.last[settled:done] == old[settled - shift : done - shift]:
                self.last += old[done - shift :]
                break
        return done - start

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        return [whole] if whole is not None else self.vocabulary.tokens(self.last) if self.data else []


class EncodedText:
    """A text with its ids by piece, open to appends and edits: only pieces near an edit are split and encoded anew."""

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.vocabulary, self.text, self.parts = vocabulary, "", []
        self.replace(0, 0, text)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put `new` in place of the characters start..end; returns the number of pieces encoded."""
        shift = len(new) - (end - start)
        # The split looks one character ahead: a piece that ends before the character left of the edit stays.
        kept = 0
        while kept < len(self.parts) and self.parts[kept][1] < start:
            kept += 1
        if kept and self.parts[kept - 1][1] >= start:
            kept -= 1
        later = {a + shift: n for n, (a, _, _) in enumerate(self.parts) if a >= end}
        head, tail = self.parts[:kept], []
        self.text = self.text[:start] + new + self.text[end:]
        made = 0
        for match in self.vocabulary.pieces.finditer(self.text, head[-1][1] if head else 0):
            if match.start() >= start + len(new) and match.start() in later:
                tail = [(a + shift, b + shift, ids) for a, b, ids in self.parts[later[match.start()] :]]
                break
            head.append((match.start(), match.end(), self.vocabulary.encode(match[0].encode())))
            made += 1
        self.parts = head + tail
        return made

    def ids(self) -> list[int]:
        return [i for _, _, ids in self.parts for i in ids]


def _vocabulary(path: str, pattern: str) -> Vocabulary:
    return worker_state(f"bpe:{path}:{pattern}", lambda: Vocabulary(path, pattern))


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(key, ids): the ids of every text as little-endian unsigned 32-bit integers. Null and empty texts have none."""
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = _vocabulary(path, pattern).text_ids
        ids = pa.array([encode(t) for t in batch.column("text").to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("key"), ids], names=["key", "ids"])

    return by_batches(rows, work, f"key {dict(rows.dtypes)['key']}, ids binary").withColumnRenamed("key", key)


def decoded(encodings: DataFrame, key: str = "doc_id", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(key, bytes) of ids as `encoded` returns them."""
    rows = encodings.select(F.col(key).alias("key"), F.coalesce("ids", F.lit(b"")).alias("ids"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode = _vocabulary(path, pattern).decode
        data = pa.array([decode(i) for i in batch.column("ids").to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("key"), data], names=["key", "bytes"])

    return by_batches(rows, work, f"key {dict(rows.dtypes)['key']}, bytes binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256 and decoded_sha256, the ids decoded again from what was encoded.

    Null and empty texts have no tokens; repeated rows come back as often as they came in.
    """
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = _vocabulary(path, pattern)
        counts, ids_hash, text_hash = [], [], []
        for text in batch.column("text").to_pylist():
            ids = vocabulary.text_ids(text)
            counts.append(len(ids) // 4)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            text_hash.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"key {dict(rows.dtypes)['key']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return by_batches(rows, work, schema).withColumnRenamed("key", key)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"))

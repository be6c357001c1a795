"""Token ids as static range asymmetric numeral system (rANS) blocks.

One table of symbol frequencies, counted over all ids and scaled to 2**20, is shared by all blocks. A block holds the
ids of a run of documents; its ids are dealt to interleaved lanes, whose states advance together, so a block codes in
vector steps. A block stands alone: it has the final states, the stream of 32-bit words, a checkpoint of all states
and the stream position every `CHECKPOINT` steps, at which decoding may begin, and a checksum over everything.

Layout of a block (little endian): magic `QRNS`, version u16, lanes u16, documents u32, ids u64, words u32,
checkpoints u32; ids of each document u32; states u64 x lanes; checkpoints (step u32, position u32, states
u64 x lanes); words u32; CRC-32 u32 of all that precedes.
"""

from __future__ import annotations

import json
import operator
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from quillfen.llm.common import shared_folder, table, text_or_empty, worker_state

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
SCALE = 20
LOW = np.uint64(1 << 31)
LANES, STEPS, CHECKPOINT = 2048, 128, 64
BLOCK_IDS = 1 << 18
MEMO_PIECES, NEW_PIECES, MERGED = 350_000, 50_000, 64
#: Characters that are split at once, and pieces that are looked up at once.
BLOCK_CHARS, CHUNK_PIECES = 1 << 19, 1_000_000
#: The pattern whose pieces `WordIds` finds by classes of characters.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_CLASSES = ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}"), (_OTHER, r"[^\s\p{L}\p{N}]"))
_HEAD = "<4sHHIQII"
_HEAD_SIZE = struct.calcsize(_HEAD)


class Frequencies:
    """Frequencies of symbols scaled to a sum of 2**SCALE; every symbol that was counted gets one at least."""

    def __init__(self, scaled: np.ndarray) -> None:
        self.freq = scaled.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(scaled), dtype=np.uint32), scaled.astype(np.int64))

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        total, whole = int(counts.sum()), 1 << SCALE
        if not total:
            return np.zeros(len(counts), np.int64)
        share = np.where(counts > 0, np.maximum(1, counts * (whole / total)).astype(np.int64), 0)
        over = int(share.sum()) - whole
        order = np.argsort(-share, kind="stable")
        if over < 0:
            share[order[0]] -= over
        for at in order:  # take the excess from the largest first, never below one
            if over <= 0:
                break
            cut = min(over, int(share[at]) - 1, max(1, int(share[at]) // 8))
            share[at] -= cut
            over -= cut
        return share


def encode_block(sizes: list[int], ids: np.ndarray, table_: Frequencies) -> bytes:
    """One block of the ids of documents of the given sizes."""
    n = len(ids)
    lanes = int(min(LANES, max(1, -(-n // STEPS))))
    steps = -(-n // lanes)
    states = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    moved = np.zeros(steps + 1, np.int64)
    marks: list[tuple[int, np.ndarray]] = []
    freq_of, start_of = table_.freq[ids], table_.start[ids]
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        freq, start, x = freq_of[a:b], start_of[a:b], states[: b - a]
        full = x >= freq << np.uint64(63 - SCALE)
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        moved[step + 1] = len(words[-1])
        x = np.where(full, x >> np.uint64(32), x)
        whole, rest = np.divmod(x, freq)
        states[: b - a] = (whole << np.uint64(SCALE)) + rest + start
        if step and step % CHECKPOINT == 0:
            marks.append((step, states.copy()))
    position = np.cumsum(moved)
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    body = [
        struct.pack(_HEAD, b"QRNS", 1, lanes, len(sizes), n, len(stream), len(marks)),
        np.array(sizes, "<u4").tobytes(),
        states.astype("<u8").tobytes(),
        *(struct.pack("<II", step, position[step]) + at.astype("<u8").tobytes() for step, at in marks[::-1]),
        stream.tobytes(),
    ]
    data = b"".join(body)
    return data + struct.pack("<I", zlib.crc32(data))


class Block:
    """A parsed block; `ids()` decodes all of it, `ids_from(step)` from a checkpoint on."""

    def __init__(self, data: bytes, table_: Frequencies) -> None:
        if len(data) < _HEAD_SIZE + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block: checksum differs")
        magic, version, self.lanes, docs, self.n, words, marks = struct.unpack_from(_HEAD, data)
        if magic != b"QRNS" or version != 1:
            raise ValueError("not a block of this format")
        self.table, at = table_, _HEAD_SIZE
        self.sizes = np.frombuffer(data, "<u4", docs, at)
        at += 4 * docs
        self.marks = {0: (0, np.frombuffer(data, "<u8", self.lanes, at))}
        at += 8 * self.lanes
        for _ in range(marks):
            step, position = struct.unpack_from("<II", data, at)
            self.marks[step] = (position, np.frombuffer(data, "<u8", self.lanes, at + 8))
            at += 8 + 8 * self.lanes
        self.words = np.frombuffer(data, "<u4", words, at)

    def ids_from(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of the steps first..last; `first` must be 0 or the step of a checkpoint."""
        position, states = self.marks[first]
        x = states.astype(np.uint64)
        lanes, mask = self.lanes, np.uint64((1 << SCALE) - 1)
        steps = -(-self.n // lanes)
        last = steps if last is None else min(last, steps)
        out = np.empty(max(0, min(self.n, last * lanes) - first * lanes), np.uint32)
        for step in range(first, last):
            a, b = step * lanes, min(self.n, (step + 1) * lanes)
            own = x[: b - a]
            slot = own & mask
            symbol = self.table.symbol[slot]
            out[a - first * lanes : b - first * lanes] = symbol
            own = self.table.freq[symbol] * (own >> np.uint64(SCALE)) + slot - self.table.start[symbol]
            empty = np.flatnonzero(own < LOW)
            own[empty] = own[empty] << np.uint64(32) | self.words[position : position + len(empty)]
            position += len(empty)
            x[: b - a] = own
        return out

    def ids(self) -> np.ndarray:
        return self.ids_from()


def _known(built: dict) -> bool:
    """Whether a tokenizer normalises, splits and cuts its added tokens as `WordIds` does."""
    normal = [n["type"] for n in (built["normalizer"] or {}).get("normalizers", [])]
    parts = (built["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = len(parts) == 2 and parts[0].get("pattern") == {"Regex": _PATTERN} and parts[1]["type"] == "ByteLevel" and not parts[1]["use_regex"]
    added = built["added_tokens"]
    bare = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(t["content"].split() != [t["content"]] for t in added)
    return normal == ["NFC", "Replace", "Lowercase"] and split and bare


class WordIds:
    """Ids of whole texts, each distinct piece encoded by the tokenizer once.

    The tokenizer normalises (NFC, lower case), splits by its own pattern and merges within pieces. Below U+0250 the
    normal form changes nothing but ASCII capitals matter less, so such texts are split by that pattern here; any
    other text is only split at ASCII white space, which the tokenizer drops and never looks across. Before all that the
    tokenizer cuts its added tokens, such as an end mark written out, from the text as it stands; so does `_runs`.
    Texts are split many at a time, by the classes of their bytes. A vocabulary of another pattern gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        built = json.loads(self.tokenizer.to_str())
        self.known = _known(built)
        self.added = sorted((t["content"] for t in built["added_tokens"]), key=len, reverse=True)
        self.cut_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split
        self.class_of = np.array([next(c for c, known in _CLASSES if regex.fullmatch(known, chr(code))) for code in range(0x250)], np.uint8)
        letters, digits, others = ("".join(re.escape(chr(c)) for c in np.flatnonzero(self.class_of == k) if c != 0x130) for k in (_LETTER, _DIGIT, _OTHER))
        self.single = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{digits}]|[{others}]+").fullmatch
        self.byte_class = bytes([*self.class_of[:128].tolist(), *[_WHOLE] * 128])
        # The tokenizer without its pattern: for many single pieces at once, with blanks between them.
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.normalizer = normalizers.Lowercase()
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = built["model"].get("end_of_word_suffix")
        self.last = np.array([bool(suffix) and (self.tokenizer.id_to_token(k) or "").endswith(suffix) for k in range(self.size)])
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, parts: list[bytes]) -> None:
        if len(self.memo) > MEMO_PIECES:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        absent = [part for part in parts if part not in memo]
        new = [part for part in absent if part not in older]
        memo.update((part, older[part]) for part in absent if part in older)
        for k in range(0, len(new), NEW_PIECES):
            self._encode(new[k : k + NEW_PIECES])

    def _encode(self, new: list[bytes]) -> None:
        memo, words = self.memo, b" ".join(new).decode().split(" ")  # no piece holds a blank
        fits = [self.single(word) is not None for word in words]
        single, keys = list(compress(words, fits)), list(compress(new, fits))
        rest, others = [list(compress(x, map(operator.not_, fits))) for x in (words, new)]
        rows = [" ".join(single[k : k + MERGED]) for k in range(0, len(single), MERGED)]
        some = (self.merger.encode_batch_fast(rows[k : k + MERGED], add_special_tokens=False) for k in range(0, len(rows), MERGED))
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array([i for e in made for i in e.ids], "<u4") for made in some)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(single):
            data, ends = ids.tobytes(), (4 * ends).tolist()
            memo.update(zip(keys, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        else:  # a vocabulary that does not mark the ends of words
            rest, others = words, new
        made = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else []
        memo.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(others, made, strict=True))

    def _runs(self, text: str) -> list[str]:
        """Runs of plain text at even places, added tokens at odd ones."""
        return self.cut_added(text) if any(token in text for token in self.added) else [text]

    def _pieces(self, runs: list[bytes], whole: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The pieces of all runs, and the number of pieces before each run and in all.

        Runs marked `whole`, or with characters beyond the classes, are split at ASCII white space only.
        """
        data = b"\n".join(runs) + b"\n\n"
        heads = np.concatenate([[0], np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)) + 1)])
        raw, low = np.frombuffer(data, np.uint8), np.frombuffer(bytearray(data.lower()), np.uint8)  # ASCII capitals only
        kind = np.frombuffer(bytearray(data.translate(self.byte_class)), np.uint8)
        lead = np.flatnonzero(raw >= 0xC2)
        if len(lead):
            code = np.where(raw[lead] < 0xE0, (raw[lead] & 31).astype(np.int64) << 6 | raw[lead + 1] & 63, 0x250)
            run = np.searchsorted(heads, lead, "right") - 1
            whole = whole.copy()
            whole[run[(code >= 0x250) | (code == 0x130)]] = True
            plain = ~whole[run]
            lead, code = lead[plain], code[plain]
            kind[lead] = kind[lead + 1] = self.class_of[code]
        if whole.any():
            own = np.repeat(np.append(whole, False), np.append(np.diff(heads), 1))
            low[own] = raw[own]
            kind[own & (kind != _SPACE)] = _WHOLE
        first = kind == _DIGIT
        first[0] = True
        first[1:] |= kind[1:] != kind[:-1]
        first[lead + 1] = False
        mark = np.flatnonzero(low == ord("'"))
        mark = mark[(kind[mark] == _OTHER) & first[mark]]  # such a quote may begin an ending: 's 't 'm 'd 're 've 'll
        one, two = low[mark + 1], low[mark + 1].astype(np.int64) << 8 | low[np.minimum(mark + 2, len(low) - 1)]
        short = np.isin(one, list(b"stmd"))
        for own, size in ((mark[short], 2), (mark[~short & np.isin(two, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])], 3)):
            first[own + 1] = False
            first[own + size] = True
        kept = kind != _SPACE
        text, starts = low[kept], np.flatnonzero(first[kept])
        before = np.searchsorted(np.flatnonzero(first & kept), heads)
        offsets = np.append(starts, len(text)).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text)]), before

    def of(self, texts: list[str], end: int) -> Iterator[bytes]:
        """The ids of every text with the end id, as little-endian unsigned 32-bit integers."""
        tail = end.to_bytes(4, "little")
        if not self.known:
            yield from (np.array(e.ids, "<u4").tobytes() + tail for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
            return
        held: list[tuple[pa.LargeBinaryArray, np.ndarray, list[int]]] = []
        block: list[list[str]] = []
        count = chars = 0
        for n, text in enumerate(texts):
            block.append(self._runs(text))
            chars += len(text)
            ended = n + 1 == len(texts)
            if chars >= BLOCK_CHARS or ended:
                whole = np.array([k % 2 == 1 for runs in block for k in range(len(runs))])
                held.append((*self._pieces([run.encode() for runs in block for run in runs], whole), list(map(len, block))))
                count, block, chars = count + len(held[-1][0]), [], 0
            if held and (count >= CHUNK_PIECES or ended):
                yield from self._coded(held, tail)
                held, count = [], 0

    def _coded(self, held: list[tuple[pa.LargeBinaryArray, np.ndarray, list[int]]], tail: bytes) -> Iterator[bytes]:
        coded = pa.concat_arrays([pieces for pieces, _, _ in held]).dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(parts)
        ids = pa.array(map(self.memo.__getitem__, parts), pa.large_binary(), size=len(parts)).take(coded.indices)
        _, offsets, data = ids.buffers()
        offsets, data = np.frombuffer(offsets, np.int64) if len(ids) else np.zeros(1, np.int64), memoryview(data or b"")
        first = 0
        for pieces, before, sizes in held:
            places = offsets[first + before[np.cumsum([0, *sizes])]].tolist()
            first += len(pieces)
            for a, b in zip(places, places[1:], strict=False):
                yield bytes(data[a:b]) + tail


def _words(path: str) -> WordIds:
    return worker_state(f"word_ids:{path}", lambda: WordIds(path))


def frequencies(blocks: DataFrame) -> DataFrame:
    """(symbol, count) of the ids of all raw blocks, counted by partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                own = np.bincount(_unpacked(data.as_py()))
                if len(own) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(own) - len(counts), np.int64)])
                counts[: len(own)] += own
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["symbol", "count"])

    made = blocks.select("ids").mapInArrow(run, "symbol bigint, count bigint")
    return made.groupBy("symbol").agg(F.sum("count").alias("count"))


def _packed(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit, else in four; the first byte says which."""
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" if narrow else b"\4") + ids.astype("<u2" if narrow else "<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1)


def _loaded(spark: SparkSession, folder: str) -> np.ndarray:
    """The shared table of a written folder: one entry per symbol of the vocabulary."""
    rows = spark.read.parquet(f"{folder}/table").collect()
    out = np.zeros(max((r["symbol"] for r in rows), default=0) + 1, np.int64)
    for row in rows:
        out[row["symbol"]] = row["freq"]
    return out


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, end: int = END_ID) -> None:
    """Encode whole texts and write `table` (symbol, freq) and `blocks` below the folder, in ascending key order.

    Documents are range partitioned by (key, checksum of the text); nulls come first, equal keys keep together. Each
    partition cuts its documents into blocks in order, with the position of a block in its partition and of its first
    id. Texts are encoded once: the ids wait in the folder `ids` while the shared table is counted.
    """
    spark = docs.sparkSession
    own = text_or_empty(text)
    rows = docs.select(F.col(key).alias("key"), own.alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        keys: list[pa.Array] = []
        held: list[bytes] = []
        count = 0

        def block() -> pa.RecordBatch:
            own_keys = pa.concat_arrays(keys)
            lists = pa.ListArray.from_arrays(pa.array([0, len(own_keys)], pa.int32()), own_keys)
            ids = pa.array([_packed(np.frombuffer(b"".join(held), "<u4"))], pa.binary())
            sizes = pa.array([[len(i) // 4 for i in held]], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([count], pa.int64()), lists, sizes, ids],
                names=["part", "seq", "first", "n_ids", "keys", "sizes", "ids"],
            )

        for batch in batches:
            column = batch.column("key")
            for n, ids in enumerate(words.of(batch.column("text").to_pylist(), end)):
                held.append(ids)
                keys.append(column.slice(n, 1))
                count += len(ids) // 4
                if count >= BLOCK_IDS:
                    yield block()
                    seq, first, keys, held, count = seq + 1, first + count, [], [], 0
        if held:
            yield block()

    place = f"part int, seq int, first bigint, n_ids bigint, keys array<{kind}>"
    ordered = rows.withColumn("crc", F.crc32("text")).repartitionByRange("key", "crc").sortWithinPartitions("key", "crc")
    raw = ordered.select("key", "text").mapInArrow(run, f"{place}, sizes array<int>, ids binary")
    raw.write.option("compression", "zstd").parquet(f"{folder}/ids")
    raw = spark.read.parquet(f"{folder}/ids")

    counted = frequencies(raw).collect()  # one row per symbol of the vocabulary at most
    counts = np.zeros(max((r["symbol"] for r in counted), default=0) + 1, np.int64)
    for row in counted:
        counts[row["symbol"]] = row["count"]
    scaled = Frequencies.scaled(counts)
    pairs = [(int(s), int(scaled[s])) for s in np.flatnonzero(scaled)]
    spark.createDataFrame(pairs, "symbol bigint, freq bigint").coalesce(1).write.parquet(f"{folder}/table")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = Frequencies(scaled)
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1)
                data = encode_block(one.column("sizes")[0].as_py(), _unpacked(one.column("ids")[0].as_py()), table_)
                columns = [one.column(k) for k in ("part", "seq", "first", "n_ids", "keys")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([data], pa.binary())], names=["part", "seq", "first", "n_ids", "keys", "block"])

    raw.mapInArrow(pack, f"{place}, block binary").write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document of a written folder, decoded from its blocks."""
    scaled = _loaded(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = dict(blocks.dtypes)["keys"].removeprefix("array<")[:-1]
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # one row per written partition
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(order) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = Frequencies(scaled)
        for batch in batches:
            for n in range(batch.num_rows):
                block = Block(batch.column("block")[n].as_py(), table_)
                ids = block.ids().astype("<u4")
                ends = np.cumsum(block.sizes, dtype=np.int64)
                starts = ends - block.sizes
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys")[n].values, pa.array(np.full(len(ends), batch.column("part")[n].as_py()), pa.int32()), pa.array(starts + batch.column("first")[n].as_py()), pa.array(block.sizes.astype(np.int64)), pa.array(crcs, pa.int64())],
                    names=["key", "part", "within", "n_tokens", "ids_crc32"],
                )

    read_back = blocks.mapInArrow(run, f"key {kind}, part int, within bigint, n_tokens bigint, ids_crc32 bigint")
    return read_back.join(F.broadcast(parts), "part").select(
        F.col("key").alias(key), (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Null and empty texts have the end id alone; documents of equal keys are ordered by the checksum of their text."""
    out = shared_folder(spark, "rans")
    write(table(spark, folder, "documents"), out)
    return read(spark, out)

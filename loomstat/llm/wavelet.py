"""Token-id output as one wavelet matrix per shard.

Documents are tokenised, ended with an end id and packed, in ascending ``doc_id``
order, into shards of about ``SHARD_IDS`` ids.  A shard is one compressed blob: a
wavelet matrix of its ids (bit-planes, most significant first; in each plane the
sequence is stably split by the bit) with the documents' ids and lengths.  From the
blob alone one can read a token, count a token in a range and look its places up,
by rank and select on the planes.

Blobs are rows of a Parquet dataset in the shared folder (``shard``, ``n_tokens``,
``n_docs``, ``blob``), so any store Spark writes to will do, and a lost task is
simply run again.  ``shard`` is partition << 32 | number in the partition, in
document order.

Edge cases: null text is empty and still gets its end id; a null ``doc_id`` sorts
first; rows that share an id stand in order of a hash of the text, then the text,
so a repeated id may spread over tasks; a text longer than a shard is a shard of
its own; an empty table gives no shards; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.llm.common import fresh_folder, table
from loomstat.llm.kernels import process_store, steps, tidy, utf8

END_ID = 2
SHARD_IDS = 1 << 19
ENCODE_BYTES = 1 << 20
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
_MAGIC = b"WVM1"


class WaveletMatrix:
    """Rank/select structure over ids: ``planes`` (packed bits) and ``zeros`` (zero bits of each plane)."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]) -> None:
        self.n, self.planes, self.zeros = n, planes, zeros
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        x = ids.astype(np.uint16 if len(ids) == 0 or ids.max() < 1 << 16 else np.uint32)
        bits = max(1, int(x.max()).bit_length()) if len(x) else 1
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (x & x.dtype.type(1 << b)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            y, z = np.empty_like(x), len(x) - int(np.count_nonzero(one))
            y[z:] = x[one]
            np.logical_not(one, out=one)
            y[:z] = x[one]
            zeros.append(z)
            x = y
        return cls(len(ids), planes, zeros)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(np.bool_)

    def decode(self) -> np.ndarray:
        """All ids: the splits are undone from the last plane up."""
        x = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            one, z = self._bits(level), self.zeros[level]
            y = np.empty_like(x)
            y[~one] = x[:z]
            y[one] = x[z:] | x.dtype.type(1 << (len(self.planes) - 1 - level))
            x = y
        return x

    def _rank1(self, level: int, at: int) -> int:
        """Ones of a plane before ``at``: a count per 512 bits and the bytes after it."""
        if self._ranks is None:
            self._ranks = []
            for p in self.planes:
                ones = np.bitwise_count(np.pad(p, (0, -len(p) % 64))).reshape(-1, 64).sum(1, dtype=np.int64)
                self._ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        block, plane = at >> 9, self.planes[level]
        rest = plane[block << 6: at >> 3]
        last = int(plane[at >> 3]) & ((1 << (at & 7)) - 1) if at & 7 else 0
        return int(self._ranks[level][block]) + int(np.bitwise_count(rest).sum()) + last.bit_count()

    def access(self, at: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            one = self.planes[level][at >> 3] >> (at & 7) & 1
            r = self._rank1(level, at)
            at = self.zeros[level] + r if one else at - r
            value = value << 1 | int(one)
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        hi = self.n if hi is None else min(hi, self.n)
        a, b = self._range(token, min(lo, hi), hi)
        return b - a

    def _select_bit(self, level: int, one: bool, k: int) -> int:
        """Place of the k-th (from 0) one or zero of a plane, by bisection on rank."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            r = self._rank1(level, mid + 1)
            if (r if one else mid + 1 - r) <= k:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token; -1 if there is none."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        at = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = bool(token >> (len(self.planes) - 1 - level) & 1)
            at = self._select_bit(level, one, at - self.zeros[level] if one else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The blob of a shard."""
    wm = WaveletMatrix.build(ids)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([0 if x is None else x for x in doc_ids], "<i8")
    head = _MAGIC + struct.pack("<QQB", wm.n, len(doc_ids), len(wm.planes))
    body = [np.array(wm.zeros, "<u8"), known, names, lengths.astype("<u8"), *wm.planes]
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in body))


def unpack(blob: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """(wavelet matrix, doc ids, lengths) of a blob."""
    if blob[:4] != _MAGIC:
        raise ValueError("not a wavelet shard")
    n, docs, bits = struct.unpack_from("<QQB", blob, 4)
    body, at = zstandard.ZstdDecompressor().decompress(blob[4 + 17:]), 0

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    zeros = [int(z) for z in take(bits, "<u8")]
    known, names, lengths = take(docs, "u1"), take(docs, "<i8"), take(docs, "<u8")
    planes = [take((n + 7) // 8, "u1") for _ in range(bits)]
    return WaveletMatrix(n, planes, zeros), [int(x) if k else None for x, k in zip(names, known)], lengths


class ChunkTable:
    """Ids of remembered chunks, found by two 64-bit hashes through open addressing in numpy arrays."""

    ENTRIES, SLOTS = 1_500_000, 1 << 21

    def __init__(self) -> None:
        self.key = np.zeros((2, self.ENTRIES), np.uint64)
        self.start, self.size = np.zeros(self.ENTRIES, np.int32), np.zeros(self.ENTRIES, np.int32)
        self.letters = np.zeros(self.ENTRIES, np.bool_)
        self.clear()

    def clear(self) -> None:
        """Forget everything but entry 0, the empty chunk."""
        self.slots = np.full(self.SLOTS, -1, np.int32)
        self.flat, self.used, self.n = np.zeros(1 << 20, np.uint32), 0, 1

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.SLOTS.bit_length() + 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash pair (2 x n), or -1."""
        out = np.full(h.shape[1], -1, np.int64)
        slot, todo = self._slot(h[0]), np.arange(h.shape[1])
        while len(todo):
            e = self.slots[slot]
            same = (e >= 0) & (self.key[0, e] == h[0, todo]) & (self.key[1, e] == h[1, todo])
            out[todo[same]] = e[same]
            on = (e >= 0) & ~same
            todo, slot = todo[on], (slot[on] + 1) & (self.SLOTS - 1)
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray, letters: bool) -> None:
        """Add distinct new hash pairs whose ids stand one after the other in ``ids``."""
        k, lo = h.shape[1], self.n
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) // 2, np.uint32)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.key[:, lo:lo + k] = h
        self.start[lo:lo + k] = self.used + np.cumsum(size) - size
        self.size[lo:lo + k], self.letters[lo:lo + k] = size, letters
        self.used, self.n = self.used + len(ids), lo + k
        entry, slot = np.arange(lo, lo + k, dtype=np.int32), self._slot(h[0])
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            on = self.slots[slot] != entry
            entry, slot = entry[on], (slot[on] + 1) & (self.SLOTS - 1)

    def gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the entries in a row, their ends)."""
        size = self.size[entry].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[entry] - ends + size, size) + np.arange(total)], ends


class WordEncoder:
    """Ids of whole texts through the ids of their blank-separated chunks.

    The tokenizer splits at white space before anything else can join, so a text's
    ids are those of its chunks in order.  A chunk is encoded once and remembered (in
    a table of bounded size that is emptied when full).  Letters with a comma or full
    stop behind them are two words to the tokenizer, and a capital A-Z is the small
    letter to it, so such a chunk takes the ids of its letters.  Letters are encoded
    many words at a time and cut at the ids that end a word.
    """

    PIECE, TOGETHER, LONGEST, AT_ONCE = 50_000, 400, 256, 10_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(pieces.values()) + 1, np.bool_)
        self.ends[[i for t, i in pieces.items() if t.endswith("</w>")]] = True
        self.tails = {ord(c): np.array(self._ids([c])[0], np.uint32) for c in ",."}
        rng = np.random.default_rng(9)
        self.factor = rng.integers(0, 1 << 64, (2, self.LONGEST), np.uint64) | np.uint64(1)
        self.table = ChunkTable()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _hashes(self, b: np.ndarray, raw: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Two hashes of each chunk; a chunk ends one byte before the next one's start."""
        lo, hi = start[0], start[-1] + length[-1] + 1
        value = b[lo:hi].astype(np.uint64) + np.uint64(1)
        value[start + length - lo] = 0
        offset = np.minimum(np.arange(lo, hi) - np.repeat(start, length + 1), self.LONGEST - 1)
        h = np.stack([np.add.reduceat(value * f[offset], start - lo) for f in self.factor])
        for i in np.flatnonzero(length > self.LONGEST):
            d = xxhash.xxh3_128_intdigest(raw[start[i]:start[i] + length[i]])
            h[:, i] = d >> 64, d & (1 << 64) - 1
        return h

    def _add_whole(self, h: np.ndarray, chunks: list[str]) -> None:
        for lo in range(0, len(chunks), self.AT_ONCE):
            ids = self._ids(chunks[lo:lo + self.AT_ONCE])
            self.table.add(h[:, lo:lo + self.AT_ONCE], np.array(list(chain.from_iterable(ids)), np.uint32),
                           np.fromiter(map(len, ids), np.int64, len(ids)), False)

    def _add_letters(self, h: np.ndarray, words: list[str]) -> None:
        """Words of letters only: each ends with exactly one id that ends a word."""
        lots = [words[i:i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        take, ids, size = [], [], []
        some = self.AT_ONCE // self.TOGETHER  # the library's results take far more room than the ids
        found_lots = (x for i in range(0, len(lots), some) for x in self._ids([" ".join(lot) for lot in lots[i:i + some]]))
        for k, (lot, found) in enumerate(zip(lots, found_lots)):
            found = np.array(found, np.uint32)
            last = np.flatnonzero(self.ends[found])
            mine = np.arange(k * self.TOGETHER, k * self.TOGETHER + len(lot))
            if len(last) == len(lot) and last[-1] == len(found) - 1:
                take.append(mine)
                ids.append(found)
                size.append(np.diff(last, prepend=-1))
            else:  # a letter that the tokenizer does not take for one
                self._add_whole(h[:, mine], lot)
        if take:
            self.table.add(h[:, np.concatenate(take)], np.concatenate(ids), np.concatenate(size), True)

    def _learn(self, b: np.ndarray, raw: bytes, start: np.ndarray, length: np.ndarray, h: np.ndarray) -> None:
        """Remember distinct new chunks."""
        table, short = self.table, (length > 0) & (length <= self.LONGEST)
        last = b[start + length - 1]
        tail = short & np.isin(last, list(self.tails))
        first, body = b[start], length - tail
        cap = short & (body > 0) & (first >= 65) & (first <= 90)
        end = np.where(tail, length - 1, 0)
        core = h.copy()
        for k in (0, 1):
            core[k] -= np.where(tail, self.factor[k, end] * (last.astype(np.uint64) + np.uint64(1)), np.uint64(0))
            core[k] += np.where(cap, self.factor[k, :1] * np.uint64(32), np.uint64(0))
        known = table.find(core)
        wanted = np.flatnonzero((known < 0) & short & (body > 0))
        wanted = wanted[np.unique(core[0, wanted], return_index=True)[1]]
        words = [raw[s:s + n] for s, n in zip(start[wanted].tolist(), body[wanted].tolist())]
        words = b" ".join(words).decode().split(" ") if words else []
        words = [w[0].lower() + w[1:] if c else w for w, c in zip(words, cap[wanted].tolist())]
        alpha = np.fromiter(map(str.isalpha, words), np.bool_, len(words))
        self._add_letters(core[:, wanted[alpha]], [w for w, x in zip(words, alpha.tolist()) if x])
        known = table.find(core)
        letters = (known >= 0) & table.letters[known]
        for mark in (0, *self.tails):
            mine = np.flatnonzero(letters & (tail & (last == mark) if mark else cap & ~tail))
            if len(mine):
                ids, ends = table.gather(known[mine])
                extra = self.tails[mark] if mark else np.zeros(0, np.uint32)
                ids = np.insert(ids, np.repeat(ends, len(extra)), np.tile(extra, len(mine)))
                table.add(h[:, mine], ids, table.size[known[mine]] + len(extra), False)
        rest = np.flatnonzero(table.find(h) < 0)
        self._add_whole(h[:, rest], [raw[s:s + n].decode() for s, n in zip(start[rest].tolist(), length[rest].tolist())])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        raw = b"\n".join(texts) + b"\n"
        b = np.frombuffer(raw, np.uint8)
        stop = np.flatnonzero((b == 32) | (b == 10))
        start = np.concatenate([[0], stop[:-1] + 1])
        found, sizes, table = [], [], self.table
        for lo in range(0, len(stop), self.PIECE):
            s, n = start[lo:lo + self.PIECE], stop[lo:lo + self.PIECE] - start[lo:lo + self.PIECE]
            h = self._hashes(b, raw, s, n)
            entry = np.where(n > 0, table.find(h), 0)
            new = np.flatnonzero(entry < 0)
            if len(new):
                if table.n + 2 * len(new) > table.ENTRIES:
                    table.clear()
                    new = np.flatnonzero(n > 0)
                while len(new):  # chunks that share one of the two hashes are learned one after another
                    once = new[np.unique(h[0, new], return_index=True)[1]]
                    self._learn(b, raw, s[once], n[once], h[:, once])
                    entry[new] = table.find(h[:, new])
                    new = new[entry[new] < 0]
            ids, ends = table.gather(entry)
            found.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        edge = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        last = np.searchsorted(stop, np.cumsum([len(t) + 1 for t in texts]) - 1, "right")
        return np.concatenate(found), np.diff(edge[np.concatenate([[0], last])])


# What a tokenizer file must say for ``WordEncoder`` to be right.
_CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None}
_CHUNKED_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
                  "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}


class PlainEncoder:
    """Ids of whole texts by the library itself, for any tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.array(list(chain.from_iterable(ids)), np.uint32), np.array([len(x) for x in ids], np.int64)


def is_chunked(path: str) -> bool:
    """Whether a tokenizer file describes the splitting that ``WordEncoder`` relies on."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model = told.get("model", {})
    return all(told.get(k) == v for k, v in _CHUNKED.items()) and all(model.get(k) == v for k, v in _CHUNKED_MODEL.items())


def _encoder(path: str) -> WordEncoder | PlainEncoder:
    """The encoder for a tokenizer file: through remembered chunks where the file allows it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread of the library keeps memory of its own
    store = process_store("word_encoders")
    if path not in store:
        store[path] = WordEncoder(path) if is_chunked(path) else PlainEncoder(path)
    return store[path]


def _ended(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the end id behind each document."""
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


def _pack_task(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = _encoder(path), TaskContext.get().partitionId(), 0
        held_ids, held_docs, held_sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held_ids, held_docs, held_sizes, held, number
            ids, sizes = np.concatenate(held_ids), np.array(held_sizes, np.int64)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([len(sizes)], pa.int64()), pa.array([pack(ids, held_docs, sizes)], pa.binary())],
                names=["shard", "n_tokens", "n_docs", "blob"])
            held_ids, held_docs, held_sizes, held, number = [], [], [], 0, number + 1
            return out

        for batch in batches:
            texts, docs = utf8(batch.column(1)), batch.column(0).cast(pa.int64()).to_pylist()
            for lo, hi in steps(texts, ENCODE_BYTES):
                ids, sizes = _ended(*encoder.encode(texts[lo:hi]), end_id)
                edge = np.concatenate([[0], np.cumsum(sizes)])
                first = 0
                for i in range(hi - lo):
                    # A shard closes when the next document would overfill it.
                    if held + sizes[i] > shard_ids and held:
                        held_ids.append(ids[edge[first]:edge[i]])
                        yield flush()
                        first = i
                    held += int(sizes[i])
                    held_docs.append(docs[lo + i])
                    held_sizes.append(int(sizes[i]))
                held_ids.append(ids[edge[first]:])
        if held:
            yield flush()
    return run


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            wm, docs, lengths = unpack(blob.as_py())
            ids = wm.decode().astype("<u4")
            edge = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(docs), pa.int64()), pa.array(docs, pa.int64()),
                 pa.array(edge[:-1], pa.int64()), pa.array(np.diff(edge), pa.int64()), pa.array(crc, pa.int64())],
                names=["shard", "doc_id", "offset", "n_tokens", "ids_crc32"])


def write_shards(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 shard_ids: int = SHARD_IDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards of ``docs`` to the folder ``path`` and return them as read back."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    shards = rows.select("doc_id", "text").mapInArrow(tidy(_pack_task(tokenizer, end_id, shard_ids), keep="word_encoders"),
                                                      "shard long, n_tokens long, n_docs long, blob binary")
    shards.write.parquet(path)
    return docs.sparkSession.read.schema(shards.schema).parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards alone."""
    # Starts in two steps: partitions first (one row each), then shards within a partition.
    sizes = shards.select("shard", F.shiftright("shard", 32).alias("part"), "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("in_part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("shard", (F.col("part_start") + F.col("in_part")).alias("shard_start"))
    docs = shards.select("shard", "blob").mapInArrow(
        tidy(_read_task, keep="word_encoders"), "shard long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return docs.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"),
                                             "n_tokens", "ids_crc32")


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of ``documents`` as wavelet shards and describe each document from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_shards(write_shards(docs, fresh_folder(spark, "shards")))

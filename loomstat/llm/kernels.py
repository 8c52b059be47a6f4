"""Small numpy helpers for the operators whose tasks work on Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that one step of a kernel holds at once (a longer single text is one step).
STEP_BYTES = 2 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8 bytes; null is empty."""
    binary = column.cast(pa.large_string()).cast(pa.large_binary())
    return [x or b"" for x in binary.to_pylist()]


def process_store(name: str) -> dict:
    """A dict that the Python worker process keeps from task to task, until a task that does not use it begins."""
    home = sys.modules.setdefault("_loomstat_process_store", types.ModuleType("_loomstat_process_store"))
    return home.__dict__.setdefault(name, {})


def tidy(task: Callable, keep: str | None = None) -> Callable:
    """A task that gives freed memory back to the system: Python workers live on between tasks.

    What earlier tasks left in process stores is dropped first, except the store named ``keep``, which this task uses."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = sys.modules.get("_loomstat_process_store")
        for name, store in list(vars(home).items()) if home else []:
            if isinstance(store, dict) and name != keep and not name.startswith("__"):
                store.clear()
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
    return run


def steps(texts: list[bytes], size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about ``size`` bytes each."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when full, so memory is bounded."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_PLACES = [int(x) | 1 for x in mix64(np.arange(1, 33, dtype=np.uint64) * MIX)]


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-word windows of a sequence of word hashes (none if it is shorter)."""
    if len(h) < n:
        return h[:0].copy()
    out = h[: len(h) - n + 1] * np.uint64(_PLACES[0])
    for i in range(1, n):
        out += h[i: len(h) - n + 1 + i] * np.uint64(_PLACES[i])
    return mix64(out)

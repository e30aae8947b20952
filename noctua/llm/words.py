"""Hashes of the words of many texts at once, with numpy.

Texts lie one after the other in a buffer; a polynomial in the ring of 64-bit integers, summed up once, gives the hash
of any run of bytes, so that words, prefixes and shingles cost a few array operations a batch. A text longer than
CHUNK_BYTES is a chunk of its own, whose arrays take about 40 bytes a byte of it and are let go with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
CHUNK_BYTES = 1 << 18
BATCH_ROWS = 256

_held: dict[str, Any] = {"stage": None, "cache": None}


def stage_caches(cache=None) -> None:
    """Called at the beginning of a task: a worker that goes on to another stage lets go what the one before learnt."""
    from pyspark import TaskContext

    context = TaskContext.get()
    stage = context.stageId() if context else None
    if _held["cache"] is not None and (_held["stage"] != stage or _held["cache"] is not cache):
        _held["cache"].forget()
        _held["cache"] = None
    if cache is not None:
        _held.update(stage=stage, cache=cache)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a task holds few texts more than once."""
    stage_caches()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    h = h ^ np.uint64(salt & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n at least; kept for chunks of the usual size only."""
    return usual_powers() if n <= 2 * CHUNK_BYTES else all_powers(n)


@cache
def usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return all_powers(2 * CHUNK_BYTES)


def all_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n + 1, BASE), np.full(n + 1, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hashed:
    """The words of a chunk: begin and end of each in the buffer; hash(begin, end) of any places."""

    def __init__(self, raws: list[bytes], inside: np.ndarray):
        """inside: for each byte value, whether it belongs to words. A zero byte parts the texts."""
        lengths = np.array([len(r) + 1 for r in raws], np.int64)
        raw = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
        self.size = len(raw)
        self.texts = np.concatenate([[0], np.cumsum(lengths)])
        mask = np.empty(len(raw) + 2, np.int8)
        mask[0] = mask[-1] = 0
        mask[1:-1] = inside[raw]
        edge = np.diff(mask)
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, self.down = powers(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])
        #: the first word of each text, and one past the last
        self.first = np.searchsorted(self.begin, self.texts)

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])


def chunks(raws: list[bytes], limit: int = CHUNK_BYTES):
    """(first, last) of runs of texts of about `limit` bytes; a longer text is a run of its own."""
    first = held = 0
    for i, raw in enumerate(raws):
        if held and held + len(raw) > limit:
            yield first, i
            first, held = i, 0
        held += len(raw) + 1
    if first < len(raws):
        yield first, len(raws)


def byte_table(others: bytes) -> np.ndarray:
    """True but for the bytes given and zero."""
    out = np.ones(256, bool)
    out[list(others)] = False
    out[0] = False
    return out


#: words parted by ASCII white space; a zero byte, where a text has one, must be replaced before
NOT_SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
LETTERS = byte_table(bytes(b for b in range(128) if not chr(b).isalpha()))

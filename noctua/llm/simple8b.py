"""Simple-8b: word-aligned coding of whole numbers below 2**64.

A stream: magic, number of values n (uint64), then an offset (uint32, in words) for each block of BLOCK values and one
past the end, the number of escapes up to each block likewise, the escaped values (uint64), the words (uint64). A
word's upper 4 bits select how many values of how many bits it packs. A value of 2**60 - 1 or more is an escape: the
word of one value holds 2**60 - 1 and the value itself stands in the list of escapes. Slots past the end of a block
are zero. Blocks decode alone or all at once.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"NS8B"
BLOCK = 1024
#: Selector, values a word, bits a value.
SELECTORS = [(1, 60, 1), (2, 30, 2), (3, 20, 3), (4, 15, 4), (5, 12, 5), (6, 10, 6), (7, 8, 7), (8, 7, 8), (9, 6, 10), (10, 5, 12), (11, 4, 15), (12, 3, 20), (13, 2, 30), (14, 1, 60)]
ESCAPE = (1 << 60) - 1


NARROW = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    if not values.size or values.max() < len(NARROW):
        return NARROW[values.astype(np.uint16)]
    out, left = np.zeros(values.shape, np.uint8), values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = left >= np.uint64(1 << step)
        out[big] += step
        left[big] >>= np.uint64(step)
    return out + (left > 0)


def encode(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    escaped = values >= ESCAPE
    escapes = values[escaped]
    padded = np.zeros((blocks, BLOCK + 60), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = np.where(escaped, np.uint64(ESCAPE), values)
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = widths(padded)

    fits = np.full((blocks, BLOCK), 14, np.uint8)  # the selector that takes most values from each place
    highest, reach, best = bits[:, :BLOCK].copy(), 1, {1: 14}
    for selector, count, size in reversed(SELECTORS[:-1]):
        while reach < count:
            np.maximum(highest, bits[:, reach : reach + BLOCK], out=highest)
            reach += 1
        fit = highest <= size
        if not fit.any():
            if size <= 8:
                break
            continue
        fits[fit] = selector
    counts = np.zeros(16, np.int64)
    for selector, count, _ in SELECTORS:
        counts[selector] = count
    ends = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    at, starts, steps = np.zeros(blocks, np.int64), [], counts[fits]
    lanes = np.arange(blocks)
    while len(lanes):
        starts.append(lanes * BLOCK + at[lanes])
        at[lanes] += steps[lanes, at[lanes]]
        lanes = lanes[at[lanes] < ends[lanes]]
    places = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    chosen = fits.reshape(-1)[places] if blocks else np.zeros(0, np.uint8)
    source = padded.reshape(-1)
    origin = places // BLOCK * (BLOCK + 60) + places % BLOCK
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, count, size in SELECTORS:
        mine = np.flatnonzero(chosen == selector)
        for j in range(count if len(mine) else 0):
            words[mine] |= source[origin[mine] + j] << np.uint64(j * size)
    edges = BLOCK * np.arange(blocks + 1)
    offsets = np.searchsorted(places, edges).astype("<u4")
    marks = np.searchsorted(np.flatnonzero(escaped), edges).astype("<u4")
    return MAGIC + b"\0" * 4 + np.array([n], "<u8").tobytes() + offsets.tobytes() + marks.tobytes() + escapes.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def decode(raw: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks first up to last (all)."""
    assert raw[:4] == MAGIC, "not a Simple-8b stream"
    n = int(np.frombuffer(raw, "<u8", 1, 8)[0])
    blocks = -(-n // BLOCK)
    last = blocks if last is None else min(last, blocks)
    offsets = np.frombuffer(raw, "<u4", blocks + 1, 16).astype(np.int64)
    marks = np.frombuffer(raw, "<u4", blocks + 1, 16 + 4 * (blocks + 1)).astype(np.int64)
    base = 16 + 8 * (blocks + 1)
    escapes = np.frombuffer(raw, "<u8", int(marks[-1]), base)
    words = np.frombuffer(raw, "<u8", int(offsets[last] - offsets[first]), base + 8 * int(marks[-1]) + 8 * int(offsets[first]))
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.zeros(16, np.int64)
    for selector, count, _ in SELECTORS:
        counts[selector] = count
    each = counts[chosen]
    run = np.cumsum(each) - each
    heads = offsets[first:last] - offsets[first]
    block = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
    place = run - run[heads][block] if len(words) else run
    out = np.zeros((last - first, BLOCK + 60), np.uint64)
    target = out.reshape(-1)
    origin = block * (BLOCK + 60) + place
    marked = []
    for selector, count, size in SELECTORS:
        mine = np.flatnonzero(chosen == selector)
        mask = np.uint64((1 << size) - 1)
        w = words[mine]
        for j in range(count if len(mine) else 0):
            target[origin[mine] + j] = (w >> np.uint64(j * size)) & mask
        if selector == 14 and len(mine):
            marked = origin[mine][(w & mask) == ESCAPE]
    if len(marked):
        target[np.sort(marked)] = escapes[marks[first] : marks[last]]
    return out[:, :BLOCK].reshape(-1)[: min(n, last * BLOCK) - first * BLOCK]

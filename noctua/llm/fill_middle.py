"""Fill-in-middle transformation on ropes: texts are cut at two unit ranks, rearranged with sentinels, and rebuilt.

A text's units are runs of white space with the word that follows, and white space at the end. A rope's leaves are
slices of the text's UTF-8 bytes, each of whole units, with their counts of units and code points; inner nodes hold the
sums, so that a rope is split at a unit rank, or at a code point, on one path from the root and within one leaf, and
joined by a new root. No bytes are copied before the result is written out.

Prefix, middle and suffix are parted at two seeded ranks. `psm` writes <P>prefix<S>suffix<M>middle, `spm`
<S>suffix<P>prefix<M>middle, and `plain` leaves the text as it is. The seed of a document is the SHA-256 of "42:" and its
doc_id in decimal, so that reruns agree and no row depends on another: there is no shuffle. `inverted` rebuilds the text
from output and form alone.

Null and empty texts, and texts that hold a sentinel, are plain; n of an empty text is 0. A null doc_id is seeded by "42:"
alone. Repeated rows give repeated rows, each by its own doc_id and text; there are no ties. An empty table gives an
empty result. Columns of docs may have any names. A text of any length is one rope; its leaves take LEAF_UNITS units,
however long a unit is, and its byte masks about ten bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.llm.shared import column_types, free_name
from noctua.llm.words import NOT_SPACE, slices

LEAF_UNITS = 256
SENTINELS = P, S, M = b"<P>", b"<S>", b"<M>"
WORD = NOT_SPACE.copy()
WORD[0] = True


def unit_starts(raw: np.ndarray) -> np.ndarray:
    """Where units begin: at the first byte, and where white space follows a word."""
    word = WORD[raw]
    return np.concatenate([np.zeros(min(1, len(raw)), np.int64), np.flatnonzero(word[:-1] & ~word[1:]) + 1])


def code_points(raw: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (raw & 0xC0) != 0x80


@dataclass(frozen=True, slots=True)
class Leaf:
    raw: np.ndarray
    units: int
    chars: int
    depth: int = 0

    def pieces(self) -> Iterator[np.ndarray]:
        yield self.raw

    def split(self, measure: str, rank: int) -> tuple[Rope, Rope]:
        """Before the unit or code point of that rank."""
        if rank <= 0:
            return None, self
        if rank >= getattr(self, measure):
            return self, None
        at = unit_starts(self.raw)[rank] if measure == "units" else np.flatnonzero(code_points(self.raw))[rank]
        left, right = self.raw[:at], self.raw[at:]
        chars = rank if measure == "chars" else int(code_points(left).sum())
        # a leaf that is parted within a unit counts it on the left
        units = rank if measure == "units" else min(self.units, len(unit_starts(left)))
        return Leaf(left, units, chars), Leaf(right, self.units - units, self.chars - chars)


@dataclass(frozen=True, slots=True)
class Node:
    left: Leaf | Node
    right: Leaf | Node
    units: int
    chars: int
    depth: int

    def pieces(self) -> Iterator[np.ndarray]:
        yield from self.left.pieces()
        yield from self.right.pieces()

    def split(self, measure: str, rank: int) -> tuple[Rope, Rope]:
        mine = getattr(self.left, measure)
        if rank == mine:
            return self.left, self.right
        if rank < mine:
            a, b = self.left.split(measure, rank)
            return a, concatenated(b, self.right)
        a, b = self.right.split(measure, rank - mine)
        return concatenated(self.left, a), b


Rope = Leaf | Node | None


def concatenated(*ropes: Rope) -> Rope:
    out = None
    for r in ropes:
        if r is not None:
            out = r if out is None else Node(out, r, out.units + r.units, out.chars + r.chars, 1 + max(out.depth, r.depth))
    return out


def rope(raw: bytes) -> Rope:
    """A balanced rope over the bytes of a text."""
    if not raw:
        return None
    whole = np.frombuffer(raw, np.uint8)
    starts = unit_starts(whole)
    cuts = starts[::LEAF_UNITS]
    chars = np.add.reduceat(code_points(whole), cuts, dtype=np.int64)
    ends = np.append(cuts[1:], len(whole))
    level = [Leaf(whole[b:e], min(LEAF_UNITS, len(starts) - LEAF_UNITS * i), int(c)) for i, (b, e, c) in enumerate(zip(cuts, ends, chars, strict=True))]
    while len(level) > 1:
        level = [concatenated(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


def flat(r: Rope) -> bytes:
    return b"".join(p.tobytes() for p in r.pieces()) if r else b""


def sentinel(raw: bytes) -> Leaf:
    return Leaf(np.frombuffer(raw, np.uint8), 0, len(raw))


def rearranged(raw: bytes, seed: bytes, rate: int, spm_rate: int) -> tuple[bytes, int, str, int | None, int | None]:
    """(output, units, form, code points of the prefix, of the middle); seed: 16 bytes, four big-endian numbers."""
    tree = rope(raw)
    n = tree.units if tree else 0
    h = [int.from_bytes(seed[i : i + 4], "big") for i in range(0, 16, 4)]
    if not raw or h[2] % 100 >= rate or any(s in raw for s in SENTINELS):
        return raw, n, "plain", None, None
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    rest, suffix = tree.split("units", high)
    prefix, middle = rest.split("units", low) if rest else (None, None)
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    parts = [sentinel(S), suffix, sentinel(P), prefix] if form == "spm" else [sentinel(P), prefix, sentinel(S), suffix]
    out = concatenated(*parts, sentinel(M), middle)
    return flat(out), n, form, prefix.chars if prefix else 0, middle.chars if middle else 0


def inverted(raw: bytes, form: str) -> bytes:
    """The text again: the output's rope is split behind its sentinels, which no part holds, and its parts joined."""
    if form == "plain":
        return raw
    tree, parts, marks = rope(raw), {}, [S, P, M] if form == "spm" else [P, S, M]
    points = code_points(np.frombuffer(raw, np.uint8))
    at = [int(points[: raw.index(m)].sum()) for m in marks]
    for mark, place in zip(reversed(marks), reversed(at), strict=True):
        tree, tail = tree.split("chars", place)
        parts[mark] = tail.split("chars", len(mark))[1]
    return flat(concatenated(parts[P], parts[M], parts[S]))


def fill_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """docs with units, form, prefix_chars, middle_chars and output (the text for training) added, after its columns.

    rate: documents in a hundred that are rearranged; spm_rate: those of them, in a hundred, with the suffix first.
    """
    seed = free_name(docs, "_seed")
    new = [free_name(docs, c) for c in ("units", "form", "prefix_chars", "middle_chars", "output")]
    seeded = docs.withColumn(seed, F.substring(F.unhex(F.sha2(F.concat(F.lit("42:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)), 1, 16))
    kinds, names = [pa.int64(), pa.string(), pa.int64(), pa.int64()], docs.columns

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            made = [rearranged(t or b"", s, rate, spm_rate) for t, s in zip(texts, batch.column(seed).to_pylist(), strict=True)]
            out, n, form, before, middle = zip(*made, strict=True)
            added = [pa.array(c, t) for c, t in zip((n, form, before, middle), kinds, strict=True)] + [pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + added, names + new)

    return seeded.mapInArrow(turn, column_types(docs, **dict(zip(new, ("long", "string", "long", "long", "string"), strict=True))))


def fill_middle_inverted(made: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """made with the text rebuilt from its output and form."""

    names = made.columns

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = [inverted(r, f) for r, f in zip(batch.column(output).cast(pa.binary()).to_pylist(), batch.column(form).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raws, pa.binary()).cast(pa.string())], [*names, restored])

    return made.mapInArrow(undo, column_types(made, **{restored: "string"}))

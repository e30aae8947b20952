"""Suffix-array dedup: bytes of passages that stand elsewhere, found by longest previous factors in suffix order.

A window is a string of `length` bytes of a text. Its key is the hash of the least of its runs of GRAM bytes, in the order of
their hashes, so that equal windows have one key and neighbours mostly share it. The windows of one key that follow one
another make a run; a run is a key, a place and a count, about one in 85 bytes. Runs whose key stands once in the corpus can
repeat nothing and end there. The bytes of the others move to their key, run by run, and there a suffix array of the
runs' windows, many keys at once, gives each window's previous and next smaller positions: windows with a previous
factor of the full length repeat an earlier one, and the windows that they match are the first ones. Removed are the later windows alone (`keep_first`), or
both. The marks go back to the texts, where they are united.

Texts that stand in several rows are one text with a count, so that a group of copies of any size is looked at once.
Equal runs of a key are one run with all its places. A key with more than HOT_BYTES of runs meets in no task: Spark groups its equal runs,
then the windows of those that differ, by 128-bit digests, with sums made before the shuffle; nothing is dropped.

Null and empty texts, and texts shorter than `length`, have nothing removed. The first of several is the one in the text
with the smallest doc_id (null last; then by digest), then the smallest place; rows with the same doc_id and text count
as one document there, and as repeats of one another without `keep_first`. An empty table gives an empty result. Columns
other than doc_id and text are not read. Long texts are hashed in blocks of BLOCK_BYTES that overlap by a window, so that only
their bytes and marks grow with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.llm.shared import STORED, clear_stored, parts, stored
from noctua.llm.suffixes import SuffixOrder
from noctua.llm.words import mixed, powers, slices

GRAM = 32
BLOCK_BYTES = 1 << 18
SORT_BYTES = 1 << 20
HOT_BYTES = 4 << 20
PLACE_BITS = 20


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(values) - width + 1
    filled = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    filled[: len(values)] = values
    rows = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def window_runs(raws: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(piece, begin, n, key, places) of the runs of windows of each piece; places: 2 where the key's gram stands there twice or more."""
    gram = min(GRAM, (length + 1) // 2)
    sizes = np.array([len(r) for r in raws], np.int64)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = mixed((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    anchor = (least_in((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    key = h[anchor]
    piece, ends = np.repeat(np.arange(len(raws)), sizes)[: len(key)], np.cumsum(sizes)
    whole = np.arange(len(key)) + length <= ends[piece]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1]) | ~whole[:-1]
    begin = np.flatnonzero(new & whole)
    # a run ends before the next one or before a window that is not within its piece
    stop = np.flatnonzero(new | ~whole)
    end = np.append(stop, len(key))[np.searchsorted(stop, begin, "right")]
    turns = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
    places = 1 + (turns[end - 1] > turns[begin])
    return piece[begin], begin - (ends - sizes)[piece[begin]], end - begin, key[begin].view(np.int64), places


def runs_of(texts: DataFrame, length: int) -> DataFrame:
    """id, key, begin, n, weight of the runs of texts (id, text, copies)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, copies = (batch.column(c).to_numpy() for c in ("id", "copies"))
            held, size = [], 0
            for i, text in enumerate(batch.column("text")):
                raw = text.as_py()
                for at in range(0, len(raw) - length + 1, BLOCK_BYTES):
                    held.append((i, at, raw[at : at + BLOCK_BYTES + length - 1]))
                    size += len(held[-1][2])
                    if size >= BLOCK_BYTES:
                        yield made(held, ids, copies)
                        held, size = [], 0
            if held:
                yield made(held, ids, copies)

    def made(held, ids, copies) -> pa.RecordBatch:
        piece, begin, n, key, places = window_runs([raw for _, _, raw in held], length)
        row, base = (np.array([x[k] for x in held], np.int64)[piece] for k in (0, 1))
        columns = [ids[row], key, begin + base, n, copies[row] * places]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "key", "begin", "n", "weight"])

    return texts.select("id", "copies", "text").mapInArrow(found, "id long, key long, begin long, n long, weight long")


def with_bytes(meeting: DataFrame, length: int) -> DataFrame:
    """key, first_id, id, copies, begin, bytes of each run of meeting (texts, each with its runs)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            for row in range(batch.num_rows):
                raw = batch.column("text")[row].as_py()
                runs = batch.column("runs")[row].values
                key, begin, n = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("key", "begin", "n"))
                for at in range(0, len(key), 4096):
                    b, m = begin[at : at + 4096], n[at : at + 4096]
                    some = [raw[x : x + k + length - 1] for x, k in zip(b.tolist(), m.tolist(), strict=True)]
                    same = [pa.array([batch.column(c)[row].as_py()] * len(b), pa.int64()) for c in ("first_id", "id", "copies")]
                    yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 4096]), *same, pa.array(b), pa.array(some, pa.binary())], ["key", "first_id", "id", "copies", "begin", "bytes"])

    return meeting.mapInArrow(cut, "key long, first_id long, id long, copies long, begin long, bytes binary")


def covered(at: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(owner, start, end) of what the windows at increasing places of each owner cover."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] > at[:-1] + length) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], at[first], at[np.append(first[1:], len(at))[: len(first)] - 1] + length


def marks_of(rows: dict[str, list], length: int, keep_first: bool) -> pa.RecordBatch:
    """id, start, end of what is removed, from runs of whole keys."""
    ids, begin, copies = (np.array(rows[c], np.int64) for c in ("id", "begin", "copies"))
    nulls = np.array([x is None for x in rows["first_id"]])
    order = np.lexsort((begin, ids, np.array([x or 0 for x in rows["first_id"]], np.int64), nulls))
    known: dict[bytes, int] = {}
    kind = np.array([known.setdefault(rows["bytes"][i], len(known)) for i in order], np.int64)  # in the order of first places
    ids, begin, copies = ids[order], begin[order], copies[order]
    sizes = np.array([len(r) for r in known], np.int64)
    n, base = sizes - length + 1, np.cumsum(sizes) - sizes
    at = np.repeat(base - np.cumsum(n) + n, n) + np.arange(n.sum())
    owner = np.repeat(np.arange(len(n)), n)
    later, first = SuffixOrder(np.frombuffer(b"".join(known), np.uint8), at, length).repeated()
    times = np.bincount(kind, copies, len(n))
    removed = later if keep_first else later | first | (times > 1)[owner]
    of, start, end = covered((at - base[owner])[removed], owner[removed], length)
    spans = np.searchsorted(of, np.arange(len(n) + 1))
    each = np.diff(spans)[kind]
    place = np.repeat(np.arange(len(kind)), each)
    span = np.repeat(spans[kind] - np.cumsum(each) + each, each) + np.arange(each.sum())
    out = [ids[place], begin[place] + start[span], begin[place] + end[span]]
    if keep_first:  # of equal runs all but the first repeat an earlier one as a whole
        seen = np.zeros(len(kind), bool)
        seen[np.unique(kind, return_index=True)[1]] = True
        mine = seen[place]
        out = [np.concatenate([x[mine], y]) for x, y in zip(out, (ids[~seen], begin[~seen], (begin + sizes[kind])[~seen]), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "start", "end"])


def matched(runs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """id, start, end of what is removed; runs with their bytes meet by key."""
    names = ["key", "first_id", "id", "copies", "begin", "bytes"]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = {c: [] for c in names}, 0
        for batch in slices(batches, 2048):
            for c in names:
                rows[c] += batch.column(c).to_pylist()
            size += batch.column("bytes").nbytes
            if size >= SORT_BYTES:
                last = rows["key"].index(rows["key"][-1])  # whole keys only
                if last:
                    yield marks_of({c: v[:last] for c, v in rows.items()}, length, keep_first)
                    rows = {c: v[last:] for c, v in rows.items()}
                    size = sum(map(len, rows["bytes"]))
        if rows["key"]:
            yield marks_of(rows, length, keep_first)

    dealt = runs.repartition(parts(runs), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(sort, "id long, start long, end long")


def windows_of(kinds: DataFrame, length: int) -> DataFrame:
    """run, at, window (its digest), times, none, first_id, id, begin of each window of different runs at their first places."""
    same = ["run", "times", "none", "first_id", "id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = batch.column("bytes").to_pylist()
            at = [np.arange(len(r) - length + 1) for r in raws]
            row = np.repeat(np.arange(len(raws)), [len(a) for a in at])
            at = np.concatenate(at)
            digests = [xxhash.xxh3_128_digest(raws[i][a : a + length]) for i, a in zip(row.tolist(), at.tolist(), strict=True)]
            taken = batch.select(same).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(batch.column("begin").to_numpy()[row] + at), pa.array(at), pa.array(digests, pa.binary())], [*same, "begin", "at", "window"])

    return kinds.mapInArrow(cut, "run binary, times long, none boolean, first_id long, id long, begin long, at long, window binary")


def matched_hot(runs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for keys too large for a task. Equal runs become one with a count; windows of different runs meet by digest, in sums."""
    place = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "id", "begin")
    runs = runs.withColumn("run", F.unhex(F.md5("bytes")))
    kinds = runs.groupBy("run").agg(F.sum("copies").alias("times"), F.min(place).alias("place"), F.first("bytes").alias("bytes"))
    kinds = stored(kinds.select("run", "times", "place.*", "bytes"), "kinds")
    windows = stored(windows_of(kinds, length), "windows")
    place = F.struct("none", "first_id", "id", "begin")
    groups = windows.groupBy("window").agg(F.sum("times").alias("all_times"), F.count("*").alias("n"), F.min(place).alias("first"))
    again = windows.join(groups.filter("n > 1" if keep_first else "all_times > 1").select("window", "first"), "window")
    again = again.filter(~place.eqNullSafe(F.col("first"))) if keep_first else again

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.sort(x.values.to_numpy()) for x in batch.column("at")]
            owner, start, end = covered(np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists]), length)
            yield pa.RecordBatch.from_arrays([batch.column("run").take(pa.array(owner)), pa.array(start), pa.array(end)], ["run", "start", "end"])

    spans = again.groupBy("run").agg(F.collect_list("at").alias("at")).mapInArrow(unite, "run binary, start long, end long")
    thin = runs.select("run", "id", "begin", F.octet_length("bytes").cast("long").alias("size"))
    moved = lambda df: df.select("id", (F.col("begin") + F.col("start")).alias("start"), (F.col("begin") + F.col("end")).alias("end"))
    if not keep_first:
        return moved(thin.join(spans, "run"))
    # of equal runs all but the first repeat an earlier one as a whole
    first = kinds.select("run", F.col("id").alias("_id"), F.col("begin").alias("_begin"))
    later = thin.join(first, "run").filter((F.col("id") != F.col("_id")) | (F.col("begin") != F.col("_begin")))
    return moved(first.select("run", F.col("_id").alias("id"), F.col("_begin").alias("begin")).join(spans, "run")).unionByName(later.select("id", F.col("begin").alias("start"), (F.col("begin") + F.col("size")).alias("end")))


def without(texts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """digest, first_id, n_removed, n_spans, kept_sha256 and kept of texts with marks (start, end), or none where all goes."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for row in range(batch.num_rows):
                raw = batch.column("text")[row].as_py()
                if not keep_first and batch.column("copies")[row].as_py() > 1:
                    start, end = np.zeros(1, np.int64), np.array([len(raw)])
                elif (marks := batch.column("marks")[row]).is_valid:
                    start, end = (marks.values.field(c).to_numpy() for c in ("start", "end"))
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate(end[order])
                    new = np.append(True, start[1:] > end[:-1])
                    start, end = start[new], end[np.append(np.flatnonzero(new)[1:], len(new)) - 1]
                else:
                    start = end = np.zeros(0, np.int64)
                edges = [0, *np.stack([start, end], 1).reshape(-1).tolist(), len(raw)]
                kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                out.append((len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("first_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["digest", "first_id", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.mapInArrow(remove, "digest binary, first_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeated_bytes(docs: DataFrame, length: int = 200, keep_first: bool = True, with_kept: bool = False) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, its bytes).

    Each byte of a string of `length` bytes that also starts anywhere else is removed; with keep_first, only where it
    also starts earlier.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    since = len(STORED)
    grouped = rows.filter(F.col("n_bytes") >= length).groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("text").alias("text"))
    texts = stored(grouped.withColumn("id", F.monotonically_increasing_id()), "texts")
    runs = stored(runs_of(texts, length), "runs")
    keys = runs.groupBy("key").agg(F.sum("weight").alias("weight"), F.sum(F.col("n") + length - 1).alias("size")).filter("weight > 1")
    keys = stored(keys.select("key", (F.col("size") > HOT_BYTES).alias("hot")), "keys")
    # by merges: plans, and with them the growth, are the same at every size
    meeting = runs.hint("merge").join(keys.hint("merge"), "key").groupBy("id", "hot").agg(F.collect_list(F.struct("key", "begin", "n")).alias("runs"))
    meeting, any_hot = stored(meeting, "meeting"), not keys.filter("hot").isEmpty()
    clear_stored(docs.sparkSession, since, (texts, meeting))
    meeting = meeting.hint("merge").join(texts.select("id", "first_id", "copies", "text").hint("merge"), "id")
    marks = matched(with_bytes(meeting.filter("not hot"), length), length, keep_first)
    if any_hot:
        marks = marks.unionByName(matched_hot(stored(with_bytes(meeting.filter("hot"), length), "hot"), length, keep_first))
    marked = stored(marks, "marks").groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    touched = texts.hint("merge").join(marked.hint("merge"), "id", "left").filter("marks is not null or copies > 1")
    cut = without(touched, length, keep_first)
    cut = stored(cut if with_kept else cut.drop("kept"), "cut")
    clear_stored(docs.sparkSession, since, (cut,))
    out = rows.join(cut.withColumnRenamed("first_id", "_first"), "digest", "left")
    # with keep_first, copies of a text after its first document repeat it as a whole
    later = F.col("_first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("_first")) if keep_first else F.lit(False)
    whole = F.unhex(F.lit(""))
    columns = {"n_removed": (F.col("n_bytes"), F.lit(0)), "n_spans": (F.lit(1), F.lit(0)), "kept_sha256": (F.sha2(whole, 256), F.lower(F.hex("digest")))}
    columns |= {"kept": (whole, F.col("text"))} if with_kept else {}
    return out.select("doc_id", "n_bytes", *[F.when(later, gone).otherwise(F.coalesce(c, as_is)).cast(dict(cut.dtypes)[c]).alias(c) for c, (gone, as_is) in columns.items()])

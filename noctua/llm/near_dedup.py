"""MinHash near-dedup by a multi-index Hamming join, confirmed on full shingle sets.

Texts with the same words form a class, and the class's smallest doc_id stands for it. Its signature is CHUNK * chunks
minima of 16 bits. By the pigeonhole principle two signatures that differ in fewer than 2 * chunks places agree, in
some chunk, in all places but one at most; so each chunk gives one key for each place left out, and all pairs under
that distance share a key. At the similarity asked for a place differs with probability 1 - similarity, so that a
linked pair at that distance or beyond has a chance of about 1e-6.

Pairs of a key are not all emitted. In each round a key's members meet one leader; links that hold on the full sets
join components. The last round looks at all pairs of a key whose members still lie in different components, so that
no link between components is lost: pairs of keys of fewer than LARGE_KEY members are emitted; members of larger keys
meet by the rarest shingles of their sets instead (`prefix_pairs`), which all pairs that are similar enough do, so that
their pairs are not made. Components come from min-label contraction; nothing of a document reaches the driver.

A text with fewer words than a shingle is one shingle. Null texts, and texts without words, are linked with nothing.
Rows with a null doc_id get a null component and are kept. Rows that share a doc_id count as one document. Empty
tables give empty results. Columns other than doc_id and text are not read. A very long text has one signature over
all its shingles, and its whole set is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.llm.shared import STORED, clear_stored, stored
from noctua.llm.words import NOT_SPACE, Hashed, chunks, mixed, slices

CHUNK = 4
STAR_ROUNDS = 2
LARGE_KEY = 32
BLOCK_ROWS = 1024
CELL_BITS = 20
MAX_SHINGLES = 1 << 13
CONFIRM_ROWS = 256


def folded(text: str | None) -> bytes:
    """A-Z lower-cased; a zero byte as two that no text holds."""
    return (text or "").encode("utf-8", "replace").lower().replace(b"\0", b"\xff\xfe")


def shingles(text: str | None, words: int) -> frozenset[bytes]:
    w = folded(text).split()
    return frozenset(b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def minima(s: np.ndarray, places: int) -> np.ndarray:
    """The 16-bit minima of a set of hashes under `places` mixes."""
    salts = mixed(np.arange(1, places + 1, dtype=np.uint64))[:, None]
    low = np.full(places, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), MAX_SHINGLES):
        h = (s[None, at : at + MAX_SHINGLES] ^ salts) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        low = np.minimum(low, h.min(1))
    return (mixed(low) >> np.uint64(48)).astype("<u2")


def hashed_sets(raws: list[bytes], words: int) -> Iterator[np.ndarray]:
    """For each folded text the sorted 64-bit hashes of its shingles; none for a text without words."""
    factors = mixed(np.arange(101, 101 + words, dtype=np.uint64)) | np.uint64(1)
    for first, last in chunks(raws):
        h = Hashed(raws[first:last], NOT_SPACE)
        w = h.hash(h.begin, h.end)
        m = max(0, len(w) - words + 1)
        run = mixed(sum(w[k : k + m] * factors[k] for k in range(words))) if m else np.zeros(0, np.uint64)
        for i in range(last - first):
            b, e = h.first[i], h.first[i + 1]
            if e - b >= words:
                yield np.unique(run[b : e - words + 1])
            else:
                yield mixed((w[b:e] * factors[: e - b]).sum(keepdims=True), 7) if e > b else np.zeros(0, np.uint64)


def signatures(docs: DataFrame, words: int, places: int) -> DataFrame:
    """doc_id, n (distinct shingles), h1 and h2 (digest of the word sequence), sig."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = [folded(t) for t in batch.column(1).to_pylist()]
            n, h1, h2, sig = [], [], [], []
            for raw, s in zip(raws, hashed_sets(raws, words), strict=True):
                digest = xxhash.xxh3_128_digest(b" ".join(raw.split())) if len(s) else bytes(16)
                n.append(len(s))
                h1.append(int.from_bytes(digest[:8], "little", signed=True))
                h2.append(int.from_bytes(digest[8:], "little", signed=True))
                sig.append(minima(s, places).tobytes() if len(s) else b"")
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h1", "h2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, sig binary")


def index(classes: DataFrame, places: int) -> DataFrame:
    """id, n, key: for each chunk and each place of it left out, the hash of the other places."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2").reshape(-1, places).astype(np.uint64)
                out = []
                for c in range(0, places, CHUNK):
                    for gone in range(CHUNK):
                        left = [c + k for k in range(CHUNK) if k != gone]
                        value = np.zeros(len(sig), np.uint64)
                        for k in left:
                            value = (value << np.uint64(16)) | sig[:, k]
                        out.append(mixed(mixed(value) + np.uint64((c + gone + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
                key = np.stack(out, 1).reshape(-1).view(np.int64)
                ids, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, places)), pa.array(np.repeat(n, places)), pa.array(key)], ["id", "n", "key"])

    return classes.select("id", "n", "sig").mapInArrow(keys, "id long, n long, key long")


def near_sizes(a, b, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def within_distance(pairs: DataFrame, classes: DataFrame, distance: int) -> DataFrame:
    """Those of pairs (a, b) whose signatures differ in at most `distance` places; no text moves for the others."""
    left, right = (classes.select(F.col("id").alias(k), F.col("sig").alias(f"{k}_sig")) for k in "ab")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in ("a_sig", "b_sig"))
            yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= distance))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "a_sig", "b_sig").mapInArrow(near, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough; texts has id and text."""
    left, right = (texts.select(F.col("id").alias(k), F.col("text").alias(f"{k}_text")) for k in "ab")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, frozenset] = {}
        for batch in (whole.slice(at, CONFIRM_ROWS) for whole in batches for at in range(0, whole.num_rows, CONFIRM_ROWS)):
            kept = []
            for a, b, ta, tb in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "a_text", "b_text")), strict=True):
                if a not in known:
                    known = {a: shingles(ta, words)}
                x, y = known[a], shingles(tb, words)
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in range(2)], ["a", "b"])

    return pairs.join(right, "b").join(left, "a").mapInArrow(confirm, "a long, b long")


def contracted(edges: DataFrame) -> DataFrame | None:
    """id, comp for every id of edges (a, b): comp is the smallest id of its component."""
    labels, edges = None, stored(edges.filter("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("p"))
        for _ in range(2):
            parent = stored(parent, "parents")
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("id", F.col("pp").alias("p"))
        parent = stored(parent, "parents")
        if labels is None:
            labels = parent.select("id", F.col("p").alias("comp"))
        else:
            labels = relabelled(labels, parent, "comp")
        labels = stored(labels, "labels")
        edges = relabelled(relabelled(edges, parent, "a"), parent, "b").filter("a <> b")
        edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels


def relabelled(df: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    to = parent.select(F.col("id").alias(column), F.col("p").alias("_to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def with_components(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    """df (id, ...) with comp."""
    if labels is None:
        return df.withColumn("comp", F.col("id"))
    return df.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def prefix_pairs(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """id, n, other, m: all pairs of members across components that can be similar enough by their rarest shingles.

    Two sets of n and m shingles that are similar enough share percent of the larger one at least, so that with all
    shingles in one order, rarest first, they meet within the first n - ceil(n * percent / 100) + 1 and as many of m.
    The first place where they meet leaves room for a big enough intersection, or the pair is dropped there. Any order
    is right: rarity is read from counts in 2 ** CELL_BITS cells, so that what is broadcast has a fixed size.
    """
    rows = stored(texts.hint("merge").join(members.select("id", "comp").distinct().hint("merge"), "id").select("id", "comp", "text").dropDuplicates(["id"]), "dense")
    shift = np.uint64(64 - CELL_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << CELL_BITS, np.int64)
        for batch in slices(batches):
            for s in hashed_sets([folded(t) for t in batch.column(0).to_pylist()], words):
                np.add.at(n, mixed(s) >> shift, 1)
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n[cells])], ["cell", "n"])

    counted = rows.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # 2 ** CELL_BITS rows at most
    often = np.zeros(1 << CELL_BITS, np.int64)
    often[counted["cell"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    shipped = rows.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, comps = (batch.column(c).to_pylist() for c in (0, 1))
            out = []
            for i, comp, s in zip(ids, comps, hashed_sets([folded(t) for t in batch.column(2).to_pylist()], words), strict=True):
                first = s[np.lexsort((s, shipped.value[mixed(s) >> shift]))][: len(s) + (-len(s) * percent // 100) + 1]
                same = lambda x: np.full(len(first), x, np.int64)  # noqa: B023, E731
                out.append((same(i), same(comp), same(len(s)), np.arange(len(first)), first.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "comp", "n", "at", "h"])

    entries = stored(rows.mapInArrow(prefixes, "id long, comp long, n long, at long, h long"), "prefixes")
    met = entries.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    entries = stored(entries.join(met.filter("low < high").select("h", "blocks"), "h"), "meeting")
    # a shingle of many sets is dealt to as many keys as it has blocks
    left = entries.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    right = entries.select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(f"_{c}") for c in ("id", "comp", "n", "at")))
    room = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at"))
    pairs = left.join(right, ["h", "block"]).filter((F.col("id") < F.col("_id")) & (F.col("comp") != F.col("_comp")))
    pairs = pairs.filter(near_sizes(F.col("n"), F.col("_n"), percent) & (room * (100 + percent) >= (F.col("n") + F.col("_n")) * percent))
    return pairs.select("id", "n", F.col("_id").alias("other"), F.col("_n").alias("m"))


def link_classes(docs: DataFrame, classes: DataFrame, words: int, percent: int, places: int) -> tuple[DataFrame | None, DataFrame]:
    """(labels, links): id and comp of the linked classes, and the confirmed links found on the way."""
    distance = 2 * places // CHUNK - 1
    entries = index(classes, places)
    groups = entries.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("lead")).filter("size > 1")
    shared = stored(entries.join(groups.select("key", "lead"), "key"), "shared")
    # always by a merge: the plan, and with it the growth, is the same at every size; the texts move once for all rounds
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = stored(whole.hint("merge").join(shared.select("id").distinct().hint("merge"), "id", "left_semi"), "texts")
    labels, tested, links = None, None, None
    for step in range(STAR_ROUNDS + 1):
        if step == 0:
            meeting = shared.select("id", "n", F.col("lead.id").alias("other"), F.col("lead.n").alias("m"))
            meeting = meeting.filter("id <> other")
        else:
            members = stored(with_components(shared.select("id", "n", "key"), labels), "members")
            split = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"), F.min(F.struct(F.xxhash64("id", "key", F.lit(step)).alias("h"), "id", "n", "comp")).alias("lead")).filter("low < high")
            if step < STAR_ROUNDS:  # one leader a key
                meeting = members.join(split.select("key", "lead"), "key").filter(F.col("comp") != F.col("lead.comp"))
                meeting = meeting.select("id", "n", F.col("lead.id").alias("other"), F.col("lead.n").alias("m"))
            else:  # all pairs across components
                left = members.join(split.filter(F.col("size") < LARGE_KEY).select("key"), "key", "left_semi")
                right = left.select("key", F.col("id").alias("other"), F.col("n").alias("m"), F.col("comp").alias("comp2"))
                meeting = left.join(right, "key").filter(F.col("comp") < F.col("comp2")).select("id", "n", "other", "m")
                large = members.join(split.filter(F.col("size") >= LARGE_KEY).select("key"), "key", "left_semi")
                meeting = meeting.union(prefix_pairs(stored(large, "large"), texts, words, percent))
        meeting = meeting.filter(near_sizes(F.col("n"), F.col("m"), percent))
        pairs = meeting.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.union(pairs)
        near = stored(within_distance(pairs, classes, distance), "near")
        found = stored(confirmed(near, texts, words, percent), "links")
        links = found if links is None else links.union(found)
        comps = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        if labels is not None:  # links between components as they are
            to = with_components(comps, labels).select("id", F.col("comp").alias("p"))
            found = relabelled(relabelled(found, to, "a"), to, "b")
        merged = contracted(found.select("a", "b"))
        if merged is not None:
            if labels is None:
                labels = merged
            else:
                old = relabelled(labels, merged.withColumnRenamed("comp", "p"), "comp")
                labels = stored(old.unionByName(merged.join(old.select("id"), "id", "left_anti")), "labels")
    return labels, links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, chunk_count: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs.

    Documents with 100 * intersection >= percent * union of their shingles are linked; component_id is the smallest
    doc_id reachable, and kept is true for the document that has it.
    """
    since = len(STORED)
    places = CHUNK * (chunk_count or (10 if percent >= 85 else 12))
    signed = stored(signatures(docs, words, places), "signatures")
    grouped = signed.filter("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = stored(grouped, "classes")
    labels, _ = link_classes(docs, classes, words, percent, places)
    clear_stored(docs.sparkSession, since, (signed, classes, labels))
    known = with_components(classes.select("h1", "h2", "id"), labels).select("h1", "h2", "comp")
    thin = signed.select("doc_id", "n", "h1", "h2")
    out = thin.filter("n > 0").join(known, ["h1", "h2"], "left")  # rows without words have one digest: they stay out
    out = out.unionByName(thin.filter("n = 0").withColumn("comp", F.col("doc_id")))
    component = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

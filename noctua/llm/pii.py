"""Personal data: base patterns, and terms that reveal them by corpus co-occurrence.

Base spans are leftmost, non-overlapping matches of four patterns, each kind for itself; a match that fails its check
is dropped. Each matched value is a protected entity. A term (a word of three letters or digits at least) that stands
outside base spans anywhere in a document with an entity may reveal it: with row counts over the whole corpus, its
disclosure is the pointwise mutual information of term and entity over the entity's information content, 1 if the term
stands nowhere else. Terms that stand with the entity in SUPPORT different texts at least (copies, alike but for case
and white space, count once) and disclose GENERALISE of it at least are spans of kind `term` in every row, with that
entity or without; sanitised texts have them generalised, or removed from REMOVE on. Of several entities the one most
disclosed rules.

Secrets are spans of kind `secret` after the base kinds: runs of SECRET_LETTERS letters, digits and underscores at
least, outside other word signs, with a letter and two digits, that carry SECRET_BITS of information a sign at least by
the frequencies of their own signs, and lie in no base span. They are not protected entities.

No pair is left out for its cost: a term in T rows can disclose GENERALISE of an entity in E of N rows only if
T <= E * (N / E) ** (1 - GENERALISE), so that pairs beyond that are not made.

Null and empty texts have no spans. Counts are of rows: repeated rows count each, but give one text. Rows with a null
doc_id are treated like others. Empty tables give empty results. Of columns of docs with the name of an added one, the
added one gets an underscore more. A text of any length takes time in proportion to it, one of a single word too.

The terms found are looked up in the task where they are few (BROADCAST_TERMS), else joined to the texts by a merge.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.llm.shared import column_types, free_name, stored, tucked, untucked
from noctua.llm.words import Hashed, byte_table, chunks, mixed, slices

#: Fixed patterns of the base kinds, in order.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SUPPORT = 3
SECRET_LETTERS, SECRET_BITS = 20, 2.8
GENERALISE, REMOVE = 0.8, 0.95
FILTER_BITS = 22
BROADCAST_TERMS = 1 << 20
TASK_TERMS = 1 << 20

COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
HAS_DIGIT = re.compile(r"[0-9]")
SECRET = re.compile(rf"(?<![A-Za-z0-9_])[A-Za-z0-9_]{{{SECRET_LETTERS},}}+")
WORD = re.compile(r"(?:[A-Za-z0-9]|[^\x00-\x7F])+")
ALNUM = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = re.sub("[^0-9]", "", found)
    return 8 <= len(digits) <= 15 if kind == "phone" else 16 <= len(digits) <= 19 and luhn(digits)


def leftmost(text: str, at_place: re.Pattern, at_run: re.Pattern) -> Iterator[re.Match]:
    """Leftmost non-overlapping matches of a pattern that begins with a run of signs and has to go on with another sign.

    Where it fails at the begin of a run it fails within the run: a match begins a run, or where the last one ended.
    So that no run is read again from each of its places.
    """
    at = 0
    while m := at_place.match(text, at) or at_run.search(text, at):
        yield m
        at = m.end()


#: the pattern at a place, and at the begin of a run only
BY_RUN = {
    kind: (re.compile(f"(?:{run})++{after}"), re.compile(f"(?<!{run})(?:{run})++{after}"))
    for kind, run, after in (("email", "[A-Za-z0-9._%+-]", PATTERNS["email"].partition("+-]+")[2]), ("ip", "[0-9]", PATTERNS["ip"].partition("+")[2]))
}


def base_spans(text: str | None) -> list[Span]:
    """By kind as listed, then by start; ends are exclusive."""
    text = text or ""
    kinds = [k for k, need in (("email", "@" in text), ("ip", "." in text), ("card", True), ("phone", "+" in text)) if need]
    if not HAS_DIGIT.search(text):
        kinds = [k for k in kinds if k == "email"]
    found = lambda k: leftmost(text, *BY_RUN[k]) if k in BY_RUN else COMPILED[k].finditer(text)
    return [(k, m.start(), m.end()) for k in kinds for m in found(k) if valid(k, m.group())]


def secret_spans(text: str | None, base: list[Span]) -> list[Span]:
    """Keys and tokens in the text, outside base spans (which are given)."""
    found = [m for m in SECRET.finditer(text or "") if information(m.group()) >= SECRET_BITS]
    return [("secret", m.start(), m.end()) for m, free in zip(found, outside(found, base), strict=True) if free]


def information(run: str) -> float:
    """Bits a sign, by the frequencies of the run's own signs; 0 for one without a letter or two digits."""
    counts = Counter(run)
    if sum(n for c, n in counts.items() if c in "0123456789") < 2 or not any(c.isalpha() for c in counts):
        return 0.0
    return -sum(n / len(run) * math.log2(n / len(run)) for n in counts.values())


def outside(matches: list[re.Match], spans: list[Span]) -> Iterator[bool]:
    """For each of the matches (in order) whether it meets none of the spans."""
    covered, at, high = sorted((b, e) for _, b, e in spans), 0, 0
    for m in matches:
        while at < len(covered) and covered[at][0] < m.end():
            high, at = max(high, covered[at][1]), at + 1
        yield high <= m.start()


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of folded words."""
    h = Hashed([w.lower().encode("utf-8", "replace") for w in words], ALNUM)
    return mixed(h.hash(h.texts[:-1], h.texts[1:] - 1), 3)


def entity(kind: str, value: str) -> int:
    value = value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def text_key(text: str) -> int:
    """The same for copies, alike but for case and white space."""
    return int.from_bytes(hashlib.blake2b(" ".join(text.lower().split()).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def without_spans(text: str) -> str:
    """The text with blanks for its base spans."""
    out, at = [], 0
    for b, e in sorted((b, e) for _, b, e in base_spans(text)):
        if e > at:
            out += [text[at:b], " " * (e - max(b, at))]
            at = e
    return "".join(out) + text[at:]


def term_lists(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the distinct hashes of its terms."""
    raws = [t.replace("\0", " ").lower().encode("utf-8", "replace") for t in texts]
    for first, last in chunks(raws):
        h = Hashed(raws[first:last], ALNUM)
        f = mixed(h.hash(h.begin, h.end), 3)
        letters = np.zeros(h.size + 1, np.int64)
        np.cumsum((np.frombuffer(b"\0".join(raws[first:last]) + b"\0", np.uint8) & 0xC0) != 0x80, out=letters[1:])
        long = letters[h.end] - letters[h.begin] >= 3
        for i in range(last - first):
            w = slice(h.first[i], h.first[i + 1])
            yield np.unique(f[w][long[w]])


def filled_bits(df: DataFrame, column: str):
    """A broadcast bitmap of fixed size of the column's leading bits, to leave out most other values before a join."""
    bits = df.select(F.shiftrightunsigned(column, 64 - FILTER_BITS).cast("int").alias("bit")).distinct()
    filled = np.zeros(1 << FILTER_BITS, bool)
    for part in bits.toLocalIterator():  # at most 2**22 rows, whatever the corpus
        filled[part.bit] = True
    return df.sparkSession.sparkContext.broadcast(np.packbits(filled))


def lists_of(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    splits = np.concatenate([[0], np.cumsum([len(x) for _, x in rows])]).astype(np.int32)
    values = np.concatenate([*(x for _, x in rows), np.zeros(0, np.uint64)]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.ListArray.from_arrays(splits, pa.array(values))], ["key", "terms"])


def entities(docs: DataFrame) -> DataFrame:
    """entity, key (of the text), n: in how many rows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column(0).to_pylist():
                held = {entity(kind, text[b:e]) for kind, b, e in base_spans(text)}
                key = text_key(text) if held else 0
                rows += [(x, key) for x in held]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["entity", "key"])

    return docs.select("text").mapInArrow(find, "entity long, key long").groupBy("entity", "key").agg(F.count("*").alias("n"))


def terms_of_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, terms of the texts with keys, each once; terms stand outside base spans."""
    shipped = filled_bits(keys, "key")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shipped.value).astype(bool)
        for batch in slices(batches):
            held = {}
            for text in batch.column(0).to_pylist():
                if text and wanted[(key := text_key(text)) >> (64 - FILTER_BITS) & (1 << FILTER_BITS) - 1]:
                    held.setdefault(key, text)
            if held:
                yield lists_of(list(zip(held, term_lists([without_spans(t) for t in held.values()]), strict=True)))

    found = docs.select("text").mapInArrow(find, "key long, terms array<bigint>")
    return found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("terms").alias("terms"))


def narrowed(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """key, term, and the columns of terms. Most other terms are left out before they move."""
    shipped = filled_bits(terms, "term")

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shipped.value).astype(bool)
        for batch in slices(batches):
            rows = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = x.values.to_numpy(zero_copy_only=False).view(np.uint64)
                rows.append((key, f[wanted[f >> np.uint64(64 - FILTER_BITS)]]))
            yield lists_of(rows)

    near = lists.select("key", "terms").mapInArrow(narrow, "key long, terms array<bigint>")
    return near.select("key", F.explode("terms").alias("term")).join(terms, "term")


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, documents: in how many rows each of terms stands. The bitmap goes to the tasks; the join is exact."""
    shipped = filled_bits(terms, "term")

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        term, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        return term, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, held, size = np.unpackbits(shipped.value).astype(bool), [], 0
        for batch in slices(batches):
            for f in term_lists([t or "" for t in batch.column(0).to_pylist()]):
                f = f[wanted[f >> np.uint64(64 - FILTER_BITS)]]
                held.append((f, np.ones(len(f), np.int64)))
                size += len(f)
            if size > TASK_TERMS:  # one row a term and task, but for tasks of more terms than are held
                held = [summed(held)]
                size = len(held[0][0])
                if size > TASK_TERMS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["term", "n"])
                    held, size = [], 0
        if held:
            term, n = summed(held)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])

    counted = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("documents"))
    return counted.join(terms, "term", "left_semi")


def disclosures(docs: DataFrame) -> DataFrame:
    """entity, term, disclosure of the pairs above the threshold."""
    none = docs.sparkSession.createDataFrame([], "entity long, term long, disclosure double")
    held = stored(entities(docs), "entities")
    often = held.groupBy("entity").agg(F.sum("n").alias("entities"), F.count("*").alias("texts")).filter(F.col("texts") >= SUPPORT)
    often = stored(often.select("entity", "entities"), "often")
    most = often.agg(F.max("entities")).first()[0]
    if most is None:
        return none
    n = float(docs.count())
    rows = stored(held.join(often, "entity"), "held")
    lists = stored(terms_of_keys(docs, rows.select("key").distinct()), "lists")
    common = lists.select(F.explode("terms").alias("term")).groupBy("term").count().filter(F.col("count") >= SUPPORT)
    limit = lambda e: F.pow(e, F.lit(GENERALISE)) * F.pow(F.lit(n), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    terms = stored(document_counts(docs, stored(common.select("term"), "common")).filter(F.col("documents") <= limit(F.lit(float(most)))), "terms")
    pairs = rows.join(narrowed(lists, terms), "key").filter(F.col("documents") <= limit(F.col("entities").cast("double")))
    both = pairs.groupBy("entity", "term", "entities", "documents").agg(F.sum("n").alias("both"), F.count("*").alias("texts"))
    content = F.log(F.lit(n) / F.col("entities"))
    mutual = F.log(F.lit(n) * F.col("both") / (F.col("entities") * F.col("documents")))
    rated = both.filter(F.col("texts") >= SUPPORT).withColumn("disclosure", F.when(content > 0, mutual / content))
    return rated.filter(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure")


class Told:
    """Hashes of revealing terms, sorted, and whether each is removed."""

    def __init__(self, hashes: np.ndarray, removed: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.removed = hashes[order], removed[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def of(self, f: np.ndarray) -> dict[int, bool]:
        """Those of f (distinct hashes) that are held."""
        f = f[self.filter[f >> np.uint64(64 - FILTER_BITS)]]
        at = np.minimum(np.searchsorted(self.hashes, f), len(self.hashes) - 1)
        ok = self.hashes[at] == f if len(self.hashes) else np.zeros(0, bool)
        return dict(zip(f[ok].view(np.int64).tolist(), self.removed[at[ok]].tolist(), strict=True))


def revealing(docs: DataFrame, told: DataFrame) -> DataFrame:
    """_key, _told (struct of term and removed) of all texts that hold terms of told (term, removed)."""
    shipped = filled_bits(told, "term")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shipped.value).astype(bool)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            rows = {}
            for text, f in zip(texts, term_lists(texts), strict=True):
                f = f[wanted[f >> np.uint64(64 - FILTER_BITS)]]
                if len(f):
                    rows[text_key(text)] = f
            yield lists_of(list(rows.items()))

    found = docs.select("text").mapInArrow(find, "key long, terms array<bigint>").select("key", F.explode("terms").alias("term")).distinct()
    mine = found.join(told, "term").groupBy(F.col("key").alias("_key")).agg(F.collect_set(F.struct("term", "removed")).alias("_told"))
    return stored(mine, "revealing")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, of its text."""
    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = pa.array([text_key(t or "") for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "_key"])

    return docs.mapInArrow(add, column_types(docs, _key="long"))


def term_spans(text: str, terms: dict[int, bool], taken: list[Span]) -> list[tuple[int, int, bool]]:
    """Words whose hash is among terms and that lie in no span taken: (start, end, removed)."""
    words = [m for m in WORD.finditer(text) if m.end() - m.start() >= 3]
    told = hashes([m.group() for m in words]).view(np.int64).tolist()
    held = [(m, terms[h]) for m, h in zip(words, told, strict=True) if h in terms]
    return [(m.start(), m.end(), gone) for (m, gone), free in zip(held, outside([m for m, _ in held], taken), strict=True) if free]


def sanitised(text: str, base: list[Span], terms: list[tuple[int, int, bool]]) -> str:
    """Base spans and secrets become their kind in brackets, terms `[TERM]` or nothing; of overlapping spans the earliest and longest rules."""
    marks = sorted([(b, -e, f"[{k.upper()}]") for k, b, e in base] + [(b, -e, "" if gone else "[TERM]") for b, e, gone in terms])
    out, at = [], 0
    for b, e, mark in marks:
        if b >= at:
            out += [text[at:b], mark]
        at = max(at, -e)
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """The columns of docs with spans (kind, start, end, base kinds first) and sanitised (the text without them).

    Without with_text: doc_id and spans only. No text moves between tasks but where terms are too many to ship.
    """
    rows = tucked(docs, ["doc_id", "text"]) if with_text else docs.select("doc_id", "text")
    told = stored(disclosures(docs).groupBy("term").agg((F.max("disclosure") >= REMOVE).alias("removed")), "told")
    few = told.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    if few:
        terms = told.toPandas()  # at most BROADCAST_TERMS
        shipped = docs.sparkSession.sparkContext.broadcast(Told(terms["term"].to_numpy(np.int64).view(np.uint64), terms["removed"].to_numpy(bool)))
    else:
        shipped = None
        rows = keyed(rows).hint("merge").join(revealing(docs, told).hint("merge"), "_key", "left").drop("_key")
    kept = [c for c in rows.columns if c not in ("text", "_told")]
    places, at = [rows.columns.index(c) for c in kept], rows.columns.index("text")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            if shipped is not None:
                told = map(shipped.value.of, term_lists([t or "" for t in texts]))
            else:
                told = ({t["term"]: t["removed"] for t in x or []} for x in batch.column(batch.num_columns - 1).to_pylist())
            spans, clean = [], []
            for text, terms in zip(texts, told, strict=True):
                base = base_spans(text)
                base += secret_spans(text, base)
                more = term_spans(text, terms, base) if terms and text else []
                spans.append([{"kind": k, "start": b, "end": e} for k, b, e in [*base, *(("term", b, e) for b, e, _ in more)]])
                if with_text:
                    clean.append(sanitised(text, base, more) if base or more else text)
            columns = [*(batch.column(k) for k in places), pa.array(spans, kind), *([batch.column(at), pa.array(clean, pa.string())] if with_text else [])]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "_spans", *(["text", "_clean"] if with_text else [])])

    added = {"_spans": "array<struct<kind: string, start: int, end: int>>"} | ({"text": "string", "_clean": "string"} if with_text else {})
    found = rows.mapInArrow(look, column_types(rows.select(*kept), **added))
    if not with_text:
        return found.withColumnRenamed("_spans", "spans")
    return untucked(found, docs, ["doc_id", "text"], F.col("_spans").alias(free_name(docs, "spans")), F.col("_clean").alias(free_name(docs, "sanitised")))

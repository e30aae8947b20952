"""Toxicity by maximum-scoring segments of token log-odds.

Training: a bounded sample of labelled rows, about TRAIN_ROWS a class by a hash of doc_id; of documents with the
same sequence of words (by a 128-bit digest: groups of copies) one a class counts. A token's features are its whole word and its prefixes;
each has the log-odds of being in toxic against clean documents under a Dirichlet prior in proportion to its overall
count. Features count, of either side, whose share of toxic documents, by the Chernoff bound, is not one of chance among as many
features and whose log-odds are MIN_ODDS away from 0 at least; a token scores the strongest of its features, other tokens the small
negative log-ratio of their shares. The model does not depend on how rows are dealt to tasks.

Scoring: the linear-time search of all maximal scoring segments finds every toxic passage; a segment's score is
calibrated by the extreme-value law of the clean documents' scores (lambda of the Karlin-Altschul equation, K by
maximum likelihood on the third of the sample not used for the log-odds), the significant ones are summed, and a
logistic curve fitted on that third makes the sum a probability.

Labels, language, source and id are no inputs of a score. Null and empty texts get the score of a text without any
passage. Without labels of both classes all scores are 0. Repeated rows are scored alike. Of several labels of a
doc_id toxic rules, of several texts the least in order counts for training, so that the sample's bound holds.
Empty tables give empty results. Of columns of docs with the name of an added one, the added one gets an underscore
more. A text of any length takes time in proportion to it; it is one sequence, of a single word too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.llm.shared import column_types, free_name, stored, tucked, untucked
from noctua.llm.words import LETTERS, Hashed, chunks, mixed, slices

TRAIN_ROWS = 10_000
PREFIXES = (4, 5, 6, 7)
MIN_ODDS = 1.5
PRIOR = 0.1  # weight of the Dirichlet prior: its mass as a part of all counts
FILTER_BITS = 20


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def token_features(h: Hashed) -> list[np.ndarray]:
    """For each kind of feature a hash a word; 0 where a word has none."""
    out = [mixed(h.hash(h.begin, h.end), 1)]
    for k in PREFIXES:
        has = h.end - h.begin > k
        f = np.zeros(len(h.begin), np.uint64)
        f[has] = mixed(h.hash(h.begin[has], h.begin[has] + k), 2)
        out.append(f)
    return out


@dataclass
class Model:
    hashes: np.ndarray
    odds: np.ndarray
    neutral: float = -0.03
    decay: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    offset: float = -3.0

    def __post_init__(self):
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def tokens(self, h: Hashed) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the words that score."""
        best = np.zeros(len(h.begin))
        for f in token_features(h):
            maybe = np.flatnonzero(self.filter[f >> np.uint64(64 - FILTER_BITS)])
            if len(maybe):
                at = np.minimum(np.searchsorted(self.hashes, f[maybe]), len(self.hashes) - 1)
                ok = self.hashes[at] == f[maybe]
                at, odds = maybe[ok], self.odds[at[ok]]
                best[at] = np.where(np.abs(odds) > np.abs(best[at]), odds, best[at])
        at = np.flatnonzero(best)
        return at, best[at]

    def passages(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """For each text the number of its words and its maximal segments (first word, last word, score)."""
        raws = [folded(t) for t in texts]
        for first, last in chunks(raws):
            h = Hashed(raws[first:last], LETTERS)
            at, score = self.tokens(h) if len(self.hashes) else (np.zeros(0, int), np.zeros(0))
            cut = np.searchsorted(at, h.first)
            for i in range(last - first):
                b, e = cut[i], cut[i + 1]
                words = int(h.first[i + 1] - h.first[i])
                yield words, segments(at[b:e] - h.first[i], score[b:e], self.neutral) if e > b else []

    def evidence(self, words: int, found: list[tuple[int, int, float]]) -> float:
        """Sum of the calibrated scores of the passages better than one expected by chance."""
        floor = math.log(self.k * max(words, 1))
        return sum(max(0.0, self.decay * s - floor) for _, _, s in found)

    def score(self, words: int, found: list) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * math.log1p(self.evidence(words, found)) + self.offset))))


def segments(at: np.ndarray, score: np.ndarray, neutral: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence with scores of either sign at some places and neutral elsewhere.

    One pass: each positive place begins a candidate with the running totals before and after it; it is joined to the
    nearest earlier one whose left total is lower, if that one's right total is not as high. Each candidate keeps the
    place of that nearest one, so that those between are passed over once only: the time is linear.
    """
    lefts: list[float] = []
    rights: list[float] = []
    spans: list[tuple[int, int]] = []
    lower: list[int] = []  # the nearest earlier candidate with a lower left total, or -1
    total, previous = 0.0, -1
    for place, s in zip(at.tolist(), score.tolist(), strict=True):
        total += neutral * (place - previous - 1)
        left, right, first = total, total + s, place
        total, previous = right, place
        if s <= 0:  # begins nothing; what follows starts lower
            continue
        j = len(lefts) - 1
        while j >= 0 and lefts[j] >= left:
            j = lower[j]
        while j >= 0 and rights[j] < right:  # joined: all from j on go, and j's own nearest is known
            left, first, k = lefts[j], spans[j][0], lower[j]
            del lefts[j:], rights[j:], spans[j:], lower[j:]
            j = k
        lefts.append(left)
        rights.append(right)
        spans.append((first, place))
        lower.append(j)
    return [(b, e, y - x) for x, y, (b, e) in zip(lefts, rights, spans, strict=True)]


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """toxic, rest, text of the sample. Its bound is documented above; the labels' own counts set the share taken."""
    h = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 20))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.create_map(*[F.lit(x) for k, n in {0: 1, 1: 1, **counts}.items() for x in (k, min(1 << 20, int(rows / n * (1 << 20))))])
    picked = known.filter(h < F.element_at(share, F.col("toxic")))
    rest = (F.pmod(F.xxhash64(F.lit("rest"), F.col("doc_id")), F.lit(3)) == 0).cast("int")
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by rows
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", rest.alias("rest"), "text")


def document_features(sample: DataFrame) -> DataFrame:
    """toxic, key (of a group of copies), features: the distinct ones of each text."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws, toxic = [folded(t) for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            for first, last in chunks(raws):
                h = Hashed(raws[first:last], LETTERS)
                kinds = token_features(h)
                keys, lists = [], []
                for i in range(last - first):
                    w = slice(h.first[i], h.first[i + 1])
                    f = np.unique(np.concatenate([k[w] for k in kinds]))
                    lists.append(f[f != 0].view(np.int64))
                    keys.append(xxhash.xxh3_128_digest(kinds[0][w].tobytes()))
                splits = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(toxic[first:last], pa.int32()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(splits, pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))], ["toxic", "key", "features"])

    found = sample.filter("rest = 0").select("toxic", "text").mapInArrow(features, "toxic int, key binary, features array<bigint>")
    return found.groupBy("toxic", "key").agg(F.first("features").alias("features"))


def log_odds(sample: DataFrame) -> Model:
    docs = stored(document_features(sample), "features")
    n = {r.toxic: r["n"] for r in docs.groupBy("toxic").agg(F.sum(F.size("features")).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    counts = docs.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("y1"), F.sum(1 - F.col("toxic")).alias("y0"))
    prior, mass = F.lit(PRIOR) * (F.col("y1") + F.col("y0")), PRIOR * (n[0] + n[1])
    a, b = F.col("y1") + prior, F.col("y0") + prior
    odds = F.log(a / (F.lit(n[1] + mass) - a)) - F.log(b / (F.lit(n[0] + mass) - b))
    counts = stored(counts.filter("y1 + y0 > 1"), "counts")
    k, share = F.col("y1") + F.col("y0"), n[1] / (n[0] + n[1])
    log = lambda x: F.coalesce(F.log(F.nullif(x, F.lit(0.0))), F.lit(0.0))
    chance = F.col("y1") * (log(F.col("y1") / k) - math.log(share)) + F.col("y0") * (log(F.col("y0") / k) - math.log(1 - share))
    rated = counts.withColumn("odds", odds).withColumn("sure", chance)
    kept = rated.filter((F.col("sure") > math.log(2 * max(counts.count(), 1))) & (F.abs("odds") > MIN_ODDS))
    kept = kept.select("f", "odds").toPandas()  # each passes the test, so that it stands in several documents of the bounded sample
    hashes = kept["f"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Model(hashes[order], kept["odds"].to_numpy(float)[order])


def calibrated(model: Model, sample: DataFrame) -> Model:
    """Sets neutral score, extreme-value law and curve on the rest: sums and at most 2 * TRAIN_ROWS pairs reach the driver."""
    if not len(model.hashes):
        model.slope, model.offset = 0.0, -60.0
        return model

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            raws = [folded(t) for t in pdf["text"]]
            for first, last in chunks(raws):
                h = Hashed(raws[first:last], LETTERS)
                at, score = model.tokens(h)
                cut = np.searchsorted(at, h.first)
                for i in range(last - first):
                    rows.append((int(pdf["toxic"].iloc[first + i]), int(h.first[i + 1] - h.first[i]), (at[cut[i] : cut[i + 1]] - h.first[i]).tolist(), score[cut[i] : cut[i + 1]].tolist()))
            yield pd.DataFrame(rows, columns=["toxic", "words", "places", "scores"])

    rows = sample.filter("rest = 1").mapInPandas(tell, "toxic int, words int, places array<int>, scores array<double>").collect()  # bounded sample
    rows.sort()  # sums of fractions in one order, however the rows were dealt
    if {0, 1} - {r.toxic for r in rows}:
        model.slope, model.offset = 0.0, -60.0
        return model
    words = [sum(r.words for r in rows if r.toxic == y) or 1 for y in (0, 1)]
    hits = [sum(len(r.places) for r in rows if r.toxic == y) for y in (0, 1)]
    share = [(h + 0.5) / (w + 1) for h, w in zip(hits, words, strict=True)]
    model.neutral = min(-1e-3, math.log((1 - share[1]) / (1 - share[0])))
    clean = np.array([s for r in rows if r.toxic == 0 for s in r.scores] or [float(model.odds.mean())])
    weight = max(len(clean), 1) / words[0] / len(clean)
    expected = lambda x: weight * np.exp(np.minimum(x * clean, 700)).sum() + (1 - weight * len(clean)) * math.exp(x * model.neutral) - 1
    low, high = 1e-6, 1e-6
    while expected(high) <= 0 and high < 50:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if expected(middle) <= 0 else (low, middle)
    model.decay = max(high, 1e-3)
    found = [(r.toxic, r.words, segments(np.array(r.places, int), np.array(r.scores, float), model.neutral)) for r in rows]
    chance = [n * math.exp(-model.decay * max((s for *_, s in f), default=0.0)) for y, n, f in found if y == 0 and n]
    model.k = 1 / max(float(np.mean(chance)) if chance else 1.0, 1e-9)
    x = np.array([math.log1p(model.evidence(n, f)) for _, n, f in found])
    model.slope, model.offset = logistic(x, np.array([y for y, *_ in found], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a weak ridge."""
    a, b = 1.0, -1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 1e-2 * a, (p - y).sum()])
        m = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.linalg.solve(m, g)
        a, b = a - float(np.clip(da, -5, 5)), b - float(np.clip(db, -5, 5))
    return a, b


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = stored(training_sample(docs, labels, rows), "sample")
    return calibrated(log_odds(sample), sample)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs with toxicity (0 to 1) and passages (first word, last word, score of each)."""
    rows = tucked(docs, ["text"])
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of a bounded sample

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches):
            found = list(model.passages(batch.column(0).to_pylist()))
            scores = pa.array([model.score(*f) for f in found], pa.float64())
            spans = pa.array([[{"first": b, "last": e, "score": s} for b, e, s in f] for _, f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, scores, spans], [*batch.schema.names, "_toxicity", "_passages"])

    found = rows.mapInArrow(scored, column_types(rows, _toxicity="double", _passages="array<struct<first: int, last: int, score: double>>"))
    return untucked(found, docs, ["text"], F.col("_toxicity").alias(free_name(docs, "toxicity")), F.col("_passages").alias(free_name(docs, "passages")))


def in_training(doc_id):
    """Rows whose labels may be used: the rest are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1

"""Document fingerprints by consistent weighted sampling, in built-in functions only.

A text's terms are its words (`[^\\x20\\x09-\\x0D]+`), weighed by their counts. For each of SAMPLES samples a term draws,
from a hash of itself, r and c of a Gamma(2, 1) law and b of a uniform one; with t = floor(ln w / r + b) and
ln a = ln c - r * (t - b) - r the term of the least a is the sample, told by (term, t). Two texts agree in a sample
with the probability of their generalised Jaccard similarity, the sum of the least weights over that of the largest.

Gamma draws come from tables of quantiles of 2**TABLE_BITS steps, so that a draw is a look-up in generated code. The
next document, by descending doc_id and round from the last to the first, is found within ranges: each range gets a
copy of the row that precedes it, so that texts move once. Ranges are cut at quantiles of (doc_id, hash of the text)
taken from a sample of CUT_SAMPLE pairs a range, so that neither far ids nor many rows of one id (or of none) fill a
range; where the cuts lie does not change the result.

Null and empty texts, and texts without words, have the fingerprint of no terms; two of them are alike (1), one of
them and another text are not (0). A table of one row is its own next document. Rows of one doc_id come in the order of
their texts' hashes, repeated rows each with a place; rows with a null doc_id come last. An empty table gives an empty
result. Other columns are not read. A very long text, or a very long word, is one row like others.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noctua.llm.shared import parts

SAMPLES = 48
TABLE_BITS = 12
CUT_SAMPLE = 24
RANGES = 8  # a partition: so that hashing deals them out evenly
#: ln a is kept in steps of 2**-22, the sample's own hash in the bits below.
STEPS, SHIFT, ID_BITS = float(1 << 22), 64.0, 31
NOTHING = "-"


def gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of the table's steps: 1 - (1 + x) * exp(-x) = u, by Newton steps."""
    u = (np.arange(1 << TABLE_BITS) + 0.5) / (1 << TABLE_BITS)
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), 1e-9)
    return x


def sample_key(term, log_weight, k: int, gamma, log_gamma):
    """The order of a term under sample k as one whole number: ln a above, the hash of (term, t) below."""
    mask = (1 << TABLE_BITS) - 1
    h = F.xxhash64(term, F.lit(k))
    draw = lambda at: F.shiftrightunsigned(h, at).bitwiseAND(F.lit(mask).cast("long")).cast("int")
    r, c = F.element_at(gamma, draw(0) + 1), F.element_at(log_gamma, draw(TABLE_BITS) + 1)
    b = (F.shiftrightunsigned(h, 2 * TABLE_BITS).bitwiseAND(F.lit(0xFFFF).cast("long")) + F.lit(0.5)) / F.lit(65536.0)
    t = F.floor(log_weight / r + b)
    log_a = c - r * (t - b) - r
    own = F.shiftrightunsigned(h, 64 - ID_BITS).bitwiseXOR(t * F.lit(0x9E3779)).bitwiseAND(F.lit((1 << ID_BITS) - 1).cast("long"))
    return F.floor((log_a + F.lit(SHIFT)) * F.lit(STEPS)).cast("long") * F.lit(1 << ID_BITS) + own


def place(doc_id, text):
    """The order of rows: by doc_id, null first, then by the text's hash."""
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("h"))


def range_of(key, cuts, n: int):
    """How many of the sorted cuts (a column) are not above key: a binary search."""
    steps = [1 << k for k in reversed(range(max(1, n.bit_length())))]
    inside = lambda at, step: (at + step <= n) & (F.get(cuts, at + step - 1) <= key)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(inside(at, step), at + step).otherwise(at))


def in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id and text with _range and _ghost: each range begins with a copy of the row before it (range 0: the last of all).

    The driver holds CUT_SAMPLE pairs of numbers a range, and then one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark, ranges = docs.sparkSession, RANGES * parts(docs)
    key = place(F.col("doc_id"), F.col("text"))
    n = docs.count()
    sampled = docs.select(key.alias("k")).sample(min(1.0, CUT_SAMPLE * ranges / max(n, 1)), 7).collect()
    sampled = sorted({(r.k.doc_id, r.k.h) for r in sampled}, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    cuts = sampled[:: max(1, len(sampled) // ranges)]
    table = spark.createDataFrame([([*cuts],)], "cuts array<struct<doc_id: long, h: long>>")
    dealt = docs.withColumn("_h", F.xxhash64("text")).join(F.broadcast(table))  # one row
    dealt = dealt.withColumn("_range", range_of(F.struct("doc_id", F.col("_h").alias("h")), F.col("cuts"), len(cuts))).drop("cuts")
    lasts = dealt.groupBy("_range").agg(F.max(F.struct("doc_id", F.col("_h").alias("h"))).alias("k")).orderBy("_range").collect()
    before = [(lasts[i - 1].k.doc_id, lasts[i - 1].k.h, r["_range"]) for i, r in enumerate(lasts)]
    before = spark.createDataFrame(before, "_last long, _h long, _to int")
    same = F.col("doc_id").eqNullSafe(F.col("_last"))
    copies = dealt.drop("_range").join(F.broadcast(before), "_h").filter(same)  # a row a range
    copies = copies.groupBy("_to", "_last", "_h").agg(F.max("text").alias("text"))
    copies = copies.select(F.col("_last").alias("doc_id"), "text", "_h", F.col("_to").alias("_range"), F.lit(True).alias("_ghost"))
    return dealt.select("doc_id", "text", "_h", "_range", F.lit(False).alias("_ghost")).union(copies)


def edited_texts(docs: DataFrame) -> DataFrame:
    """_range, _place, doc_id, text, n_chars, cut (characters replaced), edited. Place 1 of a range is the copy."""
    order = W.Window.partitionBy("_range").orderBy(F.desc("_ghost"), F.col("doc_id").asc_nulls_first(), "_h", F.col("text").asc_nulls_first())
    rows = in_ranges(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("_range", "doc_id", "text", F.row_number().over(order).alias("_place"), F.coalesce(F.lag("text").over(order), F.lit("")).alias("next"))
    n = F.length("text").cast("long")
    rows = rows.withColumn("n_chars", n).withColumn("half", F.floor(n / 2).cast("int"))
    stays = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("half"))
    return rows.withColumn("stays", stays).withColumn("comes", F.substring("next", F.lit(1), F.col("half")))


def weighted_terms(rows: DataFrame) -> DataFrame:
    """_range, _place, doc_id, n_chars, kind, term, and the counts x in the text and y in the edited text.

    kind 0: a word, by its 64-bit hash; -1: no word; 1 and more: a piece of the edited text's digest, which goes along.
    The words before the cut are split once for both texts; a word that the cut parts goes with each ending.
    """
    spaced = lambda c: reduce(lambda s, ch: F.replace(s, F.lit(ch), F.lit(" ")), "\t\n\v\f\r", c)
    part = F.substring_index(spaced(F.col("stays")), " ", -1)
    rows = rows.withColumn("a", spaced(F.col("stays"))).withColumn("part", part)
    goes = F.substring("text", F.length("stays") + 1, F.col("half"))
    rows = rows.select(
        "_range", "_place", "doc_id", "n_chars", F.sha2(F.concat("stays", "comes"), 256).alias("digest"),
        F.split(F.substring("a", F.lit(1), F.length("a") - F.length("part")), " ").alias("both"),
        F.split(F.concat("part", spaced(goes)), " ").alias("old"), F.split(F.concat("part", spaced(F.col("comes"))), " ").alias("new"),
    )
    k = len(PIECES)
    rows = rows.withColumn("n0", F.size("both") + k).withColumn("n1", F.size("both") + k + F.size("old"))
    words = F.concat(F.array(*[F.substring("digest", b, n) for b, n in PIECES]), F.col("both"), F.col("old"), F.col("new"))
    told = rows.select("_range", "_place", "doc_id", "n_chars", "n0", "n1", F.posexplode(words).alias("i", "w"))
    kind = F.when(F.col("i") < k, F.col("i") + 1).when(F.col("w") == "", -1).otherwise(0)
    term = F.when(F.col("i") < k, F.conv("w", 16, 10).cast("long")).otherwise(F.xxhash64("w"))
    x, y = (F.col("i") < F.col("n1")).cast("int"), ((F.col("i") < F.col("n0")) | (F.col("i") >= F.col("n1"))).cast("int")
    told = told.select("_range", "_place", "doc_id", "n_chars", kind.alias("kind"), term.alias("term"), x.alias("x"), y.alias("y"))
    return told.groupBy("_range", "_place", "doc_id", "n_chars", "kind", "term").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


PIECES = [(1, 15), (16, 15), (31, 15), (46, 15), (61, 4)]  # of a digest's 64 hexadecimal digits


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint of each row of docs."""
    terms = weighted_terms(edited_texts(docs))
    side = lambda s, w: F.struct(F.lit(s).alias("side"), w.alias("weight"))
    x, y = F.col("x"), F.col("y")
    sides = F.when(x == y, F.array(side(2, x))).when(y == 0, F.array(side(0, x))).when(x == 0, F.array(side(1, y))).otherwise(F.array(side(0, x), side(1, y)))
    keys = ["_range", "_place", "doc_id", "n_chars"]
    weighed = terms.select(*keys, "kind", "term", F.explode(sides).alias("s")).select(*keys, "kind", "term", "s.side", F.log(F.col("s.weight").cast("double")).alias("lw"))
    gamma = gamma_quantiles().tolist()
    tables = docs.sparkSession.createDataFrame([(s, gamma, [math.log(g) for g in gamma]) for s in range(3)], "side int, gammas array<double>, logs array<double>")
    weighed = weighed.join(F.broadcast(tables), "side")  # three rows: the tables as columns, not as literals of each expression
    word = F.col("kind") == 0
    piece = [F.max(F.when(F.col("kind") == k + 1, F.col("term"))).alias(f"d{k}") for k in range(len(PIECES))]
    least = [F.min(F.when(word, sample_key(F.col("term"), F.col("lw"), k, F.col("gammas"), F.col("logs")))).alias(f"m{k}") for k in range(SAMPLES)]
    mins = weighed.groupBy(*keys, "side").agg(*least, *piece)
    of = lambda k, s: F.min(F.when(F.col("side").isin(2, s), F.col(f"m{k}")))
    both = mins.groupBy(*keys).agg(*[of(k, s).alias(f"f{s}_{k}") for s in (0, 1) for k in range(SAMPLES)], *[F.max(f"d{k}").alias(f"d{k}") for k in range(len(PIECES))])
    sample = lambda c: F.lower(F.hex(c.bitwiseAND(F.lit((1 << ID_BITS) - 1).cast("long"))))
    printed = lambda s: F.when(F.col(f"f{s}_0").isNull(), F.lit(NOTHING)).otherwise(F.concat_ws(",", *[sample(F.col(f"f{s}_{k}")) for k in range(SAMPLES)]))
    digest = F.concat(*[F.lpad(F.lower(F.hex(f"d{k}")), n, "0") for k, (_, n) in enumerate(PIECES)])
    rows = both.select("_range", "_place", "doc_id", "n_chars", digest.alias("edited_sha256"), printed(0).alias("fingerprint"), printed(1).alias("edited_fingerprint"))
    after = F.lag("fingerprint").over(W.Window.partitionBy("_range").orderBy("_place"))
    return rows.withColumn("next_fingerprint", after).filter("_place > 1").drop("_range", "_place")


def likeness(a, b):
    """The share of equal samples of two fingerprints."""
    x, y = F.split(a, ","), F.split(b, ",")
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return F.when((a == NOTHING) | (b == NOTHING), (a == b).cast("double")).otherwise(same / F.lit(float(SAMPLES)))

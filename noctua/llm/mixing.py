"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Each source has a weight and a size in words. All sizes together are shared out by weight; a source that would get
more than `cap` times its size is clamped there and its excess goes to the others by weight, until none is above. A
source whose target is r times its size gives floor(r) whole repetitions of each document, and one more of a seeded
part: documents in the order of a seeded hash, up to the place where their words come nearest to what is missing.

Null and empty texts have size 0. Documents without a source form a source of their own, the last in order. A source
of size 0 has target 0. Rows with the same doc_id and text, or with a null doc_id and the same text,
have one hash and are taken one by one, in the order they are stored in. An empty table gives an empty result. Sources
are grouped with map-side sums, so one may hold any share of the rows; the place in the hash order is found among
BUCKETS sums a source, then among the rows of one bucket. Columns of docs may have any names, those used here too. A
text of any length is counted in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noctua.llm.shared import SPACE, running_total, stored, tucked, untucked

BUCKETS = 4096
BITS = 60


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long")


def seeded_hash(doc_id, text, seed: int):
    """A whole number below 2**60 from id and text, the same everywhere."""
    parts = F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), *parts)), 1, 15), 16, 10).cast("long")


def source_key(source):
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("~"))


def water_fill(sources: DataFrame, cap: int) -> DataFrame:
    """sources has size and weight, both whole; adds target. Each round brings two sums to the driver."""
    big = lambda c: c.cast("decimal(38,0)")
    total, weight = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    clamped, left = 0, weight
    while True:
        over = big(F.col("weight")) * F.lit(total - clamped).cast("decimal(20,0)") > big(F.col("size") * cap) * F.lit(left).cast("decimal(20,0)")
        row = sources.agg(F.coalesce(F.sum(F.when(over, F.col("size") * cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if (row[0], row[1]) == (clamped, left):
            break
        clamped, left = row
    share = F.col("weight").cast("double") * F.lit(float(total - clamped)) / F.lit(float(left or 1))
    return sources.withColumn("target", F.when(over | F.lit(left == 0), (F.col("size") * cap).cast("double")).otherwise(share))


def source_targets(sizes: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """source, key, size, weight, target of each source; sizes has source and size. Weights repeat in order of code points, null last."""
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("size")).withColumn("one", F.lit(1))
    ranked = running_total(grouped, [F.col("source").asc_nulls_last()], "one", "rank", "sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    weighed = stored(ranked.select("source", source_key(F.col("source")).alias("key"), "size", weight.alias("weight")), "weights")
    return water_fill(weighed, cap)


def mixing_plan(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(thin, plan). thin: doc_id, key, size, h, row of every document; plan: a row a source with target, whole, cut_h,
    cut_row, and of the equal rows at cut_h how many are taken once more (cut_n) of how many (cut_of)."""
    h = seeded_hash(F.col("doc_id"), F.col("text"), seed)
    thin = docs.select("doc_id", "source", source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), h.alias("h"))
    thin = stored(thin.withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = source_targets(thin, weights, cap)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("size"))
    targets = stored(targets, "targets")

    step = 1 << (BITS - BUCKETS.bit_length() + 1)
    bucket = F.floor(F.col("h") / F.lit(step)).cast("int")
    sums = thin.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.Window.partitionBy("key").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    edges = sums.withColumn("before", before).join(targets.select("key", "need"), "key")
    edges = edges.filter((F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("words")))
    rows = thin.withColumn("bucket", bucket).join(edges.drop("words"), ["key", "bucket"])
    inside = W.Window.partitionBy("key").orderBy("h", "row").rowsBetween(W.Window.unboundedPreceding, -1)
    rows = rows.withColumn("had", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    last = F.max(F.when(F.col("had") + F.col("size") / 2 < F.col("need"), F.struct("h", "row")))
    cuts = rows.groupBy("key").agg(last.alias("last"), F.first("bucket").alias("bucket"))
    cuts = cuts.select("key", F.coalesce("last.h", F.col("bucket") * F.lit(step) - 1).alias("cut_h"), F.coalesce("last.row", F.lit(-1)).alias("cut_row"))
    cuts = stored(cuts, "cuts")
    at = thin.join(cuts, "key").filter("h = cut_h").groupBy("key").agg(F.count_if(F.col("row") <= F.col("cut_row")).alias("cut_n"), F.count("*").alias("cut_of"))
    return thin, stored(targets.join(cuts, "key", "left").join(at, "key", "left"), "plan")


def mix_sizes(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, seed: int = 17) -> DataFrame:
    """A row a document: doc_id, size, source_size, target (of its source), repetitions, taken (words)."""
    thin, plan = mixing_plan(docs, weights, cap, seed)
    plan = plan.select("key", F.col("size").alias("source_size"), "target", "whole", "cut_h", "cut_row")
    once_more = (F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("row") <= F.col("cut_row")))
    out = thin.join(plan, "key").withColumn("repetitions", F.col("whole") + F.when(once_more, 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", "repetitions", (F.col("size") * F.col("repetitions")).alias("taken"))


def mix(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: each document as many times as the plan takes it, with the columns it had. One pass over the texts more."""
    _, plan = mixing_plan(docs, weights, cap, seed)
    parted = not plan.filter("cut_n < cut_of").isEmpty()
    rows = tucked(docs, ["doc_id", "source", "text"])
    keyed = rows.withColumn("key", source_key(F.col("source"))).withColumn("h", seeded_hash(F.col("doc_id"), F.col("text"), seed))
    joined = keyed.join(plan.select("key", "whole", "cut_h", "cut_n", "cut_of"), "key")
    split = (F.col("h") == F.col("cut_h")) & (F.col("cut_n") < F.col("cut_of"))
    clear = joined.filter(~F.coalesce(split, F.lit(False))) if parted else joined
    more = F.when((F.col("h") < F.col("cut_h")) | (F.col("h") == F.col("cut_h")), 1).otherwise(0)
    counted = clear.withColumn("n", (F.col("whole") + more).cast("int"))
    if parted:  # of rows with one id and text, the first ones as they come are taken once more
        ties = stored(joined.filter(split).withColumn("part", F.spark_partition_id()), "ties")
        before = W.Window.partitionBy("key").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
        bases = ties.groupBy("key", "part").count().select("key", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
        nth = F.col("base") + F.row_number().over(W.Window.partitionBy("key", "part").orderBy("h"))
        ranked = ties.join(bases, ["key", "part"]).withColumn("n", (F.col("whole") + F.when(nth <= F.col("cut_n"), 1).otherwise(0)).cast("int"))
        counted = counted.unionByName(ranked.select(counted.columns))
    repeated = counted.filter("n > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("n"))))
    return untucked(repeated, docs, ["doc_id", "source", "text"])

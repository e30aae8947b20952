"""Results that do not depend on how rows are dealt, and sources whose rows share one id."""

import random

import numpy as np
import pytest

from noctua.llm import toxicity
from noctua.llm.mixing import mix, mix_sizes
from noctua.llm.queries import QUERIES
from tests.llm.test_any_table import all_maximal


def test_toxicity_by_partitions(spark):
    set_, found = lambda n: spark.conf.set("spark.sql.shuffle.partitions", n), []
    for n in ("4", "11"):
        set_(n)
        found.append(sorted(QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.01").collect()))
    set_("4")
    assert found[0] == found[1]


def test_segments_of_both_signs():
    random.seed(4)
    for _ in range(200):
        x = [random.choice([-2.0, -0.5, 1.0, 2.5, -0.25]) for _ in range(random.randrange(30))]
        at = np.array([i for i, v in enumerate(x) if v != -0.25], int)
        assert [(a, b) for a, b, _ in toxicity.segments(at, np.array([x[i] for i in at]), -0.25)] == all_maximal(x)


@pytest.mark.parametrize("texts", ["same", "own"])
def test_mixing_without_ids(spark, texts):
    word = lambda i: "w" if texts == "same" else f"w{i}"
    rows = [(None, f"{word(i)} " * 10, "a") for i in range(400)] + [(i, f"{word(i)} " * 10, "b") for i in range(300)] + [(7, f"{word(i)} " * 10, "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    taken = {r.key: (r.taken, r.target) for r in mix_sizes(docs).groupBy("source_size", "target").agg({"taken": "sum"}).toDF("s", "target", "taken").selectExpr("target as key", "taken", "target").collect()}
    assert sorted(round(t) for _, t in taken.values()) == [1667, 3333, 5000]
    assert all(abs(a - b) <= 10 for a, b in taken.values())
    mixed = {r.source: r["n"] * 10 for r in mix(docs).groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert sorted(mixed.values()) == sorted(a for a, _ in taken.values())

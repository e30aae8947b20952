"""Importance resampling against a plain count, weight and sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from noctua.llm import resampling as r
from tests.llm.test_edges import docs_rows

SCHEMA = "doc_id long, text string, score string, n_words int, rank string"


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


def plain(docs, target, percent, least):
    s, t = Counter(), Counter()
    for _, text in docs:
        s += grams(text)[1]
    for text in target:
        t += grams(text)[1]
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10000) / ((s[b] + 1.0) * (t.total() + 10000)))) for b in s | t}
    out = []
    for doc_id, text in docs:
        n, g = grams(text)
        weight = sum(gain[b] * k for b, k in g.items())
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, g.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for i, x in enumerate(able):
        x[4] = i + 1 if i < percent * len(able) // 100 else None
    return [tuple(x[:4]) + (x[4] or None,) for x in out]


@pytest.mark.parametrize(("percent", "least"), [(0, 0), (5, 20), (40, 1), (100, 0)])
def test_same_as_plain(spark, monkeypatch, percent, least):
    monkeypatch.setattr(r, "RUN_WORDS", 50)
    random.seed(2)
    words = "red Green blue naïve x1 kite λόγος zoo-keeper".split()
    docs = [(d, t) for d, t, *_ in docs_rows()] + [(500 + i, " ".join(random.choice(words) for _ in range(random.randrange(40)))) for i in range(150)]
    docs += [(900, "red kite " * 20)] * 5 + [(None, "red kite " * 20)] * 3  # ties of repeated rows
    target = ["red kite blue kite", None, "", "λόγος red"]
    df = spark.createDataFrame([(d, t, "s", 1, "q") for d, t in docs], SCHEMA).repartition(5)
    got = r.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, least).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(docs, target, percent, least), key=str)


def test_empty_target_and_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert r.resample(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b", "s", 1, "q")], SCHEMA)
    assert r.resample(some, none, 100, 0).select("n_features", "rank").collect() == [(3, 1)]

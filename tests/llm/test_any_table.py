"""Clashing column names, far ids, very long single words; methods against brute force."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noctua.llm import fingerprints, near_dedup, pii, topk, toxicity
from noctua.llm.shared import quoted

CLASH = ["toxicity", "passages", "spans", "Sanitised", "_key", "_rest", "_toxicity", "key", "n", "copy", "a.b", "h", "whole"]


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(40)]
    for i in range(0, 40, 4):  # near copies: one word of sixty differs
        w = texts[i].split()
        w[-1] = "other"
        texts[i + 1] = " ".join(w)
    texts[30] += " mail me at a.b@c.org or +1 555 123 4567"
    rows = [(i, t, f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(40, None, None, None), (41, "", "s0", 0), (None, "no id", "s1", 5), (0, texts[0], "s0", len(texts[0])), (50, "x" * 300_000, "s2", 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASH])
    folder = str(tmp_path_factory.mktemp("clash"))
    spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, folder, rows


def components(rows, words, percent):
    sets = {i: near_dedup.shingles(t, words) for i, t, *_ in rows if i is not None and t}
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    return label


def test_stages_keep_any_columns(spark, clashing):
    """Each stage against a plain version: what it keeps, what it changes, and that all other columns stay as they were."""
    docs, folder, rows = clashing
    stages = dict(corpus_pipeline.STAGES)
    ids = Counter(r[0] for r in rows)
    for name in ("toxicity", "near_dedup", "pii", "mixing"):
        got = stages[name](spark, docs, folder)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema], name
        kept = got.collect()
        for r in kept:
            assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for c in CLASH), name
        found = Counter(r.doc_id for r in kept)
        if name == "toxicity":
            assert found == ids  # nothing here tells toxic from clean
        elif name == "near_dedup":
            label = components(rows, 5, 80)
            assert found == Counter({i: 1 for i in ids if i is None or label.get(i, i) == i})
            assert len(found) < len(ids)
        elif name == "pii":
            assert found == ids
            text = {r.doc_id: r.text for r in kept}
            assert text[30].endswith("mail me at [EMAIL] or [PHONE]") and text[40] is None and text[50] == "x" * 300_000
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
        else:
            size = lambda s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s)
            words = Counter()
            for r in kept:
                words[r.source] += len((r.text or "").split())
            whole = sum(map(size, ("s0", "s1", "s2", None)))
            assert sum(words.values()) == pytest.approx(whole, rel=0.1)
            assert all(n <= 3 * ids[i] for i, n in found.items())
    assert stages["packing"](spark, docs.select(*map(quoted, docs.columns)), folder).count() >= len(rows)


def test_setting_of_the_pipeline_loses_no_link(spark):
    """Five words, 80 %: every linked pair of 300 near copies is found."""
    rng = random.Random(9)
    rows = []
    for g in range(100):
        base = [f"g{g}w{i}" for i in range(100)]
        for k in range(3):
            w = list(base)
            for at in rng.sample(range(100), rng.choice([0, 1, 2, 3, 4])):
                w[at] = f"x{rng.randrange(10**6)}"
            rows.append((g * 3 + k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    want = {}
    for g in range(100):
        want |= components(rows[3 * g : 3 * g + 3], 5, 80)
    assert got == want


def all_maximal(x):
    """The best scoring run, the shortest of equal ones, then the same to its left and right."""
    best = max(((sum(x[i : j + 1]), i - j, i, j) for i in range(len(x)) for j in range(i, len(x))), default=(0,))
    if best[0] <= 1e-12:
        return []
    _, _, i, j = best
    return all_maximal(x[:i]) + [(i, j)] + [(a + j + 1, b + j + 1) for a, b in all_maximal(x[j + 1 :])]


def test_all_segments_are_maximal():
    rng = random.Random(1)
    for _ in range(800):
        x = [rng.uniform(0.1, 3) if rng.random() < 0.4 else -0.37 for _ in range(rng.randrange(1, 26))]
        at = np.array([i for i, v in enumerate(x) if v > 0], int)
        assert [(a, b) for a, b, _ in toxicity.segments(at, np.array([v for v in x if v > 0]), -0.37)] == all_maximal(x)


def test_long_texts_take_linear_time():
    began = time.process_time()
    for n in (200_000, 400_000):
        toxicity.segments(np.cumsum(np.full(n // 4, 40)), np.full(n // 4, 0.5), -0.05)
        for text in ("a" * n + "@", "1" * n + ".", "a@" * n, "1.2.3" * n, "+1" * n, "4" * n):
            pii.base_spans(text)
            pii.without_spans(text)
    assert time.process_time() - began < 120  # square time would be hours


def test_base_spans_of_runs():
    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choice(["a@b.co", "@", "..", ".", "1.2.3.4", "1.2", "7", "ab", "a.b@", "+", "-", " ", "é"]) for _ in range(rng.randrange(14)))
        assert pii.base_spans(t) == [(k, m.start(), m.end()) for k, p in pii.PATTERNS.items() for m in re.finditer(p, t) if pii.valid(k, m.group())]


def test_bounds_prune(spark):
    """Vectors without any structure: most pairs never meet exactly, and the result is that of all products."""
    rng = np.random.default_rng(0)
    m = rng.normal(size=(3000, 64))
    m = np.floor(256 * m / np.linalg.norm(m, axis=1, keepdims=True))
    ids = np.arange(len(m))
    q = ids % 50 == 0
    block = topk.Block(ids[q], m[q], topk.turned(m.T @ m), topk.floors(ids[q], m[q], ids[:1500], m[:1500], 5), 5)
    for at in range(0, len(m), 512):
        block.meet(ids[at : at + 512], m[at : at + 512])
    assert block.exact < 0.1 * block.tested
    for i, k in enumerate(ids[q]):
        score = m @ m[k]
        score[k] = -np.inf
        assert block.best_ids[i].tolist() == np.lexsort((ids, -score))[:5].tolist()


def test_many_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.floor(rng.normal(size=6) * 9)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in topk.top_k(df, df.filter("vec_id < 10"), 2).collect()}
    for i in range(10):
        best = sorted((-sum(a * b for a, b in zip(rows[i][1], v, strict=True)), j) for j, v in rows if j != i)[:2]
        assert [got[i, 1], got[i, 2]] == [j for _, j in best]


def jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / sum((x | y).values())


def test_likeness_is_generalised_jaccard(spark):
    """Weighted words, short and long texts: the mean error is near 0, and no pair is far off. One id lies far from the others."""
    rng = random.Random(7)
    texts = []
    for i in range(120):
        n = 4000 if i % 30 < 2 else 40
        texts.append(" ".join(f"p{i // 2}w{int(rng.paretovariate(0.8)) % n}" for _ in range(n)))
        if i % 2:  # shares a part with the text before
            w = texts[-2].split()
            texts[-1] = " ".join(w[: rng.randrange(1, len(w))] + texts[-1].split()[: len(w) // 4])
    rows = [(i if i else 10**15, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).withColumn("near", fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint"))).collect()}
    order = sorted(dict(rows))
    error = []
    for k, i in enumerate(order):
        mine, after = dict(rows)[i], dict(rows)[order[k - 1]]
        h = len(mine) // 2
        assert got[i].edited_sha256 == hashlib.sha256((mine[: len(mine) - h] + after[:h]).encode()).hexdigest()
        error.append(got[i].near - jaccard(mine, after))
    assert abs(np.mean(error)) < 0.02 and np.abs(error).max() < 0.32


def test_ranges_are_even(spark):
    """One far id, and a third of the rows without any: no range holds more than a few shares of the rows."""
    rows = [(10**15 if i == 0 else None if i % 3 == 0 else i, f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = [r["count"] for r in fingerprints.in_ranges(df).groupBy("_range").count().collect()]
    assert len(sizes) > 16 and max(sizes) < 6 * 3000 / len(sizes)

"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns: each operator gives its defined result."""

import random
from collections import Counter

import numpy as np
import pytest

from noctua.llm import queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, extra string"
LONG = " ".join(f"w{i % 977}" for i in range(30000))


def docs_rows():
    random.seed(3)
    base = [" ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(random.randrange(40)) for _ in range(60)) for _ in range(6)]
    rows = [(i, base[i % 6], "en", f"s{i % 4}") for i in range(24)]
    rows += [(100 + i, base[i] + " tail", "en", "s0") for i in range(6)]
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, "  \t\n ", "en", None), (203, "one", "en", "s9"), (204, "ONE", "en", "s9"), (205, LONG, "en", "s2"), (203, "one", "en", "s9"), (None, base[0], "en", "s1"), (206, "naïve Ünïcode ⓿ text\0zero 🙂🙂", "fr", "é")]
    return [(i, t, lang, s, len(t or ""), 7, "x") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(docs_rows(), DOCS).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(24)] + [(None, 1, 1), (200, 0, None), (203, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    pages = [(1, "https://A.Example.com/en/7x?y=/en/", "h"), (2, None, None), (3, "no scheme", "h"), (4, "http://spam-farm.example.org/fr/1", "h"), (5, "http://x.net/de/1", "h"), (6, "http://a.example.net/de/8#f", "h"), (6, "http://a.example.net/de/8#f", "h"), (7, "://com/en/", "h"), (8, "ftp://xcom/en/1", "h"), (None, "http://b.org/es/", "h"), (9, "http://", "h")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=8).tolist(), 0) for i in range(60)] + [(100, [1.0] * 8, 0), (101, [1.0] * 8, 0), (150, None, 0), (151, [None] * 8, 0), (152, [float("nan")] * 8, 0), (153, [float("inf")] + [0.0] * 7, 0), (154, [], 0), (155, [0.5] * 5, 0), (None, [1.0] * 8, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(0, base_text()), (1, None), (2, "naïve text")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def base_text():
    return docs_rows()[0][1]


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "pages", "embeddings", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_empty_tables(spark, empty, name):
    assert q.QUERIES[name](spark, empty).count() == 0


def rows(spark, name, sf):
    return [r.asDict() for r in q.QUERIES[name](spark, sf).collect()]


def all_docs():
    return [(r[0], r[1] or "") for r in docs_rows()]


def test_mixing(spark, sf):
    got = rows(spark, "op1_mixing", sf)
    assert len(got) == len(all_docs())
    total = sum(r["size"] for r in got)


    targets = {(r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in targets) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-6 for s, t in targets)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert got and sorted(map(str, got)) == sorted(map(str, rows(spark, "op1_mixing", sf)))


def test_license_counts(spark, sf):
    got = rows(spark, "op2_license_scan", sf)
    import re

    words = Counter((i, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))) for i, t in all_docs())
    assert Counter((r["doc_id"], r["n_words"]) for r in got) == words
    assert all(r["n_base"] == 0 and r["first_word"] is None and r["base_labels"] == "" for r in got)


def test_fingerprints(spark, sf):
    import hashlib

    got = rows(spark, "op3_fingerprints", sf)
    order = sorted(all_docs(), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[k - 1][1]
        h = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(want)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert by[200]["fingerprint"] == by[201]["fingerprint"] == by[202]["fingerprint"] == "-"
    assert by[0]["fingerprint"] == by[6]["fingerprint"] != by[1]["fingerprint"]
    assert by[201]["near_next"] == 1


def test_url_rules(spark, sf):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(spark, "op4_url_filter", sf)}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("spam-farm.example.org", "/fr/1", None, "block")
    assert got[5][2:] == ("net/de/", "block")
    assert got[6][2:] == ("example.net/de/8", "block")
    assert got[7] == ("com", "/en/", "com/en/", "block")
    assert got[8] == ("xcom", "/en/1", None, "allow")
    assert got[None][2:] == ("org/es/", "block")


def test_near_dedup(spark, sf):
    got = rows(spark, "op5_near_dedup", sf)
    assert len(got) == len(all_docs())
    sets = {}
    for i, t in all_docs():
        w = t.encode().lower().split()
        if i is not None and w:
            sets.setdefault(i, set()).add(frozenset(b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and any(100 * len(a & b) >= 85 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for r in got:
        i = r["doc_id"]
        assert r["component_id"] == (None if i is None else root(i) if i in sets else i)
        assert r["kept"] == (i is None or r["component_id"] == i)


def brute_ids(end):
    from tokenizers import Tokenizer

    from noctua.llm.tokens import tokenizer_file

    t = Tokenizer.from_file(tokenizer_file())
    return [(i, t.encode(x, add_special_tokens=False).ids + [end]) for i, x in all_docs()]


def crc(ids):
    import zlib

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, sf):
    got = rows(spark, "op6_token_files", sf)
    want = brute_ids(1)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), crc(x)) for i, x in want)
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids)


def test_packing(spark, sf):
    got = rows(spark, "op8_packing", sf)
    want = Counter((i, k // 2048, k, len(x[k : k + 2048]), crc(x[k : k + 2048])) for i, x in brute_ids(0) for k in range(0, len(x), 2048))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048


def test_pii_odd(spark, sf):
    got = rows(spark, "op7_pii", sf)
    assert len(got) == len(all_docs()) and all(r["spans"] == "" for r in got)


def test_toxicity_odd(spark, sf):
    got = rows(spark, "op9_toxicity", sf)
    assert len(got) == len(all_docs())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] is not None for r in got)


def test_top_k(spark, sf):
    vectors = [(r.vec_id, [np.floor(256 * float(np.float32(x))) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]
    got = {}
    for r in rows(spark, "op10_topk_search", sf):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i, _ in vectors if i % 50 == 0}
    for i, v in vectors:
        if i % 50 == 0:
            s = sorted((-int(sum(a * b for a, b in zip(v, w, strict=False))), j) for j, w in vectors if j != i)[:5]
            assert sorted(got[i]) == [(k + 1, j, -x) for k, (x, j) in enumerate(s)]


def test_pipeline_odd(spark, sf, empty):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.count()
    assert p.run(spark, sf).count() > 0
    assert p.run(spark, empty).count() == 0


def test_one_row(spark, tmp_path):
    spark.createDataFrame([(5, "a lone text", "en", "s", 11, 0, "")], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    r = rows(spark, "op3_fingerprints", str(tmp_path))[0]
    assert (r["near_edited"], r["near_next"]) != (None, None) and r["near_next"] == 1

"""Repeated passages against every window of every text; suffix order and factors against plain sorting."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from noctua.llm import repeats as p
from noctua.llm.suffixes import SuffixOrder
from tests.llm.test_edges import docs_rows


@pytest.mark.parametrize(("length", "signs", "size"), [(1, 2, 50), (5, 2, 300), (12, 2, 700), (40, 2, 900), (200, 1, 900), (200, 3, 3000), (230, 2, 1200)])
def test_factors(length, signs, size):
    rng = np.random.default_rng(length)
    raw = rng.integers(97, 97 + signs, size).astype(np.uint8)
    raw[size // 2 : size // 2 + size // 4] = raw[size // 4 : size // 4 + size // 4]
    at = np.sort(rng.choice(size - length + 1, (size - length + 1) * 3 // 4, replace=False))
    s, whole = SuffixOrder(raw, at, length), raw.tobytes()
    windows = [whole[i : i + length] for i in at]
    assert s.order.tolist() == sorted(range(len(at)), key=lambda i: (windows[i], i))
    place = np.argsort(s.order)
    want = []
    for i, w in enumerate(windows):
        shared = [next((k for k in range(length) if w[k] != x[k]), length) for x in windows[:i]]
        want.append(max(shared, default=0))
        for near, side in ((s.previous[i], s.order[: place[i]][::-1]), (s.next[i], s.order[place[i] + 1 :])):
            assert near == next((j for j in side if j < i), -1)
    assert s.longest_previous_factors().tolist() == want
    later, first = s.repeated()
    assert later.tolist() == [f == length for f in want]
    assert first.tolist() == [windows.index(w) == i and windows.count(w) > 1 for i, w in enumerate(windows)]


def plain(docs, length, keep_first):
    places, raws = defaultdict(list), [(t or "").encode() for _, t in docs]
    ranked = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, hashlib.sha256(raws[i]).digest()))
    copies = {(d, r): i for i, ((d, _), r) in reversed(list(enumerate(zip(docs, raws, strict=True))))}  # rows equal in both: one document
    same = [copies[docs[i][0], raws[i]] for i in range(len(docs))]
    for i in ranked:
        if not keep_first or same[i] == i:
            for at in range(len(raws[i]) - length + 1):
                places[raws[i][at : at + length]].append((i, at))
    gone = [set() for _ in docs]
    for found in places.values():
        for k, (i, at) in enumerate(found):
            if len(found) > 1 and (k or not keep_first):
                gone[i].update(range(at, at + length))
    out = []
    for i, (d, _) in enumerate(docs):
        g, raw = gone[same[i]] if keep_first else gone[i], raws[i]
        kept = bytes(b for at, b in enumerate(raw) if at not in g)
        out.append((d, len(raw), len(g), sum(at - 1 not in g for at in g), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def some_docs():
    random.seed(8)
    signs = "ab é🙂"
    lines = ["".join(random.choice(signs) for _ in range(random.randrange(10, 90))) for _ in range(25)]
    docs = [(i, "".join(random.choice(lines) for _ in range(random.randrange(12)))) for i in range(80)]
    docs += [(100 + i, "shared passage of many documents, " * 2 + f"{i}" * random.randrange(30)) for i in range(60)]  # a hot key
    docs += [(300, "z" * 700), (301, "xy" * 300), (302, "xy" * 200 + "q"), (None, docs[3][1]), (None, docs[3][1]), (5, docs[5][1]), (5, docs[6][1]), (None, None), (303, "")]
    return docs + [(1000 + (r[0] or 0), (r[1] or "")[:800]) for r in docs_rows()]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("hot", [p.HOT_BYTES, 600])
def test_same_as_every_window(spark, monkeypatch, keep_first, hot):
    monkeypatch.setattr(p, "HOT_BYTES", hot)
    monkeypatch.setattr(p, "SORT_BYTES", 2000)
    docs = some_docs()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, digest string, key int").repartition(5)
    got = p.repeated_bytes(df, 40, keep_first, with_kept=True)
    rows = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got.collect()), key=str)
    want = plain(docs, 40, keep_first)
    assert sum(r[2] for r in want) > 5000
    assert rows == want


def test_blocks_of_long_texts(spark, monkeypatch):
    rng = random.Random(1)
    some = "".join(chr(rng.randrange(97, 123)) for _ in range(5000))
    docs = [(1, some), (2, "!" * 50 + some[3000:3600] + "?" * 50), (3, some[:199] + "#" + some[:200])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain(docs, 200, False)
    for block in (p.BLOCK_BYTES, 700):
        runs = [p.window_runs([some.encode()[at : at + block + 199]], 200) for at in range(0, 4801, block)]
        assert sum(int(r[2].sum()) for r in runs) == 4801  # each window once
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in p.repeated_bytes(df, 200, False).collect()]
    assert sorted(got, key=str) == [r[:5] for r in want]

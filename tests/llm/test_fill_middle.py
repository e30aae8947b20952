"""Ropes against plain strings: cut at any unit and code point, rearranged, rebuilt."""

import hashlib
import random
import re

import pytest

from noctua.llm import fill_middle as f
from noctua.llm.queries import QUERIES
from tests.llm.test_edges import docs_rows, empty, sf  # noqa: F401

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts():
    random.seed(5)
    signs = ["a", "bc", "é", "🙂", " ", "\n", "\t ", "\0", "<", "P", "\x0b", " "]
    return ["", " ", "a", "  a", "a ", "\n\n"] + ["".join(random.choice(signs) for _ in range(random.randrange(1, 1500))) for _ in range(60)]


def depth_of(r):
    return r.depth if r else 0


def test_cut_anywhere():
    for text in texts():
        units, raw = UNIT.findall(text), text.encode()
        tree = f.rope(raw)
        assert (tree.units if tree else 0) == len(units) and (tree.chars if tree else 0) == len(text)
        assert depth_of(tree) <= max(1, len(units) // f.LEAF_UNITS + 1).bit_length()
        for rank in {0, 1, len(units) // 3, len(units)} if tree else ():
            a, b = tree.split("units", rank)
            assert (f.flat(a).decode(), f.flat(b).decode()) == ("".join(units[:rank]), "".join(units[rank:]))
            assert (a.chars if a else 0, b.units if b else 0) == (len("".join(units[:rank])), len(units) - rank)
        for place in {0, 1, len(text) // 2, len(text)} if tree else ():
            a, b = tree.split("chars", place)
            assert (f.flat(a).decode(), f.flat(b).decode()) == (text[:place], text[place:])


def plain(doc_id, text, rate=50, spm=80):
    """(n, form, code points of prefix and middle, output) as the contract says it."""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_query_on_odd_rows(spark, sf):  # noqa: F811
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d, t, *_ in docs_rows():
        n, form, p, m, out = plain(d, t or "")
        want.append((d, n, form, p, m, sha(out), sha(t or "")))
    got = [tuple(r) for r in QUERIES["op11_fill_middle"](spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("spm", [0, 100])
def test_every_text_and_clashing_names(spark, spm):
    rows = [(i, t, "u", 1) for i, t in enumerate(texts())] + [(900, "holds <S> itself", "u", 1), (None, None, "u", 1), (None, "x y", "u", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Output string, units int")
    made = f.fill_middle(docs, rate=100, spm_rate=spm)
    assert made.columns == ["doc_id", "text", "Output", "units", "units_", "form", "prefix_chars", "middle_chars", "output_"]
    for r in f.fill_middle_inverted(made, output="output_").collect():
        assert r.restored == (r.text or "") and (r["units_"], r.form, r.prefix_chars, r.middle_chars, r["output_"]) == plain(r.doc_id, r.text or "", 100, spm)
        assert (r.form == "plain") == (not r.text or any(s in r.text for s in ("<P>", "<S>", "<M>")))

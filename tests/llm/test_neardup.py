import random
import re

import numpy as np
import pytest

from huddle.llm import neardup
from huddle.llm.common import components
from huddle.llm.shingles import sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    """doc_id -> (size, component), comparing all pairs."""
    rows = [(d, shingles(t)) for d, t, *_ in rows if d is not None]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(d, len(s), find(d)) for d, s in rows}


def test_sets_sizes(docs_rows):
    texts = [t or "" for _, t, *_ in docs_rows]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    value, at = sets(raw, off)
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]


def test_sketch_fills_and_estimates():
    g = np.random.default_rng(4)
    a = np.unique(g.integers(0, 1 << 62, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:360], g.integers(0, 1 << 62, 40, dtype=np.uint64)]))
    for n in (1, 3, 50, 400):
        s = neardup.sketches(a[:n], np.array([0, n]))
        assert (s != neardup._NONE).all()
    s = neardup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.08


def test_near_duplicates(docs, docs_rows):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(docs_rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute(docs_rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_large_group_in_blocks(spark, monkeypatch):
    """A group of near copies over many blocks: no link lost."""
    r = random.Random(11)
    base = [f"w{r.randrange(10_000)}" for _ in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = f"x{r.randrange(10_000)}"
        rows.append((i, " ".join(w[: len(w) - r.choice([0, 0, 12])])))
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 16)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == brute(rows)


def test_empty(none):
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    want = {(x, find(x)) for x in list(root) if find(x) != x}
    got = {tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == want

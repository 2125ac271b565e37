import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from huddle.llm import ann, licenses, sharding


def brute_nearest(rows, k=10, every=100):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    rows = sorted((i, v) for i, v in rows if len(v) == 8)
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % every == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
            out[i] = sorted((d[j], rows[j][0]) for j in range(len(rows)) if rows[j][0] != i)[:k]
    return out


@pytest.fixture(scope="module")
def vectors():
    g = np.random.default_rng(3)
    rows = [(i, g.normal(size=8).round(3).tolist()) for i in range(600)]
    same = g.normal(size=8).round(3).tolist()
    rows += [(1000 + i, same) for i in range(300)]                      # one very common vector
    rows += [(2000, None), (2100, []), (2200, [0.0] * 8), (2300, [float("nan")] + [1.0] * 7), (2400, [None] + [1.0] * 7),
             (2500, [float("inf")] * 8), (2600, [1.0] * 3), (None, same), rows[0], rows[5]]
    return rows


def test_nearest(spark, vectors):
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, q int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute_nearest(vectors)
    assert set(got) == set(want)
    hit = 0
    for q, near in got.items():
        near.sort()
        assert [x[0] for x in near] == list(range(1, 11))
        assert [x[1:] for x in near] == sorted(x[1:] for x in near)
        hit += len({x[2] for x in near} & {i for _, i in want[q]})
    assert hit >= 0.95 * 10 * len(want)
    assert [(round(s, 12), i) for _, s, i in got[1000]] == [(round(s, 12), i) for s, i in want[1000]]


def test_recall_on_the_given_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    x = np.array([v for _, v in rows], float)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for k, (i, v) in enumerate(rows):
        if i in got:
            d = np.sqrt(((x - x[k]) ** 2).sum(1))
            d[k] = np.inf
            hit += len(got[i] & {rows[j][0] for j in np.argsort(d)[:10]})
            total += 10
    assert hit >= 0.9 * total


def test_recall_beside_a_close_cluster(spark):
    """A third of the vectors are close to each other: the others are still told apart, and so are they."""
    g = np.random.default_rng(8)
    x = g.normal(size=(30_000, 64))
    x[:10_000] = x[0] + 0.1 * g.normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = g.permutation(x)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 300 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == 100
    hit = 0
    for i, near in got.items():
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += len(near & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.95 * 10 * len(got)


def test_nearest_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (200, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect())
    assert [x[:3] for x in got] == [(0, 1, 200), (0, 2, 1), (200, 1, 0), (200, 2, 1)]
    assert ann.nearest(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0


def brute_shards(rows, limit):
    """The directory by splitting buckets one bit at a time."""
    def h(d, t):
        return int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)
    todo, out = [(0, 0, [(h(d, t), len((t or "").encode())) for d, t, *_ in rows])], []
    while todo:
        depth, prefix, own = todo.pop()
        if sum(n for _, n in own) <= limit or depth == 60:
            out.append((depth, prefix, len(own), sum(n for _, n in own)))
            continue
        for bit in (0, 1):
            part = [x for x in own if (x[0] >> (59 - depth)) & 1 == bit]
            if part:
                todo.append((depth + 1, prefix * 2 + bit, part))
    return sorted(out)


@pytest.mark.parametrize("limit", [1 << 40, 3000, 200, 1])
def test_shards(docs, docs_rows, limit):
    got = sharding.shards(docs, limit).collect()
    assert len(got) == len(docs_rows)
    by = {}
    for r in got:
        by.setdefault((r.depth, r.shard.split(".")[0]), []).append(r)
    want = {(d, format(p, f"0{d}b") if d else ""): (n, b) for d, p, n, b in brute_shards(docs_rows, limit)}
    assert {k: (len(v), sum(r.n_bytes for r in v)) for k, v in by.items()} == want
    pages = {}
    for r in got:
        pages.setdefault(r.shard, []).append(r.n_bytes)
    assert all(sum(v) <= limit or len(v) == 1 for v in pages.values())


def test_shards_of_copies(spark):
    """A third of all rows are one row: pages, not one shard over the limit."""
    rows = [(1, "same text " * 10)] * 300 + [(i, "t" * (i % 50)) for i in range(2, 600)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()
    assert len(got) == len(rows)
    pages = {}
    for r in got:
        pages.setdefault(r.shard, []).append(r.n_bytes)
    assert max(map(sum, pages.values())) <= 1000
    assert sum(r.page > 0 for r in got) == 290


def test_shards_empty(none):
    assert sharding.shards(none).count() == 0


def test_licenses(spark):
    r = random.Random(1)
    prose = lambda n: " ".join(r.choice(["alpha", "of", "beta", "the", "gamma", "work", "software"]) for _ in range(n))
    rows = [("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                          "associated documentation files (the Software), to deal in the Software without restriction"),
            ("a/x/1", prose(200)), ("a/x/2", prose(300) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(300)),
            ("a/x/y/3", prose(50)), ("a/x/y/COPYING", "This work is licensed under the GNU General Public License, version 3."),
            ("a/x/y/z/4", prose(2)), ("b/5", prose(20)), ("6", prose(20)), (None, prose(20)), ("a/7", None), ("a/8", ""),
            ("ab/9", prose(10)), ("a/x/1", prose(200)), ("a/x/10", "the software of the work")]
    df = spark.createDataFrame([(i, p, t, "z") for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, own string")
    got = {r.doc_id: (r.license, r.basis, r.from_dir) for r in licenses.scan(df).collect()}
    assert got == {0: ("MIT", "own", None), 1: ("MIT", "inherited", "a"), 2: ("Apache-2.0", "own", None), 3: ("GPL-3.0", "inherited", "a/x/y"),
                   4: ("GPL-3.0", "own", None), 5: ("GPL-3.0", "inherited", "a/x/y"), 6: (None, "none", None), 7: (None, "none", None),
                   8: (None, "none", None), 9: ("MIT", "inherited", "a"), 10: ("MIT", "inherited", "a"), 11: (None, "none", None),
                   12: ("MIT", "inherited", "a"), 13: ("MIT", "inherited", "a")}
    assert licenses.scan(df.filter("false")).count() == 0


def test_license_cosine(docs_rows):
    """The sparse cosine equals a plain one over dictionaries."""
    import re

    import pyarrow as pa
    lines = ["Licensed under the Apache License, Version 2.0.", "the the license file of this work", "word " * 30 + "MIT License MIT", "no"]
    ix = licenses.Index().weigh(1000.0, np.full(len(licenses.Index().vocab), 50.0))

    class Sent:
        value = ix
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "path": ["p"] * 4, "text": lines})
    got = next(licenses._own([batch], Sent)).to_pydict()
    known = {w for _, t in licenses.TEMPLATES for w in re.findall(r"[a-z0-9]+", t.lower())}
    idf = lambda w: math.log(1001 / 51) + 1e-3 if w in known else math.log(1001) + 1e-3

    def vec(t):
        v = {}
        for w in re.findall(r"[a-z0-9]+", t.lower()):
            v[w] = v.get(w, 0) + 1
        v = {w: n * idf(w) for w, n in v.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}
    for i, t in enumerate(lines):
        best = max(sum(x * vec(u).get(w, 0) for w, x in vec(t).items()) for _, u in licenses.TEMPLATES)
        assert got["score"][i] == pytest.approx(best if best >= licenses.LEAST else 0.0)

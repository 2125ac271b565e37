import random

import numpy as np
import pyarrow as pa
import pytest

from huddle.llm import decontam


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))


def edited(r, text, n):
    x = list(text)
    for _ in range(n):
        k, o = r.randrange(len(x)), r.random()
        if o < 0.4:
            x[k] = "q"
        elif o < 0.7:
            x.insert(k, "z")
        else:
            x.pop(k)
    return "".join(x)


def least_edits(pattern: bytes, text: bytes) -> int:
    """Least edits of the whole pattern against any passage of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_no_passage_is_lost_or_invented():
    r = random.Random(5)
    items = [words(r, r.randint(6, 30)) for _ in range(12)]
    table = pa.table({"item_id": list(range(12)), "text": items})
    seg = pa.Table.from_batches(list(decontam._segments(table.to_batches())))
    pieces = seg.column("text").to_pylist()
    index = decontam.Index(pieces)
    texts = []
    for i in range(30):
        it = r.choice(items)
        texts.append(words(r, r.randint(0, 8)) + " " + edited(r, it, r.randint(0, len(it) // 8)) + " " + words(r, r.randint(0, 8)))
    got = {(row, s): e for row, s, e, _ in decontam._matches(pa.RecordBatch.from_pydict({"text": texts}), index)}
    for i, t in enumerate(texts):
        for s, p in enumerate(pieces):
            k = least_edits(p, t.lower().encode())
            assert ((i, s) in got) == (k <= len(p) // 10), (i, s, k, len(p))
            if (i, s) in got:
                assert got[i, s] == k


@pytest.fixture(scope="module")
def bench(spark):
    r = random.Random(6)
    rows = [(i, words(r, 40), "x") for i in range(5)] + [(7, None, "x"), (8, "short", "x"), (None, words(r, 40), "x")]
    return spark.createDataFrame(rows + rows[:1], "item_id long, text string, doc_id string"), rows


def leaky(spark, rows):
    r = random.Random(8)
    texts = [(1, words(r, 30) + "\n" + rows[0][1].upper().replace(" ", "\n") + " " + words(r, 2000)), (2, rows[1][1]), (3, words(r, 500)),
             (4, edited(r, rows[2][1], 8)), (5, None), (6, ""), (None, "é " + rows[3][1]), (2, rows[1][1]), (9, rows[0][1][:50]),
             (10, rows[0][1] + " " + rows[1][1])]
    return spark.createDataFrame([(*t, 5) for t in texts], "doc_id long, text string, segment int")


def test_matches(spark, bench):
    df = leaky(spark, bench[1])
    got = sorted((r.doc_id or 0, r.item_id) for r in decontam.matches(df, bench[0]).collect())
    assert got == [(0, 3), (1, 0), (2, 1), (4, 2), (10, 0), (10, 1)]
    ends = {(r.doc_id, r.item_id): r.last_end for r in decontam.matches(df, bench[0]).collect()}
    assert ends[None, 3] == 2 + len(bench[1][3][1])


@pytest.mark.parametrize("block", [40_000, 3])
def test_decontaminated(spark, bench, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_SEGMENTS", block)
    df = leaky(spark, bench[1])
    got = decontam.decontaminated(df, bench[0])
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [3, 5, 6, 9]


def test_empty(none, docs, bench):
    assert decontam.matches(none, bench[0]).count() == 0
    assert decontam.matches(docs, bench[0].filter("false")).count() == 0
    assert decontam.decontaminated(docs, bench[0].filter("false")).count() == docs.count()
    assert np.isfinite(decontam.decontaminated(docs, bench[0]).count())


def test_texts_of_one_letter(spark):
    """A run of a letter in a text and in the benchmark shares all q-grams on all diagonals: bounded space, whole result."""
    import tracemalloc
    index = decontam.Index([b"a" * 96, b"a" * 95 + b"b"])
    text = "a" * 200_000 + "b" + "-" * 50_000
    tracemalloc.start()
    got = list(decontam._matches(pa.RecordBatch.from_pydict({"text": [text, "c" * 200_000]}), index))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700e6
    assert {r for r, *_ in got} == {0} and {s for _, s, *_ in got} == {0, 1}
    # every band of diagonals holds the run, from the first place where it fits on
    ends = sorted(p for _, s, e, p in got if s == 0 and e == 0)
    assert ends[0] <= 96 + 10 and ends[-1] >= 200_000 - 10 and max(np.diff(ends)) <= index.width * 2


def test_hits_in_chunks_give_the_same(monkeypatch):
    r = random.Random(12)
    items = [words(r, 60).encode()[:96] for _ in range(30)]
    texts = [words(r, 400) + " " + items[i % 30].decode() + " " + words(r, 50) for i in range(40)] + [items[3].decode() * 20]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    whole = sorted(decontam._matches(batch, decontam.Index(items)))
    monkeypatch.setattr(decontam, "HITS", 50)
    monkeypatch.setattr(decontam, "REGIONS", 7)
    assert sorted(decontam._matches(batch, decontam.Index(items))) == whole and len(whole) > 40


def test_equal_segments_of_items(spark):
    bench = spark.createDataFrame([(1, "ab " * 400), (2, "ab " * 100), (3, "xyz" * 40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "head " + "ab " * 120), (2, "nothing"), (3, "xyz" * 50)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.segments for r in decontam.matches(docs, bench).collect()}
    n = {r.item_id: r["count"] for r in decontam.segments(bench).groupBy("item_id").count().collect()}
    assert got == {(1, 1): n[1], (1, 2): n[2], (3, 3): n[3]}

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from huddle.llm import quality, toxicity


def test_features_by_hand():
    import pyarrow as pa
    x = quality.features(pa.array(["Ab, ab ab *", None, ""]))
    assert x[0, :4] == pytest.approx([1 / 11, 1 / 11, 1 / 6, 1 / 4])
    assert (x[1:, :6] == 0).all()


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        good, toxic = r.random() < 0.8, r.random() < 0.2
        w = [r.choice(vocab) for _ in range(r.randint(20, 60))]
        if not good:
            w = [x + "***" for x in w]
        elif toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["grotfool", "grotfools", "mudworm", "mudworms", "mudwormish"]))
        rows.append((i, " ".join(w), "en", "s0" if i % 3 else f"s{i % 7}", 0))
        labels.append((i, int(good), int(toxic and good)))
    rows += [(2000, None, None, None, 0), (2001, "", "en", "s1", 0), (2002, "a grotfoolery of mudworming " + " ".join(vocab[:20]), "en", "s1", 0),
             (None, "x", "en", None, 0), rows[3]]
    labels += [(None, 1, 1), (5, None, None), labels[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("good", F.lit(1)).withColumn("toxic", F.lit(9))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, (b, c)) for a, b, c in labels if b is not None), rows


def test_quality(corpus):
    docs, labels, known, rows = corpus
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r._score <= 1 for r in got)
    hits = [(r._score >= 0.5) == (known[r.doc_id][0] == 1) for r in got if r.doc_id in known]
    assert np.mean(hits) > 0.99
    kept = quality.filtered(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r._score >= 0.5 for r in got)


def test_quality_shrinks_sparse_sites(spark):
    sites = spark.createDataFrame([("big", 900.0, 1000), ("small", 0.0, 1), ("mid", 30.0, 100)], "_h string, good double, n long")
    got = {r._h: r.post for r in quality._shrunk(sites, ["_h"], F.lit(0.5), "post").collect()}
    assert 0.1 < got["small"] < 0.5 and abs(got["big"] - 0.9) < 0.01 and 0.3 < got["mid"] < 0.33


def test_quality_without_labels(corpus):
    docs, labels, _, rows = corpus
    assert quality.filtered(docs, labels.filter("false")).count() == len(rows)
    assert quality.filtered(docs.filter("false"), labels).count() == 0


def test_toxicity(corpus):
    docs, labels, known, rows = corpus
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.predicted, known[r.doc_id][1]) for r in got if r.held_out and r.doc_id in known]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.95
    unseen = next(r.score for r in got if r.doc_id == 2002)
    assert unseen > 0.5                                        # forms that were never seen, by their stems


def test_toxicity_ignores_held_out_labels(corpus):
    docs, labels, _, _ = corpus
    flipped = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.score(docs, flipped).collect()}
    assert a == b


def test_toxicity_without_labels(corpus):
    docs, labels, _, rows = corpus
    assert {r.score for r in toxicity.score(docs, labels.filter("false")).collect()} == {0.5}
    assert toxicity.score(docs.filter("false"), labels).count() == 0


def test_spread_estimate(spark):
    """The sketch of the words before a word, against a plain count."""
    import pyarrow as pa
    from huddle.llm.shingles import words
    r = random.Random(0)
    text = " ".join(f"p{r.randrange(n)} target{n}" for n in (3, 40, 2000) for _ in range(3 * n))
    raw = np.frombuffer(text.encode(), np.uint8)
    h, row, _, *stems = words(raw, np.array([0, len(raw)]), toxicity._GAPS, toxicity.STEMS)
    vocab = np.unique(h)

    class Sent:
        value = vocab
    out = next(toxicity._spread([pa.RecordBatch.from_pydict({"text": [text]})], Sent)).to_pydict()
    cells = spark.createDataFrame(list(zip(out["cell"], out["rank"])), "cell long, rank int")
    est = {r.word: r.spread for r in toxicity.spread_estimate(cells).collect()}
    for n in (3, 40, 2000):
        raw = np.frombuffer(f"target{n}".encode(), np.uint8)
        key = words(raw, np.array([0, len(raw)]), toxicity._GAPS)[0]
        assert 0.4 < est[int(np.searchsorted(vocab, key[0]))] / (n * 0.95) < 1.9


def test_no_python_state_of_doc_ids(corpus):
    """Renumbering held-out documents leaves their scores alone: the id is no input."""
    docs, labels, _, _ = corpus
    base = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    assert {r.doc_id: r.score for r in toxicity.score(other, labels).collect()} == base


def test_toxicity_counts_all_labelled_rows(spark):
    """Classes of unequal size: the counts of each are those of all its rows that may be learnt from."""
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 9))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 30)))) for i in range(400)]
    labels = [(i, int(i % 10 == 0)) for i in range(400)] + [(3, 1), (7, None), (None, 1), (4000, 0)]
    docs = spark.createDataFrame([*rows, rows[8], (None, "x y")], "doc_id long, text string").repartition(3)
    known = toxicity._labelled(spark.createDataFrame(labels, "doc_id long, toxic int"))
    want_rows = {i: int(i % 10 == 0 or i == 3) for i in [*range(400), 4000] if zlib.crc32(str(i).encode()) % 5}
    assert {r.doc_id: r.toxic for r in known.collect()} == want_rows and known.count() == len(want_rows)
    words, pairs = {}, {}
    for i, text in rows:
        if i in want_rows:
            w = ["", "", *text.split()]
            for k in range(2, len(w)):
                words.setdefault((want_rows[i], w[k]), set()).add(w[k - 1])
                pairs.setdefault((want_rows[i], w[k - 1], w[k]), set()).add(w[k - 2])
    got = toxicity._counts(toxicity._texts_of(docs, known)).collect()
    told = lambda pair: sorted((r.toxic, r.n) for r in got if r.pair == pair)
    assert told(0) == sorted((c, len(x)) for (c, _), x in words.items())
    assert told(1) == sorted((c, len(x)) for (c, *_), x in pairs.items() if len(x) > toxicity.DISCOUNT)


def test_toxicity_of_unequal_classes(corpus):
    """More ordinary rows than toxic ones leave the words that no row has without evidence."""
    docs, labels, known, _ = corpus
    few = labels.filter("toxic = 0 or doc_id % 3 = 0")
    got = [r for r in toxicity.score(docs, few).collect() if r.held_out and r.doc_id in known]
    assert np.mean([r.predicted == known[r.doc_id][1] for r in got]) > 0.9
    assert np.mean([r.predicted for r in got if known[r.doc_id][1] == 0]) < 0.05


def test_sketches_of_tasks_join(spark):
    """Sketches sent in blocks give what one task's sketch gives."""
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(900)}x" for _ in range(40)) for _ in range(90)]
    from huddle.llm.shingles import words
    raw = " ".join(texts).encode()
    h, _, _, *stems = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), toxicity._GAPS, toxicity.STEMS)
    vocab = np.unique(np.concatenate(toxicity._units(toxicity._keys(h, stems))))
    shared = spark.sparkContext.broadcast(vocab)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    all_at_once = docs.coalesce(1).mapInArrow(
        lambda it: toxicity._spread(it, shared, toxicity._keys, toxicity._units), "cell long, rank int")
    blocks = docs.repartition(5).mapInArrow(lambda it: toxicity._spread_blocks(it, shared), "block long, ranks binary")
    joined = blocks.groupBy("block").applyInArrow(toxicity._largest, "cell long, rank int")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, all_at_once.collect()))

"""Quality by hierarchical empirical Bayes.

A logistic curve over simple shares of a text (symbols, punctuation, capitals,
words equal to the one before, length of words), fitted on a bounded sample of
labelled documents, gives each document's evidence. Sites are read from all
documents: the mean probability of a host's documents is shrunk towards the
global mean, that of a path's documents (a part of the host) towards its host's,
each with the strength that the spread between sites shows (method of moments).
A document's score joins its evidence with how far its path's posterior is from the
global mean.

Defined results: null text is an empty text, whose shares are 0; null hosts and
paths are sites of their own; repeated rows count once each; a doc_id labelled twice
is good if any label says so; without labelled rows of both classes there is no
evidence (0) and every document is kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from huddle.llm.common import written
from huddle.llm.shingles import row_slices, words
from huddle.llm.tokens import text_buffer, tidied
from huddle.llm.toxicity import logistic

FIT_DOCS = 10_000            # labelled documents of each class that are learnt from, at most
KEEP_FROM = 0.5
BROADCAST_SITES = 100_000    # sites of about 100 bytes; more are joined by a shuffle
EVIDENCE_LIMIT = 12.0

_CLASS = np.zeros((4, 256), bool)             # letters A-Z, all ASCII letters, marks of prose, other symbols
_CLASS[0, 65:91] = True
_CLASS[1, 65:91] = _CLASS[1, 97:123] = True
_CLASS[2, [33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = True
_CLASS[3, 33:48] = _CLASS[3, 58:65] = _CLASS[3, 91:97] = _CLASS[3, 123:127] = True
_CLASS[3] &= ~_CLASS[2]

FEATURES = ["symbols", "marks", "capitals", "repeats", "word_length", "length"]


def features(text: pa.Array) -> np.ndarray:
    """One row of shares per text."""
    raw, off = text_buffer(text)
    out = np.zeros((len(off) - 1, len(FEATURES)))
    for a, b in row_slices(off):
        own, at = raw[off[a]:off[b]], off[a:b + 1] - off[a]
        size = np.diff(at)
        caps, letters, marks, other = (
            np.diff(np.concatenate([[0], np.cumsum(c[own], dtype=np.int64)])[at]) for c in _CLASS)
        h, row, _ = words(own, at)
        n = np.bincount(row, minlength=b - a)
        same = np.bincount(row[1:], (h[1:] == h[:-1]) & (row[1:] == row[:-1]), minlength=b - a) if len(h) else 0 * n
        out[a:b] = np.column_stack([
            other / np.maximum(size, 1), marks / np.maximum(size, 1), caps / np.maximum(letters, 1),
            same / np.maximum(n, 1), np.minimum(size / np.maximum(n, 1), 20) / 20, np.log1p(size) / 10])
    # shares near 0 tell most
    return np.column_stack([out, np.sqrt(out[:, :4])])


def _with_features(batches, curve, keep):
    """``keep`` columns and, without a curve, the features; with one, the evidence."""
    for batch in batches:
        x = features(batch.column("text"))
        if curve is None:
            last = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
        else:
            last = pa.array(np.clip(curve[0] + x @ curve[1:], -EVIDENCE_LIMIT, EVIDENCE_LIMIT))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), last], names=[*keep, "_evidence"])


def _evidence(docs: DataFrame, curve: np.ndarray | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and ``_evidence`` (0 without a curve)."""
    if curve is None:
        return docs.select(*keep, F.lit(0.0).alias("_evidence"))
    schema = StructType([docs.schema[c] for c in keep] + [StructField("_evidence", DoubleType())])
    return docs.mapInArrow(tidied(lambda it: _with_features(it, curve, keep)), schema)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> np.ndarray | None:
    """Weights of the evidence, from a bounded sample of labelled documents."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    share = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(share) < 2:
        return None
    one = lambda q: known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    rows = one(0).unionByName(one(1))                  # at most 2 * fit_docs rows of two numbers: a proven bound
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id").mapInArrow(
        tidied(lambda it: _with_features(it, None, ["quality"])), "quality int, _evidence array<double>").toArrow()
    y = got.column("quality").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    weight = np.where(y == 1, share[1] / y.sum(), share[0] / (len(y) - y.sum())) * len(y) / (share[0] + share[1])
    x = got.column("_evidence").combine_chunks().flatten().to_numpy()
    return logistic(x.reshape(len(y), -1), y, weight)


def _shrunk(sites: DataFrame, key: list[str], mean, into: str) -> DataFrame:
    """Posterior mean of each site: its own mean, shrunk towards ``mean`` (a column).

    The strength (in documents) is mean * (1 - mean) / variance between sites - 1,
    the variance being what the spread of the sites' means has beyond chance.
    """
    p = F.col("good") / F.col("n")
    m = sites.withColumn("prior", mean)
    spread = m.agg(F.sum(F.col("n") * (p - F.col("prior")) ** 2 - F.col("prior") * (1 - F.col("prior"))).alias("over"),
                   F.sum("n").alias("n"), F.avg("prior").alias("prior")).first()
    over, n, prior = spread["over"] or 0.0, spread["n"] or 0, spread["prior"] or 0.5
    between = max(over / n if n else 0.0, 1e-6)
    strength = max(prior * (1 - prior) / between - 1, 1.0)
    return m.select(*key, "good", "n", ((F.col("good") + strength * F.col("prior")) / (F.col("n") + strength)).alias(into))


def _logit(p):
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", fit_docs: int = FIT_DOCS) -> DataFrame:
    """``docs`` with _evidence, _host, _path (posteriors) and _score."""
    curve = fit(docs, labels, fit_docs)
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(k) for c, k in ((host, "_h"), (path, "_p"))]
    p = 1 / (1 + F.exp(-F.col("_evidence")))
    # text is read once for the sites and once for the rows; only a number per document is kept between
    sites = written(_evidence(docs.select(*key, "text"), curve, ["_h", "_p"]).groupBy("_h", "_p").agg(
        F.sum(p).alias("good"), F.count("*").alias("n")), "sites")
    total = sites.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    mean = (total["good"] / total["n"]) if total["n"] else 0.5
    hosts = _shrunk(sites.groupBy("_h").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), ["_h"], F.lit(mean), "_host")
    paths = written(_shrunk(sites.join(hosts.select("_h", "_host"), "_h"), ["_h", "_p", "_host"], F.col("_host"), "_path")
                    .select("_h", "_p", "_host", "_path"), "posteriors")
    found = F.broadcast(paths) if paths.count() <= BROADCAST_SITES else paths
    all_columns = [F.col(c) for c in docs.columns]
    out = _evidence(docs.select(*all_columns, *key), curve, [*docs.columns, "_h", "_p"]).join(found, ["_h", "_p"])
    score = 1 / (1 + F.exp(-(F.col("_evidence") + _logit(F.col("_path")) - _logit(F.lit(mean)))))
    return out.select(*all_columns, "_evidence", "_host", "_path",
                      (F.lit(1.0) if curve is None else score).alias("_score"))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their own columns."""
    return scored(docs, labels).filter(F.col("_score") >= KEEP_FROM).select(*docs.columns)

"""Approximate nearest neighbours by a permutation index.

A vector is represented by its LENGTH nearest pivots in order; the pivots are
PIVOTS vectors of a sample, each the farthest from those before, so that a close
cluster, however many of the vectors it holds, takes few of them. A block of vectors posts each of them in the inverted
files of its pivots, with the pivot's place. A query reads the files of its own
pivots and adds up the footrule distance (places differ by; a pivot that is
missing counts as place LENGTH); the nearest by footrule, a share of each block
with all ties at its edge, are ranked again by their exact distance. Every vector
is indexed; queries are tried in blocks of a bounded size against all blocks.

Equal vectors are one class, held once with its smallest ids, as many as an
answer can need.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components, and rows without an id, take no part; repeated rows count
once; ties go to the smaller vec_id; with fewer candidates all are returned; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huddle.llm.common import written

PIVOTS, LENGTH = 256, 128
SAMPLE = 4_096               # vectors that pivots are chosen from
SHARE = 0.12                 # ranked again: this share of each block, and no fewer than an answer needs
BLOCK_ROWS = 4_096           # vectors indexed together, and queries sent together


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (as doubles) of the rows that take part."""
    e = F.col("embedding")
    ok = (F.col("vec_id").isNotNull() & e.isNotNull()
          & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
          & F.exists(e, lambda x: x != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).filter(ok).distinct()
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("embedding") == (size["size"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def spread(x: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the rows (all, if fewer): the first, then each the farthest from those before."""
    at, d = [0], np.full(len(x), np.inf)
    while len(at) < min(count, len(x)):
        d = np.minimum(d, ((x - x[at[-1]]) ** 2).sum(1))
        d[at] = -1
        at.append(int(d.argmax()))
    return x[at[:len(x)]]


def _nearest_pivots(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    d = (x ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :length]


class Files:
    """Inverted files of a block: per pivot, the place it has in each vector's permutation."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, length: int):
        order = _nearest_pivots(x, pivots, length)
        place = np.full((len(x), len(pivots)), length, np.uint8)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(length, dtype=np.uint8), order.shape), 1)
        self.place, self.length = np.ascontiguousarray(place.T), length

    def nearest(self, order: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` vectors of least footrule distance to a query's permutation, with ties."""
        own = np.arange(self.length, dtype=np.uint8)[:, None]
        # twice the sum of the later places, over the query's pivots, is the footrule distance and a constant
        later = np.maximum(self.place[order], own).sum(0, dtype=np.int32)
        if count >= len(later):
            return np.arange(len(later))
        return np.flatnonzero(later <= np.partition(later, count - 1)[count - 1])


def _search(batches, sent, share, k):
    """The k nearest classes of each query among a task's vectors."""
    names, queries, pivots, length = sent.value
    orders = _nearest_pivots(queries, pivots, length)
    best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in names]
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(a, BLOCK_ROWS)
            x, cid = _matrix(part.column("embedding")), part.column("cid").to_numpy()
            files = Files(x, pivots, length)
            count = max(int(np.ceil(share * len(x))), k)
            for i in range(len(names)):
                at = files.nearest(orders[i], count)
                d = np.sqrt(((x[at] - queries[i]) ** 2).sum(1))
                d, c = np.concatenate([best[i][0], d]), np.concatenate([best[i][1], cid[at]])
                if len(d) > k:
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                    near = near[np.lexsort((c[near], d[near]))[:k]]
                    d, c = d[near], c[near]
                best[i] = d, c
    sizes = [len(d) for d, _ in best]
    if sum(sizes):
        yield pa.RecordBatch.from_pydict({
            "q": np.repeat(names, sizes), "cid": np.concatenate([c for _, c in best]), "score": np.concatenate([d for d, _ in best])})


def nearest(vectors: DataFrame, query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that fulfils ``query`` (a condition
    on vec_id) its k nearest others found."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    first = Window.partitionBy("embedding").orderBy("vec_id")
    # no answer needs more than k + 1 ids of one vector
    classes = written(rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).groupBy("embedding").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.col("ids")[0]), "classes")
    sample = classes.select("embedding", "cid").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).toArrow().column("embedding")
    p = spread(_matrix(sample.combine_chunks()), PIVOTS)
    asked = rows.filter(query)
    asked = written(asked.join(classes.select("embedding", "cid"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("q")), "asked")
    queries = classes.join(asked.select(F.col("q").alias("cid")).distinct(), "cid", "left_semi").select("cid", "embedding")
    queries = written(queries, "queries")
    blocks = -(-queries.count() // BLOCK_ROWS)
    schema = "q long, cid long, score double"
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("cid"), F.lit(blocks)) == b).toArrow()
        if block.num_rows:
            sent = spark.sparkContext.broadcast((block.column("cid").to_numpy(), _matrix(block.column("embedding").combine_chunks()),
                                                 p, min(LENGTH, len(p))))
            found = found.unionByName(classes.select("cid", "embedding").mapInArrow(
                lambda it, sent=sent: _search(it, sent, SHARE, k + 1), schema))
    per_query = Window.partitionBy("q").orderBy("score", "cid")
    top = written(found.withColumn("n", F.row_number().over(per_query)).filter(F.col("n") <= k + 1).drop("n"), "found")
    ids = top.join(classes.select("cid", "ids"), "cid").select("q", "score", F.explode("ids").alias("vec_id"))
    per_query = Window.partitionBy("q").orderBy("score", "vec_id")
    ids = ids.withColumn("n", F.row_number().over(per_query)).filter(F.col("n") <= k + 1).drop("n")
    # a class's queries share its answer, each without itself
    per_row = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return asked.join(ids, "q").filter("query_id <> vec_id").withColumn("rank", F.row_number().over(per_row).cast("int")).filter(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

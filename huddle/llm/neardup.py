"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A sketch has ``ROWS`` coordinates for each of its bands. In round i every shingle is hashed to
a bin with a value that begins with i; a bin keeps its least value. Rounds go on
until all bins of a document are filled; after as many rounds as there are bins,
round i puts every shingle into bin i modulo their number, so that each one does fill.
Documents with equal sets are one class. Classes that share a band are
candidates; connected candidates form a group, and in each group every pair of
classes whose sizes allow it is compared on the full sets, in blocks of a
bounded size. There are as many bands as it takes that two sets of the least
similarity that is linked miss each other in all of them with a probability
below 1e-6.

Defined results: null text, and texts without words, have an empty set and are
linked with nothing; repeated rows share a class; a row with a null doc_id has
no component (null) and is kept; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import components, release, written
from huddle.llm.shingles import mix, row_slices, sets
from huddle.llm.tokens import text_buffer, tidied

ROWS = 8
MISSED = 1e-6                # probability that a pair of the least similarity shares no band
SIMILAR_PERCENT = 85         # op7's; other callers give their own
BLOCK_CLASSES = 256          # classes compared with as many others by one task
BLOCK_SHINGLES = 300_000
PACK_SHINGLES = 1_000_000    # small groups handled by one task
_COLUMNS = 4_096

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def band_count(percent: int) -> int:
    """Bands (of ROWS) for pairs that are similar to ``percent`` or more."""
    return math.ceil(math.log(MISSED) / math.log1p(-(percent / 100) ** ROWS)) if percent < 100 else 1


BANDS = band_count(SIMILAR_PERCENT)


def sketches(value: np.ndarray, off: np.ndarray, bins: int = ROWS * BANDS) -> np.ndarray:
    """Fast similarity sketch of each row's set; rows without shingles stay unfilled."""
    rows = len(off) - 1
    size = np.diff(off)
    out = np.full(rows * bins, _NONE)
    owner, x = np.repeat(np.arange(rows), size), value
    for i in range(2 * bins):
        if not len(x):
            break
        h = mix(x + _U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        at = ((h >> _U(32)) % _U(bins)).astype(np.int64) if i < bins else np.full(len(x), i - bins)
        np.minimum.at(out, owner * bins + at, (_U(i) << _U(32)) | (h & _U(0xFFFFFFFF)))
        unfilled = (out.reshape(rows, bins) == _NONE).any(1)
        more = unfilled[owner]
        if not more.all():
            owner, x = owner[more], x[more]
    return out.reshape(rows, bins)


def bands(sketch: np.ndarray) -> np.ndarray:
    """One hash per band and row."""
    rows, count = len(sketch), sketch.shape[1] // ROWS
    odd = np.arange(1, ROWS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) | _U(1)
    joined = (mix(sketch).reshape(rows, count, ROWS) * odd).sum(2, dtype=np.uint64)
    return mix(joined + np.arange(count, dtype=np.uint64) * _U(0xD1B54A32D192ED03)).view(np.int64)


def _digests(value, off):
    """Two sums over each set: equal sets are told by 128 bits."""
    total = [np.concatenate([[_U(0)], np.cumsum(mix(value ^ _U(s)), dtype=np.uint64)]) for s in (0x5851F42D, 0x14057B7E)]
    return [(t[off[1:]] - t[off[:-1]]).view(np.int64) for t in total]


def _signed(batches, count):
    for batch in batches:
        raw, off = text_buffer(batch.column("text"))
        for a, b in row_slices(off):
            value, at = sets(raw[off[a]:off[b]], off[a:b + 1] - off[a])
            k1, k2 = _digests(value, at)
            n = np.diff(at)
            flat = bands(sketches(value, at, ROWS * count))
            some = n > 0
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(some * count)]).astype(np.int32)), pa.array(flat[some].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(k1), pa.array(k2), lists],
                names=["doc_id", "n", "k1", "k2", "bands"])


def signed(docs: DataFrame, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """doc_id, size and digest of the set, band hashes."""
    count = band_count(percent)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tidied(lambda it: _signed(it, count)), "doc_id long, n long, k1 long, k2 long, bands array<long>")


def _full_sets(batches):
    for batch in batches:
        raw, off = text_buffer(batch.column("text"))
        for a, b in row_slices(off):
            value, at = sets(raw[off[a]:off[b]], off[a:b + 1] - off[a])
            k1, k2 = _digests(value, at)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
            rest = [batch.column(c).slice(a, b - a) for c in ("doc_id", "root", "block", "units", "k1", "k2")]
            got = pa.RecordBatch.from_arrays(
                rest[:4] + [lists, pa.array(k1), pa.array(k2)], names=["doc_id", "root", "block", "units", "shingles", "own1", "own2"])
            # rows that only share the id of the class's document are another text
            same = (k1 == rest[4].to_numpy()) & (k2 == rest[5].to_numpy())
            yield got.filter(pa.array(same)).drop_columns(["own1", "own2"])


def _linked(values: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether each of the rows ``left`` is similar to each of the rows ``right``."""
    size = np.array([len(v) for v in values])
    flat, owner = np.concatenate(values), np.repeat(np.arange(len(values)), size)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    col = (np.cumsum(count > 1) - 1)[inverse[shared]]
    owner = owner[shared]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    both = np.zeros((len(left), len(right)), np.int64)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, _COLUMNS):
        a, b = np.searchsorted(col, [c, c + _COLUMNS])
        m = np.zeros((len(values), _COLUMNS), np.float32)
        m[owner[a:b], col[a:b] - c] = 1
        both += (m[left] @ m[right].T).astype(np.int64)
    union = size[left][:, None] + size[right][None, :] - both
    return 100 * both >= percent * union


def _forest(values: list[np.ndarray], block: np.ndarray, percent: int) -> np.ndarray:
    """For each row the least row that links between (or, with one block, in) the blocks reach."""
    n = len(values)
    near = np.zeros((n, n), bool)
    names = np.unique(block)
    left = np.flatnonzero(block == names[0])
    right = np.flatnonzero(block == names[-1])
    got = _linked(values, left, right, percent)
    near[np.ix_(left, right)] = got
    near |= near.T
    np.fill_diagonal(near, True)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(rows, percent):
    """Edges that connect what is linked among a unit's classes."""
    rows = rows.combine_chunks()
    doc = rows.column("doc_id").to_numpy()
    root, block = rows.column("root").to_numpy(), rows.column("block").to_numpy()
    lists = rows.column("shingles").combine_chunks()
    flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()
    a, b = [], []
    order = np.lexsort((doc, root))
    for group in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        group = group[np.concatenate([[True], np.diff(doc[group]) != 0])]   # repeated rows
        if len(group) > 1:
            label = _forest([flat[off[i]:off[i + 1]] for i in group], block[group], percent)
            tied = np.flatnonzero(label != np.arange(len(group)))
            a.append(doc[group[tied]])
            b.append(doc[group[label[tied]]])
    empty = np.zeros(0, np.int64)
    return pa.table({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})


def _units(members: DataFrame, packs: int, percent: int) -> DataFrame:
    """Deals the members (doc_id, root, n) into units of a bounded size.

    A small group is one unit, with other small groups. A large one is cut by
    size classes, each ``percent`` of the next one, and hashed blocks;
    its units are the pairs of blocks of equal or neighbouring size classes.
    """
    level = F.floor(F.log("n") / float(np.log(100 / percent))).cast("int")
    m = members.withColumn("level", level)
    sized = m.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    big = (F.col("size") > BLOCK_CLASSES) | (F.col("shingles") > BLOCK_SHINGLES)
    small = m.join(sized.filter(~big), "root").select(
        "doc_id", "root", "k1", "k2", F.lit(0).cast("long").alias("block"),
        F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(packs)).cast("string"))).alias("units"))
    large = m.join(sized.filter(big).select("root"), "root")
    cut = large.groupBy("root", "level").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).select(
        "root", "level", F.greatest(F.ceil(F.col("size") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("nb"))
    around = cut.select("root", F.explode(F.array(*[F.struct(
        (F.col("level") + d).alias("level"), F.when(F.lit(d) == 0, F.col("nb")).alias("own"),
        F.when(F.lit(d) == 1, F.col("nb")).alias("below"), F.when(F.lit(d) == -1, F.col("nb")).alias("above")) for d in (-1, 0, 1)])).alias("x"))
    around = around.groupBy("root", "x.level").agg(*[F.max(f"x.{c}").alias(c) for c in ("own", "below", "above")])
    dealt = large.join(around, ["root", "level"]).withColumn("s", F.pmod(F.xxhash64("doc_id"), F.col("own")))
    name = lambda lo, s, hi, t: F.concat_ws(":", F.col("root"), lo, s, hi, t)
    lev, s = F.col("level"), F.col("s")
    span = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    units = F.concat(
        F.transform(span(F.col("own")), lambda t: name(lev, F.least(s, t), lev, F.greatest(s, t))),
        F.transform(span(F.col("above")), lambda t: name(lev, s, lev + 1, t)),
        F.transform(span(F.col("below")), lambda t: name(lev - 1, t, lev, s)))
    return small.unionByName(dealt.select(
        "doc_id", "root", "k1", "k2", F.xxhash64("level", "s").alias("block"), units.alias("units")))


def near_duplicates(docs: DataFrame, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Texts are linked whose sets' Jaccard similarity is at least ``percent``.
    """
    every = written(signed(docs, percent), "signed")
    classes = written(every.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("k1", "k2", "n").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    posted = classes.select("rep", F.explode("bands").alias("band"))
    leader = posted.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    star = posted.join(leader, "band").filter("rep <> leader").select(
        F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    groups = components(star, "groups")
    nodes = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    members = written(nodes.join(classes.select(F.col("rep").alias("node"), "n", "k1", "k2"), "node")
                      .withColumnRenamed("node", "doc_id"), "members")
    total = members.agg(F.sum("n")).first()[0] or 0
    units = _units(members, max(1, -(-total // PACK_SHINGLES)), percent)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    full = text.join(units, "doc_id").mapInArrow(
        tidied(_full_sets), "doc_id long, root long, block long, units array<string>, shingles array<long>")
    edges = written(full.select(F.explode("units").alias("unit"), "doc_id", "root", "block", "shingles")
                    .groupBy("unit").applyInArrow(lambda unit, rows: _links(rows, percent), "a long, b long"), "links")
    joined = components(edges, "near").withColumnRenamed("node", "rep")
    found = classes.select("k1", "k2", "n", "rep").join(joined, "rep", "left").select(
        "k1", "k2", "n", F.coalesce("root", "rep").alias("component_id"))
    release(members)
    out = every.select("doc_id", "n", "k1", "k2").join(found, ["k1", "k2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

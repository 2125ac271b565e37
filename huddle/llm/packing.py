"""Best-fit packing by the sum-of-squares rule.

A document's token ids (with an end id) are packed into sequences of
``capacity`` tokens. Only documents longer than that are cut: into full pieces,
the first of which takes what is left over. Pieces are dealt into groups of a
bounded size by a hash of their key; in each group they are placed, largest
first, where the sum over gaps g < capacity of (open sequences with gap g)^2
becomes smallest; equal sums go to the fullest sequence. What stays open in a
group (its last, badly filled sequences) is packed once more with the open rest
of other groups.

Defined results: null text is an empty text (the end id alone); repeated rows
are packed once each; a null doc_id stays null; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import written
from huddle.llm.tokens import encoded_slices, tidied

GROUP_PIECES = 40_000       # pieces packed together by one task
REST_GAP = 8                # sequences with a larger gap are packed once more

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(batches, path, end_id, capacity):
    for batch in batches:
        doc = batch.column("doc_id")
        for a, b, ids, count in encoded_slices(batch.column("text"), path):
            at, rows = 0, []
            for i in range(a, b):
                n = int(count[i - a])
                own = np.append(ids[at:at + n], end_id).astype("<u4")
                at += n
                first = len(own) % capacity or min(len(own), capacity)
                cuts = [0, *range(first, len(own) + 1, capacity)]
                rows += [(i, k, s, e - s, zlib.crc32(own[s:e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            row, piece, start, length, crc = map(list, zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(row)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """One row per piece: where it starts in its document, its length, the crc32 of its ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tidied(partial(_cut, path=tokenizer, end_id=end_id, capacity=capacity)), PIECES)


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-of-squares placement of items, largest first: sequence, offset of
    each item, and the gap each sequence is left with."""
    order = np.argsort(-sizes, kind="stable")
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    n_open = np.zeros(capacity + 1, np.int64)            # n_open[0] is never counted
    seq, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    gaps: list[int] = []
    for i in order:
        s = int(sizes[i])
        # change of the sum of squares, over 2: a gap g >= s becomes g - s
        g = np.flatnonzero(n_open[s:]) + s
        target = -1
        if len(g):
            left = g - s
            change = np.where(left > 0, n_open[left] + 1, 0) - n_open[g]
            k = int(np.argmin(change))                   # the first: the fullest
            target = int(g[k])
        if target < 0:                                   # largest first: open one only when none fits
            bin_, gap = len(gaps), capacity
            gaps.append(capacity)
        else:
            bin_, gap = open_by_gap[target].pop(), target
            n_open[target] -= 1
        seq[i], offset[i] = bin_, capacity - gap
        gap -= s
        gaps[bin_] = gap
        if gap:
            open_by_gap[gap].append(bin_)
            n_open[gap] += 1
    return seq, offset, np.asarray(gaps, np.int64)


def _pack(key, items, capacity, rest_gap):
    """Places a group's items. ``seq`` is null for what stays in sequences with a large gap."""
    size = items.column("length").to_numpy()
    seq, offset, gaps = place(size, capacity)
    ids = (int(key[0].as_py()) << 32) + seq
    keep = gaps[seq] <= rest_gap if rest_gap >= 0 else np.ones(len(seq), bool)
    return pa.table({
        **{c: items.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
        "sequence_id": pa.array(ids, pa.int64(), mask=~keep),
        "offset": pa.array(offset, pa.int64(), mask=~keep)})


PACKED = PIECES + ", sequence_id long, offset long"


def _packed(df: DataFrame, groups: int, base: int, capacity: int, rest_gap: int) -> DataFrame:
    # row numbers of a written table: repeated rows are dealt apart
    keyed = df.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)) + base)
    return keyed.groupBy("g").applyInArrow(lambda key, items: _pack(key, items, capacity, rest_gap), PACKED)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024,
         group_pieces: int = GROUP_PIECES, rest_gap: int = REST_GAP) -> DataFrame:
    """The pieces of all documents with their sequence and their offset in it.

    Full pieces are sequences of their own and never grouped. Two rounds of
    grouping: the second packs what the first left in sequences with a gap
    over ``rest_gap``, in fewer groups; its groups are as bounded as the first's.
    """
    cut = written(pieces(docs, tokenizer, end_id, capacity), "pieces")
    full = cut.filter(F.col("length") == capacity).select(
        "*", (F.monotonically_increasing_id() + F.lit(1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = cut.filter(F.col("length") < capacity)
    groups = -(-part.count() // group_pieces) or 1
    first = written(_packed(part, groups, 0, capacity, rest_gap if groups > 1 else -1), "packed")
    if groups == 1:
        return full.unionByName(first)
    rest = first.filter(F.col("sequence_id").isNull()).drop("sequence_id", "offset")
    again = -(-rest.count() // group_pieces) or 1
    second = written(_packed(rest, again, groups, capacity, -1), "repacked")
    return full.unionByName(first.filter(F.col("sequence_id").isNotNull())).unionByName(second)



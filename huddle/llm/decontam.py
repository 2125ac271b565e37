"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping segments of SEGMENT bytes. A passage
within k edits of a segment of m bytes shares at least m - Q + 1 - k * Q
q-grams with it, on diagonals (place in the text less place in the segment)
that differ by at most k. So shared q-grams are counted in overlapping bands of
diagonals, twice the budget wide; bands that reach the bound are verified by a
banded alignment. Segments are tried in blocks of a bounded size, each against
all texts.

Texts are compared as UTF-8 bytes with A-Z lower-cased and each ASCII white
space as a space.

Defined results: null and empty texts match nothing; items below LEAST bytes (and null
ones) are no evidence and match nothing; repeated rows each get their matches, a
null doc_id stays null; empty tables give no rows; other columns are not read
(and kept as they are by ``decontaminated``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import written
from huddle.llm.shingles import row_slices
from huddle.llm.tokens import text_buffer, tidied

Q = 7
SEGMENT, STRIDE, LEAST = 96, 48, 32
EDIT_SHARE = 0.1
BLOCK_SEGMENTS = 40_000      # about 4 MB of segments broadcast at once
_SLICE = 1 << 20
HITS = 1 << 21               # shared q-grams looked at together
REGIONS = 1 << 15            # regions aligned together
_FILTER_BITS, _BAND_BITS = 22, 22

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_U = np.uint64


def _segments(batches):
    for batch in batches:
        raw, off = text_buffer(batch.column("text"))
        raw = _FOLD[raw]
        item, no, text = [], [], []
        for i, name in enumerate(batch.column("item_id").to_pylist()):
            own = raw[off[i]:off[i + 1]].tobytes()
            last = max(len(own) - SEGMENT, 0)
            for k, s in enumerate(sorted({*range(0, last, STRIDE), last})):
                if len(own) >= LEAST:
                    item.append(name), no.append(k), text.append(own[s:s + SEGMENT])
        yield pa.RecordBatch.from_pydict({"item_id": pa.array(item, pa.int64()), "segment": pa.array(no, pa.int32()),
                                          "text": pa.array(text, pa.binary())})


def segments(benchmark: DataFrame) -> DataFrame:
    """item_id, number of the segment, its folded bytes."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        _segments, "item_id long, segment int, text binary")


def grams(raw: np.ndarray) -> np.ndarray:
    """The Q bytes from each place on, as one number."""
    n = max(len(raw) - Q + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out |= raw[k:k + n].astype(np.uint64) << _U(8 * k)
    return out


def _hash(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64)


def budget(m: np.ndarray) -> np.ndarray:
    return (m * EDIT_SHARE).astype(np.int64)


class Index:
    """The q-grams of a block of segments."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.edits = budget(self.size)
        self.least = self.size - Q + 1 - self.edits * Q          # positive from LEAST on
        self.text = np.zeros((len(texts), SEGMENT), np.uint8)
        every, owner, place = [], [], []
        for i, t in enumerate(texts):
            raw = np.frombuffer(t, np.uint8)
            self.text[i, :len(raw)] = raw
            g = grams(raw)
            every.append(g), owner.append(np.full(len(g), i)), place.append(np.arange(len(g)))
        g, owner, place = np.concatenate(every), np.concatenate(owner), np.concatenate(place)
        order = np.argsort(g, kind="stable")
        self.gram, first = np.unique(g[order], return_index=True)
        self.bound = np.append(first, len(g))
        self.owner, self.place = owner[order], place[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[_hash(self.gram, _FILTER_BITS)] = True
        self.width = int(self.edits.max()) + 1

    def regions(self, raw: np.ndarray, off: np.ndarray):
        """(row, segment, first diagonal) of every band that reaches its bound."""
        g = grams(raw)
        at = np.flatnonzero(self.filter[_hash(g, _FILTER_BITS)])
        where = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
        ok = self.gram[where] == g[at]
        at, where = at[ok], where[ok]
        row = np.searchsorted(off, at, "right") - 1
        inside = at + Q <= off[row + 1]
        at, where, row = at[inside], where[inside], row[inside]
        # hashed counts are upper bounds; bands that may reach the bound are counted exactly
        hashed = np.zeros(1 << _BAND_BITS, np.int64)
        chunks = self._chunks(where)
        held = None
        for a, b in chunks:
            held = self._hits(at[a:b], where[a:b], row[a:b], off)
            hashed += np.bincount(_hash(held[0], _BAND_BITS), minlength=1 << _BAND_BITS)
        kept = []
        for a, b in chunks:
            key, of_row, seg, band = held if len(chunks) == 1 else self._hits(at[a:b], where[a:b], row[a:b], off)
            near = hashed[_hash(key, _BAND_BITS)] + np.maximum(
                hashed[_hash(key + _U(1), _BAND_BITS)], hashed[_hash(key - _U(1), _BAND_BITS)])
            keep = np.flatnonzero(near >= self.least[seg])
            key, first, count = np.unique(key[keep], return_index=True, return_counts=True)
            kept.append((key, count, *(x[keep[first]] for x in (of_row, seg, band))))
        if not kept:
            return np.zeros((0, 3), np.int64)
        key, count, row, seg, band = (np.concatenate(x) for x in zip(*kept))
        if len(kept) > 1:
            key, first, group = np.unique(key, return_index=True, return_inverse=True)
            count = np.bincount(group, count, len(key)).astype(np.int64)
            row, seg, band = row[first], seg[first], band[first]
        out = []
        for step in (0, 1):                                       # bands b-1, b and b, b+1
            other = key - _U(1) if step == 0 else key + _U(1)
            j = np.minimum(np.searchsorted(key, other), max(len(key) - 1, 0))
            total = count + np.where(key[j] == other, count[j], 0) if len(key) else count
            good = total >= self.least[seg]
            out.append(np.column_stack([row, seg, (band - 1 + step) * self.width - SEGMENT])[good])
        return np.unique(np.concatenate(out), axis=0) if len(out[0]) + len(out[1]) else np.zeros((0, 3), np.int64)

    def _chunks(self, where):
        """Ranges of text places with about HITS hits each, so that a text of one letter is
        worked on in a bounded space too."""
        total = np.cumsum(self.bound[where + 1] - self.bound[where])
        out, a = [], 0
        while a < len(where):
            done = total[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(total, done + HITS, "right")))
            out.append((a, b))
            a = b
        return out

    def _hits(self, at, where, row, off):
        """(key of row, segment and band; row; segment; band) of each q-gram shared with a segment."""
        n = self.bound[where + 1] - self.bound[where]
        hit = np.repeat(self.bound[where] - np.cumsum(n) + n, n) + np.arange(n.sum())
        seg = self.owner[hit]
        row = np.repeat(row, n)
        diagonal = np.repeat(at, n) - self.place[hit] - off[row] + SEGMENT
        band = diagonal // self.width
        key = ((row.astype(np.uint64) << _U(40)) + (seg.astype(np.uint64) << _U(24)) + band.astype(np.uint64) if len(self.size) < 1 << 16
               and off[-1] < 1 << 24 else _wide(row, seg, band))
        return key, row, seg, band

    def verify(self, raw: np.ndarray, off: np.ndarray, found: np.ndarray):
        """Of the regions that are within their edits: the region, its edits, and where in the row its alignment ends."""
        parts = [self._verify(raw, off, found[a:a + REGIONS]) for a in range(0, len(found), REGIONS)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _verify(self, raw: np.ndarray, off: np.ndarray, found: np.ndarray):
        row, seg, start = found.T
        size, edits = self.size[seg], self.edits[seg]
        span = 3 * self.width                                     # two bands, and the drift of the alignment
        big = 4 * SEGMENT
        col = np.arange(span)
        cost = np.zeros((len(found), span), np.int32)
        # the alignment starts at any diagonal of the band, inside the text
        outside = (start[:, None] + col < 0) | (start[:, None] + col > (off[row + 1] - off[row])[:, None])
        cost[outside] = big
        best, end = np.full(len(found), big), np.zeros(len(found), np.int64)
        length = off[row + 1] - off[row]
        for j in range(SEGMENT):
            live = j < size
            t = start[:, None] + col + j
            valid = (t >= 0) & (t < length[:, None])
            letter = raw[np.where(valid, off[row][:, None] + t, 0)]
            new = np.where(valid, cost + (letter != self.text[seg, j][:, None]), big)
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)        # a letter of the segment is missing
            new = np.minimum.accumulate(new - col, 1) + col               # the text has one more
            cost = np.where(live[:, None], new, cost)
            done = np.flatnonzero(j == size - 1)
            if len(done):
                k = cost[done].argmin(1)
                best[done] = cost[done, k]
                end[done] = np.minimum(start[done] + k + size[done], length[done])
        ok = best <= edits
        return found[ok], best[ok], end[ok]


def _wide(row, seg, band):
    """Any numbers into one key; bands next to each other stay next to each other."""
    x = (row.astype(np.uint64) * _U(0xD6E8FEB86659FD93)) ^ (seg.astype(np.uint64) * _U(0xA0761D6478BD642F))
    return (x << _U(1)) + band.astype(np.uint64)


def _matches(batch, index):
    """(row of the batch, segment, edits, end in bytes) for a batch's texts."""
    raw, off = text_buffer(batch.column("text"))
    raw = _FOLD[raw]
    for a, b in row_slices(off, _SLICE):
        own, at = raw[off[a]:off[b]], off[a:b + 1] - off[a]
        found = index.regions(own, at)
        if len(found):
            found, edits, end = index.verify(own, at, found)
            if len(found):
                points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                row, seg = found[:, 0], found[:, 1]
                stop = points[at[row] + end] - points[at[row]]
                yield from zip((a + row).tolist(), seg.tolist(), edits.tolist(), stop.tolist())


def _blocks(benchmark: DataFrame):
    """The segments, in blocks of about BLOCK_SEGMENTS rows of at most SEGMENT bytes."""
    every = written(segments(benchmark), "segments")
    n = -(-every.count() // BLOCK_SEGMENTS)
    for k in range(n):
        rows = every.filter(F.pmod(F.xxhash64("item_id", "segment", "text"), F.lit(n)) == k).toArrow()
        if rows.num_rows:
            # equal segments (of a repetitive item, or of several) are searched once
            owners: dict[bytes, list] = {}
            for item, no, text in zip(*(rows.column(c).to_pylist() for c in ("item_id", "segment", "text"))):
                owners.setdefault(text, []).append((item, no))
            yield list(owners.values()), list(owners)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and, of the item's segments found in the text: how many, their
    edits, and the places (code points) where the first and the last one end."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, segment int, edits int, first long, last long"
    out = spark.createDataFrame([], schema)
    for owners, text in _blocks(benchmark):
        sent = spark.sparkContext.broadcast((owners, Index(text)))

        def find(batches, sent=sent):
            owners, index = sent.value
            for batch in batches:
                doc = batch.column("doc_id").to_pylist()
                best: dict[tuple, list] = {}     # of a text and segment: least edits, first and last end
                for r, s, e, p in _matches(batch, index):
                    b = best.setdefault((r, s), [e, p, p])
                    best[r, s] = [min(b[0], e), min(b[1], p), max(b[2], p)]
                got = [(doc[r], item, no, *b) for (r, s), b in best.items() for item, no in owners[s]]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got), (
                        pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                        names=["doc_id", "item_id", "segment", "edits", "first", "last"])

        out = out.unionByName(texts.mapInArrow(tidied(find), schema))
    best = out.groupBy("doc_id", "item_id", "segment").agg(F.min("edits").alias("edits"), F.min("first").alias("a"), F.max("last").alias("b"))
    return best.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("segments"), F.sum("edits").alias("edits"), F.min("a").alias("first_end"), F.max("b").alias("last_end"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no passage of the benchmark, all columns kept."""
    for _, text in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Index(text))

        def keep(batches, sent=sent):
            for batch in batches:
                hit = np.zeros(batch.num_rows, bool)
                hit[[r for r, *_ in _matches(batch, sent.value)]] = True
                yield batch.filter(pa.array(~hit))

        docs = docs.mapInArrow(tidied(keep), docs.schema)
    return docs

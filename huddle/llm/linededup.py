"""Line dedup: hashes of lines are range-partitioned and sorted by document and
position; first occurrences are streamed, and bitmaps of the kept lines returned.

Texts never move with the lines. A line is a 16-byte hash, its document, row
and position; the range is cut on all of them, so a line of a third of all
documents is spread over many partitions. Documents come largest first, so the
first occurrence is the one that stays. One pass over a sorted partition decides
every run of equal hashes that begins and ends in it; a run cut by a partition's
border is settled from at most three documents of each of its parts.

A document's bitmap has a bit for each line (1: kept), packed and compressed.

Defined cases: a null text is one empty line; lines end at ``\\n`` alone; rows
without a doc_id are one document smaller than all others (-2^63); rows of one
doc_id are one document, and all its lines stay if it is the largest that holds
them; equal rows share a bitmap; an empty table gives none; columns besides
doc_id and text are ignored by ``keep_bitmaps`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huddle.llm.common import written
from huddle.llm.tokens import tidied

LEAST_CHARS = 20       # of a key that may be dropped
LEAST_DOCS = 3         # documents that hold it
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)

_STREAMED = "line binary, doc long, row long, pos int, kind int"
_DROP, _OPEN, _SEEN = 0, 1, 2    # decided; waits for other partitions; a document of a cut run


def _identity(docs: DataFrame):
    """The document number and, with it, the row of a text."""
    return (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)),
            F.xxhash64(F.coalesce(docs["text"], F.lit(""))))


def _split(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row for each line whose key is long enough: line (hash of the key), doc, row, pos."""
    doc, row = _identity(docs)
    each = docs.select(doc.alias("doc"), row.alias("row"), F.posexplode(_split(docs["text"])).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(SPACES)), UPPER, LOWER)
    return each.select("doc", "row", "pos", key.alias("key")).filter(F.char_length("key") >= least_chars).select(
        F.unhex(F.md5(F.col("key").cast("binary"))).alias("line"), "doc", "row", "pos")


class _Runs:
    """Streams a partition sorted by line, then documents from the largest."""

    def __init__(self, least_docs: int):
        self.least = least_docs
        self.line = None           # of the run that the last batch ended in
        self.first = True          # that run is the partition's first
        self.doc = None            # its last document
        self.order = 0             # and which of the run's documents that is
        self.seen: list[int] = []  # its first documents, as many as decide
        self.pending: list = []    # its rows that a further document would drop

    def _rows(self, line, doc, row, pos, kind):
        n = len(doc)
        return pa.RecordBatch.from_arrays([
            line if line is not None else pa.nulls(n, pa.binary()), pa.array(doc, pa.int64()),
            pa.array(row, pa.int64()), pa.array(pos, pa.int32()), pa.array(np.full(n, kind, np.int32))],
            names=["line", "doc", "row", "pos", "kind"])

    def _border(self):
        """The documents of a run that a partition's border may cut."""
        n = len(self.seen)
        return self._rows(pa.array([self.line] * n, pa.binary()), self.seen, np.zeros(n), np.zeros(n), _SEEN)

    def batch(self, b: pa.RecordBatch):
        line = b.column(0).cast(pa.binary())
        doc, row, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        n = len(doc)
        new = np.ones(n, bool)     # a run begins here
        new[1:] = pc.not_equal(line.slice(1), line.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = self.line is None or line[0].as_py() != self.line
        fresh = new.copy()         # a document of the run begins here
        fresh[1:] |= doc[1:] != doc[:-1]
        if not new[0]:
            fresh[0] = doc[0] != self.doc
        starts = np.flatnonzero(new)
        count = np.cumsum(fresh)
        run = np.cumsum(new) - 1                 # -1: the run of the batch before
        base = np.append(count[starts] - 1, -self.order)
        order = count - base[run]                # which of its run's documents a row is of
        ends = np.append(starts[1:], n) - 1
        many = order[ends] >= self.least         # of each run that begins in this batch
        head = starts[0] if len(starts) else n   # rows of the run of the batch before
        if head:
            self._remember(doc[:head][fresh[:head]])
            yield from self._continue(line, doc, row, pos, order, 0, head)
        if not len(starts):
            self.doc, self.order = doc[-1], order[-1]
            return
        if self.line is not None:
            yield from self._close()
        first_here = self.line is None           # the first run of the partition begins here
        if first_here:
            a, z = 0, starts[1] if len(starts) > 1 else n
            self.line, self.first, self.seen, self.pending = line[0].as_py(), True, [], []
            self._remember(doc[a:z][fresh[a:z]])
            yield from self._continue(line, doc, row, pos, order, a, z)
            if len(starts) > 1:
                yield from self._close()
        # runs that begin and end in this batch, all but the partition's first
        decided = np.zeros(n, bool)
        whole = np.zeros(len(starts) + 1, bool)  # the last entry stands for run -1
        whole[1 if first_here else 0:len(starts) - 1] = True
        decided[:] = whole[run] & np.append(many, False)[run] & (order > 1)
        at = np.flatnonzero(decided)
        if len(at):
            yield self._rows(None, doc[at], row[at], pos[at], _DROP)
        last = starts[-1]
        if not (first_here and len(starts) == 1):
            self.line, self.first, self.seen, self.pending = line[int(last)].as_py(), False, [], []
            self._remember(doc[last:][fresh[last:]])
            yield from self._continue(line, doc, row, pos, order, last, n)
        self.doc, self.order = doc[-1], order[-1]

    def _remember(self, docs):
        self.seen.extend(docs[:max(self.least - len(self.seen), 0)].tolist())

    def _continue(self, line, doc, row, pos, order, a, z):
        """Rows a to z of the current run, which may go on."""
        if self.first:             # its largest document may be in the partition before
            yield self._rows(line.slice(a, z - a), doc[a:z], row[a:z], pos[a:z], _OPEN)
            return
        late = np.flatnonzero(order[a:z] > 1) + a
        if len(late):
            self.pending.append((doc[late], row[late], pos[late]))
        if order[z - 1] >= self.least:
            for d, r, p in self.pending:
                yield self._rows(None, d, r, p, _DROP)
            self.pending = []

    def _close(self):
        """The current run is over, inside the partition."""
        if self.first:
            yield self._border()
        self.pending = []

    def end(self):
        if self.line is None:
            return
        yield self._border()
        for d, r, p in self.pending:
            yield self._rows(pa.array([self.line] * len(d), pa.binary()), d, r, p, _OPEN)


def _streamer(least_docs: int):
    def work(batches):
        runs = _Runs(least_docs)
        for b in batches:
            if b.num_rows:
                yield from runs.batch(b)
        yield from runs.end()
    return tidied(work)


def dropped(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The lines that go: doc, row, pos (repeated rows may be named twice)."""
    # written, so that the range's sample does not split the texts a second time
    rows = written(lines(docs, least_chars), "lines")
    keys = [F.asc("line"), F.desc("doc"), F.asc("row"), F.asc("pos")]
    sorted_rows = rows.select("line", "doc", "row", "pos").repartitionByRange(*keys).sortWithinPartitions(*keys)
    found = written(sorted_rows.mapInArrow(_streamer(least_docs), _STREAMED), "line-runs")
    # At most two runs of a partition are cut, so this has two rows a partition at most.
    docs_of = found.filter(f"kind = {_SEEN}").select("line", "doc").distinct()
    cut = docs_of.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("largest")).filter(
        F.col("docs") >= least_docs)
    late = found.filter(f"kind = {_OPEN}").join(F.broadcast(cut), "line").filter("doc < largest")
    return found.filter(f"kind = {_DROP}").select("doc", "row", "pos").unionByName(late.select("doc", "row", "pos"))


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines, gone):
    import pandas as pd

    def one(n, positions):
        bits = np.ones(n, bool)
        if positions is not None:
            bits[np.asarray(positions, np.int64)] = False
        return zlib.compress(np.packbits(bits).tobytes())
    return pd.Series([one(n, p) for n, p in zip(n_lines, gone)], dtype=object)


@F.pandas_udf(T.StringType())
def _kept(text, keep):
    import pandas as pd

    def one(t, k):
        t = t or ""
        if k is None:
            return t
        parts = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=len(parts))
        return "\n".join(p for p, b in zip(parts, bits) if b)
    return pd.Series([one(t, k) for t, k in zip(text, keep)], dtype=object)


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """For each distinct (doc, row): n_lines, n_dropped, keep (compressed bits, 1 for each kept line).

    ``doc`` is the doc_id (-2^63 if null), ``row`` tells texts of one doc_id apart.
    """
    docs = docs.select("doc_id", "text")
    doc, row = _identity(docs)
    gone = dropped(docs, least_chars, least_docs).groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))
    every = docs.select(doc.alias("doc"), row.alias("row"), F.size(_split(docs["text"])).cast("long").alias("n_lines"))
    return every.distinct().join(gone, ["doc", "row"], "left").select(
        "doc", "row", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        _bitmap("n_lines", "gone").alias("keep"))


def deduplicated(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the kept lines as text; columns n_lines and n_dropped of the bitmap are put behind."""
    doc, row = _identity(docs)
    b = bitmaps.select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("n_lines").alias("__lines"),
                       F.col("n_dropped").alias("__dropped"),
                       F.when(F.col("n_dropped") > 0, F.col("keep")).alias("__keep"))
    joined = docs.join(b, (doc == b["__doc"]) & (row == b["__row"]))
    columns = [_kept(docs["text"], b["__keep"]).alias("text") if c == "text" else docs[c] for c in docs.columns]
    return joined.select(*columns, b["__lines"], b["__dropped"])


def deduplicated_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""
    docs = docs.select("doc_id", "text")
    rows = deduplicated(docs, written(keep_bitmaps(docs), "line-bitmaps"))
    return rows.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

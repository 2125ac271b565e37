"""Token-id files: an adaptive context-mixing range coder.

A file's rows are blocks of at most ``BLOCK_IDS`` ids. A block is coded by
itself: its models start empty and it carries checksums of its bytes and ids.
The ids of a block lie in lanes, each with a range coder of its own, and one
step codes the next id of every lane with array operations.

For each id, order 2 and order 1 predict one id each (the last one that
followed the same two ids, or the same id) with a confidence; order 0 gives
every id a share by its count. A flag says which prediction holds; the
shares of its three values are learnt for each state of confidence, which mixes
the orders. If neither prediction holds, the id takes its share of order 0 within
the flag's, so flag and id are one symbol for the range coder. The models learn
after every ``STEPS`` steps, from what the reader has read by then too.

Defined results: null text is an empty text (the end id alone); documents are
in order of doc_id (null first), repeated ids by a hash of the text; an empty
table gives no files and no rows; a wrong checksum raises ValueError; other
columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from huddle.llm.tokens import encoded_slices, tidied

BLOCK_IDS = 1 << 20
LANES = 4096
MIN_LANE_IDS = 128
STEPS = 24
TEXT_BYTES = 16 << 20        # text turned into ids at once
_BITS1, _BITS2 = 16, 20
_FLAG_BITS, _ID_BITS = 10, 20      # shares are of these powers of two
_BITS = _FLAG_BITS + _ID_BITS      # of a flag and an id, coded as one symbol
_U = np.uint64
_BOT, _W32 = np.uint64(1 << 32), np.uint64(32)
_MAGIC = b"IDC2"
_HEAD = struct.Struct("<4sIIII")             # magic, ids, lanes, crc32 of ids, crc32 of the rest


class Model:
    """What a block has learnt so far; the same on the writing and the reading side."""

    def __init__(self, vocab: int):
        # the id that followed last, and how often in a row (2 bits)
        self.slots1, self.slots2 = np.zeros(1 << _BITS1, np.int32), np.zeros(1 << _BITS2, np.int32)
        self.count, self.seen = np.zeros(vocab, np.int64), 0
        self.flags = np.ones((32, 3), np.int64)
        self._tables()

    def _tables(self):
        # the last id and the last flag get what rounding leaves
        vocab = len(self.count)
        if self.seen:
            freq = 1 + self.count * ((1 << _ID_BITS) - vocab) // self.seen
        else:
            freq = np.full(vocab, (1 << _ID_BITS) // vocab)
        self.cum = np.zeros(vocab + 1, np.uint64)
        self.cum[1:] = np.cumsum(freq)
        self.cum[-1] = 1 << _ID_BITS
        share = 1 + self.flags * ((1 << _FLAG_BITS) - 3) // self.flags.sum(1, keepdims=True)
        one, two = share[:, 0], share[:, 0] + share[:, 1]
        # by 3 * state + flag: where the share of a flag starts, and its size
        self.flag_start = np.column_stack([np.zeros_like(one), one, two]).ravel().astype(np.uint64) << _U(_ID_BITS)
        self.flag_size = np.column_stack([one, two - one, (1 << _FLAG_BITS) - two]).ravel().astype(np.uint64)
        self.flag1, self.flag2 = self.flag_start[1::3].copy(), self.flag_start[2::3].copy()

    def id_table(self) -> np.ndarray:
        """The id at every place of order 0."""
        return np.repeat(np.arange(len(self.count), dtype=np.int32), np.diff(self.cum.astype(np.int64)))

    def predict(self, before: np.ndarray, last: np.ndarray):
        """Slots of both contexts, both predictions and the state of confidence."""
        h1 = (last * 40503 >> 3) & ((1 << _BITS1) - 1)
        h2 = ((before * 2654435761 + last * 40503001) >> 7) & ((1 << _BITS2) - 1)
        g1, g2 = self.slots1.take(h1), self.slots2.take(h2)
        p1, p2 = g1 >> 2, g2 >> 2
        c1, c2 = g1 & 3, g2 & 3
        return h1, h2, p1, p2, (c2 << 2) + c1 + ((p1 == p2) * np.int32(16))

    def learn(self, h1, h2, p1, p2, state, flag, ids):
        """Takes in some steps, flat and in step order (of equal slots the last counts)."""
        self.flags += np.bincount(state * 3 + flag, minlength=96).reshape(32, 3)
        self.slots1[h1] = (ids << 2) + np.minimum((state & 3) + 1, 3) * (p1 == ids)
        self.slots2[h2] = (ids << 2) + np.minimum((state >> 2 & 3) + 1, 3) * (p2 == ids)
        self.count += np.bincount(ids, minlength=len(self.count))
        self.seen += len(ids)
        self._tables()


class Writer:
    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.out = np.zeros((lanes, steps + 2), np.uint32)   # a symbol of _BITS bits ends one word at most
        self.n = np.zeros(lanes, np.int64)

    def put(self, start: np.ndarray, size: np.ndarray) -> None:
        """One symbol of every lane."""
        self.range >>= _U(_BITS)
        self.low += start * self.range
        self.range *= size
        k = np.flatnonzero(_due(self.low, self.range))
        if len(k):
            low = self.low[k]
            self.out[k, self.n[k]] = low >> _W32
            self.n[k] += 1
            self.range[k] = _cut(low, self.range[k]) << _W32
            self.low[k] = low << _W32

    def end(self) -> None:
        k = np.arange(len(self.low))
        for _ in range(2):
            self.out[k, self.n] = self.low >> _W32
            self.low = self.low << _W32
            self.n += 1


def _due(low, rng):
    """Whether the upper word is settled, or the range too small for a symbol."""
    return ((low ^ (low + rng)) < _BOT) | (rng < _BOT)


def _cut(low, rng):
    """The range, ended where the upper word would change."""
    return np.where((low ^ (low + rng)) >= _BOT, (~low + _U(1)) & (_BOT - _U(1)), rng)


class Reader:
    def __init__(self, words: np.ndarray, n: np.ndarray):
        self.words = np.append(words, np.zeros(2, np.uint32)).astype(np.uint64)
        self.at = np.cumsum(n) - n
        self.low = np.zeros(len(n), np.uint64)
        self.range = np.full(len(n), 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.code = np.zeros(len(n), np.uint64)
        for _ in range(2):
            self.code = (self.code << _W32) | self.words[self.at]
            self.at += 1

    def value(self) -> np.ndarray:
        self.range >>= _U(_BITS)
        return np.minimum((self.code - self.low) // self.range, _U((1 << _BITS) - 1))

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        self.low += start * self.range
        self.range *= size
        k = np.flatnonzero(_due(self.low, self.range))
        if len(k):
            low = self.low[k]
            self.code[k] = (self.code[k] << _W32) | self.words[self.at[k]]
            self.at[k] += 1
            self.range[k] = _cut(low, self.range[k]) << _W32
            self.low[k] = low << _W32


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // MIN_LANE_IDS))


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    """The bytes of one block."""
    n = len(ids)
    lanes = _lanes(n)
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids                                       # the last lanes are filled up with 0
    grid = grid.reshape(lanes, steps).T
    prev = np.zeros((steps + 2, lanes), np.int64)
    prev[2:] = grid
    model, out = Model(vocab), Writer(lanes, steps)
    for a in range(0, steps, STEPS):
        b = min(steps, a + STEPS)
        now = grid[a:b].ravel()
        told = model.predict(prev[a:b].ravel(), prev[a + 1:b + 1].ravel())
        p1, p2, state = told[-3:]
        flag = np.where(p2 == now, 0, np.where(p1 == now, 1, 2))
        f_start, f_size = model.flag_start.take(state * 3 + flag), model.flag_size.take(state * 3 + flag)
        # a flag that tells the id takes the whole of its share, the others the share of the id in it
        first, escaped = model.cum.take(now), flag == 2
        start = f_start + first * f_size * escaped
        size = f_size * np.where(escaped, model.cum.take(now + 1) - first, _U(1 << _ID_BITS))
        for k in range(0, len(now), lanes):
            out.put(start[k:k + lanes], size[k:k + lanes])
        model.learn(*told, flag, now)
    out.end()
    words = out.out[np.arange(out.out.shape[1]) < out.n[:, None]]
    rest = out.n.astype("<u4").tobytes() + words.astype("<u4").tobytes()
    return _HEAD.pack(_MAGIC, n, lanes, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(rest)) + rest


def decode_block(block: bytes, vocab: int) -> np.ndarray:
    """The ids of one block; raises ValueError if a checksum differs."""
    if len(block) < _HEAD.size:
        raise ValueError("truncated block")
    magic, n, lanes, ids_crc, rest_crc = _HEAD.unpack_from(block)
    rest = block[_HEAD.size:]
    if magic != _MAGIC or zlib.crc32(rest) != rest_crc:
        raise ValueError("damaged block")
    count = np.frombuffer(rest, "<u4", lanes).astype(np.int64)
    reader = Reader(np.frombuffer(rest, "<u4", offset=4 * lanes), count)
    steps = -(-n // lanes)
    prev = np.zeros((steps + 2, lanes), np.int64)
    model = Model(vocab)
    for a in range(0, steps, STEPS):
        b, told, table = min(steps, a + STEPS), [], model.id_table()
        for t in range(a, b):
            guess = model.predict(prev[t], prev[t + 1])
            p1, p2, state = guess[-3:]
            v = reader.value()
            second, escaped = v >= model.flag1.take(state), v >= model.flag2.take(state)
            flag = second.astype(np.int64) + escaped
            now = np.where(second, p1, p2)
            start, size = model.flag_start.take(state * 3 + flag), model.flag_size.take(state * 3 + flag)
            left = np.flatnonzero(escaped)
            own = size[left]
            got = table.take(((v[left] - start[left]) // own).astype(np.int64))
            first = model.cum.take(got)
            now[left] = got
            start[left] += first * own
            size <<= _U(_ID_BITS)
            size[left] = own * (model.cum.take(got + 1) - first)
            reader.take(start, size)
            prev[t + 2] = now
            told.append((*guess, flag, now))
        model.learn(*(np.concatenate(x) for x in zip(*told)))
    ids = prev[2:].T.ravel()[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("damaged block: the ids differ")
    return ids


BLOCKS = ("part int, block int, first long, n_ids long, doc_id array<long>, doc_no array<long>, "
          "piece_no array<int>, n array<int>, payload binary")


def _write(batches, path, end_id, vocab, block_ids):
    part, block, first, doc_no = TaskContext.get().partitionId(), 0, 0, -1
    ids: list[np.ndarray] = []
    rows: list[tuple] = []           # doc_id, doc_no, piece_no, n
    held = 0

    def flush():
        nonlocal block, first, ids, rows, held
        got = np.concatenate(ids)
        doc, no, piece, n = (list(x) for x in zip(*rows))
        out = pa.RecordBatch.from_pydict(
            {"part": [part], "block": [block], "first": [first], "n_ids": [len(got)], "doc_id": [doc], "doc_no": [no],
             "piece_no": [piece], "n": [n], "payload": [encode_block(got, vocab)]}, schema=_ARROW)
        block, first, ids, rows, held = block + 1, first + len(got), [], [], 0
        return out

    for batch in batches:
        names = batch.column("doc_id").to_pylist()
        for a, b, flat, count in encoded_slices(batch.column("text"), path, TEXT_BYTES):
            at = 0
            for i in range(a, b):
                own = np.append(flat[at:at + int(count[i - a])], end_id).astype(np.int32)
                at += int(count[i - a])
                doc_no, piece = doc_no + 1, 0
                while len(own):
                    take = own[:block_ids - held]
                    ids.append(take)
                    rows.append((names[i], doc_no, piece, len(take)))
                    held, own, piece = held + len(take), own[len(take):], piece + 1
                    if held == block_ids:
                        yield flush()
    if held:
        yield flush()


_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                    ("doc_id", pa.list_(pa.int64())), ("doc_no", pa.list_(pa.int64())),
                    ("piece_no", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("payload", pa.binary())])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, vocab: int = 50_257,
              block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all documents to ``path``, in ascending order of doc_id."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(tidied(partial(_write, path=tokenizer, end_id=end_id, vocab=vocab, block_ids=block_ids)), BLOCKS).write.parquet(path)


def _read(batches, vocab):
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_block(row["payload"], vocab).astype("<u4")
            n = np.asarray(row["n"], np.int64)
            end = np.cumsum(n)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([row["part"]] * len(n), pa.int32()), "doc_no": pa.array(row["doc_no"], pa.int64()),
                "piece_no": pa.array(row["piece_no"], pa.int32()), "doc_id": pa.array(row["doc_id"], pa.int64()),
                "at": pa.array(row["first"] + end - n, pa.int64()), "n": pa.array(n, pa.int64()),
                "crc": pa.array([zlib.crc32(ids[e - k:e]) for e, k in zip(end, n)], pa.int64())})


@F.pandas_udf(LongType())
def _joined_crc(parts: pd.Series) -> pd.Series:
    """crc32 of pieces in a row, from each piece's crc32 and its number of ids."""
    def one(rows):
        crc = rows[0]["crc"]
        for r in rows[1:]:
            zeros = bytes(4 * int(r["n"]))
            crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ r["crc"]
        return crc
    return parts.map(one)


def read_ids(spark, path: str, vocab: int = 50_257) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one row per writing task: how many ids are before it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = blocks.mapInArrow(
        tidied(partial(_read, vocab=vocab)), "part int, doc_no long, piece_no int, doc_id long, at long, n long, crc long")
    docs = found.groupBy("part", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("piece_no", "n", "crc"))).alias("pieces"))
    return docs.join(parts, "part").select(
        "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens",
        _joined_crc("pieces").alias("ids_crc32"))

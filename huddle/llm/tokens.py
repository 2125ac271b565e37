"""Token ids of whole texts with the ``tokenizers`` library, for Arrow batches.

Byte-level BPE merges never cross the boundaries of its pre-tokens, so a text
may be cut at any such boundary and the ids of the pieces joined again. Words
repeat: a batch is cut at boundaries that can be told from ASCII bytes alone,
each distinct piece is encoded once, and the ids are gathered back. The memo of
pieces is bounded, and only saves work: the ids are those of the whole text.
"""

from __future__ import annotations

import ctypes
import os

import numpy as np
import pyarrow as pa

MEMO_PIECES = 900_000       # distinct pieces remembered by one Python worker
SLICE_BYTES = 4 << 20       # text handled at once
JOINED = 512                # new words encoded with one call



def tidied(work):
    """``work`` over a task's batches; at its end the worker, which Spark uses again for
    other tasks, gives back memory that its allocators would keep."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
    return run


_ALNUM, _PUNCT, _SPACE, _OTHER_WS, _LEAD = 1, 2, 3, 4, 5


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)          # 0: nothing is known
    for b in range(33, 127):
        table[b] = _ALNUM if chr(b).isalnum() else _PUNCT
    table[32] = _SPACE
    table[9:14] = _OTHER_WS
    table[0xC3:0xE0] = _LEAD                 # first bytes of characters that aren't white space
    table[0xE4:0xF5] = _LEAD
    return table


_CLASSES = _byte_classes()
_SOLID = frozenset(np.flatnonzero((_CLASSES == _ALNUM) | (_CLASSES == _PUNCT) | (_CLASSES == _LEAD)).tolist())


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the n+1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of about ``limit`` bytes each (one row at least)."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


def piece_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the texts may be cut without changing any id."""
    n = len(raw)
    cls = _CLASSES[raw]
    latin = np.zeros(n, bool)                # letters U+00C0 to U+00FF
    latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    cls[latin] = _ALNUM
    first = off[:-1][off[:-1] < off[1:]]     # first byte of each text that has one
    prev = np.zeros(n, np.uint8)
    prev[1:] = cls[:-1]
    prev[first] = 0
    prev2 = np.zeros(n, np.uint8)
    prev2[1:] = prev[:-1]
    prev2[first] = 0
    nxt = np.zeros(n, np.uint8)
    nxt[:-1] = cls[1:]
    nxt[first[1:] - 1] = 0
    solid = (cls == _ALNUM) | (cls == _PUNCT) | (cls == _LEAD)
    solid[latin] = False
    cut = (cls == _SPACE) & ((nxt == _ALNUM) | (nxt == _PUNCT) | (nxt == _LEAD))
    cut |= (prev == _ALNUM) & (cls == _PUNCT)
    known = (prev == _ALNUM) | (prev == _PUNCT)
    cut |= known & ((cls == _SPACE) | (cls == _OTHER_WS))
    cut |= (prev == _OTHER_WS) & solid & ((prev2 == _ALNUM) | (prev2 == _PUNCT))
    cut[first] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts, as ``tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        # bytes of each id: the characters of a byte-level token stand for one byte each
        self.width = np.zeros(self.tok.get_vocab_size(), np.int64)
        for token, i in self.tok.get_vocab().items():
            self.width[i] = len(token)
        self.memo: dict[bytes, int] = {}
        # the ids of piece k are pool[pool_off[k]:pool_off[k + 1]]; both arrays have room at the end
        self.pool = np.zeros(1 << 16, np.int32)
        self.pool_off = np.zeros(1 << 14, np.int64)

    @staticmethod
    def _room(array: np.ndarray, need: int) -> np.ndarray:
        if need <= len(array):
            return array
        return np.concatenate([array, np.zeros(max(need - len(array), len(array)), array.dtype)])

    def _add(self, pieces: list[bytes]) -> None:
        # Words with a leading space are encoded JOINED at a time, which saves
        # calls; their ids are told apart by the bytes they stand for.
        words, rest = [], []
        for p in pieces:
            (words if p[0] == 32 and len(p) > 1 and p[1] in _SOLID and p[-1] > 32 else rest).append(p)
        joined = [b"".join(words[i:i + JOINED]).decode() for i in range(0, len(words), JOINED)]
        coded = self.tok.encode_batch_fast(joined + [p.decode() for p in rest], add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, np.int32) for e in coded])
        ends = np.cumsum([len(p) for p in words + rest])
        stops = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
        first = len(self.memo)
        at = int(self.pool_off[first])
        self.pool = self._room(self.pool, at + len(ids))
        self.pool[at:at + len(ids)] = ids
        self.pool_off = self._room(self.pool_off, first + len(stops) + 1)
        self.pool_off[first + 1:first + len(stops) + 1] = stops + at
        self.memo.update(zip(words + rest, range(first, first + len(stops))))

    def _whole(self, text: bytes) -> np.ndarray:
        return np.asarray(self.tok.encode(text.decode("utf-8"), add_special_tokens=False).ids, np.int32)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        n = len(off) - 1
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        if any(s in memoryview(raw).tobytes() for s in self.special):
            # a special token may stand anywhere in such a text: no cuts
            parts = [self._whole(raw[off[i]:off[i + 1]].tobytes()) for i in range(n)]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        starts = piece_starts(raw, off)
        bounds = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        memo = self.memo
        known = list(map(memo.get, distinct))
        missing = [p for p, at in zip(distinct, known) if at is None]
        if missing:
            self._add(missing)
            known = list(map(memo.get, distinct))
        at = np.array(known, np.int64)
        piece = coded.indices.to_numpy(zero_copy_only=False)
        begin, count = self.pool_off[at].take(piece), (self.pool_off[at + 1] - self.pool_off[at]).take(piece)
        total = np.zeros(len(piece) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        place = np.repeat(begin - total[:-1], count)
        place += np.arange(total[-1])
        ids = self.pool.take(place)
        doc_at = np.searchsorted(starts, off)            # first piece of each text
        return ids, total[doc_at[1:]] - total[doc_at[:-1]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded_slices(column: pa.Array, path: str, limit: int = SLICE_BYTES):
    """Yields (first row, end row, ids, ids per text) over a batch's texts."""
    raw, off = text_buffer(column)
    enc = encoder(path)
    for a, b in slices(off, limit):
        ids, count = enc.encode(raw[off[a]:off[b]], off[a:b + 1] - off[a])
        yield a, b, ids, count


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

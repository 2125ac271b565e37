import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from huddle.llm import idcoder, packing
from huddle.llm.tokens import encoded_slices


def brute(rows, path, end):
    t = Tokenizer.from_file(path)
    return [(d, t.encode(x or "", add_special_tokens=False).ids + [end]) for d, x, *_ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_keep_ids(tokenizer):
    r = random.Random(3)
    al = ["a", "B", "7", " ", "  ", "\n", "\t", "'", "'s", ".", "!", "é", "×", " ", "—", "日本", "😀", "\x1c", "\r\n", "ß", "<|endoftext|>"]
    for special in (False, True):
        texts = ["".join(r.choice(al if special else al[:-1]) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [None, ""]
        t = Tokenizer.from_file(tokenizer)
        got = []
        for _, _, ids, n in encoded_slices(pa.array(texts), tokenizer):
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_place_fills_and_fits():
    size = np.random.default_rng(1).integers(1, 64, 3000)
    seq, offset, gaps = packing.place(size, 64)
    for s in range(len(gaps)):
        own = np.flatnonzero(seq == s)
        own = own[np.argsort(offset[own])]
        assert (offset[own] == np.cumsum(size[own]) - size[own]).all() and size[own].sum() + gaps[s] == 64
    assert len(gaps) <= 1.01 * size.sum() / 64


@pytest.mark.parametrize("group", [40_000, 20])
def test_pack(docs, docs_rows, tokenizer, group):
    got = packing.pack(docs, tokenizer, capacity=128, group_pieces=group).collect()
    want = sorted(crc(ids) for _, ids in brute(docs_rows, tokenizer, 2) if len(ids) <= 128)
    cut = {r.doc_id for r in got if r.piece > 0}
    assert sorted(r.ids_crc32 for r in got if r.doc_id not in cut) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 128
    long = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 106)
    ids = dict(brute([x for x in docs_rows if x[0] == 106], tokenizer, 2))[106]
    assert [x[2] for x in long[1:]] == [128] * (len(long) - 1) and sum(x[2] for x in long) == len(ids)
    assert all(crc(ids[s:s + n]) == c for _, s, n, c in long)
    total = sum(r.length for r in got)
    assert total == sum(len(i) for _, i in brute(docs_rows, tokenizer, 2))
    assert len(by) <= -(-total // 128) + (2 if group > 100 else 6)


def test_pack_empty(none, tokenizer):
    assert packing.pack(none, tokenizer).count() == 0


@pytest.mark.parametrize("n", [1, 2, 129, 5000, 200_000])
def test_block_round_trip(n):
    g = np.random.default_rng(n)
    for ids in (g.integers(0, 50_257, n), np.full(n, 50_256), g.integers(0, 50, n)):
        assert (idcoder.decode_block(idcoder.encode_block(ids, 50_257), 50_257) == ids).all()


def test_block_damage():
    b = bytearray(idcoder.encode_block(np.arange(500), 50_257))
    for at in (5, 20, len(b) - 3):
        bad = bytearray(b)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            idcoder.decode_block(bytes(bad), 50_257)
    with pytest.raises(ValueError):
        idcoder.decode_block(b"IDC", 50_257)


def test_writer_ends_one_word_a_symbol():
    """The least shares there are, at the ends and across word borders, against the reader."""
    g = np.random.default_rng(5)
    top, lanes = 1 << idcoder._BITS, 300
    start = g.choice(np.array([0, 1, top // 2 - 1, top // 2, top - 1]), (200, lanes)).astype(np.uint64)
    size = np.ones_like(start)
    writer = idcoder.Writer(lanes, len(start))
    for s, z in zip(start, size):
        writer.put(s, z)
    writer.end()
    assert (writer.n <= len(start) + 2).all()
    reader = idcoder.Reader(writer.out[np.arange(writer.out.shape[1]) < writer.n[:, None]], writer.n)
    for s, z in zip(start, size):
        assert (reader.value() == s).all()
        reader.take(s, z)


def test_flag_and_id_are_one_symbol(monkeypatch):
    """A step of all lanes costs one call of the coder, however many ids no order foretells."""
    calls = []
    put = idcoder.Writer.put
    monkeypatch.setattr(idcoder.Writer, "put", lambda self, *a: (calls.append(1), put(self, *a)))
    ids = np.random.default_rng(1).integers(0, 50_257, 50_000)
    idcoder.encode_block(ids, 50_257)
    assert len(calls) == -(-len(ids) // idcoder._lanes(len(ids)))


def test_repeats_compress():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_257, 300), 700)
    assert len(idcoder.encode_block(ids, 50_257)) < 0.75 * len(ids)


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_files(docs, docs_rows, tokenizer, tmp_path, block, spark):
    # blocks of 700 ids: documents go over several
    idcoder.write_ids(docs, str(tmp_path / "ids"), tokenizer, block_ids=block)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in idcoder.read_ids(spark, str(tmp_path / "ids")).collect())
    want = {(d, len(i), crc(i)) for d, i in brute(docs_rows, tokenizer, 0)}
    assert {(d if some else None, n, c) for some, d, _, n, c in got} == want and len(got) == len(docs_rows)
    at = 0
    for _, _, start, n, _ in sorted(got, key=lambda x: x[2]):
        assert start == at
        at += n
    assert [x[1] for x in sorted(got, key=lambda x: x[2]) if x[0]] == sorted(d for d, *_ in docs_rows if d is not None)


def test_files_empty(none, tokenizer, tmp_path, spark):
    idcoder.write_ids(none, str(tmp_path / "ids"), tokenizer)
    assert idcoder.read_ids(spark, str(tmp_path / "ids")).count() == 0

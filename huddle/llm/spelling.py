"""Spelling variants: a bit-sliced position index over the vocabulary.

For each (position, letter) a bitset says which words have that letter there.
A query word is read letter by letter; one word-parallel step carries the set of
words without an error so far and the sets with one error, whose positions are
shifted: a replaced letter (none), a letter more in the word (one ahead), a
letter more in the query (one behind). An error is entered only where the words
first differ, so each pair is found once.

Vocabularies are split so that near words always meet. Words of ``n`` and
``n + 1`` letters first differ at some position; all positions are cut into
intervals, and words that agree before and after an interval form a group.
Groups over ``GROUP_WORDS`` are split again by halves of their interval; those of
one position hold a few thousand words at most (all their letters but one or
two are equal), so no group grows with the vocabulary and no word is left out.
Groups are indexed many at a time, 64 words to a machine word.

Forms: a word's form is its near word with the largest count, if that is at
least ``RATIO`` times its own; counts grow tenfold with each step, so chains
are short, and pointer doubling follows them.

Defined cases: null texts have no words; a null doc_id is hashed as an empty one;
repeated rows count again; ties go to the smallest word in code-point order;
words may have any length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import release, written
from huddle.llm.tokens import tidied

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 7
LEAST_COUNT = 2
DAMAGED_BY = 31        # every run whose hash this divides loses a letter
RATIO = 10
GROUP_WORDS = 512      # groups above it are split by halves of their interval
CHUNK_ROWS = 50_000    # words indexed at once (whole groups)

_NEAR = "word string, n_near long, form_n long, form string"


def damaged_runs(docs: DataFrame) -> DataFrame:
    """Every run that can give a word, in lower case, with its letter deleted where the hash says so."""
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc"),
                       F.explode(F.regexp_extract_all(docs["text"], F.lit(RUN), 0)).alias("run"))
    runs = runs.filter(F.char_length("run") >= LEAST_LETTERS).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.select(F.when(F.col("h") % DAMAGED_BY == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    counted = words.filter(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the group: words of ``kind`` or ``kind + 1`` letters that agree outside [lo, hi)."""
    tail = F.greatest(F.col("kind") - F.col("hi"), F.lit(0))
    key = F.concat_ws(" ", "kind", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")),
                      F.when(tail > 0, F.substring("word", F.char_length("word") - tail + 1, tail)).otherwise(""))
    return rows.select("word", "n", "kind", "lo", "hi", key.alias("key"))


def _halves(rows: DataFrame) -> DataFrame:
    mid = F.expr("(lo + hi) div 2").cast("int")
    two = F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))
    return _keyed(rows.select("word", "n", "kind", F.explode(two).alias("cut")).select("word", "n", "kind", "cut.lo", "cut.hi"))


def groups(vocab: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """All memberships of words in groups; each pair of near words meets in exactly one group as a pair."""
    letters = F.char_length("word")
    kinds = vocab.select("word", "n", F.explode(F.array(letters, letters - 1)).alias("kind"))
    rows = _halves(kinds.withColumn("lo", F.lit(0)).withColumn("hi", F.col("kind") + 1))
    done = []
    while True:
        # at most 1 / group_words of the rows; Spark broadcasts them only if they are few
        big = written(rows.filter("hi - lo > 1").groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(
            F.col("c") > group_words).select("key"), "spelling-big")
        if big.isEmpty():
            break
        done.append(rows.join(big, "key", "left_anti"))
        rows = written(_halves(rows.join(big, "key", "left_semi")), "spelling-groups")
    for more in done:
        rows = rows.unionByName(more)
    return rows


# ---- the index, over many groups at once ----

_CLASS = np.full(256, -1, np.int64)
_CLASS[97:123] = np.arange(26)
_CLASS[0xC0:0x100] = np.arange(26, 26 + 64)
_LETTERS = 90


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of all words in a row, and the offsets of the words."""
    words = words.cast(pa.large_string())
    text = "".join(words.to_pylist()).encode("latin-1")
    off = np.zeros(len(words) + 1, np.int64)
    np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), out=off[1:])
    return _CLASS[np.frombuffer(text, np.uint8)], off


class _Slices:
    """Bitsets by (block of 64 words, position, letter), kept sorted; absent ones are empty."""

    def __init__(self, block, place, letter, bit, width):
        code = (block * width + place) * _LETTERS + letter
        order = np.argsort(code, kind="stable")
        code, bits = code[order], np.left_shift(np.uint64(1), bit[order].astype(np.uint64))
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        self.width = width
        self.codes = np.append(code[first], -1)       # the last set is empty
        self.sets = np.append(np.bitwise_or.reduceat(bits, first), np.uint64(0)) if len(code) else np.zeros(1, np.uint64)

    def get(self, block, place, letter):
        """The sets of the given letters there; letter -1 (no letter) has none."""
        want = (block * self.width + place) * _LETTERS + letter
        at = np.searchsorted(self.codes[:-1], want)
        return np.where((self.codes[at] == want) & (letter >= 0), self.sets[at], np.uint64(0))


def near_words(words: pa.Array, n: np.ndarray, kind: np.ndarray, lo: np.ndarray, hi: np.ndarray,
               start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by group and, in it, best word first: which rows have near words, how many, and the best's row.

    ``start`` has the first row of each group, and the number of rows last.
    """
    letters, off = _letters(words)
    size = np.diff(start)
    blocks = (size + 63) // 64
    block0 = np.cumsum(blocks) - blocks
    group = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(words)) - start[group]
    block, bit = block0[group] + inside // 64, inside % 64
    length = np.diff(off)
    short = length == kind
    one = np.left_shift(np.uint64(1), bit.astype(np.uint64))
    shorts, longs = np.zeros(blocks.sum(), np.uint64), np.zeros(blocks.sum(), np.uint64)
    np.bitwise_or.at(shorts, block[short], one[short])
    np.bitwise_or.at(longs, block[~short], one[~short])

    # the letters at positions lo to hi of each word
    span = hi - lo
    here = np.maximum(np.minimum(hi + 1, length) - lo, 0)
    row = np.repeat(np.arange(len(words)), here)
    place = np.arange(len(row)) - np.repeat(np.cumsum(here) - here, here)
    sets = _Slices(block[row], place, letters[off[row] + lo[row] + place], bit[row], int(span.max()) + 1)

    # a cell: a query word and one block of its group; the longest intervals first
    cells = blocks[group]
    q = np.repeat(np.arange(len(words)), cells)
    b = np.repeat(block0[group], cells) + np.arange(len(q)) - np.repeat(np.cumsum(cells) - cells, cells)
    order = np.argsort(-span[q], kind="stable")
    q, b = q[order], b[order]
    q_short, span_q, lo_q = short[q], span[q], lo[q]
    length_q = length[q]
    exact = np.where(q_short, shorts[b] | longs[b], shorts[b])
    replaced, ahead, behind = (np.zeros(len(q), np.uint64) for _ in range(3))
    # A short query meets short words (replaced) and long ones (ahead); a long query short ones (behind).
    may_replace = np.where(q_short, shorts[b], np.uint64(0))
    may_ahead = np.where(q_short, longs[b], np.uint64(0))
    may_behind = np.where(q_short, np.uint64(0), shorts[b])
    for s in range(int(span.max()) + 1 if len(q) else 0):
        k = int(np.searchsorted(-span_q, -s, "right"))       # cells whose interval reaches step s
        at = lo_q[:k] + s
        bk, qk = b[:k], q[:k]
        some = at < length_q[:k]
        c = np.where(some, letters[np.minimum(off[qk] + at, len(letters) - 1)], -1)
        enter = s < span_q[:k]                               # else only a letter behind is checked
        match = sets.get(bk, s, c)
        miss = np.where(enter, exact[:k] & ~match, np.uint64(0))
        after = sets.get(bk, s + 1, np.where(enter, c, -1))
        before = sets.get(bk, s - 1, c) if s else np.zeros(k, np.uint64)
        # a short query that has ended keeps its words: a last letter more is left in the long ones
        over = q_short[:k] & ~some
        replaced[:k] = np.where(over | ~enter, replaced[:k], (replaced[:k] & match) | (miss & may_replace[:k]))
        ahead[:k] = np.where(~enter, ahead[:k], np.where(over, ahead[:k] | (miss & may_ahead[:k]),
                                                         after & (ahead[:k] | (miss & may_ahead[:k]))))
        behind[:k] = np.where(some, (behind[:k] & before) | (miss & may_behind[:k]), behind[:k])
        exact[:k] &= match
    found = replaced | ahead | behind

    hit = np.flatnonzero(found)
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = hit[np.lexsort((b[hit], q[hit]))]
    q, b, found = q[hit], b[hit], found[hit]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    count = np.add.reduceat(np.bitwise_count(found).astype(np.int64), first)
    f = found[first]                                         # the best word is the lowest bit of the first block
    low = np.bitwise_count((f & (~f + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    g = group[q[first]]
    return q[first], count, start[g] + (b[first] - block0[g]) * 64 + low


def _searched(table: pa.Table) -> pa.RecordBatch | None:
    """Near words of whole groups, sorted by key and best word first."""
    table = table.combine_chunks()
    key = table.column("key").combine_chunks() if table.num_rows else None
    if key is None or not len(key):
        return None
    if isinstance(key, pa.ChunkedArray):
        key = key.chunk(0)
    new = np.append(True, pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False))
    start = np.append(np.flatnonzero(new), len(key))
    several = np.repeat(np.diff(start) > 1, np.diff(start))
    if not several.any():
        return None
    size = np.diff(start)
    start = np.append(0, np.cumsum(size[size > 1]))
    table = table.filter(pa.array(several))
    n, kind, lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "kind", "lo", "hi"))
    words = table.column("word").combine_chunks()
    if isinstance(words, pa.ChunkedArray):
        words = words.chunk(0)
    at, count, best = near_words(words, n, kind, lo, hi, start)
    if not len(at):
        return None
    return pa.RecordBatch.from_arrays([words.take(pa.array(at)).cast(pa.string()), pa.array(count), pa.array(n[best]),
                                       words.take(pa.array(best)).cast(pa.string())],
                                      names=["word", "n_near", "form_n", "form"])


def _search(chunk_rows: int):
    def work(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < chunk_rows:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key")
            last = pc.equal(key, key[len(key) - 1]).combine_chunks().to_numpy(zero_copy_only=False)
            whole = int(np.argmax(last))                     # the last group may go on
            out = _searched(table.slice(0, whole))
            if out is not None:
                yield out
            held = table.slice(whole).to_batches()
            rows = table.num_rows - whole
        if held:
            out = _searched(pa.Table.from_batches(held))
            if out is not None:
                yield out
    return tidied(work)


def near(vocab: DataFrame, group_words: int = GROUP_WORDS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """For the words of each group with near words there: word, n_near, form_n, form (the best near word)."""
    rows = groups(vocab, group_words).select("key", "kind", "lo", "hi", "n", "word")
    dealt = rows.repartition("key").sortWithinPartitions("key", F.desc("n"), "word")
    return dealt.mapInArrow(_search(chunk_rows), _NEAR)


def forms(vocab: DataFrame, ratio: int = RATIO, group_words: int = GROUP_WORDS) -> DataFrame:
    """Per word: word, n, n_near, form, form_n (null without one)."""
    found = near(vocab, group_words)
    every = found.withColumn("n", F.lit(None).cast("long")).unionByName(vocab.select(
        "word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"),
        F.lit(None).cast("string").alias("form")))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("form"))))
    words = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    fits = -F.col("best.minus") >= F.col("n") * ratio
    return words.select("word", "n", "n_near", F.when(fits, F.col("best.form")).alias("form"),
                        F.when(fits, -F.col("best.minus")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """The last word of each chain: ``word, root`` of the words that have a ``form``."""
    cur = written(links.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(cur.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        release(cur)
        cur = new.select("word", "root")
        cur.scratch = new.scratch
        if new.filter("moved").limit(1).isEmpty():
            return cur


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    vocab = written(vocabulary(damaged_runs(docs)), "spelling-words")
    found = written(forms(vocab), "spelling-forms")
    last = roots(found)
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

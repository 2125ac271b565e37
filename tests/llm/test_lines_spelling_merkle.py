"""Line dedup, spelling variants and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from huddle.llm import linededup, merkle, spelling
from huddle.llm.common import importable

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    importable(spark)
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "7 as pos", "'x' as line", "'y' as root", "1L as rank", "2 as n", "'w' as word", "3 as kind",
                         "'k' as key", "'l' as leaf", "0L as __doc")


# ---- line dedup ----

def lines_by_hand(rows, least_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    least = -(1 << 63)
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(least if r[0] is None else r[0])
    out = []
    for r in rows:
        parts = (r[1] or "").split("\n")
        d = least if r[0] is None else r[0]
        kept = [p for p in parts if not (len(h := holders.get(key(p), ())) >= least_docs and max(h) != d)]
        out.append((r[0], len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def line_rows(seed, n=120):
    r = random.Random(seed)
    pool = [f"  Line number {i} of the common pool é\t" for i in range(12)] + ["short", "", "   ", "x" * 19, "Ü" * 20, "ü" * 20]
    rows = [(r.choice([i, i, r.randint(0, n)]), "\n".join(r.choice(pool) for _ in range(r.randint(1, 8))), "en", "s", 0)
            for i in range(n)]
    hot = "the very same line in a third of all documents"
    rows = [(d, t + ("\n" + hot + "\n" + hot.upper() if i % 3 == 0 else ""), *rest) for i, (d, t, *rest) in enumerate(rows)]
    rows += [(None, None, None, None, None), (None, hot, None, None, None), (500, "", "en", "s", 0), rows[0], rows[0],
             (501, "\n".join([hot] * 5000) + "\n" + "y" * 1_000_000, "en", "s", 0)]
    return rows


@pytest.mark.parametrize("parts", [1, 5, 61])
def test_lines_equal_brute_force_however_runs_are_cut(spark, parts):
    rows = line_rows(parts)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled",
                                                "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
        got = linededup.deduplicated_digests(frame(spark, rows)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert Counter(tuple(g) for g in got) == lines_by_hand(rows)


def test_line_bitmaps_and_empty_table(spark, none):
    rows = [(1, "a\nthis line is in three documents\nb", "en", "s", 0), (2, "this line is in three documents", "en", "s", 0),
            (3, "c\n THIS line is in three documents ", "en", "s", 0)]
    got = {r.doc: (r.n_lines, r.n_dropped, zlib.decompress(r.keep)) for r in linededup.keep_bitmaps(frame(spark, rows)).collect()}
    assert got == {1: (3, 1, bytes([0b10100000])), 2: (1, 1, b"\0"), 3: (2, 0, bytes([0b11000000]))}
    kept = linededup.deduplicated(frame(spark, rows), linededup.keep_bitmaps(frame(spark, rows)))
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "a\nb", 2: "", 3: rows[2][1]}
    assert linededup.deduplicated_digests(none).count() == 0


# ---- spelling variants ----

def words_by_hand(rows):
    n = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def are_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + 1:] == b[p + 1:] or a[p + 1:] == b[p:] or a[p:] == b[p + 1:]


def variants_by_hand(n, ratio=10):
    near = {w: [v for v in n if are_near(w, v)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            form[w] = best if n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n[w], len(near[w]), n[f] if f else None))
    return out


def word_rows(seed, alphabet="abé", n=150):
    r = random.Random(seed)
    bases = ["".join(r.choice(alphabet) for _ in range(r.randint(7, 9))) for _ in range(25)]

    def typo(w):
        p = r.randrange(len(w))
        return r.choice([w[:p] + w[p + 1:], w[:p] + r.choice(alphabet) + w[p:], w[:p] + r.choice(alphabet) + w[p + 1:]])
    rows = []
    for i in range(n):
        words = [r.choice(bases[:1 + r.randrange(len(bases))]) for _ in range(40)]
        rows.append((i, " ".join(typo(w) if r.random() < .15 else w.upper() if r.random() < .1 else w for w in words), "en", "s", 0))
    return rows + [(None, rows[0][1], None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), rows[1], rows[1],
                   (900, "z" * 30_000 + " " + "z" * 30_000 + "1" + "z" * 29_999 + "ä-" + "z" * 29_999 + "ä", "en", "s", 0)]


@pytest.mark.parametrize("seed,group_words", [(1, 4), (2, 20), (3, 100_000)])
def test_variants_equal_brute_force(spark, seed, group_words):
    rows = word_rows(seed)
    n = words_by_hand(rows)
    vocab = spelling.vocabulary(spelling.damaged_runs(frame(spark, rows)))
    assert {tuple(r) for r in vocab.collect()} == set(n.items())
    found = spelling.forms(vocab, group_words=group_words).cache()
    last = spelling.roots(found)
    got = found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word"), "n", "n_near", "form_n")
    assert {tuple(r) for r in got.collect()} == (want := variants_by_hand(n))
    assert any(w[1] for w in want)


def test_groups_are_bounded_and_pairs_meet_once(spark):
    """A vocabulary with one common beginning: no group stays above the limit, no pair is lost or doubled."""
    r = random.Random(5)
    words = sorted({"gemeinsam" + "".join(r.choice("abcd") for _ in range(4)) for _ in range(220)})
    vocab = spark.createDataFrame([(w, 2 + i) for i, w in enumerate(words)], "word string, n long")
    sizes = [x["count"] for x in spelling.groups(vocab, 16).groupBy("key", "hi", "lo").count().collect() if x.hi - x.lo > 1]
    assert max(sizes) <= 16
    got = {x.word: x.n_near for x in spelling.forms(vocab, group_words=16).collect()}
    assert got == {w: sum(are_near(w, v) for v in words) for w in words}


def test_chains_ties_and_no_words(spark, none):
    vocab = spark.createDataFrame([("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("caaaaaa", 20)],
                                  "word string, n long")
    found = spelling.forms(vocab).cache()
    last = {r.word: r.root for r in spelling.roots(found).collect()}
    forms = {r.word: r.form for r in found.collect()}
    assert forms["aaaaaaa"] == "aaaaaab" and forms["caaaaaa"] is None and forms["aaaabbb"] is None   # a tie goes to the smaller
    assert last["aaaaaaa"] == last["aaaaabb"] == "aaaabbb"
    assert spelling.variants(none).count() == 0


# ---- Merkle manifest ----

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r):
    values = (r[0], r[3], r[2], r[4], r[1])
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def proofs_by_hand(rows):
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
        return out
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for l in langs:
        by[l].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {l: levels([leaf_of(r) for r in by[l]]) for l in langs}
    top = levels([trees[l][-1][0] for l in langs])
    out = []
    for k, l in enumerate(langs):
        for i, r in enumerate(by[l]):
            touched = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf_of((*r[:4], r[4] + 1)) if touched else leaf_of(r)
            path = []
            for tree, at in ((trees[l], i), (top, k)):
                for level in tree[:-1]:
                    run = level[at // 2 * 2:at // 2 * 2 + 2]
                    path += run[:at % 2] + run[at % 2 + 1:]
                    run = [*run[:at % 2], node, *run[at % 2 + 1:]]
                    node, at = sha(*run), at // 2
            out.append((r[0], leaf_of(r), trees[l][-1][0], top[-1][0], sha(*path), node, node == top[-1][0]))
    return Counter(out)


def manifest_rows(n, langs, seed=1):
    r = random.Random(seed)
    return [(i, "t" * r.randint(0, 9) + "é", r.choice(langs), "s", r.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    manifest_rows(1, ["en"]), manifest_rows(64, ["en"]), manifest_rows(65, ["en"]), manifest_rows(300, ["en", "en", "en", "é", None, "zz"]),
    [(i, "t", f"l{i:03d}", "s", 1) for i in range(70)],                                # the top tree has two bands
    manifest_rows(40, ["en", None]) + [(5, "same", "en", "s", 3)] * 130 + [(None, None, None, None, None)] * 3 + [(5, "y" * 300_000, "en", "", 3)],
], ids=["one", "64", "65", "langs", "many-langs", "repeats"])
def test_proofs_equal_brute_force(spark, rows):
    got = merkle.verified(frame(spark, rows)).collect()
    assert Counter(tuple(g) for g in got) == proofs_by_hand(rows)


def test_ranks_over_many_small_partitions(spark):
    rows = manifest_rows(500, ["en", "en", "de", None]) + [(7, "same", "en", "s", 1)] * 200
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        m = merkle.manifest(frame(spark, rows).repartition(13))
        got = m.leaves.groupBy("lang").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
        parts = [r["count"] for r in m.leaves.groupBy("part").count().collect()] if "part" in m.leaves.columns else []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert all(g.r == list(range(len(g.r))) for g in got) and not parts


def test_equal_segments_share_a_record_and_empty_table(spark, none):
    m = merkle.manifest(frame(spark, [(5, "same", "en", "s", 3)] * 256))
    assert m.store.count() == 2               # one of 64 equal leaves, one of four equal segments
    assert merkle.verified(none).count() == 0

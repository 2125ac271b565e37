"""Merkle manifest of a dataset: a content-addressed DAG that leaf requests descend.

Rows are leaves; the leaves of a language, by doc_id, are the bottom of its tree,
and the trees' tops, by language, that of the top tree. Trees are binary: every
two consecutive nodes become one, a last single one is hashed alone.

The store holds records of ``SEGMENT_LEVELS`` levels: the digest of a segment's
top, and its children (the at most 64 digests at its bottom, from which the
levels between follow). Equal segments have one record. Segments are built by
grouped aggregation, 64 rows of a key at most, a written table for each band.

Requests descend from the root: each step joins the digests reached with the
store, takes the child that the rank's next digit names, and puts the children
that were not taken, lowest first, before the path so far; so no path has to be
turned round at the end. Requests of a segment share their way, so the upper
steps have one row per segment, not one per leaf.

Ranks come from a range partitioning by group and order: the place in the sorted
partition, less the group's first place there, plus the group's rows in the
partitions before. No group is collected or sorted in one task.

Defined cases: nulls are ``-`` in a leaf; a null language is the first; null
doc_ids come first in their language and are never tampered with; rows of one
doc_id are ordered by their digests, equal rows are leaves of their own; a null
n_chars stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huddle.llm.common import written

SEGMENT_LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_BY = 7        # rows whose crc32(doc_id) this divides are tampered with


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(docs: DataFrame, **changed: Column) -> Column:
    """The digest of a row, with other values for some columns."""
    return sha(F.concat(*[_field(changed.get(c, docs[c])) for c in FIELDS]))


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows``, written, with ``rank`` (from 0) in each group; nulls first, equal rows in any order.

    The range is cut on the order, and on a running number, so that neither a
    group nor many equal rows land in one partition.
    """
    found = written(rows.withColumn("spread", F.monotonically_increasing_id()), f"{name}-rows")
    keys = [F.asc_nulls_first(c) for c in [*group, *order, "spread"]]
    cut = found.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("spread")
    place = F.monotonically_increasing_id()          # partition above 33 bits, place in it below
    cut = written(cut.withColumn("place", place), f"{name}-sorted").withColumns(
        {"part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)})
    # one row for each partition, and one more for each border between groups
    counts = cut.groupBy("part", *group).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col("part").alias("_part"), *[F.col(c).alias(f"_{c}") for c in group],
                          (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("_shift"))
    on = F.col("part") == F.col("_part")
    for c in group:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return cut.join(shift, on).select(*rows.columns, (F.col("place") + F.col("_shift")).cast("long").alias("rank"))


def _next_level(nodes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), lambda i: sha(
        F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit("")))))


def _levels(children: Column, height: Column) -> Column:
    """All levels of a segment, from its children up to its top."""
    bottom = F.array(children)
    return F.when(height > 0, F.aggregate(F.sequence(F.lit(1), height), bottom, lambda levels, _: F.concat(
        levels, F.array(_next_level(F.element_at(levels, -1)))))).otherwise(bottom)


def _siblings(levels: Column, height: Column, digit: Column) -> Column:
    """What was not taken on the way to a child, lowest first: left and right of it ('' if nothing)."""
    def at(level):
        nodes, i = F.get(levels, level), F.call_function("shiftright", digit, level)
        right = F.coalesce(F.get(nodes, i + 1), F.lit(""))
        odd = i.bitwiseAND(1) == 1
        return F.struct(F.when(odd, F.get(nodes, i - 1)).otherwise("").alias("left"),
                        F.when(odd, "").otherwise(right).alias("right"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    return F.when(height > 0, F.transform(F.sequence(F.lit(0), height - 1), at)).otherwise(none)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: sha(F.concat(s["left"], node, s["right"])))


def proof(path: Column) -> Column:
    """Digest of a path's siblings in order."""
    return sha(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def _height(n: Column) -> Column:
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def forest(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Trees over ``nodes`` (tree, rank, digest): the bands of their records, and tree, height, top."""
    heights = written(nodes.groupBy("tree").agg(_height(F.count(F.lit(1))).alias("height")), f"{name}-heights")
    deepest = heights.agg(F.max("height")).first()[0] or 0
    level = nodes.join(heights, "tree").select("tree", "rank", "digest", F.col("height").alias("up"))
    bands, tops = [], [level.filter("up = 0")]
    for _ in range(0, deepest, SEGMENT_LEVELS):
        height = F.least(F.first("up"), F.lit(SEGMENT_LEVELS))
        segment = level.filter("up > 0").groupBy("tree", F.shiftright("rank", SEGMENT_LEVELS).alias("rank")).agg(
            F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("nodes"), height.alias("height"),
            F.first("up").alias("up"))
        segment = segment.select("tree", "rank", "height", "up", F.col("nodes.digest").alias("children"))
        top = F.get(F.element_at(_levels(F.col("children"), F.col("height")), -1), F.lit(0))
        band = written(segment.withColumn("digest", top), f"{name}-band")
        bands.append(band.select("digest", "height", "children"))
        level = band.select("tree", "rank", "digest", (F.col("up") - F.col("height")).alias("up"))
        tops.append(level.filter("up = 0"))
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    return bands, every.join(heights, "tree").select("tree", "height", F.col("digest").alias("top"))


@dataclass
class Manifest:
    """``leaves`` (with lang, tree, rank), ``trees`` (tree, lang, height, subroot, above: the top tree),
    ``store`` (digest, height, children), ``top`` (one row: digest, height; none for an empty table)."""
    leaves: DataFrame
    trees: DataFrame
    store: DataFrame
    top: DataFrame


def manifest(docs: DataFrame) -> Manifest:
    """The DAG of all rows of ``docs`` (the columns of documents)."""
    changed = F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % TAMPERED_BY == 0,
                     leaf_digest(docs, n_chars=docs["n_chars"] + 1))
    rows = ranked(docs.select(docs["lang"].alias("lang"), docs["doc_id"].alias("doc_id"), leaf_digest(docs).alias("leaf"),
                              F.when(docs["n_chars"].isNotNull(), changed).alias("tampered")),
                  ["lang"], ["doc_id", "leaf"], "merkle")
    langs = ranked(rows.select("lang").distinct(), [], ["lang"], "merkle-langs")
    langs = written(langs.select(F.col("lang").alias("of"), F.col("rank").alias("tree")), "merkle-trees")
    leaves = written(rows.join(langs, F.col("lang").eqNullSafe(F.col("of"))).drop("of"), "merkle-leaves")
    bands, tops = forest(leaves.select("tree", "rank", F.col("leaf").alias("digest")), "merkle")
    trees = written(tops.join(langs, "tree").select(
        "tree", F.col("of").alias("lang"), "height", F.col("top").alias("subroot"), F.lit(-1).cast("long").alias("above")),
        "merkle-tops")
    # the trees' tops are the leaves of the top tree, in the order of the languages
    upper, top = forest(trees.select(F.col("above").alias("tree"), F.col("tree").alias("rank"),
                                     F.col("subroot").alias("digest")), "merkle-top")
    store = None
    for band in [*bands, *upper]:
        store = band if store is None else store.unionByName(band)
    if store is None:
        store = leaves.sparkSession.createDataFrame([], "digest string, height int, children array<string>")
    return Manifest(leaves, trees, written(store.dropDuplicates(["digest"]), "merkle-store"),
                    top.select(F.col("top").alias("digest"), "height"))


def _step(frontier: DataFrame, store: DataFrame) -> DataFrame:
    """One record further down: a row for each child, with what was not taken put before the path."""
    s = store.select("digest", F.col("height").alias("h"), "children")
    found = frontier.join(s, "digest").withColumn("levels", _levels(F.col("children"), F.col("h")))
    each = found.select("*", F.posexplode("children").alias("digit", "child"))
    return each.select("tree", "subroot", "root", (F.col("rank") * (1 << SEGMENT_LEVELS) + F.col("digit")).alias("rank"),
                       (F.col("up") - F.col("h")).alias("up"), F.col("child").alias("digest"),
                       F.concat(_siblings(F.col("levels"), F.col("h"), F.col("digit")), "path").alias("path"))


def descended(m: Manifest, requests: DataFrame) -> DataFrame:
    """For requests (tree, rank and any other columns): leaf, subroot, root and path, found in the store.

    Path entries have left and right: the sibling on that side, or ''.
    """
    none = F.array().cast("array<struct<left:string,right:string>>")
    at = m.top.select(F.lit(-1).cast("long").alias("tree"), F.lit(None).cast("string").alias("subroot"),
                      F.col("digest").alias("root"), F.lit(0).cast("long").alias("rank"),
                      F.col("height").alias("up"), "digest", none.alias("path"))
    done = []

    def down(rows, least, name):
        """Rows that have come down to ``least`` levels."""
        arrived = []
        while True:
            rows = written(rows, name)
            arrived.append(rows.filter(F.col("up") <= least))
            rows = rows.filter(F.col("up") > least)
            if rows.isEmpty():
                break
            rows = _step(rows, m.store)
        out = arrived[0]
        for a in arrived[1:]:
            out = out.unionByName(a)
        return out

    tops = down(at, 0, "merkle-top-path")
    trees = m.trees.select("tree", F.col("height").alias("up"))
    at = tops.select(F.col("rank").alias("tree"), F.col("digest").alias("subroot"), "root",
                     F.lit(0).cast("long").alias("rank"), "digest", "path").join(trees, "tree")
    last = down(at.select("tree", "subroot", "root", "rank", "up", "digest", "path"), SEGMENT_LEVELS, "merkle-path")
    # The last step is made by the requests, 64 of a segment at most.
    s = m.store.select("digest", F.col("height").alias("h"), "children")
    last = last.join(s, "digest", "left").select(
        "tree", F.col("rank").alias("segment"), "subroot", "root", "path", F.coalesce("h", F.lit(0)).alias("h"),
        F.coalesce("children", F.array("digest")).alias("children"))
    last = last.withColumn("levels", _levels(F.col("children"), F.col("h")))
    others = [c for c in requests.columns if c not in ("tree", "rank")]
    asked = requests.groupBy("tree", F.shiftright("rank", SEGMENT_LEVELS).alias("segment")).agg(
        F.collect_list(F.struct("rank", *others)).alias("asked"))
    each = last.join(asked, ["tree", "segment"]).select("*", F.explode("asked").alias("ask"))
    digit = F.col("ask.rank").bitwiseAND((1 << SEGMENT_LEVELS) - 1).cast("int")
    each = each.withColumn("digit", digit)
    path = F.concat(_siblings(F.col("levels"), F.col("h"), F.col("digit")), "path")
    return each.select(*[F.col(f"ask.{c}").alias(c) for c in others], F.get("children", F.col("digit")).alias("leaf"),
                       "subroot", "root", path.alias("path"))


def verified(docs: DataFrame) -> DataFrame:
    """Each row's leaf, subroot, root, proof, and the root that its (perhaps tampered) leaf folds to."""
    m = manifest(docs)
    rows = descended(m, m.leaves.select("tree", "rank", "doc_id", "tampered"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
                       folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))

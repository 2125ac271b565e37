"""Sharding by extendible hashing.

Documents hash to 60 bits. The directory begins with one bucket; a bucket over
the byte limit is split on the next bit, and only such buckets are. So a document's shard
is the shortest prefix of its hash whose documents fit the limit. Rows that
share all bits (repeated rows) can't be told apart by a bit: their bucket gets
overflow pages, each filled up to the limit. A single row over the limit is a
page of its own.

The directory is made from sums over hash cells, STEP bits at a time, never from a
list of documents; only cells that don't fit yet go on to the next bits.

Defined results: null text has 0 bytes; a null doc_id hashes as an empty text, with the
text; repeated rows are one row each in the result, on pages of one bucket if
they don't fit; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import written

HASH_BITS = 60
STEP = 12
BYTE_LIMIT = 1 << 20


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, bytes of the text, and 60 bits of the md5 of id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    md5 = F.md5(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text), "utf-8"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.conv(F.substring(md5, 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"))


def _prefix(depth) -> Column:
    return F.expr(f"shiftright(hash, {HASH_BITS} - {depth})")


def directory(rows: DataFrame, limit: int = BYTE_LIMIT) -> DataFrame:
    """depth, prefix of the buckets, their bytes, and whether they need overflow pages."""
    found, open_cells, depth = None, None, 0
    total = rows.agg(F.sum("n_bytes")).first()[0]
    if total is None:
        return rows.sparkSession.createDataFrame([], "depth int, prefix long, bucket_bytes long, overflow boolean")
    while True:
        upto = min(depth + STEP, HASH_BITS)
        live = rows if open_cells is None else rows.withColumn("cell", _prefix(depth)).join(open_cells, "cell", "left_semi")
        cells = live.select(_prefix(upto).alias("cell"), "n_bytes").groupBy("cell").agg(
            F.sum("n_bytes").alias("n_bytes"))
        # the sum of every prefix between the two depths, of all cells below it
        levels = F.explode(F.sequence(F.lit(depth), F.lit(upto))).alias("depth")
        sums = cells.select("cell", "n_bytes", levels).groupBy(
            "depth", F.expr(f"shiftright(cell, {upto} - depth)").alias("prefix")).agg(F.sum("n_bytes").alias("bucket_bytes"))
        sums = written(sums, "directory")
        # a bucket is a leaf if it fits and the one above it doesn't
        above = sums.filter(F.col("bucket_bytes") > limit).select(
            (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        fits = sums.filter(F.col("bucket_bytes") <= limit)
        leaves = fits.withColumn("up", F.shiftright("prefix", 1)).join(above, ["depth", "up"], "left_semi").select(
            "depth", "prefix", "bucket_bytes", F.lit(False).alias("overflow"))
        if depth == 0:
            leaves = leaves.unionByName(fits.filter("depth = 0").select("depth", "prefix", "bucket_bytes", F.lit(False).alias("overflow")))
        over = sums.filter((F.col("depth") == upto) & (F.col("bucket_bytes") > limit))
        if upto == HASH_BITS:
            leaves = leaves.unionByName(over.select("depth", "prefix", "bucket_bytes", F.lit(True).alias("overflow")))
        found = leaves if found is None else found.unionByName(leaves)
        if upto == HASH_BITS or over.isEmpty():
            return found
        open_cells, depth = over.select(F.col("prefix").alias("cell")), upto


def shards(docs: DataFrame, limit: int = BYTE_LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard (bits of the prefix, then the page), depth, page."""
    rows = written(hashed(docs), "hashed")
    buckets = written(directory(rows, limit), "buckets")
    depths = [r[0] for r in buckets.select("depth").distinct().orderBy("depth").collect()]   # at most 61 numbers
    parts = []
    for d in depths:
        here = buckets.filter(F.col("depth") == d)
        parts.append(rows.withColumn("prefix", _prefix(d)).join(here, "prefix"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, n_bytes long, shard string, depth int, page int")
    all_rows = parts[0]
    for p in parts[1:]:
        all_rows = all_rows.unionByName(p)
    # rows of an overflow bucket are equal: so many go on a page, by their number among the copies
    equal = all_rows.filter("overflow").groupBy("doc_id", "n_bytes", "hash", "depth", "prefix").agg(F.count("*").alias("n"))
    paged = equal.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn(
        "page", F.floor(F.col("i") / F.greatest(F.floor(F.lit(limit) / F.col("n_bytes")), F.lit(1))).cast("int"))
    columns = ["doc_id", "n_bytes", "depth", "prefix", "page"]
    out = all_rows.filter("not overflow").withColumn("page", F.lit(0)).select(*columns).unionByName(paged.select(*columns))
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    return out.select("doc_id", "n_bytes", F.concat(bits, F.lit("."), F.col("page").cast("string")).alias("shard"), "depth", "page")

"""Helpers shared by the operators: tables, written intermediate results, components."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huddle.session import scratch_path


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package, wherever the driver was started.
    (On a cluster the package is sent with ``--py-files`` or installed.)"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it and survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for df in frames:
        path = getattr(df, "scratch", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: ``node, root`` (smallest node reachable).

    Alternates large-star and small-star steps, each one grouped aggregation
    and one join on the node, until no edge changes; every round is a written
    table, so the lineage stays short. A node of many edges is one key of a
    partially aggregated minimum and of a join that may be split, never a
    collected group. Self-loops and nulls are ignored; no edges give no rows.
    """
    # u > v: every edge points from the larger to the smaller node
    cur = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .filter("u <> v").distinct(), f"{name}-e")
    while True:
        # large star: neighbours above a node are linked to its smallest neighbour or itself
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        # small star: neighbours below a node, and the node, are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = (linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(linked.select("u", F.col("m").alias("v")))
                 .filter("u <> v").distinct())
        new = written(small, f"{name}-e")
        # stable once every edge leads to a root: no node is on both sides
        unstable = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1)
        more = new.groupBy("u").count().filter("count > 1").limit(1)
        done = unstable.isEmpty() and more.isEmpty()
        release(cur)
        cur = new
        if done:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""The corpus pipeline: stages that each call one operator of ``huddle.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``; the last returns pieces
packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huddle.llm import decontam, neardup, packing, pii, quality
from huddle.llm.common import table, written
from huddle.llm.tokens import default_tokenizer

SIMILAR_PERCENT = 80   # of the near-duplicate stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the quality classifier rejects go."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group the row with the smallest doc_id stays.

    Rows are told by id and text: of equal ones one stays, and rows of one id
    whose texts are not linked are judged apart. Rows without a doc_id stay.
    """
    # nulls are left out of a hash, so a null text is told from an empty one by a flag
    rows = docs.filter("doc_id is not null").withColumn("_row", F.xxhash64("doc_id", F.col("text").isNull(), "text"))
    found = written(neardup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), SIMILAR_PERCENT).select(
        F.col("doc_id").alias("_row"), "component_id").distinct(), "near-rows")
    least = rows.select("doc_id", "_row").distinct().join(found, "_row").groupBy("component_id").agg(
        F.min(F.struct("doc_id", "_row")).alias("least")).select("least._row")
    named = rows.join(least, "_row", "left_semi").dropDuplicates(["doc_id", "_row"]).drop("_row")
    return named.unionByName(docs.filter("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a passage of the benchmark go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: personal data and the terms that reveal it are replaced in the texts."""
    return pii.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the kept texts as token pieces in sequences."""
    return packing.pack(docs, default_tokenizer())


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", sanitise),
    ("packing", pack),
]

# Trained models and tokenizers: no SQL form. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""Session helpers.

The library never creates machine-local scratch space on a cluster: anything
written between jobs goes under ``spark.checkpoint.dir``, which the cluster
names. Only when that is unset (local tests) do we pick a directory ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the report plans rely on. AQE re-plans joins at runtime (a join side
# is broadcast only when its measured size is under the threshold, otherwise a
# sort-merge join runs), coalesces small shuffle partitions and splits skewed
# ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",   # see ``tuned``
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "huddle", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    On a cluster pass nothing and let spark-submit decide master and sizes.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def tuned(spark: SparkSession) -> SparkSession:
    """A session that others made, with the one setting that the league plans need: off, rows
    partitioned by league are joined on (league, roster) where they are. Results never depend on it."""
    spark.conf.set(CO_PARTITION, "false")
    return spark


def _configured_dir(spark: SparkSession) -> str | None:
    return (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir", None))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    Read from the session (``spark.checkpoint.dir``); only on a ``local``
    master without one (tests) do we create a folder ourselves. On a cluster
    without the setting this fails rather than writing to a machine-local
    folder.
    """
    sc = spark.sparkContext
    configured = _configured_dir(spark)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not _is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a shared folder: written "
                         "intermediate tables must survive the loss of an executor")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="huddle-ckpt-"))
    return sc.getCheckpointDir()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint root for one written table."""
    return f"{checkpoint_root(spark)}/huddle/{name}-{uuid.uuid4().hex[:12]}"


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package, wherever the driver was started.
    (On a cluster the package is sent with ``--py-files`` or installed.)"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])

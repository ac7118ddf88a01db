"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Pages are wide rows: small Arrow batches keep a Python worker's memory flat
# however long the pages are.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # of a repeated JSON key the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "joblume", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in _SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_rules(spark: SparkSession) -> None:
    """Settings that results depend on, for a session that somebody else made."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stage tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and the master is local, as in tests, a temporary folder is made and put in
    its place; on a cluster other machines would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="joblume-")
        spark.conf.set("spark.checkpoint.dir", root)
    # checkpoint() itself reads the context, which knows the folder only if it
    # was there at start-up.
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

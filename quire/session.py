"""Session defaults and the shared place for checkpoints."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings a fresh session gets. Shuffle partitions are left to the caller (AQE coalesces them).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults of this library; ``conf`` wins over them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where neither the
    session nor the context has one (tests, a laptop) a temporary folder is set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "quire-checkpoints"))
    return df.checkpoint(eager=True)

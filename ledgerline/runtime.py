"""Session helpers: tables, reliable checkpoints, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this estimated size; beyond it Spark shuffles both sides.
BROADCAST_LIMIT_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a folder of our own is
    set only in local sessions that name none. On a cluster no machine-local folder will do, so
    a session without a named folder raises there.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerline-checkpoint-"))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast when the counted rows prove that it fits; else leave the shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT_BYTES else df

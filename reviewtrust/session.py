"""Session defaults, and the shared folder used to cut lineage in loops."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Broadcast joins are left to Spark: a side is broadcast only when its measured size is
# under spark.sql.autoBroadcastJoinThreshold; larger sides shuffle, with AQE splitting
# skewed partitions. The corpus operators hint at a broadcast only where the rows are bounded by a constant.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # The call site of every column expression is looked up otherwise: as much time as building the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reviewtrust")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local-mode session that names none gets a temporary folder, one for each
    application: on a cluster such a folder is not visible to the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _FALLBACK:
        _FALLBACK[context.applicationId] = tempfile.mkdtemp(prefix="reviewtrust-")
    return _FALLBACK[context.applicationId]


class Workspace:
    """Tables written to the shared folder by one iterative job.

    A written table cuts lineage like a checkpoint does, survives the loss of any
    executor, is computed in one pass, and gives the next plan real size statistics.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._count = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._count:04d}"
        self._count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

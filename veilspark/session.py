"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts are wide rows: small Arrow batches keep Python workers within memory
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.session.timeZone": "UTC",
    # a mapping store's state may outgrow the heap
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # recording the call site of every column costs more than building the expressions
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "veilspark", **options: str) -> SparkSession:
    """A session with the defaults above; ``options`` win over them."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as the session names it.

    Without one, a temporary folder is used in local mode only, and removed at the end: on a
    cluster the executors could not reach it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="veilspark-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)  # it may hold raw values
    spark.conf.set("spark.checkpoint.dir", root)
    return root

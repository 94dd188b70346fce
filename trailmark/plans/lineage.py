"""Cutting lineage at points where one frame feeds many jobs."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of an action at its end if this holds where its frame is made; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SETTING = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, or one in the warehouse where that is unset.

    A warehouse on a local disk is shared only while Spark runs in one process; on a cluster it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    on_disk = warehouse.startswith(("file:", "/"))
    if on_disk and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_trailmark"


def spent(df: DataFrame) -> DataFrame:
    """``df`` for one action, at whose end its shuffle files go. Only for frames whose result is stored: another action would shuffle again."""
    conf = df.sparkSession.conf
    with _SETTING:
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            return df.select("*")
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Store ``df`` once and return the stored copy: a reliable checkpoint, which survives lost executors. What was shuffled for it is removed.

    Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have Spark remove it when the frame is gone.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return spent(df).checkpoint()

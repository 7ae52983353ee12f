"""Where jobs cut their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Spark's setting to remove shuffle files at the end of a query; before 4.1 it is not known and does nothing.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it gets a folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rowguard-")
        # Its own folder, made just above for this local session.
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; survives lost executors.

    What was shuffled to make it goes at once, not when the driver happens to collect its garbage.
    """
    conf = df.sparkSession.conf
    shared_folder(df.sparkSession)
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        # A query takes the setting when it is made, so it is made here.
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def release(*frames: DataFrame) -> None:
    """Remove what ``cut_lineage`` wrote for these, which nothing reads again, instead of when the driver collects its garbage."""
    for df in frames:
        written = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if written.isDefined():
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(written.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "eventloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect; on a cluster the master comes from spark-submit."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go when no table refers to them
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="eventloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


#: Spark's setting that removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: In queries that write cut tables rows go to Python in batches of so many bytes: those of 10,000 whole texts would stay in the memory pools
#: of executors and workers for good.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def cut(df: DataFrame, clean: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from the files: survives lost executors, ends the lineage.

    With clean its shuffle files go as soon as it is written. That is for plans all of whose stages are needed: where Spark gives up a join with an empty
    side, the other side's stage goes on and would wait minutes for files that went. df itself is not run, but a query of its own, so a later use of df
    finds nothing missing.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    settings = BATCH | {CLEANUP: "true"} if clean else BATCH
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return df.select("*").checkpoint()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

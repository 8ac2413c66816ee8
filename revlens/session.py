"""Session settings, the shared work folder, and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "revlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` out; ``spark-submit`` supplies it together with
    the shuffle partition count and ``spark.checkpoint.dir``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    tune(spark)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings results depend on to a session somebody else made."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Lets a join on (article, bucket, rev) reuse data already hashed by (article, bucket). The
    # price: a side hashed by article alone must be hashed anew before a join on more columns.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def work_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; only a local session may fall back to a temporary one."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="revlens-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _run_folder(spark: SparkSession) -> str:
    """Below it lies all that this application writes for itself."""
    return os.path.join(work_folder(spark), "revlens", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the work folder, never used before."""
    return os.path.join(_run_folder(spark), f"{name}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession) -> bool:
    """Delete the scratch tables of this application, once no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hand a table that is read by fewer tasks than there are cores to all of them.

    Only a small table comes in so few pieces; one with many splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and ends the plan here."""
    work_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write once, read back: later steps start from the files instead of the plan. codec: of the files, else the session's."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)

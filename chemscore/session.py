"""Session helpers.

Library code never creates a session; it only reads settings from the one it
is given.  ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


# Settings we expect on a large cluster (set by the deployment, not by the
# library): AQE re-plans joins and coalesces partitions at run time and splits
# skewed join partitions; partitions are sized for executor memory.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.shuffle.partitions": "20000",           # initial; AQE coalesces
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.session.timeZone": "UTC",
    # "spark.checkpoint.dir": a shared folder (HDFS/S3/ABFS), set by the cluster
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "chemscore") -> SparkSession:
    """A local[N] session configured the way the tests and bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHEMSCORE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.ansi.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    When it is unset we only pick our own folder in local mode (tests, bench);
    on a cluster a machine-local folder would not survive an executor loss, so
    we refuse instead of guessing.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no SparkContext handle
        sc = None
    if sc is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            return configured
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chemscore-ckpt-", dir="/tmp"))
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...) "
        "so that checkpointed lineage survives executor loss")


def checkpoint(df):
    """Reliable checkpoint (never localCheckpoint) in the session's checkpoint dir."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _application(spark) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - a Spark Connect session has no SparkContext handle
        return ""


# staged tables of this process, by session application
_STAGED: dict[str, list[str]] = {}


def drop_staged(spark) -> int:
    """Delete the tables that ``materialize`` has written for this application,
    and forget them; returns how many.  For the end of a job, when nothing that
    it returned is still to be read."""
    paths = _STAGED.pop(_application(spark), [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)


def staged_path(spark, label: str) -> str:
    """A new path under the checkpoint folder that ``drop_staged`` deletes."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/chemscore-{label}-{uuid.uuid4().hex}"
    _STAGED.setdefault(_application(spark), []).append(path)
    return path


def materialize(df, label: str = "table", staging_dir: str | None = None):
    """Write ``df`` once as parquet under the checkpoint folder and read it back.

    Unlike ``Dataset.checkpoint`` (which recomputes its input to write it),
    this computes the plan exactly once, cuts the lineage, survives executor
    loss (the folder is the shared one the cluster names) and gives the
    optimizer real size statistics for the result.

    With ``staging_dir`` the table is written to ``<staging_dir>/<label>`` and
    replaces the previous one (bounded space for long-running streams whose
    micro-batches run one after another).
    """
    spark = df.sparkSession
    if staging_dir:
        path = f"{staging_dir.rstrip('/')}/{label}"
        df.write.mode("overwrite").parquet(path)
    else:
        path = staged_path(spark, label)
        df.write.mode("error").parquet(path)
    # the schema is known: no footer-reading inference job on read-back
    return spark.read.schema(df.schema).parquet(path)

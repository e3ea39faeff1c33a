"""Session helpers: scale-oriented defaults and the checkpoint location.

Cluster settings win: nothing here overrides a value the cluster already set.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Defaults applied only when the session leaves them unset.  They are the
# knobs that decide whether a 100 TB run spills gracefully and adapts to skew.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Broadcast only below this runtime-measured size; above it AQE keeps the
    # shuffle join.  This is the size check for every implicit broadcast.
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
}


# Launch-time settings for a large cluster (pass to spark-submit --conf or the
# builder; they cannot be changed on a running session).  They keep a job
# alive through lost executors: shuffle files outlive their executor (external
# shuffle service / decommission migration), lost tasks and stages are retried,
# stragglers are re-launched speculatively.
CLUSTER_LAUNCH_CONF = {
    "spark.shuffle.service.enabled": "true",
    "spark.dynamicAllocation.enabled": "true",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
    "spark.storage.decommission.rddBlocks.enabled": "true",
    "spark.task.maxFailures": "8",
    "spark.stage.maxConsecutiveAttempts": "8",
    "spark.speculation": "true",
    "spark.speculation.quantile": "0.9",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.parquet.filterPushdown": "true",
}


def cluster_builder(app: str = "pressferry") -> SparkSession.Builder:
    """Builder with the launch-time cluster settings and the scale defaults.
    ``spark.checkpoint.dir`` is left to the cluster (a shared folder)."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**CLUSTER_LAUNCH_CONF, **SCALE_DEFAULTS}.items():
        builder = builder.config(key, value)
    return builder


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "pressferry") -> SparkSession:
    """Session for tests and the bench (local mode)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.ansi.enabled", "true")
    )
    for key, value in SCALE_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_scale_defaults(spark: SparkSession) -> None:
    """Fill in SCALE_DEFAULTS on an existing session where they are unset."""
    for key, value in SCALE_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it if needed.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only on a local master with nothing configured (unit tests) a private
    temporary folder is created; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="pressferry-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def size_shuffle_partitions(spark: SparkSession, input_bytes: int,
                            target_bytes: int = 256 * 1024 * 1024, minimum: int = 200) -> int:
    """Shuffle partitions for a job reading ``input_bytes``: about
    ``target_bytes`` of shuffle input per task so partitions fit executor
    memory without spilling much (100 TB at 256 MB -> ~400k is too many files
    per map task, so AQE starts from this number and coalesces small ones).
    Sets ``spark.sql.shuffle.partitions`` and AQE's initial partition number."""
    n = max(minimum, int(input_bytes // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes // 2))
    return n


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the files under ``paths`` (Hadoop file system listing on
    the driver: metadata only, no data read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            total += fs.getContentSummary(p).getLength()
    return int(total)


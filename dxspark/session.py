"""Session settings and the shared scratch location.

The settings are the ones that matter at scale: AQE (runtime coalescing,
runtime broadcast conversion of joins whose measured side is small, skew-join
splitting), UTC, no UI. `get_spark` only fills in keys the caller has not set,
so a cluster's own configuration always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A partition counts as skewed at 5x the median and above 256 MB;
    # such partitions are split and the other side replicated.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # remove reliable-checkpoint files once their RDDs are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "dxspark", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench: local master, small shuffle count."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a private one only when the
    session has none (local tests). On a cluster `spark.checkpoint.dir` names a
    shared filesystem and is used as is."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dxspark-ckpt-", dir="/tmp"))
    else:
        # a machine-local folder would not be visible to the executors
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store) for this cluster")
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str = "out") -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def to_all_tasks(rows: DataFrame) -> DataFrame:
    """`rows`, dealt out evenly where fewer tasks read them than can run at once: for
    work that takes far longer than to move the rows."""
    slots = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= slots else rows.repartition(4 * slots)

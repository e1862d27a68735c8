"""Session construction and cluster-shared scratch locations."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every tagscope job relies on.  Timestamps are TIMESTAMP_NTZ end to
# end; the session zone only matters where text with an explicit offset is
# parsed, and it is pinned to UTC so offsets are normalised to UTC wall time.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # scans read 2-3 narrow columns: larger splits, fewer tasks
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpointed intermediates are deleted once the driver drops them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "tagscope",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Return a session with tagscope's settings (local runs, tests, bench).

    On a cluster, pass ``master=None`` and let spark-submit decide; the
    shuffle partition count should then be sized to the data (AQE coalesces
    small partitions at run time).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(CORE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables, as the cluster
    names it in ``spark.checkpoint.dir``.  There is no default: a folder of one
    machine would be lost with it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return d


def shared_dir(spark: SparkSession) -> str:
    """``checkpoint_dir``, or a folder below the warehouse where the session names
    none (local runs only: a cluster names one)."""
    try:
        return checkpoint_dir(spark).rstrip("/")
    except ValueError:
        return (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")

"""Spark session settings shared by the library, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job relies on: UTC day boundaries, ANSI arithmetic (division by
# zero is handled explicitly with try_divide / guarded ratios), AQE for runtime
# re-planning (partition coalescing, skew-join splitting, runtime broadcast only
# below the size threshold Spark measures).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoints (range tags, shared experiment results) are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "platewise", master: str | None = None,
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, taken from ``spark.checkpoint.dir``.

    It must name a folder that the driver and all executors share.  Only a
    local-mode session without the setting gets one of its own, below its
    warehouse folder; on a cluster a missing setting is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's own spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", None)
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def materialize(df):
    """Write ``df`` once as a reliable checkpoint (shared folder) and return the copy.

    For intermediates read by more than one consumer: every consumer scans the
    copy instead of recomputing the lineage (for the analytics, a pass over all
    orders), and a lost executor re-reads it instead of recomputing.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings every operator may rely on.  Session time zone is pinned
# because the stored calendar date is the UTC date of the reading.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Pair scoring is heavy on few bytes; do not merge such stages into one task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


def build_session(
    app_name: str = "basketlens", master: str | None = None, **conf: str
) -> SparkSession:
    """Session for tests and jobs; ``master`` is left to spark-submit if None."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_sql_defaults(spark: SparkSession) -> SparkSession:
    """Set the defaults on a session somebody else built, keeping its own choices."""
    for key, value in SQL_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """New path below ``spark.checkpoint.dir``, the folder all executors can reach.

    A local session without that setting uses the folder of its own warehouse.  All
    paths of an application lie in one folder, which it removes when it ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
        base = spark.conf.get("spark.sql.warehouse.dir")
    own = f"{base.rstrip('/')}/basketlens-{spark.sparkContext.applicationId}"
    if own not in _OWNED:
        _OWNED.add(own)
        atexit.register(_remove, spark, own)
    return "/".join([own, *parts, uuid.uuid4().hex])


_OWNED: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    """Delete the application's folder while its JVM is still there."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df):
    """Write ``df`` to the shared folder and read it back: an executor-loss-safe cut."""
    path = shared_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

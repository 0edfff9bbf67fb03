"""Session settings for local runs and tests; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "relearn", memory: str = "12g") -> SparkSession:
    partitions = 8 if cores == "*" else max(int(cores), 1)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Parts that shuffles begin with, so that a part holds so small a share of large tables; small ones are joined to few parts.
FIRST_PARTS = 256


def broadcast_measured(spark: SparkSession) -> None:
    """Let the session send a join's side to all only by its size at run time, up to the limit it had for estimates.

    Estimates start from file sizes. A file of repetitive columns is a fiftieth of its rows in memory, or less, so
    by estimate millions of rows pass for small and are gathered in the driver. Adaptive execution measures rows.
    The parts it joins small partitions to are measured compressed, though, and a task sorts and hashes some twenty
    times that, so they are a quarter of the usual size unless the session says otherwise. Small parts are joined, but
    large ones are not split, so shuffles begin with many.
    """
    part = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(part, None) is None:
        spark.conf.set(part, "16m")
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(first, None) is None:
        spark.conf.set(first, str(max(FIRST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
        spark.conf.set("spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin", "0")  # few rows leave most of many parts empty
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark.conf.get(planned)
    if limit != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, limit)
        spark.conf.set(planned, "-1")

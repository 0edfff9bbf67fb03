"""Ordering inside keys that stays parallel when one key holds most of the rows.

A plain window sorts each key in one task. That is right while keys are small. When a key
is larger than ``hot_rows`` the rows are ordered over range partitions instead, which split
the key, and positions come from partition offsets. Range bounds are drawn by sampling, so
that frame is checkpointed before anything is computed from it: a recomputed bound could
not then move a row after its offset was counted.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
ROWS_PER_PARTITION = 1_000_000
BROADCAST_ROWS = 100_000
LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits
GROUP_LIMIT_ROWS = 1000  # default of spark.sql.optimizer.windowGroupLimitThreshold


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh local one only when none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if named is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def pin(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly, before a step that works long on each.

    Files are split by their bytes, so a small file of repetitive rows would be one task however long its rows take.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def null_safe_on(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def global_position(
    df: DataFrame, order: Sequence[Column], name: str = "position", rows: int | None = None
) -> DataFrame:
    """Zero-based position of every row in one total order; ``order`` must end in a unique column.

    ``rows``, counted if not given, sizes the range partitions.
    """
    rows = df.count() if rows is None else rows
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PARTITION))
    laid_out = pin(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_at", LOCAL_BITS)
    # One row per range partition, so the single-task window is bounded, and so is the broadcast.
    sizes = laid_out.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    if parts <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return (
        laid_out.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)))
        .drop("_part", "_at", "_offset")
    )


def key_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest key and of all keys: one pre-aggregated pass over the key columns."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    found = sizes.agg(F.max("_n").alias("largest"), F.sum("_n").alias("total")).first()
    return found.largest or 0, found.total or 0


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "position",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One-based row number inside ``keys``; ``order`` must be total inside a key."""
    largest, total = key_sizes(df, keys)
    if largest <= hot_rows:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    placed = global_position(df, [F.col(k).asc() for k in keys] + list(order), "_g", total)
    firsts = placed.groupBy(*keys).agg(F.min("_g").alias("_first"))
    renamed = firsts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    on = null_safe_on(placed, renamed, [(k, f"_k{i}") for i, k in enumerate(keys)])
    return (
        placed.join(renamed, on)
        .withColumn(name, F.col("_g") - F.col("_first") + 1)
        .select(*df.columns, name)
    )


def page_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int,
    offset: int = 0,
    name: str = "position",
) -> DataFrame:
    """Rows offset+1 .. offset+limit of each key.

    Up to the group-limit threshold Spark keeps only the leading rows of a key before the
    shuffle, so a large key never reaches one task; deeper pages rank over range partitions.
    """
    last = offset + limit
    if last <= GROUP_LIMIT_ROWS:
        window = Window.partitionBy(*keys).orderBy(*order)
        ranked = df.withColumn(name, F.row_number().over(window))
    else:
        ranked = rank_rows(df, keys, order, name)
    return ranked.filter((F.col(name) <= last) & (F.col(name) > offset)).withColumn(
        name, F.col(name).cast("long")
    )


def running_sum_and_floor(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: str,
    sum_name: str,
    floor_name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Running sum of ``value`` inside a key and the running minimum of that sum.

    Both compose: a block is summarised by its total and its lowest prefix. Hot keys are cut
    into blocks of ``hot_rows`` positions; blocks are folded on their own and then shifted by
    what precedes them.
    """
    upto = (Window.unboundedPreceding, Window.currentRow)
    if key_sizes(df, keys)[0] <= hot_rows:
        rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
        summed = df.withColumn(sum_name, F.sum(value).over(rows))
        return summed.withColumn(floor_name, F.min(sum_name).over(rows))

    placed = rank_rows(df, keys, order, "_pos", hot_rows).withColumn(
        "_block", F.floor((F.col("_pos") - 1) / F.lit(hot_rows)).cast("long")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(*upto)
    folded = placed.withColumn("_s", F.sum(value).over(inside)).withColumn(
        "_m", F.min("_s").over(inside)
    )
    blocks = folded.groupBy(*keys, "_block").agg(
        F.max_by("_s", "_pos").alias("_total"), F.min("_m").alias("_low")
    )
    # Rows here are blocks, that is rows / hot_rows, so one key's blocks fit one task.
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifted = blocks.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    shifted = shifted.withColumn("_base_low", F.min(F.col("_base") + F.col("_low")).over(earlier))
    side = shifted.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_block").alias("_b"), "_base", "_base_low",
    )
    on = null_safe_on(folded, side, [(k, f"_k{i}") for i, k in enumerate(keys)] + [("_block", "_b")])
    return (
        folded.join(side, on)
        .withColumn(sum_name, F.col("_base") + F.col("_s"))
        .withColumn(floor_name, F.least(F.col("_base_low"), F.col("_base") + F.col("_m")))
        .select(*df.columns, sum_name, floor_name)
    )

"""Applying change sets to snapshots, and labelling due rows with batch numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relearn.functions.ranks import global_position

SET_FIELDS = "_set"
DELETED = "_deleted"


def last_per_key(rows: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last by ``order``, and by all other columns where that ties.

    Reducing before the shuffle keeps a key with many rows in many tasks.
    """
    fields = [c for c in rows.columns if c != key]
    if not fields:
        return rows.distinct()
    rest = [f.name for f in rows.schema if f.name in fields and f.name not in order and f.dataType.typeName() not in ("map", "variant")]
    rank = F.struct(*order, *rest) if order or rest else F.lit(0)
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), rank).alias("_last")).select(key, "_last.*")


def merge_changes(base: DataFrame, changes: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """The next snapshot: partial updates, new keys added, flagged keys removed.

    Of several changes of a key the last by ``order`` counts (columns of ``changes``; ties go by all
    its columns). ``_set`` (array of names) lists the fields an
    update carries, so a field can be set to null; without ``_set`` every field present is
    set. ``_deleted`` removes the row.
    """
    changes = last_per_key(changes, key, order)
    fields = [c for c in changes.columns if c not in (key, SET_FIELDS, DELETED)]
    given = F.col(SET_FIELDS) if SET_FIELDS in changes.columns else F.lit(None).cast("array<string>")
    gone = F.col(DELETED) if DELETED in changes.columns else F.lit(False)
    side = changes.select(
        F.col(key).alias("_key"),
        given.alias("_given"),
        F.coalesce(gone, F.lit(False)).alias("_gone"),
        *[F.col(c).alias(f"_new_{c}") for c in fields],
    )
    joined = base.withColumn("_old", F.lit(True)).join(side, base[key] == side["_key"], "full_outer")
    is_new = F.col("_old").isNull()

    def value(name: str) -> Column:
        if name == key:
            return F.coalesce(F.col(key), F.col("_key")).alias(key)
        if name not in fields:
            return F.col(name)
        sets = F.col("_key").isNotNull() & F.coalesce(
            F.array_contains("_given", name), F.lit(True)
        )
        return F.when(is_new | sets, F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)

    return joined.filter(~F.coalesce(F.col("_gone"), F.lit(False))).select(*[value(c) for c in base.columns])


def overlay(base: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """``base`` with the fields of ``updates`` replaced for the keys it names; adds and drops nothing.

    ``updates`` has one row per key; ``last_per_key`` makes it so.
    """
    fields = [c for c in updates.columns if c != key]
    side = updates.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = base.join(side, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in base.columns
        ]
    )


def batched_due(df: DataFrame, predicate: Column, order: Sequence[str], n: int) -> DataFrame:
    """Rows matching ``predicate`` with the number of the batch of ``n`` they fall in.

    Batches follow ``order`` ascending with nulls last; its last column must be unique.
    """
    due = df.filter(predicate)
    placed = global_position(due, [F.col(c).asc_nulls_last() for c in order], "_g")
    return placed.withColumn("batch_no", F.floor(F.col("_g") / F.lit(n)).cast("long")).drop("_g")

"""Shared helpers: the cluster's shared folder, written intermediate tables, row batches, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a fresh local one only in local mode without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


ROW_GROUP_BYTES = 16 << 20


def pin(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)  # a writer keeps a row group in memory
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


#: Rows travel to Python in batches of at most so many bytes (one long text makes a batch of its own).
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch for this session, unless it is set to something else than Spark's default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))


_HELD: list = []


def held(key: tuple, make: Callable):
    """``make()``, kept from task to task in one Python worker until a task of another kind starts."""
    if not _HELD or _HELD[0] != key:
        let_go()
        _HELD.extend((key, make()))
    return _HELD[1]


def let_go() -> None:
    _HELD.clear()
    give_back()


def give_back() -> None:
    """Return freed memory of this worker to the system, where the C library has a call for it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_rows(
    df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 512, start: Callable | None = None, hold: tuple | None = None
) -> DataFrame:
    """``mapInArrow`` in slices of at most ``rows`` rows.

    ``work`` gets a slice and returns columns by name; ``start``, if given, makes a tool that is passed
    to ``work`` as a second argument, once per task or, with a key ``hold``, once per worker. Whatever
    a worker holds for another key goes when the task starts; freed memory is given back after each batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if hold is None:
            let_go()
        more = () if start is None else (start() if hold is None else held(hold, start),)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows), *more)
                yield pa.RecordBatch.from_arrays(
                    [
                        x if isinstance(x, pa.Array) else pa.array(x, type=f.type)
                        for f, x in ((f, out[f.name]) for f in fields)
                    ],
                    schema=fields,
                )
            give_back()

    return df.mapInArrow(run, schema)


def schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


#: Ids up to this number may be sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def sent_if_small(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` (narrow rows, cheap to count) with a broadcast hint if there are at most ``most``."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a, b): columns node, component.

    Labels spread along edges and jump to their label's label, so long chains halve in each round;
    every round is written to the shared folder. Nothing is gathered on the driver but one flag.
    """
    both = pin(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges"
    )
    labels = pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        spread = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        # A label is itself a node, so the inner joins lose nothing.
        after = pin(
            labels.join(spread, "node")
            .join(hop, "component")
            .select("node", F.least("component", "near", "up").alias("component"), F.col("component").alias("was")),
            "labels",
        )
        if after.where("component <> was").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")

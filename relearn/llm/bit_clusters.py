"""Centroid clustering by bit planes: popcounts give exact dot products and distances.

A vector of 64 whole numbers in two's complement is a stack of bit planes, each one uint64: bit i of
plane p is bit p of component i. The dot product of two stacks is the sum over all pairs of planes of
the popcount of their AND, times the planes' weights (the top one's is negative). Planes and squared
lengths are written once; each round reads only these, and returns per task and centroid the number
of its vectors and their sums, again counted plane by plane. Only centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relearn.llm.common import map_rows, pin

WIDTH = 64
#: Components are kept within ±2**27, so that a squared distance of 64 of them fits 64 bits.
MOST = 1 << 27
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def weights(planes: int) -> np.ndarray:
    """Weights of the planes of two's complement, lowest first."""
    out = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    out[-1] *= -1
    return out


def to_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """(vectors, planes) of uint64 from (vectors, 64) of whole numbers."""
    out = np.empty((len(values), planes), dtype="<u8")
    for p in range(planes):
        out[:, p] = np.packbits((values >> p & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def plane_bits(plane: np.ndarray) -> np.ndarray:
    """(vectors, 64) of 0 and 1 from one plane of each vector."""
    return np.unpackbits(np.ascontiguousarray(plane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def from_planes(stack: np.ndarray) -> np.ndarray:
    return sum(plane_bits(stack[:, p]).astype(np.int64) * w for p, w in enumerate(weights(stack.shape[1])))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of every stack of ``a`` with every stack of ``b``, by weighted AND and popcount."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for p, w in enumerate(weights(a.shape[1])):
        part = np.zeros_like(out)
        for r, x in enumerate(weights(b.shape[1])):
            part += x * np.bitwise_count(a[:, p, None] & b[None, :, r]).astype(np.int64)
        out += w * part
    return out


def planes_for(low: int, high: int) -> int:
    return max((-low - 1 if low < 0 else 0).bit_length(), max(high, 0).bit_length()) + 1


def stacks(batch: pa.RecordBatch, planes: int) -> np.ndarray:
    return batch.column("planes").flatten().to_numpy(zero_copy_only=False).reshape(-1, planes).view(np.uint64)


def nearest(batch: pa.RecordBatch, centroids: np.ndarray, planes: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, the first of equally near ones, and its squared distance."""
    own = to_planes(centroids, planes)
    far = batch.column("square").to_numpy()[:, None] + (centroids * centroids).sum(axis=1) - 2 * dots(stacks(batch, planes), own)
    place = np.argmin(far, axis=1)
    return place, far[np.arange(len(far)), place]


def next_centroids(table: DataFrame, centroids: np.ndarray, planes: int, rows: int = 4096) -> np.ndarray:
    """floor(sum / count) of the vectors nearest to each centroid; centroids without vectors stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, WIDTH), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                place, _ = nearest(part, centroids, planes)
                member = (place == np.arange(k)[:, None]).astype(np.float32)
                count += member.sum(axis=1).astype(np.int64)
                for p, w in enumerate(weights(planes)):
                    total += w * (member @ plane_bits(stacks(part, planes)[:, p]).astype(np.float32)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"cluster": list(range(k)), "n": count.tolist(), "sums": total.tolist()})

    sums = table.select("planes", "square").mapInArrow(run, "cluster long, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    sums = sums.groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    after = centroids.copy()
    for r in sums.where("n > 0").collect():  # 64 numbers a centroid
        after[r.cluster, r["at"]] = int(r.x) // int(r.n)
    return after


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, first: Column | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Kept are vectors of exactly 64 components, none null or non-finite; a component x counts as
    floor(scale * x), held within ±2**27. The k vectors with the smallest ``first`` (the SHA-256 of
    ``1:<vec_id>`` if not given) are the first centroids, in that order; equal ones go by their bits, rows
    without vec_id come last. Fewer vectors make fewer centroids, none make no row. Ties go to the centroid with the
    smaller number, repeated rows count as often as they occur, rows without vec_id are clustered like
    others. Sums of distances beyond 64 bits are given as the largest number. Other columns are not read.
    """
    spark = vectors.sparkSession
    first = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256) if first is None else first
    sound = (F.size("embedding") == WIDTH) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x * scale, F.lit(-1e12)), F.lit(1e12))), F.lit(-MOST)), F.lit(MOST))
    rows = vectors.select("vec_id", first.alias("first"), F.col("embedding").cast("array<double>").alias("embedding")).where(sound)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "first", F.transform("embedding", held).alias("v"))
    bounds = rows.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    if bounds.low is None:
        return spark.createDataFrame([], RESULT)
    planes = planes_for(bounds.low, bounds.high)

    def packed(batch: pa.RecordBatch) -> dict:
        values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
        stack = to_planes(values, planes).view(np.int64)
        made = pa.ListArray.from_arrays(np.arange(0, stack.size + 1, planes, dtype=np.int32), stack.ravel())
        return {"vec_id": batch.column("vec_id"), "first": batch.column("first"), "planes": made.cast(pa.list_(pa.field("element", pa.int64()))), "square": (values * values).sum(axis=1)}

    kind = rows.schema["first"].dataType.simpleString()
    table = pin(map_rows(rows, packed, f"vec_id long, first {kind}, planes array<long>, square long", rows=4096), "planes")
    seeds = table.orderBy(F.asc_nulls_last("first"), "planes").limit(k).select("planes").collect()  # k rows
    centroids = from_planes(np.array([r.planes for r in seeds], dtype=np.int64).view(np.uint64))
    for _ in range(rounds):
        centroids = next_centroids(table, centroids, planes)

    def assigned(batch: pa.RecordBatch) -> dict:
        place, far = nearest(batch, centroids, planes)
        return {"vec_id": batch.column("vec_id"), "cluster": place.astype(np.int32), "distance": far}

    found = pin(map_rows(table.select("vec_id", "planes", "square"), assigned, "vec_id long, cluster int, distance long", rows=4096), "clusters")
    sums = {r.cluster: int(r.x) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    shown = [(c, min(x, 2**63 - 1), min(sum(sums.values()), 2**63 - 1), digest(c)) for c, x in sums.items()]
    clusters = spark.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are sent

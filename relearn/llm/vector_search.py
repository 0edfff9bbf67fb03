"""Exact top-k by inner product: branch and bound over dimension blocks in vertical layout.

A tile holds its vectors by column: dimension after dimension, the most telling ones first. Scores are
accumulated block of dimensions by block; what the dimensions still to come can add is at most the
product of the lengths of the two rests (the remaining mass). Pairs whose bound stays below the k-th
best score known for their query are dropped, and once few are left they are compacted into a list
that alone is followed through the remaining blocks.

Queries and candidates meet tile by tile, each pair of tiles once: rows are numbered, a query's row is
repeated per candidate tile and a candidate's per query tile, and Spark groups them by the pair, whose
size is bounded in bytes. Tiles are searched in rounds of 1, 7, 56, ... so that later ones start from
the scores found before; a round returns at most k rows a query and tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relearn.llm.common import pin

FOUND = "query_row long, query_id long, row long, vec_id long, score long"
RESULT = "query_id long, rank int, vec_id long, score long"
#: Vectors at least this long are scored with unbounded integers; the products of others stay below 2**52.
LONG = float(1 << 26)
#: Components beyond this are taken as this: every score they enter lies beyond 64 bits.
MOST = 1e100


def matrices(column: pa.ChunkedArray, scale: int) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(places, components by column, whether they are large) of the vectors of each length."""
    lists = column.combine_chunks()
    flat, length = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(length, dtype=np.int64) - length
    out = []
    for n in np.unique(length).tolist():
        own = np.flatnonzero(length == n)
        values = np.clip(np.floor(flat[start[own] + np.arange(n)[:, None]] * float(scale)), -MOST, MOST)
        large = np.sqrt((values * values).sum(axis=0)) >= LONG
        out += [(own[part], np.ascontiguousarray(values[:, part]), flag) for part, flag in ((~large, False), (large, True)) if part.any()]
    return out


def rests(values: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Length of what each vector has from each cut on: the remaining mass."""
    mass = np.vstack([np.cumsum((values * values)[::-1], axis=0)[::-1], np.zeros((1, values.shape[1]))])
    return np.sqrt(mass[cuts])


def close_pairs(q: np.ndarray, c: np.ndarray, least: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, candidate places and exact scores of all pairs that score at least their query's ``least``."""
    order = np.argsort(-(q * q).sum(axis=1) * (c * c).sum(axis=1), kind="stable")
    q, c = q[order], c[order]
    cuts = [*range(0, len(order), block), len(order)]
    left, right = rests(q, cuts), rests(c, cuts)
    score, at = np.zeros((q.shape[1], c.shape[1])), 0
    alive = np.ones(score.shape, dtype=bool)
    for at in range(1, len(cuts)):
        score += q[cuts[at - 1] : cuts[at]].T @ c[cuts[at - 1] : cuts[at]]
        alive = score + left[at][:, None] * right[at] * (1 + 1e-9) + 0.5 >= least[:, None]
        if np.count_nonzero(alive) * 16 <= alive.size:
            break
    qi, ci = np.nonzero(alive)
    score = score[qi, ci]
    for at in range(at + 1, len(cuts)):
        score += np.einsum("ij,ij->j", q[cuts[at - 1] : cuts[at], qi], c[cuts[at - 1] : cuts[at], ci])
        alive = score + left[at][qi] * right[at][ci] * (1 + 1e-9) + 0.5 >= least[qi]
        qi, ci, score = qi[alive], ci[alive], score[alive]
    return qi, ci, score.astype(np.int64)


def large_pairs(q: np.ndarray, c: np.ndarray, other: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`close_pairs` for large components: bounds from rounded scores, whole numbers for what they leave."""
    slack = 1e-9 * np.sqrt((q * q).sum(axis=0))[:, None] * np.sqrt((c * c).sum(axis=0)) + 1
    score = np.where(other, q.T @ c, -np.inf)
    floor = least
    if c.shape[1] > k:
        low = np.where(other, score - slack, -np.inf)
        floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
    floor = np.minimum(floor, 9.2e18)[:, None]  # scores beyond 64 bits are equal
    qi, ci = np.nonzero(other & (score + slack >= floor - np.abs(floor) * 1e-9))
    exact = (sum(int(a) * int(b) for a, b in zip(q[:, i].tolist(), c[:, j].tolist(), strict=True)) for i, j in zip(qi, ci, strict=True))
    return qi, ci, np.array([min(max(x, -(2**63) + 1), 2**63 - 1) for x in exact], dtype=np.int64)


def best_of(found: list[np.ndarray], k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The k best of (query place, score, vec_id, row) per query, and each one's rank from 0."""
    q, score, vec, row = found
    order = np.lexsort((row, vec, -score, q))
    found = [x[order] for x in found]
    first = np.flatnonzero(np.r_[True, found[0][1:] != found[0][:-1]]) if len(order) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return [x[rank < k] for x in found], rank[rank < k]


def search_tile(queries: pa.Table, candidates: pa.Table, k: int, scale: int, block: int, rows: int = 4096, most: int = 256) -> list[np.ndarray]:
    """(query place, score, vec_id, row) of the k best candidates of each query of one pair of tiles.

    ``rows`` candidates meet ``most`` queries at a time, so memory does not grow with the tile's product.
    """
    query_id = queries.column("query_id").to_numpy()
    least = queries.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
    least[np.isnan(least)] = -np.inf
    vec, row = candidates.column("vec_id").to_numpy(), candidates.column("row").to_numpy()
    found = [np.empty(0, dtype=np.int64)] * 4
    left, right = matrices(queries.column("asked"), scale), matrices(candidates.column("v"), scale)
    for places, c, c_large in right:
        for lo in range(0, c.shape[1], rows):
            own, new = places[lo : lo + rows], []
            for asked, q, q_large in left:
                n = min(len(q), len(c))  # missing components count as 0
                for at in range(0, q.shape[1], most):
                    a = asked[at : at + most]
                    x, y = q[:n, at : at + most], c[:n, lo : lo + rows]
                    if not (q_large or c_large):
                        qi, ci, score = close_pairs(x, y, least[a], block)
                    else:
                        qi, ci, score = large_pairs(x, y, query_id[a][:, None] != vec[own], least[a], k)
                    other = query_id[a][qi] != vec[own][ci]
                    new.append((a[qi[other]], score[other], vec[own][ci[other]], row[own][ci[other]]))
            found, rank = best_of([np.concatenate(x) for x in zip(found, *new, strict=True)], k)
            full = rank == k - 1
            least[found[0][full]] = np.maximum(least[found[0][full]], found[1][full].astype(np.float64))
    return found


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block: int = 8, tile_bytes: int = 32_000_000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query row with all other rows.

    Components x count as floor(scale * x). Ties go to the smaller vec_id. Rows that bear the query's
    vec_id are its own and left out. Vectors that are null, or hold a null or a non-finite component,
    take no part, nor do rows without vec_id. Shorter vectors count as filled up with zeros, so vectors
    of any length meet, empty ones with score 0. A query row that occurs twice is answered twice, a
    candidate that occurs twice takes two ranks. Scores beyond 64 bits are given as the outermost
    number. No query, or no other row, gives no row. Other columns are not read.
    """
    spark = vectors.sparkSession
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    rows = rows.where(sound & F.col("vec_id").isNotNull())
    rows = pin(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").alias("v"), F.coalesce("asks", F.lit(False)).alias("asks")), "vectors")
    size = F.size("v").cast("long") * 8 + 64
    totals = rows.agg(F.sum(size).alias("all"), F.sum(F.when(F.col("asks"), size)).alias("asking")).first()
    if not totals.asking:
        return spark.createDataFrame([], RESULT)
    tiles = max(spark.sparkContext.defaultParallelism, -(-totals["all"] // tile_bytes))
    parts = -(-totals.asking // tile_bytes)
    best = spark.createDataFrame([], FOUND)
    per_query = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")

    def search(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        place, score, vec, row = search_tile(queries, candidates, k, scale, block)
        asked = [queries.column(c).to_numpy()[place] for c in ("query_row", "query_id")]
        return pa.table({"query_row": asked[0], "query_id": asked[1], "row": row, "vec_id": vec, "score": score})

    lo, hi = 0, 1
    while lo < tiles:
        hi = min(hi, tiles)
        least = best.withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("least"))
        asking = rows.where("asks").join(least, "row", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
        asking = asking.select(
            "part", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)).cast("array<long>")).alias("tile"), F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("asked"), "least"
        )
        others = rows.withColumn("tile", F.pmod("row", F.lit(tiles))).where(F.col("tile").between(lo, hi - 1))
        others = others.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")).alias("part"), "tile", "row", "vec_id", "v")
        found = asking.groupBy("part", "tile").cogroup(others.groupBy("part", "tile")).applyInArrow(search, FOUND)
        best = pin(best.union(found).withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= k).drop("rank"), "best")
        lo, hi = hi, 8 * hi
    return best.select("query_id", F.row_number().over(per_query).cast("int").alias("rank"), "vec_id", "score")

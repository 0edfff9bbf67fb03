"""Jaccard self-join on word shingles by token-combination prefixes, and the components of its links.

Sets of equal content are one class and take part once. Every class keeps its smallest shingle
hashes, its prefix, extended by n/16 beyond what one common token needs. Two similar sets then
share at least 2 + n/16 prefix tokens.

* A token held by few prefixes (``rare``) is a key of its own: its holders are paired.
* Sets that can be similar through frequent tokens alone hold at least 2 + n/16 of them. Among
  these, prefixes are taken anew from whole sets, rarest token first. Their frequent tokens are
  dealt into g classes by hash, with g below the number of common tokens, so two of the common ones
  fall into one class: the key is that combination of two tokens.
* Crowded groups are first joined into components by a few exact checks for each set. For components
  alone, what lies outside a crowd's largest component is compared with the whole crowd in blocks,
  exactly. For all links, every two blocks of a crowd or component meet once, and tasks sum the
  links of each set.

Candidates whose shared prefix tokens rule out the threshold are dropped, the others are verified
on whole shingle sets. No candidate is capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relearn.llm.common import components, map_rows, pin, sent_if_small

# Odd multipliers of the 64-bit mixing steps.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], dtype=np.uint64)
CACHED_WORDS = 400_000


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text given as UTF-8 bytes."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}

    def hashes(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.int64)
        found = text.lower().split()  # on bytes: only A-Z is lowered, only ASCII white space splits
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, digest = self.known, xxhash.xxh3_64_intdigest
        h = np.array([known[w] if w in known else known.setdefault(w, digest(w)) for w in found], dtype=np.uint64)
        n = min(self.words, len(h))
        if n == 0:
            return np.empty(0, dtype=np.int64)
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * MULTIPLIERS[0]
            out ^= out >> np.uint64(29)
        out *= MULTIPLIERS[3]
        out ^= out >> np.uint64(32)
        return np.unique(out.view(np.int64))


def lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def shingle_sketch(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, key (digest of the whole set), prefix (its smallest hashes), its size and last hash.

    A prefix that is the whole set ends behind all hashes.
    """

    def work(batch: pa.RecordBatch, shingler: Shingler) -> dict:
        keys, sizes, prefixes, last = [], [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            h = shingler.hashes(text)
            n = len(h)
            keys.append(digest(h))
            sizes.append(n)
            prefixes.append(h[: min(n, n - -(-percent * n // 100) + 2 + n // 16)])
            last.append(int(prefixes[-1][-1]) if 0 < len(prefixes[-1]) < n else 2**63 - 1)
        return {
            "doc_id": batch.column("doc_id"), "n_shingles": sizes, "key": keys,
            "prefix": lists(prefixes), "p": [len(x) for x in prefixes], "last": last,
        }

    return map_rows(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        work,
        "doc_id long, n_shingles long, key binary, prefix array<long>, p long, last long",
        start=lambda: Shingler(words),
    )


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and its whole shingle set; ``wanted``: node, key, rep (a doc_id with that set)."""

    def work(batch: pa.RecordBatch, shingler: Shingler) -> dict:
        found = [shingler.hashes(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
        return {"key": [digest(h) for h in found], "tokens": lists(found)}

    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = map_rows(rows.join(sent_if_small(ids), "doc_id", "left_semi"), work, "key binary, tokens array<long>", start=lambda: Shingler(words))
    return found.join(wanted.select("key", "node"), "key").dropDuplicates(["node"]).select("node", "tokens")


def similar(percent: int | float, shared: str = "shared", a: str = "n_a", b: str = "n_b") -> Column:
    return F.expr(f"100 * {shared} >= {percent} * ({a} + {b} - {shared})")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the exact sizes and overlap of their sets."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("t_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select(
        *pairs.columns,
        F.size("t_a").cast("long").alias("n_a"),
        F.size("t_b").cast("long").alias("n_b"),
        F.size(F.array_intersect("t_a", "t_b")).cast("long").alias("shared"),
    )


def possible(pairs: DataFrame, stats: DataFrame, shared: Column, percent: int = 75) -> DataFrame:
    """The pairs whose shared prefix tokens (at most ``shared``) still allow the threshold.

    The side whose prefix ends first has all its common tokens in the other prefix, so the overlap
    is at most the shared ones plus what lies behind its own prefix.
    """
    side = lambda s: stats.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "p", "last", "h")])
    rest = F.when(F.col("last_a") <= F.col("last_b"), F.col("n_a") - F.col("p_a")).otherwise(F.col("n_b") - F.col("p_b"))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
        .withColumn("most", shared + rest)
        .where(similar(percent, "most"))
        .select("a", "b")
    )


def sized(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose set sizes allow a similarity of ``percent``."""
    side = lambda s: sizes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"))
    fits = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b")


def pairs_within(rows: DataFrame, key: str) -> DataFrame:
    """a < b for the nodes that share ``key``; only for keys whose groups are small."""
    left = rows.select(key, F.col("node").alias("a"))
    return left.join(rows.select(key, F.col("node").alias("b")), key).where("a < b")


def combinations(rows: DataFrame) -> DataFrame:
    """Keys of two frequent tokens of one hash class: node, key.

    ``rows``: node, tokens (frequent prefix tokens), q (least number of common ones, 2 or more) and
    low (that of the smallest similar set). With g a power of two below q, two of q common tokens
    share a class. Two sets meet at the g of the smaller one, so each indexes its own g and that of low.
    """

    def work(batch: pa.RecordBatch) -> dict:
        nodes, keys = [], []
        for node, tokens, q, low in zip(*(batch.column(c).to_pylist() for c in ("node", "tokens", "q", "low")), strict=True):
            t = np.unique(np.array(tokens, dtype=np.int64)).view(np.uint64)
            for g in {1 << (x - 1).bit_length() - 1 for x in range(low, q + 1)}:
                mixed = (t ^ (t >> np.uint64(31))) * MULTIPLIERS[1]
                spot = (mixed >> np.uint64(40)) % np.uint64(g)
                order = np.argsort(spot, kind="stable")
                mixed, spot = mixed[order], spot[order]
                for c in range(g):
                    own = mixed[spot == c]
                    if len(own) > 1:
                        i, j = np.triu_indices(len(own), 1)
                        k = (own[i] * MULTIPLIERS[2] ^ (own[j] >> np.uint64(7)) ^ own[j]) * MULTIPLIERS[0] + np.uint64(g)
                        keys.append(k)
                        nodes.append(np.full(len(k), node, dtype=np.int64))
        joined = lambda x, kind: np.concatenate(x).view(np.int64) if x else np.empty(0, dtype=kind)
        return {"node": joined(nodes, np.int64), "key": joined(keys, np.int64)}

    return map_rows(rows.select("node", "tokens", "q", "low"), work, "node long, key long", rows=64)


def proposals(full: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact sizes of pairs of each node with two holders of each of its four smallest tokens."""
    first = full.select("node", F.explode(F.slice(F.array_sort("tokens"), 1, 4)).alias("token"))
    heads = first.groupBy("token").agg(
        F.min("node").alias("x"), F.min_by("node", F.xxhash64("node", "token")).alias("y")
    )
    asked = first.join(heads, "token").select(F.col("node").alias("a"), F.explode(F.array("x", "y")).alias("b"))
    return measured(asked.where("a <> b").distinct(), sets)


BLOCK = 128


def side(sets: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, parts, set sizes and all tokens of a block."""
    node, part, tokens = sets.flatten()
    sizes = tokens.value_lengths().to_numpy(zero_copy_only=False)
    return node.to_numpy(), part.to_numpy(), sizes, tokens.flatten().to_numpy()


def similar_in(asked: tuple, held: tuple, percent: int) -> np.ndarray:
    """Which sets of two blocks are similar, as a matrix."""
    seen = np.intersect1d(asked[3], held[3])
    table = []
    for _, _, sizes, tokens in (asked, held):
        row, at = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(seen, tokens)
        hit = seen[np.minimum(at, len(seen) - 1)] == tokens if len(seen) else np.zeros(len(tokens), dtype=bool)
        m = np.zeros((len(sizes), len(seen)), dtype=np.float32)
        m[row[hit], at[hit]] = 1
        table.append(m)
    shared = np.rint(table[0] @ table[1].T).astype(np.float64)
    return 100 * shared >= percent * (asked[2][:, None].astype(np.float64) + held[2][None, :] - shared)


def compared(batch: pa.RecordBatch, percent: int) -> dict:
    """Similar pairs between two blocks of sets that are in different components so far."""
    links: list[tuple[int, int]] = []
    for x, y in zip(batch.column("asked"), batch.column("held"), strict=True):
        asked, held = side(x.values), side(y.values)
        fit = similar_in(asked, held, percent) & (asked[1][:, None] != held[1][None, :])
        links += [(asked[0][i], held[0][j]) for i, j in np.argwhere(fit)]
    return {"a": [x for x, _ in links], "b": [x for _, x in links]}


def across(rows: DataFrame, percent: int) -> DataFrame:
    """Links between components of one crowd; ``rows``: crowd, node, part, tokens.

    Sets outside the crowd's largest component are compared with all sets of the crowd, block by
    block, as products of 0/1 matrices; pairs are never listed.
    """
    parts = rows.groupBy("crowd", "part").count()
    crowds = parts.groupBy("crowd").agg(
        F.sum("count").alias("all"), F.max("count").alias("most"), F.max_by("part", F.struct("count", "part")).alias("giant")
    )
    near = rows.join(sent_if_small(pin(crowds, "sizes")), "crowd")  # one row a crowd
    blocks = lambda n: F.ceil(n / BLOCK)
    into = lambda n: F.pmod(F.xxhash64("node"), n).alias("block")
    one = F.collect_list(F.struct("node", "part", "tokens"))
    held = near.select("crowd", into(blocks(F.col("all"))), "node", "part", "tokens").groupBy("crowd", "block").agg(one.alias("held"))
    asked = (
        near.where("part <> giant")
        .select("crowd", blocks(F.col("all")).alias("n"), into(blocks(F.col("all") - F.col("most"))), "node", "part", "tokens")
        .groupBy("crowd", "n", "block")
        .agg(one.alias("asked"))
        .select("crowd", "asked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    )
    return map_rows(
        asked.join(held, ["crowd", "block"]).select("asked", "held"), lambda x: compared(x, percent), "a long, b long", rows=4
    )


#: Sets whose links one task counts before it passes the sums on.
COUNTED = 200_000


def within(rows: DataFrame, percent: int, listed: bool = False) -> DataFrame:
    """All links within each crowd; ``rows``: crowd, node, part, tokens.

    Rows (a, null, n) are links of set a, to be summed; rows (a, b, null) with a < b are links
    between different parts or, with ``listed``, all links. Each two blocks of a crowd meet once:
    a block meets itself and the next half of the ring of blocks.
    """
    sizes = sent_if_small(pin(rows.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "sizes"))
    placed = rows.join(sizes, "crowd").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    held = placed.groupBy("crowd", "blocks", "block").agg(F.collect_list(F.struct("node", "part", "tokens")).alias("held"))
    steps = F.floor(F.col("blocks") / 2) - F.expr("int(blocks % 2 = 0 AND 2 * block >= blocks)")
    asked = held.select("crowd", "blocks", F.col("block").alias("own"), F.col("held").alias("asked"), F.explode(F.sequence(F.lit(0).cast("long"), steps)).alias("step"))
    asked = asked.select("crowd", "asked", (F.col("step") == 0).alias("same"), F.pmod(F.col("own") + F.col("step"), F.col("blocks")).alias("block"))
    pairs = asked.join(held.select("crowd", "block", "held"), ["crowd", "block"]).select("asked", "held", "same")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches):
        sums: dict[int, int] = {}

        def out() -> pa.RecordBatch:
            nodes, n = list(sums), list(sums.values())
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64())], schema=schema)

        for batch in batches:
            for x, y, same in zip(batch.column("asked"), batch.column("held"), batch.column("same").to_pylist(), strict=True):
                one = side(x.values)
                two = one if same else side(y.values)
                fit = similar_in(one, two, percent)
                if same:
                    np.fill_diagonal(fit, False)
                if not listed:
                    for nodes, n in ((one[0], fit.sum(axis=1)), (two[0], fit.sum(axis=0)))[: 1 if same else 2]:
                        for node, k in zip(nodes.tolist(), n.tolist(), strict=True):
                            if k:
                                sums[node] = sums.get(node, 0) + k
                    fit &= one[1][:, None] != two[1][None, :]
                i, j = np.nonzero(np.triu(fit) if same else fit)
                if len(i):
                    a, b = one[0][i], two[0][j]
                    ends = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())]
                    yield pa.RecordBatch.from_arrays(ends, schema=schema)
                if len(sums) > COUNTED:
                    yield out()
        yield out()

    return pairs.mapInArrow(run, "a long, b long, n long")


def ngram_jaccard_join(
    docs: DataFrame, words: int = 5, percent: int = 75, rare: int = 32, crowded: int = 64
) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n_shingles, node, n_links) and all links (a < b) between nodes whose sets are similar.

    ``n_links`` counts the other sets similar to the row's own. Links within crowds are found when
    the links are read, one row a link; counts and components need no such rows.
    """
    members, found, crowds, counts = joined_nodes(docs, words, percent, rare, crowded, True)
    links = found
    if crowds is not None:
        links = found.union(within(crowds, percent, listed=True).select("a", "b")).distinct()
    return members.join(counts, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("n_links", F.lit(0)).alias("n_links")), links


def link_counts(found: DataFrame, crowds: DataFrame | None, inside: DataFrame | None) -> DataFrame:
    """node, n_links: the links of each node within its crowd, and those listed in ``found`` that leave it."""
    if crowds is not None:
        of = lambda s: crowds.select(F.col("node").alias(s), F.col("crowd").alias(f"crowd_{s}"))
        found = found.join(of("a"), "a", "left").join(of("b"), "b", "left").where("NOT coalesce(crowd_a = crowd_b, false)")
    ends = found.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n"))
    if inside is not None:
        ends = ends.union(inside.where("n IS NOT NULL").select("a", "n"))
    return ends.groupBy("node").agg(F.sum("n").alias("n_links"))


def joined_nodes(
    docs: DataFrame, words: int, percent: int, rare: int, crowded: int, counted: bool
) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Members (doc_id, n_shingles, node), links (a < b), crowds (crowd, node, part, tokens) and counts (node, n_links).

    A node stands for one shingle set: the smallest doc_id that has it. Where rows of one doc_id have
    several sets, all but one of these get a negative node made from the set's digest. Rows without
    doc_id keep a null node and link with nothing. Texts without words have no shingle and no node
    but their doc_id. Links suffice for the components: of those within crowds, only some are listed.
    If ``counted``, the crowds are given whose sets were all compared with each other, and counts
    over all links; else both are None. Runs jobs when called; intermediate tables go to the shared folder.
    """
    sketch = pin(shingle_sketch(docs, words, percent), "sketch")
    filled = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = [F.first(c).alias(a) for c, a in (("n_shingles", "n"), ("p", "p"), ("last", "last"))]  # equal for equal sets
    reps = filled.groupBy("key").agg(F.min("doc_id").alias("rep"), *same)
    made = F.xxhash64("key").bitwiseOR(F.lit(-(2**63)))
    own = F.col("key") == F.min("key").over(Window.partitionBy("rep"))
    nodes = pin(reps.select("key", "rep", "n", "p", "last", F.when(own, F.col("rep")).otherwise(made).alias("node")), "nodes")
    members = sketch.select("doc_id", "n_shingles", "key").join(nodes.select("key", "node"), "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")
    )
    # Of one or two shingles, no other set can be similar enough at three quarters.
    least = 3 if percent >= 75 else 1
    prefixes = (
        filled.where(F.col("n_shingles") >= least)
        .groupBy("key")
        .agg(F.first("prefix").alias("prefix"))
        .join(nodes.select("key", "node"), "key")
        .drop("key")
    )
    postings = prefixes.select("node", F.explode("prefix").alias("token"))
    known = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = pin(postings.join(known, "token"), "common")

    held = common.groupBy("node").agg(F.sum((F.col("df") > rare).cast("long")).alias("h"))
    stats = pin(nodes.join(held, "node").select("node", "n", "p", "last", "h"), "stats")
    seen = pairs_within(common.where(F.col("df") <= rare), "token").groupBy("a", "b").agg(F.count(F.lit(1)).alias("r"))
    single = possible(seen, stats, F.col("r") + F.least("h_a", "h_b"), percent)

    smaller = lambda n: F.ceil(n * percent / 100)  # noqa: E731  the smallest set similar to one of n
    common_to = lambda n: (2 + F.floor(smaller(n) / 16)).cast("int")
    least = common_to(F.col("n"))
    rich = stats.select("node", "n", least.alias("q"), common_to(smaller(F.col("n"))).alias("low")).where(stats.h >= least)
    rich = pin(rich, "rich")
    single = pin(single, "single")
    wanted = single.select(F.col("a").alias("node")).union(single.select("b")).union(rich.select("node")).distinct()
    wanted = pin(wanted.join(nodes, "node"), "wanted")
    sets = pin(shingle_sets(docs, wanted, words), "sets")
    links = [measured(single, sets).where(similar(percent)).select("a", "b")]
    crowds = inside = None
    if not rich.isEmpty():
        more, crowds, inside = crowd_links(rich, sets, percent, rare, crowded, counted)
        links += more
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    found = pin(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return members, found, crowds, link_counts(found, crowds, inside) if counted else None


def crowd_links(
    rich: DataFrame, sets: DataFrame, percent: int, rare: int, crowded: int, counted: bool
) -> tuple[list[DataFrame], DataFrame | None, DataFrame | None]:
    """Links among sets that may be similar through frequent tokens alone (``rich``: node, n, q).

    If ``counted``, also the crowds and components whose sets were all compared, and what ``within``
    found there: links listed outside these lead to other crowds.

    Among these, whole sets are counted and prefixes taken rarest token first, so that only sets
    made of frequent tokens by three quarters reach frequent ones. Prefixes are long enough for q
    common tokens.
    """
    postings = rich.join(sets, "node").select("node", "n", "q", "low", F.explode("tokens").alias("token"))
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by_rarity = Window.partitionBy("node").orderBy("df", "token")
    prefix = pin(
        postings.join(counts, "token", "left")
        .withColumn("df", F.coalesce("df", F.lit(1)))
        .withColumn("at", F.row_number().over(by_rarity))
        .where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + F.col("q")) & (F.col("df") > 1)),
        "prefix",
    )
    sizes = rich.select("node", "n")
    near = pairs_within(prefix.where(F.col("df") <= rare), "token").distinct()
    full = pin(
        prefix.where(F.col("df") > rare)
        .groupBy("node", "n", "q", "low")
        .agg(F.collect_set("token").alias("tokens"))
        .where(F.size("tokens") > 1),
        "full",
    )
    linked = pin(proposals(full, sets).where(similar(percent)), "linked")
    joined = components(linked)
    keyed = pin(
        combinations(full).join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")),
        "keyed",
    )
    # Groups within one component so far need no more links for components. Components stand for their nodes.
    parts = pin(keyed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")), "parts")
    mixed = parts.groupBy("key").agg(F.sum("n").alias("size"), F.min("part").alias("head"), F.max("part").alias("last"))
    mixed = pin(mixed.where("head <> last"), "mixed")
    few = keyed.join(mixed.where(F.col("size") <= crowded).select("key"), "key")
    other = few.select("key", F.col("node").alias("b"), F.col("part").alias("part_b"))
    small = (
        few.select("key", F.col("node").alias("a"), "part")
        .join(other, "key")
        .where("part < part_b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    checks = sized(near.select("a", "b").union(small).distinct(), sizes, percent)

    # Crowded groups that share components are one crowd.
    large = parts.join(mixed.where(F.col("size") > crowded).select("key", "head"), "key")
    crowd = components(large.select(F.col("part").alias("a"), F.col("head").alias("b")).distinct())
    named = crowd.select(F.col("node").alias("part"), F.col("component").alias("crowd"))
    placed = full.select("node").join(joined, "node", "left").select("node", "component", F.coalesce("component", "node").alias("part"))
    links = [linked.select("a", "b"), measured(checks, sets).where(similar(percent)).select("a", "b")]
    if not counted:
        rows = placed.select("node", "part").join(named, "part").join(sets, "node")
        return [*links, across(pin(rows, "crowds"), percent)], None, None
    placed = placed.join(named, "part", "left").select("node", "part", F.coalesce("crowd", "component").alias("crowd"))
    placed = pin(placed.where("crowd IS NOT NULL"), "placed")
    crowds = sets.join(sent_if_small(placed), "node").select("crowd", "node", "part", "tokens")
    inside = pin(within(crowds, percent), "inside")
    return [*links, inside.where("b IS NOT NULL").select("a", "b")], crowds, inside


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 75, rare: int = 32, crowded: int = 64, counted: bool = True
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and n_links for every row.

    ``n_links`` is the number of other shingle sets similar to the row's own; without ``counted`` it
    is left out and crowds are compared only as far as components need.
    Null and empty texts and texts without words have no shingle and are their own component; a row
    without doc_id has none. Rows that repeat a doc_id are returned as often as they occur. Other
    columns of ``docs`` are not read. An empty table gives no row.
    """
    members, links, _, counts = joined_nodes(docs, words, percent, rare, crowded, counted)
    # Rows of one doc_id are one document, whatever their texts.
    several = members.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    several = pin(several, "several")
    none = several.isEmpty()
    if not none:
        links = links.union(members.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).distinct())
    labelled = members.join(components(links), "node", "left")
    more = []
    if counts is not None:
        labelled, more = labelled.join(counts, "node", "left"), [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    labelled = labelled.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"), *more)
    if none:
        return labelled
    # Made nodes are no doc_ids: name each component after its smallest one.
    labelled = pin(labelled, "labelled")
    names = labelled.groupBy("component_id").agg(F.min("doc_id").alias("name"))
    named = labelled.join(names, "component_id", "left")
    return named.select("doc_id", "n_shingles", F.col("name").alias("component_id"), *labelled.columns[3:])


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id; same columns.

    Of rows that repeat this doc_id one stays. Rows without doc_id stay.
    """
    near = pin(near_duplicates(docs, words, percent, counted=False), "near")
    late = near.where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(sent_if_small(late), "doc_id", "left_anti").select(*docs.columns)
    twice = near.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return left
    twice = sent_if_small(pin(twice, "twice"))
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).union(
        left.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    )

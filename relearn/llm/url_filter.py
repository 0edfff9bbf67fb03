"""URL verdicts from host and path rules, and from link-graph propagation where no rule fits.

Personalised PageRank spreads trust from the hosts of allowed pages along links, and distrust from
the hosts of blocked pages against them: who links to blocked hosts is distrusted. Each host is
then allowed or blocked by comparing both. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relearn.llm.common import pin, sent_if_small

LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ://, A-Z lowered, and the path up to query or fragment; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.substr(url, F.when(at > 0, at + 3).otherwise(F.lit(1)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    has = F.coalesce(at > 0, F.lit(False))
    return F.when(has, lower_ascii(host)).otherwise(""), F.when(has, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (size, rule, action) of the longest rule, given as (action, host/path); null if none fits.

    A host's domain suffixes are looked up in a map of the rules, so the list may hold thousands.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for action, rule in rules:
        h, slash, p = rule.partition("/")
        by_host.setdefault(h, []).append((slash + p, action))
    kind = "array<struct<path:string,action:string>>"
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,action:string>")
    table = F.create_map(
        *[
            x
            for h, own in by_host.items()
            for x in (F.lit(h), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(a).alias("action")) for p, a in own]).cast(kind))
        ]
    )
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(
                F.filter(F.coalesce(F.try_element_at(table, s), F.array().cast(kind)), lambda r: path.startswith(r["path"])),
                lambda r: F.struct(
                    F.length(F.concat(s, r["path"])).alias("size"), F.concat(s, r["path"]).alias("rule"), r["action"].alias("action")
                ),
            ),
        )
    )
    return F.array_max(fitting)


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts: source, target, n. ``pages``: host, html."""
    links = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))))
    targets = pages.where("host <> ''").select(F.col("host").alias("source"), links.alias("url"))
    full = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), F.col("url"))).otherwise(F.col("url"))
    return (
        targets.select("source", host_and_path(full)[0].alias("target"))
        .where("target <> '' AND source <> target")
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: Rounds between two looks at what still changes.
LOOK = 4


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, stay: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """Personalised PageRank of each (kind, host): kind, host, score.

    ``edges``: kind, source, target, n; ``seeds``: kind, host, weight. Shares of a source go to its
    targets by n. Each round pre-aggregates the shares by target; tables hold one row a host.
    Rounds go on until none changes any score by more than ``tolerance`` of itself, so every host
    that links reach has its score, however far; or, if given, there are just ``rounds``.
    """
    out = edges.groupBy("kind", "source").agg(F.sum("n").alias("total"))
    shares = pin(edges.join(out, ["kind", "source"]).select("kind", F.col("source").alias("host"), "target", (F.col("n") / F.col("total")).alias("share")), "edges")
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = pin(seeds.join(total, "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("seed")), "seeds")
    score = start.select("kind", "host", F.col("seed").alias("score"))
    if shares.isEmpty():  # without links every score stays where it began
        return score.withColumn("score", F.col("score") * (1 - stay))
    step = 0
    while rounds is None or step < rounds:
        sent = (
            score.join(shares, ["kind", "host"])
            .groupBy("kind", F.col("target").alias("host"))
            .agg((stay * F.sum(F.col("score") * F.col("share"))).alias("score"))
        )
        kept = start.select("kind", "host", ((1 - stay) * F.col("seed")).alias("score"))
        step += 1
        after = sent.union(kept)
        if rounds is None and step % LOOK == 0:
            both = after.withColumn("was", F.lit(0.0)).union(score.select("kind", "host", F.lit(0.0), "score"))
            both = pin(both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("was").alias("was")), "scores")
            score = both.select("kind", "host", "score")
            if both.where(F.abs(F.col("score") - F.col("was")) > tolerance * F.greatest("score", "was")).isEmpty():
                break
        else:
            score = after.groupBy("kind", "host").agg(F.sum("score").alias("score"))
            if rounds is not None and (step % 3 == 0 or step == rounds):
                score = pin(score, "scores")
    return score


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], rounds: int | None = None, stay: float = 0.85, lean: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, trust, distrust, verdict for every row.

    Without a fitting rule a page is blocked if its host's distrust exceeds ``lean`` times its trust,
    else allowed; a url that is null or has no host reaches no seed and is allowed. Rows that repeat
    are returned as often. Links are followed until scores stand still, or over ``rounds`` if given.
    Columns other than page_id, url and html are not read.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    ruled = read.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    judged = pin(ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.action").alias("action")), "judged")
    links = pin(host_edges(read.select("host", "html")), "links")
    edges = links.select(F.lit("allow").alias("kind"), "source", "target", "n").union(
        links.select(F.lit("block"), F.col("target"), F.col("source"), F.col("n"))
    )
    seeds = judged.where("action IS NOT NULL AND host <> ''").groupBy(F.col("action").alias("kind"), "host").agg(F.count(F.lit(1)).alias("weight"))
    scores = propagate(edges, seeds, rounds, stay)
    per_host = scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "allow", F.col("score"))).alias("trust"),
        F.sum(F.when(F.col("kind") == "block", F.col("score"))).alias("distrust"),
    )
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    said = F.when(F.col("action").isNotNull(), F.col("action")).when(distrust > lean * trust, "block").otherwise("allow")
    return judged.join(sent_if_small(pin(per_host, "hosts"), 200_000), "host", "left").select(
        "page_id", "host", "path", "rule", trust.alias("trust"), distrust.alias("distrust"), said.alias("verdict")
    )

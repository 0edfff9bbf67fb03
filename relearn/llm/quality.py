"""Quality rules with thresholds learned per language and source, in DataFrame functions only.

The quantile sketch of a metric is a histogram of logarithmic bins, two per cent wide, beside a count
of zeros: one row a bin, merged by adding counts, so partial sums, merges and reruns give the same
numbers. Sketches are kept per (lang, source) and merged into one per lang and one over all. Texts
that fail the base rules are not in them.

A fence comes from the quartiles of the values above zero and the share z of zeros. On the
logarithmic scale the upper one lies ``reach`` quartile distances above the upper quartile if no value
is zero, at the median if almost all are, and in between in proportion to z: having any of what most
texts have none of is the outlier. The lower fence of metrics with two sides is the mirror image.
Fences of a group lean towards those of its language, and these towards those of all texts, by the
weight of its values against ``lean`` more; a small group has nearly its language's fences. Documents
are then joined with the fences of their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relearn.llm.common import pin, sent_if_small

WORDS = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]"
#: Metrics, and whether too little counts against a text as well.
METRICS = {"symbol_share": False, "dup_line_share": False, "repeat_share": False, "word_length": True}
#: Width of a bin on the logarithmic scale.
BIN = 0.02
SKETCH = ["metric", "bin"]


def repeated_words(words: Column, window: int = 8) -> Column:
    """Number of words that lie in windows of ``window`` words found twice or more in the text."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - window)
    prints = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, window)))

    def covered(marks: Column) -> Column:
        order = F.array_sort(F.transform(marks, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))

        def among(o: Column) -> Column:
            twice = F.filter(
                o,
                lambda x, k: (F.get(o, k - 1)["h"] == x["h"]) & (k > 0) | F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False)),
            )
            places = F.array_sort(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
            step = lambda acc, i: F.struct(
                i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(window))).cast("long").alias("n")
            )
            return F.aggregate(places, start, step, lambda acc: acc["n"])

        # The sorted array is bound once, as the single element of an array, and used many times.
        sums = F.transform(F.array(order), among)
        return F.when(F.size(F.array_distinct(marks)) < F.size(marks), F.get(sums, F.lit(0))).otherwise(F.lit(0).cast("long"))

    bound = F.get(F.transform(F.array(prints), covered), F.lit(0))
    return F.when(n > window, bound).otherwise(F.lit(0).cast("long"))


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row; a null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text")
    )
    words = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORDS))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def line_counts(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    out = rows.select(
        "doc_id", "lang", "source", F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        once(words, counts).alias("w"), once(lines, line_counts).alias("l"),
    )
    return out.select("doc_id", "lang", "source", "n_symbols", "w.*", "l.*")


def with_shares(metrics: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1))
    return metrics.withColumns(
        {
            "symbol_share": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
            "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / n,
            "word_length": F.col("word_chars") / n,
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )


def sketches(metrics: DataFrame) -> DataFrame:
    """lang, source, metric, bin (null: zero), n: histograms of all texts that pass the base rules.

    Counts are pre-aggregated, so a group with a third of all rows is merged, not gathered.
    """
    values = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in METRICS])
    rows = metrics.where("NOT base_failed").select("lang", "source", F.explode(values).alias("v"))
    place = F.when(F.col("v.x") > 0, F.ceil(F.log("v.x") / BIN).cast("int"))
    return rows.groupBy("lang", "source", F.col("v.metric").alias("metric"), place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def level_fences(counts: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """keys, metric, n (values above zero), low and high (logarithms; null without such values)."""
    group = [*keys, "metric"]
    order = Window.partitionBy(*group).orderBy("bin")
    above = F.when(F.col("bin").isNotNull(), F.col("n"))
    ranked = counts.select(*group, "bin", "n", F.sum(above).over(order).alias("upto"), F.sum(above).over(Window.partitionBy(*group)).alias("all"))
    q = lambda p: ((F.min(F.when((F.col("bin").isNotNull()) & (F.col("upto") >= p * F.col("all")), F.col("bin"))) - 0.5) * BIN).alias(f"q{p}")
    zeros = F.coalesce(F.sum(F.when(F.col("bin").isNull(), F.col("n"))), F.lit(0))
    found = ranked.groupBy(*group).agg(q(0.25), q(0.5), q(0.75), F.coalesce(F.max("all"), F.lit(0)).alias("n"), zeros.alias("zeros"))
    low, mid, high = (F.col(f"`q{p}`") for p in (0.25, 0.5, 0.75))
    z, two_sided = F.col("zeros") / (F.col("zeros") + F.col("n")), F.col("metric").isin([c for c, both in METRICS.items() if both])
    upper = (1 - z) * (high + reach * (high - low)) + z * mid
    lower = F.when(two_sided, (1 - z) * (low - reach * (high - low)) + z * mid)
    return found.select(*group, "n", lower.alias("low"), upper.alias("high"))


def fences(metrics: DataFrame, reach: float = 3.0, lean: float = 100.0) -> DataFrame:
    """lang, source (null for null) and fence: per metric n, low and high on the metric's own scale.

    A fence is null where no text of any group has a value above zero.
    """
    parts = pin(sketches(metrics), "sketches")
    own = level_fences(parts, ["lang", "source"], reach)
    merged = lambda *keys: parts.groupBy(*keys, *SKETCH).agg(F.sum("n").alias("n"))
    langs = level_fences(merged("lang"), ["lang"], reach)
    whole = {r.metric: r for r in level_fences(merged(), [], reach).collect()}  # one row a metric

    def leaning(n: Column, mine: Column, parent: Column) -> Column:
        weight = n / (n + lean)
        return F.coalesce(weight * mine + (1 - weight) * parent, mine, parent)

    def constant(side: str) -> Column:
        out = F.lit(None).cast("double")
        for c, r in whole.items():
            out = F.when(F.col("metric") == c, F.lit(r[side])).otherwise(out)
        return out

    wide = langs.select(F.col("lang").alias("of"), "metric", *[leaning(F.col("n"), F.col(x), constant(x)).alias(f"wide_{x}") for x in ("low", "high")])
    o, w = own.alias("o"), wide.alias("w")
    joined = o.join(w, F.col("o.lang").eqNullSafe(F.col("w.of")) & (F.col("o.metric") == F.col("w.metric")), "left")
    limits = joined.select(
        "lang", "source", F.col("o.metric").alias("metric"), "n",
        *[F.exp(leaning(F.col("n"), F.col(f"o.{x}"), F.col(f"wide_{x}"))).alias(x) for x in ("low", "high")],
    )
    fence = F.struct(*[F.max(F.when(F.col("metric") == c, F.struct("n", "low", "high"))).alias(c) for c in METRICS])
    return limits.groupBy("lang", "source").agg(fence.alias("fence"))


def judge_quality(docs: DataFrame, reach: float = 3.0, lean: float = 100.0) -> DataFrame:
    """Counts, shares, base_failed, fences and kept for every row.

    kept is false for failed base rules, else true if every metric lies within its fences; a value on a
    fence is within. Null lang or source is a group of its own. Null and empty texts have no words and
    fail; texts of any length are read whole; repeated rows count as often as they occur. Columns other
    than doc_id, text, lang and source are not read; a table without rows gives no row.
    """
    metrics = pin(with_shares(base_metrics(docs)), "metrics")
    limits = sent_if_small(pin(fences(metrics, reach, lean), "fences"), 100_000)  # some 200 bytes a group
    m, f = metrics.alias("m"), limits.alias("f")
    on = F.col("m.lang").eqNullSafe(F.col("f.lang")) & F.col("m.source").eqNullSafe(F.col("f.source"))
    fine = F.lit(True)
    for c in METRICS:
        x, limit = F.col(f"m.{c}"), F.col(f"f.fence.{c}")
        fine = fine & F.coalesce(x <= limit["high"], F.lit(True)) & F.coalesce(x >= limit["low"], F.lit(True))
    return m.join(f, on, "left").select("m.*", "f.fence", (~F.col("m.base_failed") & fine).alias("kept"))

"""Toxicity score from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, letters that look like Latin ones, digits that stand for
letters, invisible characters. Lexicon entries are whole words or word beginnings with a weight,
learned as smoothed log-odds from a bounded sample of labelled texts and joined with given ones.
Matches inside exception phrases do not count; such phrases are given, and learned as word pairs
around matches of clean texts. The weight sum, alone and relative to the text's length, is turned
into a score by a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relearn.llm.common import map_rows, pin

# Characters read as another letter, and insults with phrases that are none.
LOOKALIKES = str.maketrans(
    "аеорсхуіѕјкмтнвґԁһӏԛԝ" + "αβγεηικμνοπρστυχω" + "ɑɡıłøđħþ" + "01345678@",
    "aeopcxyisjkmthbrdhlqw" + "abyenikuvonpstuxw" + "agilodhp" + "oieasgtba",
    "­​‌‍⁠﻿",
)
#: Signs read as letters beside letters only, so that prices and sentence ends stay as they are.
SIGNS = {"$": "s", "!": "i", "|": "l", "+": "t", "9": "g"}
SEED_WORDS = {"idiot": 3.0, "moron": 3.0, "scum": 3.0, "stupid": 3.0, "loser": 3.0}
EXCEPTIONS = ("pond scum", "soap scum", "stupid question", "sore loser")

WORD = re.compile(r"\w+")


SIGN = re.compile(r"\$(?=[^\W\d_])|(?<=[^\W\d_])[!|+9](?=[^\W\d_])")
MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff]+")


def folded_words(text: str | None) -> list[str]:
    """Words of the folded text: compatible forms and accents first, so that a folded letter never splits a word."""
    if not text:
        return []
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = SIGN.sub(lambda m: SIGNS[m.group()], text.lower().translate(LOOKALIKES))
    return WORD.findall(text)


@dataclass(frozen=True)
class Lexicon:
    """weights: term to weight, a leading space marking word starts and a trailing one word ends."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...] = (-3.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found


def hits(words: list[str], automaton: ahocorasick.Automaton) -> tuple[str, list[tuple[int, int, float]]]:
    """The padded text and its matches (start, end, weight) outside exception phrases."""
    line = f" {' '.join(words)} "
    if not len(automaton):
        return line, []
    found, spared = [], []
    for last, (length, weight) in automaton.iter(line):
        start = last + 1 - length
        (spared.append((start, last)) if weight is None else found.append((start, last + 1, weight)))
    if spared and found:
        joined: list[list[int]] = []  # phrases may overlap: disjoint stretches, in order
        for a, b in sorted(spared):
            if joined and a < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        starts = [a for a, _ in joined]
        before = lambda at: joined[bisect_right(starts, at) - 1] if starts[0] <= at else (0, 0)
        found = [x for x in found if x[0] >= before(x[0])[1]]
    return line, found


def features(words: list[str], automaton: ahocorasick.Automaton) -> tuple[float, float, int]:
    """Weight sum, each word start counted by its heaviest entry, the same per 100 words, both as logs, and how many."""
    best: dict[int, float] = {}
    for start, _, weight in hits(words, automaton)[1]:
        best[start] = max(weight, best.get(start, 0.0))
    total = sum(best.values())
    return float(np.log1p(total)), float(np.log1p(100 * total / max(len(words), 25))), len(best)


def counted(sample: DataFrame, work) -> DataFrame:
    """Sum of toxic and clean document counts of the terms that ``work`` finds in a word list."""

    def count(batch: pa.RecordBatch, tool) -> dict:
        sums = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            sums[toxic].update(work(folded_words(text), tool))
        terms = list(sums[0] | sums[1])
        return {"term": terms, "toxic": [sums[1][t] for t in terms], "clean": [sums[0][t] for t in terms]}

    rows = map_rows(sample, count, "term string, toxic long, clean long", rows=2000, start=getattr(work, "start", lambda: None))
    return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def entries(words: list[str], _=None) -> set[str]:
    """Distinct words of a text, and their beginnings of four to seven letters, as lexicon terms."""
    found = set()
    for w in set(words):
        found.add(f" {w} ")
        for n in range(4, min(8, len(w))):
            found.add(f" {w[:n]}")
    return found


def learn_lexicon(
    labelled: DataFrame, seeds: dict[str, float] | None = None, exceptions: tuple[str, ...] = EXCEPTIONS,
    least: int = 8, odds: float = 3.0,
) -> Lexicon:
    """Lexicon from ``labelled`` (text, toxic 0/1), a sample of bounded size: all terms above the odds.

    Terms of equal weight and count go by length, then by letters. Without toxic or without clean texts, and
    so on an empty sample, only the given words and phrases are known.
    """
    sizes = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    weights = {f" {w} ": x for w, x in (SEED_WORDS if seeds is None else seeds).items()}
    if not bad or not good:
        return Lexicon(weights, exceptions)
    ratio = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    ranked = (
        counted(labelled, entries).where(F.col("toxic") >= least).withColumn("w", ratio).where(F.col("w") >= odds)
    )
    for row in sorted(ranked.collect(), key=lambda r: (len(r.term), r.term)):
        shorter = (row.term[:n] for n in range(5, len(row.term)))
        if not any(row.w <= weights.get(s, -1) + 0.7 for s in shorter):
            weights[row.term] = row.w

    plain = Lexicon(weights, exceptions)

    def around(words: list[str], automaton) -> set[str]:
        line, found = hits(words, automaton)
        out = set()
        for start, _, _ in found:
            end = line.index(" ", start + 1)
            before = line[:start].rsplit(" ", 1)[-1]
            after = line[end + 1 :].split(" ", 1)[0]
            out |= {f"{before}{line[start:end]}"} if before else set()
            out |= {f"{line[start + 1 : end]} {after}"} if after else set()
        return out

    around.start = plain.automaton
    spared = counted(labelled, around).where("clean >= 3 AND toxic = 0").orderBy(F.desc("clean"), "term")
    known = Lexicon(weights, tuple(dict.fromkeys([*exceptions, *(r.term for r in spared.collect())])))

    def measure(batch: pa.RecordBatch, automaton) -> dict:
        pairs = [features(folded_words(t), automaton) for t in batch.column("text").to_pylist()]
        return {"x": [p[0] for p in pairs], "y": [p[1] for p in pairs], "toxic": batch.column("toxic")}

    rows = map_rows(labelled, measure, "x double, y double, toxic int", start=known.automaton).collect()
    return Lexicon(known.weights, known.exceptions, fitted(np.array([[1, r.x, r.y] for r in rows]), np.array([r.toxic for r in rows])))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge on the slopes."""
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, n_hits (matched words), score (0 to 1) for every row.

    Null and empty texts have no hit and the score of none; texts of any length are read whole. Of entries that
    start at one place the heaviest counts. Repeated rows give repeated rows; other columns are not read.
    """

    def work(batch: pa.RecordBatch, automaton) -> dict:
        scores, counts = [], []
        a, b, c = lexicon.curve
        for text in batch.column("text").to_pylist():
            words = folded_words(text)
            x, y, n = features(words, automaton)
            scores.append(float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30)))))
            counts.append(n)
        return {"doc_id": batch.column("doc_id"), "n_hits": counts, "score": scores}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, work, "doc_id long, n_hits long, score double", start=lexicon.automaton)


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = 20_000) -> DataFrame:
    """text and toxic of about ``most`` labelled documents at most, drawn by a hash of doc_id.

    A document with several labels counts as toxic if one says so; rows without doc_id, label or
    text are left out. The sample is written to the shared folder.
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(allowed)
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, most / max(usable.count(), 1))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The drawn ids are bounded by ``most``, so they can be sent to all executors.
    return pin(texts.join(F.broadcast(drawn), "doc_id").where("text IS NOT NULL").select("text", "toxic"), "labelled")

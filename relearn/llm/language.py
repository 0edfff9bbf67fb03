"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is the product of its letters'
vectors, each rotated by its distance from the end; a text is the sum over its trigrams, a language
the sum of the unit vectors of its training texts. Texts get the language with the nearest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relearn.llm.common import map_rows, schema_text, sent_if_small

DIMENSIONS = 1024
CODES = 0x110000
CACHED_TRIGRAMS = 30_000
SLICE = 2048


class Profiles:
    """Vectors of texts; the vectors of up to CACHED_TRIGRAMS trigrams are kept in one array."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.letter = np.frombuffer(bytes(chr(i).isalpha() for i in range(CODES)), dtype=np.uint8).astype(bool)
        self.letters: dict[int, np.ndarray] = {}
        self.vectors = np.empty((CACHED_TRIGRAMS, dimensions), dtype=np.int8)
        self.forget()

    def forget(self) -> None:
        self.codes, self.places = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)  # sorted codes, rows of ``vectors``

    def of_letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng(code).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self.letters[code]

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of the text's letters, each run of other characters being one space, and their counts."""
        if not text:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
        is_letter = self.letter[x]
        if not is_letter.any():
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[0] = True
        x = np.where(is_letter, x, 32)[keep].astype(np.uint64)
        grams = x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:]
        return np.unique(grams, return_counts=True)

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct trigrams, at most SLICE of them."""
        new = grams[~np.isin(grams, self.codes, assume_unique=True)]
        if len(new):
            if len(self.codes) + len(new) > len(self.vectors):
                self.forget()
                new = grams
            mask, n = np.uint64(0x1FFFFF), len(self.codes)
            parts = self.vectors[n : n + len(new)]
            parts[:] = 1
            for turn, shift in enumerate((0, 21, 42)):
                codes, at = np.unique(new >> np.uint64(shift) & mask, return_inverse=True)
                parts *= np.stack([np.roll(self.of_letter(int(c)), turn) for c in codes])[at]
            codes = np.concatenate([self.codes, new])
            order = np.argsort(codes)
            self.codes, self.places = codes[order], np.concatenate([self.places, np.arange(n, n + len(new))])[order]
        return self.vectors[self.places[np.searchsorted(self.codes, grams)]]

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        """One unit vector a text; all zero where it has no letter."""
        found = [self.trigrams(t) for t in texts]
        grams = np.unique(np.concatenate([g for g, _ in found])) if found else np.empty(0, dtype=np.uint64)
        table = np.zeros((len(texts), len(grams)), dtype=np.float32)
        for row, (g, n) in zip(table, found, strict=True):
            row[np.searchsorted(grams, g)] = n
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for at in range(0, len(grams), SLICE):
            out += table[:, at : at + SLICE] @ self.bound(grams[at : at + SLICE]).astype(np.float32)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


#: The profiles that a worker keeps from task to task.
KEPT = {"start": Profiles, "hold": ("profiles",)}


def labelled_rows(docs: DataFrame, allowed: Column, most: int | None) -> DataFrame:
    """lang and text of the ``allowed`` rows; with ``most``, of about so many a language at most, drawn by a hash of doc_id."""
    text = F.col("text").cast("string")
    rows = docs.where(allowed & F.col("lang").isNotNull() & text.isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    if most is None:
        return rows.select("lang", "text")
    shares = rows.groupBy("lang").agg(F.least(F.lit(1_000_000.0), most * 1_000_000.0 / F.count(F.lit(1))).alias("share"))
    drawn = rows.join(sent_if_small(shares, 100_000), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share"))
    return drawn.select("lang", "text")


def learn_prototypes(docs: DataFrame, allowed: Column, most: int | None = None) -> dict[str, np.ndarray]:
    """Unit prototype by language from its ``allowed`` rows; with ``most``, from about so many of them at most.

    Rows without lang or text are not used. Every language with a letter in its texts gets a prototype, 4 KB each;
    the driver holds them all.
    """

    def work(batch: pa.RecordBatch, profiles: Profiles) -> dict:
        vectors = profiles.of_texts(batch.column("text").to_pylist())
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        names = sorted(set(langs))
        return {
            "lang": names,
            "sums": [vectors[langs == x].sum(axis=0).tolist() for x in names],
        }

    sums = map_rows(labelled_rows(docs, allowed, most), work, "lang string, sums array<float>", rows=128, **KEPT)
    totals = (
        sums.select("lang", F.posexplode("sums").alias("at", "x"))
        .groupBy("lang", "at")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
    )  # one row of DIMENSIONS numbers a language
    out = {}
    for row in totals.collect():
        v = np.array([p.x for p in row.xs], dtype=np.float32)
        if np.linalg.norm(v):
            out[row.lang] = v / np.linalg.norm(v)
    return out


def identify_language(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """All columns of ``docs``' key and text replaced by doc_id, lang_pred, score (cosine, 0 to 1).

    Texts that are null, empty or without a letter get ``und`` and 0, and so does every text if
    nothing was learned. Ties go to the first language by name.
    """
    names = sorted(prototypes)
    table = np.stack([prototypes[x] for x in names]) if names else np.zeros((0, DIMENSIONS), dtype=np.float32)

    def work(batch: pa.RecordBatch, profiles: Profiles) -> dict:
        vectors = profiles.of_texts(batch.column("text").to_pylist())
        none = ~vectors.any(axis=1)
        if not names:
            none[:] = True
        cos = vectors @ table.T if names else np.zeros((len(none), 1))
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(best)), best], 0, 1).astype(float)
        return {
            "doc_id": batch.column("doc_id"),
            "lang_pred": ["und" if u else names[i] for u, i in zip(none, best, strict=True)],
            "score": np.where(none, 0.0, score).tolist(),
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, work, "doc_id long, lang_pred string, score double", rows=64, **KEPT)


def score_floors(docs: DataFrame, allowed: Column, prototypes: dict[str, np.ndarray], most: int | None = None, low: float = 0.001) -> dict[str, float]:
    """Least cosine by language that counts as that language, from the ``allowed`` texts, with ``most`` a sample of them.

    Half of the ``low`` quantile of the scores of a language's own texts, as unseen texts score less than
    learned ones; never within 3.5 standard deviations of what unrelated vectors reach by chance.
    """
    rows = labelled_rows(docs, allowed, most).select(F.lit(0).cast("long").alias("doc_id"), "lang", "text")
    names = sorted(prototypes)
    table = np.stack([prototypes[x] for x in names]) if names else np.zeros((0, DIMENSIONS), dtype=np.float32)

    def work(batch: pa.RecordBatch, profiles: Profiles) -> dict:
        vectors, at = profiles.of_texts(batch.column("text").to_pylist()), {x: i for i, x in enumerate(names)}
        own = [(x, float(v @ table[at[x]])) for x, v in zip(batch.column("lang").to_pylist(), vectors, strict=True) if x in at and v.any()]
        return {"lang": [x for x, _ in own], "score": [x for _, x in own]}

    scores = map_rows(rows.select("lang", "text"), work, "lang string, score double", rows=64, **KEPT)
    # Scores of four places are at most 10,001 a language, however many texts.
    counts = scores.groupBy("lang", F.round("score", 4).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("lang").agg(F.percentile("score", low, F.col("n")).alias("low")).collect()  # one number a language
    chance = 3.5 / np.sqrt(DIMENSIONS)
    return {x: chance for x in names} | {r.lang: max(0.5 * r.low, chance) for r in found}


def in_known_language(docs: DataFrame, prototypes: dict[str, np.ndarray], floors: dict[str, float]) -> DataFrame:
    """The rows of ``docs`` whose text has a language: a letter, and the cosine its nearest language asks for; same columns.

    Null and empty texts go; texts of any length are read whole; repeated rows stay or go together.
    """
    names = sorted(prototypes)
    table = np.stack([prototypes[x] for x in names]) if names else np.zeros((1, DIMENSIONS), dtype=np.float32)
    least = np.array([floors[x] for x in names] or [2.0])

    def work(batch: pa.RecordBatch, profiles: Profiles) -> dict:
        cos = profiles.of_texts(batch.column("text").to_pylist()) @ table.T
        best = cos.argmax(axis=1)
        kept = batch.filter(pa.array(cos[np.arange(len(best)), best] >= least[best]))
        return {name: kept.column(name) for name in kept.schema.names}

    return map_rows(docs, work, schema_text(docs), rows=64, **KEPT)

"""Benchmark decontamination: BM25 index of test items, block-max WAND, question and answer overlap.

An item's impacts are divided by the most that a run of its words as long as a passage can score
(the whole item, if it is no longer), so a passage's score is the share it covers of what it can
cover. Passages overlap by half, so one of them holds half of the best run of an item copied at any
place, however long the item. Items lie in the index by that score, so that blocks hold items of
like impacts. Every training text is cut into overlapping passages of words; each is a query.
Bounds by block of items rule out most passages for whole blocks at once; the rest go through
block-max WAND, which returns all items at or above the threshold. Hits are verified by overlap of
word trigrams with the item's question and of words with its answer, both within the passages that
were hit and as many neighbours as the item is long: an answer scattered elsewhere in a long text is
none. The index is a handful of flat arrays and one dictionary of words; indexes are made, sent and
given up one after the other.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relearn.llm.common import map_rows, pin, schema_text

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Text of test items in one broadcast index (of some eight times the size); more items make more indexes, run one after the other.
INDEX_BYTES = 32_000_000
# Odd multipliers of the trigram hash.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def item_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words of an item's last sentence (the answer) and of what precedes it; one sentence alone is cut at three quarters."""
    parts = [w for w in (item_words(x) for x in re.split(r"(?<=[.?!])\s+|\n+", text or "")) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = max(1, 3 * len(words) // 4)
    return words[:cut], words[cut:] or words[-1:]


def best_run(words: list[str], weights: dict[str, float], size: int) -> float:
    """Largest sum of the weights of the distinct words in any ``size`` neighbouring words."""
    if len(words) <= size:
        return sum(weights.values())
    inside, new, gone = Counter(words[:size]), [], []
    for k in range(size, len(words)):
        inside[words[k]] += 1
        new.append(weights[words[k]] if inside[words[k]] == 1 else 0.0)
        inside[words[k - size]] -= 1
        gone.append(0.0 if inside[words[k - size]] else weights[words[k - size]])
    return sum(weights[w] for w in set(words[:size])) + max(0.0, float(np.max(np.cumsum(np.array(new) - np.array(gone)))))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` (1 to 3) term numbers."""
    x = ids.astype(np.uint64)
    for _ in range(n - 1):
        x = (x[:-1] * ODD[0]) ^ (x[1:] + ODD[1])
    return x


def flat(parts: list[np.ndarray], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """One array after the other, and where each starts."""
    start = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in parts], out=start[1:])
    return np.concatenate(parts).astype(kind) if parts else np.empty(0, dtype=kind), start


class Index:
    """Items (id, text) with global document frequencies; ``block`` postings share one bound, ``size`` is a passage's words.

    Postings of term t are ``items`` and ``impacts`` from ``start[t]`` to ``start[t + 1]``, by item; their blocks lie
    from ``block_start[t]`` on. ``bound`` holds each term's largest impact by range of ``width`` items.
    """

    def __init__(
        self, items: list[tuple[int, str]], df: dict[str, int], n: int, average: float, block: int = 16, ranges: int = 48, size: int = 128
    ):
        rows = []
        for at, (_, text) in enumerate(items):
            words = item_words(text)
            if words:
                rows.append((best_run(words, self.raw(words, df, n, average), size), items[at][0], at))
        rows.sort(key=lambda r: (r[0], r[1]))
        self.ids = np.array([r[1] for r in rows], dtype=np.int64)
        self.term: dict[str, int] = {}
        number = lambda ws: np.array([self.term.setdefault(w, len(self.term)) for w in ws], dtype=np.int64)
        terms, impacts, questions, answers, self.gram, self.length = [], [], [], [], [], []
        for total, _, at in rows:
            text = items[at][1]
            words = item_words(text)
            raw = self.raw(words, df, n, average)
            terms.append(number(raw))
            impacts.append(np.array(list(raw.values())) / total)
            question, answer = question_answer(text)
            self.gram.append(min(3, len(question)))
            self.length.append(len(words))
            questions.append(np.unique(grams(number(question), self.gram[-1])))
            answers.append(np.unique(number(answer)))
        self.question, self.question_start = flat(questions, np.uint64)
        self.answer, self.answer_start = flat(answers, np.int64)
        own, _ = flat(terms, np.int64)
        place = np.repeat(np.arange(len(rows)), [len(t) for t in terms])
        order = np.argsort(own, kind="stable")
        own, self.items = own[order], place[order].astype(np.int32)
        self.impacts = flat(impacts, np.float64)[0][order]
        self.start = np.searchsorted(own, np.arange(len(self.term) + 1))
        counts = np.diff(self.start)
        self.block, blocks = block, -(-counts // block)
        self.block_start = np.concatenate([[0], np.cumsum(blocks)])
        first = np.repeat(self.start[:-1], blocks) + block * (np.arange(self.block_start[-1]) - np.repeat(self.block_start[:-1], blocks))
        last = np.minimum(first + block, np.repeat(self.start[1:], blocks)) - 1
        self.block_last = self.items[last]
        self.block_most = np.maximum.reduceat(self.impacts, first) if len(first) else np.empty(0)
        self.most = np.maximum.reduceat(self.impacts, self.start[:-1]) if len(own) else np.empty(0)
        self.width = max(1, -(-len(rows) // ranges))
        self.bound = np.zeros((len(self.term), -(-len(rows) // self.width) if rows else 0), dtype=np.float32)
        np.maximum.at(self.bound, (own, self.items // self.width), np.nextafter(self.impacts.astype(np.float32), np.float32(2)))

    @staticmethod
    def raw(words: list[str], df: dict[str, int], n: int, average: float) -> dict[str, float]:
        """BM25 impact of each distinct word of an item."""
        norm = K1 * (1 - B + B * len(words) / max(average, 1))
        return {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in Counter(words).items()}


def block_max_wand(index: Index, terms: list[int], threshold: float, start: int = 0, end: int | None = None) -> list[tuple[int, float]]:
    """All items in [start, end) whose score for the distinct ``terms`` is at least ``threshold``."""
    end = len(index.ids) if end is None else end
    slack = threshold - 1e-9
    items, impacts, most = memoryview(index.items), memoryview(index.impacts), memoryview(index.most)
    ends, block_last, block_most, block_start = memoryview(index.start), memoryview(index.block_last), memoryview(index.block_most), memoryview(index.block_start)
    cursors = []  # [item, place, term]
    for t in terms:
        at = bisect_left(items, start, ends[t], ends[t + 1])
        if at < ends[t + 1] and items[at] < end:
            cursors.append([items[at], at, t])
    found = []

    def move(cursor: list, to: int) -> None:
        last = ends[cursor[2] + 1]
        at = bisect_left(items, to, cursor[1], last)
        cursor[0], cursor[1] = (items[at] if at < last else end), at

    while True:
        cursors = sorted((c for c in cursors if c[0] < end), key=lambda c: c[0])
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += most[c[2]]
            if total >= slack:
                pivot = k
                break
        if pivot < 0:
            return found
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        # Block bounds of the lists up to the pivot, and where the nearest of those blocks ends.
        bound, after = 0.0, end
        for c in cursors[: pivot + 1]:
            b = bisect_left(block_last, item, block_start[c[2]], block_start[c[2] + 1])
            if b < block_start[c[2] + 1]:
                bound += block_most[b]
                after = min(after, block_last[b] + 1)
        if bound < slack:
            if pivot + 1 < len(cursors):
                after = min(after, cursors[pivot + 1][0])
            for c in cursors[: pivot + 1]:
                move(c, max(after, item + 1))
        elif cursors[0][0] == item:
            score = sum(impacts[c[1]] for c in cursors[: pivot + 1])
            if score >= slack:
                found.append((item, score))
            for c in cursors[: pivot + 1]:
                move(c, item + 1)
        else:
            for c in cursors[:pivot]:
                if c[0] < item:
                    move(c, item)


def matches(index: Index, ids: np.ndarray, half: int, threshold: float) -> dict[int, list[tuple[int, float]]]:
    """(passage, score) of each item's hits; passage p is the chunks p and p + 1 of ``half`` words."""
    chunk = np.arange(len(ids)) // half
    known = ids >= 0
    n_terms = max(len(index.term), 1)
    keys = np.unique(chunk[known] * n_terms + ids[known])
    chunks, terms = keys // n_terms, keys % n_terms
    n = int(chunk[-1]) + 1 if len(chunk) else 0
    sums = np.zeros((n, index.bound.shape[1]), dtype=np.float32)
    if len(keys):
        first = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]])
        sums[chunks[first]] = np.add.reduceat(index.bound[terms], first, axis=0)
    pair = sums[:-1] + sums[1:] if n > 1 else sums
    out: dict[int, list[tuple[int, float]]] = {}
    for at in np.flatnonzero(pair.max(axis=1) >= threshold - 1e-4).tolist() if len(pair) else ():
        own = np.unique(terms[(chunks == at) | (chunks == at + 1)])
        ranges = np.flatnonzero(index.bound[own].sum(axis=0) >= threshold - 1e-4)
        if not len(ranges):
            continue
        own = own.tolist()
        for r in ranges.tolist():
            for item, score in block_max_wand(index, own, threshold, r * index.width, (r + 1) * index.width):
                out.setdefault(item, []).append((at, min(score, 1.0)))  # scattered words of a long item can weigh more than any run
    return out


def verified(index: Index, item: int, ids: np.ndarray, passages: list[int], half: int) -> tuple[float, float]:
    """Largest question and answer overlap around any run of neighbouring passages that were hit."""
    reach = -(-index.length[item] // half)
    q = index.question[index.question_start[item] : index.question_start[item + 1]]
    a = index.answer[index.answer_start[item] : index.answer_start[item + 1]]
    runs: list[list[int]] = []
    for at in sorted(passages):
        if runs and at - runs[-1][1] <= 2 * reach + 2:
            runs[-1][1] = at
        else:
            runs.append([at, at])
    best = (0.0, 0.0)
    for first, last in runs:
        near = ids[max(0, (first - reach) * half) : (last + 2 + reach) * half]
        found = (float(np.isin(q, grams(near, index.gram[item])).mean()), float(np.isin(a, near).mean()))
        best = max(best, found, key=lambda x: (min(x), sum(x)))
    return best


def text_hits(index: Index, text: str | None, half: int, threshold: float, question: float, answer: float) -> list[tuple]:
    """(item id, score, passages, question overlap, answer overlap) of the verified items of one text."""
    words = item_words(text)
    if not words or not len(index.ids):
        return []
    ids = np.array(list(map(lambda w, get=index.term.get: get(w, -1), words)), dtype=np.int64)
    out = []
    for item, hits in sorted(matches(index, ids, half, threshold).items()):
        q, a = verified(index, item, ids, [at for at, _ in hits], half)
        if q >= question and a >= answer:
            out.append((int(index.ids[item]), max(s for _, s in hits), len(hits), q, a))
    return out


def benchmark_indexes(benchmark: DataFrame, index_bytes: int = INDEX_BYTES, half: int = 64) -> Iterator[Index]:
    """Indexes that together hold all items, each of bounded size and made when asked for, with frequencies over the whole benchmark.

    Rows without item_id or without words are no items; of rows with one id each is an item.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL")
    totals = items.agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    if not totals.n:
        return
    shards = max(1, -(-totals.size // index_bytes))

    def work(batch: pa.RecordBatch) -> dict:
        words = [item_words(t) for t in batch.column("text").to_pylist()]
        return {"word": [w for ws in words for w in set(ws)], "length": [len(ws) for ws in words for _ in set(ws)]}

    words = map_rows(items, work, "word string, length long")
    df = pin(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    lengths = map_rows(items, lambda b: {"n": [len(item_words(t)) for t in b.column("text").to_pylist()]}, "n long")
    average = float(lengths.agg(F.avg("n")).first()[0] or 1)
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard)
        own = map_rows(part, work, "word string, length long").select("word").distinct().join(df, "word")
        frequencies = {r.word: r.df for r in own.collect()}
        yield Index([(r.item_id, r.text) for r in part.collect()], frequencies, totals.n, average, size=2 * half)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question: float = 0.5, answer: float = 0.5,
    half: int = 64, index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """doc_id, item_id, score, n_passages, question_overlap, answer_overlap of every verified hit.

    Items and texts may have any length. Texts that are null, empty or without words have no hit; an empty benchmark gives no row.
    Repeated rows give repeated hits; items of equal text are all reported. Other columns of either table are not read.
    """
    schema = "doc_id long, item_id long, score double, n_passages long, question_overlap double, answer_overlap double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, out = docs.sparkSession, None
    for index in benchmark_indexes(benchmark, index_bytes, half):
        sent = spark.sparkContext.broadcast(index)  # of at most index_bytes of item texts
        del index

        def work(batch: pa.RecordBatch, index: Index) -> dict:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            hits = [(i, *h) for i, t in zip(ids, texts, strict=True) for h in text_hits(index, t, half, threshold, question, answer)]
            names = ("doc_id", "item_id", "score", "n_passages", "question_overlap", "answer_overlap")
            return {name: [h[k] for h in hits] for k, name in enumerate(names)}

        part = pin(map_rows(rows, work, schema, start=lambda sent=sent: sent.value), "leaks")
        sent.unpersist()
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question: float = 0.5, answer: float = 0.5,
    half: int = 64, index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """The rows of ``docs`` without a verified hit; same columns. Cases as in :func:`find_leaks`."""
    schema = schema_text(docs)
    for index in benchmark_indexes(benchmark, index_bytes, half):
        sent = docs.sparkSession.sparkContext.broadcast(index)  # of at most index_bytes of item texts
        del index

        def work(batch: pa.RecordBatch, index: Index) -> dict:
            texts = batch.column("text").to_pylist()
            kept = batch.filter(pa.array([not text_hits(index, t, half, threshold, question, answer) for t in texts], type=pa.bool_()))
            return {name: kept.column(name) for name in kept.schema.names}

        docs = pin(map_rows(docs, work, schema, start=lambda sent=sent: sent.value), "clean")
        sent.unpersist()
    return docs

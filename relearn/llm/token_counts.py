"""Token counts that follow edits: segment trees over pre-tokens, re-encoding only what edits touch.

A text is cut into pre-tokens by the tokenizer's pattern; a leaf of its tree holds a run of them with
its characters, pre-tokens and tokens, and inner nodes hold sums. An edit is found by descending on
characters. The pattern is run again from the leaf that holds the characters shortly before the
edit, as far as a leaf boundary behind it falls on a pre-token boundary again: from there on
the text is cut as before. Only those leaves get new counts, and their sums are updated.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relearn.llm.common import map_rows, schema_text

# Fixed value: the pre-token pattern that the byte-level vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters behind a pre-token that may decide where it ends (contractions, white space).
LOOKAHEAD = 3
LEAF = 64
CACHED_PRETOKENS = 500_000


class Counter:
    """Token counts of pre-tokens, kept while there are at most CACHED_PRETOKENS."""

    def __init__(self, ranks: str) -> None:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def counts(self, pretokens: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHED_PRETOKENS:
            known.clear()
        new = [p for p in dict.fromkeys(pretokens) if p not in known]
        for p in new:
            known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in pretokens]


class Tree:
    """Sums of characters, pre-tokens and tokens over leaves; node i has the children 2i and 2i + 1."""

    def __init__(self, leaves: np.ndarray) -> None:
        """``leaves``: one row of (characters, pre-tokens, tokens) each."""
        self.count = max(len(leaves), 1)
        self.size = 1 << (self.count - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 3), dtype=np.int64)
        self.sums[self.size : self.size + len(leaves)] = leaves
        for i in range(self.size.bit_length() - 1, 0, -1):
            lo = 1 << (i - 1)
            self.sums[lo : 2 * lo] = self.sums[2 * lo : 4 * lo].reshape(lo, 2, 3).sum(axis=1)

    @property
    def leaves(self) -> np.ndarray:
        return self.sums[self.size : self.size + self.count]

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last leaf, and where that leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if char - start >= self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        leaf = min(node - self.size, self.count - 1)
        return leaf, start if leaf == node - self.size else int(self.sums[1, 0] - self.leaves[leaf, 0])

    def put(self, leaf: int, row: tuple[int, int, int]) -> None:
        node = self.size + leaf
        change = np.array(row) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def cut(pretokens: list[str], counts: list[int], leaf: int) -> np.ndarray:
    """Leaf rows of a run of pre-tokens."""
    if not pretokens:
        return np.zeros((0, 3), dtype=np.int64)
    at = np.arange(0, len(pretokens), leaf)
    chars = np.add.reduceat(np.array([len(p) for p in pretokens]), at)
    return np.stack([chars, np.diff(np.r_[at, len(pretokens)]), np.add.reduceat(np.array(counts), at)], axis=1)


def build(text: str, counter: Counter, leaf: int = LEAF) -> Tree:
    pretokens = counter.pattern.findall(text)
    return Tree(cut(pretokens, counter.counts(pretokens), leaf))


def edited(text: str, tree: Tree, at: int, gone: int, put: str, counter: Counter, leaf: int = LEAF) -> tuple[str, Tree, int]:
    """Text and tree after one edit, and how many pre-tokens were encoded again."""
    new, shift = text[:at] + put + text[at + gone :], len(put) - gone
    first, start = tree.find(max(at - LOOKAHEAD, 0))
    last, begin = tree.find(at + gone)
    ends = {}  # leaf boundaries behind the edit, in the new text
    boundary = begin
    if boundary >= at + gone:
        ends[boundary + shift] = last
    found: list[str] = []
    stop, place = tree.count, start
    for m in counter.pattern.finditer(new, start):
        if place >= at + len(put):
            while last < tree.count and boundary + shift < place:
                boundary += int(tree.leaves[last, 0])
                last += 1
                ends[boundary + shift] = last
            if place in ends:
                stop = ends[place]
                break
        found.append(m[0])
        place = m.end()
    rows = cut(found, counter.counts(found), leaf)
    slots = stop - first
    if len(rows) > slots or not slots:
        tree = Tree(np.concatenate([tree.leaves[:first], rows, tree.leaves[stop:]]))
    else:
        for k in range(slots):
            tree.put(first + k, tuple(rows[k]) if k < len(rows) else (0, 0, 0))
    return new, tree, len(found)


def packed(tree: Tree) -> list[dict]:
    return [dict(zip(("chars", "pretokens", "tokens"), map(int, row), strict=True)) for row in tree.leaves if row.any()]


LEAVES = "array<struct<chars:int,pretokens:int,tokens:int>>"


def token_trees(docs: DataFrame, ranks: str, leaf: int = LEAF) -> DataFrame:
    """``docs`` with the leaves of each text's tree and n_tokens; same rows, its own columns first.

    A null or empty text has no leaf and no token. A column of ``docs`` named leaves or n_tokens is
    replaced. ``ranks`` is a vocabulary file that all executors can read.
    """
    kept = docs.drop("leaves", "n_tokens")
    schema = schema_text(kept)

    def work(batch: pa.RecordBatch, counter: Counter) -> dict:
        trees = [build(t or "", counter, leaf) for t in batch.column("text").to_pylist()]
        out = {name: batch.column(name) for name in batch.schema.names}
        return out | {"leaves": [packed(t) for t in trees], "n_tokens": [int(t.sums[1, 2]) for t in trees]}

    return map_rows(kept, work, f"{schema}, leaves {LEAVES}, n_tokens long", rows=256, start=lambda: Counter(ranks), hold=("counter", ranks))


def apply_edits(rows: DataFrame, ranks: str, leaf: int = LEAF) -> DataFrame:
    """Token counts after the edits of each row, from its tree.

    ``rows``: doc_id, text, leaves (see ``token_trees``), edits (array of structs at, gone, put, in
    code points of the stored text). Edits are applied from the last to the first; one that overlaps
    an edit behind it, or has a null or negative place, is skipped; places behind the end mean
    the end. Returns doc_id, n_tokens_before, n_tokens, n_pretokens, n_reencoded (pre-tokens), n_applied,
    n_skipped and the new leaves. Null and empty texts are empty; they can grow by edits.
    """

    def work(batch: pa.RecordBatch, counter: Counter) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_tokens_before", "n_tokens", "n_pretokens", "n_reencoded", "n_applied", "n_skipped", "leaves")}
        for text, leaves, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "leaves", "edits")), strict=True):
            text = text or ""
            tree = Tree(np.array([[x["chars"], x["pretokens"], x["tokens"]] for x in leaves or []], dtype=np.int64).reshape(-1, 3))
            before, again, applied, skipped, limit = int(tree.sums[1, 2]), 0, 0, 0, len(text)
            valid = [e for e in edits or [] if e and e["at"] is not None and e["at"] >= 0 and (e["gone"] or 0) >= 0]
            skipped += len(edits or []) - len(valid)
            for e in sorted(valid, key=lambda e: (e["at"], e["gone"] or 0, e["put"] or ""), reverse=True):
                at = min(e["at"], len(text)) if not applied else e["at"]
                gone = min(e["gone"] or 0, max(limit - at, 0)) if not applied else e["gone"] or 0
                if at + gone > limit:
                    skipped += 1
                    continue
                text, tree, n = edited(text, tree, at, gone, e["put"] or "", counter, leaf)
                again, applied, limit = again + n, applied + 1, at
            row = (before, int(tree.sums[1, 2]), int(tree.sums[1, 1]), again, applied, skipped, packed(tree))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"doc_id": batch.column("doc_id")} | out

    wanted = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("leaves").cast(LEAVES).alias("leaves"),
        F.col("edits").cast("array<struct<at:long,gone:long,put:string>>").alias("edits"),
    )
    schema = f"doc_id long, n_tokens_before long, n_tokens long, n_pretokens long, n_reencoded long, n_applied long, n_skipped long, leaves {LEAVES}"
    return map_rows(wanted, work, schema, rows=256, start=lambda: Counter(ranks), hold=("counter", ranks))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with an edits column from a table doc_id, at, gone, put; documents without edits get an empty one.

    A document's edits are a bounded part of that document: they cannot overlap and be applied.
    """
    per = edits.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.struct(F.col("at").cast("long").alias("at"), F.col("gone").cast("long").alias("gone"), "put")).alias("_edits")
    )
    none = F.array().cast("array<struct<at:long,gone:long,put:string>>")
    joined = docs.drop("edits").join(per, F.col("doc_id") == F.col("_id"), "left")
    return joined.withColumn("edits", F.coalesce("_edits", none)).drop("_id", "_edits")

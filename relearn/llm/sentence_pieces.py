"""Sampled SentencePiece segmentations by Gumbel top-k without replacement, and decoding.

A text's lattice has the model's pieces as edges; an edge's weight follows Zipf's law over the
piece's merge rank. Backward sums over the lattice give each edge its conditional probability, which
is also an exact bound for a best-first search: the perturbed value of a partial segmentation is the
largest perturbed value of all its completions. A segmentation is completed by following the largest
child; the other children, perturbed below their parent, wait in a queue, and the best of them is
completed next. So the k completed ones are the k largest of all segmentations, drawn without
replacement. Pieces do not cross word starts or line ends, so lattices are kept per word and walked
for all words of a batch at once.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relearn.llm.common import map_rows

UNIT = re.compile(r"\n| *[^ \n]+| +")
#: Edges of word lattices that a worker keeps, at 16 bytes and about as much again for the words. Beyond them,
#: words that came up again since the last time stay, if they hold at most three quarters of these edges.
CACHED_EDGES = 2_200_000
# Constants of the splitmix64 generator.
GAMMA, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
TURNS = np.arange(1, 4097, dtype=np.uint64) * GAMMA


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class Pieces:
    """A model's pieces with spaces for word starts, Zipf weights to the power ``alpha``, and byte pieces."""

    def __init__(self, path: str, alpha: float = 0.5) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        norm = math.log(sum(1 / (r + 10) for r in range(n)))
        self.weight: dict[str, tuple[int, float]] = {}
        self.byte: dict[int, int] = {}
        self.text: list[bytes] = [b""] * n
        self.low = alpha * (-math.log(n + 10) - norm)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                self.text[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                rank = min(max(-model.get_score(i), 0.0), n)
                self.weight[text] = (i, alpha * (-math.log(rank + 10) - norm))
                self.text[i] = text.encode()
        self.trie()
        self.kind = np.dtype("<u2" if n <= 65536 else "<u4")
        self.flat = np.frombuffer(b"".join(self.text), dtype=np.uint8)
        self.size = np.array([len(x) for x in self.text], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def trie(self) -> None:
        """States are piece beginnings: ``root`` leads from a first letter, ``follow`` from (state, letter) to the next.

        The second is a table with open addressing, so that many steps are looked up at once.
        """
        states = {p[:k] for p in self.weight for k in range(1, len(p) + 1)}
        number = {x: i for i, x in enumerate(sorted(states))}
        self.root = np.full(0x110000, -1, dtype=np.int32)
        steps = []
        for x, i in number.items():
            if len(x) == 1:
                self.root[ord(x)] = i
            else:
                steps.append((number[x[:-1]] << 21 | ord(x[-1]), i))
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.targets = np.zeros(1 << self.bits, dtype=np.int64)
        keys, targets = (np.array(x, dtype=np.int64) for x in (zip(*steps, strict=True) if steps else ((), ())))
        spot = self.spots(keys)
        while len(keys):  # the first key of each free spot is placed, the others move on
            free = self.keys[spot] == -1
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(spot, return_index=True)[1]] = True
            placed = free & first
            self.keys[spot[placed]], self.targets[spot[placed]] = keys[placed], targets[placed]
            keys, targets, spot = keys[~placed], targets[~placed], spot[~placed]
            spot = np.where(self.keys[spot] == -1, spot, (spot + 1) & (len(self.keys) - 1))
        self.state_piece = np.array([self.weight.get(x, (-1, 0.0))[0] for x in number], dtype=np.int64)
        self.state_weight = np.array([self.weight.get(x, (-1, 0.0))[1] for x in number])

    def spots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * GAMMA >> np.uint64(64 - self.bits)).astype(np.int64)

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """Next state of each (state << 21 | letter), -1 if there is none."""
        out, left, spot = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), self.spots(keys)
        while len(left):
            there = self.keys[spot]
            same = there == keys[left]
            out[left[same]] = self.targets[spot[same]]
            on = ~same & (there != -1)
            left, spot = left[on], (spot[on] + 1) & (len(self.keys) - 1)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of piece ids; the space that encoding puts in front is dropped."""
        size = self.size[ids]
        spot = np.repeat(self.start[ids] - np.cumsum(size) + size, size)
        spot += np.arange(len(spot))
        return self.flat[spot].tobytes().decode("utf-8", "replace")[1:]


class Grown:
    """A numpy array that grows at its end, by an eighth, so that little of it is empty."""

    def __init__(self, kind: type) -> None:
        self.data, self.n = np.empty(1 << 16, dtype=kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(len(self.data) // 8, len(more)), dtype=self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)

    def replace(self, values: np.ndarray) -> None:
        self.data, self.n = values.astype(self.data.dtype, copy=False), len(values)


class Lattices:
    """Word lattices in flat arrays: node -> edges, edge -> next node (-1: end of word), piece, log probability."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.next, self.piece = Grown(np.int32), Grown(np.int32), Grown(np.int32)
        self.log, self.sum = Grown(np.float32), Grown(np.float32)  # sum: of a node's probabilities up to the edge
        self.first.add(np.zeros(1, dtype=np.int32))
        self.again = Grown(bool)  # by node: the word that starts there came up after it was added

    def thin_out(self) -> None:
        """Forget the words that have not come up again since the last call, or all if that leaves too many edges."""
        kept = [(at, unit) for unit, at in self.known.items() if self.again.data[at]]
        lengths = np.array([len(unit) for _, unit in kept], dtype=np.int32)
        starts = np.array([at for at, _ in kept], dtype=np.int32)
        after = np.cumsum(lengths, dtype=np.int32)
        nodes = np.repeat(starts - after + lengths, lengths) + np.arange(lengths.sum(), dtype=np.int32)
        first = self.first.data[nodes]
        width = self.first.data[nodes + 1] - first
        if not kept or width.sum() > CACHED_EDGES * 3 // 4:
            return self.forget()
        ends = np.cumsum(width, dtype=np.int32)
        edges = np.repeat(first - ends + width, width) + np.arange(ends[-1], dtype=np.int32)
        place = np.zeros(self.first.n, dtype=np.int32)
        place[nodes] = np.arange(len(nodes), dtype=np.int32)
        nexts = self.next.data[edges]
        self.next.replace(np.where(nexts >= 0, place[nexts], np.int32(-1)))
        for column in (self.piece, self.log, self.sum):  # one after the other, so that one copy is made at a time
            column.replace(column.data[edges])
        self.first.replace(np.concatenate([np.zeros(1, dtype=np.int32), ends]))
        self.again.replace(np.zeros(len(nodes), dtype=bool))
        self.known = {unit: at for (_, unit), at in zip(kept, (after - lengths).tolist(), strict=True)}

    def add(self, units: list[str]) -> None:
        """Lattices of new words, all at once."""
        p = self.pieces
        letters = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        lengths = np.array([len(u) for u in units])
        ends = np.cumsum(lengths)
        end = np.repeat(ends, lengths)
        at, n = np.arange(len(letters)), 1
        state = p.root[letters].astype(np.int64)
        single = np.zeros(len(letters), dtype=bool)
        found = []  # of each length: start, length, piece and weight of its edges
        at, state = at[state >= 0], state[state >= 0]
        while len(at):
            piece = p.state_piece[state]
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], n, piece[hit], p.state_weight[state[hit]]))
            if n == 1:
                single[at[hit]] = True
            more = np.flatnonzero(at + n < end[at])
            at = at[more]
            state = p.follow(state[more] << 21 | letters[at + n])
            more = np.flatnonzero(state >= 0)
            at, state = at[more], state[more]
            n += 1
        bare = np.flatnonzero(~single)
        code = letters[bare]
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        as_byte = np.array([p.byte[c] if c < 0x80 else -c for c in code.tolist()], dtype=np.int64)
        found.insert(1, (bare, 1, as_byte, p.low * size))
        # Edges in order of their start, the longest first: each start occurs once among those of a length.
        counts = np.zeros(len(letters), dtype=np.int64)
        for part in found:
            counts[part[0]] += 1
        cursor = np.cumsum(counts) - counts
        total = int(counts.sum())
        n, piece, weight = np.empty(total, dtype=np.int32), np.empty(total, dtype=np.int32), np.empty(total)
        for part in reversed(found):
            spot = cursor[part[0]]
            n[spot], piece[spot], weight[spot] = part[1:]
            cursor[part[0]] = spot + 1
        at = np.repeat(np.arange(len(letters), dtype=np.int32), counts)
        left = np.repeat(end - np.arange(len(letters)), counts)
        # Backward sums, nodes with fewest letters left first.
        back = np.zeros(len(letters) + 1)
        last = n == left
        target = at + n
        target[last] = len(letters)
        by_left = np.argsort(left.astype(np.uint16) if left.max() < 65536 else left, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(left[by_left]) > 0, True])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            e = by_left[lo:hi]
            value, node = weight[e] + back[target[e]], at[e]
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            top = np.maximum.reduceat(value, start)
            spread = np.exp(value - np.repeat(top, np.diff(np.r_[start, len(e)])))
            back[node[start]] = top + np.log(np.add.reduceat(spread, start))
        log = np.minimum(weight + back[target] - np.repeat(back[:-1], counts), 0.0)
        base, edges = self.first.n - 1, self.next.n
        after = np.cumsum(counts)
        self.first.add(edges + after)
        self.again.add(np.zeros(len(letters), dtype=bool))
        self.next.add(np.where(last, -1, base + target))
        self.piece.add(piece)
        self.log.add(log)
        sums = np.cumsum(np.exp(log))
        sums -= np.repeat(np.r_[0.0, sums[after[:-1] - 1]], counts)
        sums[after - 1] = 2.0  # the last edge takes whatever is left
        self.sum.add(sums)
        for unit, start in zip(units, (base + ends - lengths).tolist(), strict=True):
            self.known[unit] = start

    def starts(self, texts: list[str]) -> list[np.ndarray]:
        """Start nodes of the words of each text."""
        if self.next.n > CACHED_EDGES:
            self.thin_out()
        split = [UNIT.findall(f" {t}") for t in texts]
        get, old = self.known.get, self.first.n - 1
        nodes = [list(map(get, units)) for units in split]
        lacking = [(own, units, [i for i, at in enumerate(own) if at is None]) for own, units in zip(nodes, split, strict=True) if None in own]
        if lacking:
            self.add(list({units[i] for _, units, places in lacking for i in places}))
            for own, units, places in lacking:
                for i in places:
                    own[i] = self.known[units[i]]
        out = [np.array(own, dtype=np.int64) for own in nodes]
        for own in out:
            self.again.data[own[own < old]] = True
        return out


def walk(lattices: Lattices, nodes: np.ndarray, row: np.ndarray, seeds: np.ndarray, early: np.ndarray):
    """Follow the largest child from each start node to the end of its word, all words in step.

    ``row``: place of the word in its text, ``seeds``: one number per word. The perturbed log
    probability of an edge is -log(x / p) with x exponential. Which edge is the largest is a draw by
    p, and as x has no memory, the others' x / p lie above the smallest by fresh x / p. Returns the
    edges followed in order, the place of each word's first one, and for ``early`` words the other
    edges: word, step, edge and how far x / p lies above the smallest.
    """
    first, nexts, sums, logs = lattices.first.data, lattices.next.data, lattices.sum.data, lattices.log.data
    salt = mixed(seeds + row.astype(np.uint64) * GAMMA)
    word, node, step, taken, others = np.arange(len(nodes)), nodes, 0, [], []
    while len(word):
        x = mixed(salt[word] + TURNS[step % 4096] + np.uint64(step))
        u = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
        edge = first[node].astype(np.int64)
        late = np.flatnonzero(sums[edge] <= u)
        while len(late):
            edge[late] += 1
            late = late[sums[edge[late]] <= u[late]]
        taken.append((word, np.full(len(word), step), edge))
        mine = np.flatnonzero(early[word])
        if len(mine):
            lo = first[node[mine]].astype(np.int64)
            n = first[node[mine] + 1] - lo
            own = np.repeat(mine, n)
            place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            each = np.repeat(lo, n) + place
            rest = each != edge[own]
            own, place, each = own[rest], place[rest], each[rest]
            y = mixed(x[own] + (place + 1).astype(np.uint64) * MIX_B)
            gap = -np.log(((y >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * np.exp(-logs[each].astype(np.float64))
            others.append((word[own], np.full(len(own), step), each, gap))
        node = nexts[edge].astype(np.int64)
        word, node = word[node >= 0], node[node >= 0]
        step += 1
    words, steps, edges = (np.concatenate(x) for x in zip(*taken, strict=True))
    counts = np.bincount(words, minlength=len(nodes))
    begin = np.cumsum(counts) - counts
    path = np.empty(len(edges), dtype=np.int64)
    path[begin[words] + steps] = edges
    if not others:
        return path, begin, [np.empty(0, dtype=np.int64)] * 3 + [np.empty(0)]
    return path, begin, [np.concatenate(x) for x in zip(*others, strict=True)]


#: Words at the start of what a search walks whose other edges are looked at first; see Search.close.
EARLY = 160
#: No perturbed value lies further above its own log probability: the smallest draw is 2**-53, about exp(-36.7).
REACH = 37.0


class Search:
    """The best-first search of one text."""

    def __init__(self, starts: np.ndarray, seed: int) -> None:
        self.starts, self.seed = starts, seed
        self.queue: list[tuple] = []
        self.done: list[tuple[float, float, np.ndarray]] = []  # perturbed, log probability, edges
        none = np.empty(0, dtype=np.int64)
        u = ((seed * 0x2545F4914F6CDD1D + 1 & 0xFFFFFFFFFFFFFFFF) >> 11) + 0.5
        self.open = (-math.log(-math.log(u * 2.0**-53)), 0.0, none, 0, int(starts[0]))

    def task(self) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and rows of what is left to walk of the opened entry."""
        _, _, _, row, node = self.open
        nodes, rows = self.starts[row:].copy(), np.arange(row, len(self.starts))
        if node < 0:
            return nodes[1:], rows[1:]
        nodes[0] = node
        return nodes, rows

    def salt(self, number: int) -> int:
        return (self.seed + (number + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF

    def close(self, lattices: Lattices, path: np.ndarray, begin: np.ndarray, rows: np.ndarray, others: list[np.ndarray], keep: int, seen: int) -> bool:
        """Take the walked edges as a segmentation and queue the best children that were not followed.

        ``others`` has those of the first ``seen`` words. False, with nothing done, if later words
        could hold one of the best ``keep``.
        """
        g, phi, prefix, _, _ = self.open
        nexts, logs = lattices.next.data, lattices.log.data
        own = logs[path].astype(np.float64)
        word, step, edge, gap = others
        base = phi + np.cumsum(own[: begin[seen] if seen < len(begin) else len(own)])
        spot = begin[word] + step
        before = np.where(spot > 0, base[spot - 1], phi) if len(spot) else np.empty(0)
        # Perturbed value of a child given that the largest is g: -log(exp(-g) + exp(-before) * gap).
        # It rises with the second term, so only children near its smallest values, and those that g swallows, are ranked.
        above = np.log(np.maximum(gap, 1e-300)) - before
        if len(above) > keep:
            near = np.flatnonzero(above <= max(np.partition(above, keep - 1)[keep - 1], -g - 10) + 1e-3)
        else:
            near = np.arange(len(above))
        minus = np.logaddexp(-g, above[near])
        best = np.argsort(minus, kind="stable")[:keep]
        order, minus = near[best], minus[best]
        if seen < len(begin) and (len(order) < keep or base[-1] > -minus[-1] - REACH):
            return False
        self.done.append((g, phi + float(own.sum()), np.concatenate([prefix, path]) if len(prefix) else path))
        for o, value in zip(order.tolist(), minus.tolist(), strict=True):
            entry = (float(before[o] + logs[edge[o]]), np.concatenate([prefix, path[: spot[o]], edge[o : o + 1]]), int(rows[word[o]]), int(nexts[edge[o]]))
            heapq.heappush(self.queue, (value, len(self.done), o, entry))
        return True

    def next(self) -> bool:
        if not self.queue:
            return False
        minus, _, _, entry = heapq.heappop(self.queue)
        self.open = (-minus, *entry)
        return True


def sample_texts(lattices: Lattices, texts: list[str], seeds: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its k sampled segmentations: piece ids, log probability, perturbed value, inclusion score."""
    starts = lattices.starts(texts)
    searches = [Search(a, s) if t else None for a, t, s in zip(starts, texts, seeds, strict=True)]
    active, none = [s for s in searches if s], np.empty(0, dtype=np.int64)
    for number in range(k):
        tasks = [(s, *s.task()) for s in active]
        sizes = [len(t[1]) for t in tasks]
        ends = np.cumsum([0, *sizes])
        path, begin, others = none, none, [none] * 4
        if ends[-1]:
            salts = np.repeat(np.array([s.salt(number) for s in active], dtype=np.uint64), sizes)
            rank = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
            path, begin, others = walk(lattices, np.concatenate([t[1] for t in tasks]), np.concatenate([t[2] for t in tasks]), salts, rank < EARLY)
            order = np.argsort(others[0], kind="stable")
            others = [x[order] for x in others]
        cuts = np.searchsorted(others[0], ends)
        edges = np.append(begin, len(path))[ends]
        for t, (s, nodes, rows) in enumerate(tasks):
            own = [x[cuts[t] : cuts[t + 1]] for x in others]
            own[0] = own[0] - ends[t]
            part, first = path[edges[t] : edges[t + 1]], begin[ends[t] : ends[t + 1]] - edges[t]
            seen = min(EARLY, len(rows))
            while not s.close(lattices, part, first, rows, own, k, seen):
                seen = min(4 * seen, len(rows))  # draws depend on word and step only, so they come out as before
                salts = np.full(seen, s.salt(number), dtype=np.uint64)
                own = walk(lattices, nodes[:seen], rows[:seen], salts, np.ones(seen, dtype=bool))[2]
        if number < k - 1:
            active = [s for s in active if s.next()]
    ids, byte = lattices.piece.data, lattices.pieces.byte
    out = []
    for s in searches:
        samples = []
        bar = -s.queue[0][0] if s and s.queue and len(s.done) == k else -math.inf
        for g, total, path in s.done if s else []:
            pieces = ids[path].astype(np.int64)
            if len(pieces) and pieces.min() < 0:
                pieces = np.array([i for p in pieces.tolist() for i in ([p] if p >= 0 else [byte[b] for b in chr(-p).encode()])], dtype=np.int64)
            inclusion = 1.0 if bar == -math.inf else -math.expm1(-math.exp(min(total - bar, 700)))
            samples.append((pieces, total, g, inclusion))
        out.append(samples)
    return out


def encode_samples(docs: DataFrame, model: str, k: int = 2, seed: int = 0, alpha: float = 0.5, batch_chars: int = 300_000) -> DataFrame:
    """k distinct sampled segmentations of every text, one row each.

    doc_id, sample (0 has the largest perturbed value), n_pieces, log_prob, perturbed, inclusion (chance
    of being among the k, given the best one left out), pieces (ids, little-endian, two bytes each for
    models of up to 65,536 pieces, else four) and round_trip (the ids decode to the text). Draws
    depend on doc_id and ``seed`` only, so a repeated row gets the same ones; a null doc_id counts as
    0. A null or empty text has one sample without pieces; texts with fewer than k segmentations
    have them all, with inclusion 1. ``model`` must be readable by all executors.
    """

    def work(rows: pa.RecordBatch, lattices: Lattices) -> dict:
        ids, texts = rows.column("doc_id").to_pylist(), [t or "" for t in rows.column("text").to_pylist()]
        keys = mixed(np.array([(i or 0) & 0xFFFFFFFFFFFFFFFF for i in ids], dtype=np.uint64) + np.uint64(seed) * MIX_A + GAMMA)
        out: dict[str, list] = {c: [] for c in ("doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "pieces", "round_trip")}
        # Texts are walked together up to a number of characters; a longer one goes alone.
        group = np.cumsum([len(t) for t in texts]) // batch_chars
        cuts = np.flatnonzero(np.r_[True, np.diff(group) > 0, True])
        sampled = (
            x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in sample_texts(lattices, texts[a:b], keys[a:b].tolist(), k)
        )
        for doc, text, samples in zip(ids, texts, sampled, strict=True):
            for number, (pieces, total, g, inclusion) in enumerate(samples or [(np.empty(0, dtype=np.int64), 0.0, 0.0, 1.0)]):
                same = lattices.pieces.decode(pieces) == text
                packed = pieces.astype(lattices.pieces.kind).tobytes()
                for c, v in zip(out, (doc, number, len(pieces), total, g, inclusion, packed, same), strict=True):
                    out[c].append(v)
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, pieces binary, round_trip boolean"
    return map_rows(rows, work, schema, rows=256, start=lambda: Lattices(Pieces(model, alpha)), hold=("lattices", model, alpha))


def decode_pieces(samples: DataFrame, model: str) -> DataFrame:
    """doc_id, sample and text of packed piece ids; null pieces give a null text."""

    def work(rows: pa.RecordBatch, pieces: Pieces) -> dict:
        packed = rows.column("pieces").to_pylist()
        texts = [None if p is None else pieces.decode(np.frombuffer(p, dtype=pieces.kind)) for p in packed]
        return {"doc_id": rows.column("doc_id"), "sample": rows.column("sample"), "text": texts}

    return map_rows(samples.select("doc_id", "sample", "pieces"), work, "doc_id long, sample int, text string", start=lambda: Pieces(model), hold=("pieces", model))

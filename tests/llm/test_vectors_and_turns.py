"""Conversation repair, exact top-k and bit-plane clusters against loops over everything."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from relearn.llm import bit_clusters, catalog, conversations, vector_search

TURNS = "conv_id long, turn long, role string, text string, place string, again boolean"


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", True) for r in rows], TURNS)


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(conversations.WHITE)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def legal(roles):
    pairs = roles[1:] if roles[:1] == "s" else roles
    return not roles or (len(pairs) >= 2 and pairs == "ua" * (len(pairs) // 2))


def slow_repair(rows):
    """Every choice of edits, with every small insertion at every place."""
    faults, best = faults_of(rows), None
    options = []
    for (_, role, text), fault in zip(rows, faults, strict=True):
        own = [(4, "D", "", None)]
        if fault not in ("b", "d"):
            extra = 3 * (fault == "t")
            own += [(extra, "K", role[:1] or "?", f"{role}:{text}"), (3 + extra, "R", "u", f"user:{text}"), (3 + extra, "R", "a", f"assistant:{text}")]
        options.append(own)
    inserts = [(3 * len(x), "I" * len(x), x, [f"{conversations.ROLES[c]}:" for c in x]) for x in ("", "u", "a", "ua", "au")]
    for choice in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, roles, lines = 0, "", "", []
            for gap, edit in itertools.zip_longest(gaps, choice):
                cost, audit, roles, lines = cost + gap[0], audit + gap[1], roles + gap[2], lines + gap[3]
                if edit:
                    cost, audit, roles = cost + edit[0], audit + edit[1], roles + edit[2]
                    lines = lines + ([edit[3]] if edit[3] is not None else [])
            if legal(roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def plain_viterbi(rows):
    """All turns, whole edit texts per state: no tree, no pruning, insertions one by one."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    now = {"": (0, "", ())}

    def put(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def widen(states):
        for _ in range(4):
            for state, (cost, audit, lines) in list(states.items()):
                for c in "ua":
                    if (state, c) in step:
                        put(states, step[state, c], (cost + 3, audit + "I", (*lines, f"{conversations.ROLES[c]}:")))
        return states

    for (_, role, text), fault in zip(rows, faults_of(rows), strict=True):
        after = {}
        for state, (cost, audit, lines) in widen(now).items():
            put(after, state, (cost + 4, audit + "D", lines))
            if fault not in ("b", "d"):
                extra = 3 * (fault == "t")
                for c, price, letter, said in ((role[:1], 0, "K", role), ("u", 3, "R", "user"), ("a", 3, "R", "assistant")):
                    if (state, c) in step:
                        put(after, step[state, c], (cost + price + extra, audit + letter, (*lines, f"{said}:{text}")))
        now = after
    return min(v for k, v in widen(now).items() if k in ("", "a"))


def random_turns(rng, n):
    roles = ["user", "assistant", "system", "tool", ""]
    texts = ["Yes.", "No", "Why?", " ", "", "a\tb!\n", "x", "Ja."]
    return [(rng.choice([None, *range(n)]), rng.choices(roles, [4, 4, 2, 1, 0.3])[0], rng.choice(texts) + rng.choice(["", "", f"{rng.randint(0, 5)}."])) for _ in range(n)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def run_local(rows):
    edits = []
    own = conversations.Conversation(lambda *x: edits.append(x))
    seen = {}
    for turn, role, text in rows:
        own.take(turn, role, text, seen.get((role, text), turn) != turn)
        seen.setdefault((role, text), turn)
    return own.summary(), edits


def test_repair_against_every_choice():
    rng = random.Random(3)
    for _ in range(60):
        rows = in_order(random_turns(rng, rng.randint(0, 3)))
        cost, audit, lines = slow_repair(rows)
        found, edits = run_local(rows)
        assert found[5:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), rows
        assert [f"{r}:{t}" for _, e, r, t in edits if e != "D"] == lines
        assert plain_viterbi(rows) == (cost, audit, tuple(lines))


def test_repair_of_long_conversations_and_bounded_tail():
    rng = random.Random(4)
    for n in (7, 30, 200):
        for _ in range(30):
            rows = in_order(random_turns(rng, n))
            cost, audit, lines = plain_viterbi(rows)
            assert run_local(rows)[0][5:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    # Clean pairs settle at once; a run of forced deletions is one node a survivor.
    left = []
    own = conversations.Repair(lambda *x: left.append(x))
    for k in range(1000):
        own.turn("user" if k % 2 == 0 else "assistant", f"{k}.", False, 0)
        assert k - sum(x[3] for x in left) <= 8
    for _ in range(5000):
        own.turn("user", "", True, 0)
    for _, tip in own.survivors.values():
        depth = 0
        while tip is not own.root:
            tip, depth = tip.parent, depth + 1
        assert depth <= 6


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        text_of = lambda x: " " if x is None else str(x)
        role, text = text_of(role), text_of(text)
        fault = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def slow_audit(rows):
    out = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows}
    groups = {}
    for r in slow_damage(rows):
        groups.setdefault(r[0], []).append(r[1:])
    for conv, own in groups.items():
        own = in_order(own)
        known = {t for t, *_ in own if t is not None}
        faults, roles = faults_of(own), [r[1][:1] for r in own]
        cost, audit, lines = plain_viterbi(own)
        out[conv] = (
            max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(x) for x in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def audited(spark, rows, monkeypatch, folder=None):
    monkeypatch.setattr(catalog, "table", lambda *_: turns_frame(spark, rows))
    return {r[0]: tuple(r)[1:] for r in catalog.op11_conversation_repair(spark, "").collect()}


def test_op11_against_loops(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3]) if c > 20 else c, *r) for c in range(60) for r in random_turns(rng, rng.randint(1, 12))]
    rows += [(5, 3, None, None), (6, None, "user", None), (7, 1, "user", "word " * 30_000), (None, None, None, None)]
    rows += rows[:40]
    assert audited(spark, rows, monkeypatch) == slow_audit(rows)
    assert audited(spark, [], monkeypatch) == {}


def test_op11_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = catalog.op11_conversation_repair(spark, DATA)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == slow_audit(rows)


def test_repaired_turns_are_whole(spark):
    rows = [(1, 0, "user", "Hi."), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "More."), (2, 0, "tool", "x."), (None, None, None, None)]
    found = conversations.repaired_turns(turns_frame(spark, rows)).orderBy("conv_id", "place").collect()
    lines = [(r.conv_id, r.edit, r.role, r.text) for r in found]
    assert lines == [(None, "D", None, None), (1, "K", "user", "Hi."), (1, "K", "assistant", "Yes."), (1, "I", "user", ""), (1, "K", "assistant", "More."), (2, "D", None, None)]


VECTORS = "vec_id long, embedding array<float>, label int, score double, cluster string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, "x") for i, v in rows], VECTORS)


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def scaled(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def slow_top(rows, k=10):
    good = [(i, scaled(v, 1024)) for i, v in rows if i is not None and sound(v)]
    out = []
    for q, a in good:
        if q % 100 == 0:
            scores = [(sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q]
            scores = sorted(((min(max(s, 1 - 2**63), 2**63 - 1), i) for s, i in scores), key=lambda x: (-x[0], x[1]))[:k]
            out += [(q, n, i, s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile_bytes", [40_000, 32_000_000])
def test_top_k_against_loops(spark, tile_bytes):
    rng = random.Random(6)
    near = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in near[i % 5]]) for i in range(900)]
    rows += [(i, rows[0][1]) for i in range(900, 1300)]  # one vector many times: ties
    rows += [(1300, [0.5] * 7), (1301, []), (1400, [1e30] * 64), (1401, [-1e30] + [1e20] * 63), (1402, [65536.0] * 64), (1500, [0.0] * 64), (1600, [])]
    rows += [(1700, None), (1800, [None] * 64), (1900, [float("nan")] * 64), (2000, [float("inf")] * 64), (None, [0.1] * 64), (3, rows[3][1]), (100, rows[100][1])]
    found = vector_search.top_inner_products(vector_frame(spark, rows), F.col("vec_id") % 100 == 0, tile_bytes=tile_bytes)
    assert sorted(map(tuple, found.collect())) == slow_top(rows)


def test_top_k_edges(spark):
    search = lambda rows: list(map(tuple, vector_search.top_inner_products(vector_frame(spark, rows), F.col("vec_id") % 100 == 0).collect()))
    assert search([]) == [] and search([(100, [1.0])]) == [] and search([(1, [1.0]), (2, [1.0])]) == []
    assert sorted(search([(100, [1.0]), (2, [0.5]), (1, [0.5])])) == [(100, 1, 1, 1024 * 512), (100, 2, 2, 1024 * 512)]


def slow_clusters(rows, k=16, rounds=3):
    good = [(i, scaled(v, 64)) for i, v in rows if sound(v) and len(v) == 64]
    good = [(i, [min(max(x, -bit_clusters.MOST), bit_clusters.MOST) for x in v]) for i, v in good]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    centroids = [v for _, v in sorted(good, key=key)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in good:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    last = [(i, *reversed(nearest(v))) for i, v in good]
    inertia = lambda c: min(sum(d for _, n, d in last if c is None or n == c), 2**63 - 1)
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    whole, own = inertia(None), {c: (inertia(c), digest(c)) for c in {n for _, n, _ in last}}
    return sorted(((i, c, d, own[c][0], whole, own[c][1]) for i, c, d in last), key=lambda r: (r[0] is None, r))


def clusters_of(spark, rows):
    found = bit_clusters.cluster_vectors(vector_frame(spark, rows))
    return sorted(map(tuple, found.collect()), key=lambda r: (r[0] is None, r))


def test_clusters_against_loops(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss((i % 4) / 10, 0.3) for _ in range(64)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 450)] + rows[:20]  # one vector many times, repeated rows
    rows += [(500, None), (501, []), (502, [0.1] * 63), (503, [None] * 64), (504, [float("nan")] * 64), (505, [float("-inf")] + [0.0] * 63), (None, [0.2] * 64)]
    assert clusters_of(spark, rows) == slow_clusters(rows)


def test_clusters_edges(spark):
    assert clusters_of(spark, []) == []
    few = [(i, [float(i)] * 64) for i in range(5)]
    assert clusters_of(spark, few) == slow_clusters(few)
    wide = [(i, [float(i - 20)] * 63 + [1e30 if i % 7 == 0 else -3e7]) for i in range(40)]
    assert clusters_of(spark, wide) == slow_clusters(wide)


def test_bit_planes():
    rng = np.random.default_rng(8)
    for low, high in ((-1, 0), (0, 1), (-64, 63), (-(2**27), 2**27), (0, 0)):
        v = rng.integers(low, high, size=(50, 64), endpoint=True)
        stack = bit_clusters.to_planes(v, bit_clusters.planes_for(low, high))
        assert (bit_clusters.from_planes(stack) == v).all()
        assert (bit_clusters.dots(stack, stack[:7]) == v @ v[:7].T).all()

"""Conversation structure repair: a Viterbi search over edits that settles them while it reads.

A repaired conversation has the role initials ``(s?(ua)+)?``. Four states tell what may come next:
nothing emitted, a system turn emitted, a user turn open, a pair closed. Every state keeps one
survivor, the cheapest way to reach it, ties by the edits' initials as text. Survivors are tips of a
tree of backpointers; a node counts the survivors and children that hold it, and goes when nobody
does. As soon as all survivors descend from one node, everything up to it is settled and handed out,
so only the unsettled tail is kept. A survivor that cannot win any more is dropped: whatever may
follow it, another one can follow for less. Two survivors of equal cost are compared by all their
unsettled edits, back to the node where they part. Neither text can begin the other, since the
longer one would hold more insertions and cost more, so the order never turns later.

Turns reach a task sorted, conversation by conversation, and pass through; no conversation is
gathered. Turns seen before are found in Spark by key, so no task remembers a conversation's texts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from relearn.llm.common import pin, sent_if_small

WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, PAIR = range(4)
#: Per state and emitted initial: turns to insert before it, and the state reached.
MOVES = {
    START: {"s": ("", SYSTEM), "u": ("", USER), "a": ("u", PAIR)},
    SYSTEM: {"u": ("", USER), "a": ("u", PAIR)},
    USER: {"a": ("", PAIR), "u": ("a", USER)},
    PAIR: {"u": ("", USER), "a": ("u", PAIR)},
}
#: Turns to insert at the end.
ENDS = {START: "", SYSTEM: "ua", USER: "a", PAIR: ""}
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 3, 4, 3, 3
#: What it costs at most to go on from the first state as from the second, by inserting, or by deleting the system turn that only START keeps.
DETOUR = {
    (START, SYSTEM): 0, (START, USER): INSERT, (START, PAIR): 0,
    (SYSTEM, START): 2 * INSERT, (SYSTEM, USER): INSERT, (SYSTEM, PAIR): 2 * INSERT,
    (USER, START): INSERT + DELETE, (USER, SYSTEM): INSERT, (USER, PAIR): INSERT,
    (PAIR, START): DELETE, (PAIR, SYSTEM): 0, (PAIR, USER): INSERT,
}
ROLES = {"u": "user", "a": "assistant"}


class Edit:
    """A node of the backpointer tree: ``times`` equal edits, what they leave, and how many hold the node."""

    __slots__ = ("parent", "letter", "role", "text", "times", "level", "refs")

    def __init__(self, parent: Edit | None, letter: str, role: str | None = None, text: str | None = None) -> None:
        self.parent, self.letter, self.role, self.text, self.times, self.refs = parent, letter, role, text, 1, 0
        self.level = parent.level + 1 if parent else 0
        if parent:
            parent.refs += 1


def parted(a: Edit, b: Edit) -> tuple[str, str]:
    """The edits of two nodes after the last one they share."""
    left, right = [], []
    while a is not b:
        if a.level >= b.level:
            left.append(a)
            a = a.parent
        else:
            right.append(b)
            b = b.parent
    return tuple("".join(n.letter * n.times for n in reversed(x)) for x in (left, right))


class Repair:
    """The search over one conversation; ``emit(letter, role, text, times)`` gets settled edits in order."""

    def __init__(self, emit: Callable) -> None:
        self.emit, self.root = emit, Edit(None, "")
        self.root.refs = 1
        self.survivors: dict[int, tuple[int, Edit]] = {START: (0, self.root)}

    def let_go(self, node: Edit) -> None:
        node.refs -= 1
        while not node.refs and node.parent:
            node = node.parent
            node.refs -= 1

    def turn(self, role: str, text: str, delete: bool, extra: int) -> None:
        """Take one turn; ``delete`` forces its deletion, ``extra`` is the price of leaving it."""
        best: dict[int, tuple[int, Edit, str, str]] = {}
        initial = role[:1]

        def offer(state: int, cost: int, tip: Edit, letters: str, roles: str) -> None:
            now = best.get(state)
            if now and cost == now[0]:
                new, old = parted(tip, now[1])
                better = new + letters < old + now[2]
            else:
                better = not now or cost < now[0]
            if better:
                best[state] = cost, tip, letters, roles

        for state, (cost, tip) in self.survivors.items():
            offer(state, cost + DELETE, tip, "D", "")
            if not delete:
                for into, (inserts, target) in MOVES[state].items():
                    if into == initial or into in ROLES:
                        price = (0 if into == initial else REROLE) + INSERT * len(inserts) + extra
                        offer(target, cost + price, tip, "I" * len(inserts) + ("K" if into == initial else "R"), inserts + into)
        for a, (cost, *_) in list(best.items()):
            for b in list(best):
                if a != b and a in best and cost + DETOUR[a, b] < best[b][0]:
                    del best[b]
        used, after = Counter(id(x[1]) for x in best.values()), {}
        for state, (cost, tip, letters, roles) in best.items():
            if letters == "D":
                if tip.letter == "D" and tip.refs == 1 and used[id(tip)] == 1 and tip is not self.root:
                    tip.times += 1
                    node = tip
                else:
                    node = Edit(tip, "D")
            else:
                node = tip
                for into in roles[:-1]:
                    node = Edit(node, "I", ROLES[into], "")
                kept = letters[-1] == "K"
                node = Edit(node, letters[-1], role if kept else ROLES[roles[-1]], text)
            node.refs += 1
            after[state] = cost, node
        for _, tip in self.survivors.values():
            self.let_go(tip)
        self.survivors = after
        self.settle()

    def settle(self) -> None:
        """Hand out what all survivors share: the path below the root as long as it does not fork."""
        if self.root.refs == 1:
            tip, path = next(iter(self.survivors.values()))[1], []
            node = tip
            while node is not self.root:
                path.append(node)
                node = node.parent
            while path and self.root.refs == 1:
                self.root = path.pop()
                self.emit(self.root.letter, self.root.role, self.root.text, self.root.times)
                self.root.parent = self.root.text = None

    def end(self) -> int:
        """Settle the rest; the cost of all edits."""
        won: tuple[int, Edit, str] | None = None
        for state, (cost, tip) in self.survivors.items():
            cost += INSERT * len(ENDS[state])
            if won and cost == won[0]:
                new, old = parted(tip, won[1])
                better = new + "I" * len(ENDS[state]) < old + "I" * len(won[2])
            else:
                better = not won or cost < won[0]
            if better:
                won = cost, tip, ENDS[state]
        node, path = won[1], []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.letter, node.role, node.text, node.times)
        for into in won[2]:
            self.emit("I", ROLES[into], "", 1)
        return won[0]


class Conversation:
    """One conversation as it passes: faults, gaps, edits, digest; ``row`` gets repaired turns if given."""

    def __init__(self, row: Callable | None) -> None:
        self.row, self.place = row, 0
        self.repair = Repair(self.settled)
        self.audit, self.digest, self.begun = [], hashlib.sha256(), False
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: tuple | None = None

    def settled(self, letter: str, role: str | None, text: str | None, times: int) -> None:
        self.audit.append(letter * times)
        if letter != "D":
            self.digest.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.begun = True
        if self.row:
            for _ in repeat(None, times):
                self.row(self.place, letter, role, text)
                self.place += 1

    def take(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        body = text.rstrip(WHITE)
        blank = not body
        duplicate = not blank and (again or self.before == (turn, role, text))
        truncated = not blank and not duplicate and body[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if self.before and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = turn, role, text
        self.repair.turn(role, text, blank or duplicate, LEFT_TRUNCATED * truncated)

    def summary(self) -> tuple:
        cost = self.repair.end()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest()


ROW_TYPES = "place long, edit string, role string, text string"
SUMMARY_TYPES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, again (role and text occur in an earlier turn), sorted within conversations."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))

    def keyed(df: DataFrame) -> DataFrame:
        conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
        parts = [x for c in (conv, F.col("role")) for x in (F.length(c).cast("string"), F.lit(":"), c)]
        return df.withColumn("key", F.unhex(F.md5(F.concat(*parts, F.col("text")))))

    # Keys of equal turns at different places of a conversation, with the first place; equal turns at one place lie side by side.
    groups = keyed(rows).groupBy("key").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("turn").alias("known"), F.count(F.lit(1)).alias("n"))
    spread = groups.where("n > 1 AND (first < last OR known > 0 AND known < n)")
    spread = pin(spread.select("key", F.when(F.col("known") == F.col("n"), F.col("first")).alias("first"), F.lit(True).alias("met")), "repeats")
    again = F.col("met").isNotNull() & F.coalesce(F.col("turn") > F.col("first"), F.col("turn").isNotNull())
    marked = keyed(rows).join(sent_if_small(spread), "key", "left")
    marked = marked.select("conv_id", "turn", "role", "text", again.alias("again"))
    return marked.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def passed(turns: DataFrame, rows: bool) -> DataFrame:
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = ROW_TYPES if rows else SUMMARY_TYPES
    schema = f"conv_id {kind}, {schema}"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, size, conv = None, 0, None

        def row(*values) -> None:
            nonlocal size
            out.append((now, *values))
            size += len(values[-1] or "")

        def flush() -> pa.RecordBatch:
            nonlocal size
            columns = zip(*out, strict=True) if out else [[]] * len(fields)
            made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for f, c in zip(fields, columns, strict=True)], schema=fields)
            out.clear()
            size = 0
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, *turn in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "again")), strict=True):
                    if conv is None or key != now:
                        if conv:
                            closed = conv.summary()
                            if not rows:
                                out.append((now, *closed))
                        now, conv = key, Conversation(row if rows else None)
                    conv.take(*turn)
                    if len(out) >= 2000 or size > 4_000_000:
                        yield flush()
        if conv:
            closed = conv.summary()
            if not rows:
                out.append((now, *closed))
        yield flush()

    return ordered_turns(turns).mapInArrow(run, schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place, edit (Keep, Rerole, Delete, Insert by initial), role and text of every edit, in order of ``place``.

    Deleted turns have neither role nor text; the others are the repaired conversation. Null roles and
    texts count as one space, null turns come first, turns of one number are ordered by role and text.
    A null conv_id is a conversation of its own. A role keeps its place by its first letter; one that is
    none of s, u, a is given a role or deleted. Very long texts pass through whole. Repeated rows are
    duplicates; an empty table gives none. Other columns are not read.
    """
    return passed(turns, True)


def audited_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit (initials of the cheapest edits) and
    repaired_sha256 (of ``role:text`` lines). Cases as in :func:`repaired_turns`."""
    return passed(turns, False)


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Turns with a planted fault by crc32 of ``conv_id:turn`` modulo 20: 0 dropped, 1 emptied, 2 without ``.!?``, 3 repeated, 4 said by the user."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text: Column = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")

"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans are certain by their shape. Weak parts (identifiers, secrets, endpoints) are reported only
when a complementary part lies within the same scope: parts become intervals and are joined by
buckets of the scope's width, so a part meets only its neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relearn.llm.common import pin, sent_if_small

# Kinds in the order in which spans of one start are listed, with their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a greedy run of 24 or more is a run's whole match
WEAK = {
    "identifier": r"""(?i)\b(?:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9_.@-]{3,}""",
    "secret": r"[A-Za-z0-9+/_-]{32,}={0,2}",  # a greedy run; one without a digit or a capital letter is dropped
    "endpoint": r"""\b(?:https?|s3|ftp|amqp|redis|mysql|postgres(?:ql)?|mongodb)://[^\s"'<>]{4,}""",
}
KINDS = ["assign", "access", "hex", *WEAK]
#: What each kind is a part of a credential.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}


def spans(text: Column, pattern: str, kind: str, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as structs (start, rank, kind, end, match) in code points.

    The pieces between matches and the matches alternate, so running lengths give the places.
    """
    gate = text.rlike(pattern) if gate is None else gate
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["piece"])
        end = at + F.length(x["m"])
        item = F.array(F.struct(at.alias("start"), end.alias("end"), x["m"].alias("m")))
        return F.struct(end.alias("at"), F.concat(acc["out"], item).alias("out"))

    pairs = F.transform(found, lambda m, i: F.struct(F.get(pieces, i).alias("piece"), m.alias("m")))
    places = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    rank = KINDS.index(kind)
    full = F.transform(
        places,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["m"].alias("m")
        ),
    )
    return F.when(gate, full).otherwise(F.array().cast("array<struct<start:long,rank:int,kind:string,end:long,m:string>>"))


def base_spans(text: Column) -> Column:
    """Spans of the three certain kinds, by start, then kind."""
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    assign = F.filter(spans(text, ASSIGN, "assign"), lambda x: F.length(value(x["m"])) >= 6)
    access = F.filter(spans(text, ACCESS, "access", text.contains("AKIA")), lambda x: F.length(x["m"]) >= 20)
    return F.array_sort(F.concat(assign, access, spans(text, HEX, "hex")))


def weak_spans(text: Column) -> Column:
    found = {kind: spans(text, pattern, kind) for kind, pattern in WEAK.items()}
    found["secret"] = F.filter(found["secret"], lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Z]"))
    return F.concat(*found.values())


def listed(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def linked_parts(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts with a complementary part at most ``scope`` characters away.

    ``parts``: doc_id, print, start, end, kind, rank, m. Each part lies in the bucket of its start
    and asks the buckets its reach covers; an end far off is asked for in its own bucket too.
    """
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    rows = parts.withColumn("role", role[F.col("kind")])
    key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "print"]
    into = lambda x: F.floor(x / scope)
    asked = rows.where(F.col("kind").isin(list(WEAK))).select(
        *key, "doc_id", "start", "end", "rank", "kind", "role", "m",
        F.explode(F.sequence(into(F.col("start") - scope), into(F.col("end") + scope))).alias("bucket"),
    )
    near = rows.select(
        *key, F.col("start").alias("s"), F.col("end").alias("e"), F.col("role").alias("other"),
        F.explode(F.sequence(into(F.col("start")), into(F.col("end")))).alias("bucket"),
    )
    on = ["id", "no_id", "print", "bucket"]
    close = (F.col("role") != F.col("other")) & (F.col("s") - F.col("end") <= scope) & (F.col("start") - F.col("e") <= scope)
    left, right = asked.alias("l"), near.alias("r")
    met = left.join(right, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on] + [close], "left_semi")
    return met.select("id", "no_id", "print", "start", "end", "rank", "kind", "m").distinct()


NONE = "array<struct<start:long,rank:int,kind:string,end:long,m:string>>"


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, print (of the text), base and weak spans of every row, written to the shared folder."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    spans_of = rows.select("doc_id", text_print("text").alias("print"), base_spans(F.col("text")).alias("base"), weak_spans(F.col("text")).alias("weak"))
    return pin(spans_of, "spans")


def text_print(text: Column | str) -> Column:
    return F.struct(F.xxhash64(text).alias("x"), F.crc32(text).alias("y"))


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()})


def linked_spans(found: DataFrame, scope: int) -> DataFrame:
    """id, no_id, print and linked: the weak spans of each text that met a complementary part."""
    several = found.where("size(weak) > 0 AND size(weak) + size(base) > 1").dropDuplicates(["doc_id", "print"])
    parts = several.select("doc_id", "print", F.explode(F.concat("base", "weak")).alias("x")).select("doc_id", "print", "x.*")
    # A text's spans are no more than the text itself, so one row holds them.
    return (
        linked_parts(parts, scope)
        .groupBy("id", "no_id", "print")
        .agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "m"))).alias("linked"))
    )


def scan_secrets(docs: DataFrame, scope: int = 300) -> DataFrame:
    """doc_id, base (certain spans), linked (weak parts that met a complementary one) for every row.

    Spans are structs (start, rank, kind, end, m) in code points, end exclusive, ordered by start and
    kind. A null or empty text has none. Repeated rows give repeated rows; rows of one doc_id but
    other texts are kept apart. Other columns of ``docs`` are not read. Intermediate rows hold spans,
    never texts, and are written to the shared folder.
    """
    found = found_spans(docs)
    joined = keyed(found).join(linked_spans(found, scope), ["id", "no_id", "print"], "left")
    return joined.select("doc_id", "base", F.coalesce("linked", F.array().cast(NONE)).alias("linked"))


def redacted(docs: DataFrame, scope: int = 300, mask: str = "[secret]") -> DataFrame:
    """``docs`` with all certain and linked spans of its texts replaced by ``mask``; same columns and rows.

    Overlapping spans are masked as one. A null text stays null.
    """
    linked = pin(linked_spans(found_spans(docs), scope), "linked").select("id", "no_id", "print", "linked")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), text_print(text).alias("print")
    )
    joined = keyed(rows).join(sent_if_small(linked), ["id", "no_id", "print"], "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    spans_of = F.array_sort(F.concat(base_spans(F.col("text")), F.coalesce("linked", F.array().cast(NONE))))
    clean = F.aggregate(spans_of, start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"))))
    new = F.when(F.col("row.text").isNotNull(), clean)
    return joined.select(*[new.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])

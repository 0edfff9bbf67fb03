"""Strict reading of JSON documents by a declared shape: which paths of a document break it.

A shape says what a value must be; records and lists hold shapes. Nothing is coerced, absent and
unknown keys are faults, and each fault is named by its path (``items.0.confidence``), in the order of
the declaration, unknown keys last and in document order. All of it is column expressions over
variants, so a document is read once where it lies and never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from relearn.functions.text import is_blank
from relearn.sources.responses import variant_kind as kind_of

Rule = Callable[[Column], Column]


def _none() -> Column:
    return F.array().cast("array<string>")


def _if(bad: Column, path: Column) -> Column:
    """The path if ``bad``, which counts as true when it is null."""
    return F.when(F.coalesce(bad, F.lit(True)), F.array(path)).otherwise(_none())


@dataclass(frozen=True)
class Shape:
    """``check(value, raw, path)`` gives the paths of faults; ``raw`` is the value's own JSON text."""

    check: Callable[[Column, Column, Column], Column]
    may_lack: bool = False
    may_be_null: bool = False

    def faults(self, value: Column, raw: Column, path: Column) -> Column:
        out = F.when(value.isNull(), _none() if self.may_lack else F.array(path))
        if self.may_be_null:
            out = out.when(kind_of(value) == "VOID", _none())
        return out.otherwise(self.check(value, raw, path))


def optional(shape: Shape, null: bool = False) -> Shape:
    """A key that may be absent and, with ``null``, may hold null."""
    return replace(shape, may_lack=True, may_be_null=null)


def text(blank: bool = True, choices: list[str] | None = None) -> Shape:
    def check(value: Column, raw: Column, path: Column) -> Column:
        said = F.try_variant_get(value, "$", "string")
        bad = kind_of(value) != "STRING"
        if not blank:
            bad = bad | is_blank(said)
        if choices is not None:
            bad = bad | ~said.isin(choices)
        return _if(bad, path)

    return Shape(check)


def whole(low: int | None = None) -> Shape:
    """An integer of up to 38 digits; a number with a point or an exponent is none."""

    def check(value: Column, raw: Column, path: Column) -> Column:
        large = F.schema_of_variant(value).rlike(r"^DECIMAL\((19|[23]\d),0\)$")
        bad = (kind_of(value) != "BIGINT") & ~large
        if low is not None:
            bad = bad | (F.try_variant_get(value, "$", "decimal(38,0)") < low)
        return _if(bad, path)

    return Shape(check)


def number(low: float | None = None, high: float | None = None) -> Shape:
    def check(value: Column, raw: Column, path: Column) -> Column:
        x = F.try_variant_get(value, "$", "double")
        bad = ~kind_of(value).isin("BIGINT", "DECIMAL", "DOUBLE") | x.isNull()
        if low is not None:
            bad = bad | (x < low)
        if high is not None:
            bad = bad | (x > high)
        return _if(bad, path)

    return Shape(check)


def truth() -> Shape:
    return Shape(lambda value, raw, path: _if(kind_of(value) != "BOOLEAN", path))


def listed(item: Shape, least: int = 0, rule: Rule | None = None) -> Shape:
    """A list of ``item``; ``rule`` is asked once all entries are sound and faults the list itself."""

    def check(value: Column, raw: Column, path: Column) -> Column:
        entries = F.try_variant_get(value, "$", "array<variant>")
        raws = F.from_json(raw, "array<string>")
        inner = F.flatten(F.transform(entries, lambda x, i: item.faults(x, F.get(raws, i), F.concat(path, F.lit("."), i.cast("string")))))
        if rule is not None:
            inner = F.when(F.size(inner) > 0, inner).otherwise(_if(~rule(value), path))
        return F.when((kind_of(value) != "ARRAY") | (F.size(entries) < least), F.array(path)).otherwise(inner)

    return Shape(check)


def record(fields: dict[str, Shape], rule: Rule | None = None) -> Shape:
    """An object with just these keys; ``rule`` is asked once all fields are sound and faults the object itself."""

    def check(value: Column, raw: Column, path: Column) -> Column:
        under = lambda name: F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))
        found = [s.faults(F.try_variant_get(value, f"$.{n}", "variant"), F.get_json_object(raw, f"$.{n}"), under(F.lit(n))) for n, s in fields.items()]
        unknown = F.array_except(F.json_object_keys(raw), F.array(*[F.lit(n) for n in fields]))
        inner = F.concat(*found, F.transform(unknown, under))
        if rule is not None:
            inner = F.when(F.size(inner) > 0, inner).otherwise(_if(~rule(value), path))
        return F.when(kind_of(value) != "OBJECT", F.array(path)).otherwise(inner)

    return Shape(check)


def faults(document: Column, shape: Shape) -> Column:
    """Paths of all faults of a JSON text; one empty path for a text that is null or does not parse."""
    return shape.faults(F.try_parse_json(document), document, F.lit(""))

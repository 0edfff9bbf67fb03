"""Rules over recognition output: validation, geometry, red marks, evidence and collection.

Items, marks and localizations are flat rows keyed by image_id. Boxes are columns l, t, r, b
in 0..1. Whatever meets per image has been counted or reduced before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relearn.functions import strict
from relearn.functions.ranks import page_rows, pin, spread
from relearn.functions.text import folded, is_blank, sequence_ratio, strip
from relearn.sources.responses import EMPTY, JSON_INVALID, variant_kind

# Fixed values of the service.
SUBJECTS = ["math", "chinese", "english"]
QUESTION_TYPES = ["write_pinyin", "write_word", "fill_blank", "calculation", "other"]
MARK_TYPES = ["circle", "cross", "deletion", "underline", "annotation", "mixed"]
ITEM_FIELDS = [
    "raw_text", "instruction", "prompt_text", "normalized_text", "answer", "subject",
    "question_type", "tags", "difficulty", "confidence", "uncertain_segments",
]
MARK_FIELDS = ["mark_id", "mark_type", "bbox", "confidence"]
RESULT_FIELDS = ["items", "error_marks", "ignored_text"]
TAG_ALIASES = {
    "pinyin": "拼音",
    "teacher-marked": "老师批改",
    "word": "词语",
    "wrong-character": "错别字",
}
TAG_DEFAULTS = {
    "write_pinyin": "拼音",
    "write_word": "词语",
    "fill_blank": "填空",
    "calculation": "计算",
    "other": "其他",
}
REASON_MATCH_UNMARKED = "答案与参考答案一致，未发现可靠错误标记"
REASON_UNCERTAIN = "题目区域或识别结果不确定"
REASON_NO_ANSWER = "缺少可比较的学生作答或参考答案"
REASON_COLLECTED = "检测到可靠错误标记且答案不一致"
REASON_CONTRADICTION = "答案与错误标记不一致"
REASON_NO_MARK = "未检测到可确认的错误标记"
DIAGNOSTIC_KEYS = [
    "operation", "status_code", "provider_status_code", "validation_fields", "reason",
    "source_width", "source_height", "prepared_width", "prepared_height",
    "candidate_count", "mark_count",
]
INVALID_RESPONSE = ("vision_response_invalid", "识别结果异常，请稍后重试")
INTERNAL_ERROR = ("recognition_internal_error", "识别暂时失败，请稍后重试")
SCHEMA_INVALID = "vision_response_schema_invalid"
FAILURE_MESSAGES = {
    EMPTY: "识别结果为空，请稍后重试",
    JSON_INVALID: "识别结果格式异常，请稍后重试",
    SCHEMA_INVALID: "识别结果格式不完整，请稍后重试",
}
BOX_FORMAT = "normalized_ltrb"
PROVIDER = "minimax"
RED_FLOOR, RED_MARGIN, RED_RATIO = 120, 45, 1.35
SUMMARY_CHARACTERS = 200
BOXES_PER_ROW = 256


@dataclass(frozen=True)
class Thresholds:
    item_confidence: float = 0.85
    mark_confidence: float = 0.85
    localization_confidence: float = 0.85
    max_area: float = 0.35
    padding: float = 0.15
    red_min_ratio: float = 0.005
    red_expansion: float = 0.08
    line_confidence: float = 0.85
    line_characters: int = 2
    support: float = 0.8
    contradiction: float = 0.9


def claimable_images(images: DataFrame, students: DataFrame, accounts: DataFrame) -> DataFrame:
    """Pending images whose student's account is active."""
    active = accounts.filter("status = 'active'").select(F.col("id").alias("account_id"))
    pupils = students.join(active, "account_id", "left_semi").select(F.col("id").alias("student_id"))
    return images.filter("status = 'pending'").join(pupils, "student_id", "left_semi")


# --- validation of model output -------------------------------------------------------------


def _number_in_unit(value: Column, kind: Column) -> Column:
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(kind.isin("BIGINT", "DECIMAL", "DOUBLE") & number.between(0, 1), F.lit(False))


def _list_errors(owner: Column, name: str, prefix: Column) -> Column:
    """Paths of entries that are not strings in an optional list of strings."""
    value = F.try_variant_get(owner, f"$.{name}", "variant")
    entries = F.try_variant_get(owner, f"$.{name}", "array<variant>")
    inner = F.transform(
        entries,
        lambda x, i: F.when(
            F.coalesce(variant_kind(x) != "STRING", F.lit(True)),
            F.concat(prefix, F.lit(f"{name}."), i.cast("string")),
        ),
    )
    whole = F.array(F.concat(prefix, F.lit(name)))
    return (
        F.when(value.isNull(), F.array().cast("array<string>"))
        .when(entries.isNull(), whole)  # no list
        .otherwise(inner)
    )


def _extra_keys(text: Column, allowed: list[str], prefix: Column) -> Column:
    keys = F.array_except(F.json_object_keys(text), F.array(*[F.lit(a) for a in allowed]))
    return F.transform(keys, lambda k: F.concat(prefix, k))


def _item_errors(item: Column, text: Column, prefix: Column) -> Column:
    def get(name: str) -> tuple[Column, Column]:
        value = F.try_variant_get(item, f"$.{name}", "variant")
        return value, variant_kind(value)

    def flag(name: str, bad: Column) -> Column:
        return F.array(F.when(F.coalesce(bad, F.lit(True)), F.concat(prefix, F.lit(name))))

    def required_text(name: str) -> Column:
        _, kind = get(name)
        return flag(name, (kind != "STRING") | is_blank(F.try_variant_get(item, f"$.{name}", "string")))

    def optional_text(name: str) -> Column:
        value, kind = get(name)
        return flag(name, value.isNotNull() & ~kind.isin("STRING", "VOID"))

    def choice(name: str, allowed: list[str]) -> Column:
        _, kind = get(name)
        return flag(name, (kind != "STRING") | ~F.try_variant_get(item, f"$.{name}", "string").isin(allowed))

    difficulty, _ = get("difficulty")
    confidence, confidence_kind = get("confidence")
    fields = F.concat(
        required_text("raw_text"),
        required_text("instruction"),
        required_text("prompt_text"),
        optional_text("normalized_text"),
        optional_text("answer"),
        choice("subject", SUBJECTS),
        choice("question_type", QUESTION_TYPES),
        _list_errors(item, "tags", prefix),
        strict.optional(strict.whole()).faults(difficulty, text, F.concat(prefix, F.lit("difficulty"))),
        flag("confidence", ~_number_in_unit(confidence, confidence_kind)),
        _list_errors(item, "uncertain_segments", prefix),
        _extra_keys(text, ITEM_FIELDS, prefix),
    )
    whole = F.array(F.regexp_replace(prefix, r"\.$", ""))
    return F.when(variant_kind(item) == "OBJECT", fields).otherwise(whole)


def bbox_ok(l: Column, t: Column, r: Column, b: Column) -> Column:
    inside = (l >= 0) & (t >= 0) & (r <= 1) & (b <= 1)
    return F.coalesce(inside & (l < r) & (t < b), F.lit(False))


def _mark_errors(mark: Column, text: Column, prefix: Column) -> Column:
    def flag(name: str, bad: Column) -> Column:
        return F.array(F.when(F.coalesce(bad, F.lit(True)), F.concat(prefix, F.lit(name))))

    mark_id = F.try_variant_get(mark, "$.mark_id", "variant")
    kind = F.try_variant_get(mark, "$.mark_type", "variant")
    box = F.try_variant_get(mark, "$.bbox", "array<variant>")
    numbers = F.try_variant_get(mark, "$.bbox", "array<double>")
    confidence = F.try_variant_get(mark, "$.confidence", "variant")
    numeric = F.forall(box, lambda v: F.coalesce(variant_kind(v).isin("BIGINT", "DECIMAL", "DOUBLE"), F.lit(False)))
    shaped = (F.size(box) == 4) & bbox_ok(*[F.get(numbers, F.lit(i)) for i in range(4)])
    fields = F.concat(
        flag("mark_id", (variant_kind(mark_id) != "BIGINT") | (F.try_variant_get(mark, "$.mark_id", "long") < 0)),
        flag("mark_type", (variant_kind(kind) != "STRING") | ~F.try_variant_get(mark, "$.mark_type", "string").isin(MARK_TYPES)),
        flag("bbox", box.isNull() | ~numeric | ~shaped),
        flag("confidence", ~_number_in_unit(confidence, variant_kind(confidence))),
        _extra_keys(text, MARK_FIELDS, prefix),
    )
    whole = F.array(F.regexp_replace(prefix, r"\.$", ""))
    return F.when(variant_kind(mark) == "OBJECT", fields).otherwise(whole)


def _child_errors(result: str, raw: str, name: str, check, required: bool) -> Column:
    value = F.try_variant_get(F.col(result), f"$.{name}", "variant")
    children = F.try_variant_get(F.col(result), f"$.{name}", "array<variant>")
    per_child = F.flatten(
        F.transform(
            children,
            lambda child, i: check(
                child, F.get(F.col(f"{raw}.{name}"), i), F.concat(F.lit(f"{name}."), i.cast("string"), F.lit("."))
            ),
        )
    )
    wrong = F.array(F.lit(name))
    if required:
        out = F.when(value.isNull(), wrong).when(children.isNull(), wrong).when(F.size(children) == 0, wrong)
    else:
        out = F.when(value.isNull(), F.array().cast("array<string>")).when(children.isNull(), wrong)
    return out.otherwise(per_child)


def validate_items(responses: DataFrame, payload: str = "payload_json", shown: int = 5) -> DataFrame:
    """Strict check of a parsed vision result: adds ``valid`` and ``bad_fields``.

    Types are not coerced, unknown keys are refused, and one bad field refuses the whole
    response. The first ``shown`` paths are reported in field order.
    """
    parsed = spread(responses).withColumn("_v", F.try_parse_json(payload)).withColumn(
        "_raw", F.from_json(payload, "items array<string>, error_marks array<string>")
    )
    errors = F.concat(
        _child_errors("_v", "_raw", "items", _item_errors, True),
        _child_errors("_v", "_raw", "error_marks", _mark_errors, False),
        _list_errors(F.col("_v"), "ignored_text", F.lit("")),
        _extra_keys(F.col(payload), RESULT_FIELDS, F.lit("")),
    )
    found = parsed.withColumn("_bad", F.filter(errors, lambda e: e.isNotNull()))
    ids = F.transform(
        F.try_variant_get(F.col("_v"), "$.error_marks", "array<variant>"),
        lambda m: F.try_variant_get(m, "$.mark_id", "long"),
    )
    # sequence(0, -1) is not empty, so a result without marks is settled first.
    in_order = F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, True).otherwise(
        ids == F.sequence(F.lit(0).cast("long"), F.size(ids).cast("long") - 1)
    )
    bad = F.when((F.size("_bad") == 0) & ~in_order, F.array(F.lit(""))).otherwise(F.slice("_bad", 1, shown))
    bad = F.when(F.col("_v").isNull(), F.array(F.lit(""))).otherwise(bad)
    return (
        found.withColumn("bad_fields", bad)
        .withColumn("valid", F.size("bad_fields") == 0)
        .drop("_v", "_raw", "_bad")
    )


ITEMS_SCHEMA = (
    "items array<struct<raw_text:string,instruction:string,prompt_text:string,normalized_text:string,"
    "answer:string,subject:string,question_type:string,tags:array<string>,difficulty:decimal(38,0),"
    "confidence:double,uncertain_segments:array<string>>>"
)
MARKS_SCHEMA = "error_marks array<struct<mark_id:int,mark_type:string,bbox:array<double>,confidence:double>>"


def recognized_items(validated: DataFrame, payload: str = "payload_json", keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Item rows of the valid responses: texts trimmed, difficulty clamped to 1..5 (default 3).

    Pin ``validated`` before: the filter on ``valid`` would else repeat the whole check.
    """
    parsed = F.from_json(payload, ITEMS_SCHEMA)
    rows = validated.filter("valid").select(*keep, F.posexplode(parsed["items"]).alias("idx", "_i")).select(*keep, "idx", "_i.*")
    for name in ("raw_text", "instruction", "prompt_text"):
        rows = rows.withColumn(name, strip(F.col(name)))
    clamped = F.greatest(F.lit(1), F.least(F.lit(5), F.col("difficulty")))
    level = F.when(F.col("difficulty").isNull(), 3).otherwise(clamped)
    empty = F.array().cast("array<string>")
    return (
        rows.withColumn("difficulty", level.cast("int"))
        .withColumn("tags", F.coalesce("tags", empty))
        .withColumn("uncertain_segments", F.coalesce("uncertain_segments", empty))
    )


def recognized_marks(validated: DataFrame, payload: str = "payload_json", keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Mark rows of the valid responses."""
    parsed = F.from_json(payload, MARKS_SCHEMA)
    rows = validated.filter("valid").select(*keep, F.posexplode(parsed["error_marks"]).alias("position", "_m"))
    box = [F.get(F.col("_m.bbox"), F.lit(i)).alias(n) for i, n in enumerate("ltrb")]
    return rows.select(*keep, "position", "_m.mark_id", "_m.mark_type", *box, "_m.confidence")


def validate_marks(marks: DataFrame) -> DataFrame:
    """Per image whether its mark rows are sound and their ids are exactly 0..n-1 in order."""
    sound = (
        F.coalesce(F.col("mark_type").isin(MARK_TYPES), F.lit(False))
        & bbox_ok(F.col("l"), F.col("t"), F.col("r"), F.col("b"))
        & F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    )
    ordered = F.coalesce(F.col("mark_id") == F.col("position"), F.lit(False))
    return marks.groupBy("image_id").agg(
        F.count("*").alias("n_marks"),
        F.bool_and(sound).alias("marks_sound"),
        F.bool_and(ordered).alias("ids_in_order"),
    ).withColumn("valid", F.col("marks_sound") & F.col("ids_in_order"))


def validate_localizations(items: DataFrame, localizations: DataFrame, marks: DataFrame) -> DataFrame:
    """Per image with localizations the reason they are all dropped; null when they stand.

    ``localizations``(image_id, idx, matched, mark_ids, l, t, r, b, observed_*, confidence);
    ``marks`` are the valid ones. Marks are compared as counts per (image, mark).
    """
    boxed = F.col("l").isNotNull()
    observed = F.lit(False)
    for name in ("observed_prompt_text", "observed_raw_text"):
        if name in localizations.columns:
            observed = observed | F.col(name).isNotNull()
    sound = (
        (F.col("matched") == boxed)
        & (F.col("matched") | ((F.size("mark_ids") == 0) & ~observed))
        & (~boxed | bbox_ok(F.col("l"), F.col("t"), F.col("r"), F.col("b")))
        & F.col("confidence").between(0, 1)
    )
    shape = localizations.groupBy("image_id", "idx").agg(
        F.count("*").alias("_n"), F.bool_and(F.coalesce(sound, F.lit(False))).alias("_sound")
    )
    shape = shape.groupBy("image_id").agg(
        F.bool_and("_sound").alias("_sound"),
        F.sum("_n").alias("_rows"),
        F.count("*").alias("_indexes"),
        F.min("idx").alias("_low"),
        F.max("idx").alias("_high"),
    )
    expected = items.groupBy("image_id").agg(F.count("*").alias("_items"))
    used = localizations.select("image_id", F.explode("mark_ids").alias("mark_id"), F.lit(1).alias("_used"), F.lit(0).alias("_valid"))
    valid = marks.select("image_id", "mark_id", F.lit(0).alias("_used"), F.lit(1).alias("_valid"))
    per_mark = used.union(valid).groupBy("image_id", "mark_id").agg(F.sum("_used").alias("_used"), F.max("_valid").alias("_valid"))
    assigned = per_mark.groupBy("image_id").agg(
        F.bool_or(F.col("_used") > 1).alias("_twice"),
        F.bool_or((F.col("_used") > 0) != (F.col("_valid") > 0)).alias("_differs"),
    )
    n = F.coalesce("_items", F.lit(0))
    reason = (
        F.when(~F.col("_sound"), "schema_invalid")
        .when((F.col("_rows") != n) | (F.col("_indexes") != F.col("_rows")), "index_count_mismatch")
        .when((F.col("_low") != 0) | (F.col("_high") != n - 1), "index_set_mismatch")
        .when(F.coalesce("_twice", F.lit(False)), "duplicate_mark_assignment")
        .when(F.coalesce("_differs", F.lit(False)), "unassigned_mark")
    )
    return shape.join(expected, "image_id", "left").join(assigned, "image_id", "left").select(
        "image_id", reason.alias("reason")
    )


# --- geometry ------------------------------------------------------------------------------


def assigned_marks(localizations: DataFrame, marks: DataFrame) -> DataFrame:
    """Per localization with marks: whether all centres lie inside, and the mean centre."""
    rows = localizations.select(
        "image_id", "idx", F.col("l").alias("_l"), F.col("t").alias("_t"), F.col("r").alias("_r"), F.col("b").alias("_b"),
        F.explode("mark_ids").alias("mark_id"),
    )
    centres = marks.select(
        "image_id", "mark_id", ((F.col("l") + F.col("r")) / 2).alias("_x"), ((F.col("t") + F.col("b")) / 2).alias("_y")
    )
    inside = F.col("_x").between(F.col("_l"), F.col("_r")) & F.col("_y").between(F.col("_t"), F.col("_b"))
    return (
        rows.join(centres, ["image_id", "mark_id"], "left")
        .groupBy("image_id", "idx")
        .agg(
            F.bool_and(F.coalesce(inside, F.lit(False))).alias("marks_inside"),
            F.avg("_x").alias("focus_x"),
            F.avg("_y").alias("focus_y"),
        )
    )


def with_geometry(localizations: DataFrame, marks: DataFrame) -> DataFrame:
    """Localizations with marks_inside, focus and whether their image has valid marks at all."""
    present = marks.select("image_id", F.lit(True).alias("image_has_marks")).distinct()
    return (
        localizations.join(assigned_marks(localizations, marks), ["image_id", "idx"], "left")
        .join(present, "image_id", "left")
        .withColumn("image_has_marks", F.coalesce("image_has_marks", F.lit(False)))
    )


def box_area() -> Column:
    return (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))


def _box_sound(box: Column) -> Column:
    edges = F.try_variant_get(box, "$", "array<double>")
    return (F.size(edges) == 4) & bbox_ok(*[F.get(edges, F.lit(i)) for i in range(4)])


def _match_sound(item: Column) -> Column:
    """A matched question has a box; another has neither box nor marks nor observed texts."""
    given = lambda name: F.coalesce(strict.kind_of(F.try_variant_get(item, f"$.{name}", "variant")) != "VOID", F.lit(False))
    matched = F.try_variant_get(item, "$.matched", "boolean")
    marks = F.coalesce(F.size(F.try_variant_get(item, "$.mark_ids", "array<variant>")), F.lit(0))
    return (matched == given("bbox")) & (matched | (marks <= 0) & ~given("observed_prompt_text") & ~given("observed_raw_text"))


LOCALIZATION = strict.record(
    {
        "items": strict.listed(
            strict.record(
                {
                    "index": strict.whole(0),
                    "matched": strict.truth(),
                    "mark_ids": strict.optional(strict.listed(strict.whole())),
                    "bbox": strict.optional(strict.listed(strict.number(), rule=_box_sound), null=True),
                    "observed_prompt_text": strict.optional(strict.text(), null=True),
                    "observed_raw_text": strict.optional(strict.text(), null=True),
                    "confidence": strict.number(0, 1),
                },
                _match_sound,
            ),
            least=1,
        )
    }
)
LOCALIZATION_ROWS = (
    "items array<struct<index:bigint,matched:boolean,mark_ids:array<bigint>,bbox:array<double>,"
    "observed_prompt_text:string,observed_raw_text:string,confidence:double>>"
)


def parse_localizations(
    documents: DataFrame, items: DataFrame, marks: DataFrame, payload: str = "payload_json", shown: int = 5
) -> dict[str, DataFrame]:
    """Read localization documents (image_id, payload) strictly, one per image.

    ``verdicts``: image_id, reason (null where the document stands) and bad_fields, the first paths of a
    document against its shape; ``localizations``: the rows of the documents that stand, as the other
    operators take them. ``items`` and the valid ``marks`` are those of :func:`validate_localizations`.
    A null or unreadable document is against its shape.
    """
    # The check is long and several steps read it; calling this runs jobs.
    read = pin(spread(documents).select("image_id", payload, strict.faults(F.col(payload), LOCALIZATION).alias("_bad")))
    read = read.withColumn("bad_fields", F.slice("_bad", 1, shown))
    found = F.from_json(payload, LOCALIZATION_ROWS)["items"]
    rows = read.filter(F.size("_bad") == 0).select("image_id", F.explode(found).alias("x"))
    edges = [F.get(F.col("x.bbox"), F.lit(i)).alias(n) for i, n in enumerate("ltrb")]
    rows = rows.select(
        "image_id", F.col("x.index").alias("idx"), "x.matched", F.coalesce("x.mark_ids", F.array().cast("array<bigint>")).alias("mark_ids"),
        *edges, "x.observed_prompt_text", "x.observed_raw_text", "x.confidence",
    )
    checked = validate_localizations(items, rows, marks)
    reason = F.when(F.size("bad_fields") > 0, F.lit("schema_invalid")).otherwise(F.col("reason"))
    verdicts = read.join(checked, "image_id", "left").select("image_id", reason.alias("reason"), "bad_fields")
    standing = verdicts.filter("reason IS NULL").select("image_id")
    return {"verdicts": verdicts, "localizations": rows.join(standing, "image_id", "left_semi")}


def geometry_ok(max_area: float, allow_unassigned: Column | None = None) -> Column:
    """Predicate over ``with_geometry`` rows: small enough, and all assigned marks centred inside.

    An image with valid marks needs one assigned, unless ``allow_unassigned`` holds.
    """
    unassigned = F.col("image_has_marks") & (F.size("mark_ids") == 0)
    if allow_unassigned is not None:
        unassigned = unassigned & ~allow_unassigned
    fits = F.col("matched") & F.col("l").isNotNull() & (box_area() <= max_area) & ~unassigned
    return F.coalesce(fits & F.coalesce("marks_inside", F.lit(True)), F.lit(False))


def display_bbox(padding: float) -> Column:
    """Box shown to the user: enlarged, moved towards the marks, clipped to the image."""
    if padding == 0:
        return F.struct("l", "t", "r", "b")

    def axis(low: str, high: str, focus: str) -> tuple[Column, Column]:
        lo, hi = F.col(low), F.col(high)
        size = F.least(F.lit(1.0), (hi - lo) * (1 + 2 * padding))
        aim = F.coalesce(F.col(focus), (lo + hi) / 2)
        centre = F.greatest(aim, F.greatest(size / 2, hi - size / 2))
        centre = F.least(centre, F.least(1 - size / 2, lo + size / 2))
        return F.greatest(F.lit(0.0), centre - size / 2), F.least(F.lit(1.0), centre + size / 2)

    left, right = axis("l", "r", "focus_x")
    top, bottom = axis("t", "b", "focus_y")
    return F.struct(left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"))


def pixel_crop_box(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column) -> Column:
    """Pixel box (left, top, right, bottom) of a normalised box, one pixel at least; null if invalid."""

    def axis(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
        first = F.greatest(F.lit(0), F.least(size - 1, F.floor(low * size)))
        last = F.greatest(first + 1, F.least(size, F.ceil(high * size)))
        return first.cast("int"), last.cast("int")

    left, right = axis(l, r, width)
    top, bottom = axis(t, b, height)
    box = F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
    finite = ~(F.isnan(l) | F.isnan(t) | F.isnan(r) | F.isnan(b))
    return F.when(bbox_ok(l, t, r, b) & finite, box)


# --- red marks ------------------------------------------------------------------------------

BOX_EVIDENCE = """image_id {key}, l double, t double, r double, b double, px_left int, px_top int,
    px_right int, px_bottom int, red_pixel_count long, pixel_count long"""


def _expanded(low: float, high: float, size: int, expansion: float) -> tuple[int, int]:
    grow = (high - low) * expansion
    first = max(0.0, low - grow) * size
    last = min(1.0, high + grow) * size
    return max(0, int(np.floor(first))), min(size, int(np.ceil(last)))


def _mask_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        masks = []
        for height, width, channels, data in zip(batch["height"], batch["width"], batch["channels"], batch["pixels"]):
            hit = np.zeros(height * width, dtype=bool)
            if channels >= 3:
                pixels = np.frombuffer(data, dtype=np.uint8).reshape(height * width, channels)
                blue, green, full = (pixels[:, c].astype(np.int32) for c in range(3))
                hit = (
                    (full >= RED_FLOOR)
                    & (full - green >= RED_MARGIN)
                    & (full - blue >= RED_MARGIN)
                    & (full >= green * RED_RATIO)
                    & (full >= blue * RED_RATIO)
                )
            masks.append(np.packbits(hit).tobytes())
        yield batch[["image_id", "height", "width"]].assign(mask=masks)


# How stored rows and columns become upright ones, by EXIF orientation.
TURNS = {
    2: np.fliplr,
    3: lambda grid: np.rot90(grid, 2),
    4: np.flipud,
    5: np.transpose,
    6: lambda grid: np.rot90(grid, -1),
    7: lambda grid: np.rot90(grid, 2).T,
    8: np.rot90,
}


def _turn_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for image_id, height, width, mask, turn in zip(*(batch[c] for c in ("image_id", "height", "width", "mask", "orientation"))):
            if turn in TURNS:
                grid = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=height * width).reshape(height, width)
                grid = TURNS[turn](grid)
                height, width = grid.shape
                mask = np.packbits(grid).tobytes()
            rows.append((image_id, height, width, mask))
        yield pd.DataFrame(rows, columns=["image_id", "height", "width", "mask"])


def red_masks(pixels: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """One bit per pixel, set where it is red, of the readable images: image_id, height, width, mask.

    ``pixels``(image_id, height, width, channels, pixels BGR, readable). This runs right on the scan, so
    what travels to the boxes afterwards is a 24th of the pixels. ``turns``(image_id, orientation), one row
    an image at most, names images that are stored turned or mirrored; their masks come out upright.
    """
    key = pixels.schema["image_id"].dataType.simpleString()
    shape = f"image_id {key}, height int, width int, mask binary"
    readable = pixels.filter("readable").select("image_id", "height", "width", "channels", "pixels")
    masks = readable.mapInPandas(_mask_batch, shape)
    if turns is None:
        return masks
    known = masks.join(turns.select("image_id", "orientation"), "image_id", "left")
    return known.withColumn("orientation", F.coalesce("orientation", F.lit(1))).mapInPandas(_turn_batch, shape)


def _count_red(expansion: float):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for image_id, height, width, mask, boxes in zip(
                batch["image_id"], batch["height"], batch["width"], batch["mask"], batch["boxes"]
            ):
                red = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=height * width).reshape(height, width)
                for box in boxes:
                    left, right = _expanded(box["l"], box["r"], width, expansion)
                    top, bottom = _expanded(box["t"], box["b"], height, expansion)
                    area = red[top:bottom, left:right]
                    rows.append(
                        (image_id, box["l"], box["t"], box["r"], box["b"], left, top, right, bottom,
                         int(area.sum(dtype=np.int64)), int(area.size))
                    )
            yield pd.DataFrame(
                rows,
                columns=["image_id", "l", "t", "r", "b", "px_left", "px_top", "px_right", "px_bottom",
                         "red_pixel_count", "pixel_count"],
            )

    return count


def count_red_pixels(pixels: DataFrame, boxes: DataFrame, expansion: float) -> DataFrame:
    """Red and all pixels inside each distinct box, enlarged by ``expansion``.

    ``pixels`` are images or their ``red_masks``. Equal boxes are merged first, and the boxes of a
    crowded image are hashed into packs of about BOXES_PER_ROW. A mask is repeated once per pack and
    meets it by (image, pack), so no row or task holds all boxes of an image.
    """
    key = boxes.schema["image_id"].dataType.simpleString()
    masks = pixels if "mask" in pixels.columns else red_masks(pixels)
    distinct = boxes.select("image_id", *[F.col(c).cast("double") for c in "ltrb"]).distinct()
    crowd = distinct.groupBy("image_id").agg(F.ceil(F.count("*") / F.lit(BOXES_PER_ROW)).alias("_packs"))
    packs = (
        distinct.join(crowd, "image_id")
        .withColumn("_pack", F.pmod(F.xxhash64("l", "t", "r", "b"), F.col("_packs")))
        # Without this the join's partitioning by image would be kept for the grouping.
        .repartition("image_id", "_pack")
        .groupBy("image_id", "_pack")
        .agg(F.collect_list(F.struct("l", "t", "r", "b")).alias("boxes"))
    )
    copies = masks.join(crowd, "image_id").withColumn("_pack", F.explode(F.sequence(F.lit(0), F.col("_packs") - 1))).drop("_packs")
    # A partitioning by image alone would satisfy the join below and gather the packs again.
    copies = copies.repartition("image_id", "_pack")
    return packs.join(copies, ["image_id", "_pack"]).drop("_pack").mapInPandas(
        _count_red(expansion), BOX_EVIDENCE.format(key=key)
    )


def red_evidence(
    pixels: DataFrame, marks: DataFrame, rules: Thresholds = Thresholds()
) -> DataFrame:
    """Marks with their pixel evidence, ``accepted`` and ``reason``.

    Low confidence outranks missing red; marks on an unreadable image are all rejected.
    """
    box = ["image_id", "l", "t", "r", "b"]
    counted = count_red_pixels(pixels, marks, rules.red_expansion)
    ratio = F.when(F.col("pixel_count") > 0, F.col("red_pixel_count") / F.col("pixel_count")).otherwise(
        F.when(F.col("pixel_count").isNotNull(), F.lit(0.0))
    )
    reason = (
        F.when(F.col("pixel_count").isNull(), "image_invalid")
        .when(F.col("confidence") < rules.mark_confidence, "low_confidence")
        .when(F.col("red_pixel_ratio") < rules.red_min_ratio, "insufficient_red_pixels")
        .otherwise("accepted")
    )
    return (
        marks.join(counted, box, "left")
        .withColumn("red_pixel_ratio", ratio)
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason") == "accepted")
    )


def evidence_matches(prompt: Column, observed_prompt: Column, raw: Column, observed_raw: Column) -> Column:
    """Whether either text was seen again at the localization, compared in folded form."""

    def same(expected: Column, observed: Column) -> Column:
        left = folded(expected, "evidence")
        return (left != "") & (left == folded(observed, "evidence"))

    return same(prompt, observed_prompt) | same(raw, observed_raw)


def local_red_evidence(
    pixels: DataFrame, located: DataFrame, rules: Thresholds = Thresholds()
) -> DataFrame:
    """Pixel evidence and ``red_verified`` of trusted localizations that were given no mark, by (image_id, idx).

    ``located`` are ``with_geometry`` rows with ``evidence``. The predicate runs before the
    join, so pixels are read only for images that need it.
    """
    needed = located.filter(
        F.col("matched")
        & F.col("l").isNotNull()
        & (F.col("confidence") >= rules.localization_confidence)
        & (box_area() <= rules.max_area)
        & F.col("evidence")
        & F.col("image_has_marks")
        & (F.size("mark_ids") == 0)
    ).select("image_id", "idx", "l", "t", "r", "b")
    counted = count_red_pixels(pixels, needed, rules.red_expansion)
    ratio = F.when(F.col("pixel_count") > 0, F.col("red_pixel_count") / F.col("pixel_count")).otherwise(
        F.when(F.col("pixel_count").isNotNull(), F.lit(0.0))
    )
    verified = F.coalesce(F.col("red_pixel_ratio") >= rules.red_min_ratio, F.lit(False))
    return (
        needed.join(counted, ["image_id", "l", "t", "r", "b"], "left")
        .withColumn("red_pixel_ratio", ratio)
        .withColumn("red_verified", verified)
    )


def local_red_check(
    pixels: DataFrame, located: DataFrame, rules: Thresholds = Thresholds()
) -> DataFrame:
    """(image_id, idx, red_verified) of :func:`local_red_evidence`."""
    return local_red_evidence(pixels, located, rules).select("image_id", "idx", "red_verified")


def review_status(
    items: DataFrame, located: DataFrame, rules: Thresholds = Thresholds()
) -> DataFrame:
    """Items with localization_verified, review_status, reliable_error_mark and crop_region.

    ``located`` are ``with_geometry`` rows with ``evidence`` and, optionally, ``red_verified``.
    """
    if "red_verified" not in located.columns:
        located = located.withColumn("red_verified", F.lit(False))
    red = F.coalesce("red_verified", F.lit(False))
    trusted = (
        (F.col("confidence") >= rules.localization_confidence)
        & geometry_ok(rules.max_area, red)
        & F.col("evidence")
    )
    no_marks = F.size("mark_ids") == 0
    source = F.when(red & no_marks, "local_red_verified").otherwise("minimax_marker_anchored")
    if rules.padding > 0:
        source = F.when(red & no_marks, "local_red_verified_context").otherwise("marker_focused_context")
    judged = located.select(
        "image_id",
        "idx",
        F.coalesce(trusted, F.lit(False)).alias("_trusted"),
        (red | ~no_marks).alias("_marked"),
        F.struct(
            display_bbox(rules.padding).alias("bbox"),
            F.struct("l", "t", "r", "b").alias("localization_bbox"),
            source.alias("bbox_source"),
            F.col("confidence").alias("bbox_confidence"),
            F.col("mark_ids").alias("mark_ids"),
        ).alias("_crop"),
    )
    verified = F.coalesce("_trusted", F.lit(False))
    uncertain = (F.col("confidence") < rules.item_confidence) | (F.size("uncertain_segments") > 0)
    return (
        items.join(judged, ["image_id", "idx"], "left")
        .withColumn("localization_verified", verified)
        .withColumn("review_status", F.when(uncertain | ~verified, "needs_review").otherwise("confirmed"))
        .withColumn("reliable_error_mark", verified & F.coalesce("_marked", F.lit(False)))
        .withColumn("crop_region", F.when(verified, F.col("_crop")))
        .withColumn("bbox_source", F.coalesce("crop_region.bbox_source", F.lit("unverified")))
        .drop("_trusted", "_marked", "_crop")
    )


# --- reading the crop again -------------------------------------------------------------------

#: Letters of English text from common to rare.
COMMON_FIRST = "etaoinshrdlcumwfgypbvkjxqz"


def _needed_overlap(length: Column, ratio: float) -> Column:
    """Fewest shared characters a text of this length needs to reach ``ratio`` with any partner."""
    return F.ceil(length * F.lit(ratio / (2 - ratio)) - 1e-9).cast("int")


def _lead_characters(text: Column, ratio: float) -> Column:
    """Characters of which one at least is shared by every text that can reach ``ratio``.

    Ordering both texts' characters the same way, two texts that share enough of them share
    one among the first length - needed + 1. The order puts rare characters first, so that few
    texts meet on each; common letters are replaced by their place, which orders them last.
    """
    by_rarity = F.translate(text, COMMON_FIRST, "".join(chr(i + 1) for i in range(len(COMMON_FIRST))))
    ordered = F.sort_array(F.array_remove(F.split(by_rarity, ""), ""), asc=False)
    keep = F.length(text) - _needed_overlap(F.length(text), ratio) + 1
    return F.array_distinct(F.slice(ordered, F.lit(1), F.greatest(keep, F.lit(1))))


def _variants(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Distinct folded forms of a text, with and without tone marks."""
    both = F.array(
        F.struct(F.lit(0).alias("form"), folded(F.col(text), "evidence").alias("folded")),
        F.struct(F.lit(1).alias("form"), folded(F.col(text), "toneless").alias("folded")),
    )
    return df.select(*keys, F.explode(both).alias("_v")).select(*keys, "_v.*").filter("folded <> ''").distinct()


def ocr_verdict(lines: DataFrame, items: DataFrame, rules: Thresholds = Thresholds()) -> DataFrame:
    """Verdict per (image_id, target_idx) from the lines read inside the target's crop.

    ``lines``(image_id, target_idx, line_no, text, confidence), ``items`` with their texts.
    A line is compared with its own target directly. Other items matter only from
    ``contradiction`` on; such pairs must share a leading character and have fitting lengths,
    so they come from an equi-join on (image, character) that misses none of them.
    """
    target = ["image_id", "target_idx"]
    usable = lines.filter(
        (F.col("confidence") >= rules.line_confidence)
        & (F.length(folded(F.col("text"), "toneless")) >= rules.line_characters)
    )
    texts = F.array(*[F.col(c) for c in ("prompt_text", "raw_text", "normalized_text", "answer") if c in items.columns])
    candidates = items.select("image_id", "idx", F.explode(texts).alias("_text")).filter("_text <> ''")
    # Both are narrow and read several times below, so texts are folded once; calling this runs jobs.
    read = pin(_variants(usable, "text", target))
    known = pin(_variants(candidates, "_text", ["image_id", "idx"]))

    # Every line but the first adds its three-character separator at least, so these lines fill the summary.
    enough = SUMMARY_CHARACTERS // 3 + 2
    opening = page_rows(usable, target, [F.col("line_no").asc()], enough, name="_line")
    summary = opening.groupBy(*target).agg(
        F.substring(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_line", "text"))), lambda s: s["text"]), " | "),
            1, SUMMARY_CHARACTERS,
        ).alias("text_summary")
    )
    heads = usable.groupBy(*target).agg(F.max("confidence").alias("confidence"))

    own = read.join(known.withColumnRenamed("idx", "target_idx").withColumnRenamed("folded", "_other"), [*target, "form"])
    own_score = own.withColumn("_ratio", sequence_ratio(F.col("folded"), F.col("_other"))).groupBy(*target).agg(
        F.max("_ratio").alias("target_score")
    )
    scored = heads.join(own_score, target, "left").withColumn("target_score", F.coalesce("target_score", F.lit(0.0)))
    open_targets = scored.filter(F.col("target_score") < rules.support).select(*target, "target_score")

    limit = rules.contradiction
    left = read.join(open_targets.select(*target), target, "left_semi").withColumn("_char", F.explode(_lead_characters(F.col("folded"), limit)))
    right = known.withColumnRenamed("folded", "_other").withColumn("_char", F.explode(_lead_characters(F.col("_other"), limit)))
    short, long = F.least(F.length("folded"), F.length("_other")), F.greatest(F.length("folded"), F.length("_other"))
    pairs = (
        left.join(right, ["image_id", "form", "_char"])
        .filter((F.col("idx") != F.col("target_idx")) & (short >= _needed_overlap(long, limit)))
        .select(*target, "idx", "folded", "_other")
        .distinct()
        .withColumn("_ratio", sequence_ratio(F.col("folded"), F.col("_other")))
        .filter(F.col("_ratio") >= limit)
    )
    best = pairs.groupBy(*target, "idx").agg(F.max("_ratio").alias("_ratio")).groupBy(*target).agg(
        F.max(F.struct("_ratio", (-F.col("idx")).alias("_minus"))).alias("_best")
    )
    judged = scored.join(best, target, "left")
    real = items.select("image_id", F.col("idx").alias("target_idx"), F.lit(True).alias("_real")).distinct()
    judged = judged.join(real, target, "left").join(summary, target, "left")
    contradicts = F.col("_best").isNotNull() & (F.col("_best._ratio") > F.col("target_score"))
    status = (
        F.when(F.col("_real").isNull(), "inconclusive")
        .when(F.col("target_score") >= rules.support, "support")
        .when(contradicts, "contradict")
        .otherwise("inconclusive")
    )
    judged = judged.withColumn("status", status).withColumn(
        "matched_index",
        F.when(F.col("status") == "support", F.col("target_idx"))
        .when(F.col("status") == "contradict", -F.col("_best._minus"))
        .cast("int"),
    )
    asked = lines.select(*target).distinct()
    return asked.join(judged, target, "left").select(
        *target,
        F.coalesce("status", F.lit("inconclusive")).alias("status"),
        "matched_index",
        F.coalesce("text_summary", F.lit("")).alias("text_summary"),
        F.when(F.col("_real"), F.col("confidence")).alias("confidence"),
    )


# --- collection -----------------------------------------------------------------------------


def collection_decision(df: DataFrame) -> DataFrame:
    """Adds collection_status and collection_reason; the first rule that fits decides.

    Needs ocr_text, ocr_answer, review_status and reliable_error_mark.
    """
    rows = df.withColumn("_given", folded(F.col("ocr_text"), "answer")).withColumn(
        "_right", folded(F.col("ocr_answer"), "answer")
    )
    same = (F.col("_given") != "") & (F.col("_given") == F.col("_right"))
    marked = F.coalesce("reliable_error_mark", F.lit(False))
    reason = (
        F.when(same & ~marked, REASON_MATCH_UNMARKED)
        .when(F.coalesce(F.col("review_status") != "confirmed", F.lit(True)), REASON_UNCERTAIN)
        .when((F.col("_given") == "") | (F.col("_right") == ""), REASON_NO_ANSWER)
        .when(marked & ~same, REASON_COLLECTED)
        .when(same, REASON_CONTRADICTION)
        .otherwise(REASON_NO_MARK)
    )
    status = (
        F.when(F.col("collection_reason") == REASON_MATCH_UNMARKED, "ignored")
        .when(F.col("collection_reason") == REASON_COLLECTED, "collected")
        .otherwise("pending_review")
    )
    return rows.withColumn("collection_reason", reason).withColumn("collection_status", status).drop("_given", "_right")


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def normalize_tags(
    tags: Column,
    question_type: Column,
    aliases: dict[str, str] = TAG_ALIASES,
    defaults: dict[str, str] = TAG_DEFAULTS,
) -> Column:
    """Chinese tags only, aliases translated, first occurrence kept, the type's own tag last."""
    bare = F.transform(tags, lambda t: strip(F.regexp_replace(strip(t), r"^#+", "")))
    named = F.transform(
        bare,
        lambda t: F.coalesce(
            F.try_element_at(_literal_map(aliases), F.lower(t)),
            F.when(t.rlike(r"[\x{3400}-\x{9fff}]"), t),
        ),
    )
    kept = F.array_distinct(F.filter(named, lambda t: t.isNotNull() & (t != "")))
    default = F.try_element_at(_literal_map(defaults), question_type)
    return F.when(default.isNull() | F.array_contains(kept, default), kept).otherwise(F.array_append(kept, default))


def drop_duplicate_candidates(candidates: DataFrame) -> DataFrame:
    """Drop pending and ignored candidates that repeat a collected one of the same image."""
    identity = ["_instruction", "_prompt", "_text", "_answer", "_type"]
    rows = candidates
    for name, source in zip(identity, ("instruction", "prompt_text", "ocr_text", "ocr_answer")):
        rows = rows.withColumn(name, folded(F.col(source), "identity"))
    rows = rows.withColumn("_type", F.coalesce("question_type", F.lit("")))
    # One pass over the folded rows; only equal items of one image meet.
    alike = Window.partitionBy("image_id", *identity)
    rows = rows.withColumn("_repeats", F.max(F.col("collection_status") == "collected").over(alike))
    weak = F.col("collection_status").isin("pending_review", "ignored")
    return rows.filter(~(F.coalesce(weak, F.lit(False)) & F.coalesce("_repeats", F.lit(False)))).drop(*identity, "_repeats")


def persist_filter(candidates: DataFrame) -> DataFrame:
    """Strict corrections discard ignored candidates; other ignored ones wait for a decision."""
    ignored = F.col("collection_status") == "ignored"
    strict = F.coalesce(F.col("recognition_correction").isin("false_positives", "both"), F.lit(False))
    return candidates.filter(~(strict & ignored)).withColumn(
        "collection_status", F.when(ignored, "pending_review").otherwise(F.col("collection_status"))
    )


def image_rollup(images: DataFrame, persisted: DataFrame, items: DataFrame) -> DataFrame:
    """Images (id, subject…) after recognition: status, question_count and subject."""
    if "collection_status" in persisted.columns:
        pending = F.col("collection_status") == "pending_review"
        if "review_status" in persisted.columns:
            pending = F.when(F.col("collection_status").isNull(), F.col("review_status") == "needs_review").otherwise(pending)
    else:
        pending = F.col("review_status") == "needs_review"
    per_image = persisted.groupBy(F.col("image_id").alias("id")).agg(
        F.count("*").cast("int").alias("_n"), F.bool_or(pending).alias("_pending")
    )
    first = items.groupBy(F.col("image_id").alias("id")).agg(F.min_by("subject", "idx").alias("_subject"))
    done = images.drop("status", "question_count").join(first, "id").join(per_image, "id", "left")
    if "recognition_correction" in images.columns:  # settled: a later run must not see it
        kind = images.schema["recognition_correction"].dataType
        done = done.withColumn("recognition_correction", F.lit(None).cast(kind))
    return (
        done.withColumn("status", F.when(F.col("_pending"), "needs_review").otherwise("confirmed"))
        .withColumn("question_count", F.coalesce("_n", F.lit(0)))
        .withColumn("subject", F.coalesce(F.nullif(F.col("subject"), F.lit("")), "_subject"))
        .drop("_n", "_pending", "_subject")
    )


def failed_images(images: DataFrame, checked: DataFrame) -> DataFrame:
    """``images`` whose response cannot be used, as failed, with the code and message users see.

    ``checked``(image_id, error, valid, bad_fields): a response with an ``error`` of its own keeps
    that code; one that parses but breaks the schema gets its own code.
    """
    code = F.coalesce("error", F.when(~F.coalesce("valid", F.lit(False)), SCHEMA_INVALID))
    errors = checked.select(
        F.col("image_id").alias("id"),
        F.lit("recognition").alias("kind"),
        code.alias("code"),
        F.try_element_at(_literal_map(FAILURE_MESSAGES), code).alias("user_message"),
        F.create_map(F.lit("validation_fields"), F.array_join("bad_fields", ",")).alias("diagnostic"),
    ).filter("code IS NOT NULL")
    shown = failure_code(errors).select("id", "error_code", "error_message")
    rest = images.drop("status", "error_code", "error_message")
    return rest.join(shown, "id").withColumn("status", F.lit("failed"))


def _pixel_box() -> Column:
    return F.array("px_left", "px_top", "px_right", "px_bottom")


def mark_documents(evidence: DataFrame, rules: Thresholds = Thresholds()) -> DataFrame:
    """What questions store of their image's marks, one row per image_id with marks.

    ``evidence`` are rows of :func:`red_evidence`. Marks stand in the order of their ids; those of an
    unreadable image have no check and are all rejected. A list is as long as that of the response
    it came from, which was one row, and the rows hold numbers only.
    """
    kind = [c for c in ("mark_type",) if c in evidence.columns]
    mark = F.struct("mark_id", *kind, F.array("l", "t", "r", "b").alias("bbox"), "confidence")
    check = F.struct(
        "mark_id", "confidence", F.lit(rules.mark_confidence).alias("confidence_threshold"), _pixel_box().alias("pixel_box"),
        "red_pixel_count", "pixel_count", "red_pixel_ratio", F.lit(rules.red_min_ratio).alias("red_pixel_min_ratio"),
        "accepted", "reason",
    )
    row = F.struct("mark_id", "accepted", mark.alias("mark"), F.when(F.col("pixel_count").isNotNull(), check).alias("check"))
    listed = evidence.groupBy("image_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    ids = lambda wanted: F.transform(F.filter("_rows", wanted), lambda x: x["mark_id"])
    return listed.select(
        "image_id",
        F.transform("_rows", lambda x: x["mark"]).alias("error_marks"),
        F.transform(F.filter("_rows", lambda x: x["check"].isNotNull()), lambda x: x["check"]).alias("error_mark_validation"),
        ids(lambda x: x["accepted"]).alias("valid_error_mark_ids"),
        ids(lambda x: ~x["accepted"]).alias("rejected_error_mark_ids"),
    )


def localization_documents(located: DataFrame, checks: DataFrame, rules: Thresholds = Thresholds()) -> DataFrame:
    """What a question stores of its localization and of the red ink looked for there, by (image_id, idx).

    ``located`` are the localizations that stand, ``checks`` rows of :func:`local_red_evidence`; a
    localization that needed no check has none. A check without pixels says so.
    """
    box = F.array("l", "t", "r", "b")
    place = F.struct(
        F.col("idx").alias("index"), "matched", "mark_ids", F.when(F.col("l").isNotNull(), box).alias("bbox"),
        "observed_prompt_text", "observed_raw_text", "confidence",
    )
    seen = F.col("pixel_count").isNotNull()
    reason = F.when(~seen, "image_invalid").when(F.col("red_verified"), "accepted").otherwise("insufficient_red_pixels")
    check = F.struct(
        F.when(seen, _pixel_box()).alias("pixel_box"), "red_pixel_count", "pixel_count", "red_pixel_ratio",
        F.when(seen, F.lit(rules.red_min_ratio)).alias("red_pixel_min_ratio"), F.col("red_verified").alias("accepted"),
        reason.alias("reason"), F.when(seen, box).alias("bbox"), F.when(seen, F.lit(rules.red_expansion)).alias("expansion_ratio"),
    )
    checked = checks.select("image_id", "idx", check.alias("localization_red_validation"))
    return located.select("image_id", "idx", place.alias("localization")).join(checked, ["image_id", "idx"], "left")


def question_rows(
    candidates: DataFrame,
    images: DataFrame,
    rules: Thresholds = Thresholds(),
    run: str = "",
    marks: DataFrame | None = None,
    places: DataFrame | None = None,
) -> DataFrame:
    """``candidates`` as rows of wrong_questions, with the student, grade and semester of their image.

    ``crop_region`` is complete, also where a region is unverified, and ``ocr_raw_json`` holds the
    recognised item, what the decision rests on and the local reading, and, given ``marks`` and ``places``
    (:func:`mark_documents`, :func:`localization_documents`), the image's marks with their checks and
    the question's localization. Those meet the questions only here, after the last one was dropped.
    Ids hash (image_id, idx, run), so the same run makes the same ones and recognising an image
    anew makes others.
    """
    beside = []
    if places is not None:
        candidates = candidates.join(places, ["image_id", "idx"], "left")
        beside += ["localization", "localization_red_validation"]
    if marks is not None:
        listed = [c for c in marks.columns if c != "image_id"]
        # An image without marks has empty lists.
        none = {c: F.coalesce(c, F.array().cast(marks.schema[c].dataType)) for c in listed}
        candidates = candidates.join(marks, "image_id", "left").withColumns(none)
        beside += listed
    known = F.col("crop_region").isNotNull()
    region = F.struct(
        F.col("crop_region.bbox").alias("bbox"),
        F.when(known, BOX_FORMAT).alias("bbox_format"),
        F.col("bbox_source"),
        F.col("crop_region.bbox_confidence").alias("bbox_confidence"),
        F.when(known, "verified").otherwise("needs_review").alias("localization_status"),
        F.col("crop_region.mark_ids").alias("mark_ids"),
        F.col("idx").alias("index"),
        F.when(known & F.lit(rules.padding > 0), F.col("crop_region.localization_bbox")).alias("localization_bbox"),
        F.when(known & F.lit(rules.padding > 0), F.lit(rules.padding)).alias("display_context_padding_ratio"),
    )
    item = [F.col(c) for c in ITEM_FIELDS if c in candidates.columns and c != "tags"]
    reading = F.struct(
        F.col("ocr_status").alias("status"), F.col("ocr_matched_index").alias("matched_index"),
        F.coalesce("ocr_text_summary", F.lit("")).alias("text_summary"), F.col("ocr_confidence").alias("confidence"),
    )
    document = F.struct(
        F.lit(PROVIDER).alias("provider"), *item, F.col("_read_tags").alias("tags"), "reliable_error_mark", "collection_reason",
        reading.alias("local_ocr"), *beside, *[c for c in ("ignored_text",) if c in candidates.columns],
    )
    own = [c for c in ("student_id", "grade", "semester") if c in images.columns]
    home = images.select(F.col("id").alias("image_id"), *own)
    return candidates.drop(*own).join(home, "image_id").select(
        F.sha2(F.concat_ws("\x1f", F.lit("question"), F.col("image_id").cast("string"), F.col("idx").cast("string"), F.lit(run)), 256).alias("id"),
        "image_id", *own, F.col("idx"), region.alias("crop_region"), "subject", "ocr_text", "ocr_answer",
        document.alias("ocr_raw_json"), "question_type", "tags", "difficulty", "review_status", "collection_status",
    )


def failure_code(errors: DataFrame) -> DataFrame:
    """Adds what users and logs may see of a failure.

    ``errors``(kind, code, user_message, diagnostic map<string,string>): kind 'recognition'
    keeps its own code and message, anything else becomes the internal error. Only allowed
    diagnostic keys of recognition errors stay.
    """
    own = F.col("kind") == "recognition"
    code = F.when(F.col("user_message").isNull(), INVALID_RESPONSE[0]).otherwise(F.col("code"))
    message = F.coalesce("user_message", F.lit(INVALID_RESPONSE[1]))
    empty = F.create_map().cast("map<string,string>")
    shown = F.map_filter("diagnostic", lambda k, _: k.isin(DIAGNOSTIC_KEYS))
    return (
        errors.withColumn("error_code", F.when(own, code).otherwise(INTERNAL_ERROR[0]))
        .withColumn("error_message", F.when(own, message).otherwise(INTERNAL_ERROR[1]))
        .withColumn("safe_diagnostic", F.when(own, F.coalesce(shown, empty)).otherwise(empty))
    )

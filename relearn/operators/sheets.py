"""Building practice sheets: selection, printable text, derivative planning and checking.

A sheet is rows keyed by sheet_id with the question's position; nothing gathers a sheet into
one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relearn.functions import strict
from relearn.functions.ranks import HOT_ROWS, pin, rank_rows, spread
from relearn.functions.text import casefold_words, is_blank, strip
from relearn.functions.times import whole_seconds_between
from relearn.operators.library import visible_questions
from relearn.operators.recognition import QUESTION_TYPES
from relearn.sources.changes import overlay
from relearn.sources.responses import variant_kind

# Fixed values of the service.
DEFAULT_TITLE = "错题重练"
DEFAULT_STUDENT = "学生"
SUBJECT_LABELS = {"math": "数学", "chinese": "语文", "english": "英语"}
ANSWER_LINE = "________________"
TOP_DIFFICULTY = 5
DEFAULT_DIFFICULTY = 2
DEFAULT_BOOST = 2
FAILURES = {
    "timeout": ("sheet_generation_timeout", "错题集生成超时，请重试或减少题目数量"),
    "derivative": ("sheet_derivative_failed", "衍生题生成失败，请重试或调整为仅原题"),
    "questions": ("sheet_questions_unavailable", "部分错题已不可用，请重新选择后生成"),
    "pdf": ("sheet_pdf_failed", "错题集 PDF 生成失败，请稍后重试"),
    "other": ("sheet_generation_failed", "错题集生成失败，请稍后重试"),
}


def select_sheet_questions(
    requests: DataFrame, lines: DataFrame, questions: DataFrame
) -> dict[str, DataFrame]:
    """Check requests(request_id, student_id) with lines(request_id, pos, question_id).

    Verdicts: empty, duplicates, unavailable, ok, in that order. ``selected`` holds the
    questions of the good requests; ``pos`` is the order asked for.
    """
    owned = visible_questions(questions).withColumnRenamed("id", "question_id").withColumn("_own", F.lit(True))
    asked = lines.select("request_id", "pos", "question_id").join(requests.select("request_id", "student_id"), "request_id")
    found = asked.join(owned, ["question_id", "student_id"], "left")
    per_question = found.groupBy("request_id", "question_id").agg(
        F.count("*").alias("_n"), F.bool_or(F.col("_own").isNotNull()).alias("_own")
    )
    counts = per_question.groupBy("request_id").agg(
        F.max("_n").alias("_most"), F.bool_and("_own").alias("_all")
    )
    verdict = (
        F.when(F.col("_most").isNull(), "empty")
        .when(F.col("_most") > 1, "duplicates")
        .when(~F.col("_all"), "unavailable")
        .otherwise("ok")
    )
    verdicts = requests.select("request_id").join(counts, "request_id", "left").select("request_id", verdict.alias("verdict"))
    good = verdicts.filter("verdict = 'ok'").select("request_id")
    return {"verdicts": verdicts, "selected": found.join(good, "request_id", "left_semi").drop("_own")}


def display_text(instruction: Column, prompt: Column, question_type: Column) -> Column:
    """What is printed for a question; the answer never is."""
    return (
        F.when(question_type == "write_pinyin", F.concat(F.lit("给“"), prompt, F.lit(f"”写拼音：{ANSWER_LINE}")))
        .when(question_type == "write_word", F.concat(F.lit("根据拼音“"), prompt, F.lit(f"”写词语：{ANSWER_LINE}")))
        .otherwise(F.concat(instruction, F.lit("\n"), prompt, F.lit(f"\n{ANSWER_LINE}")))
    )


def printable_questions(questions: DataFrame, raw: str = "ocr_raw_json") -> DataFrame:
    """Adds instruction, prompt_text, question_type, display_text, answer and ``printable``.

    Both texts come from the recognition document and are required; an unknown type is other.
    """

    def field(name: str) -> Column:
        return strip(F.coalesce(F.get_json_object(raw, f"$.{name}"), F.lit("")))

    kind = field("question_type")
    kind = F.when(kind.isin(QUESTION_TYPES), kind).otherwise("other")
    rows = (
        questions.withColumn("instruction", field("instruction"))
        .withColumn("prompt_text", field("prompt_text"))
        .withColumn("question_type", kind)
    )
    ok = (F.col("instruction") != "") & (F.col("prompt_text") != "")
    text = display_text(F.col("instruction"), F.col("prompt_text"), F.col("question_type"))
    return (
        rows.withColumn("printable", ok)
        .withColumn("display_text", F.when(ok, text))
        .withColumn("answer", strip(F.nullif(F.col("ocr_answer"), F.lit(""))))
    )


def missing_prompts(printable: DataFrame, key: str = "sheet_id") -> DataFrame:
    """Questions per sheet that cannot be printed; sheets without any are absent."""
    return printable.filter(~F.col("printable")).groupBy(key).agg(F.count("*").alias("missing_count"))


def plan_derivatives(selected: DataFrame, batch_size: int = 8) -> DataFrame:
    """Adds difficulty, target_difficulty, subject and batch_no to selected questions.

    Uses difficulty_boost (default 2) of the sheet where that column exists.
    """
    boost = F.coalesce("difficulty_boost", F.lit(DEFAULT_BOOST)) if "difficulty_boost" in selected.columns else F.lit(DEFAULT_BOOST)
    level = F.coalesce(F.nullif(F.col("difficulty"), F.lit(0)), F.lit(DEFAULT_DIFFICULTY))
    return (
        selected.withColumn("difficulty", level.cast("int"))
        .withColumn("target_difficulty", F.least(F.lit(TOP_DIFFICULTY), F.col("difficulty") + boost).cast("int"))
        .withColumn("subject", F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit("math")))
        .withColumn("batch_no", F.floor(F.col("pos") / F.lit(batch_size)).cast("int"))
    )


def question_identity(instruction: Column, prompt: Column, question_type: Column) -> Column:
    """Case-folded printed text with collapsed blanks: what makes two questions copies."""
    return casefold_words(display_text(instruction, prompt, question_type))


def validate_derivatives(requested: DataFrame, payloads: DataFrame, count: int) -> dict[str, DataFrame]:
    """Check generated variants batch by batch.

    ``requested``(batch_id, source_id, instruction, prompt_text, question_type) are the
    originals; ``payloads`` adds variant and answer. A batch fails as a whole: invalid_fields,
    source_mismatch, count_invalid or duplicate_question. Good batches come back as rows.
    """
    texts = ("instruction", "prompt_text", "answer")
    bad = ~F.coalesce(F.col("question_type").isin(QUESTION_TYPES), F.lit(False))
    for name in texts:
        bad = bad | is_blank(F.col(name))
    clean = payloads.withColumn("_bad", bad)
    for name in texts:
        clean = clean.withColumn(name, strip(F.col(name)))
    identity = question_identity(F.col("instruction"), F.col("prompt_text"), F.col("question_type"))
    variants = clean.select("batch_id", "source_id", identity.alias("_identity"), "_bad", F.lit(1).alias("_variant"))
    originals = requested.select("batch_id", "source_id", identity.alias("_identity"), F.lit(False).alias("_bad"), F.lit(0).alias("_variant"))
    per_text = variants.union(originals).groupBy("batch_id", "source_id", "_identity").agg(
        F.count("*").alias("_copies"),
        F.sum("_variant").alias("_variants"),
        F.bool_or("_bad").alias("_bad"),
    )
    per_source = per_text.groupBy("batch_id", "source_id").agg(
        F.max("_copies").alias("_copies"),
        F.sum("_variants").alias("_variants"),
        F.sum(F.col("_copies") - F.col("_variants")).alias("_asked"),
        F.bool_or("_bad").alias("_bad"),
    )
    per_batch = per_source.groupBy("batch_id").agg(
        F.bool_or("_bad").alias("_bad"),
        F.bool_or((F.col("_asked") == 0) | (F.col("_variants") == 0)).alias("_sources"),
        F.bool_or(F.col("_variants") != count).alias("_count"),
        F.bool_or(F.col("_copies") > 1).alias("_twice"),
    )
    verdict = (
        F.when(F.col("_bad"), "invalid_fields")
        .when(F.col("_sources"), "source_mismatch")
        .when(F.col("_count"), "count_invalid")
        .when(F.col("_twice"), "duplicate_question")
        .otherwise("ok")
    )
    verdicts = per_batch.select("batch_id", verdict.alias("verdict"))
    good = clean.drop("_bad").join(verdicts.filter("verdict = 'ok'"), "batch_id", "left_semi")
    text = display_text(F.col("instruction"), F.col("prompt_text"), F.col("question_type"))
    return {"verdicts": verdicts, "variants": good.withColumn("display_text", text)}


VARIANT = strict.record(
    {
        "instruction": strict.text(blank=False),
        "prompt_text": strict.text(blank=False),
        "question_type": strict.text(choices=QUESTION_TYPES),
        "answer": strict.text(blank=False),
    }
)
PAYLOAD = strict.record({"items": strict.listed(strict.record({"source_id": strict.text(), "variants": strict.listed(VARIANT)}))})
PAYLOAD_ROWS = (
    "items array<struct<source_id:string,variants:array<struct<instruction:string,prompt_text:string,"
    "question_type:string,answer:string>>>>"
)


def parse_payloads(requested: DataFrame, documents: DataFrame, count: int, payload: str = "payload_json", shown: int = 5) -> dict[str, DataFrame]:
    """Read generated documents (batch_id, payload) strictly and check them against what was requested.

    ``verdicts``: batch_id, verdict and bad_fields. A batch fails as a whole, by the first of
    invalid_fields, duplicate_source (a source returned twice), source_mismatch, count_invalid and
    duplicate_question. ``variants``: rows of the good batches, numbered as they stand. ``requested`` is that of
    :func:`validate_derivatives`; its source ids are compared as texts.
    """
    # The check is long and several steps read it; calling this runs jobs.
    read = pin(spread(documents).select("batch_id", payload, strict.faults(F.col(payload), PAYLOAD).alias("_bad")))
    read = read.withColumn("bad_fields", F.slice("_bad", 1, shown))
    found = F.from_json(payload, PAYLOAD_ROWS)["items"]
    given = read.filter(F.size("_bad") == 0).select("batch_id", F.explode(found).alias("x"))
    given = given.select("batch_id", F.col("x.source_id").alias("_source"), F.col("x.variants").alias("_variants"))
    asked = requested.select("batch_id", F.col("source_id").cast("string").alias("_source"), F.lit(1).alias("_asked"))
    asked = asked.join(given.select("batch_id").distinct(), "batch_id", "left_semi")
    met = given.select("batch_id", "_source", F.lit(0).alias("_asked"), F.lit(1).alias("_given"), (F.size("_variants") != count).alias("_count"))
    met = met.unionByName(asked.withColumns({"_given": F.lit(0), "_count": F.lit(False)}))
    per_source = met.groupBy("batch_id", "_source").agg(F.sum("_asked").alias("_asked"), F.sum("_given").alias("_given"), F.bool_or("_count").alias("_count"))
    per_batch = per_source.groupBy("batch_id").agg(
        F.bool_or(F.col("_given") > 1).alias("_twice"),
        F.bool_or((F.col("_asked") == 0) | (F.col("_given") == 0)).alias("_differ"),
        F.bool_or("_count").alias("_count"),
    )
    early = (
        F.when(F.size("bad_fields") > 0, "invalid_fields")
        .when(F.col("_twice"), "duplicate_source")
        .when(F.col("_differ") | F.col("_twice").isNull(), "source_mismatch")
        .when(F.col("_count"), "count_invalid")
    )
    judged = read.join(per_batch, "batch_id", "left").select("batch_id", "bad_fields", early.alias("_early"))
    open_ids = judged.filter("_early IS NULL").select("batch_id")
    rows = given.join(open_ids, "batch_id", "left_semi").select("batch_id", "_source", F.posexplode("_variants").alias("variant", "v"))
    ids = requested.select("batch_id", "source_id", F.col("source_id").cast("string").alias("_source"))
    rows = rows.join(ids, ["batch_id", "_source"]).select("batch_id", "source_id", "variant", "v.*")
    checked = validate_derivatives(requested.join(open_ids, "batch_id", "left_semi"), rows, count)
    late = checked["verdicts"].withColumnRenamed("verdict", "_late")
    verdict = F.coalesce("_early", "_late", F.lit("ok"))
    verdicts = judged.join(late, "batch_id", "left").select("batch_id", verdict.alias("verdict"), "bad_fields")
    return {"verdicts": verdicts, "variants": checked["variants"]}


def expand_sheet_items(originals: DataFrame, variants: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sheet items: every original followed by its variants, numbered from 0 without gaps.

    ``originals``(sheet_id, pos, question_id, display_text), ``variants``(sheet_id,
    source_id, variant, display_text).
    """
    first = originals.select(
        "sheet_id", "pos", F.lit(-1).alias("variant"), "question_id", "display_text"
    )
    places = originals.select("sheet_id", "pos", F.col("question_id").alias("source_id"))
    derived = variants.join(places, ["sheet_id", "source_id"]).select(
        "sheet_id", "pos", F.col("variant").cast("int").alias("variant"), F.col("source_id").alias("question_id"), "display_text"
    )
    rows = rank_rows(first.union(derived), ["sheet_id"], [F.col("pos").asc(), F.col("variant").asc()], "_rank", hot_rows)
    original = F.col("variant") < 0
    kind = F.when(original, "original").otherwise("derived")
    order = (F.col("_rank") - 1).cast("int")
    return rows.select(
        "sheet_id",
        F.col("question_id").alias("wrong_question_id"),
        kind.alias("question_type"),
        F.when(~original, F.col("question_id")).alias("derived_from"),
        F.col("display_text").alias("question_text"),
        F.struct(
            kind.alias("question_type"),
            F.col("display_text").alias("question_text"),
            F.col("question_id").alias("source_wrong_question_id"),
            order.alias("sort_order"),
        ).alias("question_snapshot"),
        order.alias("sort_order"),
        F.when(original, "vision").otherwise("llm").alias("generation_method"),
    )


def split_answer_line(text: Column) -> Column:
    """Struct of the prompt and whether the text ended in an underscore answer line."""
    value = F.coalesce(text, F.lit(""))
    line = r"(?U)_{4,}\s*\z"
    has_line = value.rlike(line)
    prompt = F.regexp_replace(F.regexp_replace(value, line, ""), r"(?U)\s+\z", "")
    return F.struct(
        F.when(has_line, prompt).otherwise(value).alias("prompt"), has_line.alias("has_answer_line")
    )


def sheet_document(sheets: DataFrame, originals: DataFrame, variants: DataFrame) -> DataFrame:
    """Printed rows of each sheet with its headings, free of answers.

    ``sheets``(sheet_id, title, student_name), ``originals`` and ``variants`` as for
    ``expand_sheet_items``, originals with subject. Rows read in (group_no, variant) order;
    the sheet's subject is its first question's.
    """
    labels = F.create_map(*[F.lit(x) for pair in SUBJECT_LABELS.items() for x in pair])
    lead = originals.groupBy("sheet_id").agg(F.min_by("subject", "pos").alias("_subject"))
    heads = sheets.join(lead, "sheet_id").select(
        "sheet_id",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(DEFAULT_TITLE)).alias("title"),
        F.coalesce(F.nullif(F.col("student_name"), F.lit("")), F.lit(DEFAULT_STUDENT)).alias("student_name"),
        F.coalesce(F.try_element_at(labels, F.col("_subject")), F.col("_subject")).alias("subject"),
    )
    first = originals.select("sheet_id", F.col("pos").alias("group_no"), F.lit(-1).alias("variant"), "display_text")
    places = originals.select("sheet_id", F.col("pos").alias("group_no"), F.col("question_id").alias("source_id"))
    derived = variants.join(places, ["sheet_id", "source_id"]).select(
        "sheet_id", "group_no", F.col("variant").cast("int").alias("variant"), "display_text"
    )
    split = split_answer_line(F.col("display_text"))
    return first.union(derived).join(heads, "sheet_id").withColumn("_split", split).select(
        "sheet_id", "title", "student_name", "subject", "group_no", "variant",
        F.when(F.col("variant") < 0, "original").otherwise("derived").alias("kind"),
        F.col("_split.prompt").alias("prompt"),
        F.col("_split.has_answer_line").alias("has_answer_line"),
    )


def generation_state(sheets: DataFrame, events: DataFrame) -> DataFrame:
    """Sheets after one event(sheet_id, event, at, completed, error_kind, phase) each, the earliest that fits.

    claim: pending → processing. progress and complete need processing. fail applies unless
    completed. retry puts a failed sheet back. Events that do not fit change nothing.
    """
    now = events.select(F.col("sheet_id").alias("id"), "event", "at", "completed", "error_kind", "phase")
    joined = sheets.join(now, "id")
    status, event = F.col("generation_status"), F.col("event")
    applies = (
        ((event == "claim") & (status == "pending"))
        | (event.isin("progress", "complete") & (status == "processing"))
        | ((event == "fail") & (status != "completed"))
        | ((event == "retry") & (status == "failed"))
    )
    kind = F.when(F.col("error_kind").isin("timeout", "derivative", "questions"), F.col("error_kind")).otherwise(
        F.when(F.col("phase") == "pdf", "pdf").otherwise("other")
    )
    codes = F.create_map(*[F.lit(x) for k, v in FAILURES.items() for x in (k, v[0])])
    texts = F.create_map(*[F.lit(x) for k, v in FAILURES.items() for x in (k, v[1])])
    none = F.lit(None).cast("string")
    keep = lambda name: F.col(name)
    clears = event.isin("claim", "complete", "retry")
    started, at = F.col("generation_started_at"), F.col("at")
    fitting = joined.filter(applies)
    # Ties in time go by the event's other fields, so that a repeated run decides alike.
    rank = F.struct("at", "event", "completed", "error_kind", "phase")
    first = fitting.groupBy("id").agg(F.min(rank).alias("_e")).select("id", "_e.*")
    updates = first.join(sheets, "id").select(
        "id",
        F.when(event == "claim", "processing").when(event == "complete", "completed").when(event == "fail", "failed")
        .when(event == "retry", "pending").otherwise(status).alias("generation_status"),
        F.when(event.isin("claim", "retry"), 0).when(event == "progress", F.col("completed"))
        .when(event == "complete", F.col("generation_total")).otherwise(keep("generation_completed"))
        .cast("int").alias("generation_completed"),
        F.when(event == "fail", F.try_element_at(codes, kind)).when(clears, none)
        .otherwise(keep("generation_error_code")).alias("generation_error_code"),
        F.when(event == "fail", F.try_element_at(texts, kind)).when(clears, none)
        .otherwise(keep("generation_error_message")).alias("generation_error_message"),
        F.when(event == "claim", at).otherwise(started).alias("generation_started_at"),
        F.when(event == "complete", whole_seconds_between(started, at))
        .when(event == "claim", F.lit(None).cast("int"))
        .otherwise(keep("generation_duration_seconds")).alias("generation_duration_seconds"),
    )
    return overlay(sheets, updates)


def batch_usage(calls: DataFrame, usage: str = "usage", key: str = "batch_id") -> DataFrame:
    """Usage counters per batch: whole numbers of the usage document, booleans left out."""
    counters = F.map_filter(
        F.from_json(usage, "map<string,variant>"), lambda _, v: variant_kind(v) == "BIGINT"
    )
    rows = calls.select(key, F.explode(counters).alias("counter", "_v"))
    return rows.groupBy(key, "counter").agg(F.sum(F.try_variant_get("_v", "$", "long")).alias("total"))

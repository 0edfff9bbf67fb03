"""Grading practice attempts and keeping each question's mastery.

Grading works on flat rows: one row per (attempt, sheet item). Aggregates run in two levels,
first per (attempt, question), so neither a busy sheet nor a busy question meets in one task
before it has been reduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relearn.functions.ranks import HOT_ROWS, null_safe_on, page_rows, pin, rank_rows, running_sum_and_floor
from relearn.operators.lifecycle import cleanup_jobs_for
from relearn.sources.changes import overlay

ARRIVAL = ("created_at", "id")


def source_question(items: DataFrame, name: str = "source_question_id") -> DataFrame:
    """The question an item practises: its own reference, else the one kept in its snapshot."""
    return items.withColumn(
        name, F.coalesce("wrong_question_id", "question_snapshot.source_wrong_question_id")
    )


def answer_coverage(attempts: DataFrame, items: DataFrame, answers: DataFrame) -> DataFrame:
    """Verdict per attempt on whether its answers cover exactly the sheet's items.

    empty, duplicate, missing, extra are checked in that order; the rest is ok. Only counts
    meet per attempt; items are never paired with attempts.
    """
    expected = items.groupBy("sheet_id").agg(F.count("*").alias("n_items"))
    known = items.select(F.col("id").alias("sheet_item_id"), F.col("sheet_id").alias("_home"))
    heads = attempts.select(F.col("id").alias("attempt_id"), "sheet_id")
    per_item = answers.groupBy("attempt_id", "sheet_item_id").agg(F.count("*").alias("_n"))
    # An attempt is down to one row per sheet its answers point at before it meets its own sheet.
    per_home = per_item.join(known, "sheet_item_id", "left").groupBy("attempt_id", "_home").agg(
        F.max("_n").alias("_n"), F.count("*").alias("_items")
    )
    hit = F.col("_home").eqNullSafe(F.col("sheet_id"))
    counts = per_home.join(heads, "attempt_id").groupBy("attempt_id").agg(
        F.max("_n").alias("_most"),
        F.sum(F.when(hit, F.col("_items")).otherwise(0)).alias("_hits"),
        F.sum(F.when(hit, 0).otherwise(F.col("_items"))).alias("_extra"),
    )
    verdict = (
        F.when(F.col("_most").isNull() | F.col("n_items").isNull(), "empty")
        .when(F.col("_most") > 1, "duplicate")
        .when(F.col("_hits") < F.col("n_items"), "missing")
        .when(F.col("_extra") > 0, "extra")
        .otherwise("ok")
    )
    return (
        heads.join(counts, "attempt_id", "left")
        .join(expected, "sheet_id", "left")
        .select("attempt_id", "sheet_id", verdict.alias("verdict"))
    )


def graded_answers(attempts: DataFrame, items: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of fully covered attempts with their item's question: the input of grading."""
    covered = answer_coverage(attempts, items, answers).filter("verdict = 'ok'").select("attempt_id")
    facts = source_question(items).select(
        F.col("id").alias("sheet_item_id"), "wrong_question_id", "source_question_id", "question_snapshot"
    )
    return answers.join(covered, "attempt_id", "left_semi").join(facts, "sheet_item_id")


def group_results(graded: DataFrame) -> DataFrame:
    """Per attempt and source question: item count and whether every answer was right.

    Items without a source question form a group of their own.
    """
    return graded.groupBy("attempt_id", "source_question_id").agg(
        F.count("*").alias("n_items"), F.bool_and("is_correct").alias("all_correct")
    )


def exact_accuracy(correct: Column, total: Column) -> Column:
    """correct / total as DECIMAL(5,4), rounded half up in whole-number arithmetic.

    Rounding a quotient that was itself rounded could differ in the last digit.
    """
    ten_thousandths = F.floor((correct * 20000 + total) / (total * 2)).cast("decimal(9,0)")
    return (ten_thousandths * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(5,4)")


def attempt_summary(graded: DataFrame) -> DataFrame:
    """Item counts and accuracy per attempt."""
    counts = graded.groupBy("attempt_id").agg(
        F.count_if("is_correct").alias("correct_count"), F.count("*").alias("total_count")
    )
    return counts.withColumn("accuracy", exact_accuracy(F.col("correct_count"), F.col("total_count")))


def number_attempts(new: DataFrame, existing: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """attempt_no of arriving attempts: they continue each sheet's numbering in arrival order."""
    used = existing.groupBy("sheet_id").agg(F.max("attempt_no").alias("_last"))
    ranked = rank_rows(new, ["sheet_id"], [F.col(c).asc() for c in ARRIVAL], "_rank", hot_rows)
    return (
        ranked.join(used, "sheet_id", "left")
        .withColumn("attempt_no", (F.coalesce("_last", F.lit(0)) + F.col("_rank")).cast("int"))
        .drop("_last", "_rank")
    )


def dedup_attempts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Verdict for every arriving attempt on its (student, idempotency key).

    The stored attempt, else the first arrival, owns the key. Other rows are a replay of the
    owner, or a conflict when they name another sheet.
    """
    key = ["student_id", "idempotency_key"]
    first = new.groupBy(*key).agg(F.min(F.struct("created_at", "id", "sheet_id")).alias("_first"))
    stored = existing.select(*key, F.col("id").alias("_id"), F.col("sheet_id").alias("_sheet"))
    owners = first.join(stored, key, "left").select(
        *key,
        F.coalesce("_id", "_first.id").alias("owner_id"),
        F.coalesce("_sheet", "_first.sheet_id").alias("_owner_sheet"),
        F.col("_id").isNull().alias("_fresh"),
    )
    verdict = (
        F.when(F.col("_fresh") & (F.col("id") == F.col("owner_id")), "accepted")
        .when(F.col("sheet_id") == F.col("_owner_sheet"), "replay")
        .otherwise("conflict")
    )
    return new.join(owners, key).withColumn("verdict", verdict).drop("_owner_sheet", "_fresh")


def build_results(graded: DataFrame, groups: DataFrame) -> DataFrame:
    """Result rows: every answered item with the number of derived siblings of its question."""
    side = groups.select(
        F.col("attempt_id").alias("_attempt"),
        F.col("source_question_id").alias("_source"),
        (F.col("n_items") - 1).alias("_derived"),
    )
    on = null_safe_on(graded, side, [("attempt_id", "_attempt"), ("wrong_question_id", "_source")])
    return graded.join(side, on, "left").select(
        "attempt_id",
        "sheet_item_id",
        "wrong_question_id",
        "is_correct",
        F.coalesce("_derived", F.lit(0)).cast("int").alias("derived_count"),
        "question_snapshot",
    )


def wrong_count_delta(previous: Column, current: Column) -> Column:
    """Change of wrong_count when a group's verdict moves from ``previous`` (null: none) to ``current``."""
    return (
        F.when(previous.isNull(), F.when(current, 0).otherwise(1))
        .when(previous == current, 0)
        .otherwise(F.when(current, -1).otherwise(1))
    )


def apply_wrong_count(
    questions: DataFrame, deltas: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """wrong_count after each delta(question_id, seq, delta): never below 1 at any step.

    With S the running sum and m its running minimum, clamping at 1 on every step equals
    greatest(start + S, 1 + S - m), so no step-by-step loop is needed.
    """
    run = running_sum_and_floor(deltas, ["question_id"], [F.col("seq").asc()], "delta", "_s", "_m", hot_rows)
    start = questions.select(
        F.col("id").alias("question_id"),
        F.coalesce(F.nullif(F.col("wrong_count"), F.lit(0)), F.lit(1)).alias("_start"),
    )
    clamped = F.greatest(F.col("_start") + F.col("_s"), 1 + F.col("_s") - F.col("_m"))
    return run.join(start, "question_id").select(
        "question_id", "seq", "delta", clamped.cast("int").alias("wrong_count")
    )


def latest_attempt_by_question(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """The newest attempt touching each question over all sheets, by (created_at, id)."""
    times = attempts.select(F.col("id").alias("attempt_id"), "created_at")
    return newest_touch(results.select("attempt_id", "wrong_question_id").join(times, "attempt_id"))


def newest_touch(touched: DataFrame) -> DataFrame:
    """The newest of the attempts(attempt_id, wrong_question_id, created_at) that touch each question."""
    newest = touched.filter(F.col("wrong_question_id").isNotNull()).groupBy(F.col("wrong_question_id").alias("question_id")).agg(
        F.max(F.struct("created_at", "attempt_id")).alias("_newest")
    )
    return newest.select("question_id", F.col("_newest.attempt_id").alias("latest_attempt_id"))


def mastery_state(
    questions: DataFrame, recorded: DataFrame, groups: DataFrame, latest: DataFrame
) -> DataFrame:
    """Question updates caused by the attempts in ``recorded``(id, student_id, completed_at).

    ``groups`` are their group results, with ``previous_correct`` when an attempt was edited.
    Only live questions of the attempt's student change. The mastery fields follow an attempt
    only if it is the question's latest overall; older ones change the count alone.
    """
    if "previous_correct" not in groups.columns:
        groups = groups.withColumn("previous_correct", F.lit(None).cast("boolean"))
    heads = recorded.select(F.col("id").alias("attempt_id"), "student_id", "completed_at")
    # Meeting on question and attempt together spreads a busy question over its attempts.
    newest = latest.select("question_id", F.col("latest_attempt_id").alias("attempt_id"), F.lit(True).alias("_newest"))
    touched = (
        groups.filter(F.col("source_question_id").isNotNull())
        .withColumnRenamed("source_question_id", "question_id")
        .join(heads, "attempt_id")
        .join(newest, ["question_id", "attempt_id"], "left")
    )
    is_latest = F.col("_newest")
    change = wrong_count_delta(F.col("previous_correct"), F.col("all_correct"))
    per_question = touched.groupBy("question_id", "student_id").agg(
        F.sum(change).alias("_delta"),
        F.bool_or(F.when(is_latest, F.col("all_correct"))).alias("_right"),
        F.max(F.when(is_latest, F.col("completed_at"))).alias("_at"),
    )
    own = questions.filter(F.col("deleted_at").isNull()).withColumnRenamed("id", "question_id")
    changed = own.join(per_question, ["question_id", "student_id"])
    moved = F.col("_right").isNotNull()
    start = F.coalesce(F.nullif(F.col("wrong_count"), F.lit(0)), F.lit(1))
    return changed.select(
        F.col("question_id").alias("id"),
        F.greatest(F.lit(1), start + F.col("_delta")).cast("int").alias("wrong_count"),
        F.when(F.col("_right"), "mastered").when(moved, "learning").otherwise(F.col("mastery_status")).alias("mastery_status"),
        F.when(F.col("_right"), F.col("_at")).when(moved, None).otherwise(F.col("mastered_at")).alias("mastered_at"),
        F.when(moved, F.col("_at")).otherwise(F.col("last_practiced_at")).alias("last_practiced_at"),
    )


def edit_attempts(
    attempts: DataFrame, items: DataFrame, results: DataFrame, edits: DataFrame, answers: DataFrame
) -> dict[str, DataFrame]:
    """Replace the answers of attempts. ``edits``(attempt_id, updated_at), ``answers`` as recorded.

    An edit counts only if it saw the stored version, the attempt is its sheet's latest, and
    both the stored and the new answers cover the sheet. Returns verdicts, the new summaries
    and the group changes. The verdicts are checkpointed, so calling this runs jobs.
    """
    newest = attempts.groupBy("sheet_id").agg(F.max_by("id", "attempt_no").alias("_newest"))
    stored = attempts.select(
        F.col("id").alias("attempt_id"), "sheet_id", "student_id", "completed_at",
        F.col("updated_at").alias("_stored_at"),
    )
    asked = edits.join(stored, "attempt_id", "left").join(newest, "sheet_id", "left")
    fresh = (F.col("updated_at") == F.col("_stored_at")) & (F.col("_newest") == F.col("attempt_id"))
    asked = asked.withColumn("_current", F.coalesce(fresh, F.lit(False)))
    current = asked.filter("_current").select(F.col("attempt_id").alias("id"), "sheet_id")

    after = answers.join(current.select(F.col("id").alias("attempt_id")), "attempt_id", "left_semi")
    before = results.join(current.select(F.col("id").alias("attempt_id")), "attempt_id", "left_semi").select(
        "attempt_id", "sheet_item_id", "is_correct"
    )
    covered = answer_coverage(current, items, after).select("attempt_id", F.col("verdict").alias("_after"))
    held = answer_coverage(current, items, before).select("attempt_id", F.col("verdict").alias("_before"))
    # Read four times below; the coverage counts behind it are made once.
    verdicts = pin(
        asked.join(covered, "attempt_id", "left")
        .join(held, "attempt_id", "left")
        .select(
            "attempt_id",
            F.when(~F.col("_current"), "conflict")
            .when(F.col("_before") != "ok", F.col("_before"))
            .when(F.col("_after") != "ok", F.col("_after"))
            .otherwise("accepted").alias("verdict"),
        )
    )
    accepted = verdicts.filter("verdict = 'accepted'").select("attempt_id")
    facts = source_question(items).select(F.col("id").alias("sheet_item_id"), "source_question_id")

    def groups_of(rows: DataFrame) -> DataFrame:
        return group_results(rows.join(accepted, "attempt_id", "left_semi").join(facts, "sheet_item_id"))

    old, new = groups_of(before), groups_of(after)
    old = old.select(
        F.col("attempt_id").alias("_a"), F.col("source_question_id").alias("_q"),
        F.col("all_correct").alias("previous_correct"),
    )
    on = null_safe_on(new, old, [("attempt_id", "_a"), ("source_question_id", "_q")])
    groups = new.join(old, on, "left").drop("_a", "_q")
    groups = groups.withColumn("delta", wrong_count_delta(F.col("previous_correct"), F.col("all_correct")))
    summaries = attempt_summary(after.join(accepted, "attempt_id", "left_semi"))
    return {"verdicts": verdicts, "summaries": summaries, "groups": groups}


def question_history(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """Per question: attempts that were not all correct, and the latest attempt's outcome."""
    times = attempts.select(F.col("id").alias("attempt_id"), "created_at", "completed_at")
    per_attempt = (
        results.filter(F.col("wrong_question_id").isNotNull())
        .groupBy(F.col("wrong_question_id").alias("question_id"), "attempt_id")
        .agg(F.bool_and("is_correct").alias("all_correct"))
        .join(times, "attempt_id")
    )
    newest = F.max(F.struct("created_at", "attempt_id", "all_correct", "completed_at"))
    return (
        per_attempt.groupBy("question_id")
        .agg(F.count_if(~F.col("all_correct")).alias("incorrect_attempt_count"), newest.alias("_newest"))
        .select(
            "question_id",
            "incorrect_attempt_count",
            F.col("_newest.all_correct").alias("latest_all_correct"),
            F.col("_newest.completed_at").alias("latest_completed_at"),
        )
    )


def reconcile_deleted_sheets(
    sheet_ids: DataFrame,
    sheets: DataFrame,
    items: DataFrame,
    attempts: DataFrame,
    results: DataFrame,
    questions: DataFrame,
) -> dict[str, DataFrame]:
    """Delete finished or failed sheets and settle the questions they practised.

    Wrong attempts that disappear are taken off the count, mastery is read again from what
    remains, and a question with nothing left is reset. Soft-deleted questions take part.
    Only questions of the sheet's own student are settled.
    """
    asked = sheets.join(sheet_ids.select("id").distinct(), "id", "left_semi")
    doomed = asked.filter(F.col("generation_status").isin("completed", "failed"))
    refused = asked.filter(~F.col("generation_status").isin("completed", "failed")).select("id", "generation_status")
    doomed_ids = doomed.select(F.col("id").alias("sheet_id"), F.col("student_id").alias("sheet_student_id"))

    gone = attempts.join(doomed_ids, "sheet_id")
    kept = attempts.join(doomed_ids, "sheet_id", "left_anti")
    gone_rows = results.join(gone.select(F.col("id").alias("attempt_id")), "attempt_id", "left_semi")
    kept_rows = results.join(kept.select(F.col("id").alias("attempt_id")), "attempt_id", "left_semi")

    owner = gone.select(F.col("id").alias("attempt_id"), "sheet_student_id")
    lost = (
        gone_rows.filter(F.col("wrong_question_id").isNotNull())
        .groupBy(F.col("wrong_question_id").alias("id"), "attempt_id")
        .agg(F.bool_and("is_correct").alias("_right"))
        .join(owner, "attempt_id")
        .groupBy("id", F.col("sheet_student_id").alias("student_id"))
        .agg(F.count_if(~F.col("_right")).alias("_lost"))
    )
    touched = questions.join(lost, ["id", "student_id"])
    asked_questions = touched.select(F.col("id").alias("wrong_question_id"))
    left = question_history(kept, kept_rows.join(asked_questions, "wrong_question_id", "left_semi"))
    state = touched.join(left.withColumnRenamed("question_id", "id"), "id", "left")
    start = F.coalesce(F.nullif(F.col("wrong_count"), F.lit(0)), F.lit(1))
    mastered = F.coalesce(F.col("latest_all_correct"), F.lit(False))
    updates = state.select(
        "id",
        F.greatest(F.lit(1), start - F.col("_lost")).cast("int").alias("wrong_count"),
        F.when(mastered, "mastered").otherwise("learning").alias("mastery_status"),
        F.when(mastered, F.col("latest_completed_at")).alias("mastered_at"),
        F.col("latest_completed_at").alias("last_practiced_at"),
    )
    return {
        "updates": updates,
        "questions": overlay(questions, updates),
        "sheets": sheets.join(doomed_ids.withColumnRenamed("sheet_id", "id"), "id", "left_anti"),
        "items": items.join(doomed_ids, "sheet_id", "left_anti"),
        "attempts": kept,
        "results": kept_rows,
        "refused": refused,
        "jobs": cleanup_jobs_for(doomed, "pdf_url", "pdf"),
    }


def first_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first arrival of every key."""
    return page_rows(df, keys, [F.col(c).asc() for c in ARRIVAL], 1, name="_first").drop("_first")

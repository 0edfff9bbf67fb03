"""Recording and editing attempts: the whole chain from duplicates to mastery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relearn.functions.ranks import pin
from relearn.functions.times import moment
from relearn.operators import practice as pr
from relearn.operators.library import practice_ready
from relearn.sources.changes import overlay

ATTEMPT_COLUMNS = [
    "id", "sheet_id", "student_id", "attempt_no", "idempotency_key", "correct_count", "total_count",
    "accuracy", "completed_at", "created_at", "updated_at",
]
RESULT_COLUMNS = ["attempt_id", "sheet_item_id", "wrong_question_id", "is_correct", "derived_count", "created_at"]


def record_attempts(
    new: DataFrame,
    answers: DataFrame,
    sheets: DataFrame,
    items: DataFrame,
    attempts: DataFrame,
    results: DataFrame,
    questions: DataFrame,
    history: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Grade ``new``(id, sheet_id, student_id, idempotency_key, completed_at, created_at).

    A verdict per attempt, in order: replay or conflict of its key, sheet_not_found,
    sheet_not_ready, then the coverage verdict; ok ones are stored. An attempt that is
    refused leaves its key free for the next arrival, so keys are settled among the
    gradable attempts only. Arrival order decides numbers. ``updates`` are the changed
    fields of questions, to be laid over the table. ``history``(attempt_id, wrong_question_id,
    created_at of the attempt) says when the stored results came to be; without it they meet ``attempts``.
    """
    ready = practice_ready(sheets).select(F.col("id").alias("sheet_id"), "student_id", "ready")
    # Only items that the batch can touch are counted and looked up; answers may name foreign ones.
    named = answers.select(F.col("sheet_item_id").alias("id")).distinct()
    ours = new.select("sheet_id").distinct().withColumn("_ours", F.lit(True))
    items = items.join(named.withColumn("_named", F.lit(True)), "id", "left").join(ours, "sheet_id", "left")
    items = pin(items.filter("_ours OR _named").drop("_ours", "_named"))
    placed = new.join(ready, ["sheet_id", "student_id"], "left")
    coverage = pr.answer_coverage(new, items, answers).select(F.col("attempt_id").alias("id"), F.col("verdict").alias("_coverage"))
    problem = (
        F.when(F.col("ready").isNull(), "sheet_not_found")
        .when(~F.col("ready"), "sheet_not_ready")
        .when(F.col("_coverage") != "ok", F.col("_coverage"))
    )
    judged = pin(placed.join(coverage, "id", "left").withColumn("_problem", problem).drop("ready", "_coverage"))
    # The stored attempt owns its key; otherwise the first gradable arrival does, and whatever
    # arrives after the owner only repeats it, gradable or not.
    key = ["student_id", "idempotency_key"]
    stored = attempts.join(new.select(*key).distinct(), key, "left_semi").select(
        *key, F.col("id").alias("_stored_id"), F.col("sheet_id").alias("_stored_sheet")
    )
    first = judged.filter("_problem IS NULL").groupBy(*key).agg(
        F.min(F.struct("created_at", "id", "sheet_id")).alias("_first")
    )
    keyed = judged.join(stored, key, "left").join(first, key, "left")
    own_sheet = F.coalesce("_stored_sheet", "_first.sheet_id")
    after_owner = F.struct("created_at", "id") > F.struct("_first.created_at", "_first.id")
    behind = F.col("_stored_id").isNotNull() | (F.col("_first").isNotNull() & after_owner)
    verdict = (
        F.when(behind & (own_sheet == F.col("sheet_id")), "replay")
        .when(behind, "conflict")
        .when(F.col("_problem").isNotNull(), F.col("_problem"))
        .otherwise("accepted")
    )
    recorded = F.coalesce("_stored_id", "_first.id")
    verdicts = pin(
        keyed.withColumn("verdict", verdict).select(
            "id", "verdict", F.when(behind | (F.col("verdict") == "accepted"), recorded).alias("recorded_id")
        )
    )
    accepted = new.join(verdicts.filter("verdict = 'accepted'").select("id"), "id", "left_semi")
    accepted_ids = accepted.select(F.col("id").alias("attempt_id"))
    facts = pr.source_question(items).select(
        F.col("id").alias("sheet_item_id"), "wrong_question_id", "source_question_id", "question_snapshot"
    )
    graded = pin(answers.join(accepted_ids, "attempt_id", "left_semi").join(facts, "sheet_item_id"))
    groups = pr.group_results(graded)
    summary = pr.attempt_summary(graded).withColumnRenamed("attempt_id", "id")
    same_sheets = attempts.join(accepted.select("sheet_id").distinct(), "sheet_id", "left_semi")
    numbered = pr.number_attempts(accepted, same_sheets).join(summary, "id")
    numbered = pin(
        numbered.withColumn("updated_at", F.col("created_at"))
        .withColumn("correct_count", F.col("correct_count").cast("int"))
        .withColumn("total_count", F.col("total_count").cast("int"))
        .select(*ATTEMPT_COLUMNS)
    )
    times = numbered.select(F.col("id").alias("attempt_id"), "created_at")
    new_results = pr.build_results(graded, groups).join(times, "attempt_id").select(*RESULT_COLUMNS)
    # Only the history of the questions at hand matters; their ids are few next to it.
    asked = graded.select(F.col("source_question_id").alias("wrong_question_id")).distinct()
    if history is None:
        past = results.select("attempt_id", "wrong_question_id").join(asked, "wrong_question_id", "left_semi")
        times = attempts.select(F.col("id").alias("attempt_id"), "created_at")
        past = past.join(times, "attempt_id")
    else:
        past = history.join(asked, "wrong_question_id", "left_semi")
    past = past.select("attempt_id", "wrong_question_id", "created_at").union(
        new_results.select("attempt_id", "wrong_question_id", "created_at")
    )
    latest = pr.newest_touch(past)
    updates = pr.mastery_state(questions, numbered, groups, latest)
    return {
        "verdicts": verdicts,
        "attempts": numbered,
        "results": new_results,
        "updates": updates,
    }


def record_edits(
    edits: DataFrame,
    answers: DataFrame,
    sheets: DataFrame,
    items: DataFrame,
    attempts: DataFrame,
    results: DataFrame,
    questions: DataFrame,
    now,
) -> dict[str, DataFrame]:
    """Replace the answers of stored attempts: ``edits``(attempt_id, student_id, updated_at as seen).

    A verdict per edit, in order: sheet_not_found unless sheet and attempt are the student's own,
    sheet_not_ready, then those of ``edit_attempts``; an unknown attempt is a conflict. Accepted ones
    give ``attempts`` (new summaries, updated at ``now``), ``results`` (their rows with the new
    answers) and ``updates`` of questions: counts move from the old verdict to the new one, mastery
    only where the attempt is the question's latest overall.
    """
    edits = edits.select("attempt_id", "student_id", "updated_at").distinct()
    home = attempts.select(F.col("id").alias("attempt_id"), "sheet_id", F.col("student_id").alias("_by"))
    ready = practice_ready(sheets).select(F.col("id").alias("sheet_id"), F.col("student_id").alias("_owner"), "ready")
    placed = edits.join(home, "attempt_id", "left").join(ready, "sheet_id", "left")
    own = F.coalesce((F.col("_by") == F.col("student_id")) & (F.col("_owner") == F.col("student_id")), F.lit(False))
    problem = (
        F.when(F.col("_by").isNull(), "conflict")
        .when(~own, "sheet_not_found")
        .when(~F.col("ready"), "sheet_not_ready")
    )
    judged = pin(placed.select("attempt_id", "updated_at", problem.alias("_problem")))
    asked = judged.filter("_problem IS NULL").drop("_problem").distinct()
    touched = asked.select("attempt_id")
    # Only the sheets at hand are counted, so the cost follows the edits and not the history.
    sheet_ids = home.join(touched, "attempt_id", "left_semi").select("sheet_id").distinct()
    near_items = items.join(sheet_ids, "sheet_id", "left_semi")
    near_attempts = attempts.join(sheet_ids, "sheet_id", "left_semi")
    held = results.join(touched, "attempt_id", "left_semi")
    given = answers.join(touched, "attempt_id", "left_semi")
    out = pr.edit_attempts(near_attempts, near_items, held, asked, given)
    refused = judged.filter("_problem IS NOT NULL").select("attempt_id", F.col("_problem").alias("verdict"))
    accepted = out["verdicts"].filter("verdict = 'accepted'").select("attempt_id")

    summary = out["summaries"].withColumnRenamed("attempt_id", "id").withColumns(
        {"correct_count": F.col("correct_count").cast("int"), "total_count": F.col("total_count").cast("int"), "updated_at": moment(now)}
    )
    changed = near_attempts.join(accepted.withColumnRenamed("attempt_id", "id"), "id", "left_semi")
    changed = pin(overlay(changed, summary))
    right = given.select("attempt_id", "sheet_item_id", F.col("is_correct").alias("_right"))
    new_results = held.join(right.join(accepted, "attempt_id", "left_semi"), ["attempt_id", "sheet_item_id"])
    new_results = new_results.withColumn("is_correct", F.col("_right")).select(*results.columns)

    groups = pin(out["groups"])
    questioned = groups.select(F.col("source_question_id").alias("wrong_question_id")).distinct()
    past = results.select("attempt_id", "wrong_question_id").join(questioned, "wrong_question_id", "left_semi")
    past_attempts = attempts.join(past.select(F.col("attempt_id").alias("id")).distinct(), "id", "left_semi")
    latest = pr.latest_attempt_by_question(past_attempts, past)
    return {
        "verdicts": out["verdicts"].unionByName(refused),
        "attempts": changed,
        "results": new_results,
        "updates": pr.mastery_state(questions, changed, groups, latest),
    }

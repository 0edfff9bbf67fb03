"""Queries over the library of wrong questions: lists, queues, histories and profiles.

Nested answers of the service become one row per child with its ordering columns, so a
parent with very many children is never gathered into one row.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relearn.functions.ranks import page_rows
from relearn.functions.times import moment, month_start_utc

# Fixed values of the service.
ACTIVE_IMAGE_STATUSES = ["pending", "segmented", "needs_review", "failed"]
MAX_PAGE = 100
NOT_FINISHED = "错题集尚未生成完成"


def live() -> Column:
    return F.col("deleted_at").isNull()


def visible_questions(questions: DataFrame) -> DataFrame:
    """Questions of the library proper: not deleted and collected."""
    return questions.filter(live() & (F.col("collection_status") == "collected"))


def list_questions(
    questions: DataFrame,
    *,
    subject: str | None = None,
    grade: int | None = None,
    semester: int | None = None,
    review_status: str | None = None,
    mastery_status: str | None = None,
    tag: str | None = None,
    created_from: datetime | str | Column | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """One page per student, newest first. A falsy filter is absent, so grade 0 filters nothing."""
    if limit > MAX_PAGE:
        raise ValueError(f"limit must not exceed {MAX_PAGE}")
    rows = visible_questions(questions)
    equal = {
        "subject": subject,
        "grade": grade,
        "semester": semester,
        "review_status": review_status,
        "mastery_status": mastery_status,
    }
    for name, wanted in equal.items():
        if wanted:
            rows = rows.filter(F.col(name) == wanted)
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    if created_from is not None and not (isinstance(created_from, str) and not created_from):
        rows = rows.filter(F.col("created_at") >= moment(created_from))
    newest = [F.col("created_at").desc_nulls_first(), F.col("id").desc_nulls_first()]
    return page_rows(rows, ["student_id"], newest, limit, offset)


def question_detail(questions: DataFrame, images: DataFrame) -> DataFrame:
    """Live questions with the image they were cut from."""
    side = images.select(
        F.col("id").alias("image_id"),
        F.col("original_url"),
        F.col("status").alias("image_status"),
    )
    return questions.filter(live()).join(side, "image_id")


def review_queue(questions: DataFrame, images: DataFrame) -> DataFrame:
    """Pending questions of each student and image, with both per-image counts.

    Display order is image_created_at descending, image_id, created_at, id.
    """
    pending = questions.filter(live() & (F.col("collection_status") == "pending_review"))
    waiting = pending.groupBy("student_id", "image_id").agg(F.count("*").alias("question_count"))
    collected = (
        visible_questions(questions).groupBy("image_id").agg(F.count("*").alias("auto_collected_count"))
    )
    shown = images.select(F.col("id").alias("image_id"), F.col("created_at").alias("image_created_at"))
    heads = (
        waiting.join(shown, "image_id")
        .join(collected, "image_id", "left")
        .withColumn("auto_collected_count", F.coalesce("auto_collected_count", F.lit(0)))
    )
    return pending.join(heads, ["student_id", "image_id"])


def incomplete_images(images: DataFrame, n: int = 100) -> DataFrame:
    """The newest n unfinished images of each student."""
    active = images.filter(F.col("status").isin(ACTIVE_IMAGE_STATUSES))
    return page_rows(active, ["student_id"], [F.col("created_at").desc(), F.col("id").desc()], n)


def profile_stats(
    questions: DataFrame, students: DataFrame, now: Column | datetime | str
) -> DataFrame:
    """Library counts of every student, zero for students without questions."""
    counts = visible_questions(questions).groupBy("student_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("created_at") >= month_start_utc(now)).alias("month_new"),
        F.count_if(F.col("review_status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("mastery_status") == "mastered").alias("mastered"),
    )
    everyone = students.select(F.col("id").alias("student_id"))
    return everyone.join(counts, "student_id", "left").na.fill(
        0, ["total", "month_new", "needs_review", "mastered"]
    )


def sheet_history(sheets: DataFrame, attempts: DataFrame, n: int = 20) -> DataFrame:
    """The newest n sheets of each student with attempt count and latest accuracy."""
    newest = page_rows(
        sheets, ["student_id"], [F.col("created_at").desc(), F.col("id").desc()], n
    )
    tried = attempts.groupBy(F.col("sheet_id").alias("id")).agg(
        F.count("*").alias("attempt_count"),
        F.max_by("accuracy", "attempt_no").alias("latest_accuracy"),
    )
    practised = F.col("attempt_count") > 0
    return (
        newest.join(tried, "id", "left")
        .withColumn("attempt_count", F.coalesce("attempt_count", F.lit(0)))
        .withColumn("practice_status", F.when(practised, "completed").otherwise("unpracticed"))
    )


def practice_ready(sheets: DataFrame) -> DataFrame:
    """Adds ``ready`` and, for sheets that cannot be practised yet, the reason shown."""
    done = F.col("generation_status") == "completed"
    stored = F.when(
        (F.col("generation_status") == "failed") & (F.col("generation_error_message") != ""),
        F.col("generation_error_message"),
    )
    reason = F.when(~done, F.coalesce(stored, F.lit(NOT_FINISHED)))
    return sheets.withColumn("ready", done).withColumn("reason", reason)


def attempt_history(
    sheets: DataFrame,
    attempts: DataFrame,
    results: DataFrame,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """A page of each finished sheet's attempts, latest number first, one row per answer.

    An attempt without answers keeps one row with null answer columns. Answers read in
    (answer_created_at, result_id) order.
    """
    if limit > MAX_PAGE:
        raise ValueError(f"limit must not exceed {MAX_PAGE}")
    own = practice_ready(sheets).filter("ready").select(F.col("id").alias("sheet_id"), "student_id")
    rows = attempts.join(own, ["sheet_id", "student_id"], "left_semi")
    page = page_rows(rows, ["sheet_id"], [F.col("attempt_no").desc()], limit, offset)
    answers = results.select(
        F.col("attempt_id").alias("id"),
        F.col("id").alias("result_id"),
        F.col("created_at").alias("answer_created_at"),
        "sheet_item_id",
        "is_correct",
    )
    return page.join(answers, "id", "left")


def sheet_review(
    sheets: DataFrame, items: DataFrame, attempts: DataFrame, results: DataFrame
) -> DataFrame:
    """Items of finished sheets under their source question, with the latest attempt's verdict.

    Groups read in (group_sort_order, group_item_id) order, items in (item_sort, sheet_item_id).
    """
    from relearn.operators.practice import source_question

    own = practice_ready(sheets).filter("ready").select(F.col("id").alias("sheet_id"), "student_id")
    latest = (
        attempts.join(own, ["sheet_id", "student_id"], "left_semi")
        .groupBy("sheet_id")
        .agg(F.max_by("id", "attempt_no").alias("latest_attempt_id"))
    )
    rows = (
        source_question(items)
        .join(own.select("sheet_id"), "sheet_id", "left_semi")
        .select(
            "sheet_id",
            "source_question_id",
            F.col("id").alias("sheet_item_id"),
            F.col("sort_order").alias("item_sort"),
            F.coalesce("question_snapshot.question_type", "question_type").alias("question_type"),
            F.coalesce("question_snapshot.question_text", "question_text").alias("question_text"),
            F.coalesce("question_snapshot.sort_order", "sort_order").alias("sort_order"),
        )
        .join(latest, "sheet_id", "left")
    )
    answers = results.select(
        F.col("attempt_id").alias("latest_attempt_id"), "sheet_item_id", "is_correct"
    )
    rows = rows.join(answers, ["latest_attempt_id", "sheet_item_id"], "left").withColumn(
        "is_correct", F.coalesce("is_correct", F.lit(True))
    )
    first = rows.groupBy("sheet_id", "source_question_id").agg(
        F.min(F.struct("item_sort", "sheet_item_id")).alias("_first")
    )
    first = first.select(
        F.col("sheet_id").alias("_sheet"),
        F.col("source_question_id").alias("_source"),
        F.col("_first.item_sort").alias("group_sort_order"),
        F.col("_first.sheet_item_id").alias("group_item_id"),
    )
    same = (rows["sheet_id"] == first["_sheet"]) & rows["source_question_id"].eqNullSafe(first["_source"])
    return rows.join(first, same).drop("_sheet", "_source")


def image_status(images: DataFrame, ids: DataFrame) -> DataFrame:
    """Status projection of the images named in ``ids``(id)."""
    return images.join(ids.select("id").distinct(), "id", "left_semi").select(
        F.col("id").alias("image_id"), "status", "question_count", "error_code", "error_message"
    )


def default_student_scope(accounts: DataFrame, students: DataFrame) -> DataFrame:
    """Every account's default student, or why it has none to act for."""
    chosen = students.filter("is_default").select(
        F.col("account_id"), F.col("id").alias("student_id")
    )
    problem = (
        F.when(F.col("status") != "active", "account_not_active")
        .when(F.col("student_id").isNull(), "student_profile_required")
    )
    scope = accounts.select(F.col("id").alias("account_id"), "status").join(chosen, "account_id", "left")
    return scope.withColumn("problem", problem).withColumn(
        "student_id", F.when(F.col("problem").isNull(), F.col("student_id"))
    )


def _prompt_required() -> Column:
    return F.col("profile_prompted_at").isNull() & F.col("profile_completed_at").isNull()


def _student_incomplete() -> Column:
    return F.col("grade").isNull() | F.col("semester").isNull()


def _with_default_student(accounts: DataFrame, students: DataFrame) -> DataFrame:
    chosen = students.filter("is_default").select(
        "account_id", F.col("id").alias("student_id"), "display_name", "grade", "semester"
    )
    return accounts.withColumnRenamed("id", "account_id").join(chosen, "account_id")


def profile_view(accounts: DataFrame, students: DataFrame, stats: DataFrame) -> DataFrame:
    """Profile of every account with a default student, joined with its library counts."""
    return (
        _with_default_student(accounts, students)
        .join(stats, "student_id", "left")
        .select(
            "account_id",
            "nickname",
            F.col("avatar_object_key").alias("avatar_url"),
            _prompt_required().alias("profile_prompt_required"),
            "student_id",
            F.col("display_name").alias("student_name"),
            "grade",
            "semester",
            _student_incomplete().alias("student_profile_required"),
            F.col("phone_ciphertext").isNotNull().alias("phone_bound"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "month_new", "needs_review", "mastered")],
        )
    )


def login_view(
    accounts: DataFrame, students: DataFrame, now: Column | datetime | str
) -> DataFrame:
    """What a login shows: state, and onboarding flags that stay off while deletion is pending."""
    pending = F.col("status") == "pending_deletion"
    state = F.when(pending & (F.col("deletion_due_at") <= moment(now)), "expired").otherwise(
        F.col("status")
    )
    return _with_default_student(accounts, students).select(
        "account_id",
        "student_id",
        state.alias("login_state"),
        (~pending & _prompt_required()).alias("profile_prompt_required"),
        (~pending & _student_incomplete()).alias("student_profile_required"),
        F.when(pending, F.col("deletion_due_at")).alias("deletion_due_at"),
    )


def owned_only(df: DataFrame, scope: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``df`` that ``scope``(key, student_id) asks for and that belong to that student."""
    return df.join(scope.select(key, "student_id").distinct(), [key, "student_id"], "left_semi")

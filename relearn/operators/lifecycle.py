"""Soft deletion, review decisions, cancellation and retention as set-wise state changes."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relearn.functions.times import days_after, days_before, moment
from relearn.operators.library import ACTIVE_IMAGE_STATUSES, live
from relearn.sources.changes import last_per_key, overlay

Moment = Column | datetime | str

# Retention periods and public storage roots.
QUESTION_RETENTION_DAYS = 30
ACCOUNT_RETENTION_DAYS = 30
RETRY_AFTER_SECONDS = 86_400
STORAGE_KINDS = {"avatars": "avatar", "uploads": "upload", "pdfs": "pdf"}


def _pending() -> Column:
    return live() & (F.col("collection_status") == "pending_review")


def _mark_images(images: DataFrame, ids: DataFrame, **values: Column) -> DataFrame:
    updates = ids.select("id").distinct()
    for name, value in values.items():
        updates = updates.withColumn(name, value)
    return overlay(images, updates)


def soft_delete(questions: DataFrame, ids: DataFrame, now: Moment) -> DataFrame:
    """Mark the questions in ``ids``(id, student_id) deleted; a repeat keeps the first time."""
    hit = ids.select("id", "student_id").distinct().withColumn("_hit", F.lit(True))
    return (
        questions.join(hit, ["id", "student_id"], "left")
        .withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_hit"), moment(now))))
        .select(*questions.columns)
    )


def restore(
    questions: DataFrame, ids: DataFrame, now: Moment, days: int = QUESTION_RETENTION_DAYS
) -> DataFrame:
    """Undo soft deletion while it is younger than the retention period."""
    hit = ids.select("id", "student_id").distinct().withColumn("_hit", F.lit(True))
    young = F.col("_hit") & (F.col("deleted_at") > days_before(now, days))
    return (
        questions.join(hit, ["id", "student_id"], "left")
        .withColumn("deleted_at", F.when(F.coalesce(young, F.lit(False)), None).otherwise(F.col("deleted_at")))
        .select(*questions.columns)
    )


def purge_due(now: Moment, days: int = QUESTION_RETENTION_DAYS) -> Column:
    cutoff = days_before(now, days)
    ignored = (F.col("collection_status") == "ignored") & (F.col("updated_at") < cutoff)
    return F.coalesce(F.col("deleted_at") < cutoff, F.lit(False)) | F.coalesce(ignored, F.lit(False))


def purge_questions(
    questions: DataFrame,
    items: DataFrame,
    results: DataFrame,
    now: Moment,
    days: int = QUESTION_RETENTION_DAYS,
) -> dict[str, DataFrame]:
    """Physically remove expired questions; items and results lose the reference, not the snapshot."""
    due = purge_due(now, days)
    purged = questions.filter(due).select("id")

    def unlink(df: DataFrame, columns: list[str]) -> DataFrame:
        for name in columns:
            # Rows without a reference have nothing to lose and would all meet in one partition.
            hit = purged.select(F.col("id").alias("_gone"))
            bound = df.filter(F.col(name).isNotNull())
            bound = bound.join(hit, bound[name] == hit["_gone"], "left")
            bound = bound.withColumn(name, F.when(F.col("_gone").isNull(), F.col(name))).drop("_gone")
            df = bound.unionByName(df.filter(F.col(name).isNull()))
        return df

    refs = [c for c in ("wrong_question_id", "derived_from") if c in items.columns]
    return {
        "purged": purged,
        "questions": questions.filter(~due),
        "items": unlink(items, refs).select(*items.columns),
        "results": unlink(results, ["wrong_question_id"]).select(*results.columns),
    }


def orphan_images(
    images: DataFrame, questions: DataFrame, now: Moment, days: int = QUESTION_RETENTION_DAYS
) -> DataFrame:
    """Images past retention that no question refers to; pass the questions left after purging."""
    old = images.filter(F.col("created_at") < days_before(now, days))
    used = questions.select(F.col("image_id").alias("id")).distinct()
    return old.join(used, "id", "left_anti")


def apply_review_decisions(
    questions: DataFrame, images: DataFrame, decisions: DataFrame
) -> dict[str, DataFrame]:
    """Collect or ignore pending questions.

    ``decisions``(image_id, student_id, question_id, decision) is one request per image and
    student; requests of one image must not name the same question twice. A request is
    rejected as a whole for duplicate decisions, a foreign image, or a question that is not
    pending there. The image is confirmed once nothing on it is pending.
    """
    request = ["image_id", "student_id"]
    own = images.select(F.col("id").alias("image_id"), "student_id", F.lit(True).alias("_own"))
    open_rows = questions.filter(_pending()).select(
        "image_id", "student_id", F.col("id").alias("question_id"), F.lit(True).alias("_open")
    )
    per_question = decisions.groupBy(*request, "question_id").agg(
        F.count("*").alias("_n"), F.first("decision").alias("decision")
    )
    checked = per_question.join(open_rows, [*request, "question_id"], "left")
    verdicts = (
        checked.groupBy(*request)
        .agg(
            F.max("_n").alias("_most"),
            F.count_if(F.col("_open").isNull()).alias("_unknown"),
            F.count_if(F.col("decision") == "collect").alias("collected"),
            F.count_if(F.col("decision") == "ignore").alias("ignored"),
        )
        .join(own, request, "left")
        .withColumn(
            "verdict",
            F.when(F.col("_most") > 1, "duplicate_decisions")
            .when(F.col("_own").isNull(), "image_not_found")
            .when(F.col("_unknown") > 0, "question_not_found")
            .otherwise("accepted"),
        )
    )
    accepted = verdicts.filter("verdict = 'accepted'").select(*request)
    decided = checked.join(accepted, request, "left_semi")
    updates = decided.select(
        F.col("question_id").alias("id"),
        F.when(F.col("decision") == "collect", "collected").otherwise("ignored").alias("collection_status"),
        F.lit("confirmed").alias("review_status"),
    )
    after = overlay(questions, updates)
    remaining = after.filter(_pending()).select("image_id").distinct()
    flagged = verdicts.join(remaining.withColumn("_left", F.lit(True)), "image_id", "left")
    outcome = flagged.select(
        *request, "verdict", "collected", "ignored", F.col("_left").isNotNull().alias("remaining")
    )
    done = outcome.filter("verdict = 'accepted' AND NOT remaining").select(F.col("image_id").alias("id"))
    return {
        "outcome": outcome,
        "questions": after,
        "images": _mark_images(images, done, status=F.lit("confirmed")),
    }


def reprocess_images(
    questions: DataFrame, images: DataFrame, requests: DataFrame, now: Moment
) -> dict[str, DataFrame]:
    """Send images with pending questions through recognition again.

    ``requests``(id, student_id, correction). Pending questions of the student are superseded. Of several
    requests for one image the greatest value of each field counts.
    """
    open_images = questions.filter(_pending()).select(F.col("image_id").alias("id"), "student_id").distinct()
    own = images.select("id", "student_id", F.lit(True).alias("_own"))
    outcome = (
        requests.groupBy("id", "student_id").agg(*[F.max(c).alias(c) for c in requests.columns if c not in ("id", "student_id")])
        .join(own, ["id", "student_id"], "left")
        .join(open_images.withColumn("_open", F.lit(True)), ["id", "student_id"], "left")
        .withColumn(
            "verdict",
            F.when(F.col("_own").isNull(), "image_not_found")
            .when(F.col("_open").isNull(), "no_pending_questions")
            .otherwise("accepted"),
        )
    )
    accepted = outcome.filter("verdict = 'accepted'")
    superseded = (
        questions.filter(_pending())
        .join(accepted.select(F.col("id").alias("image_id"), "student_id"), ["image_id", "student_id"], "left_semi")
        .select("id", F.lit("superseded").alias("collection_status"), moment(now).alias("deleted_at"))
    )
    none = F.lit(None).cast("string")
    reset = accepted.select(
        "id", F.lit("pending").alias("status"), F.lit(0).alias("question_count"),
        none.alias("error_code"), none.alias("error_message"),
        F.col("correction").alias("recognition_correction"),
    )
    reset = reset.select(*[c for c in reset.columns if c in images.columns])
    return {
        "outcome": outcome.select("id", "student_id", "verdict"),
        "questions": overlay(questions, superseded),
        "images": overlay(images, reset),
    }


def cancel_images(questions: DataFrame, images: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Cancel active images named in ``requests``(id, student_id); their pending questions are ignored."""
    active = images.filter(F.col("status").isin(ACTIVE_IMAGE_STATUSES))
    cancelled = active.join(requests.select("id", "student_id").distinct(), ["id", "student_id"], "left_semi")
    ids = cancelled.select("id", "student_id")
    ignored = (
        questions.filter(_pending())
        .join(ids.withColumnRenamed("id", "image_id"), ["image_id", "student_id"], "left_semi")
        .select("id", F.lit("ignored").alias("collection_status"))
    )
    none = F.lit(None).cast("string")
    return {
        "cancelled": ids.select("id"),
        "questions": overlay(questions, ignored),
        "images": _mark_images(images, ids, status=F.lit("cancelled"), error_code=none, error_message=none),
    }


def retry_failed_images(images: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Queue failed images again; other states are refused."""
    own = images.select("id", "student_id", "status")
    outcome = (
        requests.select("id", "student_id").distinct()
        .join(own, ["id", "student_id"], "left")
        .select(
            "id",
            "student_id",
            F.when(F.col("status").isNull(), "image_not_found")
            .when(F.col("status") != "failed", "not_failed")
            .otherwise("accepted").alias("verdict"),
        )
    )
    none = F.lit(None).cast("string")
    ids = outcome.filter("verdict = 'accepted'")
    return {
        "outcome": outcome,
        "images": _mark_images(images, ids, status=F.lit("pending"), error_code=none, error_message=none),
    }


def confirm_edited(questions: DataFrame, images: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """Apply edits(id, student_id, fields…) to live questions.

    Of several edits of a question the last by ``edited_at`` counts, where that is given, else the
    largest by its fields. An edited needs_review question becomes confirmed, and so does its image when no live
    question on it still needs review.
    """
    fields = [c for c in edits.columns if c not in ("id", "student_id", "edited_at")]
    target = questions.filter(live()).select("id", "student_id", "image_id", F.col("review_status").alias("_was"))
    order = [c for c in ("edited_at",) if c in edits.columns]
    hit = last_per_key(edits.join(target, ["id", "student_id"]), "id", order)
    wanted = F.col("review_status") if "review_status" in fields else F.col("_was")
    updates = hit.select(
        "id",
        *[c for c in fields if c != "review_status"],
        F.when(F.col("_was") == "needs_review", "confirmed").otherwise(wanted).alias("review_status"),
    )
    after = overlay(questions, updates)
    still = after.filter(live() & (F.col("review_status") == "needs_review")).select("image_id").distinct()
    done = (
        hit.filter("_was = 'needs_review'").select("image_id").distinct()
        .join(still, "image_id", "left_anti")
        .withColumnRenamed("image_id", "id")
    )
    return {"questions": after, "images": _mark_images(images, done, status=F.lit("confirmed")), "confirmed_images": done}


def request_account_deletion(
    accounts: DataFrame,
    identities: DataFrame,
    requests: DataFrame,
    now: Moment,
    days: int = ACCOUNT_RETENTION_DAYS,
) -> dict[str, DataFrame]:
    """Start the recovery period of accounts in ``requests``(account_id, appid, openid).

    The identity must belong to the account; a pending account stays as it is.
    """
    known = identities.select("account_id", "appid", "openid", F.lit(True).alias("_mine")).distinct()
    state = accounts.select(F.col("id").alias("account_id"), "status", "token_version")
    outcome = (
        requests.distinct()
        .join(state, "account_id", "left")
        .join(known, ["account_id", "appid", "openid"], "left")
        .withColumn(
            "verdict",
            F.when(F.col("status").isNull(), "unavailable")
            .when(F.col("_mine").isNull(), "invalid_identity")
            .when(F.col("status") == "pending_deletion", "already_pending")
            .when(F.col("status") != "active", "unavailable")
            .otherwise("accepted"),
        )
    )
    updates = outcome.filter("verdict = 'accepted'").select(F.col("account_id").alias("id"), "token_version").distinct().select(
        "id",
        F.lit("pending_deletion").alias("status"),
        moment(now).alias("deletion_requested_at"),
        days_after(now, days).alias("deletion_due_at"),
        (F.col("token_version") + 1).cast("int").alias("token_version"),
    )
    return {"outcome": outcome.select(*requests.columns, "verdict"), "accounts": overlay(accounts, updates)}


def recover_account_deletion(
    accounts: DataFrame, students: DataFrame, requests: DataFrame, now: Moment
) -> dict[str, DataFrame]:
    """Undo pending deletion for ``requests``(account_id, token_version), strictly before it is due."""
    chosen = students.filter("is_default").select("account_id", F.lit(True).alias("_student")).distinct()
    state = accounts.select(
        F.col("id").alias("account_id"), "status", "deletion_due_at", F.col("token_version").alias("_stored")
    )
    usable = (
        (F.col("status") == "pending_deletion")
        & (F.col("_stored") == F.col("token_version"))
        & F.col("deletion_due_at").isNotNull()
    )
    outcome = (
        requests.distinct()
        .join(state, "account_id", "left")
        .join(chosen, "account_id", "left")
        .withColumn(
            "verdict",
            F.when(~F.coalesce(usable, F.lit(False)), "unavailable")
            .when(F.col("deletion_due_at") <= moment(now), "expired")
            .when(F.col("_student").isNull(), "unavailable")
            .otherwise("accepted"),
        )
    )
    never = F.lit(None).cast("timestamp_ntz")
    updates = outcome.filter("verdict = 'accepted'").select(
        F.col("account_id").alias("id"),
        F.lit("active").alias("status"),
        never.alias("deletion_requested_at"),
        never.alias("deletion_due_at"),
        (F.col("_stored") + 1).cast("int").alias("token_version"),
    )
    return {"outcome": outcome.select(*requests.columns, "verdict"), "accounts": overlay(accounts, updates)}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it.

    The optimizer writes a named column out at each of its uses, in filters without noticing repeats; a lambda's variable it keeps.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cleanup_path(path: Column) -> Column:
    """Normalised object path, or null unless it is a storage root plus one safe file name.

    Doubled slashes and single dots collapse as in a POSIX path; three leading slashes count
    as one, exactly two do not.
    """
    collapsed = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), r"/+", "/")
    tidy = F.regexp_replace(collapsed, r"(?<=.)(/\.?)$", "")
    shape = r"^/(avatars|uploads|pdfs)/([^/]+)$"
    sound = lambda p: p.rlike(shape) & ~path.rlike(r"^//(?!/)") & ~p.rlike(r"/\.{1,2}$")
    return _once(tidy, lambda p: F.when(sound(p), p))


def _cleanup_file(path: Column, kind: str | None) -> Column:
    """(storage_kind, object_path) of a path as one struct, both null for paths that must not be deleted."""
    kinds = F.create_map(*[F.lit(x) for pair in STORAGE_KINDS.items() for x in pair])

    def file(p: Column) -> Column:
        found = F.try_element_at(kinds, F.regexp_extract(p, r"^/([a-z]+)/", 1))
        wanted = (lambda k: k) if kind is None else (lambda k: F.when(k == kind, k))
        return _once(found, lambda k: F.struct(
            wanted(k).alias("storage_kind"), F.when(wanted(k).isNotNull(), p).alias("object_path")))

    return _once(cleanup_path(path), file)


def file_cleanup_jobs(paths: DataFrame, column: str, kind: str | None = None) -> DataFrame:
    """Adds storage_kind and object_path, both null for paths that must not be deleted.

    With ``kind`` the path must also lie in that kind's root.
    """
    rest = [c for c in paths.columns if c not in ("storage_kind", "object_path")]
    return paths.select(*rest, F.inline(F.array(_cleanup_file(F.col(column), kind))))


def cleanup_jobs_for(rows: DataFrame, column: str, kind: str | None = None) -> DataFrame:
    # A filter does not move below the generated columns, so a path is read once, and only after the joins below.
    jobs = file_cleanup_jobs(rows.select(F.col(column).alias("_path")), "_path", kind)
    return jobs.filter(F.col("object_path").isNotNull()).select("storage_kind", "object_path")


def purge_accounts(tables: dict[str, DataFrame], now: Moment) -> dict[str, DataFrame]:
    """Remove accounts whose recovery period is over, with everything their students own.

    Takes and returns tables by name; the result adds ``purged`` account ids and ``jobs``,
    the files to delete. Recovery conflicts keep their row and lose the account reference.
    """
    accounts = tables["accounts"]
    due = F.coalesce(
        (F.col("status") == "pending_deletion") & (F.col("deletion_due_at") <= moment(now)), F.lit(False)
    )
    gone = accounts.filter(due).select(F.col("id").alias("account_id"))
    students = tables["students"].join(gone, "account_id", "left_semi").select(F.col("id").alias("student_id"))
    sheets = tables["practice_sheets"].join(students, "student_id", "left_semi")
    attempts = tables["practice_attempts"].join(students, "student_id", "left_semi")

    out = dict(tables)
    out["purged"] = gone
    out["accounts"] = accounts.filter(~due)
    for name in ("students", "wechat_identities"):
        if name in tables:
            out[name] = tables[name].join(gone, "account_id", "left_anti")
    for name in ("wrong_images", "wrong_questions", "practice_sheets", "practice_attempts"):
        out[name] = tables[name].join(students, "student_id", "left_anti")
    out["sheet_items"] = tables["sheet_items"].join(
        sheets.select(F.col("id").alias("sheet_id")), "sheet_id", "left_anti"
    )
    out["practice_results"] = tables["practice_results"].join(
        attempts.select(F.col("id").alias("attempt_id")), "attempt_id", "left_anti"
    )
    if "account_recovery_conflicts" in tables:
        conflicts = tables["account_recovery_conflicts"]
        for name in ("current_account_id", "target_account_id"):
            hit = gone.select(F.col("account_id").alias("_gone"))
            conflicts = conflicts.join(hit, conflicts[name] == hit["_gone"], "left")
            conflicts = conflicts.withColumn(name, F.when(F.col("_gone").isNull(), F.col(name))).drop("_gone")
        out["account_recovery_conflicts"] = conflicts
    images = tables["wrong_images"].join(students, "student_id", "left_semi")
    out["jobs"] = reduce(
        DataFrame.unionByName,
        [
            cleanup_jobs_for(accounts.filter(due), "avatar_object_key"),
            cleanup_jobs_for(sheets, "pdf_url"),
            cleanup_jobs_for(images, "original_url"),
        ],
    )
    return out


def schedule_cleanup_retries(
    jobs: DataFrame, outcomes: DataFrame, now: Moment, interval_seconds: int = RETRY_AFTER_SECONDS
) -> dict[str, DataFrame]:
    """Fold the ``outcomes``(id, ok, error) of attempted deletions into the job table.

    Due jobs that succeeded leave, those that failed wait for ``interval_seconds``; jobs that
    are not due, or were not attempted, stay.
    """
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= moment(now))
    # A file that was deleted once is gone, whatever else was reported of it.
    told = outcomes.groupBy("id").agg(F.max(F.struct("ok", "error")).alias("_o")).select("id", "_o.*")
    tried = jobs.join(told, "id", "left").withColumn(
        "_step", F.when(due & F.col("ok"), "deleted").when(due & ~F.col("ok"), "failed").otherwise("kept")
    )
    failed = F.col("_step") == "failed"
    later = moment(now) + F.make_dt_interval(secs=F.lit(interval_seconds))
    left = (
        tried.filter("_step <> 'deleted'")
        .withColumn(
            "attempt_count",
            F.when(failed, F.coalesce("attempt_count", F.lit(0)) + 1).otherwise(F.col("attempt_count")).cast("int"),
        )
        .withColumn("last_error", F.when(failed, F.col("error")).otherwise(F.col("last_error")))
        .withColumn("next_attempt_at", F.when(failed, later).otherwise(F.col("next_attempt_at")))
    )
    summary = tried.agg(
        F.count_if(F.col("_step") == "deleted").alias("files_deleted"),
        F.count_if(failed).alias("file_failures"),
    )
    return {"jobs": left.select(*jobs.columns), "summary": summary}

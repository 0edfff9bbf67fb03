from pyspark.sql import functions as F

from relearn.catalog import Case
from relearn.functions.times import moment, month_start_utc, to_naive_utc
from relearn.operators import library as lib

NOW = "1998-03-15 08:30:00"
VISIBLE = "deleted_at IS NULL AND collection_status = 'collected'"
MONTH = "TIMESTAMP '1998-02-28 16:00:00'"


def _items(t):
    return t("b_sheet_items").withColumn(
        "question_snapshot",
        F.struct(
            F.col("snapshot_source_id").alias("source_wrong_question_id"),
            F.concat(F.lit("snap "), "question_text").alias("question_text"),
            F.when(F.col("sort_order") > 0, F.col("question_type")).alias("question_type"),
            F.col("sort_order").alias("sort_order"),
        ),
    )


CASES = {
    "b1_visible_questions": Case(
        lambda t: lib.visible_questions(t("b_questions")).select("id", "student_id", "subject", "created_at"),
        f"SELECT id, student_id, subject, created_at FROM b_questions WHERE {VISIBLE}",
    ),
    "b2_list_questions": Case(
        lambda t: lib.list_questions(t("b_questions"), subject="math", grade=0, tag="t3", limit=5, offset=1)
        .select("student_id", "id", "created_at", "position"),
        f"""SELECT student_id, id, created_at, position FROM (
            SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY created_at DESC, id DESC) AS position
            FROM b_questions WHERE {VISIBLE} AND subject = 'math' AND list_contains(tags, 't3')) x
            WHERE position BETWEEN 2 AND 6""",
    ),
    "b2_list_questions_filtered": Case(
        lambda t: lib.list_questions(
            t("b_questions"), mastery_status="learning", review_status="confirmed",
            created_from=NOW, limit=100).select("student_id", "id", "position"),
        f"""SELECT student_id, id, position FROM (
            SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY created_at DESC, id DESC) AS position
            FROM b_questions WHERE {VISIBLE} AND mastery_status = 'learning' AND review_status = 'confirmed'
            AND created_at >= TIMESTAMP '{NOW}') x WHERE position BETWEEN 1 AND 100""",
    ),
    "b3_to_naive_utc": Case(
        lambda t: t("orders").select(
            "o_orderkey",
            to_naive_utc(F.col("o_orderdate"), F.when(F.col("o_orderstatus") != "P", F.lit("Asia/Shanghai"))).alias("utc")),
        """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate - INTERVAL 8 HOUR ELSE o_orderdate END AS utc
           FROM orders""",
    ),
    "b4_question_detail": Case(
        lambda t: lib.question_detail(t("b_questions"), t("b_images"))
        .select("id", "image_id", "subject", "original_url", "image_status"),
        """SELECT q.id, q.image_id, q.subject, i.original_url, i.status AS image_status
           FROM b_questions q JOIN b_images i ON i.id = q.image_id WHERE q.deleted_at IS NULL""",
    ),
    "b5_review_queue": Case(
        lambda t: lib.review_queue(t("b_questions"), t("b_images")).select(
            "student_id", "image_id", "image_created_at", "question_count", "auto_collected_count", "id", "created_at"),
        """SELECT q.student_id, q.image_id, i.created_at AS image_created_at,
             count(*) OVER (PARTITION BY q.student_id, q.image_id) AS question_count,
             (SELECT count(*) FROM b_questions c WHERE c.image_id = q.image_id AND c.deleted_at IS NULL
               AND c.collection_status = 'collected') AS auto_collected_count, q.id, q.created_at
           FROM b_questions q JOIN b_images i ON i.id = q.image_id
           WHERE q.deleted_at IS NULL AND q.collection_status = 'pending_review'""",
    ),
    "b6_incomplete_images": Case(
        lambda t: lib.incomplete_images(t("b_images"), 3).select("student_id", "id", "status", "created_at", "position"),
        """SELECT student_id, id, status, created_at, position FROM (
             SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY created_at DESC, id DESC) AS position
             FROM b_images WHERE status IN ('pending','segmented','needs_review','failed')) x WHERE position <= 3""",
    ),
    "b7_profile_stats": Case(
        lambda t: lib.profile_stats(t("b_questions"), t("b_students"), NOW),
        f"""SELECT s.id AS student_id, count(q.id) AS total,
             count(q.id) FILTER (WHERE q.created_at >= {MONTH}) AS month_new,
             count(q.id) FILTER (WHERE q.review_status = 'needs_review') AS needs_review,
             count(q.id) FILTER (WHERE q.mastery_status = 'mastered') AS mastered
           FROM b_students s LEFT JOIN (SELECT * FROM b_questions WHERE {VISIBLE}) q ON q.student_id = s.id GROUP BY s.id""",
    ),
    "b8_month_start": Case(
        lambda t: t("events").select("event_id", month_start_utc(F.col("ts")).alias("month_start")),
        """SELECT event_id, date_trunc('month', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR AS month_start FROM events""",
    ),
    "b9_sheet_history": Case(
        lambda t: lib.sheet_history(t("b_sheets"), t("b_attempts"), 20).select(
            "student_id", "id", "created_at", "position", "attempt_count", "latest_accuracy", "practice_status"),
        """SELECT s.student_id, s.id, s.created_at, s.position, count(a.id) AS attempt_count,
             arg_max(a.accuracy, a.attempt_no) AS latest_accuracy,
             CASE WHEN count(a.id) > 0 THEN 'completed' ELSE 'unpracticed' END AS practice_status
           FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY created_at DESC, id DESC) AS position
                 FROM b_sheets) s LEFT JOIN b_attempts a ON a.sheet_id = s.id
           WHERE s.position <= 20 GROUP BY ALL""",
    ),
    "b10_attempt_history": Case(
        lambda t: lib.attempt_history(t("b_sheets"), t("b_attempts"), t("b_results"), 2, 1).select(
            "sheet_id", F.col("id").alias("attempt_id"), "attempt_no", "position", "sheet_item_id", "is_correct"),
        """SELECT a.sheet_id, a.id AS attempt_id, a.attempt_no, a.position, r.sheet_item_id, r.is_correct FROM (
             SELECT a.*, row_number() OVER (PARTITION BY a.sheet_id ORDER BY a.attempt_no DESC) AS position
             FROM b_attempts a JOIN b_sheets s ON s.id = a.sheet_id AND s.student_id = a.student_id
             WHERE s.generation_status = 'completed') a
           LEFT JOIN b_results r ON r.attempt_id = a.id WHERE a.position BETWEEN 2 AND 3""",
    ),
    "b11_sheet_review": Case(
        lambda t: lib.sheet_review(t("b_sheets"), _items(t), t("b_attempts"), t("b_results")).select(
            "sheet_id", "latest_attempt_id", "source_question_id", "group_sort_order", "group_item_id",
            "sheet_item_id", "question_type", "question_text", "sort_order", "is_correct"),
        """WITH latest AS (SELECT a.sheet_id, arg_max(a.id, a.attempt_no) AS latest_attempt_id FROM b_attempts a
             JOIN b_sheets s ON s.id = a.sheet_id AND s.student_id = a.student_id GROUP BY a.sheet_id),
           rows_ AS (SELECT i.sheet_id, l.latest_attempt_id, coalesce(i.wrong_question_id, i.snapshot_source_id) AS source_question_id,
             i.id AS sheet_item_id, i.question_type, 'snap ' || i.question_text AS question_text, i.sort_order,
             coalesce(r.is_correct, true) AS is_correct
             FROM b_sheet_items i JOIN b_sheets s ON s.id = i.sheet_id AND s.generation_status = 'completed'
             LEFT JOIN latest l ON l.sheet_id = i.sheet_id
             LEFT JOIN b_results r ON r.attempt_id = l.latest_attempt_id AND r.sheet_item_id = i.id)
           SELECT *, min(sort_order) OVER (PARTITION BY sheet_id, source_question_id) AS group_sort_order,
             first_value(sheet_item_id) OVER (PARTITION BY sheet_id, source_question_id ORDER BY sort_order, sheet_item_id) AS group_item_id
           FROM rows_""",
    ),
    "b12_image_status": Case(
        lambda t: lib.image_status(t("b_images"), t("b_questions").select(F.col("image_id").alias("id"))),
        """SELECT id AS image_id, status, question_count, error_code, error_message FROM b_images
           WHERE id IN (SELECT image_id FROM b_questions)""",
    ),
    "b13_default_student_scope": Case(
        lambda t: lib.default_student_scope(t("b_accounts"), t("b_students")),
        """SELECT a.id AS account_id, a.status, CASE WHEN a.status = 'active' THEN s.id END AS student_id,
             CASE WHEN a.status <> 'active' THEN 'account_not_active' WHEN s.id IS NULL THEN 'student_profile_required' END AS problem
           FROM b_accounts a LEFT JOIN b_students s ON s.account_id = a.id AND s.is_default""",
    ),
    "b14_profile_view": Case(
        lambda t: lib.profile_view(
            t("b_accounts"), t("b_students"), lib.profile_stats(t("b_questions"), t("b_students"), NOW)),
        f"""SELECT a.id AS account_id, a.nickname, a.avatar_object_key AS avatar_url,
             (a.profile_prompted_at IS NULL AND a.profile_completed_at IS NULL) AS profile_prompt_required,
             s.id AS student_id, s.display_name AS student_name, s.grade, s.semester,
             (s.grade IS NULL OR s.semester IS NULL) AS student_profile_required,
             (a.phone_ciphertext IS NOT NULL) AS phone_bound, count(q.id) AS total,
             count(q.id) FILTER (WHERE q.created_at >= {MONTH}) AS month_new,
             count(q.id) FILTER (WHERE q.review_status = 'needs_review') AS needs_review,
             count(q.id) FILTER (WHERE q.mastery_status = 'mastered') AS mastered
           FROM b_accounts a JOIN b_students s ON s.account_id = a.id AND s.is_default
           LEFT JOIN (SELECT * FROM b_questions WHERE {VISIBLE}) q ON q.student_id = s.id GROUP BY ALL""",
    ),
    "b15_owned_only": Case(
        lambda t: lib.owned_only(
            t("b_questions"),
            t("b_sheet_requests").select(F.col("question_id").alias("id"), (F.col("student_id") + F.col("pos") % 2).alias("student_id")))
        .select("id", "student_id"),
        """SELECT id, student_id FROM b_questions q WHERE EXISTS (SELECT 1 FROM b_sheet_requests r
             WHERE r.question_id = q.id AND r.student_id + r.pos % 2 = q.student_id)""",
    ),
    "b16_login_view": Case(
        lambda t: lib.login_view(t("b_accounts"), t("b_students"), "2024-01-01 12:00:00"),
        """SELECT a.id AS account_id, s.id AS student_id,
             CASE WHEN a.status = 'pending_deletion' AND a.deletion_due_at <= TIMESTAMP '2024-01-01 12:00:00' THEN 'expired' ELSE a.status END AS login_state,
             (a.status <> 'pending_deletion' AND a.profile_prompted_at IS NULL AND a.profile_completed_at IS NULL) AS profile_prompt_required,
             (a.status <> 'pending_deletion' AND (s.grade IS NULL OR s.semester IS NULL)) AS student_profile_required,
             CASE WHEN a.status = 'pending_deletion' THEN a.deletion_due_at END AS deletion_due_at
           FROM b_accounts a JOIN b_students s ON s.account_id = a.id AND s.is_default""",
    ),
    "c15_practice_ready": Case(
        lambda t: lib.practice_ready(t("b_sheets")).select("id", "ready", "reason"),
        """SELECT id, generation_status = 'completed' AS ready, CASE WHEN generation_status = 'completed' THEN NULL
             WHEN generation_status = 'failed' AND generation_error_message <> '' THEN generation_error_message
             ELSE '错题集尚未生成完成' END AS reason FROM b_sheets""",
    ),
}

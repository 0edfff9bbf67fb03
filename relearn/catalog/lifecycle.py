from pyspark.sql import functions as F

from relearn.catalog import Case
from relearn.operators import lifecycle as lc

NOW = "1998-12-01 00:00:00"
CUTOFF = "TIMESTAMP '1998-11-01 00:00:00'"
DUE = "TIMESTAMP '2024-01-04 00:00:00'"
PURGE = f"(coalesce(deleted_at < {CUTOFF}, false) OR (collection_status = 'ignored' AND updated_at < {CUTOFF}))"
ACTIVE = "('pending','segmented','needs_review','failed')"
PENDING = "deleted_at IS NULL AND collection_status = 'pending_review'"


def _requested(t):
    """Questions asked for, some under a foreign student."""
    return t.sql("SELECT question_id AS id, student_id + pos % 2 AS student_id FROM b_sheet_requests")


REQUESTED = "(SELECT DISTINCT question_id AS id, student_id + pos % 2 AS student_id FROM b_sheet_requests)"


def _image_requests(t):
    return t.sql("SELECT l_orderkey AS id, o_custkey + l_linenumber % 2 AS student_id, l_linestatus AS correction "
                 "FROM lineitem JOIN orders ON o_orderkey = l_orderkey").dropDuplicates(["id", "student_id"])


IMAGE_REQUESTS = ("(SELECT DISTINCT l_orderkey AS id, o_custkey + l_linenumber % 2 AS student_id "
                  "FROM lineitem JOIN orders ON o_orderkey = l_orderkey)")


def _practice_items(t):
    """Sheet items and results that refer to library questions."""
    return t.sql("SELECT l_orderkey*100 + l_linenumber*10 + l_suppkey % 10 AS id, l_orderkey*10 + l_linenumber AS wrong_question_id, "
                 "CASE WHEN l_returnflag = 'A' THEN l_orderkey*10 + l_linenumber END AS derived_from FROM lineitem")


def _purged(t):
    items = _practice_items(t)
    return lc.purge_questions(t("b_questions"), items, items.drop("derived_from"), NOW)


DECISIONS = """SELECT id AS question_id, image_id, CASE WHEN difficulty = 5 THEN student_id + 1 ELSE student_id END AS student_id,
  CASE WHEN semester = 1 THEN 'collect' ELSE 'ignore' END AS decision FROM b_questions
  WHERE collection_status = 'pending_review' OR (subject = 'english' AND collection_status = 'superseded')"""
OUTCOME = f"""decisions AS ({DECISIONS}), judged AS (SELECT d.*, i.id AS own, q.id AS open_ FROM decisions d
    LEFT JOIN b_images i ON i.id = d.image_id AND i.student_id = d.student_id
    LEFT JOIN (SELECT * FROM b_questions WHERE {PENDING}) q ON q.id = d.question_id AND q.image_id = d.image_id AND q.student_id = d.student_id),
  verdicts AS (SELECT image_id, student_id, CASE WHEN count(own) = 0 THEN 'image_not_found' WHEN count(open_) < count(*) THEN 'question_not_found'
    ELSE 'accepted' END AS verdict, count(*) FILTER (WHERE decision = 'collect') AS collected,
    count(*) FILTER (WHERE decision = 'ignore') AS ignored FROM judged GROUP BY ALL),
  after AS (SELECT q.id, q.image_id, q.deleted_at, CASE WHEN v.verdict = 'accepted' THEN CASE d.decision WHEN 'collect' THEN 'collected' ELSE 'ignored' END
      ELSE q.collection_status END AS collection_status, CASE WHEN v.verdict = 'accepted' THEN 'confirmed' ELSE q.review_status END AS review_status
    FROM b_questions q LEFT JOIN decisions d ON d.question_id = q.id
    LEFT JOIN verdicts v ON v.image_id = d.image_id AND v.student_id = d.student_id),
  outcome AS (SELECT v.*, EXISTS (SELECT 1 FROM after a WHERE a.image_id = v.image_id AND a.{PENDING}) AS remaining FROM verdicts v)"""


def _decided(t):
    return lc.apply_review_decisions(t("b_questions"), t("b_images"), t.sql(DECISIONS))


def _reprocessed(t):
    return lc.reprocess_images(t("b_questions"), t("b_images"), _image_requests(t), NOW)


def _cancelled(t):
    return lc.cancel_images(t("b_questions"), t("b_images"), _image_requests(t))


def _confirmed(t):
    edits = _requested(t).distinct().withColumn("subject", F.lit("math"))
    return lc.confirm_edited(t("b_questions"), t("b_images"), edits)


EDITED = f"""hit AS (SELECT q.* FROM b_questions q JOIN {REQUESTED} r ON r.id = q.id AND r.student_id = q.student_id WHERE q.deleted_at IS NULL),
  after AS (SELECT q.id, q.image_id, q.deleted_at, CASE WHEN h.id IS NOT NULL THEN 'math' ELSE q.subject END AS subject,
    CASE WHEN h.review_status = 'needs_review' THEN 'confirmed' ELSE q.review_status END AS review_status
    FROM b_questions q LEFT JOIN hit h ON h.id = q.id)"""


def _deletion(t):
    requests = t.sql("SELECT id AS account_id, appid, CASE WHEN id % 10 = 0 THEN 'nobody' ELSE openid END AS openid FROM b_identities")
    return lc.request_account_deletion(t("b_accounts"), t("b_identities"), requests, NOW)


def _recovery(t):
    requests = t.sql("SELECT id AS account_id, CAST(CASE WHEN id % 4 = 0 THEN 9 ELSE token_version END AS INT) AS token_version FROM b_accounts")
    return lc.recover_account_deletion(t("b_accounts"), t("b_students"), requests, "2024-01-02 00:00:00")


def tables_for_purge(t):
    return {
        "accounts": t("b_accounts"),
        "students": t("b_students"),
        "wechat_identities": t("b_identities"),
        "wrong_images": t("b_images"),
        "wrong_questions": t("b_questions"),
        "practice_sheets": t("b_sheets"),
        "sheet_items": t("b_sheet_items"),
        "practice_attempts": t("b_attempts"),
        "practice_results": t("b_results"),
    }


def _account_purge(t):
    return lc.purge_accounts(tables_for_purge(t), "2024-01-04 00:00:00")


def _ids(frames):
    parts = [df.select(F.lit(name).alias("kind"), F.col(df.columns[0] if name == "purged" else "id").alias("id")) for name, df in frames]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


LEAVERS = f"""gone AS (SELECT id FROM b_accounts WHERE status = 'pending_deletion' AND deletion_due_at <= {DUE}),
  pupils AS (SELECT id FROM b_students WHERE account_id IN (SELECT id FROM gone))"""

JOBS = """SELECT event_id AS id, CAST(event_id % 3 AS INT) AS attempt_count, CASE WHEN event_type = 'view' THEN NULL ELSE ts END AS next_attempt_at,
  CASE WHEN event_type = 'view' THEN NULL ELSE 'Old' END AS last_error FROM events"""
OUTCOMES = "SELECT event_id AS id, value > 30 AS ok, CASE WHEN value > 30 THEN NULL ELSE 'OSError' END AS error FROM events WHERE event_type <> 'click'"


def _retries(t):
    return lc.schedule_cleanup_retries(t.sql(JOBS), t.sql(OUTCOMES), "2024-01-03 00:00:00")


STEP = """CASE WHEN (j.next_attempt_at IS NULL OR j.next_attempt_at <= TIMESTAMP '2024-01-03 00:00:00') AND o.ok IS NOT NULL
  THEN CASE WHEN o.ok THEN 'deleted' ELSE 'failed' END ELSE 'kept' END"""

CASES = {
    "f1_soft_delete": Case(
        lambda t: lc.soft_delete(t("b_questions"), _requested(t), NOW).select("id", "deleted_at"),
        f"""SELECT q.id, CASE WHEN q.deleted_at IS NULL AND r.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE q.deleted_at END AS deleted_at
           FROM b_questions q LEFT JOIN {REQUESTED} r ON r.id = q.id AND r.student_id = q.student_id""",
    ),
    "f1_restore": Case(
        lambda t: lc.restore(t("b_questions"), _requested(t), NOW).select("id", "deleted_at"),
        f"""SELECT q.id, CASE WHEN q.deleted_at > {CUTOFF} AND r.id IS NOT NULL THEN NULL ELSE q.deleted_at END AS deleted_at
           FROM b_questions q LEFT JOIN {REQUESTED} r ON r.id = q.id AND r.student_id = q.student_id""",
    ),
    "f2_purge_questions": Case(
        lambda t: _purged(t)["questions"].select("id"), f"SELECT id FROM b_questions WHERE NOT {PURGE}"
    ),
    "f2_purge_references": Case(
        lambda t: _purged(t)["items"],
        f"""WITH gone AS (SELECT id FROM b_questions WHERE {PURGE}), refs AS (SELECT l_orderkey*100 + l_linenumber*10 + l_suppkey % 10 AS id,
             l_orderkey*10 + l_linenumber AS q, l_returnflag FROM lineitem)
           SELECT r.id, CASE WHEN g.id IS NULL THEN r.q END AS wrong_question_id,
             CASE WHEN g.id IS NULL AND r.l_returnflag = 'A' THEN r.q END AS derived_from FROM refs r LEFT JOIN gone g ON g.id = r.q""",
    ),
    "f3_orphan_images": Case(
        lambda t: lc.orphan_images(t("b_images"), _purged(t)["questions"], NOW).select("id", "original_url"),
        f"""SELECT id, original_url FROM b_images i WHERE created_at < {CUTOFF} AND NOT EXISTS (
             SELECT 1 FROM b_questions q WHERE q.image_id = i.id AND NOT {PURGE})""",
    ),
    "f4_review_outcome": Case(lambda t: _decided(t)["outcome"], f"WITH {OUTCOME} SELECT * FROM outcome"),
    "f4_review_questions": Case(
        lambda t: _decided(t)["questions"].select("id", "collection_status", "review_status"),
        f"WITH {OUTCOME} SELECT id, collection_status, review_status FROM after",
    ),
    "f4_review_images": Case(
        lambda t: _decided(t)["images"].select("id", "status"),
        f"""WITH {OUTCOME} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM outcome o WHERE o.image_id = i.id AND o.verdict = 'accepted' AND NOT o.remaining)
           THEN 'confirmed' ELSE status END AS status FROM b_images i""",
    ),
    "f5_reprocess_outcome": Case(
        lambda t: _reprocessed(t)["outcome"],
        f"""SELECT r.id, r.student_id, CASE WHEN i.id IS NULL THEN 'image_not_found' WHEN NOT EXISTS (SELECT 1 FROM b_questions q
             WHERE q.image_id = r.id AND q.student_id = r.student_id AND {PENDING}) THEN 'no_pending_questions' ELSE 'accepted' END AS verdict
           FROM {IMAGE_REQUESTS} r LEFT JOIN b_images i ON i.id = r.id AND i.student_id = r.student_id""",
    ),
    "f5_reprocess_questions": Case(
        lambda t: _reprocessed(t)["questions"].select("id", "collection_status", "deleted_at"),
        f"""WITH hit AS (SELECT q.id FROM b_questions q JOIN {IMAGE_REQUESTS} r ON r.id = q.image_id AND r.student_id = q.student_id WHERE q.{PENDING})
           SELECT id, CASE WHEN id IN (SELECT id FROM hit) THEN 'superseded' ELSE collection_status END AS collection_status,
             CASE WHEN id IN (SELECT id FROM hit) THEN TIMESTAMP '{NOW}' ELSE deleted_at END AS deleted_at FROM b_questions""",
    ),
    "f6_cancel_images": Case(
        lambda t: _cancelled(t)["images"].select("id", "status", "error_code", "error_message"),
        f"""SELECT i.id, CASE WHEN r.id IS NOT NULL THEN 'cancelled' ELSE status END AS status,
             CASE WHEN r.id IS NULL THEN error_code END AS error_code, CASE WHEN r.id IS NULL THEN error_message END AS error_message
           FROM b_images i LEFT JOIN {IMAGE_REQUESTS} r ON r.id = i.id AND r.student_id = i.student_id AND i.status IN {ACTIVE}""",
    ),
    "f6_cancel_questions": Case(
        lambda t: _cancelled(t)["questions"].select("id", "collection_status"),
        f"""SELECT q.id, CASE WHEN i.id IS NOT NULL AND q.{PENDING} THEN 'ignored' ELSE q.collection_status END AS collection_status FROM b_questions q
           LEFT JOIN (SELECT i.id, i.student_id FROM b_images i JOIN {IMAGE_REQUESTS} r ON r.id = i.id AND r.student_id = i.student_id
             WHERE i.status IN {ACTIVE}) i ON i.id = q.image_id AND i.student_id = q.student_id""",
    ),
    "f7_retry_failed_images": Case(
        lambda t: lc.retry_failed_images(t("b_images"), _image_requests(t))["outcome"],
        f"""SELECT r.id, r.student_id, CASE WHEN i.id IS NULL THEN 'image_not_found' WHEN i.status <> 'failed' THEN 'not_failed' ELSE 'accepted' END AS verdict
           FROM {IMAGE_REQUESTS} r LEFT JOIN b_images i ON i.id = r.id AND i.student_id = r.student_id""",
    ),
    "f7_retry_image_states": Case(
        lambda t: lc.retry_failed_images(t("b_images"), _image_requests(t))["images"].select("id", "status", "error_code"),
        f"""SELECT i.id, CASE WHEN r.id IS NOT NULL THEN 'pending' ELSE status END AS status, CASE WHEN r.id IS NULL THEN error_code END AS error_code
           FROM b_images i LEFT JOIN {IMAGE_REQUESTS} r ON r.id = i.id AND r.student_id = i.student_id AND i.status = 'failed'""",
    ),
    "f8_confirm_edited": Case(
        lambda t: _confirmed(t)["questions"].select("id", "subject", "review_status"),
        f"WITH {EDITED} SELECT id, subject, review_status FROM after",
    ),
    "f8_confirmed_images": Case(
        lambda t: _confirmed(t)["confirmed_images"],
        f"""WITH {EDITED} SELECT DISTINCT image_id AS id FROM hit h WHERE review_status = 'needs_review' AND NOT EXISTS (
             SELECT 1 FROM after a WHERE a.image_id = h.image_id AND a.deleted_at IS NULL AND a.review_status = 'needs_review')""",
    ),
    "f9_request_deletion": Case(
        lambda t: _deletion(t)["accounts"].select("id", "status", "deletion_due_at", "token_version"),
        f"""SELECT id, 'pending_deletion' AS status, CASE WHEN status = 'active' THEN TIMESTAMP '{NOW}' + INTERVAL 30 DAY ELSE deletion_due_at END AS deletion_due_at,
             CAST(token_version + CASE WHEN status = 'active' THEN 1 ELSE 0 END AS INT) AS token_version FROM b_accounts WHERE id % 10 <> 0
           UNION ALL SELECT id, status, deletion_due_at, token_version FROM b_accounts WHERE id % 10 = 0""",
    ),
    "f9_request_outcome": Case(
        lambda t: _deletion(t)["outcome"].select("account_id", "verdict"),
        """SELECT id AS account_id, CASE WHEN id % 10 = 0 THEN 'invalid_identity' WHEN status = 'active' THEN 'accepted' ELSE 'already_pending' END AS verdict
           FROM b_accounts""",
    ),
    "f9_recover_outcome": Case(
        lambda t: _recovery(t)["outcome"].select("account_id", "verdict"),
        """SELECT id AS account_id, CASE WHEN status <> 'pending_deletion' OR id % 4 = 0 THEN 'unavailable'
             WHEN deletion_due_at <= TIMESTAMP '2024-01-02 00:00:00' THEN 'expired'
             WHEN NOT EXISTS (SELECT 1 FROM b_students s WHERE s.account_id = a.id AND s.is_default) THEN 'unavailable' ELSE 'accepted' END AS verdict
           FROM b_accounts a""",
    ),
    "f10_purge_accounts": Case(
        lambda t: (lambda r: _ids([(k, r[k]) for k in ["purged", "accounts", "students", "wechat_identities", "wrong_images", "wrong_questions",
                                                      "practice_sheets", "sheet_items", "practice_attempts", "practice_results"]]))(_account_purge(t)),
        f"""WITH {LEAVERS} SELECT 'purged' AS kind, id FROM gone
           UNION ALL SELECT 'accounts', id FROM b_accounts WHERE id NOT IN (SELECT id FROM gone)
           UNION ALL SELECT 'students', id FROM b_students WHERE account_id NOT IN (SELECT id FROM gone)
           UNION ALL SELECT 'wechat_identities', id FROM b_identities WHERE account_id NOT IN (SELECT id FROM gone)
           UNION ALL SELECT 'wrong_images', id FROM b_images WHERE student_id NOT IN (SELECT id FROM pupils)
           UNION ALL SELECT 'wrong_questions', id FROM b_questions WHERE student_id NOT IN (SELECT id FROM pupils)
           UNION ALL SELECT 'practice_sheets', id FROM b_sheets WHERE student_id NOT IN (SELECT id FROM pupils)
           UNION ALL SELECT 'sheet_items', i.id FROM b_sheet_items i JOIN b_sheets s ON s.id = i.sheet_id WHERE s.student_id NOT IN (SELECT id FROM pupils)
           UNION ALL SELECT 'practice_attempts', id FROM b_attempts WHERE student_id NOT IN (SELECT id FROM pupils)
           UNION ALL SELECT 'practice_results', r.id FROM b_results r JOIN b_attempts a ON a.id = r.attempt_id WHERE a.student_id NOT IN (SELECT id FROM pupils)""",
    ),
    "f10_purge_jobs": Case(
        lambda t: _account_purge(t)["jobs"],
        f"""WITH {LEAVERS} SELECT 'avatar' AS storage_kind, avatar_object_key AS object_path FROM b_accounts WHERE id IN (SELECT id FROM gone) AND avatar_object_key IS NOT NULL
           UNION ALL SELECT 'pdf', pdf_url FROM b_sheets WHERE student_id IN (SELECT id FROM pupils) AND pdf_url IS NOT NULL
           UNION ALL SELECT 'upload', original_url FROM b_images WHERE student_id IN (SELECT id FROM pupils) AND original_url NOT LIKE '%/x.jpg'""",
    ),
    "f11_file_cleanup_jobs": Case(
        lambda t: lc.file_cleanup_jobs(
            t.sql("SELECT id, original_url AS path FROM b_images UNION ALL SELECT id, pdf_url FROM b_sheets "
                  "UNION ALL SELECT page_id, url FROM pages UNION ALL SELECT id, avatar_object_key FROM b_accounts"), "path")
        .select("id", "path", "storage_kind", "object_path"),
        r"""SELECT id, path, CASE WHEN ok THEN CASE split_part(path, '/', 2) WHEN 'uploads' THEN 'upload' WHEN 'pdfs' THEN 'pdf' ELSE 'avatar' END END AS storage_kind,
             CASE WHEN ok THEN path END AS object_path FROM (SELECT *, regexp_full_match(path, '/(uploads|pdfs|avatars)/[^/]+') AS ok FROM (
             SELECT id, original_url AS path FROM b_images UNION ALL SELECT id, pdf_url FROM b_sheets
             UNION ALL SELECT page_id, url FROM pages UNION ALL SELECT id, avatar_object_key FROM b_accounts) u) x""",
    ),
    "f12_cleanup_retries": Case(
        lambda t: _retries(t)["jobs"],
        f"""SELECT j.id, CAST(j.attempt_count + CASE WHEN {STEP} = 'failed' THEN 1 ELSE 0 END AS INT) AS attempt_count,
             CASE WHEN {STEP} = 'failed' THEN TIMESTAMP '2024-01-04 00:00:00' ELSE j.next_attempt_at END AS next_attempt_at,
             CASE WHEN {STEP} = 'failed' THEN o.error ELSE j.last_error END AS last_error
           FROM ({JOBS}) j LEFT JOIN ({OUTCOMES}) o ON o.id = j.id WHERE {STEP} <> 'deleted'""",
    ),
    "f12_cleanup_summary": Case(
        lambda t: _retries(t)["summary"],
        f"""SELECT count(*) FILTER (WHERE {STEP} = 'deleted') AS files_deleted, count(*) FILTER (WHERE {STEP} = 'failed') AS file_failures
           FROM ({JOBS}) j LEFT JOIN ({OUTCOMES}) o ON o.id = j.id""",
    ),
}

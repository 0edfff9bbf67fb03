import uuid

from pyspark.sql import functions as F

from relearn.catalog import Case
from relearn.catalog import lifecycle as life
from relearn.catalog.practice import COVERAGE, _items
from relearn.catalog.recognition import EXACT, FLOW_IMAGES, SETTLED, responses, settle
from relearn.catalog.sources import domain_tables
from relearn.functions.ranks import ensure_checkpoint_dir, pin
from relearn.operators.lifecycle import retry_failed_images
from relearn.plans.grading import ATTEMPT_COLUMNS, RESULT_COLUMNS
from relearn.plans.retention import run_retention
from relearn.streaming.jobs import (
    Snapshots,
    first_within,
    read_arrivals,
    run_available,
    stream_attempts,
    stream_recognition,
    stream_retention,
)

NOW = "1998-12-01 00:00:00"


def _run_folder(t):
    """A folder of its own for this run, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def _recognition(t, again=False):
    """Image states after all responses; with ``again``, failed images are queued anew and answered well."""
    folder = _run_folder(t)
    arrivals = f"{folder}/arrivals"
    responses(t).repartition(2, "image_id").write.parquet(arrivals)
    snapshots = Snapshots(t.spark, f"{folder}/state", parts=4, fold_every=3)
    none = F.lit(None).cast("string")
    snapshots.write("images", t("b_taken").withColumns({"error_code": none, "error_message": none}), -1)

    def run():
        stream = read_arrivals(t.spark, arrivals, "image_id long, content string", files_per_batch=1)
        stream_recognition(
            stream, lambda batch, images, n: settle(t, batch, images, EXACT, str(n)), snapshots, f"{folder}/checkpoint").awaitTermination()

    run()
    if again:
        now = snapshots.current("images", "image_updates")
        queued = retry_failed_images(now, now.filter("status = 'failed'").select("id", "student_id"))["images"]
        snapshots.replace("images", "image_updates", queued)
        body = F.lit('{"items":[{"raw_text":"a","instruction":"i","prompt_text":"p","subject":"math","question_type":"other","confidence":1}]}')
        now.select(F.col("id").alias("image_id"), body.alias("content")).coalesce(1).write.mode("append").parquet(arrivals)
        run()
    return snapshots.current("images", "image_updates").select(*SETTLED)


STREAMED = FLOW_IMAGES.replace("WITH ", "", 1)
STATES = "SELECT id, student_id, status, question_count, subject, recognition_correction, NULL AS error_code, NULL AS error_message FROM b_taken WHERE id NOT IN (SELECT id FROM done)"
RECOGNITION_SQL = f"WITH done AS (WITH {STREAMED}) SELECT * FROM done UNION ALL {STATES}"
AGAIN_SQL = f"""WITH done AS (WITH {STREAMED}) SELECT id, student_id, CASE WHEN status = 'failed' THEN 'needs_review' ELSE status END AS status,
    CASE WHEN status = 'failed' THEN 1 ELSE question_count END AS question_count, CASE WHEN status = 'failed' THEN coalesce(nullif(subject, ''), 'math') ELSE subject END AS subject,
    NULL AS recognition_correction, NULL AS error_code, NULL AS error_message FROM done UNION ALL {STATES}"""


def _attempts(t):
    folder = _run_folder(t)
    answers = t("b_answers").groupBy("attempt_id").agg(F.collect_list(F.struct("sheet_item_id", "is_correct")).alias("answers"))
    rows = t("b_attempts").drop("attempt_no", "accuracy", "updated_at").join(answers.withColumnRenamed("attempt_id", "id"), "id", "left")
    rows = pin(rows)  # read once for the times and once a batch
    # Four batches of one file, each a quarter of the time, the earlier attempts first.
    low, high = rows.agg(F.min("created_at"), F.max("created_at")).first()
    span = lambda to: F.timestamp_diff("MICROSECOND", F.lit(low), to)
    quarter = F.floor(span(F.col("created_at")) * 4 / (span(F.lit(high)) + 1))
    for n in range(4):
        rows.filter(quarter == n).coalesce(1).write.mode("append").parquet(f"{folder}/arrivals")
    snapshots = Snapshots(t.spark, f"{folder}/state", parts=4, fold_every=3)
    none = t("b_attempts").limit(0)
    snapshots.write("practice_sheets", t("b_sheets"), -1)
    snapshots.write("sheet_items", _items(t), -1)
    snapshots.write("wrong_questions", t("b_practised"), -1)
    empty = none.withColumn("correct_count", F.lit(0)).withColumn("total_count", F.lit(0)).select(*ATTEMPT_COLUMNS)
    snapshots.write("practice_attempts", empty, -1)
    results = t("b_results").limit(0).withColumn("derived_count", F.lit(0)).select(*RESULT_COLUMNS)
    snapshots.write("practice_results", results, -1)

    def split(batch):
        flat = batch.select(F.col("id").alias("attempt_id"), F.inline("answers"))
        return batch.drop("answers"), flat

    arrivals = read_arrivals(t.spark, f"{folder}/arrivals", rows.schema, files_per_batch=1)
    stream_attempts(arrivals, split, snapshots, f"{folder}/checkpoint").awaitTermination()
    return snapshots


def _attempt_verdicts(t):
    done = _attempts(t)
    numbers = done.everything("practice_attempts").select("id", "attempt_no", "correct_count", "accuracy")
    return done.everything("verdicts").join(numbers, "id", "left")


ATTEMPT_SQL = f"""WITH {COVERAGE},
  judged AS (SELECT a.*, CASE WHEN s.generation_status <> 'completed' THEN 'sheet_not_ready' WHEN v.verdict <> 'ok' THEN v.verdict END AS problem
    FROM b_attempts a JOIN b_sheets s ON s.id = a.sheet_id JOIN verdicts v ON v.attempt_id = a.id),
  owners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id, idempotency_key ORDER BY created_at, id) AS rn FROM judged WHERE problem IS NULL) x WHERE rn = 1),
  outcome AS (SELECT j.id, j.sheet_id, j.created_at, CASE WHEN o.id = j.id THEN 'accepted' WHEN o.id IS NOT NULL AND (j.created_at > o.created_at OR (j.created_at = o.created_at AND j.id > o.id))
      THEN CASE WHEN o.sheet_id = j.sheet_id THEN 'replay' ELSE 'conflict' END ELSE j.problem END AS verdict, o.id AS owner_id
    FROM judged j LEFT JOIN owners o ON o.student_id = j.student_id AND o.idempotency_key = j.idempotency_key),
  numbered AS (SELECT id, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY created_at, id) AS INT) AS attempt_no FROM outcome WHERE verdict = 'accepted'),
  summed AS (SELECT attempt_id AS id, CAST(count(*) FILTER (WHERE is_correct) AS INT) AS correct_count,
    CAST(round(count(*) FILTER (WHERE is_correct) / count(*), 4) AS DECIMAL(5,4)) AS accuracy FROM b_answers GROUP BY 1)
  SELECT o.id, o.verdict, CASE WHEN o.verdict IN ('accepted', 'replay', 'conflict') THEN o.owner_id END AS recorded_id, n.attempt_no,
    CASE WHEN n.id IS NOT NULL THEN s.correct_count END AS correct_count, CASE WHEN n.id IS NOT NULL THEN s.accuracy END AS accuracy
  FROM outcome o LEFT JOIN numbered n ON n.id = o.id LEFT JOIN summed s ON s.id = o.id"""


STATE = ["id", "wrong_count", "mastery_status", "mastered_at", "last_practiced_at"]
# A question moves with its student's attempt if that was the latest of its batch to touch the question.
STATES_SQL = ATTEMPT_SQL[: ATTEMPT_SQL.index("numbered AS")] + f"""span AS (SELECT min(epoch_us(created_at)) AS low, max(epoch_us(created_at)) AS high FROM b_attempts),
  placed AS (SELECT a.*, floor((epoch_us(a.created_at) - low) * 4.0 / (high - low + 1)) AS batch FROM b_attempts a JOIN outcome o ON o.id = a.id AND o.verdict = 'accepted', span),
  answered AS (SELECT a.attempt_id, i.wrong_question_id, coalesce(i.wrong_question_id, i.snapshot_source_id) AS q, a.is_correct
    FROM b_answers a JOIN placed o ON o.id = a.attempt_id JOIN b_sheet_items i ON i.id = a.sheet_item_id),
  settled AS (SELECT attempt_id, q, bool_and(is_correct) AS ok FROM answered WHERE q IS NOT NULL GROUP BY ALL),
  last_touch AS (SELECT wrong_question_id AS q, batch, arg_max(o.id, struct_pack(c := o.created_at, i := o.id)) AS attempt_id
    FROM answered r JOIN placed o ON o.id = r.attempt_id WHERE wrong_question_id IS NOT NULL GROUP BY ALL),
  moves AS (SELECT s.q, o.student_id, s.ok, o.completed_at, struct_pack(c := o.created_at, i := o.id) AS place, l.attempt_id IS NOT NULL AS is_last
    FROM settled s JOIN placed o ON o.id = s.attempt_id LEFT JOIN last_touch l ON l.q = s.q AND l.batch = o.batch AND l.attempt_id = o.id),
  changed AS (SELECT q, student_id, count(*) FILTER (WHERE NOT ok) AS wrong, bool_or(is_last) AS moved, arg_max(ok, place) FILTER (WHERE is_last) AS ok,
    arg_max(completed_at, place) FILTER (WHERE is_last) AS done_at FROM moves GROUP BY ALL)
  SELECT p.id, CAST(CASE WHEN c.q IS NULL THEN p.wrong_count ELSE CASE WHEN p.wrong_count = 0 THEN 1 ELSE p.wrong_count END + wrong END AS INT) AS wrong_count,
    CASE WHEN c.moved THEN CASE WHEN c.ok THEN 'mastered' ELSE 'learning' END ELSE p.mastery_status END AS mastery_status,
    CASE WHEN c.moved THEN CASE WHEN c.ok THEN c.done_at END ELSE p.mastered_at END AS mastered_at,
    CASE WHEN c.moved THEN c.done_at ELSE p.last_practiced_at END AS last_practiced_at
  FROM b_practised p LEFT JOIN changed c ON c.q = p.id AND c.student_id = p.student_id AND p.deleted_at IS NULL"""


def _forever_keys(t):
    """Keys seen for the first time, remembered by the stream's own state."""
    folder = _run_folder(t)
    t("b_attempts").select("id", "student_id", "idempotency_key").repartition(2).write.parquet(f"{folder}/arrivals")
    seen = read_arrivals(t.spark, f"{folder}/arrivals", "id long, student_id long, idempotency_key string").dropDuplicates(["student_id", "idempotency_key"])
    snapshots = Snapshots(t.spark, f"{folder}/state")
    run_available(seen, lambda df, n: snapshots.append("keys", df.drop("id"), n), f"{folder}/checkpoint").awaitTermination()
    return snapshots.everything("keys")


def _bounded_keys(t):
    """Keys seen for the first time within a year: all rows arrive, then, in a second batch, all of them again."""
    folder = _run_folder(t)
    rows = t("b_attempts").select("id", "student_id", "idempotency_key", F.col("created_at").cast("timestamp").alias("at"))
    schema = "id long, student_id long, idempotency_key string, at timestamp"
    rows.write.parquet(f"{folder}/arrivals")  # all files make one batch
    snapshots = Snapshots(t.spark, f"{folder}/state")

    def run():
        seen = first_within(read_arrivals(t.spark, f"{folder}/arrivals", schema), ["student_id", "idempotency_key"], "at", "400 days")
        run_available(seen, lambda df, n: snapshots.append("keys", df.drop("id", "at"), n), f"{folder}/checkpoint").awaitTermination()

    run()
    rows.write.mode("append").parquet(f"{folder}/arrivals")
    run()
    return snapshots.everything("keys")


def _retention_inputs(t):
    tables = domain_tables(t)
    tables["file_cleanup_jobs"] = t.sql(life.JOBS).select(
        F.col("id").cast("string").alias("id"), F.lit("upload").alias("storage_kind"),
        F.concat(F.lit("/uploads/e"), F.col("id").cast("string")).alias("object_path"), "attempt_count", "last_error", "next_attempt_at")
    old = t.sql(life.OUTCOMES).select(F.lit("upload").alias("storage_kind"), F.concat(F.lit("/uploads/e"), F.col("id").cast("string")).alias("object_path"), "ok", "error")
    pdfs = t("b_sheets").filter("pdf_url IS NOT NULL").select(
        F.lit("pdf").alias("storage_kind"), F.col("pdf_url").alias("object_path"), (F.col("id") % 2 == 0).alias("ok"), F.lit("OSError").alias("error"))
    return tables, old.unionByName(pdfs)


def _retention(t):
    tables, outcomes = _retention_inputs(t)
    return run_retention(tables, outcomes, "2024-01-04 00:00:00")[1]


def _timed_retention(t):
    """Questions and images that are left after two ticks of the same time."""
    folder = _run_folder(t)
    snapshots = Snapshots(t.spark, f"{folder}/state")
    tables, outcomes = _retention_inputs(t)
    for name, df in tables.items():
        snapshots.write(name, df, -1)
    outcomes = pin(outcomes)
    ticks = t.spark.range(2).select(F.to_timestamp_ntz(F.lit("2024-01-04 00:00:00")).alias("now"))
    ticks.repartition(2).write.parquet(f"{folder}/ticks")

    def save(snapshot, counts, batch_id):
        for name, df in snapshot.items():
            snapshots.write(name, df, batch_id)

    stream = read_arrivals(t.spark, f"{folder}/ticks", "now timestamp_ntz", files_per_batch=1)
    stream_retention(
        stream, lambda n: ({x: snapshots.before(x, n) for x in tables}, outcomes), save, f"{folder}/checkpoint").awaitTermination()
    left = [snapshots.latest(x).select(F.lit(x).alias("table_name"), F.col("id").cast("string").alias("id")) for x in ("wrong_questions", "wrong_images")]
    return left[0].unionByName(left[1])


RETENTION_SQL = """WITH gone AS (SELECT id FROM b_accounts WHERE status = 'pending_deletion' AND deletion_due_at <= TIMESTAMP '2024-01-04 00:00:00'),
  pupils AS (SELECT id FROM b_students WHERE account_id IN (SELECT id FROM gone)),
  cut AS (SELECT id, image_id FROM b_questions WHERE coalesce(deleted_at < TIMESTAMP '2023-12-05 00:00:00', false) OR (collection_status = 'ignored' AND updated_at < TIMESTAMP '2023-12-05 00:00:00')),
  orphans AS (SELECT id FROM b_images i WHERE created_at < TIMESTAMP '2023-12-05 00:00:00' AND NOT EXISTS (SELECT 1 FROM b_questions q WHERE q.image_id = i.id AND q.id NOT IN (SELECT id FROM cut))),
  queued AS (SELECT avatar_object_key AS p, true AS ok, true AS skip FROM b_accounts WHERE id IN (SELECT id FROM gone) AND avatar_object_key IS NOT NULL
    UNION ALL SELECT pdf_url, id % 2 = 0, false FROM b_sheets WHERE student_id IN (SELECT id FROM pupils) AND pdf_url IS NOT NULL
    UNION ALL SELECT original_url, true, true FROM b_images WHERE student_id IN (SELECT id FROM pupils) AND original_url NOT LIKE '%/x.jpg' AND id NOT IN (SELECT id FROM orphans)),
  old AS (SELECT value > 30 AS ok FROM events WHERE event_type <> 'click' AND (event_type = 'view' OR ts <= TIMESTAMP '2024-01-04 00:00:00'))
  SELECT 'questions_deleted' AS counter, count(*) AS n FROM cut UNION ALL SELECT 'images_deleted', count(*) FROM orphans
  UNION ALL SELECT 'accounts_deleted', count(*) FROM gone UNION ALL SELECT 'files_queued', count(*) FROM queued
  UNION ALL SELECT 'files_deleted', (SELECT count(*) FROM queued WHERE NOT skip AND ok) + (SELECT count(*) FROM old WHERE ok)
  UNION ALL SELECT 'file_failures', (SELECT count(*) FROM queued WHERE NOT skip AND NOT ok) + (SELECT count(*) FROM old WHERE NOT ok)"""

LEFT_SQL = RETENTION_SQL[: RETENTION_SQL.index("queued AS")] + """done AS (SELECT 1)
  SELECT 'wrong_questions' AS table_name, CAST(id AS VARCHAR) AS id FROM b_questions
    WHERE id NOT IN (SELECT id FROM cut) AND (student_id IS NULL OR student_id NOT IN (SELECT id FROM pupils))
  UNION ALL SELECT 'wrong_images', CAST(id AS VARCHAR) FROM b_images
    WHERE id NOT IN (SELECT id FROM orphans) AND (student_id IS NULL OR student_id NOT IN (SELECT id FROM pupils))"""

CASES = {
    "h1_stream_recognition": Case(_recognition, RECOGNITION_SQL),
    "h1_recognised_again": Case(lambda t: _recognition(t, again=True), AGAIN_SQL),
    "h2_stream_attempts": Case(_attempt_verdicts, ATTEMPT_SQL),
    "h2_question_states": Case(lambda t: _attempts(t).current("wrong_questions", "question_updates").select(*STATE), STATES_SQL),
    "h2_stream_keys": Case(_forever_keys, "SELECT DISTINCT student_id, idempotency_key FROM b_attempts"),
    "h2_bounded_keys": Case(_bounded_keys, "SELECT DISTINCT student_id, idempotency_key FROM b_attempts"),
    "h3_retention": Case(_retention, RETENTION_SQL),
    "h3_timed_retention": Case(_timed_retention, LEFT_SQL),
}

"""Replays and repeated runs must change nothing."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from relearn.catalog import streams as cs
from relearn.catalog.practice import _items
from relearn.plans.grading import ATTEMPT_COLUMNS, RESULT_COLUMNS, record_attempts
from relearn.plans.retention import run_retention
from relearn.functions.ranks import pin
from relearn.streaming.jobs import Snapshots, first_within, read_arrivals, run_available, stream_attempts, stream_recognition, stream_retention, timer


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_attempts_delivered_twice_count_once(spark, tables, tmp_path):
    answers = tables("b_answers").groupBy("attempt_id").agg(F.collect_list(F.struct("sheet_item_id", "is_correct")).alias("answers"))
    rows = tables("b_attempts").drop("attempt_no", "accuracy", "updated_at").join(answers.withColumnRenamed("attempt_id", "id"), "id", "left")
    rows = pin(rows)
    state = Snapshots(spark, str(tmp_path / "state"))
    state.write("practice_sheets", tables("b_sheets"), -1)
    state.write("sheet_items", _items(tables), -1)
    state.write("wrong_questions", tables("b_practised"), -1)
    none = tables("b_attempts").limit(0).withColumn("correct_count", F.lit(0)).withColumn("total_count", F.lit(0))
    state.write("practice_attempts", none.select(*ATTEMPT_COLUMNS), -1)
    state.write("practice_results", tables("b_results").limit(0).withColumn("derived_count", F.lit(0)).select(*RESULT_COLUMNS), -1)

    def split(batch):
        return batch.drop("answers"), batch.select(F.col("id").alias("attempt_id"), F.inline("answers"))

    def deliver(name):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "arrivals"))
        stream = read_arrivals(spark, str(tmp_path / "arrivals"), rows.schema)
        stream_attempts(stream, split, state, str(tmp_path / "checkpoint")).awaitTermination()
        return rows_of(state.current("wrong_questions", "question_updates")), rows_of(state.everything("practice_attempts"))

    first = deliver("one")
    assert len(first[1]) > 0
    assert deliver("two") == first
    verdicts = state.latest("verdicts")
    assert verdicts.filter("verdict = 'accepted'").count() == 0


def test_responses_delivered_twice_count_once(spark, tables, tmp_path):
    rows = pin(cs.responses(tables))
    state = Snapshots(spark, str(tmp_path / "state"))
    state.write("images", rows.select(F.col("image_id").alias("id"), F.lit("pending").alias("status")), -1)

    def process(batch, images, _):
        known = batch.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi")
        return {"questions": known, "images": images.withColumn("status", F.lit("confirmed"))}

    def deliver():
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "arrivals"))
        stream = read_arrivals(spark, str(tmp_path / "arrivals"), rows.schema)
        stream_recognition(stream, process, state, str(tmp_path / "checkpoint")).awaitTermination()
        return state.everything("questions").count()

    n = rows.count()
    assert [deliver(), deliver()] == [n, n]
    # Sent back to pending, an image is recognised again; folding the updates keeps the state.
    now = state.current("images", "image_updates")
    queued = now.withColumn("status", F.when(F.col("id") == 1, "pending").otherwise(F.col("status")))
    state.replace("images", "image_updates", queued)
    assert deliver() == n + 1
    before = rows_of(state.current("images", "image_updates"))
    state.replace("images", "image_updates")
    assert rows_of(state.current("images", "image_updates")) == before


def test_retention_run_twice(spark, tables):
    inputs, outcomes = cs._retention_inputs(tables)
    inputs = {k: pin(v) for k, v in inputs.items()}
    outcomes = pin(outcomes.withColumn("ok", F.lit(True)))
    once, counts = run_retention(inputs, outcomes, "2024-01-04 00:00:00")
    assert {r.counter for r in counts.collect() if r.n} >= {"questions_deleted", "files_deleted"}
    once = {k: pin(v) for k, v in once.items()}
    twice, again = run_retention(once, outcomes, "2024-01-04 00:00:00")
    assert {r.counter: r.n for r in again.collect()} == dict.fromkeys(
        ["questions_deleted", "images_deleted", "accounts_deleted", "files_queued", "files_deleted", "file_failures"], 0)
    for name in once:
        assert rows_of(twice[name]) == rows_of(once[name]), name


def test_bounded_duplicates_expire(spark, tmp_path):
    schema = "k string, n int, at timestamp"
    path, state = str(tmp_path / "in"), Snapshots(spark, str(tmp_path / "state"))

    def deliver(*rows):
        spark.createDataFrame([(k, n, datetime.fromisoformat(at)) for k, n, at in rows], schema).coalesce(1).write.mode("append").parquet(path)
        seen = first_within(read_arrivals(spark, path, schema), ["k"], "at", "2 days")
        run_available(seen, lambda df, n: state.append("keys", df, n), str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(r.n for r in state.everything("keys").collect())

    assert deliver(("a", 1, "2024-01-01"), ("a", 1, "2024-01-01"), ("b", 2, "2024-01-01")) == [1, 2]
    assert deliver(("a", 3, "2024-01-02"), ("c", 4, "2024-01-04")) == [1, 2, 4]  # a repeat within the delay
    assert deliver(("d", 5, "2024-01-20")) == [1, 2, 4, 5]
    # a's memory has expired: a new event counts again, an event older than the watermark is dropped as late.
    assert deliver(("a", 6, "2024-01-21"), ("b", 7, "2024-01-02")) == [1, 2, 4, 5, 6]


def test_retention_by_timer(spark, tables, tmp_path):
    inputs, outcomes = cs._retention_inputs(tables)
    state, runs = {k: pin(v) for k, v in inputs.items()}, []
    outcomes = pin(outcomes.withColumn("ok", F.lit(True)))

    def save(snapshot, counts, batch_id):
        state.update({k: pin(v) for k, v in snapshot.items()})
        runs.append({r.counter: r.n for r in counts.collect()})

    query = stream_retention(timer(spark), lambda n: (dict(state), outcomes), save, str(tmp_path / "checkpoint"), every="1 second")
    try:
        end = time.monotonic() + 240
        while len(runs) < 2 and query.isActive and time.monotonic() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert len(runs) >= 2 and runs[0]["questions_deleted"] > 0
    assert set(runs[1].values()) == {0}


def test_state_in_buckets_stays_level(spark, tmp_path):
    """Twenty batches of changes: folded state equals all updates applied, and old versions go."""
    state = Snapshots(spark, str(tmp_path / "state"), parts=4, fold_every=3)
    state.write("wrong_questions", spark.range(12).select("id", F.lit(0).alias("wrong_count")), -1)
    files = []
    for n in range(20):
        change = spark.createDataFrame([(n % 12, n, n)], "id long, wrong_count int, batch_id long")
        state.fold("wrong_questions", "question_updates", n)
        state.merge("verdicts", n)
        state.append("question_updates", change, n)
        state.append("verdicts", change.limit(0) if n == 7 else change, n)
        files.append(sum(1 for path in (tmp_path / "state").rglob("*.parquet") if "verdicts" not in str(path)))
    now = {r.id: r.wrong_count for r in state.current("wrong_questions", "question_updates").collect()}
    assert now == {n % 12: n for n in range(20)}
    assert max(files[10:]) <= max(files[:10])
    assert sorted(r.wrong_count for r in state.everything("verdicts").collect()) == [n for n in range(20) if n != 7]
    # A batch that is run again sees the state before it, also when its fold was done already.
    before = rows_of(state.current("wrong_questions", "question_updates", 19))
    state.fold("wrong_questions", "question_updates", 19)
    assert rows_of(state.current("wrong_questions", "question_updates", 19)) == before
    with pytest.raises(ValueError, match="parts"):
        Snapshots(spark, str(tmp_path / "state"), parts=5).latest("wrong_questions")


def test_only_touched_buckets_are_read(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path), parts=4)
    state.write("wrong_questions", spark.range(100).select("id", F.lit(0).alias("wrong_count")), -1)
    asked = spark.createDataFrame([(5,), (None,)], "id int")
    among = state.touched(asked, "id")
    found = state.latest("wrong_questions", among)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "state_bucket" in plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    near = {r.id for r in found.collect()}
    assert 5 in near and len(near) < 100
    assert found.columns == ["id", "wrong_count"]
    # No key at all touches nothing.
    assert state.latest("wrong_questions", state.touched(asked.limit(0), "id")).count() == 0
    assert Snapshots(spark, str(tmp_path / "other")).touched(asked, "id") is None


def test_history_of_results_replaces_their_attempts(spark):
    """Stored results with their attempts' times give the same updates as results that meet the attempts."""
    at = datetime.fromisoformat
    attempt = "id long, sheet_id long, student_id long, attempt_no int, idempotency_key string, created_at timestamp_ntz, completed_at timestamp_ntz"
    stored = spark.createDataFrame([(1, 1, 1, 1, "a", at("2024-01-03"), at("2024-01-03"))], attempt)
    new = spark.createDataFrame(
        [(2, 1, 1, "b", at("2024-01-02"), at("2024-01-02")), (3, 1, 1, "c", at("2024-01-04"), at("2024-01-04"))],
        "id long, sheet_id long, student_id long, idempotency_key string, created_at timestamp_ntz, completed_at timestamp_ntz")
    stored = stored.withColumns({"correct_count": F.lit(1), "total_count": F.lit(1), "updated_at": F.col("created_at"), "accuracy": F.lit(1).cast("decimal(5,4)")})
    sheets = spark.createDataFrame([(1, 1, "completed", None, "/x.pdf")], "id long, student_id long, generation_status string, generation_error_message string, pdf_url string")
    items = spark.createDataFrame(
        [(10, 1, 5, (5,)), (11, 1, 6, (6,))],
        "id long, sheet_id long, wrong_question_id long, question_snapshot struct<source_wrong_question_id:long>")
    results = spark.createDataFrame([(1, 10, 5, True, 0, at("2024-01-03"))], "attempt_id long, sheet_item_id long, wrong_question_id long, is_correct boolean, derived_count int, created_at timestamp_ntz")
    questions = spark.createDataFrame(
        [(5, 1, 1, "learning", None, None, None), (6, 1, 0, "learning", None, None, None)],
        "id long, student_id long, wrong_count int, mastery_status string, mastered_at timestamp_ntz, last_practiced_at timestamp_ntz, deleted_at timestamp_ntz")

    def updates(rows, history):
        answers = spark.createDataFrame([(a, i, i == 10) for a in rows for i in (10, 11)], "attempt_id long, sheet_item_id long, is_correct boolean")
        batch = new.filter(F.col("id").isin(rows))
        return rows_of(record_attempts(batch, answers, sheets, items, stored, results, questions, history)["updates"])

    history = results.select("attempt_id", "wrong_question_id", "created_at")
    older = updates([2], None)
    assert older == updates([2], history)
    # Question 5 has a newer attempt, so its mastery stays; question 6 is answered wrongly for the first time.
    assert "id=5, last_practiced_at=None" in older[0] and "wrong_count=1" in older[0]
    assert "id=6, last_practiced_at=datetime.datetime(2024, 1, 2" in older[1] and "wrong_count=2" in older[1]
    assert any("mastered'" in row for row in updates([3], None))

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from relearn.functions.times import month_start_utc, to_naive_utc
from relearn.operators import lifecycle as lc
from relearn.operators import practice as pr


def test_wrong_count_delta(spark):
    table = [(None, True, 0), (None, False, 1), (True, True, 0), (False, False, 0), (False, True, -1), (True, False, 1)]
    df = spark.createDataFrame(table, "p boolean, n boolean, want int")
    assert df.filter(pr.wrong_count_delta(F.col("p"), F.col("n")) != F.col("want")).count() == 0


def test_accuracy_rounds_half_up(spark):
    pairs = [(c, t) for t in range(1, 81) for c in range(t + 1)] + [(1, 20000), (3, 20000), (49999, 10**9), (50001, 10**9)]
    df = spark.createDataFrame(pairs, "c long, t long")
    for c, t, got in df.select("c", "t", pr.exact_accuracy(F.col("c"), F.col("t"))).collect():
        assert got == (Decimal(c) / Decimal(t)).quantize(Decimal("0.0001"), ROUND_HALF_UP), (c, t)


def test_groups_and_summary(spark):
    items = spark.createDataFrame(
        [(1, 9, 5, None), (2, 9, 5, None), (3, 9, None, 6), (4, 9, None, None)],
        "id int, sheet_id int, wrong_question_id int, source int",
    ).withColumn("question_snapshot", F.struct(F.col("source").alias("source_wrong_question_id")))
    attempts = spark.createDataFrame([(70, 9)], "id int, sheet_id int")
    answers = spark.createDataFrame([(70, 1, True), (70, 2, False), (70, 3, True), (70, 4, True)], "attempt_id int, sheet_item_id int, is_correct boolean")
    graded = pr.graded_answers(attempts, items, answers)
    groups = {r.source_question_id: (r.n_items, r.all_correct) for r in pr.group_results(graded).collect()}
    assert groups == {5: (2, False), 6: (1, True), None: (1, True)}
    summary = pr.attempt_summary(graded).first()
    assert (summary.correct_count, summary.total_count, summary.accuracy) == (3, 4, Decimal("0.7500"))
    derived = {r.sheet_item_id: r.derived_count for r in pr.build_results(graded, pr.group_results(graded)).collect()}
    assert derived == {1: 1, 2: 1, 3: 0, 4: 0}


@pytest.mark.parametrize(
    "answers, verdict",
    [
        ([], "empty"),
        ([1, 1, 2, 9], "duplicate"),
        ([1], "missing"),
        ([1, 2, 9], "extra"),
        ([1, 2], "ok"),
    ],
)
def test_coverage(spark, answers, verdict):
    items = spark.createDataFrame([(1, 5), (2, 5), (9, 6)], "id int, sheet_id int")
    attempts = spark.createDataFrame([(70, 5)], "id int, sheet_id int")
    rows = spark.createDataFrame([(70, a, True) for a in answers], "attempt_id int, sheet_item_id int, is_correct boolean")
    assert pr.answer_coverage(attempts, items, rows).first().verdict == verdict


def test_edit_then_revert_restores_counts(spark, tables):
    """Changing answers and changing them back leaves a zero net change per question."""
    from relearn.catalog.practice import _items

    attempts, results, items = tables("b_attempts"), tables("b_results"), _items(tables)
    edits = attempts.select(F.col("id").alias("attempt_id"), "updated_at")
    stored = results.select("attempt_id", "sheet_item_id", "is_correct")
    flipped = stored.withColumn("is_correct", ~F.col("is_correct"))
    there = pr.edit_attempts(attempts, items, results, edits, flipped)["groups"]
    changed = results.drop("is_correct").join(flipped, ["attempt_id", "sheet_item_id"])
    back = pr.edit_attempts(attempts, items, changed, edits, stored)["groups"]
    net = there.unionByName(back).groupBy("attempt_id", "source_question_id").agg(F.sum("delta").alias("d"))
    assert there.count() > 0
    assert net.filter("d <> 0").count() == 0


def test_month_start_and_zone(spark):
    row = spark.range(1).select(
        month_start_utc("2026-08-01 00:30:00").cast("string").alias("m"),
        to_naive_utc(F.lit("2024-03-01 07:00:00").cast("timestamp_ntz"), "Asia/Shanghai").cast("string").alias("z"),
        to_naive_utc(F.lit("2024-03-01 07:00:00").cast("timestamp_ntz"), None).cast("string").alias("n"),
    ).first()
    assert (row.m, row.z, row.n) == ("2026-07-31 16:00:00", "2024-02-29 23:00:00", "2024-03-01 07:00:00")


def test_cleanup_paths(spark):
    good = {"/pdfs/a.pdf": ("pdf", "/pdfs/a.pdf"), "/uploads//b.jpg": ("upload", "/uploads/b.jpg"), "/avatars/./c": ("avatar", "/avatars/c")}
    bad = ["/pdfs", "/pdfs/", "/pdfs/..", "/pdfs/a/b", "pdfs/a", "/other/a", "", None, "/pdfs/../uploads/x", "//pdfs/a"]
    df = spark.createDataFrame([(p,) for p in [*good, *bad]], "path string")
    for path, kind, clean in lc.file_cleanup_jobs(df, "path").collect():
        assert (kind, clean) == good.get(path, (None, None)), path


def test_retention_boundaries(spark):
    rows = [(1, "1998-11-01 00:00:00", "collected", None), (2, "1998-10-31 23:59:59", "collected", None),
            (3, None, "ignored", "1998-10-31 23:59:59"), (4, None, "ignored", "1998-11-01 00:00:00"), (5, None, "collected", "1990-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id int, d string, collection_status string, u string").select(
        "id", F.col("d").cast("timestamp_ntz").alias("deleted_at"), "collection_status", F.col("u").cast("timestamp_ntz").alias("updated_at"))
    assert sorted(r.id for r in df.filter(lc.purge_due("1998-12-01 00:00:00")).collect()) == [2, 3]
    mine = df.withColumn("student_id", F.lit(1))
    kept = lc.restore(mine, mine.select("id", "student_id"), "1998-12-01 00:00:00")
    assert {r.id for r in kept.filter("deleted_at IS NOT NULL").collect()} == {1, 2}

"""Orderings must not depend on whether a key is hot or on how rows are partitioned."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from relearn.functions import ranks
from relearn.operators import practice as pr
from relearn.operators.library import list_questions
from relearn.operators.sheets import expand_sheet_items


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share key 0, half of those one time; some keys are null."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = 0 if i % 3 == 0 else None if i % 50 == 1 else rng.randint(1, 40)
        rows.append((key, 5 if i % 6 == 0 else rng.randint(0, 9), i, rng.choice([-1, 0, 1])))
    return spark.createDataFrame(rows, "k int, t int, id int, v int").repartition(7)


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rank_rows_hot_equals_window(skewed):
    order = [F.col("t").desc(), F.col("id").asc()]
    plain = skewed.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
    hot = ranks.rank_rows(skewed, ["k"], order, "p", hot_rows=20)
    assert as_set(hot) == as_set(plain)
    assert as_set(ranks.rank_rows(skewed, ["k"], order, "p")) == as_set(plain)


def test_hot_key_is_split_over_tasks(skewed):
    order = [F.col("t").asc(), F.col("id").asc()]
    placed = ranks.global_position(skewed, [F.col("k").asc(), *order], "g")
    assert sorted(r.g for r in placed.select("g").collect()) == list(range(900))
    tasks = placed.filter("k = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_global_position_follows_order(skewed):
    placed = ranks.global_position(skewed, [F.col("t").desc_nulls_last(), F.col("id").asc()], "g")
    rows = sorted(placed.collect(), key=lambda r: r.g)
    assert [(-r.t, r.id) for r in rows] == sorted((-r.t, r.id) for r in rows)


def test_page_rows_deep_equals_shallow(skewed, monkeypatch):
    order = [F.col("id").asc()]
    shallow = as_set(ranks.page_rows(skewed, ["k"], order, 5, 3))
    monkeypatch.setattr(ranks, "GROUP_LIMIT_ROWS", 1)
    assert as_set(ranks.page_rows(skewed, ["k"], order, 5, 3)) == shallow


@pytest.mark.parametrize("hot_rows", [10_000, 16])
def test_running_fold_equals_loop(spark, skewed, hot_rows):
    deltas = skewed.filter("k IS NOT NULL").select(F.col("k").alias("question_id"), F.col("id").alias("seq"), F.col("v").alias("delta"))
    questions = spark.range(41).select(F.col("id").cast("int").alias("id"), (F.col("id") % 3).cast("int").alias("wrong_count"))
    got = {(r.question_id, r.seq): r.wrong_count for r in pr.apply_wrong_count(questions, deltas, hot_rows).collect()}
    state, want = {}, {}
    for row in sorted(deltas.collect(), key=lambda r: (r.question_id, r.seq)):
        count = state.get(row.question_id, row.question_id % 3)
        state[row.question_id] = max(1, (count or 1) + row.delta)
        want[(row.question_id, row.seq)] = state[row.question_id]
    assert got == want


def test_number_attempts_hot(spark, skewed):
    new = skewed.filter("k IS NOT NULL").select(F.col("k").alias("sheet_id"), F.col("t").alias("created_at"), "id")
    old = spark.createDataFrame([(0, 4), (1, 2)], "sheet_id int, attempt_no int")
    cold = as_set(pr.number_attempts(new, old).select("id", "attempt_no"))
    assert as_set(pr.number_attempts(new, old, hot_rows=10).select("id", "attempt_no")) == cold
    assert min(n for _, n in cold) == 1


def test_sheet_items_hot(spark):
    originals = spark.range(200).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("sheet_id"), F.col("id").alias("pos"),
        F.col("id").alias("question_id"), F.lit("q").alias("display_text"))
    variants = originals.select("sheet_id", F.col("question_id").alias("source_id"), F.lit(0).alias("variant"), "display_text")
    cold = expand_sheet_items(originals, variants).select("sheet_id", "wrong_question_id", "question_type", "sort_order")
    hot = expand_sheet_items(originals, variants, hot_rows=10).select(*cold.columns)
    assert as_set(hot) == as_set(cold)


def test_results_do_not_depend_on_partitions(spark, tables):
    want = as_set(list_questions(tables("b_questions"), limit=3).select("id", "position"))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert as_set(list_questions(tables("b_questions"), limit=3).select("id", "position")) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

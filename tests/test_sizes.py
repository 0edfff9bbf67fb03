"""What a small file of many rows does to plans: nothing is sent whole through the driver, no task does all the work."""

import re

import pytest
from pyspark.sql import functions as F

from relearn.catalog import streams
from relearn.catalog.bindings import Tables
from relearn.operators import recognition as rec
from relearn.operators import sheets as sh
from relearn.session import broadcast_measured


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A part table of few bytes and many rows."""
    path = str(tmp_path_factory.mktemp("many"))
    part = spark.range(400_000).select(
        F.col("id").alias("p_partkey"), F.lit("large ring").alias("p_name"), F.lit("Brand#7").alias("p_brand"),
        F.lit("LARGE").alias("p_type"), F.lit(1).alias("p_size"), F.lit(900.0).alias("p_retailprice"))
    part.coalesce(1).write.parquet(f"{path}/part.parquet")
    return path


def test_joins_are_not_broadcast_by_the_size_of_files(spark, folder):
    lines = Tables(spark, folder)("b_ocr_lines")
    done = lines.groupBy("line_no", "text").count()
    assert sum(r["count"] for r in done.collect()) == 800_000
    assert "BroadcastExchange" not in done._jdf.queryExecution().executedPlan().toString()


def test_small_sides_are_still_broadcast(spark, folder):
    t = Tables(spark, folder)
    few = t("part").filter("p_partkey < 10").select("p_partkey")
    joined = t("part").join(few, "p_partkey")
    assert joined.count() == 10
    counted = joined.groupBy("p_type").count()
    counted.collect()
    assert "BroadcastHashJoin" in counted._jdf.queryExecution().executedPlan().toString()


def test_responses_are_dealt_out_before_they_are_checked(spark, folder):
    rows = Tables(spark, folder)("b_vision").filter("response_id < 400").coalesce(1)
    checked = rec.validate_items(rows)
    sizes = [r["n"] for r in checked.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 400 and len(sizes) > 1 and max(sizes) < 400


def test_payloads_are_checked_once(spark):
    documents = spark.createDataFrame([(1, '{"items":[]}'), (2, "no json")], "batch_id long, payload_json string")
    requested = spark.createDataFrame([(1, 10), (2, 20)], "batch_id long, source_id long").withColumns(
        {"instruction": F.lit("i"), "prompt_text": F.lit("p"), "question_type": F.lit("other"), "display_text": F.lit("d")})
    plan = sh.parse_payloads(requested, documents, 2)["verdicts"]._jdf.queryExecution().optimizedPlan().toString()
    assert "json_object_keys" not in plan


def test_arrivals_are_written_by_more_than_one_task(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "_run_folder", lambda t: str(tmp_path))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        keys = streams._bounded_keys(tables)
        assert keys.count() == tables("b_attempts").select("student_id", "idempotency_key").distinct().count()
    finally:
        spark.conf.set(key, before)
    assert len(list((tmp_path / "arrivals").glob("*.parquet"))) > 2


def test_parts_are_a_quarter_unless_the_session_says_otherwise(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        broadcast_measured(spark)
        assert spark.conf.get(key) == "16m"
        spark.conf.set(key, "8m")
        broadcast_measured(spark)
        assert spark.conf.get(key) == "8m"
    finally:
        spark.conf.set(key, before or "16m")


def test_shuffles_begin_with_many_parts(spark, folder):
    t = Tables(spark, folder)
    grouped = t("part").groupBy("p_partkey").agg(F.count("*").alias("n"))
    assert "hashpartitioning(p_partkey" in (plan := grouped._jdf.queryExecution().executedPlan().toString())
    assert max(int(n) for n in re.findall(r"hashpartitioning\(p_partkey#\d+L?, (\d+)\)", plan)) >= 256
    assert grouped.rdd.getNumPartitions() < 256

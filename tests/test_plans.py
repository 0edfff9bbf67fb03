"""What the plans must look like at scale."""

from pyspark.sql import functions as F

from relearn.operators import library as lib


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_limit_before_the_shuffle(spark, tables):
    plan = plan_of(lib.incomplete_images(tables("b_images"), 3))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_filters_and_columns_reach_the_scan(spark, tmp_path, tables):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    path = str(tmp_path / "q")
    tables("b_questions").write.parquet(path)
    df = lib.list_questions(spark.read.parquet(path), subject="math", limit=5).select("id")
    plan = plan_of(df)
    assert "PushedFilters" in plan and "IsNull(deleted_at)" in plan and "EqualTo(collection_status,collected)" in plan
    scan = plan[plan.index("ReadSchema"):]
    assert "mastery_status" not in scan and "tags" not in scan


def test_counts_are_reduced_before_the_shuffle(spark, tables):
    plan = plan_of(lib.profile_stats(tables("b_questions"), tables("b_students"), F.lit("1998-03-15 08:30:00").cast("timestamp_ntz")))
    assert "partial_count" in plan

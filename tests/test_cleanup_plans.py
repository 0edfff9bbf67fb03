"""Object paths are read once per file to delete, after the joins that choose the files."""

import re

from relearn.operators import lifecycle as lc
from relearn.plans.retention import run_retention

PATHS = [
    "/uploads/a.jpg", "/uploads//a.jpg", "/pdfs/./b.pdf", "//uploads/a", "///uploads/a", "/uploads/..", "/uploads/a/.", "/other/a",
    "", None, "/avatars/x/y", "uploads/a", "/uploads/.../",
]


def test_paths_are_read_once_and_after_the_choice_of_rows(spark):
    rows = spark.createDataFrame(list(enumerate(PATHS)), "id long, path string")
    chosen = rows.join(spark.range(50), "id", "left_semi")
    plan = lc.cleanup_jobs_for(chosen, "path", "upload")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3
    assert "regexp" not in plan[plan.index("Join"):]


def test_files_keep_their_kinds_and_other_columns(spark):
    rows = spark.createDataFrame([(i, p, "old") for i, p in enumerate(PATHS)], "id long, object_path string, storage_kind string")
    got = {r["id"]: (r["storage_kind"], r["object_path"]) for r in lc.file_cleanup_jobs(rows, "object_path").collect()}
    found = {0: ("upload", "/uploads/a.jpg"), 1: ("upload", "/uploads/a.jpg"), 2: ("pdf", "/pdfs/b.pdf"), 4: ("upload", "/uploads/a"),
             6: ("upload", "/uploads/a"), 12: ("upload", "/uploads/...")}
    assert got == {i: found.get(i, (None, None)) for i in range(len(PATHS))}
    jobs = lc.cleanup_jobs_for(rows, "object_path", "upload").collect()
    assert sorted(map(tuple, jobs)) == sorted(v for v in found.values() if v[0] == "upload")


def test_retention_reads_each_path_of_three_tables_once(spark, tables):
    from relearn.catalog import streams

    counts = run_retention(*streams._retention_inputs(tables), "2024-01-04 00:00:00")[1]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if re.search(r"\bFilter\b", line)]
    assert filters and not any("regexp_replace" in line for line in filters)

"""The two retention jobs as one run that can be repeated without further effect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relearn.operators import lifecycle as lc
from relearn.operators.identity import natural_id


def run_retention(
    tables: dict[str, DataFrame], outcomes: DataFrame, now: lc.Moment
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Purge questions, then orphan images, then accounts, then fold in file deletions.

    ``outcomes``(storage_kind, object_path, ok, error) says how attempted file deletions
    went. Returns the next snapshot and the counts of the run.
    """
    at = lc.moment(now)
    purged = lc.purge_questions(tables["wrong_questions"], tables["sheet_items"], tables["practice_results"], now)
    orphans = lc.orphan_images(tables["wrong_images"], purged["questions"], now)
    after = dict(tables)
    after["wrong_questions"] = purged["questions"]
    after["sheet_items"] = purged["items"]
    after["practice_results"] = purged["results"]
    after["wrong_images"] = tables["wrong_images"].join(orphans.select("id"), "id", "left_anti")
    gone = lc.purge_accounts(after, now)

    jobs = tables["file_cleanup_jobs"]
    queued = gone["jobs"].distinct().select(
        natural_id("file", F.col("storage_kind"), F.col("object_path")).cast(jobs.schema["id"].dataType).alias("id"),
        "storage_kind",
        "object_path",
        F.lit(0).alias("attempt_count"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(None).cast("timestamp_ntz").alias("next_attempt_at"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )
    known = jobs.select("storage_kind", "object_path")
    fresh = queued.join(known, ["storage_kind", "object_path"], "left_anti")
    waiting = jobs.unionByName(fresh.select(*[c for c in jobs.columns if c in fresh.columns]), allowMissingColumns=True)
    settled = waiting.select("id", "storage_kind", "object_path").join(outcomes, ["storage_kind", "object_path"])
    retried = lc.schedule_cleanup_retries(waiting, settled, now)

    snapshot = {k: v for k, v in gone.items() if k not in ("jobs", "purged")}
    snapshot["file_cleanup_jobs"] = retried["jobs"]
    parts = {
        "questions_deleted": purged["purged"],
        "images_deleted": orphans,
        "accounts_deleted": gone["purged"],
        "files_queued": fresh,
    }
    counted = [df.agg(F.lit(name).alias("counter"), F.count("*").alias("n")) for name, df in parts.items()]
    done = retried["summary"].select(
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in ("files_deleted", "file_failures")
        ]))
    )
    counts = reduce(DataFrame.unionByName, [*counted, done])
    return snapshot, counts

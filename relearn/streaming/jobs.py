"""Structured Streaming jobs over snapshots kept in a shared folder.

A version is named after the batch that wrote it, so a batch that is run again overwrites its
own output and nothing else.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from relearn.functions.ranks import pin
from relearn.operators.practice import source_question
from relearn.plans.grading import record_attempts
from relearn.plans.retention import run_retention
from relearn.sources.changes import overlay


#: The column whose hash decides the bucket of a row, by table; the jobs below read along these columns.
BUCKETED = {
    "practice_sheets": "id",
    "sheet_items": "sheet_id",
    "practice_attempts": "student_id",
    "practice_results": "wrong_question_id",
    "wrong_questions": "id",
    "question_updates": "id",
    "images": "id",
    "image_updates": "id",
}
BUCKET = "state_bucket"
MERGED = "-merged"


class Snapshots:
    """Versions of named tables below one folder; version -1 is what the job starts from.

    A table is one parquet folder partitioned by version, so Spark's partition pruning picks
    versions and a plan names one path however many batches there were. Next to it stands a small
    table of the versions written completely. With more than one of ``parts``, a version of a table in
    BUCKETED is partitioned further by a hash of its column, and a batch reads the buckets it touches only.
    ``parts`` belongs to the folder: another number is refused. After ``fold_every`` batches
    ``fold`` and ``merge`` make few files of many and delete what the two newest generations do not need.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 1, fold_every: int = 32):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.parts = parts
        self.fold_every = fold_every

    def _bucketed(self, name: str) -> str | None:
        return BUCKETED.get(name.removesuffix(MERGED)) if self.parts > 1 else None

    def _bucket(self, column: str) -> Column:
        # As text, since equal numbers of other widths have other hashes.
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(self.parts)).cast("int")

    def touched(self, df: DataFrame, column: str) -> list[int] | None:
        """Buckets that the values of a column fall in, at most ``parts`` numbers; None without buckets."""
        if self.parts == 1:
            return None
        return sorted(row[0] for row in df.select(self._bucket(column).alias(BUCKET)).distinct().collect())

    def write(self, name: str, df: DataFrame, version: int) -> None:
        """One version of a table; the same version written again replaces itself."""
        part, column = f"v={version + 1:012d}", self._bucketed(name)
        if column is None:
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{part}")
        else:
            # Rebalancing gathers small buckets in few files and splits a large one.
            laid = df.withColumn(BUCKET, self._bucket(column)).hint("rebalance", BUCKET)
            laid.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.folder}/{name}/{part}")
        done = self.spark.range(1).select(
            F.lit(version).cast("long").alias("version"), F.lit(df.schema.json()).alias("shape"), F.lit(self.parts).alias("parts"))
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}-versions/{part}")

    append = write  # rows of one batch; ``upto`` and ``everything`` read all batches together

    def _versions(self, name: str, below: int = 1 << 62, after: int = -2) -> DataFrame | None:
        try:
            found = self.spark.read.schema("version long, shape string, parts int").parquet(f"{self.folder}/{name}-versions")
        except AnalysisException:  # nothing was written yet
            return None
        return found.filter((F.col("version") < below) & (F.col("version") > after))

    def newest(self, name: str, below: int = 1 << 62) -> int | None:
        """The newest complete version below ``below``."""
        versions = self._versions(name, below)
        return None if versions is None else versions.agg(F.max("version")).first()[0]

    def _rows(self, name: str, among: list[int] | None = None) -> DataFrame:
        shape, parts = self._versions(name).agg(F.max_by(F.struct("shape", "parts"), "version")).first()[0]
        if parts != self.parts:
            raise ValueError(f"{name} was written in {parts} parts, not {self.parts}")
        bucketed = self._bucketed(name) is not None
        # Stated, because versions without rows have no files to tell it.
        fields = T.StructType.fromJson(json.loads(shape)).add("v", T.LongType())
        rows = self.spark.read.schema(fields.add(BUCKET, T.IntegerType()) if bucketed else fields).parquet(f"{self.folder}/{name}")
        return rows.filter(F.col(BUCKET).isin(among)) if bucketed and among is not None else rows

    def before(self, name: str, version: int, among: list[int] | None = None) -> DataFrame:
        """The newest complete version older than ``version``, or its buckets ``among``."""
        found = self.newest(name, version)
        if found is None:
            raise FileNotFoundError(f"no snapshot of {name} before version {version}")
        return self._rows(name, among).filter(F.col("v") == found + 1).drop("v", BUCKET)

    def latest(self, name: str, among: list[int] | None = None) -> DataFrame:
        return self.before(name, 1 << 62, among)

    def upto(self, name: str, version: int, after: int = -2, among: list[int] | None = None) -> DataFrame:
        """All rows appended before ``version`` and after ``after``, or those in buckets ``among``."""
        if self.newest(name, version) is None:
            raise FileNotFoundError(f"no rows of {name} before version {version}")

        def between(rows: DataFrame, low: int) -> DataFrame:
            return rows.filter((F.col("v") <= version) & (F.col("v") > low + 1)).drop("v", BUCKET)

        merged = self.newest(name + MERGED, version)
        if merged is None or merged <= after:
            return between(self._rows(name, among), after)
        return between(self._rows(name + MERGED, among), after).unionByName(between(self._rows(name, among), merged))

    def everything(self, name: str) -> DataFrame:
        return self.upto(name, 1 << 62)

    def current(
        self, name: str, updates: str, version: int = 1 << 62, key: str = "id", among: list[int] | None = None
    ) -> DataFrame:
        """The table ``name`` before ``version``: its newest snapshot under the newest of the later ``updates``.

        A batch thus writes what it changed, not the table.
        """
        base = self.before(name, version, among)
        if self.newest(updates, version) is None:
            return base
        changed = self.upto(updates, version, self.newest(name, version), among)
        fields = [c for c in changed.columns if c not in (key, "batch_id")]
        newest = changed.groupBy(key).agg(F.max_by(F.struct(*fields), "batch_id").alias("_u"))
        return overlay(base, newest.select(key, "_u.*"), key)

    def replace(self, name: str, updates: str, df: DataFrame | None = None) -> None:
        """Make ``df``, or the current table, the snapshot that later updates lie on.

        This folds the updates so far away from later reads, and is how changes from elsewhere, such as
        images sent back to pending, enter between two runs of a stream.
        """
        last = self.newest(updates)
        df = self.current(name, updates) if df is None else df
        self.write(name, pin(df), self.newest(name) if last is None else max(last, self.newest(name)))

    def _many(self, name: str, version: int, after: int) -> bool:
        versions = self._versions(name, version, after)
        return versions is not None and versions.count() >= self.fold_every

    def fold(self, name: str, updates: str, version: int) -> None:
        """At the start of batch ``version``: once many batches changed ``name``, write it as a snapshot.

        All earlier batches are done then, so none of them is read again. The last snapshot and the
        updates on it stay for readers who began before; what is older is deleted.
        """
        base = self.newest(name, version)
        if self._many(updates, version, base):
            self.write(name, pin(self.current(name, updates, version)), version - 1)
            self._delete(name, base)
            self._delete(updates, base + 1)

    def merge(self, name: str, version: int) -> None:
        """At the start of batch ``version``: write the rows of many appended versions as one version.

        Rows already merged are not written again. The small versions stay until the next time.
        """
        merged = self.newest(name + MERGED, version)
        merged = -2 if merged is None else merged
        if self._many(name, version, merged):
            self.write(name + MERGED, self.upto(name, version, merged), version - 1)
            self._delete(name, merged + 1)

    def _delete(self, name: str, below: int) -> None:
        """Delete the versions of ``name`` older than ``below``."""
        for table in (name, f"{name}-versions"):
            files = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.folder}/{table}").inputFiles()
            if not files:
                continue
            # Spark tells the full address of the folder; the versions in it are few.
            store, path = fs.FileSystem.from_uri(files[0][: files[0].rindex(f"/{table}/v=")] + f"/{table}")
            for found in store.get_file_info(fs.FileSelector(path)):
                number = re.fullmatch(r"v=(\d+)", found.base_name)
                if number and int(number[1]) - 1 < below:
                    store.delete_dir(found.path)


def read_arrivals(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, **options: str) -> DataFrame:
    """A stream of parquet files dropped into ``path``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.options(**options).parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, batch by batch, then stop."""
    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_within(arrivals: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first arrival of each key, remembered for ``delay`` of event time only.

    The bounded form of removing duplicates: a key leaves the state once the watermark, ``delay`` behind the
    newest ``time``, has passed ``delay`` after its own, so state grows with the keys of that span and
    not with all keys ever seen. A repeat within the span has no effect; one that comes after it counts as
    new, unless it is itself older than the watermark and dropped as late.
    """
    return arrivals.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def timer(spark: SparkSession) -> DataFrame:
    """A stream of ticks: ``now`` in UTC, one a second; a trigger takes what has come since the last one."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.select(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("timestamp").cast("timestamp_ntz")).alias("now"))


def stream_retention(
    ticks: DataFrame,
    load: Callable[[int], tuple[dict[str, DataFrame], DataFrame]],
    save: Callable[[dict[str, DataFrame], DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Run retention whenever ``ticks``(now) brings a time: every ``every`` (``1 day``), or over what has come.

    ``load`` gives the tables and file outcomes before a batch's number, ``save`` takes the next snapshot and the
    counts of the run. The time is data of the batch, so a batch that is run again after a failure
    uses the same one and writes the same rows; several ticks in one batch count as the latest.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        now = batch.agg(F.max("now")).first()[0]  # one time a batch
        if now is not None:
            tables, outcomes = load(batch_id)
            snapshot, counts = run_retention(tables, outcomes, now)
            save(snapshot, counts, batch_id)

    if every is None:
        return run_available(ticks, each, checkpoint)
    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def stream_attempts(
    arrivals: DataFrame,
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    snapshots: Snapshots,
    checkpoint: str,
) -> StreamingQuery:
    """Grade arriving attempts against the stored ones and move the questions' state.

    ``split`` turns a batch into attempts and answers. Attempts, results and changed question
    fields are appended per batch, so what a batch writes grows with the batch; sheets, items
    and questions come from their snapshots. Of each table a batch reads the buckets of its own
    students, sheets and questions. Stored results carry their attempt's ``created_at``, as the ones
    written here do, so a question's history needs no attempts of other students. Keys are remembered
    for ever, as stored attempts.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        snapshots.fold("wrong_questions", "question_updates", batch_id)
        for log in ("verdicts", "practice_attempts", "practice_results"):
            snapshots.merge(log, batch_id)
        new, answers = (pin(df) for df in split(batch))
        sheets = snapshots.touched(new, "sheet_id")
        items = snapshots.latest("sheet_items", sheets)
        ours = items.join(new.select("sheet_id").distinct(), "sheet_id", "left_semi")
        asked = snapshots.touched(source_question(ours), "source_question_id")
        results = snapshots.upto("practice_results", batch_id, among=asked)
        out = record_attempts(
            new, answers,
            snapshots.latest("practice_sheets", sheets),
            items,
            snapshots.upto("practice_attempts", batch_id, among=snapshots.touched(new, "student_id")),
            results,
            snapshots.current("wrong_questions", "question_updates", batch_id, among=asked),
            results.select("attempt_id", "wrong_question_id", "created_at"),
        )
        snapshots.append("verdicts", out["verdicts"], batch_id)
        snapshots.append("practice_attempts", out["attempts"], batch_id)
        snapshots.append("practice_results", out["results"], batch_id)
        updates = out["updates"].withColumn("batch_id", F.lit(batch_id).cast("long"))
        snapshots.append("question_updates", updates, batch_id)

    return run_available(arrivals, each, checkpoint)


def stream_recognition(
    arrivals: DataFrame,
    process: Callable[[DataFrame, DataFrame, int], dict[str, DataFrame]],
    snapshots: Snapshots,
    checkpoint: str,
) -> StreamingQuery:
    """Turn arriving responses into questions and image states.

    ``process`` maps a batch of responses (one row per image_id), their pending images and the batch's
    number to ``questions`` and ``images``, usually with ``plans.recognition.settle_images``. State decides what
    is claimed: a response delivered twice finds its image settled and has no effect, while an image
    that was sent back to pending is recognised again.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        # The first by all other columns, so that a batch run again keeps the same one.
        order = [c for c in batch.columns if c != "image_id"]
        first = batch.withColumn("_row", F.row_number().over(Window.partitionBy("image_id").orderBy(*order)))
        first = pin(first.filter("_row = 1").drop("_row"))
        snapshots.fold("images", "image_updates", batch_id)
        snapshots.merge("questions", batch_id)
        near = snapshots.touched(first, "image_id")
        known = snapshots.current("images", "image_updates", batch_id, among=near)
        pending = known.filter("status = 'pending'")
        asked = pending.join(first.select(F.col("image_id").alias("id")), "id", "left_semi")
        out = process(first, pin(asked), batch_id)
        snapshots.append("questions", out["questions"], batch_id)
        updates = out["images"].withColumn("batch_id", F.lit(batch_id).cast("long"))
        snapshots.append("image_updates", updates, batch_id)

    return run_available(arrivals, each, checkpoint)

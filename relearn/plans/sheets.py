"""Building sheets: from requests to generation batches, and from variants to stored sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relearn.operators import sheets as sh


def prepare_sheets(
    requests: DataFrame, lines: DataFrame, questions: DataFrame, batch_size: int = 8
) -> dict[str, DataFrame]:
    """Check requests and plan what has to be generated.

    ``requests``(request_id, student_id, optional difficulty_boost), ``lines``(request_id, pos,
    question_id). A request with questions that cannot be printed gets missing_prompts.
    """
    chosen = sh.select_sheet_questions(requests, lines, questions)
    printable = sh.printable_questions(chosen["selected"])
    missing = sh.missing_prompts(printable, "request_id")
    verdicts = chosen["verdicts"].join(missing, "request_id", "left").select(
        "request_id",
        F.when(F.col("missing_count") > 0, "missing_prompts").otherwise(F.col("verdict")).alias("verdict"),
        F.coalesce("missing_count", F.lit(0)).alias("missing_count"),
    )
    if "difficulty_boost" in requests.columns:
        printable = printable.join(requests.select("request_id", "difficulty_boost"), "request_id")
    ready = printable.join(verdicts.filter("verdict = 'ok'").select("request_id"), "request_id", "left_semi")
    return {"verdicts": verdicts, "planned": sh.plan_derivatives(ready, batch_size)}


def finish_sheets(planned: DataFrame, payloads: DataFrame, count: int) -> dict[str, DataFrame]:
    """Check generated variants and lay out the sheets whose batches all passed.

    ``payloads``(request_id, batch_no, source_id, variant, instruction, prompt_text,
    question_type, answer). With ``count`` 0 the sheets hold the originals only.
    """
    originals = planned.select(
        F.col("request_id").alias("sheet_id"), "pos", "question_id", "display_text", "subject", "batch_no"
    )
    if count == 0:
        none = originals.limit(0).select("sheet_id", F.col("question_id").alias("source_id"), F.lit(0).alias("variant"), "display_text")
        return {"failed": originals.limit(0).select("sheet_id"), "items": sh.expand_sheet_items(originals, none)}

    # A generation batch is one slice of one sheet.
    def batch(df: DataFrame) -> DataFrame:
        return df.withColumn("batch_id", F.struct("request_id", "batch_no"))

    requested = batch(planned.withColumnRenamed("question_id", "source_id")).select(
        "batch_id", "source_id", "instruction", "prompt_text", "question_type"
    )
    checked = sh.validate_derivatives(requested, batch(payloads), count)
    failed = checked["verdicts"].filter("verdict <> 'ok'").select(F.col("batch_id.request_id").alias("sheet_id")).distinct()
    variants = checked["variants"].select(
        F.col("batch_id.request_id").alias("sheet_id"), "source_id", "variant", "display_text"
    )
    kept = [df.join(failed, "sheet_id", "left_anti") for df in (originals, variants)]
    return {"failed": failed, "items": sh.expand_sheet_items(*kept)}

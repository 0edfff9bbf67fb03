"""From validated recognition output to question candidates and image states, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relearn.functions.ranks import pin
from relearn.operators import recognition as rec
from relearn.operators.recognition import Thresholds
from relearn.sources.responses import parse_model_responses

LOCALIZATION_COLUMNS = [
    "image_id", "idx", "matched", "mark_ids", "l", "t", "r", "b",
    "observed_prompt_text", "observed_raw_text", "confidence",
]


def recognize(
    images: DataFrame,
    items: DataFrame,
    marks: DataFrame,
    localizations: DataFrame,
    lines: DataFrame,
    pixels: DataFrame,
    rules: Thresholds = Thresholds(),
    turns: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Candidates to store, the images they settle, and the evidence both rest on: marks and places.

    ``images``(id, subject, recognition_correction, …), ``items`` and ``marks`` of valid
    responses, ``localizations``, ``lines`` read in the crops, ``pixels`` of the images and
    ``turns``(image_id, orientation) of those that are not stored upright.
    A crop contradicted by its own text is withdrawn before the collection decision; the
    mark's reliability is not. Steps that several later ones read are checkpointed, so the
    text and pixel work is done once; calling this therefore runs jobs.
    """
    # Pixels are read once, as one-bit masks; give the pixels of the images at hand only.
    masks = pin(rec.red_masks(pixels, turns))
    evidence = pin(rec.red_evidence(masks, marks, rules))
    valid = evidence.filter("accepted").select("image_id", "mark_id", "l", "t", "r", "b")

    # Images whose marks were all rejected were never localized.
    marked = evidence.groupBy("image_id").agg(F.bool_or("accepted").alias("_any"))
    hopeless = marked.filter("NOT _any").select("image_id")
    tried = localizations.join(hopeless, "image_id", "left_anti")
    dropped = rec.validate_localizations(items, tried, valid)
    standing = tried.join(dropped.filter("reason IS NULL").select("image_id"), "image_id", "left_semi")

    texts = items.select("image_id", "idx", "prompt_text", "raw_text")
    seen = standing.join(texts, ["image_id", "idx"]).withColumn(
        "evidence",
        rec.evidence_matches(
            F.col("prompt_text"), F.col("observed_prompt_text"), F.col("raw_text"), F.col("observed_raw_text")
        ),
    ).drop("prompt_text", "raw_text")
    located = pin(rec.with_geometry(seen, valid))
    checks = pin(rec.local_red_evidence(masks, located, rules))
    checked_places = located.join(checks.select("image_id", "idx", "red_verified"), ["image_id", "idx"], "left")
    judged = pin(rec.review_status(items, checked_places, rules))

    cropped = judged.filter("localization_verified").select("image_id", F.col("idx").alias("target_idx"))
    read = rec.ocr_verdict(lines.join(cropped, ["image_id", "target_idx"], "left_semi"), items, rules)
    read = read.select(
        "image_id", F.col("target_idx").alias("idx"), F.col("status").alias("ocr_status"),
        F.col("matched_index").alias("ocr_matched_index"), F.col("text_summary").alias("ocr_text_summary"),
        F.col("confidence").alias("ocr_confidence"),
    )
    contradicted = F.col("ocr_status") == "contradict"
    checked = (
        judged.join(read, ["image_id", "idx"], "left")
        .withColumn("ocr_status", F.coalesce("ocr_status", F.lit("unavailable")))
        .withColumn("crop_region", F.when(~contradicted, F.col("crop_region")))
        .withColumn("bbox_source", F.when(contradicted, "unverified").otherwise(F.col("bbox_source")))
        .withColumn("review_status", F.when(contradicted, "needs_review").otherwise(F.col("review_status")))
        .withColumn("ocr_text", F.col("raw_text"))
        .withColumn("ocr_answer", F.col("answer"))
        .withColumn("_read_tags", F.col("tags"))
        .withColumn("tags", rec.normalize_tags(F.col("tags"), F.col("question_type")))
    )
    corrections = images.select(F.col("id").alias("image_id"), "recognition_correction")
    decided = pin(rec.collection_decision(checked).join(corrections, "image_id"))
    unique = rec.drop_duplicate_candidates(decided)
    stored = rec.persist_filter(unique)
    return {
        "evidence": evidence,
        "places": rec.localization_documents(located, checks, rules),
        "candidates": stored,
        "images": rec.image_rollup(images, stored, items),
    }


def settle_images(
    images: DataFrame,
    students: DataFrame,
    accounts: DataFrame,
    responses: DataFrame,
    localizations: DataFrame,
    lines: DataFrame,
    pixels: DataFrame,
    rules: Thresholds = Thresholds(),
    content: str = "content",
    run: str = "",
    turns: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Claim the pending images that ``responses``(image_id, content) answer, and settle each.

    Images are claimed by state, so one that was sent back to pending is recognised again, and a
    response to any other image, or to one of an account that is not active, does nothing. A
    response that is empty, no JSON object or against the schema is refused whole: its image
    fails with code and message, and no question comes from it. ``run`` tells question ids of
    several recognitions of an image apart. ``images`` are the changed rows, ``questions`` rows of
    wrong_questions, ``failures`` the refused responses with the paths of their bad fields.
    """
    none = F.lit(None).cast("string")
    for name in ("error_code", "error_message", "recognition_correction"):
        if name not in images.columns:
            images = images.withColumn(name, none)
    claimed = rec.claimable_images(images, students, accounts)
    answered = responses.select("image_id", content).join(claimed.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    parsed = parse_model_responses(answered, content, "ignored_text array<string>")
    checked = pin(rec.validate_items(parsed).drop(content))
    sound = checked.filter("error IS NULL AND valid")
    ids = sound.select("image_id")
    out = recognize(
        claimed.join(ids.withColumnRenamed("image_id", "id"), "id", "left_semi"),
        rec.recognized_items(sound),
        rec.recognized_marks(sound).drop("position"),
        localizations.join(ids, "image_id", "left_semi"),
        lines.join(ids, "image_id", "left_semi"),
        pixels.join(ids, "image_id", "left_semi"),  # no other picture is decoded
        rules,
        turns,
    )
    failed = rec.failed_images(claimed, checked)
    aside = sound.select("image_id", F.col("payload.ignored_text").alias("ignored_text"))
    marks = rec.mark_documents(out["evidence"], rules)
    questions = rec.question_rows(out["candidates"].join(aside, "image_id"), claimed, rules, run, marks, out["places"])
    return {
        "evidence": out["evidence"],
        "candidates": out["candidates"],
        "questions": questions,
        "images": out["images"].select(*images.columns).unionByName(failed.select(*images.columns)),
        "failures": checked.filter("error IS NOT NULL OR NOT valid").select("image_id", "error", "bad_fields"),
    }

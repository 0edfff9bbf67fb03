"""The recognition flow on hand-made images with hand-worked outcomes."""

import pytest
from pyspark.sql import functions as F

from relearn.operators import recognition as rec
from relearn.operators.recognition import Thresholds
from relearn.plans.recognition import recognize

SIZE = 100
RULES = Thresholds(padding=0.0)


def picture(red_boxes):
    """SIZE x SIZE white BGR pixels with red boxes (left, top, right, bottom)."""
    data = bytearray(b"\xff" * (SIZE * SIZE * 3))
    for left, top, right, bottom in red_boxes:
        for y in range(top, bottom):
            for x in range(left, right):
                at = (y * SIZE + x) * 3
                data[at:at + 3] = bytes((30, 30, 220))
    return bytes(data)


@pytest.fixture(scope="module")
def outcome(spark):
    # Image 1: item 0 is marked and wrong; item 1 repeats it unmarked; item 2's crop reads like
    # item 3; item 3 has no mark of its own but red ink; item 4 is right and unmarked.
    # Image 2: its only mark shows no red. Image 3: as item 4, under a strict correction.
    items = [
        (1, 0, "cat", "dog", "Read", "animal one", 0.95),
        (1, 1, "Cat!", "DOG", "Read", "Animal one", 0.95),
        (1, 2, "sun", "moon", "Read", "bright star", 0.95),
        (1, 3, "five", "six", "Read", "count fingers", 0.95),
        (1, 4, "same", "same", "Read", "no mark here", 0.95),
        (2, 0, "one", "two", "Read", "plain text", 0.95),
        (3, 0, "same", "same", "Read", "kept away", 0.95),
    ]
    marks = [(1, 0, 0.1, 0.1, 0.2, 0.2, 0.9), (1, 1, 0.5, 0.1, 0.6, 0.2, 0.9), (2, 0, 0.1, 0.1, 0.2, 0.2, 0.9)]
    boxes = [
        (1, 0, True, [0], 0.05, 0.05, 0.3, 0.3, "ANIMAL ONE"),
        (1, 1, False, [], None, None, None, None, None),
        (1, 2, True, [1], 0.45, 0.05, 0.7, 0.3, "bright star"),
        (1, 3, True, [], 0.1, 0.6, 0.4, 0.9, "count fingers"),
        (1, 4, True, [], 0.6, 0.6, 0.9, 0.9, "no mark here"),
        (2, 0, True, [], 0.1, 0.1, 0.4, 0.4, "plain text"),
        (3, 0, True, [], 0.1, 0.1, 0.4, 0.4, "kept away"),
    ]
    lines = [(1, 0, 0, "animal one", 0.9), (1, 2, 0, "count fingers", 0.9), (1, 3, 0, "nothing alike", 0.9)]
    red = {1: [(10, 10, 20, 20), (50, 10, 60, 20), (15, 65, 35, 85)], 2: [], 3: []}
    pixels = spark.createDataFrame(
        [(i, SIZE, SIZE, 3, bytearray(picture(b)), True) for i, b in red.items()],
        "image_id int, height int, width int, channels int, pixels binary, readable boolean")
    empty = F.array().cast("array<string>")
    item_rows = spark.createDataFrame(items, "image_id int, idx int, raw_text string, answer string, instruction string, prompt_text string, confidence double").withColumns(
        {"normalized_text": F.lit(None).cast("string"), "subject": F.lit("english"), "question_type": F.lit("other"), "tags": empty,
         "uncertain_segments": empty})
    images = spark.createDataFrame([(1, None, None), (2, "math", None), (3, None, "both")], "id int, subject string, recognition_correction string").withColumns(
        {"status": F.lit("segmented"), "question_count": F.lit(0)})
    out = recognize(
        images, item_rows,
        spark.createDataFrame(marks, "image_id int, mark_id int, l double, t double, r double, b double, confidence double"),
        spark.createDataFrame(boxes, "image_id int, idx int, matched boolean, mark_ids array<int>, l double, t double, r double, b double, observed_prompt_text string").withColumns(
            {"observed_raw_text": F.lit(None).cast("string"), "confidence": F.lit(0.9)}),
        spark.createDataFrame(lines, "image_id int, target_idx int, line_no int, text string, confidence double"),
        pixels, RULES)
    rows = {(r.image_id, r.idx): r for r in out["candidates"].collect()}
    marks = rec.mark_documents(out["evidence"], RULES)
    home = images.withColumns({"student_id": F.lit(7), "grade": F.lit(2), "semester": F.lit(1)}).drop("subject")
    candidates = out["candidates"].withColumn("difficulty", F.lit(1))
    stored = rec.question_rows(candidates, home, RULES, marks=marks, places=out["places"])
    documents = {(r.image_id, r.idx): r.ocr_raw_json for r in stored.collect()}
    return rows, {r.id: (r.status, r.question_count, r.subject) for r in out["images"].collect()}, documents


def test_marked_and_wrong_is_collected(outcome):
    row = outcome[0][(1, 0)]
    assert (row.collection_status, row.review_status, row.bbox_source, row.ocr_status) == ("collected", "confirmed", "minimax_marker_anchored", "support")
    assert row.tags == ["其他"]


def test_pending_copy_of_a_collected_item_is_dropped(outcome):
    assert (1, 1) not in outcome[0]


def test_contradicted_crop_is_withdrawn_before_the_decision(outcome):
    row = outcome[0][(1, 2)]
    assert (row.ocr_status, row.ocr_matched_index, row.crop_region, row.bbox_source) == ("contradict", 3, None, "unverified")
    assert (row.review_status, row.collection_status, row.reliable_error_mark) == ("needs_review", "pending_review", True)


def test_red_ink_stands_in_for_a_mark(outcome):
    row = outcome[0][(1, 3)]
    assert (row.bbox_source, row.reliable_error_mark, row.collection_status) == ("local_red_verified", True, "collected")


def test_right_answer_without_mark_waits_for_a_decision(outcome):
    row = outcome[0][(1, 4)]
    assert (row.collection_status, row.reliable_error_mark, row.review_status) == ("pending_review", False, "needs_review")


def test_rejected_marks_leave_the_image_unlocalized(outcome):
    row = outcome[0][(2, 0)]
    assert (row.localization_verified, row.collection_status, row.ocr_status) == (False, "pending_review", "unavailable")


def test_strict_correction_discards_ignored_items(outcome):
    assert (3, 0) not in outcome[0]


def test_images_settle(outcome):
    assert outcome[1] == {1: ("needs_review", 4, "english"), 2: ("needs_review", 1, "math"), 3: ("confirmed", 0, "english")}


def test_stored_document_holds_the_marks_of_the_image_in_order(outcome):
    for key in ((1, 0), (1, 4)):
        document = outcome[2][key]
        assert [(m.mark_id, m.bbox) for m in document.error_marks] == [(0, [0.1, 0.1, 0.2, 0.2]), (1, [0.5, 0.1, 0.6, 0.2])]
        assert (document.valid_error_mark_ids, document.rejected_error_mark_ids) == ([0, 1], [])
    check = outcome[2][(1, 0)].error_mark_validation[0]
    # The box grows by 0.008 on each side, which touches one more row and column of pixels each way.
    assert (check.pixel_box, check.red_pixel_count, check.pixel_count, check.reason) == ([9, 9, 21, 21], 100, 144, "accepted")
    rejected = outcome[2][(2, 0)]
    assert (rejected.valid_error_mark_ids, rejected.rejected_error_mark_ids) == ([], [0])
    assert rejected.error_mark_validation[0].reason == "insufficient_red_pixels"


def test_stored_document_holds_the_localization_and_its_red_check(outcome):
    document = outcome[2][(1, 3)]
    assert (document.localization["index"], document.localization.mark_ids, document.localization.bbox) == (3, [], [0.1, 0.6, 0.4, 0.9])
    red = document.localization_red_validation
    assert (red.accepted, red.reason, red.bbox, red.red_pixel_count) == (True, "accepted", [0.1, 0.6, 0.4, 0.9], 400)
    # A localization with a mark of its own needs no check, and a contradicted one stays in the document.
    withdrawn = outcome[2][(1, 2)]
    assert (withdrawn.localization.mark_ids, withdrawn.localization_red_validation) == ([1], None)
    white = outcome[2][(1, 4)].localization_red_validation
    assert (white.accepted, white.reason, white.red_pixel_count) == (False, "insufficient_red_pixels", 0)
    # An image whose marks were all rejected was not localized.
    assert outcome[2][(2, 0)].localization is None


def test_documents_without_pixels_or_marks(spark):
    mark = "image_id int, mark_id int, l double, t double, r double, b double, confidence double"
    pixels = spark.createDataFrame(
        [(1, 1, 1, 3, bytearray(b"\xff" * 3), False)],
        "image_id int, height int, width int, channels int, pixels binary, readable boolean")
    marks = spark.createDataFrame([(1, 1, 0.5, 0.5, 0.6, 0.6, 0.9), (1, 0, 0.1, 0.1, 0.2, 0.2, 0.9)], mark)
    row = rec.mark_documents(rec.red_evidence(pixels, marks, RULES), RULES).first()
    assert ([m.mark_id for m in row.error_marks], row.error_mark_validation) == ([0, 1], [])
    assert (row.valid_error_mark_ids, row.rejected_error_mark_ids) == ([], [0, 1])
    place = spark.createDataFrame(
        [(1, 0, True, [], 0.1, 0.1, 0.4, 0.4, "x", None, 0.9, True, True), (1, 1, False, [], None, None, None, None, None, None, 0.9, False, True)],
        "image_id int, idx int, matched boolean, mark_ids array<int>, l double, t double, r double, b double, observed_prompt_text string,"
        "observed_raw_text string, confidence double, evidence boolean, image_has_marks boolean")
    found = rec.localization_documents(place, rec.local_red_evidence(pixels, place, RULES), RULES)
    first, second = sorted(found.collect(), key=lambda r: r.idx)
    assert (first.localization_red_validation.accepted, first.localization_red_validation.reason) == (False, "image_invalid")
    assert first.localization_red_validation.bbox is None
    assert (second.localization.bbox, second.localization_red_validation) == (None, None)

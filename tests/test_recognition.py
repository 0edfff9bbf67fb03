import json
import struct
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from relearn.functions.text import fold_one
from relearn.operators import recognition as rec
from relearn.operators.recognition import Thresholds
from relearn.sources.images import scan_images
from relearn.sources.responses import parse_model_responses

ITEM = {
    "raw_text": "a", "instruction": "i", "prompt_text": "p", "subject": "math", "question_type": "other", "confidence": 0.9,
}


def checked(spark, payload):
    row = rec.validate_items(spark.createDataFrame([(json.dumps(payload),)], "payload_json string")).first()
    return row.valid, row.bad_fields


@pytest.mark.parametrize(
    "payload, bad",
    [
        ({"items": [ITEM]}, []),
        ({"items": [{**ITEM, "difficulty": 99, "tags": [], "answer": None}], "ignored_text": ["x"]}, []),
        ({"items": []}, ["items"]),
        ({"error_marks": []}, ["items"]),
        ({"items": [ITEM], "note": 1}, ["note"]),
        ({"items": [{**ITEM, "difficulty": True}]}, ["items.0.difficulty"]),
        ({"items": [{**ITEM, "difficulty": 3.0}]}, ["items.0.difficulty"]),
        ({"items": [ITEM, {**ITEM, "raw_text": " 　", "tags": None}]}, ["items.1.raw_text", "items.1.tags"]),
        ({"items": [{"x": 1}]}, [f"items.0.{n}" for n in ("raw_text", "instruction", "prompt_text", "subject", "question_type")]),
        ({"items": ["a"]}, ["items.0"]),
        ({"items": [{**ITEM, "confidence": 1}], "error_marks": [{"mark_id": 0, "mark_type": "cross", "bbox": [0, 0, 1, 1], "confidence": 1}]}, []),
        ({"items": [ITEM], "error_marks": [{"mark_id": 1, "mark_type": "cross", "bbox": [0, 0, 1, 1], "confidence": 1}]}, [""]),
        ({"items": [ITEM], "error_marks": [{"mark_id": 0, "mark_type": "star", "bbox": [0.5, 0, 0.5, 1], "confidence": 2}]},
         ["error_marks.0.mark_type", "error_marks.0.bbox", "error_marks.0.confidence"]),
    ],
)
def test_validate_items(spark, payload, bad):
    assert checked(spark, payload) == (not bad, bad)


@pytest.mark.parametrize(
    "mode, content, text",
    [
        ("vision", "```json\n{\"a\": \"x\"}\n```", "x"),
        ("vision", "<output>```{\"a\": \"x\"}```</output>", "x"),
        ("vision", "see <output>{\"a\": \"x\"}</output>", None),
        ("llm", "see <output>{\"a\": \"x\"}</output> <output>{}</output>", "x"),
        ("llm", "```json\n{\"a\": \"x\"}\n``` tail", "x"),
        ("llm", "{\"a\": \"x\"}", "x"),
        ("llm", "nothing", None),
    ],
)
def test_parse_modes(spark, mode, content, text):
    row = parse_model_responses(spark.createDataFrame([(content,)], "c string"), "c", "a string", mode=mode).first()
    assert (row.payload.a if row.payload else None) == text
    assert (row.error is None) == (text is not None)


DECISIONS = [
    ("Ｃａｔ！", "cat", "confirmed", False, "ignored"),
    ("cat", "dog", "needs_review", True, "pending_review"),
    ("cat", None, "confirmed", True, "pending_review"),
    ("", "cat", "confirmed", True, "pending_review"),
    ("cat", "dog", "confirmed", True, "collected"),
    ("cat", "cat", "confirmed", True, "pending_review"),
    ("cat", "dog", "confirmed", False, "pending_review"),
    ("straße", "STRASSE", "needs_review", False, "ignored"),
    ("nǐ", "ni", "confirmed", True, "collected"),
]


def test_collection_decision(spark):
    df = spark.createDataFrame(DECISIONS, "ocr_text string, ocr_answer string, review_status string, reliable_error_mark boolean, want string")
    assert rec.collection_decision(df).filter("collection_status <> want").count() == 0


def test_normalize_tags(spark):
    cases = [
        (["#Pinyin", "## 减法 ", "减法", "english only", "  "], "calculation", ["拼音", "减法", "计算"]),
        (["词语"], "write_word", ["词语"]),
        ([], "unknown", []),
        (["Wrong-Character"], "other", ["错别字", "其他"]),
    ]
    df = spark.createDataFrame(cases, "tags array<string>, kind string, want array<string>")
    for row in df.withColumn("got", rec.normalize_tags(F.col("tags"), F.col("kind"))).collect():
        assert row.got == row.want


def bmp(width, height, colour):
    """A 24-bit bitmap; ``colour(x, y)`` gives (r, g, b)."""
    pad = b"\0" * (-width * 3 % 4)
    rows = b"".join(
        b"".join(bytes(reversed(colour(x, y))) for x in range(width)) + pad for y in reversed(range(height))
    )
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 0, 54, 40, width, height, 1, 24, 0, len(rows), 2835, 2835, 0, 0)
    return head + rows


def test_scanned_images_and_red_marks(spark, tmp_path):
    red = lambda x, y: (220, 40, 40) if 20 <= x < 30 and 10 <= y < 20 else (255, 255, 255)
    (tmp_path / "1.bmp").write_bytes(bmp(101, 60, red))
    (tmp_path / "2.bmp").write_bytes(b"not an image")
    (tmp_path / "3.bmp").write_bytes(bmp(400, 300, lambda x, y: (255, 255, 255)))
    scanned = scan_images(spark, str(tmp_path), max_pixels=50_000).withColumn(
        "image_id", F.regexp_extract("object_path", r"(\d)\.bmp", 1).cast("int"))
    states = {r.image_id: r.readable for r in scanned.select("image_id", "readable").collect()}
    assert states == {1: True, 2: False, 3: False}
    marks = spark.createDataFrame(
        [(1, 0, 0.2, 0.2, 0.3, 0.3, 0.9), (1, 1, 0.2, 0.2, 0.3, 0.3, 0.5), (1, 2, 0.6, 0.6, 0.9, 0.9, 0.9), (2, 0, 0.1, 0.1, 0.2, 0.2, 0.9), (3, 0, 0.1, 0.1, 0.2, 0.2, 0.9)],
        "image_id int, mark_id int, l double, t double, r double, b double, confidence double")
    got = {(r.image_id, r.mark_id): r for r in rec.red_evidence(scanned, marks).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        (1, 0): "accepted", (1, 1): "low_confidence", (1, 2): "insufficient_red_pixels", (2, 0): "image_invalid", (3, 0): "image_invalid"}
    first = got[(1, 0)]
    assert (first.px_left, first.px_top, first.px_right, first.px_bottom) == (19, 11, 32, 19)
    assert (first.red_pixel_count, first.pixel_count) == (10 * 8, 13 * 8)


def test_crowded_image_equals_brute_force(spark):
    """More boxes than one pack holds, half of them copies of one another."""
    size, rng = 40, np.random.default_rng(5)
    image = rng.integers(0, 256, (size, size, 3), dtype=np.uint8)
    boxes = []
    for n in range(900):
        l, t = rng.integers(0, 30, 2) / 40
        boxes.append((1, n, float(l), float(t), float(l) + (n % 9 + 1) / 40, float(t) + (n % 7 + 1) / 40, 0.9))
    boxes += [(1, 900 + n, *boxes[0][2:]) for n in range(900)]
    pixels = spark.createDataFrame([(1, size, size, 3, bytearray(image.tobytes()), True)],
                                   "image_id int, height int, width int, channels int, pixels binary, readable boolean")
    marks = spark.createDataFrame(boxes, "image_id int, mark_id int, l double, t double, r double, b double, confidence double")
    got = rec.red_evidence(pixels, marks, Thresholds(red_expansion=0.0)).collect()
    assert len(got) == 1800
    b, g, r = (image[..., c].astype(int) for c in range(3))
    red = (r >= 120) & (r - g >= 45) & (r - b >= 45) & (r >= 1.35 * g) & (r >= 1.35 * b)
    for row in got:
        inside = red[row.px_top:row.px_bottom, row.px_left:row.px_right]
        assert (row.red_pixel_count, row.pixel_count) == (inside.sum(), inside.size)


def brute_verdicts(lines, items, rules):
    """The verdict rule written as loops over everything."""

    def similar(a, b):
        pairs = [(fold_one(a, k), fold_one(b, k)) for k in ("evidence", "toneless")]
        return max((SequenceMatcher(None, x, y).ratio() for x, y in pairs if x and y), default=0.0)

    out = {}
    for image, target in sorted({(i, t) for i, t, *_ in lines}):
        own = [(text, c) for i, t, _, text, c in sorted(lines, key=lambda r: r[2]) if (i, t) == (image, target)]
        own = [(x, c) for x, c in own if c >= rules.line_confidence and len(fold_one(x, "toneless")) >= rules.line_characters]
        here = {idx: [v for v in texts if v] for i, idx, *texts in items if i == image}
        summary = " | ".join(x for x, _ in own)[:200]
        if not own or target not in here:
            out[(image, target)] = ("inconclusive", None, summary)
            continue
        score = {i: max((similar(x, v) for x, _ in own for v in texts), default=0.0) for i, texts in here.items()}
        status, index = "inconclusive", None
        others = [i for i in sorted(score) if i != target]
        if score[target] >= rules.support:
            status, index = "support", target
        elif others:
            best = max(others, key=score.get)
            if score[best] >= rules.contradiction and score[best] > score[target]:
                status, index = "contradict", best
        out[(image, target)] = (status, index, summary)
    return out


@pytest.mark.parametrize("rules", [Thresholds(), Thresholds(support=0.6, contradiction=0.7), Thresholds(support=0.95, contradiction=0.5, line_characters=1)])
def test_ocr_verdict_equals_brute_force(spark, rules):
    words = ["nǐ hǎo shì jiè", "ni hao shi jie", "减法 12-5=", "减法 12-6=", "春天来了花开", "春天来了花谢", "abcdefghij", "abcdefghik", "jihgfedcba", "ａｂｃｄｅｆｇｈｉｊ", "x", "long " * 45, "long " * 44 + "lone"]
    items = [(i, k, words[(i * 5 + k * 3) % 13], words[(i + k * 7) % 13], None if k % 2 else words[(i * k) % 13], "")
             for i in range(12) for k in range(5)]
    lines = [(i, k, n, words[(i * 3 + k + n * 4) % 13], 0.8 + ((i + n + k) % 3) * 0.05) for i in range(12) for k in range(6) for n in range(3)]
    got = rec.ocr_verdict(
        spark.createDataFrame(lines, "image_id int, target_idx int, line_no int, text string, confidence double"),
        spark.createDataFrame(items, "image_id int, idx int, prompt_text string, raw_text string, normalized_text string, answer string"),
        rules,
    )
    seen = {(r.image_id, r.target_idx): (r.status, r.matched_index, r.text_summary) for r in got.collect()}
    want = brute_verdicts(lines, items, rules)
    assert seen == want
    if rules == Thresholds():
        assert {v[0] for v in want.values()} == {"support", "contradict", "inconclusive"}


def test_lead_characters_miss_no_similar_pair(spark):
    """Texts that reach the ratio always share a leading character."""
    texts = ["abcdefghij", "abcdefghi", "bcdefghija", "aaaaabbbbb", "aaaabbbbbb", "zzzz", "zzzy", "春天来了", "春天来啦"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for ratio in (0.5, 0.75, 0.9):
        lead = dict(df.select("t", rec._lead_characters(F.col("t"), ratio)).collect())
        for a in texts:
            for b in texts:
                if SequenceMatcher(None, a, b).ratio() >= ratio:
                    assert set(lead[a]) & set(lead[b]), (a, b, ratio)


def test_evidence_folds_width_and_case(spark):
    df = spark.createDataFrame([("Ａ b！", "ab", None, None, True), (None, None, "x", "y", False), ("!!", "??", None, None, False)],
                               "p string, op string, r string, orr string, want boolean")
    got = df.withColumn("got", rec.evidence_matches(F.col("p"), F.col("op"), F.col("r"), F.col("orr"))).collect()
    assert all(r.got == r.want for r in got)


def test_unicode_categories_agree():
    sample = [chr(c) for c in range(0x20, 0x3000)]
    assert all(c.isalnum() == (unicodedata.category(c)[0] in "LN") for c in sample)


def test_settled_images_lose_their_correction(spark):
    images = spark.createDataFrame([(1, "pending", 0, "math", "fix")], "id long, status string, question_count int, subject string, recognition_correction string")
    items = spark.createDataFrame([(1, 0, "math")], "image_id long, idx int, subject string")
    kept = spark.createDataFrame([(1, "collected")], "image_id long, collection_status string")
    row = rec.image_rollup(images, kept, items).first()
    assert row.recognition_correction is None and row.status == "confirmed"

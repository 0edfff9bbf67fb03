import pytest
from pyspark.sql import functions as F

from relearn.operators import sheets as sh
from relearn.plans.sheets import finish_sheets, prepare_sheets


@pytest.mark.parametrize(
    "text, prompt, has_line",
    [("Q ____", "Q", True), ("Q ___", "Q ___", False), ("a____b\n________ \n", "a____b", True), ("", "", False), (None, "", False), ("____", "", True), ("Q ____ x", "Q ____ x", False)],
)
def test_split_answer_line(spark, text, prompt, has_line):
    row = spark.createDataFrame([(text,)], "t string").select(sh.split_answer_line(F.col("t")).alias("s")).first().s
    assert (row.prompt, row.has_answer_line) == (prompt, has_line)


def test_identity_ignores_case_and_blanks_but_not_type_text(spark):
    df = spark.createDataFrame([("Do", "A  b", "other", "do", "a b", "calculation"), ("x", "ß", "write_word", "y", "SS", "write_word")], "a string, b string, c string, d string, e string, f string")
    left = sh.question_identity(F.col("a"), F.col("b"), F.col("c"))
    right = sh.question_identity(F.col("d"), F.col("e"), F.col("f"))
    assert df.filter(left != right).count() == 0


def questions(spark):
    raw = '{"instruction":"Solve","prompt_text":"%s","question_type":"calculation"}'
    rows = [(i, 7, "collected", None, raw % f"p{i}" if i != 5 else "{}", "secret", i % 6, "math") for i in range(1, 7)]
    rows.append((9, 8, "collected", None, raw % "p9", "secret", 2, "math"))
    return spark.createDataFrame(rows, "id int, student_id int, collection_status string, deleted_at timestamp_ntz, ocr_raw_json string, ocr_answer string, difficulty int, subject string")


def test_sheet_flow(spark):
    requests = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 7), (5, 7), (6, 7)], "request_id int, student_id int")
    asked = {1: [3, 1, 2], 2: [1, 1], 3: [9], 4: [5, 1], 6: [4]}
    lines = spark.createDataFrame([(r, p, q) for r, qs in asked.items() for p, q in enumerate(qs)], "request_id int, pos int, question_id int")
    out = prepare_sheets(requests, lines, questions(spark), batch_size=2)
    assert {r.request_id: r.verdict for r in out["verdicts"].collect()} == {
        1: "ok", 2: "duplicates", 3: "unavailable", 4: "missing_prompts", 5: "empty", 6: "ok"}
    planned = {(r.request_id, r.pos): (r.question_id, r.target_difficulty, r.batch_no) for r in out["planned"].collect()}
    assert planned == {(1, 0): (3, 5, 0), (1, 1): (1, 3, 0), (1, 2): (2, 4, 1), (6, 0): (4, 5, 0)}

    variants = [(1, 0, 3, 0, "v3"), (1, 0, 1, 0, "v1"), (1, 1, 2, 0, "v2"), (6, 0, 4, 0, " P4 ")]
    payloads = spark.createDataFrame(variants, "request_id int, batch_no int, source_id int, variant int, prompt_text string").withColumns(
        {"instruction": F.lit("Solve"), "question_type": F.lit("calculation"), "answer": F.lit("a")})
    done = finish_sheets(out["planned"], payloads, 1)
    assert [r.sheet_id for r in done["failed"].collect()] == [6]
    items = sorted(done["items"].collect(), key=lambda r: r.sort_order)
    assert [(r.wrong_question_id, r.question_type, r.sort_order) for r in items] == [
        (3, "original", 0), (3, "derived", 1), (1, "original", 2), (1, "derived", 3), (2, "original", 4), (2, "derived", 5)]
    assert all("secret" not in r.question_text for r in items)
    assert finish_sheets(out["planned"], payloads, 0)["items"].count() == 4


def test_derivative_batches(spark):
    original = spark.createDataFrame([(1, 10, "Do", "a", "other"), (1, 11, "Do", "b", "other"), (2, 12, "Do", "c", "other"), (3, 13, "Do", "d", "other"), (4, 14, "Do", "e", "other"), (5, 15, "Do", "f", "other")],
                                     "batch_id int, source_id int, instruction string, prompt_text string, question_type string")
    variants = [(1, 10, "x"), (1, 11, "x"), (2, 12, " C "), (3, 99, "z"), (4, 14, "  "), (5, 15, "m"), (5, 15, "n")]
    payload = spark.createDataFrame([(b, s, i, "Do", p, "other", "a") for i, (b, s, p) in enumerate(variants)],
                                    "batch_id int, source_id int, variant int, instruction string, prompt_text string, question_type string, answer string")
    got = {r.batch_id: r.verdict for r in sh.validate_derivatives(original, payload, 1)["verdicts"].collect()}
    assert got == {1: "ok", 2: "duplicate_question", 3: "source_mismatch", 4: "invalid_fields", 5: "count_invalid"}

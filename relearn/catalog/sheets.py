from pyspark.sql import functions as F

from relearn.catalog import Case
from relearn.operators import sheets as sh

LINE = "________________"
REQUESTED = "SELECT DISTINCT request_id, student_id FROM b_sheet_requests"


def _requests(t):
    """Every order asks for a sheet; orders without lines ask for nothing."""
    return t("b_images").select(F.col("id").alias("request_id"), "student_id")


def _selection(t):
    return sh.select_sheet_questions(_requests(t), t("b_sheet_requests"), t("b_questions"))


LINES = """lines AS (SELECT r.request_id, r.pos, r.question_id, r.student_id, q.id AS own, q.difficulty, q.subject FROM b_sheet_requests r
    LEFT JOIN (SELECT * FROM b_questions WHERE deleted_at IS NULL AND collection_status = 'collected') q ON q.id = r.question_id AND q.student_id = r.student_id),
  verdicts AS (SELECT i.id AS request_id, CASE WHEN count(l.pos) = 0 THEN 'empty' WHEN count(l.pos) > count(DISTINCT l.question_id) THEN 'duplicates'
    WHEN count(l.own) < count(l.pos) THEN 'unavailable' ELSE 'ok' END AS verdict FROM b_images i LEFT JOIN lines l ON l.request_id = i.id GROUP BY i.id)"""


def _printable(t):
    raw = F.to_json(F.struct(
        F.when(F.col("idx") != 2, F.concat(F.lit(" "), "instruction")).alias("instruction"), "prompt_text",
        F.when(F.col("idx") == 1, "essay").otherwise(F.col("question_type")).alias("question_type")))
    rows = t("b_items").select(F.col("image_id").alias("sheet_id"), "idx", raw.alias("ocr_raw_json"), F.col("answer").alias("ocr_answer"))
    return sh.printable_questions(rows)


TEXT = f"""CASE kind WHEN 'write_pinyin' THEN '给“' || prompt_text || '”写拼音：{LINE}' WHEN 'write_word' THEN '根据拼音“' || prompt_text || '”写词语：{LINE}'
  ELSE instruction || chr(10) || prompt_text || chr(10) || '{LINE}' END"""


def _originals(t):
    return t.sql("SELECT CAST(floor(p_partkey/8) AS BIGINT) AS batch_id, p_partkey AS source_id, p_type AS instruction, p_brand AS prompt_text, 'other' AS question_type FROM part")


def _checked(t):
    return sh.validate_derivatives(_originals(t), t("b_derivatives"), 2)


def _payloads(t):
    """One generated document a batch from its rows, with a fault planted by ``batch_id % 10``."""
    k, place = F.col("batch_id") % 10, F.col("source_id") % 8
    rows = t("b_derivatives").filter(~((k == 3) & (place == 2)))
    fields = ["instruction", "prompt_text", "question_type"]
    planted = (place == 0) & (F.col("variant") == 0)
    text = F.when((k == 1) & planted, F.to_json(F.struct(*fields, "answer", F.lit(1).alias("note")))).when(
        (k == 5) & planted, F.to_json(F.struct(*fields, F.lit(7).alias("answer")))).otherwise(F.to_json(F.struct(*fields, "answer")))
    sources = rows.groupBy("batch_id", "source_id").agg(F.sort_array(F.collect_list(F.struct("variant", text.alias("text")))).alias("v"))
    body = F.when((k == 4) & (place == 3), F.lit("")).otherwise(F.array_join(F.col("v.text"), ","))
    item = F.concat(F.lit('{"source_id":"'), F.col("source_id").cast("string"), F.lit('","variants":['), body, F.lit("]}"))
    given = sources.select("batch_id", "source_id", F.when((k == 2) & (place == 1), F.concat_ws(",", item, item)).otherwise(item).alias("item"))
    lists = given.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("source_id", "item"))).alias("x"))
    document = F.concat(F.lit('{"items":['), F.array_join(F.col("x.item"), ","), F.lit("]}"))
    return lists.select("batch_id", F.when(k != 6, document).alias("payload_json"))


ORIGINALS = "(SELECT CAST(floor(p_partkey/8) AS BIGINT) AS batch_id, p_partkey AS source_id, p_type AS instruction, p_brand AS prompt_text FROM part)"
VERDICTS = f"""texts AS (SELECT batch_id, source_id, lower(instruction || ' ' || trim(prompt_text)) AS identity, 1 AS v FROM b_derivatives
    UNION ALL SELECT batch_id, source_id, lower(instruction || ' ' || prompt_text), 0 FROM {ORIGINALS}),
  sources AS (SELECT batch_id, source_id, sum(v) AS n, count(*) > count(DISTINCT identity) AS twice FROM texts GROUP BY ALL),
  verdicts AS (SELECT batch_id, CASE WHEN bool_or(n <> 2) THEN 'count_invalid' WHEN bool_or(twice) THEN 'duplicate_question' ELSE 'ok' END AS verdict
    FROM sources GROUP BY batch_id)"""


def _sheet_parts(t):
    """Sheets of eight parts each: originals and generated variants."""
    originals = t.sql(f"""SELECT CAST(floor(p_partkey/8) AS BIGINT) AS sheet_id, CAST(p_partkey % 8 AS INT) AS pos, p_partkey AS question_id,
        concat(p_type, ' ', p_brand, ' {LINE}') AS display_text,
        CASE p_partkey % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'chinese' ELSE 'art' END AS subject FROM part""")
    variants = t("b_derivatives").select(F.col("batch_id").alias("sheet_id"), "source_id", "variant", F.col("prompt_text").alias("display_text"))
    return originals, variants


PARTS = f"""rows_ AS (SELECT CAST(floor(p_partkey/8) AS BIGINT) AS sheet_id, CAST(p_partkey % 8 AS INT) AS pos, -1 AS variant, p_partkey AS question_id,
    p_type || ' ' || p_brand || ' {LINE}' AS display_text FROM part
  UNION ALL SELECT batch_id, CAST(source_id % 8 AS INT), variant, source_id, prompt_text FROM b_derivatives)"""


def _document(t):
    originals, variants = _sheet_parts(t)
    heads = t.sql("SELECT id AS sheet_id, CASE WHEN id % 3 = 0 THEN '' ELSE display_name END AS title, CASE WHEN id % 5 = 0 THEN NULL ELSE display_name END AS student_name FROM b_students")
    return sh.sheet_document(heads, originals, variants)


GENERATION = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' WHEN 2 THEN 'pending' ELSE 'completed' END AS generation_status,
  CAST(user_id AS INT) AS generation_total, CAST(event_id % 7 AS INT) AS generation_completed,
  CASE WHEN event_id % 4 = 0 THEN 'old_code' END AS generation_error_code, CASE WHEN event_id % 4 = 0 THEN 'old text' END AS generation_error_message,
  CASE WHEN event_type = 'view' THEN NULL ELSE ts END AS generation_started_at, CAST(NULL AS INT) AS generation_duration_seconds FROM events"""
STEPS = """SELECT e.event_id AS sheet_id, CASE e.user_id % 5 WHEN 0 THEN 'claim' WHEN 1 THEN 'progress' WHEN 2 THEN 'complete' WHEN 3 THEN 'fail' ELSE 'retry' END AS event,
  n.ts AS at, CAST(e.event_id % 11 AS INT) AS completed, CASE e.event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'derivative' ELSE 'socket' END AS error_kind,
  CASE WHEN e.event_id % 2 = 0 THEN 'pdf' ELSE 'derivatives' END AS phase FROM events e JOIN events n ON n.event_id = e.event_id + 1"""

CASES = {
    "e1_selection_verdicts": Case(lambda t: _selection(t)["verdicts"], f"WITH {LINES} SELECT * FROM verdicts"),
    "e1_selected_questions": Case(
        lambda t: _selection(t)["selected"].select("request_id", "pos", "question_id", "student_id", "subject"),
        f"""WITH {LINES} SELECT l.request_id, l.pos, l.question_id, l.student_id, l.subject FROM lines l
           JOIN verdicts v ON v.request_id = l.request_id AND v.verdict = 'ok'""",
    ),
    "e2_printable_questions": Case(
        lambda t: _printable(t).select("sheet_id", "idx", "printable", "question_type", "display_text", "answer"),
        f"""SELECT image_id AS sheet_id, idx, idx <> 2 AS printable, kind AS question_type, CASE WHEN idx <> 2 THEN {TEXT} END AS display_text, answer
           FROM (SELECT *, CASE WHEN idx = 1 THEN 'other' ELSE question_type END AS kind FROM b_items) x""",
    ),
    "e2_missing_prompts": Case(
        lambda t: sh.missing_prompts(_printable(t)),
        "SELECT image_id AS sheet_id, count(*) AS missing_count FROM b_items WHERE idx = 2 GROUP BY 1",
    ),
    "e3_plan_derivatives": Case(
        lambda t: sh.plan_derivatives(_selection(t)["selected"], 3).select(
            "request_id", "pos", "difficulty", "target_difficulty", "subject", "batch_no"),
        f"""WITH {LINES} SELECT l.request_id, l.pos, CASE WHEN difficulty = 0 THEN 2 ELSE difficulty END AS difficulty,
             CAST(least(5, CASE WHEN difficulty = 0 THEN 2 ELSE difficulty END + 2) AS INT) AS target_difficulty, l.subject, CAST(floor(l.pos / 3) AS INT) AS batch_no
           FROM lines l JOIN verdicts v ON v.request_id = l.request_id AND v.verdict = 'ok'""",
    ),
    "e4_derivative_verdicts": Case(lambda t: _checked(t)["verdicts"], f"WITH {VERDICTS} SELECT * FROM verdicts"),
    "e4_derivative_variants": Case(
        lambda t: _checked(t)["variants"].select("batch_id", "source_id", "variant", "display_text"),
        f"""WITH {VERDICTS} SELECT d.batch_id, d.source_id, d.variant, d.instruction || chr(10) || trim(d.prompt_text) || chr(10) || '{LINE}' AS display_text
           FROM b_derivatives d JOIN verdicts v ON v.batch_id = d.batch_id AND v.verdict = 'ok'""",
    ),
    "e4_parse_payloads": Case(
        lambda t: sh.parse_payloads(_originals(t), _payloads(t), 2)["verdicts"].select("batch_id", "verdict", F.array_join("bad_fields", ",").alias("bad_fields")),
        f"""WITH {VERDICTS} SELECT batch_id, CASE batch_id % 10 WHEN 1 THEN 'invalid_fields' WHEN 2 THEN 'duplicate_source' WHEN 3 THEN 'source_mismatch'
             WHEN 4 THEN 'count_invalid' WHEN 5 THEN 'invalid_fields' WHEN 6 THEN 'invalid_fields' ELSE verdict END AS verdict,
             CASE batch_id % 10 WHEN 1 THEN 'items.0.variants.0.note' WHEN 5 THEN 'items.0.variants.0.answer' ELSE '' END AS bad_fields FROM verdicts""",
    ),
    "e5_expand_sheet_items": Case(
        lambda t: sh.expand_sheet_items(*_sheet_parts(t)).select(
            "sheet_id", "wrong_question_id", "question_type", "derived_from", "question_text", "sort_order", "generation_method",
            F.col("question_snapshot.source_wrong_question_id").alias("snapshot_source"),
            F.col("question_snapshot.sort_order").alias("snapshot_order")),
        f"""WITH {PARTS}, numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY pos, variant) - 1 AS INT) AS sort_order FROM rows_)
           SELECT sheet_id, question_id AS wrong_question_id, CASE WHEN variant < 0 THEN 'original' ELSE 'derived' END AS question_type,
             CASE WHEN variant >= 0 THEN question_id END AS derived_from, display_text AS question_text, sort_order,
             CASE WHEN variant < 0 THEN 'vision' ELSE 'llm' END AS generation_method, question_id AS snapshot_source, sort_order AS snapshot_order FROM numbered""",
    ),
    "e6_sheet_document": Case(
        _document,
        f"""WITH {PARTS} SELECT r.sheet_id, CASE WHEN r.sheet_id % 3 = 0 THEN '错题重练' ELSE s.display_name END AS title, CASE WHEN r.sheet_id % 5 = 0 THEN '学生' ELSE s.display_name END AS student_name,
             CASE (r.sheet_id * 8) % 3 WHEN 0 THEN '数学' WHEN 1 THEN '语文' ELSE 'art' END AS subject, r.pos AS group_no, r.variant,
             CASE WHEN r.variant < 0 THEN 'original' ELSE 'derived' END AS kind, CASE WHEN r.variant < 0 THEN rtrim(rtrim(r.display_text, '_')) ELSE r.display_text END AS prompt,
             r.variant < 0 AS has_answer_line FROM rows_ r JOIN b_students s ON s.id = r.sheet_id""",
    ),
    "e7_split_answer_line": Case(
        lambda t: t("b_answer_lines").select("doc_id", sh.split_answer_line(F.col("display_text")).alias("s")).select("doc_id", "s.*"),
        r"""SELECT doc_id, regexp_matches(display_text, '_{4,}\s*$') AS has_answer_line, CASE WHEN regexp_matches(display_text, '_{4,}\s*$')
             THEN regexp_replace(regexp_replace(display_text, '_{4,}\s*$', ''), '\s+$', '') ELSE display_text END AS prompt FROM b_answer_lines""",
    ),
    "e8_generation_state": Case(
        lambda t: sh.generation_state(t.sql(GENERATION), t.sql(STEPS)),
        f"""WITH x AS (SELECT s.*, n.event, n.at AS step_at, n.completed, CASE WHEN n.error_kind = 'socket' THEN CASE WHEN n.phase = 'pdf' THEN 'pdf' ELSE 'other' END ELSE n.error_kind END AS kind
             FROM ({GENERATION}) s LEFT JOIN ({STEPS}) n ON n.sheet_id = s.id AND ((n.event = 'claim' AND s.generation_status = 'pending')
               OR (n.event IN ('progress', 'complete') AND s.generation_status = 'processing') OR (n.event = 'fail' AND s.generation_status <> 'completed')
               OR (n.event = 'retry' AND s.generation_status = 'failed')))
           SELECT id, CASE event WHEN 'claim' THEN 'processing' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'retry' THEN 'pending' ELSE generation_status END AS generation_status,
             generation_total, CASE event WHEN 'claim' THEN 0 WHEN 'retry' THEN 0 WHEN 'progress' THEN completed WHEN 'complete' THEN generation_total ELSE generation_completed END AS generation_completed,
             CASE WHEN event = 'fail' THEN CASE kind WHEN 'timeout' THEN 'sheet_generation_timeout' WHEN 'derivative' THEN 'sheet_derivative_failed' WHEN 'pdf' THEN 'sheet_pdf_failed'
               ELSE 'sheet_generation_failed' END WHEN event IN ('claim', 'complete', 'retry') THEN NULL ELSE generation_error_code END AS generation_error_code,
             CASE WHEN event = 'fail' THEN CASE kind WHEN 'timeout' THEN '{sh.FAILURES['timeout'][1]}' WHEN 'derivative' THEN '{sh.FAILURES['derivative'][1]}' WHEN 'pdf' THEN '{sh.FAILURES['pdf'][1]}'
               ELSE '{sh.FAILURES['other'][1]}' END WHEN event IN ('claim', 'complete', 'retry') THEN NULL ELSE generation_error_message END AS generation_error_message,
             CASE WHEN event = 'claim' THEN step_at ELSE generation_started_at END AS generation_started_at,
             CASE WHEN event = 'complete' AND generation_started_at IS NULL THEN NULL WHEN event = 'complete' THEN CAST(ceil(greatest(epoch_us(step_at) - epoch_us(generation_started_at), 0) / 1000000) AS INT) ELSE generation_duration_seconds END AS generation_duration_seconds FROM x""",
    ),
    "e9_batch_usage": Case(
        lambda t: sh.batch_usage(t("b_usage")),
        """SELECT batch_id, 'prompt_tokens' AS counter, CAST(sum(CAST(json_extract(usage, '$.prompt_tokens') AS BIGINT)) AS BIGINT) AS total FROM b_usage GROUP BY 1
           UNION ALL SELECT batch_id, 'completion_tokens', CAST(sum(CAST(json_extract(usage, '$.completion_tokens') AS BIGINT)) AS BIGINT) FROM b_usage GROUP BY 1""",
    ),
}

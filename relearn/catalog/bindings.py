"""Domain views over the test tables, as SQL that Spark and the checking engine both run.

``EACH(a,b)`` emits one row per listed value. Every view covers its whole base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from relearn.session import broadcast_measured

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

BINDINGS = {
    "b_students": """
SELECT c_custkey AS id, CAST(floor(c_custkey/2) AS BIGINT) AS account_id,
 (c_custkey % 2 = 0 AND c_mktsegment <> 'MACHINERY') AS is_default,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 7 AS INT) END AS grade,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS INT) END AS semester,
 c_name AS display_name FROM customer""",
    "b_accounts": """
SELECT a.id, CASE WHEN a.id % 9 = 0 THEN 'pending_deletion' ELSE 'active' END AS status,
 CAST(1 + a.id % 3 AS INT) AS token_version,
 CASE WHEN a.id % 9 = 0 THEN e.ts ELSE NULL END AS deletion_requested_at,
 CASE WHEN a.id % 9 = 0 THEN e.ts ELSE NULL END AS deletion_due_at,
 CASE WHEN a.id % 4 = 0 THEN NULL ELSE concat('/avatars/', CAST(a.id AS STRING), '.jpg') END AS avatar_object_key,
 CASE WHEN a.id % 3 = 0 THEN NULL ELSE concat('n', CAST(a.id AS STRING)) END AS nickname,
 CASE WHEN a.id % 5 = 0 THEN NULL ELSE concat('c', CAST(a.id AS STRING)) END AS phone_ciphertext,
 CASE WHEN a.id % 6 = 0 THEN e.ts ELSE NULL END AS profile_prompted_at,
 CASE WHEN a.id % 8 = 0 THEN e.ts ELSE NULL END AS profile_completed_at
FROM (SELECT DISTINCT CAST(floor(c_custkey/2) AS BIGINT) AS id FROM customer) a
LEFT JOIN events e ON e.event_id = a.id""",
    "b_phones": """
SELECT id AS account_id, CASE id % 5
 WHEN 0 THEN concat('138', lpad(CAST(id % 400 AS STRING), 8, '0'))
 WHEN 1 THEN concat('+86 138-', lpad(CAST(id % 400 AS STRING), 8, '0'))
 WHEN 2 THEN concat('86138', lpad(CAST(id % 400 AS STRING), 8, '0'))
 WHEN 3 THEN concat('128', lpad(CAST(id % 400 AS STRING), 8, '0'))
 ELSE '12345' END AS phone
FROM (SELECT DISTINCT CAST(floor(c_custkey/2) AS BIGINT) AS id FROM customer) a""",
    "b_identities": """
SELECT id, id AS account_id, CASE id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error'
 WHEN 3 THEN 'signup' ELSE 'purchase' END AS appid, concat('u', CAST(id AS STRING)) AS openid
FROM (SELECT DISTINCT CAST(floor(c_custkey/2) AS BIGINT) AS id FROM customer) a""",
    "b_logins": """
SELECT event_type AS appid, concat('u', CAST(user_id AS STRING)) AS openid, ts AS login_at FROM events""",
    "b_images": """
SELECT o_orderkey AS id, o_custkey AS student_id, o_orderdate AS created_at,
 CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'segmented' WHEN 2 THEN 'needs_review'
  WHEN 3 THEN 'confirmed' WHEN 4 THEN 'failed' ELSE 'cancelled' END AS status,
 CAST(o_orderkey % 5 AS INT) AS question_count,
 CASE WHEN o_orderkey % 6 = 4 THEN o_orderpriority ELSE NULL END AS error_code,
 CASE WHEN o_orderkey % 6 = 4 THEN o_orderstatus ELSE NULL END AS error_message,
 concat('/uploads/', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 50 = 0 THEN '/x.jpg' ELSE '.jpg' END) AS original_url
FROM orders""",
    "b_questions": """
SELECT l.l_orderkey*10+l.l_linenumber AS id, l.l_orderkey AS image_id, min(o.o_custkey) AS student_id, min(l.l_shipdate) AS created_at,
 CASE min(l.l_returnflag) WHEN 'A' THEN 'math' WHEN 'N' THEN 'chinese' ELSE 'english' END AS subject,
 CAST(1 + min(l.l_partkey) % 6 AS INT) AS grade, CAST(1 + min(l.l_suppkey) % 2 AS INT) AS semester,
 CAST(min(l.l_partkey) % 6 AS INT) AS difficulty,
 split(concat('t', CAST(min(l.l_suppkey) % 5 AS STRING), ';t', CAST(min(l.l_partkey) % 7 AS STRING)), ';') AS tags,
 CAST(min(l.l_suppkey) % 4 AS INT) AS wrong_count,
 CASE WHEN min(l.l_partkey) % 10 < 6 THEN 'collected' WHEN min(l.l_partkey) % 10 < 8 THEN 'pending_review'
  WHEN min(l.l_partkey) % 10 = 8 THEN 'ignored' ELSE 'superseded' END AS collection_status,
 CASE WHEN min(l.l_suppkey) % 4 = 0 THEN 'needs_review' ELSE 'confirmed' END AS review_status,
 CASE WHEN min(l.l_suppkey) % 3 = 0 THEN 'mastered' ELSE 'learning' END AS mastery_status,
 CASE WHEN min(l.l_partkey) % 11 = 0 THEN max(l.l_shipdate) ELSE NULL END AS deleted_at, max(l.l_shipdate) AS updated_at
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY l.l_orderkey, l.l_linenumber""",
    "b_sheets": """
SELECT event_id AS id, user_id AS student_id, ts AS created_at, concat('S', CAST(event_id AS STRING)) AS title,
 CASE event_id % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' WHEN 2 THEN 'pending' ELSE 'completed' END AS generation_status,
 CASE WHEN event_type = 'error' THEN props ELSE NULL END AS generation_error_message,
 CASE WHEN event_type = 'view' THEN NULL ELSE concat('/pdfs/', CAST(event_id AS STRING), '.pdf') END AS pdf_url FROM events""",
    "b_sheet_items": """
SELECT x.event_id*3 + x.i AS id, x.event_id AS sheet_id,
 CASE WHEN x.i < 2 THEN x.event_id WHEN x.event_type IN ('view', 'signup') THEN NULL ELSE x.event_id + 1 END AS wrong_question_id,
 CASE WHEN x.i < 2 THEN x.event_id WHEN x.event_type = 'signup' THEN NULL ELSE x.event_id + 1 END AS snapshot_source_id,
 CASE WHEN x.i = 1 THEN 'derived' ELSE 'original' END AS question_type, x.i AS sort_order,
 concat(x.event_type, CAST(x.i AS STRING)) AS question_text
FROM (SELECT event_id, event_type, EACH(0,1,2) AS i FROM events) x""",
    "b_practised": """
SELECT event_id AS id, user_id AS student_id, CAST(event_id % 4 AS INT) AS wrong_count,
 CASE WHEN event_id % 3 = 0 THEN 'mastered' ELSE 'learning' END AS mastery_status,
 CASE WHEN event_id % 3 = 0 THEN ts ELSE NULL END AS mastered_at,
 CASE WHEN event_id % 3 < 2 THEN ts ELSE NULL END AS last_practiced_at,
 CASE WHEN event_type = 'purchase' AND value > 20 THEN ts ELSE NULL END AS deleted_at FROM events""",
    "b_attempts": """
SELECT a.event_id AS id, s.event_id AS sheet_id, s.user_id AS student_id, CAST(a.event_id % 4 + 1 AS INT) AS attempt_no,
 concat('k', CAST(CAST(floor(a.event_id/2) AS BIGINT) % 50 AS STRING)) AS idempotency_key,
 a.ts AS created_at, a.ts AS completed_at, a.ts AS updated_at,
 CAST(CASE a.user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.3333 WHEN 2 THEN 0.6667 ELSE 1 END AS DECIMAL(5,4)) AS accuracy
FROM events a JOIN events s ON s.event_id = CAST(floor(a.event_id/4) AS BIGINT)""",
    "b_results": """
SELECT x.event_id*3 + x.i AS id, x.event_id AS attempt_id, t.id AS sheet_item_id, t.wrong_question_id, t.snapshot_source_id,
 ((x.event_id*7 + x.i*5 + x.user_id) % 4 <> 0) AS is_correct, x.ts AS created_at
FROM (SELECT event_id, user_id, ts, EACH(0,1,2) AS i FROM events) x
JOIN b_sheet_items t ON t.id = CAST(floor(x.event_id/4) AS BIGINT)*3 + x.i""",
    "b_answers": """
SELECT x.event_id AS attempt_id,
 CAST(floor(x.event_id/4) AS BIGINT)*3 + least(x.i, 2) + CASE WHEN x.event_type = 'click' AND x.value > 60 AND x.i = 2 THEN 1000000000 ELSE 0 END AS sheet_item_id,
 ((x.event_id*7 + least(x.i, 2)*5 + x.user_id) % 4 <> 0) AS is_correct
FROM (SELECT event_id, user_id, event_type, value, EACH(0,1,2,3) AS i FROM events) x
WHERE (x.i < 3 OR (x.event_type = 'error' AND x.value > 30)) AND NOT (x.i = 1 AND x.event_type = 'view' AND x.value > 40)""",
    "b_sheet_requests": """
SELECT l.l_orderkey AS request_id, o.o_custkey AS student_id, l.l_orderkey*10 + l.l_linenumber AS question_id,
 CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_extendedprice) - 1 AS INT) AS pos
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "b_items": """
SELECT CAST(floor(p_partkey/4) AS BIGINT) AS image_id, CAST(p_partkey % 4 AS INT) AS idx, p_name AS raw_text, p_type AS instruction, p_brand AS prompt_text,
 CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, ' x') ELSE NULL END AS answer,
 CASE p_partkey % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'chinese' ELSE 'english' END AS subject,
 CASE p_size % 5 WHEN 0 THEN 'write_pinyin' WHEN 1 THEN 'write_word' WHEN 2 THEN 'fill_blank' WHEN 3 THEN 'calculation' ELSE 'other' END AS question_type,
 split(CASE p_partkey % 4 WHEN 0 THEN concat('#pinyin;', lower(p_type), ';词语;Word;  #减法 ') WHEN 1 THEN ' '
  WHEN 2 THEN concat('wrong-character;', p_type, ';## 竖式;竖式;计算') ELSE 'Teacher-Marked;;填空; 其他 ;#' END, ';') AS tags,
 p_size - 3 AS difficulty, least(CAST(1 AS DOUBLE), CAST(p_size AS DOUBLE)/50 + 0.4) AS confidence, (p_partkey % 13 = 0) AS uncertain
FROM part""",
    "b_taken": """
SELECT x.id, x.id*2 AS student_id, CASE WHEN x.id % 11 = 4 THEN 'confirmed' ELSE 'pending' END AS status, CAST(0 AS INT) AS question_count,
 CASE x.id % 4 WHEN 0 THEN 'english' WHEN 1 THEN '' ELSE NULL END AS subject, CAST(1 + x.id % 6 AS INT) AS grade, CAST(1 + x.id % 2 AS INT) AS semester,
 CASE x.id % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'missed_errors' ELSE NULL END AS recognition_correction
FROM (SELECT DISTINCT CAST(floor(p_partkey/4) AS BIGINT) AS id FROM part) x""",
    "b_newcomers": """
SELECT 10000000 + p_partkey AS id FROM part""",
    "b_members": """
SELECT * FROM b_accounts UNION ALL SELECT id, CASE WHEN id % 17 = 0 THEN 'pending_deletion' ELSE 'active' END, CAST(1 + id % 3 AS INT), NULL, NULL,
 CASE WHEN id % 4 = 0 THEN NULL ELSE concat('/avatars/', CAST(id AS STRING), '.jpg') END, NULL, NULL, NULL, NULL FROM b_newcomers""",
    "b_member_phones": """
SELECT * FROM b_phones UNION ALL SELECT id, concat('138', lpad(CAST(id % 500 AS STRING), 8, '0')) FROM b_newcomers""",
    "b_member_students": """
SELECT * FROM b_students UNION ALL SELECT id, id, true, CAST(1 AS INT), CAST(1 AS INT), 'new' FROM b_newcomers""",
    "b_member_identities": """
SELECT * FROM b_identities UNION ALL SELECT id, id, 'new', concat('u', CAST(id AS STRING)) FROM b_newcomers""",
    "b_candidates": """
SELECT CAST(floor(x.p_partkey/4) AS BIGINT) AS image_id, CAST(x.p_partkey % 4 AS INT) + x.c AS idx, x.p_type AS instruction, x.p_brand AS prompt_text,
 CASE WHEN x.c = 0 THEN x.p_name ELSE upper(concat(x.p_name, '!')) END AS ocr_text, CASE WHEN x.p_partkey % 7 = 0 THEN NULL ELSE x.p_name END AS ocr_answer,
 'other' AS question_type, CASE x.p_partkey % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'chinese' ELSE 'english' END AS subject,
 CASE WHEN x.c = 4 THEN CASE WHEN x.p_size % 2 = 0 THEN 'pending_review' ELSE 'ignored' END WHEN x.p_partkey % 2 = 0 THEN 'collected' ELSE 'pending_review' END AS collection_status,
 CASE CAST(floor(x.p_partkey/4) AS BIGINT) % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'missed_errors' ELSE NULL END AS recognition_correction
FROM (SELECT p_partkey, p_name, p_type, p_brand, p_size, EACH(0,4) AS c FROM part) x""",
    "b_usage": """
SELECT event_id AS call_id, CAST(floor(event_id/3) AS BIGINT) AS batch_id, concat('{"prompt_tokens":', CAST(user_id AS STRING), ',"completion_tokens":', CAST(event_id % 50 AS STRING), ',"cached":true,"note":"', event_type, '"}') AS usage FROM events""",
    "b_marks": """
SELECT CAST(floor(p_partkey/4) AS BIGINT) AS image_id, CAST(p_partkey % 4 AS INT) AS position,
 CAST(p_partkey % 4 AS INT) + CASE WHEN p_size = 50 THEN 1 ELSE 0 END AS mark_id,
 CASE p_type WHEN 'ECONOMY' THEN 'circle' WHEN 'SMALL' THEN 'cross' WHEN 'LARGE' THEN 'underline' WHEN 'MEDIUM' THEN 'deletion' ELSE 'mixed' END AS mark_type,
 CAST((p_partkey*37) % 60 AS DOUBLE)/100 AS l, CAST((p_partkey*53) % 60 AS DOUBLE)/100 AS t,
 CAST((p_partkey*37) % 60 + 5 + p_size % 20 AS DOUBLE)/100 AS r, CAST((p_partkey*53) % 60 + 5 + p_size % 15 AS DOUBLE)/100 AS b,
 CAST(50 + p_size AS DOUBLE)/100 AS confidence
FROM part""",
    "b_valid_marks": """
SELECT image_id, position AS mark_id, l, t, r, b FROM b_marks WHERE confidence >= 0.65""",
    "b_localizations": """
SELECT CAST(floor(p_partkey/4) AS BIGINT) AS image_id, CAST(p_partkey % 4 AS INT) AS idx, (p_partkey % 19 <> 0) AS matched,
 CASE WHEN p_partkey % 19 = 0 OR p_size < 15 THEN NULL WHEN p_size = 49 THEN 0 WHEN p_size = 50 THEN CAST(p_partkey % 4 AS INT) + 1 ELSE CAST(p_partkey % 4 AS INT) END AS mark_id,
 CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST((p_partkey*37) % 60 AS DOUBLE)/100 END AS l,
 CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST((p_partkey*53) % 60 AS DOUBLE)/100 END AS t,
 CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST((p_partkey*37) % 60 + 10 + p_size % 30 AS DOUBLE)/100 END AS r,
 CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST((p_partkey*53) % 60 + 10 + p_size % 30 AS DOUBLE)/100 END AS b,
 CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 6 = 0 THEN 'none' ELSE upper(p_brand) END AS observed_prompt_text,
 CAST(60 + p_size % 40 AS DOUBLE)/100 AS confidence
FROM part""",
    "b_ocr_lines": """
SELECT CAST(floor(x.p_partkey/4) AS BIGINT) AS image_id, CAST(x.p_partkey % 4 AS INT) AS target_idx, x.i AS line_no,
 CASE (x.p_partkey + x.i) % 4 WHEN 0 THEN x.p_name WHEN 1 THEN concat(x.p_brand, '!') WHEN 2 THEN concat('x', n.p_name) ELSE 'z' END AS text,
 CAST(80 + (x.p_size + x.i*7) % 20 AS DOUBLE)/100 AS confidence
FROM (SELECT p_partkey, p_name, p_brand, p_size, EACH(0,1) AS i FROM part) x JOIN part n ON n.p_partkey = CAST(floor(x.p_partkey/4) AS BIGINT)*4""",
    "b_pixels": """
SELECT v.vec_id AS image_id, CAST(v.k % 8 AS INT) AS x, CAST(floor(v.k/8) AS INT) AS y,
 CASE WHEN CAST(v.f AS DOUBLE) > 0.15 THEN 220 ELSE 250 END AS r, CASE WHEN CAST(v.f AS DOUBLE) > 0.15 THEN 30 ELSE 250 END AS g, CASE WHEN CAST(v.f AS DOUBLE) > 0.15 THEN 40 ELSE 250 END AS b
FROM (SELECT vec_id, PIXEL(embedding) FROM embeddings) v""",
    "b_responses": """
SELECT p_partkey AS response_id, CASE p_partkey % 6
 WHEN 0 THEN concat('<output> {"raw_text":"', p_name, '","difficulty":', CAST(p_size AS STRING), '} </output>')
 WHEN 1 THEN concat('{"raw_text":"', p_name, '","difficulty":', CAST(p_size AS STRING), '}')
 WHEN 2 THEN concat('Here: <output>{"raw_text":"', p_name, '"}</output>')
 WHEN 3 THEN '   ' WHEN 4 THEN concat('{"raw_text":"', p_name)
 ELSE concat('{"raw_text":"', p_name, '","difficulty":"', CAST(p_size AS STRING), '","extra":1}') END AS content
FROM part""",
    "b_vision": """
SELECT p_partkey AS response_id, concat('{"items":[{"raw_text":"', p_name, '","instruction":"', CASE WHEN p_size % 9 = 0 THEN '  ' ELSE p_type END,
 '","prompt_text":', CASE WHEN p_size % 7 = 0 THEN '5' ELSE concat('"', p_brand, '"') END,
 ',"subject":"', CASE WHEN p_partkey % 11 = 0 THEN 'music' ELSE 'math' END, '","question_type":"other","difficulty":',
 CASE WHEN p_size % 13 = 0 THEN 'true' WHEN p_size % 8 = 0 THEN '2.5' ELSE CAST(p_size - 10 AS STRING) END,
 ',"confidence":', CASE WHEN p_size % 10 = 0 THEN '1.5' ELSE '0.9' END, CASE WHEN p_partkey % 17 = 0 THEN ',"note":1' ELSE '' END,
 CASE WHEN p_partkey % 5 = 0 THEN ',"tags":["a",1]' ELSE ',"tags":["a"]' END,
 '},{"raw_text":"second","instruction":"i","prompt_text":"p","subject":"english","question_type":"',
 CASE WHEN p_partkey % 23 = 0 THEN 'essay' ELSE 'fill_blank' END, '","confidence":1}]}') AS payload_json
FROM part""",
    "b_derivatives": """
SELECT CAST(floor(x.p_partkey/8) AS BIGINT) AS batch_id, x.p_partkey AS source_id, x.v AS variant, x.p_type AS instruction,
 CASE WHEN x.p_size = 7 THEN concat(' ', upper(x.p_brand), ' ') WHEN x.p_size = 8 THEN concat(x.p_brand, ' same')
  ELSE concat(x.p_brand, ' v', CAST(x.v AS STRING)) END AS prompt_text, 'other' AS question_type, 'a' AS answer
FROM (SELECT p_partkey, p_type, p_brand, p_size, EACH(0,1) AS v FROM part) x WHERE NOT (x.p_size = 9 AND x.v = 1)""",
    "b_answer_lines": """
SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN ' ____' WHEN 1 THEN ' ___' WHEN 2 THEN '________  ' ELSE '' END) AS display_text FROM documents""",
}

FOR_SPARK = {
    "each": r"explode(array(\1))",
    "pixel": r"posexplode(\1) AS (k, f)",
}
FOR_DUCKDB = {
    "each": r"unnest([\1])",
    "pixel": r"unnest(range(0, 64)) AS k, unnest(\1) AS f",
}
NAME = re.compile(r"\bb_\w+\b")


def _render(sql: str, forms: dict[str, str]) -> str:
    sql = re.sub(r"EACH\(([^)]*)\)", forms["each"], sql)
    return re.sub(r"PIXEL\(([^)]*)\)", forms["pixel"], sql)


def _needed(sql: str) -> list[str]:
    """Bindings used by a statement, each after the ones it builds on."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in NAME.findall(text):
            if name in BINDINGS and name not in order:
                visit(BINDINGS[name])
                order.append(name)

    visit(sql)
    return order


def for_duckdb(sql: str) -> str:
    """A statement over bindings as one self-contained query."""
    sql = sql.strip()
    parts = [f"{n} AS ({_render(BINDINGS[n], FOR_DUCKDB).strip()})" for n in _needed(sql)]
    if not parts:
        return _render(sql, FOR_DUCKDB)
    head = "WITH " + ",\n".join(parts)
    body = _render(sql, FOR_DUCKDB)
    return head + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)


class Tables:
    """Base tables and bindings of one data folder as DataFrames.

    The session broadcasts by measured sizes from then on, see :func:`broadcast_measured`.
    """

    def __init__(self, spark: SparkSession, folder: str):
        broadcast_measured(spark)
        self.spark = spark
        self.folder = folder

    def __call__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, statement: str) -> DataFrame:
        needed = _needed(statement)
        parts = [f"{n} AS ({_render(BINDINGS[n], FOR_SPARK).strip()})" for n in needed]
        used = " ".join([statement, *[BINDINGS[n] for n in needed]])
        for table in BASE:
            if re.search(rf"\b{table}\b", used):
                self(table).createOrReplaceTempView(table)
        body = _render(statement.strip(), FOR_SPARK)
        if parts:
            body = "WITH " + ",\n".join(parts) + "\n" + body
        return self.spark.sql(body)

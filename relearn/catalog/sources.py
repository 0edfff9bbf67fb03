import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relearn.catalog import Case
from relearn.functions.ranks import ensure_checkpoint_dir, pin
from relearn.operators.lifecycle import purge_due
from relearn.sources import tables as tb
from relearn.sources.changes import batched_due, merge_changes
from relearn.sources.responses import open_envelope, parse_model_responses

PAYLOAD = "raw_text string, difficulty int"
NOW = "1998-12-01 00:00:00"
CUTOFF = "TIMESTAMP '1998-11-01 00:00:00'"


def domain_tables(t):
    """The eleven tables over the test data, in table form."""
    return {
        "accounts": t("b_accounts"),
        "wechat_identities": t("b_identities"),
        "students": t("b_students"),
        "wrong_images": t("b_images"),
        "wrong_questions": t("b_questions"),
        "practice_sheets": t("b_sheets"),
        "sheet_items": t("b_sheet_items"),
        "practice_attempts": t("b_attempts"),
        "practice_results": t("b_results"),
        "account_recovery_conflicts": t.sql(
            "SELECT id, concat('AR-', CAST(id AS STRING)) AS support_reference, id AS current_account_id, id + 1 AS target_account_id, 'open' AS status FROM b_accounts"),
        "file_cleanup_jobs": t.sql(
            "SELECT id, 'pdf' AS storage_kind, pdf_url AS object_path, 0 AS attempt_count FROM b_sheets"),
    }


NAMES = {
    "accounts": "b_accounts", "wechat_identities": "b_identities", "students": "b_students", "wrong_images": "b_images",
    "wrong_questions": "b_questions", "practice_sheets": "b_sheets", "sheet_items": "b_sheet_items",
    "practice_attempts": "b_attempts", "practice_results": "b_results", "account_recovery_conflicts": "b_accounts",
    "file_cleanup_jobs": "b_sheets",
}


def _loaded(t):
    """Write the tables once, load them back by schema: rows, ids, and a sum over the rows' own values."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/tables-{uuid.uuid4().hex}"
    for name, df in domain_tables(t).items():
        tb.conform(df, name, "long").write.parquet(f"{folder}/{name}")
    loaded = tb.load_tables(t.spark, folder, id_type="long")
    parts = []
    for name, df in loaded.items():
        shown = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in CONTENT[name].split()])
        half = F.conv(F.substring(F.md5(shown), 1, 8), 16, 10).cast("long")
        parts.append(df.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum(half).alias("content")).select(F.lit(name).alias("table"), "*"))
    return reduce(DataFrame.unionByName, parts)


# Columns whose values are compared after loading; texts and whole numbers look alike in both engines.
CONTENT = {
    "accounts": "id status token_version nickname", "wechat_identities": "id account_id appid openid",
    "students": "id account_id is_default grade semester display_name", "wrong_images": "id student_id status question_count error_code original_url",
    "wrong_questions": "id image_id student_id subject grade difficulty wrong_count collection_status review_status mastery_status",
    "practice_sheets": "id student_id title generation_status pdf_url", "sheet_items": "id sheet_id wrong_question_id question_type sort_order question_text",
    "practice_attempts": "id sheet_id student_id attempt_no idempotency_key accuracy",
    "practice_results": "id attempt_id sheet_item_id wrong_question_id is_correct",
    "account_recovery_conflicts": "id support_reference current_account_id target_account_id status",
    "file_cleanup_jobs": "id storage_kind object_path attempt_count",
}


def _content_sql(name, rows):
    shown = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in CONTENT[name].split())
    half = f"CAST(CAST('0x' || substr(md5({shown}), 1, 8) AS BIGINT) AS HUGEINT)"
    return f"SELECT '{name}' AS \"table\", count(*) AS n, count(DISTINCT id) AS ids, CAST(sum({half}) AS BIGINT) AS content FROM {rows} AS r"


def _audit(t):
    return tb.audit_constraints({name: pin(df) for name, df in domain_tables(t).items()})


# What the audit is held against, per table of the test data: required columns that are there, those that
# are not, unique keys with a condition, references with their parent, and allowed values.
EXPECTED = {
    "accounts": ("id status token_version", "created_at updated_at", [("id",)], [], {"status": "active pending_deletion"}),
    "wechat_identities": (
        "id account_id appid openid", "last_login_at created_at updated_at", [("id",), ("appid openid",)], [("account_id", "accounts")], {}),
    "students": (
        "id account_id is_default", "profile_completed created_at updated_at", [("id",), ("account_id", "is_default")],
        [("account_id", "accounts")], {}),
    "wrong_images": (
        "id student_id original_url question_count status created_at", "grade semester updated_at", [("id",)],
        [("student_id", "students")], {"status": "pending segmented needs_review confirmed failed cancelled"}),
    "wrong_questions": (
        "id student_id image_id tags wrong_count review_status mastery_status collection_status created_at updated_at semester grade", "",
        [("id",)], [("student_id", "students"), ("image_id", "wrong_images")],
        {"subject": "math chinese english", "review_status": "pending processing confirmed needs_review", "mastery_status": "learning mastered"}),
    "practice_sheets": (
        "id student_id generation_status created_at", "generation_total generation_completed updated_at", [("id",)],
        [("student_id", "students")], {}),
    "sheet_items": (
        "id sheet_id question_type question_text sort_order", "question_snapshot", [("id",)],
        [("sheet_id", "practice_sheets"), ("wrong_question_id", "wrong_questions")], {"question_type": "original derived"}),
    "practice_attempts": (
        "id sheet_id student_id attempt_no idempotency_key accuracy completed_at created_at updated_at", "correct_count total_count",
        [("id",), ("student_id idempotency_key",), ("sheet_id attempt_no",)],
        [("sheet_id", "practice_sheets"), ("student_id", "students")], {}),
    "practice_results": (
        "id attempt_id sheet_item_id is_correct created_at", "derived_count question_snapshot updated_at",
        [("id",), ("attempt_id sheet_item_id",)],
        [("attempt_id", "practice_attempts"), ("sheet_item_id", "sheet_items"), ("wrong_question_id", "wrong_questions")], {}),
    "account_recovery_conflicts": (
        "id support_reference status", "created_at updated_at", [("id",), ("support_reference",)],
        [("current_account_id", "accounts"), ("target_account_id", "accounts")], {"status": "open resolved"}),
    "file_cleanup_jobs": (
        "id storage_kind object_path attempt_count", "created_at updated_at", [("id",)], [], {"storage_kind": "avatar upload pdf"}),
}
# The two tables that are made from others, as SQL.
MADE = {
    "account_recovery_conflicts": "(SELECT id, 'AR-' || id AS support_reference, id AS current_account_id, id + 1 AS target_account_id, 'open' AS status FROM b_accounts)",
    "file_cleanup_jobs": "(SELECT id, 'pdf' AS storage_kind, pdf_url AS object_path, 0 AS attempt_count FROM b_sheets)",
}


def _audit_sql():
    """Every rule of EXPECTED as a query of its own: (table, rule, key, n)."""
    out = []

    def rule(table, name, query):
        out.append(f"SELECT '{table}' AS \"table\", '{name}' AS rule, CAST(key AS VARCHAR) AS key, CAST(n AS BIGINT) AS n FROM ({query}) AS x(key, n)")

    for table, (present, absent, unique, references, allowed) in EXPECTED.items():
        rows = f"{MADE.get(table, NAMES[table])} AS r"
        for name in absent.split():
            rule(table, "missing_column", f"SELECT '{name}', 1")
        for name in present.split():
            rule(table, "not_null", f"SELECT '{name}', count(*) FROM {rows} WHERE {name} IS NULL HAVING count(*) > 0")
        for keys, *condition in unique:
            names = keys.split()
            where = " AND ".join([f"{k} IS NOT NULL" for k in names] + condition)
            shown = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in names)
            rule(table, f"unique({','.join(names)})", f"SELECT {shown}, count(*) FROM {rows} WHERE {where} GROUP BY {', '.join(names)} HAVING count(*) > 1")
        for name, parent in references:
            rule(table, f"foreign({name})", f"SELECT {name}, count(*) FROM {rows} WHERE {name} IS NOT NULL AND {name} NOT IN (SELECT id FROM {NAMES[parent]} WHERE id IS NOT NULL) GROUP BY 1")
        for name, values in allowed.items():
            rule(table, f"domain({name})", f"SELECT {name}, count(*) FROM {rows} WHERE {name} NOT IN ({', '.join(repr(v) for v in values.split())}) GROUP BY 1")
    return " UNION ALL ".join(out)


def _changes(t):
    """Changes to images: two kinds of partial update, removals and new rows."""
    return t.sql("""SELECT o_orderkey + CASE WHEN o_orderpriority = '1-URGENT' THEN 1000000000 ELSE 0 END AS id, o_custkey AS student_id, 'confirmed' AS status,
        CAST(NULL AS STRING) AS error_code, CAST(77 AS INT) AS question_count,
        split(CASE WHEN o_orderstatus = 'P' THEN 'status;error_code' ELSE 'question_count' END, ';') AS _set,
        (o_orderpriority = '5-LOW') AS _deleted FROM orders""")


def _evolved(t, version):
    old = t("b_images").drop("error_code", "error_message")
    return tb.evolve_schema(tb.evolve_schema(old, "wrong_images", 8), "wrong_images", version, 8)


def _envelopes(t):
    return t.sql("""SELECT event_id AS id, CASE event_type WHEN 'error' THEN concat('{"base_resp":{"status_code":', CAST(user_id AS STRING), '},"content":', props, '}')
        WHEN 'view' THEN concat('[', props, ']') WHEN 'click' THEN 'oops' WHEN 'signup' THEN concat('{"content":"', event_type, '"}')
        ELSE '{"content":"{\\\\"k\\\\":1}","base_resp":null}' END AS body FROM events""")


CASES = {
    "a1_load_tables": Case(_loaded, " UNION ALL ".join(_content_sql(k, MADE.get(k, v)) for k, v in NAMES.items())),
    "a2_evolve_schema_up": Case(
        lambda t: _evolved(t, 8).select("id", "status", "error_code", "error_message", "recognition_correction"),
        "SELECT id, status, NULL AS error_code, NULL AS error_message, NULL AS recognition_correction FROM b_images",
    ),
    "a2_evolve_sheets_up": Case(
        lambda t: tb.evolve_schema(t("b_sheets").select("id", "student_id"), "practice_sheets", 6).drop("student_id"),
        """SELECT id, 'completed' AS generation_status, 0 AS generation_total, 0 AS generation_completed, NULL AS generation_error_code,
           NULL AS generation_error_message, NULL AS generation_started_at, NULL AS generation_duration_seconds FROM b_sheets""",
    ),
    "a2_evolve_schema_down": Case(
        lambda t: _evolved(t, 2).select("*"),
        """SELECT id, student_id, created_at, CASE status WHEN 'cancelled' THEN 'confirmed' WHEN 'failed' THEN 'pending' ELSE status END AS status,
           question_count, original_url FROM b_images""",
    ),
    "a3_audit_constraints": Case(_audit, _audit_sql()),
    "a3_audit_all": Case(
        lambda t: _audit(t).groupBy("table", "rule").agg(F.count("*").alias("keys"), F.sum("n").alias("rows")),
        f'SELECT "table", rule, count(*) AS keys, CAST(sum(n) AS BIGINT) AS "rows" FROM ({_audit_sql()}) GROUP BY 1, 2',
    ),
    "a4_parse_vision": Case(
        lambda t: parse_model_responses(t("b_responses"), "content", PAYLOAD).select(
            "response_id", "error", "payload.raw_text", "payload.difficulty"),
        """SELECT p_partkey AS response_id, CASE p_partkey % 6 WHEN 3 THEN 'vision_response_empty' WHEN 2 THEN 'vision_response_json_invalid' WHEN 4 THEN 'vision_response_json_invalid' END AS error,
             CASE WHEN p_partkey % 6 IN (0, 1, 5) THEN p_name END AS raw_text, CASE WHEN p_partkey % 6 IN (0, 1) THEN p_size END AS difficulty FROM part""",
    ),
    "a4_parse_llm": Case(
        lambda t: parse_model_responses(
            t("b_responses"), "content", PAYLOAD, mode="llm",
            default=F.struct(F.lit(None).cast("string").alias("raw_text"), F.lit(3).alias("difficulty")))
        .select("response_id", "error", "payload.raw_text", "payload.difficulty"),
        """SELECT p_partkey AS response_id, CASE p_partkey % 6 WHEN 3 THEN 'vision_response_empty' WHEN 4 THEN 'vision_response_json_invalid' END AS error,
             CASE WHEN p_partkey % 6 IN (0, 1, 2, 5) THEN p_name END AS raw_text, CASE WHEN p_partkey % 6 IN (0, 1) THEN p_size WHEN p_partkey % 6 IN (3, 4) THEN 3 END AS difficulty FROM part""",
    ),
    "a4_open_envelope": Case(
        lambda t: parse_model_responses(open_envelope(_envelopes(t), "body"), "content", "k int").select("id", "error", "payload.k"),
        """SELECT event_id AS id, CASE event_type WHEN 'error' THEN CASE WHEN user_id = 0 THEN 'vision_response_empty' ELSE 'vision_upstream_rejected' END WHEN 'view' THEN 'vision_response_envelope_invalid'
             WHEN 'click' THEN 'vision_response_envelope_invalid' WHEN 'signup' THEN 'vision_response_json_invalid' END AS error, CASE WHEN event_type = 'purchase' THEN 1 END AS k FROM events""",
    ),
    "a6_merge_changes": Case(
        lambda t: merge_changes(t("b_images"), _changes(t)).select("id", "student_id", "status", "error_code", "question_count", "original_url"),
        """WITH o AS (SELECT * FROM orders JOIN b_images i ON i.id = o_orderkey)
           SELECT id, student_id, CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderstatus = 'P' THEN 'confirmed' ELSE status END AS status,
             CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderstatus = 'P' THEN NULL ELSE error_code END AS error_code,
             CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P' THEN 77 ELSE question_count END AS question_count, original_url FROM o WHERE o_orderpriority <> '5-LOW'
           UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 'confirmed', NULL, 77, NULL FROM o WHERE o_orderpriority = '1-URGENT'""",
    ),
    "a7_batched_due": Case(
        lambda t: batched_due(t("b_questions"), purge_due(NOW), ["deleted_at", "id"], 100).select("id", "deleted_at", "batch_no"),
        f"""SELECT id, deleted_at, CAST(floor((row_number() OVER (ORDER BY deleted_at ASC NULLS LAST, id) - 1) / 100) AS BIGINT) AS batch_no FROM b_questions
           WHERE coalesce(deleted_at < {CUTOFF}, false) OR (collection_status = 'ignored' AND updated_at < {CUTOFF})""",
    ),
}

"""The eleven tables: schemas, loading, migrations and constraint audit."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Table -> column -> Spark type. A trailing ! marks a required column.
TABLES = {
    "accounts": """id string!, nickname string, avatar_object_key string, phone_ciphertext string,
        phone_fingerprint string, phone_bound_at ts, status string!, profile_prompted_at ts,
        profile_completed_at ts, token_version int!, deletion_requested_at ts, deletion_due_at ts,
        created_at ts!, updated_at ts!""",
    "wechat_identities": """id string!, account_id string!, appid string!, openid string!, unionid string,
        last_login_at ts!, created_at ts!, updated_at ts!""",
    "students": """id string!, account_id string!, display_name string, grade smallint, semester smallint,
        is_default boolean!, profile_completed boolean!, created_at ts!, updated_at ts!""",
    "wrong_images": """id string!, student_id string!, original_url string!, subject string, grade smallint!,
        semester smallint!, question_count int!, status string!, error_code string, error_message string,
        recognition_correction string, created_at ts!, updated_at ts!""",
    "wrong_questions": """id string!, student_id string!, image_id string!, crop_region string, subject string,
        semester smallint!, grade smallint!, ocr_text string, ocr_answer string, ocr_raw_json string,
        question_type string, problem_schema string, difficulty_params string, derived_schema string,
        tags array<string>!, difficulty smallint, wrong_count int!, review_status string!,
        mastery_status string!, mastered_at ts, last_practiced_at ts, deleted_at ts,
        collection_status string!, created_at ts!, updated_at ts!""",
    "practice_sheets": """id string!, student_id string!, title string, config_json string, pdf_url string,
        generation_status string!, generation_total int!, generation_completed int!,
        generation_error_code string, generation_error_message string, generation_started_at ts,
        generation_duration_seconds int, created_at ts!, updated_at ts!""",
    "sheet_items": """id string!, sheet_id string!, wrong_question_id string, question_type string!,
        derived_from string, question_text string!, question_snapshot string!, sort_order int!,
        generation_method string""",
    "practice_attempts": """id string!, sheet_id string!, student_id string!, attempt_no int!,
        idempotency_key string!, correct_count int!, total_count int!, accuracy decimal(5,4)!,
        completed_at ts!, created_at ts!, updated_at ts!""",
    "practice_results": """id string!, attempt_id string!, sheet_item_id string!, wrong_question_id string,
        is_correct boolean!, derived_count int!, question_snapshot string!, created_at ts!, updated_at ts!""",
    "account_recovery_conflicts": """id string!, support_reference string!, current_account_id string,
        target_account_id string, status string!, resolved_at ts, created_at ts!, updated_at ts!""",
    "file_cleanup_jobs": """id string!, storage_kind string!, object_path string!, attempt_count int!,
        last_error string, next_attempt_at ts, created_at ts!, updated_at ts!""",
}

# What is unique, what refers to what, what a column may hold.
UNIQUE = [
    ("accounts", ["phone_fingerprint"], None),
    ("wechat_identities", ["appid", "openid"], None),
    ("students", ["account_id"], "is_default"),
    ("practice_attempts", ["student_id", "idempotency_key"], None),
    ("practice_attempts", ["sheet_id", "attempt_no"], None),
    ("practice_results", ["attempt_id", "sheet_item_id"], None),
    ("account_recovery_conflicts", ["support_reference"], None),
] + [(table, ["id"], None) for table in TABLES]
FOREIGN = [
    ("wechat_identities", "account_id", "accounts"),
    ("students", "account_id", "accounts"),
    ("wrong_images", "student_id", "students"),
    ("wrong_questions", "student_id", "students"),
    ("wrong_questions", "image_id", "wrong_images"),
    ("practice_sheets", "student_id", "students"),
    ("sheet_items", "sheet_id", "practice_sheets"),
    ("sheet_items", "wrong_question_id", "wrong_questions"),
    ("sheet_items", "derived_from", "wrong_questions"),
    ("practice_attempts", "sheet_id", "practice_sheets"),
    ("practice_attempts", "student_id", "students"),
    ("practice_results", "attempt_id", "practice_attempts"),
    ("practice_results", "sheet_item_id", "sheet_items"),
    ("practice_results", "wrong_question_id", "wrong_questions"),
    ("account_recovery_conflicts", "current_account_id", "accounts"),
    ("account_recovery_conflicts", "target_account_id", "accounts"),
]
DOMAINS = [
    ("accounts", "status", ["active", "pending_deletion"]),
    ("wrong_images", "subject", ["math", "chinese", "english"]),
    ("wrong_images", "status", ["pending", "segmented", "needs_review", "confirmed", "failed", "cancelled"]),
    ("wrong_questions", "subject", ["math", "chinese", "english"]),
    ("wrong_questions", "review_status", ["pending", "processing", "confirmed", "needs_review"]),
    ("wrong_questions", "mastery_status", ["learning", "mastered"]),
    ("sheet_items", "question_type", ["original", "derived"]),
    ("account_recovery_conflicts", "status", ["open", "resolved"]),
    ("file_cleanup_jobs", "storage_kind", ["avatar", "upload", "pdf"]),
]

# Fixed values: (version, table, column, type, default) and (version, column, removed, replacement).
ADDED = [
    (3, "wrong_images", "error_code", "string", None),
    (3, "wrong_images", "error_message", "string", None),
    (4, "wrong_questions", "collection_status", "string", "collected"),
    (5, "practice_sheets", "generation_status", "string", "completed"),
    (5, "practice_sheets", "generation_total", "int", 0),
    (5, "practice_sheets", "generation_completed", "int", 0),
    (5, "practice_sheets", "generation_error_code", "string", None),
    (5, "practice_sheets", "generation_error_message", "string", None),
    (6, "practice_sheets", "generation_started_at", "timestamp_ntz", None),
    (6, "practice_sheets", "generation_duration_seconds", "int", None),
    (7, "wrong_images", "recognition_correction", "string", None),
]
RETIRED_STATUS = [(8, "cancelled", "confirmed"), (3, "failed", "pending")]
LATEST_VERSION = 8


def _columns(table: str) -> list[tuple[str, str, bool]]:
    """(name, Spark type, required) of a table's columns."""
    out = []
    for part in re.split(r",\s+", TABLES[table]):
        name, kind = part.split()
        plain = kind.rstrip("!")
        out.append((name, "timestamp_ntz" if plain == "ts" else plain, kind.endswith("!")))
    return out


def table_schema(table: str, id_type: str = "string") -> T.StructType:
    """Schema of a table; ``id_type`` replaces the type of key columns (the test data has longs)."""
    ddl = []
    for name, kind, _ in _columns(table):
        is_key = name == "id" or (name.endswith("_id")) or name == "derived_from"
        ddl.append(f"{name} {id_type if is_key else kind}")
    return T.StructType.fromDDL(", ".join(ddl))


def conform(df: DataFrame, table: str, id_type: str = "string") -> DataFrame:
    """Select a table's columns in order and type, adding missing ones as null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_schema(table, id_type)
        ]
    )


def load_tables(
    spark: SparkSession,
    location: str,
    *,
    id_type: str = "string",
    jdbc: dict[str, str] | None = None,
    partitioning: dict[str, dict[str, str]] | None = None,
) -> dict[str, DataFrame]:
    """All tables, from ``location``/<table> parquet folders or, with ``jdbc``, from a database.

    JDBC reads are split by ``partitioning[table]``: Spark's own partitionColumn, lowerBound,
    upperBound and numPartitions options.
    """
    tables = {}
    for name in TABLES:
        if jdbc is None:
            tables[name] = spark.read.schema(table_schema(name, id_type)).parquet(f"{location}/{name}")
        else:
            options = {**jdbc, "url": location, "dbtable": name, **(partitioning or {}).get(name, {})}
            tables[name] = conform(spark.read.format("jdbc").options(**options).load(), name, id_type)
    return tables


def evolve_schema(df: DataFrame, table: str, version: int, from_version: int = 2) -> DataFrame:
    """Bring rows of ``from_version`` to ``version``: add defaulted columns, or drop them again.

    Going down also maps the image states that the older version does not know.
    """
    if version >= from_version:
        for at, owner, name, kind, default in ADDED:
            if owner == table and from_version < at <= version and name not in df.columns:
                df = df.withColumn(name, F.lit(default).cast(kind))
        return df
    if table == "wrong_images":
        for at, removed, replacement in RETIRED_STATUS:
            if version < at <= from_version:
                df = df.withColumn(
                    "status", F.when(F.col("status") == removed, replacement).otherwise(F.col("status"))
                )
    return df.drop(*[n for at, owner, n, _, _ in ADDED if owner == table and version < at])


def _key_text(columns: list[str]) -> Column:
    """Key columns as one text; separators inside a composite key are escaped."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    parts = [F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for c in columns]
    return F.concat_ws("|", *parts)


def _row_faults(table: str, df: DataFrame) -> DataFrame | None:
    """(table, rule, key, n) of the not-null and domain rules, from one scan that explodes faulty rows only."""
    have = set(df.columns)
    rules = [
        (F.col(name).isNull(), "not_null", F.lit(name))
        for name, _, needed in _columns(table)
        if needed and name in have
    ] + [
        (F.coalesce(~F.col(name).isin(allowed), F.lit(False)), f"domain({name})", F.col(name))
        for owner, name, allowed in DOMAINS
        if owner == table and name in have
    ]
    if not rules:
        return None
    hits = F.array(*[F.when(broken, F.struct(F.lit(rule).alias("rule"), key.alias("key"))) for broken, rule, key in rules])
    faulty = df.filter(reduce(lambda a, b: a | b, [broken for broken, _, _ in rules]))
    rows = faulty.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("_h"))
    return rows.groupBy(F.lit(table).alias("table"), "_h.rule", "_h.key").agg(F.count("*").alias("n"))


def _repeats(table: str, df: DataFrame, keys: list[str], condition: str | None) -> DataFrame:
    """(table, rule, key, n) of a unique rule; keys are grouped in their own types and shown as text."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    if condition:
        present = present & F.col(condition)
    counted = df.filter(present).groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    rule = F.lit(f"unique({','.join(keys)})").alias("rule")
    return counted.select(F.lit(table).alias("table"), rule, _key_text(keys).alias("key"), F.col("_n").alias("n"))


def _dangling(parent: DataFrame, references: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(table, rule, key, n) of the references (table, column, rows) that name no id of ``parent``.

    References are counted per value first, so a hot one is a single row where it meets the ids; those of
    all tables meet them at once. Both sides keep the id's type, or become text where types differ.
    """
    kinds = {parent.schema["id"].dataType} | {df.schema[name].dataType for _, name, df in references}
    kind = kinds.pop() if len(kinds) == 1 else T.StringType()
    counted = [
        df.filter(F.col(name).isNotNull())
        .groupBy(F.lit(table).alias("table"), F.lit(f"foreign({name})").alias("rule"), F.col(name).cast(kind).alias("id"))
        .agg(F.count("*").alias("n"))
        for table, name, df in references
    ]
    ids = parent.select(F.col("id").cast(kind).alias("id"))
    lost = reduce(DataFrame.unionByName, counted).join(ids, "id", "left_anti")
    return lost.select("table", "rule", F.col("id").cast("string").alias("key"), "n")


def audit_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations as (table, rule, key, n): missing columns, not-null, unique, foreign key and domain rules.

    Row rules take one scan a table and move nothing but faulty rows. A unique rule reads its key columns
    only; a foreign key is counted per value before it meets the ids of its parent. A rule one of whose
    columns is absent is not audited, nor a foreign key whose parent is not among ``tables``.
    """
    found, absent = [], []
    for table, df in tables.items():
        have = set(df.columns)
        absent += [(table, "missing_column", n, 1) for n, _, needed in _columns(table) if needed and n not in have]
        faults = _row_faults(table, df)
        found += [] if faults is None else [faults]
        for owner, keys, condition in UNIQUE:
            if owner == table and set(keys) | ({condition} if condition else set()) <= have:
                found.append(_repeats(table, df, keys, condition))
    for parent, df in tables.items():
        references = [
            (owner, name, tables[owner])
            for owner, name, target in FOREIGN
            if target == parent and owner in tables and name in tables[owner].columns
        ]
        if references and "id" in df.columns:
            found.append(_dangling(df, references))
    if absent:
        spark = next(iter(tables.values())).sparkSession
        found.append(spark.createDataFrame(absent, "table string, rule string, key string, n long"))
    while len(found) > 1:  # in pairs: a chain would be analysed anew at every step
        found = [reduce(DataFrame.unionByName, found[i : i + 2]) for i in range(0, len(found), 2)]
    return found[0]

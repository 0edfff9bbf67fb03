"""The constraint audit on small hand-made tables."""

from relearn.sources.tables import audit_constraints


def found(tables):
    return {(r["table"], r["rule"], r["key"]): r["n"] for r in audit_constraints(tables).collect()}


def test_every_kind_of_rule(spark):
    accounts = spark.createDataFrame(
        [(1, "active", 0, None), (1, "gone", 0, "f"), (2, None, 0, "f"), (None, "active", 0, None)],
        "id long, status string, token_version int, phone_fingerprint string",
    )
    students = spark.createDataFrame(
        [(10, 1, True), (11, 1, True), (12, 1, False), (13, 9, True), (14, 9, False), (15, None, True)],
        "id long, account_id long, is_default boolean",
    )
    out = found({"accounts": accounts, "students": students})
    assert {k: n for k, n in out.items() if k[1] != "missing_column"} == {
        ("accounts", "not_null", "id"): 1,
        ("accounts", "not_null", "status"): 1,
        ("accounts", "domain(status)", "gone"): 1,
        ("accounts", "unique(id)", "1"): 2,
        ("accounts", "unique(phone_fingerprint)", "f"): 2,
        ("students", "not_null", "account_id"): 1,
        ("students", "unique(account_id)", "1"): 2,
        ("students", "foreign(account_id)", "9"): 2,
    }
    assert ("accounts", "missing_column", "created_at") in out and ("students", "missing_column", "profile_completed") in out


def test_composite_keys_are_told_apart_and_types_may_differ(spark):
    attempts = spark.createDataFrame(
        [(1, "a|b", "c"), (2, "a", "b|c"), (3, "a", "b|c")], "id long, student_id string, idempotency_key string"
    )
    out = found({"practice_attempts": attempts})
    assert out["practice_attempts", "unique(student_id,idempotency_key)", "a|b\\|c"] == 2
    assert len([k for k in out if k[1].startswith("unique")]) == 1
    sheets = spark.createDataFrame([("7",), ("8",)], "id string")
    items = spark.createDataFrame([(1, 7), (2, 9)], "id long, sheet_id long")
    out = found({"practice_sheets": sheets, "sheet_items": items})
    assert {k for k in out if k[1].startswith("foreign")} == {("sheet_items", "foreign(sheet_id)", "9")}


def test_a_reference_meets_ids_as_one_row_a_value(spark):
    items = spark.range(1000).selectExpr("id", "5L AS sheet_id")
    sheets = spark.range(3)
    audit = audit_constraints({"practice_sheets": sheets, "sheet_items": items})
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Window" not in plan
    # No key becomes text before it is counted, and only faulty rows are exploded.
    assert all("Aggregate" not in line for line in plan.splitlines() if "cast(sheet_id" in line)
    assert ("sheet_items", "foreign(sheet_id)", "5", 1000) in [tuple(r) for r in audit.collect()]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, sheet_id long")
    assert not [k for k in found({"sheet_items": empty, "practice_sheets": empty.select("id")}) if k[1] != "missing_column"]

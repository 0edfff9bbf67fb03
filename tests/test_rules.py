"""Long secrets, absent columns, repeated requests."""

import hashlib
import hmac

from pyspark.sql import functions as F

from relearn.operators import identity
from relearn.sources import tables as tb
from relearn.sources.changes import merge_changes


def test_fingerprint_is_hmac_for_any_key_length(spark):
    for size in (1, 64, 65, 200):
        secret = "k" * size
        got = spark.range(1).select(identity.phone_fingerprint(F.lit("13812345678"), secret)).first()[0]
        assert got == hmac.new(secret.encode(), b"13812345678", hashlib.sha256).hexdigest()


def test_audit_reports_absent_columns_and_knows_processing(spark):
    name = "wrong_questions"
    whole = tb.conform(spark.createDataFrame([(1, "processing")], "id long, review_status string"), name, "long")
    rules = {(r.rule, r.key) for r in tb.audit_constraints({name: whole}).collect()}
    assert not any(rule.startswith("domain(review_status") for rule, _ in rules)
    lacking = tb.audit_constraints({name: whole.drop("student_id")}).filter("rule = 'missing_column'").collect()
    assert [(r.table, r.key, r.n) for r in lacking] == [(name, "student_id", 1)]


def test_a_key_changed_twice_takes_the_last_change(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    twice = spark.createDataFrame([(1, "new", 2), (1, "old", 1), (3, "c", 1)], "id int, v string, at int")
    got = merge_changes(base, twice, order=["at"])
    assert sorted(map(tuple, got.collect())) == [(1, "new"), (2, "b"), (3, "c")]


def test_claims_on_one_account_have_one_winner(spark):
    accounts = spark.createDataFrame([(i, "active", 1, f"p{i}", None) for i in (1, 2, 3, 9)],
                                     "id int, status string, token_version int, phone_fingerprint string, avatar_object_key string")
    identities = spark.createDataFrame([(i, i) for i in (1, 2, 3, 9)], "id int, account_id int")
    students = spark.createDataFrame([(i, i, True) for i in (1, 2, 3, 9)], "id int, account_id int, is_default boolean")
    business = spark.createDataFrame([(i, False) for i in (1, 2, 3, 9)], "account_id int, has_data boolean")
    # 1 and 2 both want 9; 9 wants 3, but takes 1 in itself; the second row repeats the first.
    claims = spark.createDataFrame([(1, 9, 1, 1, "p9"), (1, 9, 1, 1, "p9"), (2, 9, 1, 1, "p9"), (9, 3, 1, 1, "p3")],
                                   "current_account_id int, target_account_id int, current_version int, target_version int, phone_fingerprint string")
    out = identity.merge_empty_accounts(accounts, identities, students, business, claims)
    assert sorted((r.current_account_id, r.target_account_id, r.outcome) for r in out["outcome"].collect()) == [
        (1, 9, "merged"), (2, 9, "state_changed"), (9, 3, "state_changed")]
    assert sorted(r.id for r in out["accounts"].collect()) == [2, 3, 9]

"""Logins, phone binding, account merging and profiles."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relearn.functions.text import strip
from relearn.functions.times import moment
from relearn.operators.lifecycle import Moment
from relearn.sources.changes import overlay

# Fixed value: HMAC works on SHA-256 blocks of 64 bytes.
HMAC_BLOCK = 64
ENVELOPE = "v1:"


def clean_phone(phone: Column) -> Column:
    """Bare eleven-digit mainland number, or null when the text is none."""
    compact = F.regexp_replace(F.coalesce(phone, F.lit("")), r"(?U)[\s-]+", "")
    bare = (
        F.when(compact.startswith("+86"), F.substr(compact, F.lit(4)))
        .when(compact.startswith("86") & (F.length(compact) == 13), F.substr(compact, F.lit(3)))
        .otherwise(compact)
    )
    return F.when(bare.rlike(r"\A1[3-9][0-9]{9}\z"), bare)


def mask_phone(clean: Column) -> Column:
    return F.concat(F.substr(clean, F.lit(1), F.lit(3)), F.lit("****"), F.substr(clean, F.lit(8), F.lit(4)))


def phone_fingerprint(clean: Column, secret: str) -> Column:
    """HMAC-SHA256 of the number as hex, built from SHA-256 so that it stays in the JVM.

    A key longer than one block is hashed first.
    """
    key = secret.encode("utf-8")
    if len(key) > HMAC_BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(HMAC_BLOCK, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    digest = F.sha2(F.concat(inner, F.encode(clean, "utf-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def protect_phone(clean: Column, key: str) -> Column:
    """Versioned AES-GCM envelope; every call draws a new initialisation vector."""
    return F.concat(F.lit(ENVELOPE), F.base64(F.aes_encrypt(clean, F.lit(key.encode("utf-8")), F.lit("GCM"))))


def reveal_phone(envelope: Column, key: str) -> Column:
    """The protected number; null for another version, a wrong key or damaged data."""
    body = F.when(envelope.startswith(ENVELOPE), F.substr(envelope, F.lit(len(ENVELOPE) + 1)))
    raw = F.try_to_binary(body, F.lit("base64"))
    plain = F.try_aes_decrypt(raw, F.lit(key.encode("utf-8")), F.lit("GCM")).cast("string")
    return clean_phone(plain)


def natural_id(kind: str, *parts: Column) -> Column:
    """An id that depends only on the natural key, so a replay creates nothing new."""
    return F.sha2(F.concat_ws("\u001f", F.lit(kind), *[p.cast("string") for p in parts]), 256)


def upsert_logins(identities: DataFrame, logins: DataFrame) -> dict[str, DataFrame]:
    """Fold logins(appid, openid, login_at) into identities.

    Known identities take the newest login time; each unknown one opens an account with a
    default student.
    """
    key = ["appid", "openid"]
    newest = logins.groupBy(*key).agg(F.max("login_at").alias("last_login_at"))
    known = identities.select(*key, F.col("id").alias("identity_id"), "account_id")
    seen = newest.join(known, key)
    fresh = newest.join(known.select(*key), key, "left_anti")
    account = natural_id("account", F.col("appid"), F.col("openid"))
    new_identities = fresh.select(
        natural_id("identity", F.col("appid"), F.col("openid")).alias("identity_id"),
        account.alias("account_id"), *key, "last_login_at",
    )
    return {
        "known": seen.select("identity_id", "account_id", *key, "last_login_at"),
        "new_identities": new_identities,
        "new_accounts": new_identities.select(
            F.col("account_id").alias("id"), F.lit("active").alias("status"), F.lit(1).alias("token_version")
        ),
        "new_students": new_identities.select(
            natural_id("student", F.col("account_id")).alias("id"),
            "account_id",
            F.lit(True).alias("is_default"),
            F.lit(False).alias("profile_completed"),
        ),
    }


def has_business_data(
    accounts: DataFrame,
    students: DataFrame,
    images: DataFrame,
    questions: DataFrame,
    sheets: DataFrame,
    attempts: DataFrame,
) -> DataFrame:
    """(account_id, has_data): any upload, question, sheet or attempt, or a further student."""
    active = reduce(
        DataFrame.union,
        [df.select("student_id").distinct() for df in (images, questions, sheets, attempts)],
    ).distinct()
    flagged = students.join(
        active.select(F.col("student_id").alias("id"), F.lit(True).alias("_active")), "id", "left"
    )
    per_account = flagged.groupBy("account_id").agg(
        F.bool_or(F.col("_active").isNotNull() | ~F.col("is_default")).alias("has_data")
    )
    return accounts.select(F.col("id").alias("account_id")).join(per_account, "account_id", "left").select(
        "account_id", F.coalesce("has_data", F.lit(False)).alias("has_data")
    )


def resolve_phone_bindings(
    accounts: DataFrame, requests: DataFrame, business: DataFrame, secret: str
) -> DataFrame:
    """Outcome of each bind request(account_id, phone, requested_at, request_id).

    A free number goes to its first valid request; later ones meet that owner. An account
    sends at most one request per run.
    """
    clean = clean_phone(F.col("phone"))
    asked = requests.withColumn("_clean", clean).withColumn(
        "_print", phone_fingerprint(F.col("_clean"), secret)
    )
    me = accounts.select(
        F.col("id").alias("account_id"), F.col("status").alias("_my_status"), F.col("phone_fingerprint").alias("_my_print")
    )
    asked = asked.join(me, "account_id", "left").withColumn(
        "_valid", F.col("_clean").isNotNull() & F.coalesce(F.col("_my_status") == "active", F.lit(False))
    )
    stored = accounts.filter(F.col("phone_fingerprint").isNotNull()).select(
        F.col("phone_fingerprint").alias("_print"),
        F.col("id").alias("_stored_owner"),
        F.col("status").alias("_stored_status"),
    )
    claims = asked.filter("_valid").groupBy("_print").agg(
        F.min(F.struct("requested_at", "request_id", "account_id")).alias("_claim")
    )
    owners = stored.join(claims, "_print", "full_outer")
    joined = asked.join(owners, "_print", "left").join(business, "account_id", "left")
    owner = F.coalesce("_stored_owner", "_claim.account_id")
    owner_status = F.coalesce("_stored_status", F.lit("active"))
    outcome = (
        F.when(F.col("_clean").isNull(), "invalid_phone")
        .when(~F.col("_valid"), "invalid_account")
        .when(F.col("_my_print").eqNullSafe(F.col("_print")), "bound")
        .when(owner == F.col("account_id"), "bound")
        .when(owner_status == "pending_deletion", "owner_pending_deletion")
        .when(owner_status != "active", "owner_unavailable")
        .when(F.coalesce("has_data", F.lit(False)), "merge_required")
        .otherwise("recovery_available")
    )
    contested = F.col("outcome").isin("owner_pending_deletion", "owner_unavailable", "merge_required", "recovery_available")
    reference = F.concat(
        F.lit("AR-"),
        F.upper(F.substr(natural_id("conflict", F.col("account_id"), F.col("target_account_id")), F.lit(1), F.lit(12))),
    )
    shown = F.col("outcome").isin("bound", "recovery_available")
    return (
        joined.withColumn("outcome", outcome)
        .withColumn("target_account_id", F.when(contested, owner))
        .withColumn("support_reference", F.when(F.col("outcome") == "merge_required", reference))
        .select(
            "request_id", "account_id", "outcome", "target_account_id", "support_reference",
            F.when(shown, mask_phone(F.col("_clean"))).alias("phone_masked"),
            F.when(F.col("outcome") == "bound", F.col("_print")).alias("phone_fingerprint"),
        )
    )


def merge_empty_accounts(
    accounts: DataFrame,
    identities: DataFrame,
    students: DataFrame,
    business: DataFrame,
    claims: DataFrame,
) -> dict[str, DataFrame]:
    """Move the login of an empty account to the owner of its phone number.

    ``claims``(current_account_id, target_account_id, current_version, target_version,
    phone_fingerprint). Anything that changed since the claim refuses it. A merge changes both
    its accounts: of several good claims on one target the lowest current account's goes through,
    an account claiming several targets joins the lowest, one that takes another in is not merged away
    itself, and the rest find the state changed.
    """

    def side(prefix: str) -> DataFrame:
        return accounts.select(
            F.col("id").alias(f"{prefix}_account_id"),
            F.col("status").alias(f"_{prefix}_status"),
            F.col("token_version").alias(f"_{prefix}_version"),
            F.col("phone_fingerprint").alias(f"_{prefix}_print"),
            F.col("avatar_object_key").alias(f"_{prefix}_avatar"),
        )

    logins = identities.groupBy(F.col("account_id").alias("current_account_id")).agg(F.count("*").alias("_logins"))
    pupils = students.groupBy("account_id").agg(
        F.count("*").alias("_students"), F.count_if("is_default").alias("_defaults")
    )
    current_pupils = pupils.select(
        F.col("account_id").alias("current_account_id"), "_students", F.col("_defaults").alias("_current_defaults")
    )
    target_pupils = pupils.select(
        F.col("account_id").alias("target_account_id"), F.col("_defaults").alias("_target_defaults")
    )
    busy = business.select(F.col("account_id").alias("current_account_id"), "has_data")
    rows = (
        claims.join(side("current"), "current_account_id", "left")
        .join(side("target"), "target_account_id", "left")
        .join(logins, "current_account_id", "left")
        .join(current_pupils, "current_account_id", "left")
        .join(target_pupils, "target_account_id", "left")
        .join(busy, "current_account_id", "left")
    )
    state_ok = (
        (F.col("current_account_id") != F.col("target_account_id"))
        & (F.col("_current_status") == "active")
        & (F.col("_target_status") == "active")
        & (F.col("_current_version") == F.col("current_version"))
        & (F.col("_target_version") == F.col("target_version"))
        & (F.col("_target_print") == F.col("phone_fingerprint"))
    )
    shape_ok = (
        (F.col("_logins") == 1)
        & (F.col("_students") == 1)
        & (F.col("_current_defaults") == 1)
        & (F.col("_target_defaults") == 1)
    )
    outcome = (
        F.when(~F.coalesce(state_ok, F.lit(False)), "state_changed")
        .when(F.coalesce("has_data", F.lit(False)), "not_empty")
        .when(~F.coalesce(shape_ok, F.lit(False)), "structure_changed")
        .otherwise("merged")
    )
    alone = rows.withColumn("outcome", outcome).dropDuplicates(["current_account_id", "target_account_id"])
    good = alone.filter("outcome = 'merged'")
    pairs = good.groupBy("target_account_id").agg(F.min("current_account_id").alias("current_account_id"))
    pairs = pairs.groupBy("current_account_id").agg(F.min("target_account_id").alias("target_account_id"))
    takes = pairs.select(F.col("target_account_id").alias("current_account_id"))
    winners = pairs.join(takes, "current_account_id", "left_anti").withColumn("_wins", F.lit(True))
    judged = alone.join(winners, ["current_account_id", "target_account_id"], "left").withColumn(
        "outcome", F.when((F.col("outcome") == "merged") & F.col("_wins").isNull(), "state_changed").otherwise(F.col("outcome"))
    )
    merged = judged.filter("outcome = 'merged'")
    gone = merged.select(F.col("current_account_id").alias("id"))
    bumped = merged.select(
        F.col("target_account_id").alias("id"), (F.col("_target_version") + 1).cast("int").alias("token_version")
    )
    moved = identities.join(
        merged.select(F.col("current_account_id").alias("account_id"), F.col("target_account_id").alias("_to")),
        "account_id", "left",
    ).withColumn("account_id", F.coalesce("_to", "account_id"))
    jobs = merged.filter(F.col("_current_avatar").startswith("/avatars/")).select(
        F.lit("avatar").alias("storage_kind"), F.col("_current_avatar").alias("object_path")
    )
    return {
        "outcome": judged.select("current_account_id", "target_account_id", "outcome"),
        "accounts": overlay(accounts, bumped).join(gone, "id", "left_anti"),
        "identities": moved.select(*identities.columns),
        "students": students.join(gone.withColumnRenamed("id", "account_id"), "account_id", "left_anti"),
        "jobs": jobs,
    }


def apply_profile_updates(
    accounts: DataFrame, students: DataFrame, updates: DataFrame, now: Moment
) -> dict[str, DataFrame]:
    """Profile changes(account_id, nickname, student_name, grade, semester, skip_prompt).

    Null means not given. Names are trimmed, and a blank name or an out-of-range class
    refuses the whole update. A nickname stamps completion, and the prompt time once; a
    skipped prompt stamps that time once.
    """
    names = {n: strip(F.col(n)) for n in ("nickname", "student_name")}
    bad = F.lit(False)
    for name, value in names.items():
        bad = bad | F.coalesce((value == "") | (F.length(value) > 50), F.lit(False))
    bad = bad | F.coalesce(~F.col("grade").between(1, 6), F.lit(False))
    bad = bad | F.coalesce(~F.col("semester").between(1, 2), F.lit(False))
    judged = updates.withColumn("refused", bad)
    good = judged.filter("NOT refused").select(
        "account_id",
        *[v.alias(f"_{n}") for n, v in names.items()],
        F.col("grade").alias("_grade"),
        F.col("semester").alias("_semester"),
        F.coalesce("skip_prompt", F.lit(False)).alias("_skip"),
    )
    at = moment(now)
    side = good.select(F.col("account_id").alias("id"), "_nickname", "_skip")
    named = F.col("_nickname").isNotNull()
    prompted = F.coalesce("profile_prompted_at", F.when(named | F.col("_skip"), at))
    new_accounts = (
        accounts.join(side, "id", "left")
        .withColumn("nickname", F.coalesce("_nickname", "nickname"))
        .withColumn("profile_prompted_at", prompted)
        .withColumn("profile_completed_at", F.when(named, at).otherwise(F.col("profile_completed_at")))
        .select(*accounts.columns)
    )
    given = good.select("account_id", "_student_name", "_grade", "_semester", F.lit(True).alias("_hit"))
    mine = F.col("is_default") & F.coalesce("_hit", F.lit(False))
    new_students = students.join(given, "account_id", "left")
    for name, source in (("display_name", "_student_name"), ("grade", "_grade"), ("semester", "_semester")):
        new_students = new_students.withColumn(
            name, F.when(mine, F.coalesce(F.col(source), F.col(name))).otherwise(F.col(name))
        )
    complete = F.col("grade").isNotNull() & F.col("semester").isNotNull()
    kept = F.col("profile_completed") if "profile_completed" in students.columns else complete
    new_students = new_students.withColumn("profile_completed", F.when(mine, complete).otherwise(kept))
    columns = list(dict.fromkeys([*students.columns, "profile_completed"]))
    return {
        "accounts": new_accounts,
        "students": new_students.select(*columns),
        "refused": judged.filter("refused").select("account_id"),
    }

from pyspark.sql import functions as F

from relearn.catalog import Case
from relearn.functions.ranks import pin
from relearn.operators import identity as ident

SECRET = "check-secret"
AES_KEY = "0123456789abcdef"
NOW = "1998-12-01 00:00:00"


def _hmac_sql(value):
    """HMAC-SHA256 as SQL over SHA-256."""
    key = SECRET.encode().ljust(64, b"\0")
    pad = {n: "".join(f"\\x{b ^ n:02X}" for b in key) for n in (0x36, 0x5C)}
    inner = f"sha256('{pad[0x36]}'::BLOB || encode({value}))"
    return f"sha256('{pad[0x5C]}'::BLOB || unhex({inner}))"


CLEAN = r"""numbers AS (SELECT account_id, phone, CASE WHEN regexp_full_match(n, '1[3-9][0-9]{9}') THEN n END AS clean FROM (
  SELECT *, CASE WHEN c LIKE '+86%' THEN substr(c, 4) WHEN c LIKE '86%' AND length(c) = 13 THEN substr(c, 3) ELSE c END AS n FROM (
  SELECT *, regexp_replace(phone, '[\s-]+', '', 'g') AS c FROM b_phones) p) q)"""
CLEAN_PHONES = CLEAN + f", prints AS (SELECT account_id, clean, {_hmac_sql('clean')} AS print FROM numbers)"


def _phones(t):
    clean = ident.clean_phone(F.col("phone"))
    return t("b_phones").withColumn("clean", clean).withColumn(
        "print", ident.phone_fingerprint(F.col("clean"), SECRET)
    )


def _accounts(t):
    """Members where the lowest id of a number holds it, unless that id ends the numbering by four in one."""
    clean = ident.clean_phone(F.col("phone"))
    prints = t("b_member_phones").withColumn("print", ident.phone_fingerprint(clean, SECRET))
    holders = prints.filter("print IS NOT NULL").groupBy("print").agg(F.min("account_id").alias("id"))
    holders = holders.filter("id % 4 <> 1").withColumnRenamed("print", "phone_fingerprint")
    return t("b_members").join(holders, "id", "left")


MEMBER_PHONES = CLEAN_PHONES.replace("b_phones", "b_member_phones")
ACCOUNTS_SQL = """holders AS (SELECT print, min(account_id) AS id FROM prints WHERE clean IS NOT NULL GROUP BY print),
  accounts AS (SELECT a.*, CASE WHEN h.id % 4 <> 1 THEN h.print END AS phone_fingerprint FROM b_members a LEFT JOIN holders h ON h.id = a.id)"""


def _business(t):
    """Whether an account has any data, over whole tables; newcomers have none."""
    return ident.has_business_data(
        t("b_members"), t("b_member_students"), t("b_images"), t("b_questions"), t("b_sheets"), t("b_attempts"))


BUSINESS_SQL = """busy AS (SELECT student_id FROM b_images UNION SELECT student_id FROM b_questions
    UNION SELECT student_id FROM b_sheets UNION SELECT student_id FROM b_attempts),
  business AS (SELECT a.id AS account_id, coalesce(bool_or(s.id IN (SELECT student_id FROM busy) OR NOT s.is_default), false) AS has_data
    FROM b_members a LEFT JOIN b_member_students s ON s.account_id = a.id GROUP BY a.id)"""

REQUESTS = """SELECT p.account_id, p.phone, e.ts AS requested_at, p.account_id AS request_id FROM b_member_phones p JOIN events e ON e.event_id = p.account_id % 10000000"""


def _resolved(t, accounts=None, business=None):
    return ident.resolve_phone_bindings(
        accounts or _accounts(t), t.sql(REQUESTS), business or _business(t), SECRET)


RESOLVED = f"""{MEMBER_PHONES}, {ACCOUNTS_SQL}, {BUSINESS_SQL},
  asked AS (SELECT r.*, p.clean, p.print, a.status AS my_status, a.phone_fingerprint AS mine, s.id AS stored, s.status AS stored_status, b.has_data,
      p.clean IS NOT NULL AND a.status = 'active' AS valid FROM ({REQUESTS}) r JOIN prints p ON p.account_id = r.account_id JOIN accounts a ON a.id = r.account_id
    LEFT JOIN accounts s ON s.phone_fingerprint = p.print JOIN business b ON b.account_id = r.account_id),
  owned AS (SELECT *, coalesce(stored, first_value(CASE WHEN valid THEN account_id END IGNORE NULLS) OVER (
      PARTITION BY print ORDER BY requested_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS owner FROM asked),
  resolved AS (SELECT request_id, account_id, print, clean, owner, CASE WHEN clean IS NULL THEN 'invalid_phone' WHEN NOT valid THEN 'invalid_account'
      WHEN mine = print OR owner = account_id THEN 'bound' WHEN coalesce(stored_status, 'active') <> 'active' THEN 'owner_pending_deletion'
      WHEN has_data THEN 'merge_required' ELSE 'recovery_available' END AS outcome FROM owned)"""


def _bound_accounts(accounts, resolved):
    """Accounts after the free numbers were given out."""
    bound = resolved.filter("outcome = 'bound'").select(F.col("account_id").alias("id"), F.col("phone_fingerprint").alias("_print"))
    return accounts.join(bound, "id", "left").withColumn(
        "phone_fingerprint", F.coalesce("phone_fingerprint", "_print")).drop("_print")


def _merged(t):
    # Used several times below, so each is computed once.
    held, business = pin(_accounts(t)), pin(_business(t))
    resolved = pin(_resolved(t, held, business))
    accounts = pin(_bound_accounts(held, resolved))
    free = resolved.filter("outcome = 'recovery_available'").select("target_account_id", F.col("account_id").alias("current_account_id"))
    version = accounts.select("id", "token_version", "phone_fingerprint")
    claims = (
        free.join(version.select(F.col("id").alias("current_account_id"), F.col("token_version").alias("current_version")), "current_account_id")
        .join(version.select(F.col("id").alias("target_account_id"), F.col("token_version").alias("target_version"), "phone_fingerprint"), "target_account_id")
        .withColumn("current_version", F.col("current_version") + F.when(F.col("current_account_id") % 7 == 0, 1).otherwise(0))
    )
    return ident.merge_empty_accounts(accounts, t("b_member_identities"), t("b_member_students"), business, claims)


MERGED = f"""{RESOLVED}, claims AS (SELECT owner AS target_account_id, account_id AS current_account_id FROM resolved WHERE outcome = 'recovery_available'),
  pupils AS (SELECT account_id, count(*) AS n, count(*) FILTER (WHERE is_default) AS d FROM b_member_students GROUP BY 1),
  alone AS (SELECT c.current_account_id, c.target_account_id, CASE WHEN c.current_account_id % 7 = 0 OR ca.status <> 'active' OR ta.status <> 'active' THEN 'state_changed'
    WHEN b.has_data THEN 'not_empty' WHEN coalesce(cp.n, 0) <> 1 OR cp.d <> 1 OR coalesce(tp.d, 0) <> 1 THEN 'structure_changed' ELSE 'merged' END AS outcome, ca.avatar_object_key
    FROM claims c JOIN accounts ca ON ca.id = c.current_account_id JOIN accounts ta ON ta.id = c.target_account_id JOIN business b ON b.account_id = c.current_account_id
    LEFT JOIN pupils cp ON cp.account_id = c.current_account_id LEFT JOIN pupils tp ON tp.account_id = c.target_account_id),
  judged AS (SELECT * REPLACE (CASE WHEN outcome = 'merged' AND current_account_id <> min(CASE WHEN outcome = 'merged' THEN current_account_id END)
    OVER (PARTITION BY target_account_id) THEN 'state_changed' ELSE outcome END AS outcome) FROM alone)"""

UPDATES = """SELECT id AS account_id, CASE id % 4 WHEN 0 THEN '  Nick ' WHEN 1 THEN NULL WHEN 2 THEN concat('n', CAST(id AS STRING)) ELSE CASE WHEN id % 11 = 0 THEN '  ' END END AS nickname,
  CASE WHEN id % 3 = 0 THEN concat(' p', CAST(id AS STRING)) END AS student_name, CAST(CASE WHEN id % 6 = 0 THEN 2 WHEN id % 13 = 0 THEN 7 END AS INT) AS grade,
  CAST(CASE WHEN id % 5 = 0 THEN 1 END AS INT) AS semester, (id % 10 = 1) AS skip_prompt FROM b_accounts"""
UPDATED = f"""updates AS ({UPDATES}), good AS (SELECT account_id, trim(nickname) AS nickname, trim(student_name) AS student_name, grade, semester, skip_prompt FROM updates
    WHERE coalesce(trim(nickname) <> '', true) AND coalesce(grade <= 6, true))"""


def _profiles(t):
    return ident.apply_profile_updates(t("b_accounts"), t("b_students"), t.sql(UPDATES), NOW)


def _logins(t):
    return ident.upsert_logins(t("b_identities"), t("b_logins"))


NEW = """fresh AS (SELECT l.appid, l.openid, max(l.login_at) AS last_login_at FROM b_logins l LEFT JOIN b_identities i
  ON i.appid = l.appid AND i.openid = l.openid WHERE i.id IS NULL GROUP BY ALL)"""

CASES = {
    "g1_clean_phone": Case(
        lambda t: t("b_phones").withColumn("clean", ident.clean_phone(F.col("phone"))).select(
            "account_id", "clean", ident.mask_phone(F.col("clean")).alias("masked"), F.col("clean").isNull().alias("invalid")),
        f"""WITH {CLEAN} SELECT account_id, clean, substr(clean, 1, 3) || '****' || substr(clean, 8, 4) AS masked, clean IS NULL AS invalid FROM numbers""",
    ),
    "g2_phone_fingerprint": Case(
        lambda t: _phones(t).select("account_id", "print"), f"WITH {CLEAN_PHONES} SELECT account_id, print FROM prints"
    ),
    "g3_protect_phone": Case(
        lambda t: _phones(t).withColumn("envelope", ident.protect_phone(F.col("clean"), AES_KEY)).select(
            "account_id", ident.reveal_phone(F.col("envelope"), AES_KEY).alias("revealed"),
            ident.reveal_phone(F.col("envelope"), AES_KEY[::-1]).alias("wrong_key"),
            ident.reveal_phone(F.col("phone"), AES_KEY).alias("not_an_envelope")),
        f"WITH {CLEAN} SELECT account_id, clean AS revealed, NULL AS wrong_key, NULL AS not_an_envelope FROM numbers",
    ),
    "g4_known_logins": Case(
        lambda t: _logins(t)["known"],
        """SELECT i.id AS identity_id, i.account_id, l.appid, l.openid, max(l.login_at) AS last_login_at FROM b_logins l
           JOIN b_identities i ON i.appid = l.appid AND i.openid = l.openid GROUP BY ALL""",
    ),
    "g4_new_logins": Case(
        lambda t: _logins(t)["new_identities"],
        f"""WITH {NEW} SELECT sha256(concat_ws(chr(31), 'identity', appid, openid)) AS identity_id, sha256(concat_ws(chr(31), 'account', appid, openid)) AS account_id,
           appid, openid, last_login_at FROM fresh""",
    ),
    "g4_new_students": Case(
        lambda t: _logins(t)["new_students"],
        f"""WITH {NEW} SELECT sha256(concat_ws(chr(31), 'student', sha256(concat_ws(chr(31), 'account', appid, openid)))) AS id,
           sha256(concat_ws(chr(31), 'account', appid, openid)) AS account_id, true AS is_default, false AS profile_completed FROM fresh""",
    ),
    "g5_has_business_data": Case(_business, f"WITH {BUSINESS_SQL} SELECT * FROM business"),
    "g6_resolve_phone_bindings": Case(
        _resolved,
        f"""WITH {RESOLVED} SELECT request_id, account_id, outcome, CASE WHEN outcome IN ('owner_pending_deletion', 'merge_required', 'recovery_available') THEN owner END AS target_account_id,
             CASE WHEN outcome = 'merge_required' THEN 'AR-' || upper(substr(sha256(concat_ws(chr(31), 'conflict', account_id, owner)), 1, 12)) END AS support_reference,
             CASE WHEN outcome IN ('bound', 'recovery_available') THEN substr(clean, 1, 3) || '****' || substr(clean, 8, 4) END AS phone_masked,
             CASE WHEN outcome = 'bound' THEN print END AS phone_fingerprint FROM resolved""",
    ),
    "g7_merge_outcome": Case(
        lambda t: _merged(t)["outcome"], f"WITH {MERGED} SELECT current_account_id, target_account_id, outcome FROM judged"
    ),
    "g7_merged_accounts": Case(
        lambda t: _merged(t)["accounts"].select("id", "token_version"),
        f"""WITH {MERGED} SELECT id, CAST(token_version + CASE WHEN id IN (SELECT target_account_id FROM judged WHERE outcome = 'merged') THEN 1 ELSE 0 END AS INT) AS token_version
           FROM accounts WHERE id NOT IN (SELECT current_account_id FROM judged WHERE outcome = 'merged')""",
    ),
    "g7_merged_identities": Case(
        lambda t: _merged(t)["identities"],
        f"""WITH {MERGED} SELECT i.id, coalesce(j.target_account_id, i.account_id) AS account_id, i.appid, i.openid FROM b_member_identities i
           LEFT JOIN judged j ON j.current_account_id = i.account_id AND j.outcome = 'merged'""",
    ),
    "g7_merge_jobs": Case(
        lambda t: _merged(t)["jobs"],
        f"WITH {MERGED} SELECT 'avatar' AS storage_kind, avatar_object_key AS object_path FROM judged WHERE outcome = 'merged' AND avatar_object_key LIKE '/avatars/%'",
    ),
    "g8_profile_accounts": Case(
        lambda t: _profiles(t)["accounts"].select("id", "nickname", "profile_prompted_at", "profile_completed_at"),
        f"""WITH {UPDATED} SELECT a.id, coalesce(g.nickname, a.nickname) AS nickname, CASE WHEN a.profile_prompted_at IS NULL AND (g.nickname IS NOT NULL OR g.skip_prompt)
             THEN TIMESTAMP '{NOW}' ELSE a.profile_prompted_at END AS profile_prompted_at,
             CASE WHEN g.nickname IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE a.profile_completed_at END AS profile_completed_at
           FROM b_accounts a LEFT JOIN good g ON g.account_id = a.id""",
    ),
    "g8_profile_students": Case(
        lambda t: _profiles(t)["students"].select("id", "display_name", "grade", "semester", "profile_completed"),
        f"""WITH {UPDATED}, x AS (SELECT s.id, coalesce(g.student_name, s.display_name) AS display_name, coalesce(g.grade, s.grade) AS grade, coalesce(g.semester, s.semester) AS semester
             FROM b_students s LEFT JOIN good g ON g.account_id = s.account_id AND s.is_default)
           SELECT *, grade IS NOT NULL AND semester IS NOT NULL AS profile_completed FROM x""",
    ),
}

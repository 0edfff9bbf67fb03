from pyspark.sql import functions as F

from relearn.catalog import Case
from relearn.operators import practice as pr
from relearn.plans.grading import record_edits


def _items(t):
    return t("b_sheet_items").withColumn(
        "question_snapshot", F.struct(F.col("snapshot_source_id").alias("source_wrong_question_id"))
    )


def _graded(t):
    return pr.graded_answers(t("b_attempts"), _items(t), t("b_answers"))


def _stored_graded(t):
    return t("b_results").withColumn(
        "question_snapshot", F.struct(F.col("snapshot_source_id").alias("source_wrong_question_id"))
    ).transform(pr.source_question)


COVERAGE = """per_item AS (SELECT a.attempt_id, a.sheet_item_id, count(*) AS n FROM b_answers a GROUP BY ALL),
  verdicts AS (SELECT t.id AS attempt_id, t.sheet_id,
    CASE WHEN max(p.n) IS NULL THEN 'empty' WHEN max(p.n) > 1 THEN 'duplicate'
      WHEN count(i.id) < (SELECT count(*) FROM b_sheet_items e WHERE e.sheet_id = t.sheet_id) THEN 'missing'
      WHEN count(*) > count(i.id) THEN 'extra' ELSE 'ok' END AS verdict
    FROM b_attempts t LEFT JOIN per_item p ON p.attempt_id = t.id
    LEFT JOIN b_sheet_items i ON i.id = p.sheet_item_id AND i.sheet_id = t.sheet_id GROUP BY t.id, t.sheet_id)"""
GRADED = COVERAGE + """,
  graded AS (SELECT a.attempt_id, a.sheet_item_id, a.is_correct, i.wrong_question_id,
    coalesce(i.wrong_question_id, i.snapshot_source_id) AS source_question_id
    FROM b_answers a JOIN verdicts v ON v.attempt_id = a.attempt_id AND v.verdict = 'ok' JOIN b_sheet_items i ON i.id = a.sheet_item_id),
  groups AS (SELECT attempt_id, source_question_id, count(*) AS n_items, bool_and(is_correct) AS all_correct FROM graded GROUP BY ALL)"""

DELTAS = """SELECT wrong_question_id AS question_id, id AS seq, CAST(CASE WHEN is_correct THEN -1 ELSE id % 2 END AS INT) AS delta
  FROM b_results WHERE wrong_question_id IS NOT NULL"""

LATEST = """SELECT r.wrong_question_id AS question_id, arg_max(a.id, struct_pack(c := a.created_at, i := a.id)) AS latest_attempt_id
  FROM b_results r JOIN b_attempts a ON a.id = r.attempt_id WHERE r.wrong_question_id IS NOT NULL GROUP BY 1"""


def _history_sql(attempts, extra=""):
    return f"""SELECT question_id, count(*) FILTER (WHERE NOT ok) AS incorrect_attempt_count,
      arg_max(ok, struct_pack(c := created_at, i := attempt_id)) AS latest_all_correct,
      arg_max(completed_at, struct_pack(c := created_at, i := attempt_id)) AS latest_completed_at
      FROM (SELECT r.wrong_question_id AS question_id, r.attempt_id, a.created_at, a.completed_at, bool_and(r.is_correct) AS ok
        FROM b_results r JOIN {attempts} a ON a.id = r.attempt_id WHERE r.wrong_question_id IS NOT NULL {extra} GROUP BY ALL) x GROUP BY 1"""


def _mastery(t):
    attempts = t("b_attempts")
    recorded = attempts.filter("attempt_no > 2")
    groups = pr.group_results(_stored_graded(t)).join(
        recorded.select(F.col("id").alias("attempt_id")), "attempt_id", "left_semi")
    return pr.mastery_state(
        t("b_practised"), recorded, groups, pr.latest_attempt_by_question(attempts, t("b_results")))


def _edits(t):
    attempts = t("b_attempts")
    edits = attempts.select(
        F.col("id").alias("attempt_id"),
        F.when(F.col("accuracy") > 0, F.col("updated_at"))
        .otherwise(F.expr("updated_at - interval 1 second")).alias("updated_at"))
    answers = t("b_answers").withColumn("is_correct", ~F.col("is_correct"))
    return pr.edit_attempts(attempts, _items(t), t("b_results"), edits, answers)


EDIT_SQL = """flipped AS (SELECT attempt_id, sheet_item_id, NOT is_correct AS is_correct FROM b_answers),
  per_item AS (SELECT a.attempt_id, a.sheet_item_id, count(*) AS n FROM b_answers a GROUP BY ALL),
  cover AS (SELECT t.id AS attempt_id,
    CASE WHEN max(p.n) IS NULL THEN 'empty' WHEN max(p.n) > 1 THEN 'duplicate' WHEN count(i.id) < 3 THEN 'missing'
      WHEN count(*) > count(i.id) THEN 'extra' ELSE 'ok' END AS verdict
    FROM b_attempts t LEFT JOIN per_item p ON p.attempt_id = t.id
    LEFT JOIN b_sheet_items i ON i.id = p.sheet_item_id AND i.sheet_id = t.sheet_id GROUP BY t.id),
  verdicts AS (SELECT t.id AS attempt_id, CASE WHEN t.accuracy = 0
    OR t.attempt_no < (SELECT max(o.attempt_no) FROM b_attempts o WHERE o.sheet_id = t.sheet_id) THEN 'conflict'
    WHEN c.verdict <> 'ok' THEN c.verdict ELSE 'accepted' END AS verdict FROM b_attempts t JOIN cover c ON c.attempt_id = t.id)"""


def _recorded_edits(t):
    attempts = t("b_attempts").withColumns({"correct_count": F.lit(0), "total_count": F.lit(0)})
    edits = attempts.select(
        F.col("id").alias("attempt_id"), (F.col("student_id") + F.when(F.col("id") % 13 == 0, 1).otherwise(0)).alias("student_id"),
        F.when(F.col("accuracy") > 0, F.col("updated_at")).otherwise(F.expr("updated_at - interval 1 second")).alias("updated_at"))
    answers = t("b_answers").withColumn("is_correct", ~F.col("is_correct"))
    return record_edits(
        edits, answers, t("b_sheets"), _items(t), attempts, t("b_results"), t("b_practised"), EDITED_AT)


EDITED_AT = "2024-06-01 00:00:00"
RECORDED_EDITS = f"""{EDIT_SQL}, told AS (SELECT v.attempt_id, CASE WHEN v.attempt_id % 13 = 0 THEN 'sheet_not_found'
    WHEN s.generation_status <> 'completed' THEN 'sheet_not_ready' ELSE v.verdict END AS verdict
    FROM verdicts v JOIN b_attempts a ON a.id = v.attempt_id JOIN b_sheets s ON s.id = a.sheet_id),
  taken AS (SELECT attempt_id FROM told WHERE verdict = 'accepted')"""


def _reconciled(t):
    doomed = t("b_sheets").filter("student_id % 2 = 0").select("id")
    return pr.reconcile_deleted_sheets(
        doomed, t("b_sheets"), t("b_sheet_items"), t("b_attempts"), t("b_results"), t("b_practised"))


DOOMED = """doomed AS (SELECT * FROM b_sheets WHERE student_id % 2 = 0 AND generation_status IN ('completed', 'failed')),
  gone AS (SELECT a.*, d.student_id AS owner_id FROM b_attempts a JOIN doomed d ON d.id = a.sheet_id),
  kept AS (SELECT * FROM b_attempts WHERE sheet_id NOT IN (SELECT id FROM doomed))"""

CASES = {
    "c1_source_question": Case(
        lambda t: pr.source_question(_items(t)).select("id", "source_question_id"),
        "SELECT id, coalesce(wrong_question_id, snapshot_source_id) AS source_question_id FROM b_sheet_items",
    ),
    "c2_answer_coverage": Case(
        lambda t: pr.answer_coverage(t("b_attempts"), _items(t), t("b_answers")),
        f"WITH {COVERAGE} SELECT * FROM verdicts",
    ),
    "c3_group_results": Case(
        lambda t: pr.group_results(_graded(t)), f"WITH {GRADED} SELECT * FROM groups"
    ),
    "c4_attempt_summary": Case(
        lambda t: pr.attempt_summary(_graded(t)),
        f"""WITH {GRADED} SELECT attempt_id, count(*) FILTER (WHERE is_correct) AS correct_count, count(*) AS total_count,
          CAST(round(count(*) FILTER (WHERE is_correct) / count(*), 4) AS DECIMAL(5,4)) AS accuracy FROM graded GROUP BY attempt_id""",
    ),
    "c5_number_attempts": Case(
        lambda t: pr.number_attempts(
            t("b_attempts").filter("attempt_no > 1").drop("attempt_no"), t("b_attempts").filter("attempt_no = 1"))
        .select("id", "sheet_id", "attempt_no"),
        """SELECT id, sheet_id, CAST(1 + row_number() OVER (PARTITION BY sheet_id ORDER BY created_at, id) AS INT) AS attempt_no
           FROM b_attempts WHERE attempt_no > 1""",
    ),
    "c6_dedup_attempts": Case(
        lambda t: pr.dedup_attempts(
            t("b_attempts").filter("attempt_no > 1"),
            pr.first_per_key(t("b_attempts").filter("attempt_no = 1"), ["student_id", "idempotency_key"]))
        .select("id", "sheet_id", "owner_id", "verdict"),
        """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY student_id, idempotency_key
             ORDER BY CASE WHEN attempt_no = 1 THEN 0 ELSE 1 END, created_at, id) AS rn FROM b_attempts)
           SELECT n.id, n.sheet_id, o.id AS owner_id, CASE WHEN n.id = o.id THEN 'accepted' WHEN n.sheet_id = o.sheet_id THEN 'replay'
             ELSE 'conflict' END AS verdict
           FROM ranked n JOIN ranked o ON o.student_id = n.student_id AND o.idempotency_key = n.idempotency_key AND o.rn = 1
           WHERE n.attempt_no > 1""",
    ),
    "c7_build_results": Case(
        lambda t: pr.build_results(_graded(t), pr.group_results(_graded(t))).drop("question_snapshot"),
        f"""WITH {GRADED} SELECT g.attempt_id, g.sheet_item_id, g.wrong_question_id, g.is_correct,
          CAST(coalesce(s.n_items - 1, 0) AS INT) AS derived_count FROM graded g LEFT JOIN groups s ON s.attempt_id = g.attempt_id
          AND s.source_question_id IS NOT DISTINCT FROM g.wrong_question_id""",
    ),
    "c8_wrong_count_delta": Case(
        lambda t: t.sql(
            "SELECT r.id, p.is_correct AS prev, r.is_correct AS next FROM b_results r LEFT JOIN b_results p ON p.id = r.id - 1"
        ).select("id", pr.wrong_count_delta(F.col("prev"), F.col("next")).alias("delta")),
        """SELECT r.id, CASE WHEN p.is_correct IS NULL THEN CASE WHEN r.is_correct THEN 0 ELSE 1 END
             ELSE CAST(p.is_correct AS INT) - CAST(r.is_correct AS INT) END AS delta
           FROM b_results r LEFT JOIN b_results p ON p.id = r.id - 1""",
    ),
    "c9_apply_wrong_count": Case(
        lambda t: pr.apply_wrong_count(t("b_practised"), t.sql(DELTAS)),
        f"""SELECT d.question_id, d.seq, d.delta, list_reduce(list(d.delta) OVER (PARTITION BY d.question_id ORDER BY d.seq),
             lambda a, b: greatest(1, a + b), CASE WHEN q.wrong_count = 0 THEN 1 ELSE q.wrong_count END) AS wrong_count
           FROM ({DELTAS}) d JOIN b_practised q ON q.id = d.question_id""",
    ),
    "c10_latest_attempt_by_question": Case(
        lambda t: pr.latest_attempt_by_question(t("b_attempts"), t("b_results")), LATEST
    ),
    "c11_mastery_state": Case(
        _mastery,
        f"""WITH g AS (SELECT r.attempt_id, coalesce(r.wrong_question_id, r.snapshot_source_id) AS q, bool_and(r.is_correct) AS ok
             FROM b_results r GROUP BY ALL), latest AS ({LATEST}),
           x AS (SELECT g.q, a.student_id, g.ok, a.completed_at, a.id = l.latest_attempt_id AS is_last FROM g
             JOIN b_attempts a ON a.id = g.attempt_id AND a.attempt_no > 2 LEFT JOIN latest l ON l.question_id = g.q WHERE g.q IS NOT NULL)
           SELECT p.id, CAST(CASE WHEN p.wrong_count = 0 THEN 1 ELSE p.wrong_count END + count(*) FILTER (WHERE NOT x.ok) AS INT) AS wrong_count,
             CASE WHEN bool_or(x.is_last) THEN CASE WHEN bool_or(x.is_last AND x.ok) THEN 'mastered' ELSE 'learning' END ELSE p.mastery_status END AS mastery_status,
             CASE WHEN bool_or(x.is_last) THEN max(x.completed_at) FILTER (WHERE x.is_last AND x.ok) ELSE p.mastered_at END AS mastered_at,
             CASE WHEN bool_or(x.is_last) THEN max(x.completed_at) FILTER (WHERE x.is_last) ELSE p.last_practiced_at END AS last_practiced_at
           FROM b_practised p JOIN x ON x.q = p.id AND x.student_id = p.student_id WHERE p.deleted_at IS NULL
           GROUP BY p.id, p.wrong_count, p.mastery_status, p.mastered_at, p.last_practiced_at""",
    ),
    "c12_edit_verdicts": Case(lambda t: _edits(t)["verdicts"], f"WITH {EDIT_SQL} SELECT * FROM verdicts"),
    "c12_edit_summaries": Case(
        lambda t: _edits(t)["summaries"],
        f"""WITH {EDIT_SQL} SELECT f.attempt_id, count(*) FILTER (WHERE f.is_correct) AS correct_count, count(*) AS total_count,
          CAST(round(count(*) FILTER (WHERE f.is_correct) / count(*), 4) AS DECIMAL(5,4)) AS accuracy
          FROM flipped f JOIN verdicts v ON v.attempt_id = f.attempt_id AND v.verdict = 'accepted' GROUP BY 1""",
    ),
    "c12_edit_groups": Case(
        lambda t: _edits(t)["groups"],
        f"""WITH {EDIT_SQL} SELECT r.attempt_id, coalesce(r.wrong_question_id, r.snapshot_source_id) AS source_question_id, count(*) AS n_items,
          bool_and(f.is_correct) AS all_correct, bool_and(r.is_correct) AS previous_correct,
          CAST(bool_and(r.is_correct) AS INT) - CAST(bool_and(f.is_correct) AS INT) AS delta
          FROM b_results r JOIN verdicts v ON v.attempt_id = r.attempt_id AND v.verdict = 'accepted'
          JOIN flipped f ON f.attempt_id = r.attempt_id AND f.sheet_item_id = r.sheet_item_id GROUP BY 1, 2""",
    ),
    "c12_recorded_verdicts": Case(
        lambda t: _recorded_edits(t)["verdicts"], f"WITH {RECORDED_EDITS} SELECT * FROM told"),
    "c12_edit_attempts": Case(
        lambda t: _recorded_edits(t)["attempts"].select("id", "attempt_no", "correct_count", "total_count", "accuracy", "updated_at"),
        f"""WITH {RECORDED_EDITS} SELECT a.id, a.attempt_no, CAST(count(*) FILTER (WHERE f.is_correct) AS INT) AS correct_count, CAST(count(*) AS INT) AS total_count,
          CAST(round(count(*) FILTER (WHERE f.is_correct) / count(*), 4) AS DECIMAL(5,4)) AS accuracy, TIMESTAMP '{EDITED_AT}' AS updated_at
          FROM b_attempts a JOIN taken k ON k.attempt_id = a.id JOIN flipped f ON f.attempt_id = a.id GROUP BY a.id, a.attempt_no""",
    ),
    "c12_edit_results": Case(
        lambda t: _recorded_edits(t)["results"].select("id", "attempt_id", "sheet_item_id", "wrong_question_id", "is_correct"),
        f"""WITH {RECORDED_EDITS} SELECT r.id, r.attempt_id, r.sheet_item_id, r.wrong_question_id, f.is_correct FROM b_results r
          JOIN taken k ON k.attempt_id = r.attempt_id JOIN flipped f ON f.attempt_id = r.attempt_id AND f.sheet_item_id = r.sheet_item_id""",
    ),
    "c12_edit_updates": Case(
        lambda t: _recorded_edits(t)["updates"],
        f"""WITH {RECORDED_EDITS}, latest AS ({LATEST}), g AS (SELECT r.attempt_id, coalesce(r.wrong_question_id, r.snapshot_source_id) AS q,
             bool_and(f.is_correct) AS ok, CAST(bool_and(r.is_correct) AS INT) - CAST(bool_and(f.is_correct) AS INT) AS delta
             FROM b_results r JOIN taken k ON k.attempt_id = r.attempt_id JOIN flipped f ON f.attempt_id = r.attempt_id AND f.sheet_item_id = r.sheet_item_id GROUP BY 1, 2),
           x AS (SELECT g.q, a.student_id, g.ok, g.delta, a.completed_at, coalesce(a.id = l.latest_attempt_id, false) AS is_last FROM g
             JOIN b_attempts a ON a.id = g.attempt_id LEFT JOIN latest l ON l.question_id = g.q WHERE g.q IS NOT NULL)
           SELECT p.id, CAST(greatest(1, CASE WHEN p.wrong_count = 0 THEN 1 ELSE p.wrong_count END + sum(x.delta)) AS INT) AS wrong_count,
             CASE WHEN bool_or(x.is_last) THEN CASE WHEN bool_or(x.is_last AND x.ok) THEN 'mastered' ELSE 'learning' END ELSE p.mastery_status END AS mastery_status,
             CASE WHEN bool_or(x.is_last) THEN max(x.completed_at) FILTER (WHERE x.is_last AND x.ok) ELSE p.mastered_at END AS mastered_at,
             CASE WHEN bool_or(x.is_last) THEN max(x.completed_at) FILTER (WHERE x.is_last) ELSE p.last_practiced_at END AS last_practiced_at
           FROM b_practised p JOIN x ON x.q = p.id AND x.student_id = p.student_id WHERE p.deleted_at IS NULL
           GROUP BY p.id, p.wrong_count, p.mastery_status, p.mastered_at, p.last_practiced_at""",
    ),
    "c13_question_history": Case(
        lambda t: pr.question_history(t("b_attempts"), t("b_results")), _history_sql("b_attempts")
    ),
    "c14_reconcile_updates": Case(
        lambda t: _reconciled(t)["updates"],
        f"""WITH {DOOMED}, lost AS (SELECT q, owner_id, count(*) FILTER (WHERE NOT ok) AS n FROM (
             SELECT r.wrong_question_id AS q, r.attempt_id, g.owner_id, bool_and(r.is_correct) AS ok FROM b_results r
             JOIN gone g ON g.id = r.attempt_id WHERE r.wrong_question_id IS NOT NULL GROUP BY ALL) y GROUP BY ALL),
           remaining AS ({_history_sql('kept')})
           SELECT p.id, CAST(greatest(1, CASE WHEN p.wrong_count = 0 THEN 1 ELSE p.wrong_count END - l.n) AS INT) AS wrong_count,
             CASE WHEN h.latest_all_correct THEN 'mastered' ELSE 'learning' END AS mastery_status,
             CASE WHEN h.latest_all_correct THEN h.latest_completed_at END AS mastered_at, h.latest_completed_at AS last_practiced_at
           FROM b_practised p JOIN lost l ON l.q = p.id AND l.owner_id = p.student_id LEFT JOIN remaining h ON h.question_id = p.id""",
    ),
    "c14_reconcile_survivors": Case(
        lambda t: (lambda r: r["sheets"].select(F.lit("sheets").alias("kind"), "id")
                   .union(r["items"].select(F.lit("items"), "id"))
                   .union(r["attempts"].select(F.lit("attempts"), "id"))
                   .union(r["results"].select(F.lit("results"), "id"))
                   .union(r["refused"].select(F.lit("refused"), "id")))(_reconciled(t)),
        f"""WITH {DOOMED} SELECT 'sheets' AS kind, id FROM b_sheets WHERE id NOT IN (SELECT id FROM doomed)
           UNION ALL SELECT 'items', id FROM b_sheet_items WHERE sheet_id NOT IN (SELECT id FROM doomed)
           UNION ALL SELECT 'attempts', id FROM kept UNION ALL SELECT 'results', id FROM b_results WHERE attempt_id IN (SELECT id FROM kept)
           UNION ALL SELECT 'refused', id FROM b_sheets WHERE student_id % 2 = 0 AND generation_status NOT IN ('completed', 'failed')""",
    ),
    "c14_reconcile_jobs": Case(
        lambda t: _reconciled(t)["jobs"],
        f"WITH {DOOMED} SELECT 'pdf' AS storage_kind, pdf_url AS object_path FROM doomed WHERE pdf_url IS NOT NULL",
    ),
}

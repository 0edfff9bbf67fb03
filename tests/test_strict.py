"""Documents against declared shapes, path by path; big integers; the localization and derivative readers."""

import json

import pytest
from pyspark.sql import functions as F

from relearn.functions import strict
from relearn.operators import recognition as rec
from relearn.operators import sheets as sh

SHAPE = strict.record(
    {
        "name": strict.text(blank=False),
        "level": strict.optional(strict.whole(0), null=True),
        "share": strict.number(0, 1),
        "on": strict.truth(),
        "parts": strict.listed(strict.record({"kind": strict.text(choices=["a", "b"]), "n": strict.optional(strict.listed(strict.whole()))}), least=1),
    },
    lambda v: F.try_variant_get(v, "$.on", "boolean") | (F.try_variant_get(v, "$.share", "double") > 0),
)
GOOD = {"name": "x", "level": 3, "share": 0.5, "on": True, "parts": [{"kind": "a"}]}


@pytest.mark.parametrize(
    "text, bad",
    [
        (json.dumps(GOOD), []),
        (json.dumps(GOOD | {"level": None, "share": 1}), []),
        (json.dumps(GOOD | {"level": 10**25}), []),
        (json.dumps(GOOD | {"level": -(10**25)}), ["level"]),
        (json.dumps(GOOD | {"level": 3.0}), ["level"]),
        (json.dumps(GOOD | {"level": True}), ["level"]),
        (json.dumps(GOOD | {"level": "3"}), ["level"]),
        (json.dumps(GOOD | {"name": " \n"}), ["name"]),
        (json.dumps(GOOD | {"name": None}), ["name"]),
        (json.dumps(GOOD | {"share": 1.01}), ["share"]),
        (json.dumps(GOOD | {"share": "1"}), ["share"]),
        (json.dumps(GOOD | {"on": 1}), ["on"]),
        (json.dumps({k: v for k, v in GOOD.items() if k not in ("name", "level", "on")}), ["name", "on"]),
        (json.dumps(GOOD | {"z": 1, "c": 2, "share": -1}), ["share", "z", "c"]),
        (json.dumps(GOOD | {"parts": []}), ["parts"]),
        (json.dumps(GOOD | {"parts": {}}), ["parts"]),
        (json.dumps(GOOD | {"parts": [1, None, {"kind": "c", "n": [1, "2", None, 3]}, {"kind": "b", "q": {"r": 1}}]}),
         ["parts.0", "parts.1", "parts.2.kind", "parts.2.n.1", "parts.2.n.2", "parts.3.q"]),
        (json.dumps(GOOD | {"on": False, "share": 0}), [""]),
        (json.dumps([GOOD]), [""]),
        ("{", [""]),
        ("", [""]),
        (None, [""]),
    ],
)
def test_faults(spark, text, bad):
    found = spark.createDataFrame([(text,)], "doc string").select(strict.faults(F.col("doc"), SHAPE).alias("f")).first().f
    assert found == bad


def test_big_difficulty_is_clamped(spark):
    item = {"raw_text": "r", "instruction": "i", "prompt_text": "p", "subject": "math", "question_type": "other", "confidence": 1}
    rows = [(json.dumps({"items": [item | {"difficulty": d}]}),) for d in (10**20, -(10**30), 4, 2**63)]
    checked = rec.validate_items(spark.createDataFrame(rows, "payload_json string"))
    assert [r.valid for r in checked.collect()] == [True] * 4
    assert [r.difficulty for r in rec.recognized_items(checked, keep=()).collect()] == [5, 1, 4, 5]


def place(index, matched=True, **more):
    return {"index": index, "matched": matched, "confidence": 0.9} | ({"bbox": [0.1, 0.1, 0.5, 0.5]} if matched else {}) | more


def test_localization_documents(spark):
    cases = {
        1: ([place(0, mark_ids=[7]), place(1, False)], None, []),
        2: ([place(0, mark_ids=[7]), place(1, False, bbox=None, observed_raw_text=None)], None, []),
        3: ([place(0, mark_ids=[7]), place(1, False, bbox=[0, 0, 1, 1])], "schema_invalid", ["items.1"]),
        4: ([place(0, mark_ids=[7]), place(1, bbox=[0, 0, 1, 1.1])], "schema_invalid", ["items.1.bbox"]),
        5: ([place(0, mark_ids=[7]), place(1, False, mark_ids=[8])], "schema_invalid", ["items.1"]),
        6: ([place(0, mark_ids=[7]), place(1, False, observed_raw_text="x")], "schema_invalid", ["items.1"]),
        7: ([place(0, mark_ids=[7])], "index_count_mismatch", []),
        8: ([place(0, mark_ids=[7]), place(0)], "index_count_mismatch", []),
        9: ([place(0, mark_ids=[7]), place(2)], "index_set_mismatch", []),
        10: ([place(0, mark_ids=[7]), place(1, mark_ids=[7])], "duplicate_mark_assignment", []),
        11: ([place(0, mark_ids=[7, 7]), place(1)], "duplicate_mark_assignment", []),
        12: ([place(0), place(1)], "unassigned_mark", []),
        13: ([place(0, mark_ids=[7, 8]), place(1)], "unassigned_mark", []),
        14: ([place(-1), place(1)], "schema_invalid", ["items.0.index"]),
    }
    docs = spark.createDataFrame([(i, json.dumps({"items": x})) for i, (x, *_) in cases.items()] + [(15, None)], "image_id long, payload_json string")
    items = spark.createDataFrame([(i, k) for i in [*cases, 15] for k in (0, 1)], "image_id long, idx int")
    marks = spark.createDataFrame([(i, 7) for i in [*cases, 15]], "image_id long, mark_id int")
    out = rec.parse_localizations(docs, items, marks)
    found = {r.image_id: (r.reason, r.bad_fields) for r in out["verdicts"].collect()}
    assert found == {i: (reason, bad) for i, (_, reason, bad) in cases.items()} | {15: ("schema_invalid", [""])}
    assert {(r.image_id, r.idx) for r in out["localizations"].collect()} == {(i, k) for i in (1, 2) for k in (0, 1)}


def test_derivative_documents(spark):
    one = lambda n: {"instruction": "do", "prompt_text": f"p{n}", "question_type": "other", "answer": "a"}
    source = lambda i, *v: {"source_id": i, "variants": list(v)}
    cases = {
        1: ([source("x", one(1)), source("y", one(2))], "ok"),
        2: ([source("x", one(1)), source("x", one(3)), source("y", one(2))], "duplicate_source"),
        3: ([source("x", one(1))], "source_mismatch"),
        4: ([source("x", one(1)), source("y", one(2)), source("z", one(2))], "source_mismatch"),
        5: ([source("x", one(1)), source("y")], "count_invalid"),
        6: ([source("x", one(1)), source("y", one(0))], "duplicate_question"),
        7: ([source("x", one(1) | {"answer": " "}), source("y", one(2))], "invalid_fields"),
        8: ([source("x", one(1)), source(5, one(2))], "invalid_fields"),
        9: ([], "source_mismatch"),
        10: ([source("x", one(1) | {"more": 1}), source("y", one(2))], "invalid_fields"),
    }
    docs = spark.createDataFrame([(i, json.dumps({"items": x})) for i, (x, _) in cases.items()], "batch_id long, payload_json string")
    asked = spark.createDataFrame([(i, s, "do", "p0", "other") for i in cases for s in "xy"], "batch_id long, source_id string, instruction string, prompt_text string, question_type string")
    out = sh.parse_payloads(asked, docs, 1)
    assert {r.batch_id: r.verdict for r in out["verdicts"].collect()} == {i: v for i, (_, v) in cases.items()}
    assert sorted((r.batch_id, r.source_id, r.prompt_text) for r in out["variants"].collect()) == [(1, "x", "p1"), (1, "y", "p2")]

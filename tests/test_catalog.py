"""Every registered query against its SQL check, on the smallest data, and without cross products."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import compare as checker  # noqa: E402
from conftest import DATA  # noqa: E402

from relearn import catalog  # noqa: E402

QUERIES = catalog.queries()
CHECKS = catalog.oracle_sql()
# So few rows that no case of the rule occurs.
MAY_BE_EMPTY = {"g7_merge_jobs", "g7_merge_outcome"}


@pytest.fixture(scope="module")
def engine():
    return checker.connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_check(spark, engine, name):
    df = QUERIES[name](spark, DATA)
    problem = checker.compare(name, df, engine, CHECKS.get(name))
    if problem == "no rows" and name in MAY_BE_EMPTY:
        problem = None
    assert problem is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_checks_name_registered_queries():
    assert set(CHECKS) <= set(QUERIES)

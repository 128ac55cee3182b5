"""Every registered signal query against its SQL on the smallest tables."""

import duckdb
import pytest

from tests.conftest import same
from wavetable.operators import match
from wavetable.plans.queries import QUERIES, oracle

ORACLE = oracle()
FAST = [q for q in QUERIES if q in ORACLE]


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, duck, sf, name):
    same(QUERIES[name](spark, sf), duck.sql(ORACLE[name]))


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLE])
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def most_rows(df):
    """The most rows that one operator of the plan gave."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        todo += [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
        todo += [plan.children().apply(n) for n in range(plan.children().size())]
        rows = plan.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
    return most


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Events of one user group, all within an hour, some at one time: a folder, their number, and DuckDB with them."""
    folder, n = tmp_path_factory.mktemp("crowded"), 1500
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"CREATE TABLE events AS SELECT n AS event_id, TIMESTAMP '2024-01-05 23:30:00' + to_milliseconds(hash(n % 1400) % 3500000) AS ts, 10 * (n // 2 % 3) AS user_id, ['purchase', 'error'][n % 2 + 1] AS event_type, 1.0::DOUBLE AS value FROM range({n}) t(n)")
    con.sql(f"COPY events TO '{folder}/events.parquet'")
    return str(folder), n, con


@pytest.mark.parametrize("name", ["repaired_picks", "picks_full_match", "picks_aligned", "picks_scores", "picks_pairs"])
def test_crowded_picks_make_no_rows_for_all_pairs(spark, crowded, name):
    folder, n, con = crowded
    out = QUERIES[name](spark, folder)
    assert most_rows(out) <= 4 * n
    same(out, con.sql(ORACLE[name]))


def test_crowded_association_makes_no_rows_for_all_pairs(spark, crowded, monkeypatch):
    folder, n, con = crowded
    steps, stable = [], match.stable
    monkeypatch.setattr(match, "stable", lambda df: steps.append(df) or stable(df))
    same(QUERIES["association_votes"](spark, folder), con.sql(ORACLE["association_votes"]))
    assert steps and max(map(most_rows, steps)) <= 4 * n


def rows_in_all(df):
    """The rows that the plan's operators gave, together; an exchange that is reused counts once."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        todo += [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
        todo += [plan.children().apply(n) for n in range(plan.children().size())]
        rows = plan.metrics().get("numOutputRows")
        total += rows.get().value() if rows.isDefined() else 0
    return total


@pytest.mark.parametrize("name", ["picks_aligned", "picks_scores"])
def test_rows_of_picks_grow_as_copies_of_events(spark, crowded, tmp_path, name):
    made = []
    for copies in (1, 3):
        con, folder = duckdb.connect(), tmp_path / str(copies)
        folder.mkdir()
        con.sql("SET timezone = 'UTC'")
        con.sql(f"CREATE TABLE events AS SELECT event_id + 10000 * c AS event_id, ts + to_milliseconds(7130 * (c // 2)) AS ts, user_id + 30 * c AS user_id, event_type, value FROM '{crowded[0]}/events.parquet', range({copies}) r(c)")
        con.sql(f"COPY events TO '{folder}/events.parquet'")
        out = QUERIES[name](spark, str(folder))
        made.append(rows_in_all(out))
    same(out, con.sql(ORACLE[name]))
    assert 0 < made[1] <= 3.5 * made[0]

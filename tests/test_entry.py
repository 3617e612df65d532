"""Driver contract and plan-shape checks."""

import re

from servebench.plans.catalog import oracle_sql, queries


def test_entry_runs(spark):
    import __spark_entry__ as E

    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0].total_requests >= 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_in_flight_window_is_partitioned(spark):
    from conftest import SF001
    from servebench.operators import timeline as TL
    from servebench.sources import standins as S

    plan = _plan(TL.in_flight(S.requests_df(spark, SF001)))
    # the window over raw deltas is partitioned by slot
    assert "Window [" in plan and "_slot" in plan


def test_projection_pruned_at_scan(spark):
    from conftest import SF001
    from servebench.plans.q_analytics import q_run_summary

    plan = _plan(q_run_summary(spark, SF001))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas
    for schema in schemas:
        assert {c.split(":")[0] for c in schema.split(",")} <= {"ts", "user_id", "event_type", "value", "props"}


def test_registry_imports_without_spark():
    """oracle_sql() must work in a process with no Spark session."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import __spark_entry__ as E; from servebench.plans import catalog as C; "
            "print(len(C.oracle_sql()), len(C.queries())); assert set(E.oracle_sql()) <= set(E.queries())")
    out = subprocess.run([sys.executable, "-c", code], cwd="/tmp", capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": root}, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n_oracle, n_queries = map(int, out.stdout.split())
    assert n_oracle == n_queries


# Queries whose unpartitioned windows run over tables bounded by the run
# length (per-slot offsets, 1 s ticks, hourly slots) or by the <= 7 category
# shares of a request plan.
BOUNDED_WINDOW_QUERIES = {"concurrency_samples", "concurrency_series", "effective_concurrency", "in_flight",
                          "live_in_flight", "peak_concurrency", "request_plan", "summary_cards", "run_report"}


def test_plan_shapes_of_all_queries(spark):
    """No nested-loop join or cartesian product anywhere; windows without a
    partition only where the windowed table is bounded by design."""
    import importlib.util
    import os

    from conftest import SF001

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.spec_from_file_location("plan_report", os.path.join(root, "scripts", "plan_report.py"))
    pr = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pr)
    offenders = []
    for name, fn in sorted(queries().items()):
        s = pr.summarize(_plan(fn(spark, SF001)))
        if s.get("nested-loop join") or s.get("cartesian product"):
            offenders.append((name, "join"))
        if s.get("window without partition, other") and name not in BOUNDED_WINDOW_QUERIES:
            offenders.append((name, "window"))
    assert offenders == []

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import DQConfig, dq_config
from ledgerloom.functions.scan import exact_quantiles, running, with_rank, with_sequence
from ledgerloom.operators import quality as Q

AS_OF = datetime(2026, 9, 1)


def failing(spark, check, rows, schema, tables=None):
    """(failing count, failing ids, warning) of one check."""
    cfg = DQConfig({"d": {"table": "d", "id_field": "id", "checks": [{"type": "accuracy", "name": "c", **check}]}})
    tables = {**(tables or {}), "d": spark.createDataFrame(rows, schema)}
    run = Q.flag_dataset("d", cfg, tables.__getitem__, AS_OF)
    result = Q.check_results(run, AS_OF).first()
    ids = sorted(r["_id"] for r in Q.failing_rows(run).collect()) if run.checks[0].failing is not None else []
    return result.failing_records, ids, result.warning


def test_completeness(spark):
    rows = [("1", "a"), ("2", None), ("3", "  \t"), ("4", "")]
    check = {"type": "completeness", "field": "v"}
    assert failing(spark, check, rows, "id string, v string")[:2] == (3, ["2", "3", "4"])
    assert failing(spark, {"type": "completeness", "expected_count": 4}, rows, "id string, v string")[0] == 0
    assert failing(spark, {"type": "completeness", "expected_count": 5}, rows, "id string, v string")[0] == 4


def test_range_and_enum(spark):
    rows = [("1", "0"), ("2", "-0.01"), ("3", "x"), ("4", None), ("5", "10"), ("6", "10.5")]
    check = {"rule": "range", "field": "v", "min": 0, "maximum": 10}
    assert failing(spark, check, rows, "id string, v string")[1] == ["2", "3", "4", "6"]
    enum = {"rule": "enum", "field": "v", "values": ["0", 10]}
    assert failing(spark, enum, rows, "id string, v string")[1] == ["2", "3", "6"]


def test_referential_ignores_null_keys(spark):
    parents = spark.createDataFrame([("A",), (None,)], "pid string")
    cfg = DQConfig({
        "p": {"table": "parents", "checks": []},
        "d": {"table": "d", "id_field": "id", "checks": [
            {"type": "accuracy", "rule": "referential", "name": "r", "field": "k", "reference_dataset": "p", "reference_field": "pid"}]},
    })
    child = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", None), ("4", "B")], "id string, k string")
    run = Q.flag_dataset("d", cfg, {"parents": parents, "d": child}.__getitem__, AS_OF)
    assert Q.check_results(run, AS_OF).first().failing_records == 2
    assert sorted(r["_id"] for r in Q.failing_rows(run).collect()) == ["2", "4"]


def test_consistency_leaves_loans_out(spark):
    schema = "id string, account_type string, available_balance double, current_balance double"
    rows = [("1", "loan", 9.0, 1.0), ("2", "checking", 9.0, 1.0), ("3", None, 9.0, 1.0), ("4", "checking", None, 1.0), ("5", "savings", 1.0, 1.0)]
    check = {"type": "consistency", "rule": "available_le_current"}
    assert failing(spark, check, rows, schema)[1] == ["2", "3"]
    assert failing(spark, {"type": "consistency", "rule": "novel"}, rows, schema) == (0, [], "unknown rule novel")


def test_staleness(spark):
    rows = [("1", "2026-08-02"), ("2", "2026-08-01 23:59:59"), ("3", None), ("4", "soon"), ("5", "2026-07-31 00:00:00")]
    check = {"type": "timeliness", "field": "v", "max_age_days": 30}
    assert failing(spark, check, rows, "id string, v string")[1] == ["5"]


def test_anomalies(spark):
    rows = [(f"{i:03d}", 100.0) for i in range(100)] + [("x", 10000.0), ("y", None)]
    check = {"type": "anomaly", "field": "v", "route_failures": True}
    assert failing(spark, check, rows, "id string, v double")[:2] == (1, ["x"])
    flat = [(str(i), 5.0) for i in range(9)]
    assert failing(spark, check, flat, "id string, v double")[0] == 0
    values = [(str(i), float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 100])]
    iqr = {"type": "anomaly", "rule": "iqr", "field": "v", "route_failures": True}
    assert failing(spark, iqr, values, "id string, v double")[1] == ["7"]
    assert failing(spark, iqr, values[:3], "id string, v double")[0] == 0


def test_missing_field_passes_with_a_warning(spark):
    got = failing(spark, {"type": "completeness", "field": "gone"}, [("1",)], "id string")
    assert got == (0, [], "no column gone")


def test_unknown_rule_is_an_error(spark):
    with pytest.raises(ValueError):
        failing(spark, {"type": "accuracy", "rule": "novel", "field": "id"}, [("1",)], "id string")


def test_check_score(spark):
    pairs = spark.createDataFrame([(100, 5), (0, 0), (10, 20)], "n int, f int")
    assert [r.s for r in pairs.select(Q.check_score(F.col("n"), F.col("f")).alias("s")).collect()] == [95.0, 100.0, 0.0]


def test_dataset_scores(spark):
    rows = [("d", "completeness", 100.0), ("d", "completeness", 80.0), ("d", "anomaly", 50.0), ("e", "anomaly", 95.0), ("e", "anomaly", 85.0)]
    df = spark.createDataFrame(rows, "dataset_name string, check_type string, quality_score double")
    even = {r.dataset_name: r for r in Q.dataset_scores(df, {}).collect()}
    assert even["d"].quality_score == 70.0 and even["e"].anomaly_rate == 10.0
    apart = {r.dataset_name: r for r in Q.dataset_scores(df, {"anomaly": 0.0}).collect()}
    assert apart["d"].quality_score == 90.0 and apart["e"].quality_score == 100.0


def test_caps_numbers_and_events(spark):
    tx = spark.createDataFrame(
        [(f"T{i:03d}", None if i < 40 else "r", -1.0 if i % 2 else 1.0) for i in range(60)], "id string, ref string, amount double"
    )
    cfg = DQConfig({"t": {"table": "t", "id_field": "id", "checks": [
        {"type": "completeness", "name": "refs", "field": "ref", "severity": "high"},
        {"type": "accuracy", "rule": "range", "name": "amounts", "field": "amount", "min": 0, "severity": "odd"},
        {"type": "accuracy", "rule": "range", "name": "quiet", "field": "amount", "min": 0, "route_failures": False},
    ]}}, {}, 25)
    run = Q.run_quality(cfg, {"t": tx}.__getitem__, AS_OF, "B")
    assert [(r.failing_records, r.withheld) for r in run.results.orderBy("dq_check_id").collect()] == [(40, 15), (30, 5), (30, 0)]
    exc = run.exceptions.orderBy("exception_id").collect()
    assert len(exc) == 50 and exc[0].exception_id == "EXC-B-000001" and exc[0].reference_id == "t:T000"
    assert {e.priority for e in exc[:25]} == {"high"} and {e.priority for e in exc[25:]} == {"low"}
    kinds = [e.event_type for e in run.events.orderBy("ord").collect()]
    assert kinds == ["exception_open"] * 50 + ["dq_check"] * 3


def test_every_failing_row_is_routed_without_a_cap(spark):
    tx = spark.range(300).select(F.format_string("T%04d", "id").alias("id"), F.lit(None).cast("string").alias("ref"))
    cfg = DQConfig({"t": {"table": "t", "id_field": "id", "checks": [{"type": "completeness", "name": "refs", "field": "ref"}]}})
    run = Q.run_quality(cfg, {"t": tx}.__getitem__, AS_OF, "B")
    rows = run.exceptions.orderBy("exception_id").collect()
    assert [r.exception_id for r in rows] == [f"EXC-B-{i:06d}" for i in range(1, 301)] and rows[299].reference_id == "t:T0299"
    assert run.results.first().withheld == 0
    plan = run.exceptions._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_not_a_number_is_missing(spark):
    rows = [("1", float("nan")), ("2", None), ("3", 1.0)]
    assert failing(spark, {"type": "completeness", "field": "v"}, rows, "id string, v double")[1] == ["1", "2"]
    enum = {"rule": "enum", "field": "v", "values": ["1.0"]}
    assert failing(spark, enum, rows, "id string, v double")[1] == []
    parents = spark.createDataFrame([(1.0,)], "pid double")
    lost = Q.missing_parents(spark.createDataFrame(rows, "id string, v double"), "v", parents, "pid")
    assert lost.count() == 0


def test_text_with_an_offset_is_an_instant(spark):
    rows = [("1", "2026-08-01 00:30:00+05:00"), ("2", "2026-07-31T19:30:00Z"), ("3", "2026-08-02T01:00:00+00:00"), ("4", "2026-08-02")]
    check = {"type": "timeliness", "field": "v", "max_age_days": 30}
    assert failing(spark, check, rows, "id string, v string")[1] == ["1", "2"]


def test_standard_checks(spark):
    cfg = dq_config()
    assert sum(len(d["checks"]) for d in cfg.datasets.values()) == 17 and len(cfg.datasets) == 4


def test_scan_helpers_with_a_hot_key(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        ((F.col("id") * 7919) % 2003).alias("o"), "id",
    )
    rows = sorted(df.collect(), key=lambda r: (r.k, r.o))
    want, seen = {}, {}
    for r in rows:
        n, top, total = seen.get(r.k, (0, -1, 0))
        seen[r.k] = (n + 1, max(top, r.id), total + r.id)
        want[r.id] = seen[r.k]
    got = with_rank(df, ["k"], ["o"], "n")
    got = running(running(got, ["k"], ["o"], "id", "top", "max"), ["k"], ["o"], "id", "total", "sum")
    assert {r.id: (r.n, r.top, r.total) for r in got.collect()} == want
    places = {r.id: r.s for r in with_sequence(df, ["o"], "s").collect()}
    assert places == {r.id: i for i, r in enumerate(sorted(rows, key=lambda r: r.o), 1)}


def test_exact_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 10, 11]] + [(None,), (float("nan"),)], "v double")
    n, q = exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0])
    assert n == 6 and q == [1.0, 2.0, 2.5, 8.25, 11.0]

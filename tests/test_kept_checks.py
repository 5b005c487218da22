"""Quality results kept up file by file equal a full run, and read only new files."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from ledgerloom.config import DQConfig
from ledgerloom.operators import quality as Q
from ledgerloom.operators.kept_checks import KeptChecks, kept_results

AS_OF = datetime(2026, 9, 1)
ROWS, PARENTS = "id string, pid string, v double, w string, at timestamp_ntz, d date, kind string", "pid string"
CHECKS = [
    {"type": "completeness", "name": "kind", "field": "kind"},
    {"type": "completeness", "name": "all", "expected_count": 700},
    {"type": "accuracy", "rule": "range", "name": "range", "field": "v", "min": -5},
    {"type": "accuracy", "rule": "enum", "name": "enum", "field": "kind", "values": ["a", "b"]},
    {"type": "accuracy", "rule": "referential", "name": "parent", "field": "pid", "reference_dataset": "p", "reference_field": "pid"},
    {"type": "accuracy", "rule": "referential", "name": "nowhere", "field": "pid"},
    {"type": "timeliness", "name": "age", "field": "at", "max_age_days": 30},
    {"type": "timeliness", "name": "day", "field": "d", "max_age_days": 10},
    {"type": "anomaly", "rule": "zscore", "name": "z", "field": "v", "threshold": 1.5},
    {"type": "anomaly", "rule": "iqr", "name": "iqr", "field": "v"},
    {"type": "anomaly", "rule": "iqr", "name": "text", "field": "w", "threshold": 0.5},
    {"type": "anomaly", "rule": "zscore", "name": "absent", "field": "nothing"},
    {"type": "consistency", "name": "balance", "rule": "available_le_current"},
]
CFG = DQConfig({"d": {"table": "d", "id_field": "id", "checks": CHECKS}, "p": {"table": "p", "checks": []}})


def made(rng, start, n):
    out = []
    for i in range(start, start + n):
        v = rng.choice([None, float("nan"), 0.0, 7.25, rng.gauss(0, 9), rng.gauss(3, 2), rng.expovariate(0.1)])
        at = AS_OF - timedelta(days=rng.choice([1, 29, 30, 31, 32, 90]), microseconds=rng.choice([0, 1, 10**6]))
        w = rng.choice([None, "x", "", str(rng.randint(-50, 50)), "2.5", "3", rng.choice(["3", "1e300"])])
        out.append((str(i), rng.choice([None, "A", "B", "C", "D"]), v, w, rng.choice([None, at]), rng.choice([None, at.date()]), rng.choice([None, " ", "a", "b", "c"])))
    return out


def state(spark, root):
    return lambda t: spark.read.schema(ROWS if t == "d" else PARENTS).parquet(f"{root}/{t}")


def put(spark, root, table, rows):
    spark.createDataFrame(rows, ROWS if table == "d" else PARENTS).repartition(2).write.mode("append").parquet(f"{root}/{table}")


def same(spark, root, as_of=AS_OF):
    key = lambda df: sorted(map(repr, df.collect()))
    read = state(spark, root)
    kept = kept_results(spark, f"{root}/state", CFG, read, as_of, "d")
    assert key(kept) == key(Q.quality_results(CFG, read, as_of, "d"))
    return {r.check_name: r.failing_records for r in kept.collect()}


def test_each_step_equals_a_full_run(spark, tmp_path):
    rng, root = random.Random(5), str(tmp_path)
    put(spark, root, "p", [("A",), (None,)])
    put(spark, root, "d", made(rng, 0, 300))
    first = same(spark, root)
    assert first["all"] == 300 and first["absent"] == 0 and min(first[n] for n in ("parent", "nowhere", "age", "day", "z", "iqr", "text")) > 0
    put(spark, root, "d", made(rng, 300, 400))
    assert same(spark, root)["all"] == 0
    assert same(spark, root, AS_OF + timedelta(days=1))["age"] > same(spark, root, AS_OF - timedelta(days=40))["age"]
    lost = same(spark, root)["parent"]
    put(spark, root, "p", [("B",), ("B",)])
    assert 0 < same(spark, root)["parent"] < lost
    # files that are gone drop out; a parents' file that is gone begins the state anew
    sorted(Path(root, "d").glob("*.parquet"))[0].unlink()
    assert same(spark, root)["all"] > 0
    for path in sorted(Path(root, "p").glob("*.parquet"))[:2]:
        path.unlink()
    same(spark, root)


def test_infinite_values_and_no_rows(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, "p", [])
    put(spark, root, "d", [])
    assert set(same(spark, root).values()) == {0}
    values = [float("inf"), float("-inf"), 1.0, 2.0, 3.0, 4.0, 5e-324, -5e-324, -0.0]
    put(spark, root, "d", [(str(i), "A", v, "1", None, None, "a") for i, v in enumerate(values)])
    same(spark, root)


def test_only_new_files_are_read(spark, tmp_path):
    rng, root = random.Random(6), str(tmp_path)
    put(spark, root, "p", [("A",)])
    put(spark, root, "d", made(rng, 0, 200))
    read = state(spark, root)
    kept_results(spark, f"{root}/state", CFG, read, AS_OF, "d").collect()
    old = sorted(Path(root, "d").glob("*.parquet"))
    put(spark, root, "d", made(rng, 200, 50))
    whole = sorted(map(repr, Q.quality_results(CFG, state(spark, root), AS_OF, "d").collect()))
    for path in [*old, *Path(root, "p").glob("*.parquet")]:
        path.write_bytes(b"no table" * 100)  # whoever opens it fails
    with pytest.raises(Exception):  # noqa: B017
        state(spark, root)("d").select("v").collect()
    kept = KeptChecks(spark, f"{root}/state", CFG, "d", state(spark, root))
    assert len(kept.refresh()) == 2 and kept.refresh() == []
    assert sorted(map(repr, kept.results(AS_OF).collect())) == whole

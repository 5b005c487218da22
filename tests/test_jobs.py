"""Jobs of the table store: stops, replays, conflicts, and updates by part."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_store import AS_OF, enrollment_csv, rows, seeded

from ledgerloom.functions import scratch
from ledgerloom.functions.scan import exact_quantiles
from ledgerloom.operators import sealed
from ledgerloom.plans.registry import _Stopping
from ledgerloom.plans.run_all import _processed, enroll_store, run_all, seals_of
from ledgerloom.sources.tables import CommitConflict, TableStore
from ledgerloom.streaming.intake import start_intake

TABLES = (
    "pending_enrollments", "accepted_enrollments", "enrollment_dual_source_results", "exception_queue", "audit_event_log", "processed_enrollments",
)


def content(store, tables=TABLES):
    return {t: sorted(map(repr, store.read(t).collect())) for t in tables}


def test_stop_after_each_write(spark, tmp_path):
    whole = seeded(spark, tmp_path / "whole")
    enroll_store(whole, AS_OF)
    for after in range(0, 8, 2):
        store = seeded(spark, tmp_path / f"s{after}")
        before = content(store)
        with pytest.raises(InterruptedError):
            enroll_store(_Stopping(spark, store.root, after), AS_OF, run_id="E1")
        assert content(store) == before and not store.done("E1")
        enroll_store(store, AS_OF, run_id="E1")
        assert content(store) == content(whole) and store.done("E1")
        assert sealed.verify(store.read("audit_event_log"), seals_of(store)).first()["verified"]
        left = store.sweep()
        assert left >= after // 4 and content(store) == content(whole)
        with pytest.raises(ValueError):
            enroll_store(store, AS_OF, run_id="E1")


def test_whole_job_goes_on_after_a_stop(spark, tmp_path):
    store = seeded(spark, tmp_path / "s")
    with pytest.raises(InterruptedError):
        run_all(_Stopping(spark, store.root, 7), AS_OF, "R1")
    assert store.done("R1:reconcile") and not store.done("R1:quality") and store.count("dq_results") == 0
    stages = {r.stage: r for r in run_all(store, AS_OF, "R1").collect()}
    assert list(stages) == ["reconcile", "quality", "enroll", "queue", "audit"] and stages["audit"].ok
    assert store.read("reconciliation_results").where("payment_id IS NOT NULL").count() == 5 and store.count("dq_results") == 17


def test_stages_leave_no_scratch_tables(spark, tmp_path, monkeypatch):
    """Neither a stage that ends nor one that is stopped; they were all kept to the end of the application."""
    folder = tmp_path / "scratch"
    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(folder))
    store = seeded(spark, tmp_path / "s")
    before = [*folder.glob("ledgerloom/*/*")]
    with pytest.raises(InterruptedError):
        run_all(_Stopping(spark, store.root, 7), AS_OF, "R1")
    assert folder.exists() and [*folder.glob("ledgerloom/*/*")] == before
    assert run_all(store, AS_OF, "R1").count() == 5 and [*folder.glob("ledgerloom/*/*")] == before
    with scratch.passing(spark):
        outer = scratch.materialize(spark.range(3), "outer")
        with scratch.passing(spark):
            scratch.materialize(spark.range(4), "inner")
        assert outer.count() == 3 and [p.name[:5] for p in folder.glob("ledgerloom/*/*") if p not in before] == ["outer"]


def test_a_job_that_was_overtaken_fails(spark, tmp_path):
    one, two = (TableStore(spark, str(tmp_path / "s")) for _ in range(2))
    row = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(CommitConflict):
        with one.job("slow"):
            one.write("t", row)
            two.write("t", row)
    assert two.read("t").count() == 1 and not two.done("slow")
    with one.job("again"):
        one.write("t", row)
        one.write("u", row)
        assert one.read("t").count() == 2 and two.read("t").count() == 1 and not two.exists("u")
    assert two.read("t").count() == 2 and two.read("u").count() == 1


def test_updates_write_touched_parts_alone(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    made = rows(spark, "pending_enrollments", [dict(enrollment_id=f"E{i}", status="pending") for i in range(400)] + [dict(enrollment_id=None), dict(enrollment_id="E7", status="x")])
    store.write("pending_enrollments", made, "replace")
    keys = spark.createDataFrame([(f"E{i}",) for i in range(7, 17)], "enrollment_id string")
    done = F.when(F.col("enrollment_id").isin([f"E{i}" for i in range(7, 17)]), "accepted").otherwise(F.col("status"))
    store.update("pending_enrollments", keys, lambda own: own.withColumn("status", done))
    written = [p for p in (tmp_path / "s" / "pending_enrollments").glob("v*/by_run=*.w.*/by_part=*")]
    assert 0 < len(written) <= 10 and len(written) == len(store._parts_of("pending_enrollments", keys))
    found = store.read("pending_enrollments").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in found} == {"accepted": 11, "pending": 390, None: 1}
    store.write("pending_enrollments", rows(spark, "pending_enrollments", [dict(enrollment_id="E8", status="late")]))
    assert store.read("pending_enrollments", keys=keys.limit(1)).count() < 60 and store.count("pending_enrollments") == 403
    store.update("pending_enrollments", keys.where("enrollment_id = 'E8'"), lambda own: own.where("enrollment_id <> 'E8'"))
    assert store.count("pending_enrollments") == 401
    store.update("pending_enrollments", keys.limit(0), lambda own: own)
    assert store.count("pending_enrollments") == 401


def test_replayed_files_change_nothing(spark, tmp_path):
    store, folder = TableStore(spark, str(tmp_path / "s")), tmp_path / "in"
    folder.mkdir()
    enrollment_csv(folder / "1.csv", [{"enrollment_id": f"S{i}"} for i in range(5)])
    for checkpoint in ("a", "b"):  # a second stream reads the same files anew
        query = start_intake(store, str(folder), str(tmp_path / checkpoint), AS_OF)
        query.awaitTermination(120)
        assert query.exception() is None
        assert store.count("accepted_enrollments") == 5 and store.count("audit_event_log") == 5
    read = _processed(store, spark.createDataFrame([("S1",)], "enrollment_id string"))
    assert read.where("enrollment_id = 'S1'").count() == 1
    assert read.count() < 5 and not any("audit_event_log" in f for f in read.inputFiles())


def test_selection_equals_sorting(spark):
    chance = random.Random(9)
    cases = [
        [chance.gauss(0, 1) for _ in range(5000)], [chance.choice([1.0, 2.0, 2.0, 1e300, -1e300]) for _ in range(3001)], [5.0] * 7, [1.0], [],
        [10.0 ** chance.randint(-300, 300) for _ in range(2000)], [float("inf")] * 3 + [float("-inf")] + [1.0, 2.0], [0.0, -0.0, 1e-320],
    ]
    for values in cases:
        made = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        total, found = exact_quantiles(made, "v", [0.0, 0.25, 0.5, 0.75, 1.0], bins=16, few=8)
        assert total == len(values)
        ranked, expected = sorted(values), []
        for spot in [p * (total - 1) for p in (0.0, 0.25, 0.5, 0.75, 1.0)] if values else []:
            a, b = ranked[math.floor(spot)], ranked[math.ceil(spot)]
            expected.append(a if a == b else a + (b - a) * (spot - math.floor(spot)))
        assert found == expected

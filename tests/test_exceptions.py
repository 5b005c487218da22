import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import exceptions as X
from ledgerloom.operators import urgent
from ledgerloom.schemas import schema_of

AS_OF = datetime(2026, 9, 1)


def queue(spark, rows):
    """rows: (id, reference, priority, status, created)."""
    full = [(i, "dq", ref, pri, None, st, at, None, None, None) for i, ref, pri, st, at in rows]
    return spark.createDataFrame(full, schema_of("exception_queue"))


def tables(spark):
    return {
        "transactions": spark.createDataFrame([("T1", 5000.0), ("T2", None), ("T3", 0.0), ("T:4", 50.0)], "transaction_id string, amount double"),
        "payment_records": spark.createDataFrame([("P1", float("nan")), ("P2", 999.994)], "payment_id string, amount double"),
        "pending_enrollments": spark.createDataFrame([("E1", " 12000 "), ("E2", "1 000")], "enrollment_id string, incentive_amount string"),
    }


def test_amount_factor_edges(spark):
    df = spark.createDataFrame([(v,) for v in (99.99, 100.0, 999.0, 1000.0, 9999.99, 10000.0, None, float("nan"))], "a double")
    got = [r.f for r in df.select(X.amount_factor(F.col("a")).alias("f")).collect()]
    assert got == [1.0, 2.0, 2.0, 3.0, 3.0, 4.0, 2.5, 2.5]


def test_scores_and_order(spark):
    rows = [
        ("X1", "transactions:T1", "high", "open", datetime(2026, 8, 22)),
        ("X2", "transactions:T2", "HIGH", "open", AS_OF),
        ("X3", "transactions:T3", "odd", "open", datetime(2026, 9, 3)),
        ("X4", "payment_records:P1", "low", "open", None),
        ("X5", "payment_records:P2", "medium", "open", datetime(2026, 8, 24, 0, 0, 1)),
        ("X6", "pending_enrollments:E1", "low", "open", AS_OF),
        ("X7", "pending_enrollments:E2", "low", "open", AS_OF),
        ("X8", "accounts:A1", "low", "open", AS_OF),
        ("X9", "nothing", "low", "open", AS_OF),
        ("Y1", "transactions:T:4", "low", "open", AS_OF),
        ("Y2", None, "low", "resolved", AS_OF),
    ]
    got = {r.exception_id: r for r in X.ranked_queue(queue(spark, rows), tables(spark), AS_OF).collect()}
    # high, 5000, ten days old, three allowed: 3 * 3 * (1 + 0.5 * 7)
    assert got["X1"].priority_score == 40.5 and got["X1"].amount_at_risk == 5000.0
    assert (got["X2"].amount_basis, got["X2"].priority_score) == ("n/a", 7.5)
    assert (got["X3"].age_days, got["X3"].sla_days, got["X3"].priority_score, got["X3"].amount_at_risk) == (0, 7, 1.0, 0.0)
    assert (got["X4"].amount_basis, got["X4"].age_days) == ("n/a", 0)
    assert (got["X5"].amount_at_risk, got["X5"].age_days, got["X5"].age_factor) == (999.99, 7, 1.0)
    assert got["X6"].amount_at_risk_factor == 4.0 and got["X7"].amount_basis == "n/a"
    assert got["Y1"].amount_at_risk == 50.0 and got["Y2"].reference_id == ""
    assert {got[k].amount_at_risk_factor for k in ("X8", "X9", "Y2")} == {2.5}
    ranked = X.ranked_queue(queue(spark, rows), tables(spark), AS_OF, "open", 7).collect()
    scores = [r.priority_score for r in ranked]
    assert len(ranked) == 10 and scores == sorted(scores, reverse=True)
    # the window of seven days given for all: 3 * 3 * (1 + 0.5 * 3)
    assert ranked[0].exception_id == "X1" and ranked[0].priority_score == 22.5


def test_assign_and_resolve(spark):
    q = queue(spark, [("A", "x:1", "low", "open", AS_OF), ("B", "x:2", "low", "resolved", AS_OF), ("C", "x:3", "low", "open", AS_OF)])
    own = spark.createDataFrame([("A", "kim")], "exception_id string, owner string")
    after = {r.exception_id: r for r in X.assign(q, own).collect()}
    assert (after["A"].assigned_to, after["A"].status, after["C"].status) == ("kim", "in_progress", "open")
    for bad in ("B", "Z"):
        with pytest.raises(ValueError, match=bad):
            X.assign(q, spark.createDataFrame([(bad, "kim")], "exception_id string, owner string"))
    done = spark.createDataFrame([("A", "typo", "fixed")], "exception_id string, root_cause string, resolution_notes string")
    updated, events = X.resolve(q, done, AS_OF)
    row = updated.where("exception_id = 'A'").first()
    assert (row.status, row.resolved_at, row.root_cause, row.resolution_notes) == ("resolved", AS_OF, "typo", "fixed")
    assert events.first().batch_id == "EXC-RESOLVE-A"
    with pytest.raises(ValueError, match="already resolved"):
        X.resolve(q, done.withColumn("exception_id", F.lit("B")), AS_OF)


def test_an_exception_is_named_once(spark):

    queue = spark.createDataFrame([("X1", "open", None)], "exception_id string, status string, assigned_to string")
    with pytest.raises(ValueError):
        X.assign(queue, spark.createDataFrame([("X1", "a"), ("X1", "b")], "exception_id string, owner string"))


@pytest.mark.parametrize("override", [None, 5])
def test_most_urgent_at_any_date_equals_the_ranked_queue(spark, override):
    rng = random.Random(7)
    rows = [
        (f"X{rng.randrange(10**6):06d}", rng.choice([None, "transactions:T1", "transactions:T3", "payment_records:P2"]),
         rng.choice(["high", "medium", "low", "odd"]), rng.choice(["open", "open", "resolved"]),
         None if n % 40 == 0 else AS_OF - timedelta(days=rng.randrange(40), seconds=rng.randrange(86400)))
        for n in range(400)
    ]
    # a third of all on one day, and rows that repeat
    rows += [(f"Y{n:04d}", "transactions:T1", "high", "open", AS_OF - timedelta(days=9, seconds=n)) for n in range(200)] + rows[:5]
    q, t = queue(spark, rows), tables(spark)
    order = urgent.stored_order(q, t, "open", override, heads=20)
    for at, top in [(AS_OF - timedelta(days=30), 20), (AS_OF, 20), (AS_OF + timedelta(days=3, hours=13), 20), (AS_OF, 45), (AS_OF + timedelta(days=90), 10_000)]:
        whole = X.ranked_queue(q, t, at, "open", override).limit(top).collect()
        assert urgent.most_urgent(order, at, top).collect() == whole


def test_most_urgent_reads_few_rows_and_none_of_an_empty_queue(spark):
    rows = [(f"X{n:05d}", "transactions:T1", "high", "open", AS_OF - timedelta(days=n % 50)) for n in range(5000)]
    order = urgent.stored_order(queue(spark, rows), tables(spark), heads=10)
    assert order.rows.where(urgent._wanted(order, AS_OF, 10)).count() == 10
    empty = urgent.stored_order(queue(spark, rows[:0]), tables(spark))
    assert urgent.most_urgent(empty, AS_OF).collect() == []


def test_items_that_share_an_id_are_named_by_more_columns(spark):
    twins = queue(spark, [
        ("X1", "a:1", "high", "open", AS_OF), ("X1", "a:2", "low", "open", AS_OF), ("X1", "a:3", "low", "in_progress", AS_OF),
        ("X1", "a:4", "low", "resolved", AS_OF), ("X2", "a:5", "high", "open", AS_OF),
    ])
    keys = ["exception_id", "priority", "status"]
    owners = twins.where("status = 'open'").select(*keys, F.concat(F.lit("to-"), "priority").alias("owner"))
    got = {r.reference_id: (r.assigned_to, r.status) for r in X.assign(twins, owners, keys).collect()}
    assert got == {
        "a:1": ("to-high", "in_progress"), "a:2": ("to-low", "in_progress"), "a:3": (None, "in_progress"),
        "a:4": (None, "resolved"), "a:5": ("to-high", "in_progress"),
    }
    asked = twins.where("status = 'in_progress'").select(*keys, F.lit("why").alias("root_cause"), F.lit("so").alias("resolution_notes"))
    updated, told = X.resolve(twins, asked, AS_OF, keys)
    assert {r.reference_id for r in updated.where("root_cause = 'why' AND status = 'resolved'").collect()} == {"a:3"} and told.count() == 1
    with pytest.raises(ValueError, match="named 2 times"):
        X.assign(twins, owners)
    with pytest.raises(ValueError, match="already resolved"):
        X.resolve(twins, twins.where("status = 'resolved'").select(*keys, F.lit("x").alias("root_cause"), F.lit("y").alias("resolution_notes")), AS_OF, keys)


def test_queue_ids_cut_to_six_digits_stay_apart(spark, tmp_path):
    """From a million events on, several items of the given queue carry one id."""
    from ledgerloom.plans.registry import QUERIES

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_id", F.col("event_id") + 999_900).write.parquet(f"{tmp_path}/events.parquet")
    n = spark.read.parquet(f"{tmp_path}/events.parquet").count()
    for name in ("exc_assign", "exc_resolve"):
        assert QUERIES[name](spark, str(tmp_path)).count() == n

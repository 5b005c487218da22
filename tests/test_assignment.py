import datetime
import glob
import random

import pytest

from ledgerloom.functions.scratch import shared_dir
from ledgerloom.operators import assignment

DAY = datetime.date(2026, 1, 1)


def _tables(spark, payment_types, ledger_types, links):
    """payment_types: {pt: [seq]}; ledger_types: [[ids in order]]; links: [(pt, index, kind, score)]."""
    edges = []
    for pt, l, kind, score in links:
        ids = ledger_types[l]
        edges.append((pt, min(ids), kind, score, len(payment_types[pt]), len(ids), (min(ids), min(ids)), (max(ids), max(ids))))
    row = "struct<ord:string,id:string>"
    schema = f"pt bigint, lt string, kind string, score double, n_p bigint, n_l bigint, l_first {row}, l_last {row}"
    payments = [(seq, pt) for pt, seqs in payment_types.items() for seq in seqs]
    ledger = [(f"r{l}", "USD", 1.0, DAY, i, i) for l, ids in enumerate(ledger_types) for i in ids]
    return (
        spark.createDataFrame(edges, schema),
        spark.createDataFrame(payments, "seq bigint, pt bigint"),
        spark.createDataFrame(ledger, "ref string, cur string, amount double, day date, ord string, id string"),
    )


def _served(payment_types, ledger_types, links):
    """Payments one by one, each the best row still free."""
    taken, got = set(), {}
    for seq, pt in sorted((s, pt) for pt, seqs in payment_types.items() for s in seqs):
        rows = [(score, i) for p, l, _, score in links if p == pt for i in ledger_types[l] if i not in taken]
        if not rows:
            continue
        kind = next(k for p, _, k, _ in links if p == pt)
        best = max(r[0] for r in rows)
        ids = [i for score, i in rows if score == best]
        got[seq] = min(ids) if kind == "E" else max(ids)
        taken.add(got[seq])
    return got


def _rounds_written(spark):
    return set(glob.glob(f"{shared_dir(spark)}/ledgerloom/*/round-*"))


def _check(spark, *case):
    edges, payments, ledger = _tables(spark, *case)
    out = assignment.rounds(edges, payments, ledger).collect()
    assert len({r["id"] for r in out}) == len(out)
    assert {r["seq"]: r["id"] for r in out} == _served(*case)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_types_equal_serving_one_by_one(spark, monkeypatch, seed):
    monkeypatch.setattr(assignment, "LOG_LENGTH", 2)
    rng = random.Random(seed)
    seqs = list(range(1, 61))
    rng.shuffle(seqs)
    payment_types = {}
    while seqs:
        some = sorted(seqs.pop() for _ in range(min(len(seqs), rng.choice([1, 1, 2, 5]))))
        payment_types[some[0]] = some
    ids = [f"t{i:03d}" for i in range(55)]
    rng.shuffle(ids)
    ledger_types = []
    while ids:
        ledger_types.append(sorted(ids.pop() for _ in range(min(len(ids), rng.choice([1, 1, 3, 6])))))
    links = []
    for pt in payment_types:
        kind = rng.choice("EF")
        for l in rng.sample(range(len(ledger_types)), min(len(ledger_types), rng.choice([2, 3, 5]))):
            links.append((pt, l, kind, 1.0 if kind == "E" else rng.choice([0.86, 0.9, 0.95])))
    _check(spark, payment_types, ledger_types, links)


def test_a_round_writes_the_payments_that_moved(spark):
    # a chain in which every round ousts one payment, beside 400 that keep their first row
    chain, calm = 5, 400
    payment_types = {i: [i] for i in range(1, chain + calm + 1)}
    ledger_types = [[f"t{i:04d}"] for i in range(chain + calm + 1)]
    links = [(1, 1, "F", 0.95), (1, 0, "F", 0.86)]
    for i in range(2, chain + 1):
        links += [(i, i - 1, "F", 0.95), (i, i, "F", 0.9)]
    for i in range(chain + 1, chain + calm + 1):
        links += [(i, i, "F", 0.95)]
    before = _rounds_written(spark)
    _check(spark, payment_types, ledger_types, links)
    written = sorted(spark.read.parquet(p).count() for p in _rounds_written(spark) - before)
    assert written == [1] * (chain - 1) + [chain + calm]


def test_one_type_with_most_payments(spark):
    # a hundred equal payments and an earlier intruder on the same rows; the last find nothing
    payment_types = {1: [1, 4], 2: [2, 3] + list(range(5, 103))}
    ledger_types = [[f"a{i:03d}" for i in range(60)], [f"b{i:03d}" for i in range(30)]]
    _check(spark, payment_types, ledger_types, [(1, 0, "E", 1.0), (2, 0, "E", 1.0), (2, 1, "E", 1.0), (1, 1, "E", 1.0)])

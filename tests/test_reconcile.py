import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from walk import closeness, plain, walk

from ledgerloom.config import ReconConfig
from ledgerloom.functions.text import common_subsequence_length, similarity
from ledgerloom.operators import reconcile as R
from ledgerloom.operators.fuzzy import _shared_ends

DAY = date(2026, 8, 20)
AS_OF = datetime(2026, 9, 1)
P = "payment_id string, reference_id string, amount double, currency string, payment_date date, status string"
L = "transaction_id string, reference_id string, amount double, currency string, posting_date date"


def frames(spark, payments, ledger):
    return (
        spark.createDataFrame([(*p, "unmatched") for p in payments], P),
        spark.createDataFrame(ledger, L),
    )


def run(spark, payments, ledger, cfg=ReconConfig(), **kw):
    pay, led = frames(spark, payments, ledger)
    matched = R.match_payments(pay, led, cfg, AS_OF, **kw)
    rest = R.unmatched_ledger(led, matched)
    got = {
        r.payment_id: (r.match_status, r.match_method, r.ledger_transaction_id, r.match_confidence, r.exception_reason)
        for r in matched.collect()
    }
    return got, [r.id for r in rest.orderBy("seq").collect()]


def check(spark, payments, ledger, cfg=ReconConfig(), **kw):
    got, rest = run(spark, payments, ledger, cfg, **kw)
    want, left = walk(
        payments, ledger, cfg.amount_tolerance, cfg.date_window_days, cfg.fuzzy_threshold, cfg.stale_days, AS_OF.date()
    )
    wrong = {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]}
    assert not wrong, dict(list(wrong.items())[:5])
    assert rest == left
    return got


def one(spark, p, t, cfg=ReconConfig()):
    """Outcome of a single payment (ref, amount, currency, day) against one ledger row."""
    return check(spark, [("P1", *p)], [("T1", *t)], cfg)["P1"]


def test_edges_of_tolerance_window_and_threshold(spark):
    """Many one-against-one cases in one run, kept apart by their reference and currency."""
    usd = [
        (("REF-A-01", 100.0, "A", DAY), ("REF-A-01", 101.0, "A", DAY), "exact"),
        (("REF-B-02", 100.0, "B", DAY), ("REF-B-02", 101.01, "B", DAY), "amount_mismatch"),
        (("REF-C-03", 100.0, "C", DAY), (" ref_c 03", 100.0, "C", DAY + timedelta(1)), "exact"),
        (("REF-D-04", 100.0, "D", DAY), ("REF-D-04", 100.0, "D", DAY + timedelta(2)), None),
        (("REF123X", 100.0, "E", DAY), ("REF1234", 100.5, "E", DAY), "fuzzy"),
        (("REF-F-06", 100.0, "F", DAY), ("REF-F-06", 100.0, "F2", DAY), "amount_mismatch"),
        (("ZZZ", 5.0, "G", AS_OF.date() - timedelta(30)), ("QQQ", 900.0, "G", DAY), None),
        (("YYY", 5.0, "H", AS_OF.date() - timedelta(31)), ("WWW", 900.0, "H", DAY), "stale"),
        (("---", 5.0, "I", DAY), ("X", 5.0, "I", DAY), None),
    ]
    payments = [(f"P{i:02d}", *p) for i, (p, _, _) in enumerate(usd)]
    ledger = [(f"T{i:02d}", *t) for i, (_, t, _) in enumerate(usd)]
    got = check(spark, payments, ledger)
    for i, (_, _, want) in enumerate(usd):
        _, method, _, _, reason = got[f"P{i:02d}"]
        assert (method or reason) == want, usd[i]


def test_threshold_just_above(spark):
    cfg = ReconConfig(fuzzy_threshold=0.86)
    assert one(spark, ("REF123X", 100.0, "USD", DAY), ("REF1234", 100.0, "USD", DAY), cfg)[0] == "unmatched_payment"


def test_zero_tolerance(spark):
    cfg = ReconConfig(amount_tolerance=0.0)
    ledger = [("T1", "R1", 100.001, "USD", DAY), ("T2", "R1", 100.0, "USD", DAY), ("T3", "R1", 100.002, "USD", DAY)]
    far = DAY - timedelta(9)
    got = check(spark, [("P1", "R1", 100.01, "USD", DAY), ("P2", "R1", 100.001, "USD", far)], ledger, cfg)
    assert got["P1"][4] == "amount_mismatch" and got["P2"][0] == "unmatched_payment"


def test_empty_ledger_and_missing_values(spark):
    got, rest = run(spark, [("P1", None, 1.0, "USD", DAY), ("P2", "A", None, "USD", DAY)], [])
    assert {v[0] for v in got.values()} == {"unmatched_payment"} and rest == []
    ledger = [("T1", "A", None, "USD", DAY), ("T2", None, 1.0, "USD", DAY), ("T3", "B", 2.0, None, DAY)]
    payments = [("P1", None, 1.0, "USD", DAY), ("P2", "A", 5.0, "USD", DAY), ("P3", "B", 2.0, None, DAY)]
    got, _ = run(spark, payments, ledger)
    assert got["P1"][:3] == ("matched", "exact", "T2")
    assert got["P2"][2:] == ("T1", 0.0, "amount_mismatch")
    assert got["P3"][:3] == ("matched", "exact", "T3")


def crowd(seed, cases, spread, alphabet="AB12"):
    """Small contended groups, each in its own currency."""
    rng = random.Random(seed)
    payments, ledger = [], []
    for c in range(cases):
        refs = ["".join(rng.choice(alphabet) for _ in range(rng.choice((5, 6, 7)))) for _ in range(3)]
        refs = [f"{c:04d}{r}" for r in refs] + [""]

        def row(kind, i):
            ref = rng.choice(refs)
            if ref and rng.random() < 0.4:
                at = rng.randrange(4, len(ref))
                ref = ref[:at] + rng.choice(alphabet) + ref[at + rng.choice((0, 1)):]
            return (f"{kind}{rng.randrange(10**6):06d}{c:04d}{i:02d}", ref, 100.0 + rng.choice(spread),
                    f"C{c}{rng.choice('xxxy')}", DAY + timedelta(rng.choice((0, 0, 0, 1, 2))))

        payments += [row("P", i) for i in range(rng.randrange(1, 7))]
        ledger += [row("T", i) for i in range(rng.randrange(0, 7))]
    # blank references would meet across cases in the "known reference" test: keep them to one
    payments = [p if p[1] or "C0" in p[3] else (*p[:1], f"{p[3]}Q", *p[2:]) for p in payments]
    return payments, ledger


@pytest.mark.parametrize("seed,spread", [(1, (0.0, 0.0, 0.5, 0.9, 1.4, 2.5)), (2, (0.0,))])
def test_random_groups_equal_a_walk(spark, seed, spread):
    check(spark, *crowd(seed, 500, spread), ReconConfig(fuzzy_threshold=0.8))


def test_crowded_buckets_equal_a_walk(spark):
    """Everything in few buckets and a tiny pair limit: all fuzzy pairs come from shared text keys."""
    rng = random.Random(5)

    def text():
        size = rng.choice((9, 10, 11, 12, 34))
        return "".join(rng.choice("AB") for _ in range(size))

    base = [text() for _ in range(25)]

    def near(s):
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            at = rng.randrange(len(s))
            s = s[:at] + rng.choice(("", "A", "B", "AB")) + s[at + 1:]
        return s

    def row(kind, i):
        return (f"{kind}{i:04d}", near(rng.choice(base)), 100.0 + rng.choice((0, 0.3, 1.2)), "USD", DAY + timedelta(rng.choice((0, 1))))

    payments = [row("P", i) for i in range(100)]
    ledger = [row("T", i) for i in range(100)]
    check(spark, payments, ledger, ReconConfig(fuzzy_threshold=0.85), pairs_per_bucket=0)
    check(spark, payments[:60], ledger[:60], ReconConfig(fuzzy_threshold=0.7), pairs_per_bucket=0)


def test_a_blank_reference_shares_no_ends(spark):
    """One blank ledger reference in a crowded bucket: nothing may be cut off the others."""
    cell = ("USD", 1, 1)
    asking = spark.createDataFrame([(*cell, "ABCD"), (*cell, "ABXD")], "cur string, db int, ab int, p_ref string")
    for refs, ends in ((["", "ABCD"], (0, 0)), (["ABCD"], (2, 1))):
        offered = spark.createDataFrame([(*cell, r) for r in refs], "cur string, db int, ab int, l_ref string")
        assert [(r.head, r.tail) for r in _shared_ends(asking, offered).collect()] == [ends]


def test_copies_and_an_intruder(spark):
    """A large group of copies on both sides, disturbed by a payment that also fits elsewhere."""
    payments = [(f"P{i:05d}", "HOT", 100.0, "USD", DAY) for i in range(600)]
    payments.insert(300, ("P00299x", "HOT", 100.9, "USD", DAY))
    ledger = [(f"T{i:05d}", "HOT", 100.0, "USD", DAY) for i in range(500)] + [("T00400x", "HOT", 101.8, "USD", DAY)]
    got = check(spark, payments, ledger)
    assert sum(v[4] == "duplicate" for v in got.values()) == 101


def test_results_summary_status_and_events(spark):
    payments = [("P1", "R1", 10.0, "USD", DAY), ("P2", "R1", 10.0, "USD", DAY), ("P3", "R9", 5.0, "USD", DAY)]
    ledger = [("T1", "r-1", 10.0, "USD", DAY), ("T2", "Z", 7.0, "USD", DAY)]
    pay, led = frames(spark, payments, ledger)
    matched = R.match_payments(pay, led, ReconConfig(), AS_OF)
    rows = R.results(matched, R.unmatched_ledger(led, matched), "B-1", AS_OF).orderBy("recon_id").collect()
    assert [r.recon_id for r in rows] == ["RECON-B-1-000001", "RECON-B-1-000002", "RECON-B-1-000003", "RECON-B-1-L000001"]
    assert rows[3].ledger_transaction_id == "T2" and rows[3].reconciled_at == AS_OF
    s = R.run_summary(matched, led, "B-1").first().asDict()
    assert (s["matched_exact"], s["exception_duplicate"], s["unmatched_ledger"]) == (1, 1, 1)
    assert s["reconciliation_rate"] == 0.3333 and s["total_amount_reconciled"] == 10.0
    status = {r.payment_id: r.status for r in R.payment_status(pay, matched).collect()}
    assert status == {"P1": "matched", "P2": "exception", "P3": "unmatched"}
    events = R.audit_rows(matched, "B-1").orderBy("ord").collect()
    assert [(e.event_type, e.entity_type) for e in events] == [("match", "reconciliation"), ("exception_open", "exception")]


def test_normal_form_drops_all_white_space(spark):
    texts = ["".join(chr(c) for c in range(0x3100)), " ref_t_0002 ", "ref\tm\n0001", "---", None, "Ünï-ß"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", R.normalize_reference(df.t).alias("n")).collect()}
    assert got[0] == plain(texts[0]) or {c for c in got[0] if c.isspace()} == set()
    assert [got[i] for i in range(1, 6)] == [plain(t) for t in texts[1:]]


def test_similarity_equals_a_table(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choice("ABC") for _ in range(rng.randrange(1, n))), "".join(rng.choice("ABC") for _ in range(rng.randrange(1, n))))
             for n in [12] * 60 + [62] * 20 + [75] * 6]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", similarity(df.a, df.b).alias("s")).collect():
        assert r.s == closeness(r.a, r.b)


def test_common_letters_over_several_words(spark):
    rng = random.Random(5)
    texts = [
        ("".join(rng.choice(letters) for _ in range(m)), "".join(rng.choice(letters) for _ in range(n)))
        for n in (60, 61, 119, 120, 121, 240) for letters in ("AB", "ABCDEF0123", "A\u00c4\U0001f600Z") for m in (1, n, n + 7)
    ]
    whole = "".join(rng.choice("ABCDEFGHIJKLMNOP0123456789") for _ in range(2000))
    fewer = "".join(c for i, c in enumerate(whole) if i % 90)
    texts += [(whole, fewer), (fewer, whole), ("??", whole), (whole, whole)]
    df = spark.createDataFrame(texts, "a string, b string")
    for r in df.select("a", "b", common_subsequence_length(df.a, df.b).alias("n")).collect():
        shared = round((len(r.a) + len(r.b)) * closeness(r.a, r.b) / 2)
        assert r.n == shared


def test_endless_amounts_match_nothing(spark):
    from ledgerloom.config import ReconConfig
    from ledgerloom.operators import reconcile

    inf = float("inf")
    day = AS_OF.date() if hasattr(AS_OF, "date") else AS_OF
    pay = spark.createDataFrame([("P1", "R1", -inf, "USD", day), ("P2", "R2", 5.0, "USD", day), ("P3", "R3", inf, "USD", day)],
                                "payment_id string, reference_id string, amount double, currency string, payment_date date")
    book = spark.createDataFrame([("T1", "R1", -inf, "USD", day), ("T2", "R2", -inf, "USD", day), ("T3", "R9", inf, "USD", day)],
                                 "transaction_id string, reference_id string, amount double, currency string, posting_date date")
    got = {r.payment_id: r.exception_reason for r in reconcile.match_payments(pay, book, ReconConfig(), AS_OF).collect()}
    assert got == {"P1": "amount_mismatch", "P2": "amount_mismatch", "P3": None}


def test_vast_amounts_agree_within_tolerance_only(spark):
    from datetime import timedelta

    from ledgerloom.config import ReconConfig
    from ledgerloom.operators import reconcile

    day = AS_OF.date()
    pay = spark.createDataFrame([("P1", "R1", 6.0e15, "USD", day), ("P2", "R2", 6.0e15, "USD", day)],
                                "payment_id string, reference_id string, amount double, currency string, payment_date date")
    rows = [(f"T{i}", "R1", a, "USD", day - timedelta(9)) for i, a in enumerate((5.0e15, 6.0e15 + 1, 7.0e15))]
    rows += [(f"U{i}", "R2", a, "USD", day - timedelta(9)) for i, a in enumerate((5.0e15, 6.0e15 + 2, 7.0e15))]
    book = spark.createDataFrame(rows, "transaction_id string, reference_id string, amount double, currency string, posting_date date")
    got = {r.payment_id: r.match_status for r in reconcile.match_payments(pay, book, ReconConfig(), AS_OF).collect()}
    assert got == {"P1": "unmatched_payment", "P2": "exception"}


def test_repeated_payment_ids_keep_their_rows(spark):
    from ledgerloom.operators import reconcile

    pay = spark.createDataFrame([("P", "a"), ("P", "b"), ("Q", "c")], "payment_id string, status string")
    matched = spark.createDataFrame([("P", 1, "exception"), ("P", 2, "matched")], "payment_id string, seq long, match_status string")
    assert sorted(map(tuple, reconcile.payment_status(pay, matched).collect())) == [("P", "matched"), ("P", "matched"), ("Q", "c")]


def test_a_shared_beginning_brings_few_pairs_together(spark):
    """One hot bucket, long references of one beginning: candidates stay near the wanted pairs."""
    from pyspark.sql import functions as F

    from ledgerloom.config import ReconConfig
    from ledgerloom.functions.text import common_subsequence_length, similarity
    from ledgerloom.operators import fuzzy

    rng = random.Random(11)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZ0123456789"
    books = ["INVOICE2026PAY" + "".join(rng.choice(letters) for _ in range(26)) for _ in range(300)]
    asked = []
    for text in books:
        for _ in range(2):
            at = rng.randrange(14, 38)
            text = text[:at] + rng.choice(("", "Z", "QQ")) + text[at + rng.choice((0, 1)):]
        asked.append(text)
    cell = "cur string, db int, ab bigint"
    pay = spark.createDataFrame([(f"P{i}", 1, t, 1.0, DAY, "USD", 0, 0) for i, t in enumerate(asked)], f"pt string, n_p int, p_ref string, p_amount double, p_day date, {cell}")
    led = spark.createDataFrame([(f"T{i}", t, 1.0, DAY, 1, i, i, "USD", 0, 0) for i, t in enumerate(books)],
                                f"lt string, l_ref string, l_amount double, l_day date, n_l int, l_first int, l_last int, {cell}")
    met = fuzzy._by_shared_text(pay, led, ReconConfig(fuzzy_threshold=0.9)).select("pt", "lt").collect()
    wanted = pay.crossJoin(led.select("lt", "l_ref")).where(similarity(F.col("p_ref"), F.col("l_ref")) >= 0.9).select("pt", "lt").collect()
    assert len(wanted) >= 290 and set(map(tuple, wanted)) <= set(map(tuple, met))
    assert len(met) < 20 * len(wanted) < 0.1 * 300 * 300


def test_similarity_of_a_pair_is_one_call_over_whole_texts(spark):
    """Texts beyond one number's bits compare in tens of microseconds, not in milliseconds of lambdas."""
    from pyspark.sql import functions as F

    pairs = [("a" * 70 + "xyz" + "b" * 70, "a" * 70 + "zyx" + "b" * 70, 141), ("ab" * 80, "ba" * 80, 159), ("", "q", 0), ("é😀x", "😀é😀", 2), (None, "a", None)]
    df = spark.createDataFrame(pairs, "a string, b string, n int")
    found = df.select("n", common_subsequence_length(F.col("a"), F.col("b")).alias("got"))
    assert all(r.n == r.got for r in found.collect())
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_only_disputed_edges_reach_the_assignment(spark, monkeypatch):
    """A payment type and a ledger type that have nobody else are settled where they are found."""
    seen = []

    def spy(edges, payments, ledger):
        seen.extend((r.kind, r.pt) for r in edges.select("kind", "pt").collect())
        return assign(edges, payments, ledger)

    assign = R.assign
    monkeypatch.setattr(R, "assign", spy)
    payments = [(f"P{i:02d}", f"REF-LONE-{i:04d}", 100.0 * i, "USD", DAY) for i in range(1, 13)]
    ledger = [(f"T{i:02d}", f"REF-LONE-{i:04d}", 100.0 * i, "USD", DAY) for i in range(1, 13)]
    # copies on one side alone; copies on both; a text near a row that its own payment takes first
    payments += [("P20", "REF-LONE-0001", 100.0, "USD", DAY), ("P21", "BOTH", 7.0, "USD", DAY), ("P22", "BOTH", 7.0, "USD", DAY)]
    payments += [("P30", "REF-LONE-0002X", 200.0, "USD", DAY)]
    ledger += [("T20", "REF-LONE-0003", 300.0, "USD", DAY), ("T21", "BOTH", 7.0, "USD", DAY), ("T22", "BOTH", 7.0, "USD", DAY)]
    check(spark, payments, ledger)
    assert sorted(seen) == [("E", 2), ("E", 14), ("F", 16)]


def test_references_of_many_types_meet_in_buckets(spark):
    """Payment types of a reference meet its ledger types directly or in buckets: the same edges."""
    rng, cfg = random.Random(5), ReconConfig()
    some = lambda n: [(rng.choice(("A", "B", "")), round(rng.uniform(0, 6), 1), DAY + timedelta(days=rng.randrange(5))) for _ in range(n)]
    pay, led = frames(
        spark, [(f"P{i:03d}", r, a, "USD", d) for i, (r, a, d) in enumerate(some(60))],
        [(f"T{i:03d}", r, a, "USD", d) for i, (r, a, d) in enumerate(some(60))],
    )
    queue = R.with_sequence(R._prepared(pay, "payment_id", "payment_date", "payment_id"), ["ord", "id"], "seq")
    types = R.payment_types(queue)
    known = R.known_types(types, R._prepared(led, "transaction_id", "posting_date", "transaction_id"))
    found = [sorted((r.pt, r.lt) for r in R.exact_edges(types, known, cfg, few=n).select("pt", "lt").collect()) for n in (0, 20, 64)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_plain_references_make_no_types(spark, monkeypatch):
    """One payment and one ledger row of a reference are settled by one aggregate, unless a fuzzy edge leads to the row."""
    written = {}

    def counted(df, label, *a, **kw):
        stored = store(df, label, *a, **kw)
        written[label] = stored.count()
        return stored

    store = R.materialize
    monkeypatch.setattr(R, "materialize", counted)
    payments = [(f"P{i:03d}", f"REF-{i:06d}", 10.0 * i, "USD", DAY) for i in range(100, 140)]
    ledger = [(f"T{i:03d}", f"ref_{i:06d}", 10.0 * i + 1, "USD", DAY + timedelta(1)) for i in range(100, 140)]
    # an earlier payment that is close to T105, a later one to T106, one of another amount, one of a second currency
    payments += [
        ("P000", "REF-00010X", 1050.0, "USD", DAY), ("P900", "REF-00010Y", 1060.0, "USD", DAY),
        ("P901", "REF-000200", 5.0, "USD", DAY), ("P902", "REF-000107", 1070.0, "EUR", DAY),
    ]
    ledger += [("T200", "REF-000200", 9.0, "USD", DAY)]
    got = check(spark, payments, ledger)
    assert got["P000"][:3] == ("matched", "fuzzy", "T105") and got["P105"][4] == "duplicate"
    assert got["P110"][:3] == ("matched", "exact", "T110")
    assert written["types"] == 4 and written["met"] == 2


def test_ledger_rows_of_other_payments_come_from_their_groups(spark, monkeypatch):
    """What the ledger says of references that are not plain is kept from the first aggregate, also of several currencies."""
    written = {}

    def counted(df, label, *a, **kw):
        stored = store(df, label, *a, **kw)
        written[label] = stored.count()
        return stored

    store = R.materialize
    monkeypatch.setattr(R, "materialize", counted)
    payments = [(f"P{i:03d}", f"REF-{i:06d}", 10.0 * i, "USD", DAY) for i in range(100, 140)]
    ledger = [(f"T{i:03d}", f"ref_{i:06d}", 10.0 * i + 1, "USD", DAY + timedelta(1)) for i in range(100, 150)]
    # another amount; a currency that only the ledger or only the payments have; copies; both currencies right
    payments += [
        ("P900", "REF-000140", 5.0, "USD", DAY), ("P901", "REF-000141", 1410.0, "EUR", DAY), ("P902", "REF-000142", 1420.0, None, DAY),
        ("P903", "REF-000143", 1430.0, "USD", DAY), ("P904", "REF-000143", 1430.0, "USD", DAY), ("P905", "REF-000144", 1440.0, "USD", DAY),
        ("P906", "REF-000144", 1440.0, "EUR", DAY), ("P907", "REF-000100", 3.0, "EUR", DAY),
    ]
    ledger += [("T900", "REF-000142", 9.0, "EUR", DAY), ("T901", "REF-000143", 1430.0, "USD", DAY), ("T902", "REF-000144", 1440.0, "EUR", DAY)]
    got = check(spark, payments, ledger)
    assert got["P906"][:3] == ("matched", "exact", "T902") and got["P905"][:3] == ("matched", "exact", "T144")
    assert got["P901"][4] == got["P907"][4] == "amount_mismatch"
    # of references 100, 140 to 144; none of the plain ones, and none that no payment names
    assert written["others_book"] == 9


def test_common_letters_of_short_and_long_texts(spark):
    """Texts within and beyond a machine word's bits, and absent ones, in one batch; counted once where a filter follows."""
    rng = random.Random(8)
    some = lambda: "".join(rng.choice("AB1\0é😀") for _ in range(rng.choice((0, 1, 7, 8, 9, 15, 33, 63, 64, 65, 90))))
    texts = [(None if rng.random() < 0.05 else some(), None if rng.random() < 0.05 else some()) for _ in range(400)]
    texts += [("A" * 64, "A" * 64), ("A" * 64, "B" * 63 + "A"), ("A" * 65, "A" * 64), ("", "")]

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [max(row[j + 1], row[j] + (x == y)) for j, y in enumerate(b)]
            for j in range(1, len(row)):
                row[j] = max(row[j], row[j - 1])
        return row[-1]

    df = spark.createDataFrame(texts, "a string, b string").coalesce(1)
    got = [tuple(r) for r in df.select("a", "b", common_subsequence_length(F.col("a"), F.col("b"))).collect()]
    assert got == [(a, b, None if a is None or b is None else longest(a, b)) for a, b in texts]
    near = df.withColumn("score", similarity(F.col("a"), F.col("b"))).where("score >= 0.5")
    assert near._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1

import hashlib
import json
import random
from datetime import UTC, datetime

import pytest

from ledgerloom.functions.canonical import HASHED_FIELDS, canonical_json, event_hash
from ledgerloom.operators import audit
from ledgerloom.schemas import schema_of

AS_OF = datetime(2026, 9, 1)
LOG = schema_of("audit_event_log")
EVENTS = "ord int, event_type string, entity_type string, entity_id string, action string, batch_id string"


def text_of(row):
    body = {f: row[f] for f in HASHED_FIELDS}
    if body["timestamp"] is not None:
        body["timestamp"] = body["timestamp"].replace(tzinfo=UTC).isoformat()
    return json.dumps(body, sort_keys=True, ensure_ascii=False)


def hash_of(row):
    return hashlib.sha256(text_of(row).encode()).hexdigest()


def events(spark, n, batch="B1", start=0):
    rows = [(start + i, "match", "reconciliation", f"R{start + i}", "match", batch) for i in range(n)]
    return spark.createDataFrame(rows, EVENTS)


def chain(n, batch="B1", previous=""):
    rows = []
    for i in range(1, n + 1):
        row = dict(event_id=f"EVT-{batch}-{i:06d}", timestamp=AS_OF, event_type="match", actor="system",
                   entity_type="reconciliation", entity_id=f"R{i}", action="match", previous_hash=previous)
        row["event_hash"] = previous = hash_of(row)
        rows.append(row)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in LOG.names) for r in rows], LOG)


def walk(rows, batch=None):
    """The report the rules ask for, event by event."""
    if batch:
        rows = [r for r in rows if r["event_id"].startswith(f"EVT-{batch}-")]
    rows = sorted(rows, key=lambda r: (r["timestamp"], r["event_id"]))
    if not rows:
        return True, None, None, None
    known = {r["event_hash"] for r in rows}
    first = [r for r in rows if r["previous_hash"] == "" or (batch and r["previous_hash"] not in known)]
    if len(first) != 1:
        return (False, first[0]["event_id"], "chain_linkage_broken", 0) if first else (False, None, "no_genesis", 0)
    seen, now, found = [], first[0], None
    while now is not None:
        if now["event_id"] in seen:
            found = found or (now["event_id"], "cycle_detected", len(seen))
            break
        seen.append(now["event_id"])
        if hash_of(now) != now["event_hash"]:
            found = found or (now["event_id"], "content_hash_mismatch", len(seen) - 1)
        after = [r for r in rows if r["previous_hash"] == now["event_hash"]]
        if len(after) > 1:
            found = found or (now["event_id"], "chain_fork", len(seen) - 1)
            break
        now = after[0] if after else None
    if found is None and len(seen) != len(rows):
        found = (None, "orphaned_events", len(seen))
    return (True, None, None, None) if found is None else (False, *found)


def report(spark, rows, batch=None):
    r = audit.verify(frame(spark, rows), batch).first()
    return r["verified"], r["event_id"], r["reason"], r["position"]


def test_canonical_text_equals_json(spark):
    odd = ['a "b" \\ c', "tab\t nl\n cr\r", "\x00\x01\x0b\x1f\x7f", "müßig 漢字 😀", "", "a/b", None]
    rows = []
    for i, text in enumerate(odd):
        stamp = datetime(2026, 9, 1, 1, 2, 3, 0 if i % 2 else 45000)
        rows.append(dict(event_id=f"E{i}", timestamp=stamp, event_type="t", actor=text, entity_type="x", entity_id=text,
                         action=text, previous_hash="" if i else None, event_hash=""))
    got = {r.event_id: (r.j, r.h) for r in frame(spark, rows).select("event_id", canonical_json().alias("j"), event_hash().alias("h")).collect()}
    for row in rows:
        assert got[row["event_id"]] == (text_of(row), hash_of(row))


def test_append_resumes_and_links_across_blocks(spark):
    first = audit.append(events(spark, 7), None, AS_OF, block_rows=3)
    rows = [r.asDict() for r in first.orderBy("event_id").collect()]
    assert [r["event_id"] for r in rows] == [f"EVT-B1-{i:06d}" for i in range(1, 8)]
    assert rows[0]["previous_hash"] == "" and all(hash_of(r) == r["event_hash"] for r in rows)
    assert [r["previous_hash"] for r in rows[1:]] == [r["event_hash"] for r in rows[:-1]]
    second = audit.append(events(spark, 2, "A0"), first, AS_OF)
    both = first.unionByName(second)
    assert second.orderBy("event_id").first()["previous_hash"] == rows[-1]["event_hash"]
    assert audit.verify(both).first()["verified"] and audit.verify(both, "A0").first()["verified"]
    assert audit.chain_tip(both).collect()[0]["event_id"] == "EVT-A0-000002"
    assert audit.append(events(spark, 0), first, AS_OF).count() == 0
    with pytest.raises(audit.BatchIdInUse):
        audit.require_unused(both, "A0")
    audit.require_unused(both, "A")


def test_batch_prefix_does_not_reach_longer_ids(spark):
    log = frame(spark, chain(2, "DQ-000-PRIOR"))
    audit.require_unused(log, "DQ-000")
    assert audit.of_batch(log, "DQ-000-PRIOR").count() == 2


def broken(name):
    rows = chain(9)
    rng = random.Random(name)
    if name == "altered":
        rows[4]["action"] = "other"
        rows[6]["action"] = "other"
    elif name == "first removed":
        rows = rows[1:]
    elif name == "middle removed":
        del rows[4]
    elif name == "two starts":
        rows += chain(2, "C1")
    elif name == "fork":
        rows.append({**rows[5], "event_id": "EVT-B1-000099"})
        rows[-1]["event_hash"] = hash_of(rows[-1])
    elif name == "fork after altered":
        rows.append({**rows[7], "event_id": "EVT-B1-000099"})
        rows[3]["actor"] = "x"
    elif name == "loop":
        rows[6]["event_hash"] = rows[2]["event_hash"]
        rows[7]["previous_hash"] = "gone"
    elif name == "separate ring":
        ring = chain(3, "R1", "x")
        ring[0]["previous_hash"] = ring[2]["event_hash"]
        rows += ring
    elif name == "twin":
        rows.append(dict(rows[4]))
    elif name == "random":
        for r in rng.sample(rows, 3):
            r[rng.choice(["previous_hash", "event_hash"])] = rng.choice(rows)["event_hash"]
    return rows


@pytest.mark.parametrize("name", [
    "altered", "first removed", "middle removed", "two starts", "fork", "fork after altered", "loop", "separate ring", "twin", "random",
])
def test_verify_names_the_first_break(spark, name):
    rows = broken(name)
    assert report(spark, rows) == walk(rows)
    if name in ("middle removed", "altered"):
        assert report(spark, rows, "B1") == walk(rows, "B1")


def test_verify_sound_and_empty(spark):
    assert report(spark, []) == (True, None, None, None)
    rows = chain(3) + chain(2, "B2", chain(3)[-1]["event_hash"])
    assert report(spark, rows) == report(spark, rows, "B2") == (True, None, None, None)


def test_evidence_package(spark, tmp_path):
    log = frame(spark, chain(3))
    results = spark.createDataFrame(
        [("RECON-B1-000001", "B1", "matched"), ("RECON-B1-000002", "B1", "exception"), ("RECON-Z-1", "Z", "matched")],
        "recon_id string, batch_id string, match_status string",
    )
    queue = spark.createDataFrame([("EXC-B1-000001", "open"), ("EXC-B1-X-000001", "open")], "exception_id string, status string")
    pack = audit.evidence(log, results, queue, "B1", full=True, exported_at=AS_OF)
    m = pack["manifest"].first()
    assert m.scope.audit_events_rows == 3 and m.scope.reconciliation_results_rows == 2 and m.scope.exception_rows == 1
    assert m.verification.verified and m.verification.broken_event is None
    assert (m.reconciliation_summary.matched, m.reconciliation_summary.exceptions) == (1, 1)
    assert m.exception_summary.open == 1 and list(m.scope.event_timestamp_range) == ["2026-09-01 00:00:00"] * 2
    assert pack["reconciliation_results"].count() == 2
    assert audit.evidence(log, results, queue, "B1")["reconciliation_results"].count() == 2
    assert audit.evidence(log, results, queue, "B1", full=False)["reconciliation_results"].count() == 0
    audit.write_evidence(pack, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/audit_events")).count() == 3
    with pytest.raises(audit.UnknownBatchId):
        audit.evidence(log, results, queue, "NOPE")


def test_recent_is_by_time_then_id(spark):
    rows = chain(4)
    rows[0]["timestamp"] = datetime(2027, 1, 1)
    got = [r.event_id for r in audit.recent(frame(spark, rows), 2).collect()]
    assert got == ["EVT-B1-000001", "EVT-B1-000004"]


def test_events_of_several_batches_are_numbered_apart(spark):
    both = events(spark, 2, "A").unionByName(events(spark, 2, "B", 2))
    ids = [r.event_id for r in audit.unchained(both, AS_OF).orderBy("seq").collect()]
    assert ids == ["EVT-A-000001", "EVT-A-000002", "EVT-B-000001", "EVT-B-000002"]


@pytest.mark.parametrize("name", ["altered", "orphaned"])
def test_long_chain_is_shortened_before_it_is_walked(spark, monkeypatch, name):
    """Breaks far from the start, with few steps left to walk; all rounds together write a few times the log."""
    rows = chain(600)
    if name == "altered":
        rows[450]["action"] = "other"
    if name == "orphaned":
        rows += [{**rows[0], "event_id": f"EVT-R1-{i}", "previous_hash": f"ring-{i}", "event_hash": f"ring-{1 - i}"} for i in range(2)]
    random.Random(name).shuffle(rows)
    written, store = [], audit.materialize

    def counting(df, label, **options):
        kept = store(df, label, **options)
        written.append(kept.count() if label == "edges" else 0)
        return kept

    monkeypatch.setattr(audit, "materialize", counting)
    r = audit.verify(frame(spark, rows), None, 40).first()
    assert (r["verified"], r["event_id"], r["reason"], r["position"]) == walk(rows)
    assert sum(written) <= 5 * len(rows)

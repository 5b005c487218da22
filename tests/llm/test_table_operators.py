"""Host reputation, chat formatting, nearest neighbours, mixing and the pipeline on small and awkward input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import cost_packing, curriculum, hilbert, host_reputation, neighbour_vote, prefix_targets
from ledgerloom.llm.common import fold
from ledgerloom.llm.queries import ORACLES, QUERIES, RULES, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("url, host, path", [
    (None, "", ""), ("no scheme", "", ""), ("http://", "", ""), ("HTTP://A.Com", "a.com", ""), ("x://H.net?q=/en/", "h.net", ""),
    ("https://www.Example.com/en/1?x#y", "www.example.com", "/en/1"), ("a://b://c/d", "b:", "//c/d"), ("ftp://É.COM/É#", "É.com", "/É"),
])
def test_host_and_path(spark, url, host, path):
    made = spark.createDataFrame([(url,)], "url string")
    assert tuple(made.select(*host_reputation.host_and_path(F.col("url"))).first()) == (host, path)


@pytest.mark.parametrize("host, path, rule, verdict", [
    ("example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("a.www.example.com", "/en/", "www.example.com/en/", "allow"), ("badexample.com", "/en/", "com/", "allow"), ("example.com", "/de/", "com/", "allow"),
    ("example.com", "", None, None), ("x.net", "/es/1", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("x.net", "/en/", None, None),
    ("x.org", "/", None, None),
])
def test_rules(spark, host, path, rule, verdict):
    made = spark.createDataFrame([(host, path)], "host string, path string")
    assert tuple(made.select(*host_reputation.match(F.col("host"), F.col("path"), RULES)).first()) == (rule, verdict)


def test_domains(spark):
    cases = {
        "a.b.example.com": ("example.com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "": ("", ""), "localhost": ("localhost",) * 2,
        "10.0.0.1:80": ("10.0.0.1",) * 2, "u:p@h.example.org:8080": ("example.org", "org"), "example.net.": ("example.net", "net"),
    }
    made = spark.createDataFrame([(h,) for h in cases], "host string")
    rows = made.select("host", *host_reputation.domain_and_suffix(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == cases


def test_reputation_is_shrunk(spark):
    """A host with one bad page is taken for its siblings; one with many is not. Awkward rows are judged too."""
    rows = [(f"http://good{i}.one.com/", 1) for i in range(20) for _ in range(30)]
    rows += [("http://new.one.com/", 0)] + [("http://bad.one.com/", 0)] * 60 + [(None, 1), (None, None), ("", 0), ("http://unseen.one.com/x", None)]
    made = spark.createDataFrame([(i, u, y, "clash") for i, (u, y) in enumerate(rows)], "page_id bigint, url string, outcome int, host string")
    judged = host_reputation.judge(made)
    found = {r.host: r for r in judged.collect()}
    assert judged.count() == len(rows) and found["bad.one.com"].verdict == "block" and found["good1.one.com"].verdict == "allow"
    assert found["new.one.com"].mean > found["bad.one.com"].mean and found["unseen.one.com"].seen == 0
    assert all(r.lower <= r.mean and 0 <= r.mean <= 1 for r in found.values())
    assert host_reputation.judge(made.limit(0)).count() == 0
    assert {r.mean for r in host_reputation.judge(made.withColumn("outcome", F.lit(None).cast("int"))).collect()} == {0.5}


def test_escape_is_reversible(spark, texts):
    awkward = [t or "" for t in texts] + ["#", "##", "####", "\\", "\\\\", "</", "<\\/turn>", "#\\#", "### x: y</turn>\n", "<", "/turn>", "\n", "a\\\nb", "$1\\$1"]
    made = spark.createDataFrame([(t,) for t in awkward], "text string")
    for r in made.select("text", prefix_targets.escape(F.col("text")).alias("e"), prefix_targets.unescape(prefix_targets.escape(F.col("text"))).alias("u")).collect():
        assert r.u == r.text and "##" not in r.e and "</" not in r.e


def test_examples(spark, texts):
    turns = [(1, 0, "system", "be"), (1, 1, "user", "hi ###"), (1, 2, "assistant", "a</turn>\n"), (1, 3, "user", "q"), (1, 4, "assistant", ""), (1, 5, "user", "bye")]
    turns += [(2, None, None, None), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (None, 1, "user", "lost"), (3, 0, "user", "only")]
    turns += [(4, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)] + [(5, 0, "odd: role</turn>\n### x", "t")]
    made = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id bigint, turn bigint, role string, text string, example string")
    examples = prefix_targets.expand(made)
    first = sorted((r for r in examples.collect() if r.conv_id == 1), key=lambda r: r.example)
    assert [r.last for r in first] == [False, False, True] and first[0].text == "### system: be</turn>\n### user: hi #\\#\\#</turn>\n### assistant: a<\\/turn>\n</turn>\n"
    assert first[0].text[first[0].loss_start :][: first[0].loss_length] == "a<\\/turn>\n" and first[1].loss_length == 0 and first[2].loss_start is None
    assert all(b.text.startswith(a.text) for a, b in zip(first, first[1:]))
    got = {r.conv_id: r for r in prefix_targets.digest(examples).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted(((t is not None, t or 0, r is not None, r or "", x is not None, x or "") for c, t, r, x in turns if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, _, _, r, _, x in own)
        loss = "".join(x for _, _, _, r, _, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss)) and r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest(), conv
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert prefix_targets.digest(prefix_targets.expand(made.limit(0))).count() == 0


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")], axis=1)
        keys = hilbert.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_search_equals_brute_force_within_windows(spark):
    random_ = np.random.default_rng(1)
    vectors = {i: [float(x) for x in random_.standard_normal(6)] for i in range(300)}
    for i in range(300, 420):
        vectors[i] = vectors[100]  # one very common vector
    rows = [(i, v) for i, v in vectors.items()] + [(7, vectors[7])]
    rows += [(1000, None), (1100, [0.0] * 6), (1200, [1.0] * 5), (1300, [float("nan")] * 6), (1400, [float("inf")] * 6), (1500, [None] * 6), (None, vectors[3])]
    made = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, embedding array<double>, name string")
    found = hilbert.search(made, F.col("id") % 100 == 0, k=5, orderings=3, window=1000).collect()
    for query in (0, 100, 200, 300, 400):
        own = np.array(vectors[query])
        near = sorted((math.sqrt(((np.array(v) - own) ** 2).sum()), i) for i, v in vectors.items() if i != query)[:5]
        got = sorted((r for r in found if r.query_id == query), key=lambda r: r["rank"])
        assert [(r["rank"], r.vec_id) for r in got] == [(n + 1, i) for n, (_, i) in enumerate(near)]
        assert all(abs(r.score - d) < 1e-12 for r, (d, _) in zip(got, near))
    assert len(found) == 25
    small = hilbert.search(made, F.col("id") % 100 == 0, k=5, orderings=4, window=100).collect()
    assert len({(r.query_id, r.vec_id) for r in small} & {(r.query_id, r.vec_id) for r in found}) >= 20
    assert hilbert.search(made.limit(0), F.lit(True)).count() == 0
    few = hilbert.search(made.where("vec_id IN (0, 1, 2)"), F.col("id") % 100 == 0, k=5).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_recall(spark):
    """Measured against brute force on the given vectors."""
    found = {(r.query_id, r.vec_id) for r in QUERIES["op5_hilbert"](spark, "/root/testdata/sf0.1").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        order = [i for i in np.lexsort((ids, np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1)))) if i != q][:10]
        hits, total = hits + sum((ids[q], ids[i]) in found for i in order), total + 10
    assert hits >= 0.9 * total


def test_recall_where_windows_are_few(spark):
    """Three windows in each of four orderings hold a twentieth of the points; true neighbours are met all the same."""
    vectors = np.random.default_rng(2).standard_normal((4000, 16))
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in hilbert.search(made, F.col("id") % 40 == 0, orderings=4, window=16).collect()}
    hits = 0
    for q in range(0, 4000, 40):
        near = [i for i in np.argsort(((vectors - vectors[q]) ** 2).sum(axis=1)) if i != q][:10]
        hits += sum((q, int(i)) in found for i in near)
    assert hits >= 0.9 * 1000


def test_schedules_invert(spark):
    for schedule in (curriculum.RISING, curriculum.LEVEL, curriculum.FALLING, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.0))):
        made = spark.range(0, 101).select((F.col("id") / 100).alias("share"))
        for r in made.select("share", curriculum.position(F.col("share"), schedule).alias("t")).collect():
            done = 0.0
            for (a, u), (b, v) in zip(schedule, schedule[1:]):
                end = min(max(r.t, a), b)
                done += (end - a) * (u + u + (v - u) * (end - a) / (b - a)) / 2
            assert abs(done / curriculum.integral(schedule) - r.share) < 1e-6


def test_mix_meets_its_targets(spark, docs, empty):
    random.seed(5)
    rows = [(i, "w " * random.randint(1, 60), random.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)] + [(400, None, "e"), (401, "", "e")]
    made = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, source string, position string")
    planned = curriculum.plan(made).collect()
    by_source = {}
    for r in planned:
        s = by_source.setdefault(r._source, [r._target, r._supply, 0, 0])
        s[2] += sum(r._taken)
        s[3] += r._size
        assert sum(r._taken) <= 2 * r._size
    total = sum(s[3] for s in by_source.values())
    for target, supply, taken, size in by_source.values():
        assert size == supply and taken == math.floor(target) <= 2 * supply
    assert abs(sum(s[0] for s in by_source.values()) - 1.5 * total) < 1
    order = sorted((s for s in by_source if s is not None)) + [None]
    rates = {s: by_source[s][0] / (5, 2, 1)[i % 3] for i, s in enumerate(order) if by_source[s][0] < 2 * by_source[s][1]}
    assert len({round(r, 6) for r in rates.values()}) <= 1
    mixed = curriculum.mix(made)
    assert mixed.columns == ["doc_id", "text", "source", "position"]
    out = mixed.collect()
    assert [r.position for r in out] == sorted(r.position for r in out) and all(0 <= r.position <= 1 for r in out)
    assert sorted(map(tuple, out)) == sorted(map(tuple, curriculum.mix(made).collect()))
    assert curriculum.plan(docs).count() == docs.count() and curriculum.mix(docs).count() > 0
    assert curriculum.plan(empty).count() == 0 and curriculum.mix(empty).count() == 0


def test_op10_follows_training_time(spark):
    """Rows come in the order of the schedules' inverted demand, as the copies do."""
    copies = QUERIES["op10_training_order"](spark, SF).collect()
    assert copies and [r.position for r in copies] == sorted(r.position for r in copies)
    planned = {r._id: min((a for a in r._at if a is not None), default=2.0) for r in curriculum.plan(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    order = [planned[r.doc_id] for r in QUERIES["op10_curriculum"](spark, SF).collect()]
    assert order == sorted(order) and len(set(order)) > 10


def test_weights_move_over_time(spark):
    made = spark.createDataFrame([(i, "w " * 10, s) for s in "abc" for i in range(500)], "doc_id bigint, text string, source string")
    rows = curriculum.mix(made, weights=(1, 1, 1), share=0.9).collect()
    early = [sum(r.source == s and r.position < 0.5 for r in rows) / sum(r.source == s for r in rows) for s in "abc"]
    assert abs(early[0] - 0.4) < 0.02 and abs(early[1] - 0.5) < 0.02 and abs(early[2] - 0.6) < 0.02


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[:3] == ["doc_id", "start", "length"] and rows.count() > 0
    docs = corpus_pipeline.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns, name
    kept = corpus_pipeline.good(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = kept.join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r.quality: r["count"] for r in judged}.get(0, 0) <= 0.2 * labels.where("quality = 0").count()
    assert re.match("quality", corpus_pipeline.STAGES[0][0])


def test_pipeline_rows_equal_plain_stages(spark):
    """run()'s pieces against a plain version: votes, all pairs, the mix in SQL, whole-text encoding."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    frame = corpus_pipeline.table(spark, SF, "documents")
    voters = neighbour_vote.fit(frame, corpus_pipeline.table(spark, SF, "labels"), F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(False)))
    ids = sorted(docs)
    votes = voters.vote(neighbour_vote.features(pa.array([docs[i].text or "" for i in ids])), 25, 8.0)
    good = [i for i, v in zip(ids, votes) if v >= 0.7]
    sets = {}
    for i in good:
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[i].text or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    single = [i for i in good if find(i) == i]
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet' WHERE doc_id IN ({', '.join(map(str, single))})")
    copies = Counter(r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op10_training_order']})").fetchall())
    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tokens = {i: np.array(whole.encode(docs[i].text or "", add_special_tokens=False).ids + [1], "<u4") for i in copies}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == copies and len(single) < len(good) < len(docs)
    covered, used = Counter(), {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        own = tokens[r.doc_id][r.start : r.start + r.length]
        assert (len(own), zlib.crc32(own.tobytes()), len(tokens[r.doc_id]), used.get(r.sequence_id, 0)) == (r.length, r.ids_crc32, r.doc_tokens, r.offset)
        used[r.sequence_id] = r.offset + r.length
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    assert covered == {(i, k): n for i, n in copies.items() for k in range(len(tokens[i]))}
    assert all(n == 2048 or n & (n - 1) == 0 for n in used.values())


def test_packing_of_an_empty_table(spark, tmp_path):
    frame = corpus_pipeline.table(spark, SF, "documents").limit(0)
    frame.write.parquet(str(tmp_path / "none"))
    assert corpus_pipeline.packed(spark, spark.read.parquet(str(tmp_path / "none")), SF).count() == 0


def test_packed_sequences_follow_training_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cost_packing.pieces, "__defaults__", tuple(20000 if d == cost_packing.POOL_TOKENS else d for d in cost_packing.pieces.__defaults__))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('some words of it ', 1000 + 10 * cast(id / 10 as int))").alias("text"))
    docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "mixed"))
    rows = corpus_pipeline.packed(spark, spark.read.parquet(str(tmp_path / "mixed")), SF).collect()
    first = {d: min(r.sequence_id for r in rows if r.doc_id == d) for d in range(400)}
    last = {d: max(r.sequence_id for r in rows if r.doc_id == d) for d in range(400)}
    # a pool is at most a slice of 2 MB, some 120 of these documents
    assert all(last[d] < first[e] for d in range(400) for e in range(d + 130, 400))

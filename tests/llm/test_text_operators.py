"""Suffix tree, multiset hash, quality vote and near duplicates on small and awkward input."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import multiset_hash, neighbour_vote, ngram_jaccard, suffix_tree
from ledgerloom.llm.common import fold, text_bytes, words
from ledgerloom.llm.components import components

WORDS = [f"w{i}" for i in range(60)]


def prose(seed, n=60):
    random.seed(seed)
    return " ".join(random.choice(WORDS) + random.choice("abcdefgh") for _ in range(n))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words(texts):
    held, offsets = text_bytes(pa.array(texts))
    units, at = words(held, offsets)
    units = [u.decode() for u in units.to_pylist()]
    assert [units[a:b] for a, b in zip(at, at[1:])] == [split(t) for t in texts]


def test_base_scores_and_counts(spark, docs, empty):
    held = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    rows = suffix_tree.score(docs, held, chunk_bytes=2000).collect()
    source = [(r.doc_id, r.held, split(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) + ["\0"]) for r in docs.withColumn("held", held).collect()]
    counts = Counter(w for _, h, ws in source if not h for w in ws)
    total = sum(counts.values())
    base = [sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in ws) for _, _, ws in source]
    expected = sorted((d is None, d or 0, h, len(ws), sum(counts[w] > 0 for w in ws), round(b, 6)) for (d, h, ws), b in zip(source, base))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == expected
    assert {r.train_tokens for r in rows} == {total} and all(math.isfinite(r.score) for r in rows)
    assert suffix_tree.score(empty, held).count() == 0


def test_without_training_rows_nothing_is_unlikely(docs):
    assert {r.score for r in suffix_tree.score(docs, F.lit(True)).collect()} == {0.0}


def test_tree_follows_the_longest_context_that_diverges(spark):
    """After "x a" comes b, after "y a" comes c: two symbols of context are needed and found."""
    rows = [(i, " ".join("x a b" if random.Random(i * 99 + j).random() < 0.5 else "y a c" for j in range(40))) for i in range(30)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    sums = {d: suffix_tree.score(made, F.lit(False), depth=d).agg(F.sum("score")).first()[0] for d in (0, 1, 2)}
    base = suffix_tree.score(made, F.lit(False)).agg(F.sum("base_score")).first()[0]
    assert abs(sums[0] - base) < 1e-6 and sums[0] < sums[1] - 100 and sums[1] < sums[2] - 100


def test_distributions_sum_to_one():
    random_ = np.random.default_rng(3)
    hashes = np.arange(1, 5, dtype=np.uint64)
    corpus = [random_.choice(4, 50, p=p) for p in ([0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.7]) for _ in range(20)]
    singles, pairs = Counter(x for c in corpus for x in c), Counter((a, b) for c in corpus for a, b in zip(c, c[1:]))
    often = sorted(p for p in pairs if pairs[p] > 60)  # the others share what is left
    levels = [hashes, np.array([a << 32 | b for a, b in often], dtype=np.uint64)]
    counts = [np.array([singles[i] for i in range(4)]), np.array([pairs[p] for p in often])]
    tree = suffix_tree.grow(levels, counts, 2000, 4, 0.0, 2.0)
    root = (counts[0] + 0.5) / (2000 + 0.5 * 5)
    for context in range(4):
        own = {b: math.exp(lp) for (a, b), lp in zip(often, tree.log_p[1]) if a == context}
        rest = math.exp(tree.rest[0][context]) * (1 - sum(root[b] for b in own))  # unseen words included
        assert abs(sum(own.values()) + rest - 1) < 1e-9


def tree_scores(docs, held, least=5, test=6.0, prior=4.0):
    """The tree's score of each document, by dictionaries over runs of every length."""
    train = [d for d, h in zip(docs, held) if not h]
    total, distinct = sum(map(len, train)), len({w for d in train for w in d})

    def often(n):
        counts = Counter(d[i : i + n] for d in train for i in range(len(d) - n + 1))
        return {r: c for r, c in counts.items() if c >= least}

    singles = Counter(w for d in train for w in d)
    log_p = [[math.log((singles[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in d] for d in docs]
    before = often(1)
    likely = {r: (c + 0.5) / (total + 0.5 * (distinct + 1)) for r, c in before.items()}
    length = 0
    while True:
        runs, groups, rests, own = often(length + 2), {}, {}, {}
        for r in runs:
            groups.setdefault(r[:-1], []).append(r)
        for c, group in groups.items():
            seen, parents = before[c], {r: likely[r[1:]] for r in group}
            left, other = max(seen - sum(runs[r] for r in group), 0), max(1 - sum(parents.values()), 1e-12)
            gain = sum(runs[r] * math.log(runs[r] / seen / parents[r]) for r in group) + (left * math.log(left / seen / other) if left else 0)
            if 2 * gain >= test * (len(group) + 1):
                rests[c] = math.log((left + prior * other) / (seen + prior) / other)
                own.update({r: (runs[r] + prior * parents[r]) / (seen + prior) for r in group})
        if not rests:
            return length, [sum(p) / math.log(10) for p in log_p]
        length += 1
        for d, p in zip(docs, log_p):
            for i in range(length, len(d)):
                if d[i - length : i] in rests:
                    p[i] = math.log(own[r]) if (r := d[i - length : i + 1]) in own else p[i] + rests[d[i - length : i]]
        before, likely = runs, {r: own.get(r, likely[r[1:]]) for r in runs}


def test_contexts_are_as_long_as_they_diverge(spark):
    """What follows "a a a" depends on the word before it, so four symbols of context are needed."""
    random_ = random.Random(6)
    pick = lambda: random_.choice(("x a a a b", "y a a a c", "z z", "q"))
    rows = [(i, " ".join(pick() for _ in range(random_.randint(0, 60)))) for i in range(60)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = suffix_tree.score(made, F.col("doc_id") % 5 == 1, chunk_bytes=1500).collect()
    length, expected = tree_scores([(*t.split(), "\0") for _, t in rows], [i % 5 == 1 for i, _ in rows])
    assert length >= 4 and len(found) == len(rows)
    assert all(abs(r.score - expected[r.doc_id]) < 1e-6 for r in found)


def test_a_run_counts_the_same_in_a_large_corpus(spark):
    """Six occurrences are enough beside nine million words."""
    rare = spark.range(6).select("id", F.lit("p q").alias("text"))
    made = rare.union(spark.range(6, 36).select("id", F.repeat(F.lit("w "), 300000))).withColumnRenamed("id", "doc_id")
    found = suffix_tree.score(made, F.lit(False)).where("doc_id < 6").collect()
    assert len(found) == 6 and all(r.train_tokens > 9000000 and r.score > r.base_score + 5 for r in found)


def test_parts_and_rounds_do_not_change_the_tree(spark, monkeypatch):
    """Contexts of six symbols stay and none of seven, which is inside a round of four; words are dealt into parts."""
    monkeypatch.setattr(suffix_tree, "PART_TOKENS", 400)
    draw = random.Random(6)
    pick = lambda: draw.choice(("x a a a a a b", "y a a a a a c", "z z", "q"))
    rows = [(i, " ".join(pick() for _ in range(draw.randint(0, 60)))) for i in range(60)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = suffix_tree.score(made, F.col("doc_id") % 5 == 1, chunk_bytes=1500).collect()
    length, expected = tree_scores([(*t.split(), "\0") for _, t in rows], [i % 5 == 1 for i, _ in rows])
    assert length >= 6 and len(found) == len(rows) and all(abs(r.score - expected[r.doc_id]) < 1e-6 for r in found)


def test_what_always_goes_on_the_same_is_not_followed():
    rule, n = suffix_tree.Rule(5, 6.0, 4.0), 8
    context, before = np.zeros(n, "<i8"), [np.ones(n, "<u4")]
    same, symbols = np.full(n, 7, "<u4"), np.array([7, 7, 7, 7, 7, 7, 8, 9], "<u4")
    change, at, _, stayed = suffix_tree._lengthened(rule, context, same, np.full(n, 3, "<i4"), np.full(n, -5.0), before)
    assert stayed == 1 and len(at) == 0 and (change > 4).all()  # stays, and nothing longer can
    many = np.array([3, 3, 3, 3, 3, 3, 9, 9], "<i4")
    assert len(suffix_tree._lengthened(rule, context, symbols, many, np.full(n, -5.0), before)[1]) == n  # may part


def test_written_rows_do_not_grow_with_the_length_of_uniform_text(spark, monkeypatch):
    """A row is as large as what it says, so that a task's rows fit its memory; it was four bytes a word and length."""
    sizes, write = [], suffix_tree.materialize

    def kept(table, *args, **kinds):
        found = write(table, *args, **kinds)
        cells = [F.max(F.length(c)) for c, t in found.dtypes if t == "binary"]
        sizes.extend(x or 0 for x in found.agg(*cells).first()) if cells else None
        return found

    monkeypatch.setattr(suffix_tree, "materialize", kept)
    made = spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 300000).alias("text"))
    assert suffix_tree.score(made, F.lit(False)).count() == 3 and max(sizes) < 100000


def test_fingerprints_are_homomorphic():
    a, b, c = prose(1), prose(2), prose(3)
    one, two = multiset_hash.fingerprints([f"{a}\n{b}\n{c}\n{a}", f"{c}\n\n{a}\n{a}\n{b}"])
    assert one == two
    less, empty = multiset_hash.fingerprints([f"{a}\n{b}", None])
    assert less != one and multiset_hash.changed(one, removed=[c, a]) == less and multiset_hash.changed(less, [c, a]) == one
    assert multiset_hash.changed(empty, [a, b]) == less and multiset_hash.likeness(empty, less) == 0 and multiset_hash.likeness(empty, empty) == 1
    texts = ["\n".join(prose(i) for i in range(20)), "\n".join(prose(i) for i in range(10, 30)), "\n".join(prose(i) for i in range(40, 60))]
    x, y, z = multiset_hash.fingerprints(texts)
    assert abs(multiset_hash.likeness(x, y) - 1 / 3) < 0.15 and multiset_hash.likeness(x, z) < 0.15


def test_edited_texts(docs, empty, monkeypatch):
    monkeypatch.setattr(multiset_hash, "RANGE_LETTERS", 3000)  # several ranges
    source = sorted(((r.doc_id, r.text or "") for r in docs.where("doc_id IS NOT NULL").collect()), key=lambda r: -r[0])
    rows = multiset_hash.compare(docs.where("doc_id IS NOT NULL")).collect()
    expected = []
    for (d, own), (_, after) in zip(source, source[1:] + source[:1]):
        half = len(own) // 2
        new = own[: len(own) - half] + after[:half]
        expected.append((d, len(own), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == sorted(expected)
    prints = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(r.doc_id, r.fingerprint) == r.fingerprint
    assert multiset_hash.compare(docs).count() == docs.count()  # null ids as well
    assert multiset_hash.compare(empty).count() == 0
    alone = multiset_hash.compare(docs.where("doc_id = 5").limit(1)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_votes(spark, docs, empty):
    def kind(i):
        return prose(i, 30) if i % 2 else " ".join(f"{w}$$$ {w}$$$" for w in prose(i, 15).split())

    rows = [(1000 + i, kind(i), i % 2) for i in range(80)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    labels = made.select("doc_id", "quality").where("doc_id < 1060").union(spark.createDataFrame([(None, 1), (1001, None), (5, None)], "doc_id bigint, quality int"))
    voters = neighbour_vote.fit(made.drop("quality"), labels, F.lit(True))
    assert len(voters.labels) == 60
    found = neighbour_vote.score(made.where("doc_id >= 1060"), voters, neighbours=5).collect()
    assert all((r.score > 0.9) == (r.quality == 1) for r in found) and found[0].__fields__ == ["doc_id", "text", "quality", "score"]
    awkward = neighbour_vote.score(docs, voters)
    assert awkward.columns == [c for c in docs.columns if c != "score"] + ["score"]
    values = [(r.text, r.score) for r in awkward.collect()]
    assert len(values) == docs.count() and all(0 <= s <= 1 for _, s in values)
    assert all(abs(s - voters.labels.mean()) < 1e-9 for t, s in values if not t)
    assert neighbour_vote.score(empty, voters).count() == 0
    none = neighbour_vote.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in neighbour_vote.score(docs, none).collect()} == {0.5}


def plain_vote(voters, row, neighbours=25, power=8.0):
    """The vote of one text, cosine by cosine."""
    latent = [sum(float(r) * float(w) * float(b) for r, w, b in zip(row, voters.weights, column)) for column in voters.basis.T]
    size = math.sqrt(sum(x * x for x in latent))
    if size <= 1e-9:
        return float(voters.labels.mean())
    cosines = [sum(a * float(b) for a, b in zip(latent, v)) / size for v in voters.vectors]
    near = sorted(range(len(cosines)), key=lambda i: (-cosines[i], i))[:neighbours]
    weights = [max(cosines[i], 0) ** power for i in near]
    return sum(w * voters.labels[i] for w, i in zip(weights, near)) / sum(weights)


def test_scores_equal_plain_votes(spark):
    rows = [(i, prose(i, 25) + (" !!! ### " * (i % 3)), int(i % 3 == 0)) for i in range(90)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    voters = neighbour_vote.fit(made.drop("quality"), made.select("doc_id", "quality").where("doc_id < 60"), F.lit(True), dimensions=8)
    terms = neighbour_vote.features(pa.array([t for _, t, _ in rows]))
    found = {r.doc_id: r.score for r in neighbour_vote.score(made.select("doc_id", "text"), voters, neighbours=7).collect()}
    for i in (0, 1, 2, 61, 74, 89):
        assert abs(found[i] - plain_vote(voters, terms[i], 7)) < 1e-3


def test_ties_go_to_the_earlier_labelled_row():
    eye = np.eye(neighbour_vote.TERMS, 4, dtype=np.float32)
    vectors = np.array([[0, 1, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0]], dtype=np.float32)
    voters = neighbour_vote.Voters(np.ones(neighbour_vote.TERMS, np.float32), eye, vectors, np.array([0, 1, 0, 0, 1]))
    row = np.zeros((1, neighbour_vote.TERMS), dtype=np.float32)
    row[0, 0] = 3.0
    assert [voters.vote(row, k, 8.0)[0] for k in (1, 2, 3, 5)] == [1.0, 0.5, 1 / 3, 1 / 3]


def test_words_move_votes(spark):
    """Two texts of the same letter pattern, told apart by their words alone."""
    good, bad = "madi polu teka".split(), "nodi raku fema".split()
    rows = [(i, " ".join(random.Random(i).choices(good if i % 2 else bad, k=20)), i % 2) for i in range(60)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    voters = neighbour_vote.fit(made.drop("quality"), made.select("doc_id", "quality").where("doc_id < 40"), F.lit(True))
    assert all((r.score >= 0.7) == (r.quality == 1) for r in neighbour_vote.score(made.where("doc_id >= 40"), voters, neighbours=5).collect())


def brute(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = split(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= threshold * len(a | b):
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), math.inf), math.inf if d is None else d)
    return sorted((-1 if d is None else d, -1 if least[top(i)] == math.inf else least[top(i)], links[i]) for i, (d, _) in enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SETS", 7)  # large clusters are cut into many blocks
    rows, random_ = [], random.Random(4)
    for base in range(4):
        words_ = prose(base, 120).split()
        for i in range((40, 6, 3, 1)[base]):
            changed = list(words_)
            for _ in range(random_.randint(0, 4)):
                changed[random_.randrange(120)] = f"new{random_.randrange(9999)}"
            rows.append((100 * base + i, " ".join(changed)))
    rows += [(900 + i, prose(77, 90)) for i in range(8)] + [(950, "a b c"), (951, " a  b\nc "), (952, "a b")]
    rows += [(None if r.doc_id is None else 5000 + r.doc_id, r.text) for r in docs.collect()]
    made = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("mark", F.lit("clash")).withColumn("print", F.lit(1))
    found = ngram_jaccard.classes(made).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in found) == brute(rows)
    kept = ngram_jaccard.keep_one(made)
    assert kept.columns == made.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted({(c) for _, c, _ in brute(rows)} | {-1})
    assert ngram_jaccard.classes(empty).count() == 0 and ngram_jaccard.keep_one(empty).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.998), (0.5, 0.9), (0.9, 0.999)):
        bands, rows = ngram_jaccard.bands_for(threshold, recall)
        assert bands * rows <= 256 and 1 - (1 - threshold**rows) ** bands >= recall


def test_components(spark):
    random_ = random.Random(8)
    edges = [(random_.randrange(60), random_.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, found)) == sorted((x, top(x)) for x in parent)

"""Conversation repair, spelling variants and covering SimHash against plain versions, on small and awkward input."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ledgerloom.llm import covering_simhash, spelling_gram, viterbi_repair
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id bigint, turn bigint, role string, text string, key string, row string, part int"


def plain_repair(rows):
    """(cost, audit, lines) by a search over all states with whole audits as values; rows are (kind, fault, role, text)."""
    nxt, made = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (2, 2, 3, 2)
    best = {0: (0, "", ())}

    def offer(into, state, value):
        if state not in into or value < into[state]:
            into[state] = value

    def role(state):
        return "assistant" if state == 3 else "user"

    def inserted(ways):
        for _ in range(4):
            for q, (cost, audit, lines) in list(ways.items()):
                offer(ways, made[q], (cost + 2, audit + "I", (*lines, role(made[q]) + ":")))
        return ways

    for initial, fault, name, text in rows:
        now = {}
        for q, (cost, audit, lines) in inserted(best).items():
            offer(now, q, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if initial in nxt[q]:
                    offer(now, nxt[q][initial], (cost + more, audit + "K", (*lines, f"{name}:{text}")))
                offer(now, made[q], (cost + 2 + more, audit + "R", (*lines, f"{role(made[q])}:{text}")))
        best = now
    return min(v for q, v in inserted(best).items() if q in (0, 3))


def plain_summary(turns):
    """By conversation, of rows (conv, turn, role, text)."""
    out = {}
    for conv in {t[0] for t in turns}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, rows = set(), []
        for _, r, x in own:
            bare = re.findall(r"[^\x20\x09-\x0D]", x)
            fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((r, x))
            rows.append((r[:1], fault, r, x))
        known = [t for t, _, _ in own if t is not None]
        cost, audit, lines = plain_repair(rows)
        faults = Counter(f for _, f, _, _ in rows)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found_summary(df):
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def random_turns(seed):
    chance = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Fine.", "Why?", "cut off", "", None, " \t", "Yes!\n ", "no end \x0b", "é.", "é"]
    turns = []
    for conv in (*range(40), None, -3):
        n = chance.choice([1, 2, 3, 5, 9, 40])
        weights = chance.choice([[5, 5, 1, 0, 0, 0, 0], [2, 2, 2, 2, 1, 1, 1], [0, 0, 0, 5, 0, 0, 0], [0, 1, 6, 0, 0, 0, 0]])
        for i in range(n):
            text = chance.choice(texts)
            if text and chance.random() < 0.7:
                text = f"{i} {text}"
            turns.append((conv, None if chance.random() < 0.05 else chance.choice([i, 2 * i, i // 2]), chance.choices(roles, weights)[0], text))
    # a run of rows that fit nowhere, and one of copies: chunks there never converge
    turns += [(900, i, "tool", f"{i}.") for i in range(101)] + [(901, i, "user", "same.") for i in range(90)] + [(902, i, "user", f"{i}") for i in range(77)]
    return turns


@pytest.mark.parametrize("chunk", [1, 4, 64])
def test_repair_equals_plain_search(spark, chunk):
    turns = random_turns(chunk)
    made = spark.createDataFrame([(*t, "clash", "clash", 1) for t in turns], TURNS)
    assert found_summary(viterbi_repair.summary(made, chunk=chunk)) == plain_summary(turns)


def test_passes_stop_where_vectors_are_parallel():
    """A rerun takes over the earlier run's rows as soon as the vectors agree, and gives what a whole run gives."""
    chance = random.Random(3)
    vectors = sorted({viterbi_repair.step_back(s, v)[0] for s in range(12) for v in ("0420", "2031", "0000", "1402")})
    for _ in range(300):
        symbols = "".join(chr(65 + chance.randrange(12)) for _ in range(chance.randrange(1, 30)))
        one, two = chance.choice(vectors), chance.choice(vectors)
        old = viterbi_repair.run_back(symbols, one)
        whole = viterbi_repair.run_back(symbols, two)
        assert viterbi_repair.run_back(symbols, two, old) == whole
        start = viterbi_repair.run_on(symbols, "0", None, whole[1])
        assert viterbi_repair.run_on(symbols, "3", start, whole[1], "0") == viterbi_repair.run_on(symbols, "3", None, whole[1])


def test_every_short_conversation():
    """All conversations of up to three row kinds: backward costs and tracing against the plain search."""
    names, faults = ("system", "user", "assistant", "tool"), (None, "truncated", "blank")
    for n in range(4):
        for kinds in product(range(12), repeat=n):
            cost, audit, _ = plain_repair([(names[k % 4][0], faults[k // 4], names[k % 4], str(i)) for i, k in enumerate(kinds)])
            symbols = "".join(chr(65 + k) for k in kinds)
            made, vectors, total = viterbi_repair.run_back(symbols, viterbi_repair.packed(viterbi_repair.END))
            state, letters, _ = viterbi_repair.run_on(symbols, "0", None, vectors)
            letters += viterbi_repair.TAIL[int(state)]
            assert (total + ord(made[0]) - 48, letters.translate(viterbi_repair._INITIALS)) == (cost, audit), kinds


def test_repair_of_damaged_rows(spark):
    turns = [t for t in random_turns(7) if t[0] is None or t[0] < 30] + [(1, 5, "user", "Twice."), (1, 5, "user", "Twice.")]
    blank = lambda v: " " if v is None else v
    after = []
    for c, t, r, x in turns:
        h = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        x = "" if h == 1 else re.sub("[.!?]", "", blank(x)) if h == 2 else blank(x)
        after += [(c, t, "user" if h == 4 else blank(r), x)] * (0 if h == 0 else 2 if h == 3 else 1)
    plain = plain_summary(after)
    made = spark.createDataFrame([(*t, "clash", "clash", 1) for t in turns], TURNS)
    rows = viterbi_repair.repair_damaged(made, chunk=8)
    got = {r[0]: tuple(r)[1:] for r in rows.collect()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == {c: plain.get(c, none) for c in {t[0] for t in turns}}
    assert viterbi_repair.repair_damaged(made.limit(0)).count() == 0
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    gone = spark.createDataFrame([(dropped, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r)[1:] for r in viterbi_repair.repair_damaged(gone).collect()] == [none]


def one_edit_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least=7):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= least:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: [v for v in n if one_edit_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


def spelled(seed):
    chance, rows = random.Random(seed), []
    base = ["although", "éclairée", "weather", "Whether", "ÉCOLIÈRE", "anagram", "nagaram", "aaaaaaaa", "x÷y×zzzz", "stranger", "strangers", "strange"]
    for key in range(300):
        words = []
        for _ in range(40):
            w = chance.choice(base)
            roll = chance.random()
            if roll < 0.08:
                at = chance.randrange(len(w))
                w = w[:at] + chance.choice(["", chance.choice("abeé"), w[at] + chance.choice("abeé")]) + w[at + 1 :]
            words.append(w.upper() if roll > 0.97 else w)
        rows.append((key, chance.choice([" ", ", ", "\n", "1", "ł"]).join(words)))
    return rows + [(1, None), (2, ""), (None, "although Although although"), (None, None), (3, "b" * 5000 + " " + "b" * 4999 + " " + "b" * 5000 + " " + "b" * 4999)]


@pytest.mark.parametrize("block_words", [4096, 8])
def test_variants_equal_all_pairs(spark, block_words):
    """With blocks of eight words almost every block is cut into lots."""
    rows = spelled(block_words)
    made = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    got = spelling_gram.variants(made, block_words=block_words)
    found = [tuple(r) for r in got.collect()]
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and len(found) == len(set(found))
    assert set(found) == plain_variants(rows) and any(f[1] for f in found)
    assert spelling_gram.variants(made.limit(0)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    rows = [(i, " ".join(["abcdefgh"] * 50 + ["abcdefghi"] * 4)) for i in range(50)] + [(60, "abcdefghij abcdefghij")]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.word: (r.form, r.root) for r in spelling_gram.variants(made, every=1 << 40).collect()}
    assert got == {"abcdefgh": (None, "abcdefgh"), "abcdefghi": ("abcdefgh", "abcdefgh"), "abcdefghij": ("abcdefghi", "abcdefgh")}


def test_letter_runs(texts):
    awkward = [t or "" for t in texts] + ["Ünïcödé", "é", "ÿ÷×À", "łabcdefghł", "abcªdef", "àbc", "abcdefg", "hijklmn"]
    held, offsets = spelling_gram.text_bytes(pa.array(awkward))
    runs, size, owner = spelling_gram.letter_runs(held, offsets, 1)
    got = [(o, r.decode()) for r, o in zip(runs.to_pylist(), owner.tolist())]
    assert got == [(i, r) for i, t in enumerate(awkward) for r in re.findall("[A-Za-zÀ-ÿ]+", t)]
    assert size.tolist() == [len(r) for _, r in got]


def plain_print(text, n=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(ws[i : i + n]) for i in range(max(len(ws) - n + 1, 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius=4):
    """Smallest id reachable, by rows (id, print)."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array([p for _, p in prints], dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1:
            root[find(int(j))] = find(i)
    groups = {}
    for i, (key, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(key)
    return [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(prints))]


def test_simhash_classes(spark, docs, empty):
    chance = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        own = [chance.choice(words) for _ in range(chance.choice([3, 4, 30, 300]))]
        for _ in range(chance.choice([1, 2, 6])):
            texts.append(" ".join(own))
            own = list(own)
            own[chance.randrange(len(own))] = chance.choice(words).upper()
    rows = [(i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in docs.collect()] + [(500, "!"), (501, None)]
    made = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id bigint, text string, print string, id int, component_id int")
    prints = [(k, plain_print(t)) for k, t in rows]
    expected = sorted(((k is None, k or 0, f"{p:016x}", c is None, c or 0) for (k, p), c in zip(prints, plain_classes(prints))))
    got = covering_simhash.classes(made).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id is None, r.component_id or 0) for r in got) == expected
    assert len({e[4] for e in expected}) < len({e[2] for e in expected})
    assert covering_simhash.classes(empty).count() == 0


@pytest.mark.parametrize("bucket", [2048, 6])
def test_links_miss_no_pair(spark, bucket):
    """Dense and sparse fingerprints; with buckets of six, most are covered again."""
    chance = random.Random(bucket)
    values = {chance.getrandbits(64) for _ in range(50)}
    for centre in list(values)[:8]:
        for _ in range(60):
            values.add(centre ^ sum(1 << b for b in chance.sample(range(64), chance.choice([1, 2, 4, 5, 6]))))
    values |= {0, (1 << 64) - 1, 1 << 63, 0b11111}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = [(v & (1 << 64) - 1,) * 2 for v in signed]
    found = covering_simhash.links(spark.createDataFrame([(v,) for v in signed], "print bigint"), bucket=bucket).collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 4 for r in found)
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        x, y = sorted((find(r.a & (1 << 64) - 1), find(r.b & (1 << 64) - 1)))
        root[y] = x
    assert [find(k) for k, _ in rows] == plain_classes(rows)


def test_masks_cover_every_radius():
    chance = random.Random(5)
    for radius, level in ((4, 0), (4, 1), (2, 0), (1, 3)):
        kept = covering_simhash.masks(radius, level)
        assert len(kept) == (2 << radius) - 1
        for _ in range(2000):
            differing = sum(1 << b for b in chance.sample(range(64), radius))
            assert any(not m & differing for m in kept)


def test_queries_of_all_rows(spark):
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in QUERIES["op13_covering_simhash"](spark, SF).collect()} == ids
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    prints = [(k, plain_print(t)) for k, t in rows]
    expected = {(k, f"{p:016x}", c) for (k, p), c in zip(prints, plain_classes(prints))}
    assert {tuple(r) for r in QUERIES["op13_covering_simhash"](spark, SF).collect()} == expected

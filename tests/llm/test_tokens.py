"""Token ids, bit planes and packing against plain loops."""

import io
import random
from collections import Counter
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import bit_planes, cost_packing
from ledgerloom.llm.queries import vocabulary
from ledgerloom.llm.tokens import Encoder, ended

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.fixture(scope="module", params=FILES)
def encoder(request):
    return Encoder(vocabulary(request.param), 100)


def whole(encoder, text):
    return encoder.whole.encode(text or "", add_special_tokens=False).ids


def test_units_encode_like_whole_texts(encoder, texts):
    ids, offsets = encoder.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == whole(encoder, text)


@given(st.lists(st.text(alphabet="aZé'.,!9 \n\t\xa0\u2003#-\u0301", max_size=30), max_size=5))
@settings(max_examples=60, deadline=None)
def test_any_texts_encode_alike(batch):
    for name in FILES:
        made = Encoder(vocabulary(name), 10)
        ids, offsets = made.encode(pa.array(batch, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [whole(made, t) for t in batch]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(["byte", "bit"]))
@settings(max_examples=60, deadline=None)
def test_planes_round_trip(ids, kind):
    ids = np.array(ids, dtype="<u4")
    assert bit_planes.from_planes(bit_planes.to_planes(ids, kind), len(ids), kind).tolist() == ids.tolist()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip_and_single_blocks(kind):
    random.seed(1)
    lists = [[random.randrange(60000) for _ in range(n)] for n in (1, 0, 5, 200, 64, 1)]
    stream = io.BytesIO()
    writer = bit_planes.Writer(stream, kind, block_ids=64)
    for i, ids in enumerate(lists):
        writer.add([i], np.array(ids, dtype="<u4"), np.array([len(ids)]))
    writer.close()
    size = stream.tell()
    assert [(k, v.tolist()) for k, v in bit_planes.documents(stream, size)] == list(enumerate(lists))
    flat = [x for ids in lists for x in ids]
    assert bit_planes.read_block(stream, bit_planes.footer(stream, size), 2).tolist() == flat[128:192]
    with pytest.raises(ValueError):
        bit_planes.footer(io.BytesIO(stream.getvalue()[:-1]), size - 1)


def test_written_files_hold_every_document_in_order(spark, docs, empty):
    path = vocabulary(FILES[0])
    rows = bit_planes.read(spark, bit_planes.write(docs, path, 0, block_ids=100)).collect()
    made = Encoder(path, 100)
    expected = []
    for d in docs.collect():
        ids = np.array(whole(made, d.text) + [0], "<u4")
        expected.append((d.doc_id is not None, d.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    rows = sorted(rows, key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted((a, b or 0, c, d) for a, b, c, d in expected)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: -1 if x is None else x)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert bit_planes.read(spark, bit_planes.write(empty, path, 0)).count() == 0


@given(st.lists(st.one_of(st.integers(1, 40), st.integers(1, 9000)), max_size=60))
@settings(max_examples=80, deadline=None)
def test_sequences_are_full_and_every_token_is_placed_once(lengths):
    pieces = cost_packing.pack(lengths)
    room, used, covered = cost_packing.capacities(sum(lengths)), {}, {}
    for doc, start, n, s, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == used.get(s, 0) and n > 0
        used[s] = offset + n
        covered.setdefault(doc, []).append((start, n))
    assert [used[s] for s in range(len(room))] == room
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(covered[doc]):
            assert start == at
            at += n
        assert at == length


def test_costs_are_even():
    random.seed(2)
    cost = {}
    for _, _, n, s, _ in cost_packing.pack([random.randint(50, 900) for _ in range(3000)]):
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    values = sorted(cost.values())[20:]  # but the remainder's short ones
    assert values[-1] < 1.5 * values[0]


def test_pieces_hold_the_ids(docs, empty):
    path = vocabulary(FILES[1])
    rows = cost_packing.pieces(docs, path, 1, pool_tokens=3000, with_ids=True).collect()
    made, total = Encoder(path, 100), 0
    for d in {(d.doc_id, d.text) for d in docs.collect()}:
        total += len(whole(made, d[1])) + 1
    by_sequence = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    copies = 2 * (len(whole(made, "It's a line.\nAnd it's another, isn't it?")) + 1)
    assert sum(r.length for r in rows) == total + copies
    long = sorted((r for r in rows if r.doc_id == 11), key=lambda r: r.start)
    ids = b"".join(r.ids for r in long)
    assert np.frombuffer(ids, "<u4").tolist() == whole(made, "word number %d " * 3000) + [1]
    assert cost_packing.pieces(empty, path, 1).count() == 0


def test_end_ids():
    ids, offsets = ended(np.array([5, 6, 7], "<u4"), np.array([0, 2, 2, 3]), 9)
    assert ids.tolist() == [5, 6, 9, 9, 7, 9] and offsets.tolist() == [0, 3, 4, 6]


def test_packing_takes_the_cheapest_with_room():
    """Against a look at every open sequence; a document is cut only where none holds it whole."""
    for seed in range(6):
        random_ = random.Random(seed)
        lengths = [random_.choice((random_.randint(1, 2047), random_.randint(500, 1100))) for _ in range(500)]
        room, used, cost, of = cost_packing.capacities(sum(lengths)), Counter(), Counter(), {}
        for piece in cost_packing.pack(lengths):
            of.setdefault(piece[0], []).append(piece)
        for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
            left = lengths[doc]
            for _, _, n, s, _ in of[doc]:
                fits = [(cost[t], t) for t in range(len(room)) if room[t] - used[t] >= left]
                assert not fits or (n == left and (cost[s], s) == min(fits))
                used[s], cost[s], left = used[s] + n, cost[s] + n + n * n / 1024, left - n

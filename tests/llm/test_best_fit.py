from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from paperloom.llm.best_fit import Rooms, pack_best_fit, plan
from paperloom.llm.packing import BatchEncoder
from tests.llm.test_packing import ODD

PATH = P.path("word_bpe_49k.json")


def brute(lengths, room):
    """The contents of all sequences, by best fit on every single piece."""
    open_, bins = [], []
    for n in sorted(lengths, reverse=True):
        k = bisect_left(open_, (n, -1))
        if k == len(open_):
            r, b = room, len(bins)
            bins.append([])
        else:
            r, b = open_.pop(k)
        bins[b].append(n)
        if r > n:
            insort(open_, (r - n, b))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_best_fit_on_every_piece(seed):
    rng = np.random.default_rng(seed)
    room = int(rng.choice([7, 64, 100, 1000]))
    lengths = np.clip(rng.lognormal(np.log(room) - 2, 1.2, 3000), 1, room).astype(int).tolist() + [room // 3] * int(rng.integers(0, 2000))
    places = plan(Counter(lengths), room)
    got, at = defaultdict(list), 0
    ends = [*places[1:, 0].tolist(), len(lengths)]
    for (first, n, each, sequence, offset), end in zip(places.tolist(), ends):
        assert first == at
        for i in range(end - first):
            got[sequence + i // each].append((offset + i % each * n, n))
        at = end
    assert Counter(n for s in got.values() for _, n in s) == Counter(lengths)
    assert sorted(sum(n for _, n in s) for s in got.values()) == sorted(map(sum, brute(lengths, room)))
    assert sorted(got) == list(range(len(got)))
    for s in got.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= room


def test_plan_follows_lengths_not_documents():
    few = plan(Counter(range(1, 500)), 4096)
    many = plan({n: 10**9 + 7 * n for n in range(1, 500)}, 4096)
    assert len(many) < 5 * len(few)
    assert plan({}, 4096).shape == (0, 5)


def test_tightest_room():
    rng, rooms, have = np.random.default_rng(1), Rooms(100), Counter()
    for _ in range(2000):
        if rng.random() < 0.5 or not +have:
            r = int(rng.integers(1, 101))
            rooms.open(r, 0, 1)
            have[r] += 1
        n = int(rng.integers(1, 101))
        r = rooms.tightest(n)
        assert r == min((x for x in +have if x >= n), default=-1)
        if r > 0:
            rooms.take(r)
            have[r] -= 1


@pytest.mark.parametrize("room,parts", [(4096, 3), (64, 7)])
def test_pieces(spark, sf, room, parts):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = docs.union(odd).repartition(parts).selectExpr("doc_id", "text", "'x' as piece", "1 as sequence_id", "0 as task")
    e = BatchEncoder(PATH)
    want = {r.doc_id: np.append(e([r.text])[0], 1) for r in docs.collect()}
    by_doc, by_seq, lengths = defaultdict(list), defaultdict(list), []
    for r in pack_best_fit(docs, PATH, max_tokens=room).collect():
        ids = want[r.doc_id]
        assert r.start == r.piece * room and r.length == min(room, len(ids) - r.start)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length].tolist()
        by_doc[r.doc_id].append(r.piece)
        by_seq[r.sequence_id].append((r.offset, r.length))
        lengths.append(r.length)
    assert all(sorted(by_doc[d]) == list(range(-(-len(x) // room))) for d, x in want.items())
    for s in by_seq.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= room
    assert len(by_seq) == len(brute(lengths, room))


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert pack_best_fit(spark.createDataFrame([], schema), PATH).count() == 0
    rows = [(None, "a b"), (None, "a b"), (3, None), (3, ""), (5, "word " * 9000)]
    got = pack_best_fit(spark.createDataFrame(rows, schema), PATH).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == [(0, 0, 3), (0, 0, 3), (3, 0, 1), (3, 0, 1), (5, 0, 4096), (5, 1, 4096), (5, 2, 809)]
    assert len({r.sequence_id for r in got}) == 3

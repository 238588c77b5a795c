import random
import re

import numpy as np
import pytest

from paperloom.llm.link_counts import overlaps
from paperloom.llm.ngram_join import _parity, ngram_jaccard_classes


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def grams(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=4, num=85, den=100):
    sets = [grams(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and den * k >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def copies(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, at = [], 0
    for _ in range(12):
        base = rng.choices(vocab, k=rng.choice([3, 5, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab) + "x" * rng.randrange(2)
            rows.append((at, " ".join(w)))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bits", [8, 20])
def test_same_classes_as_brute_force(spark, seed, bits):
    rows = copies(seed) + [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One two"), (9004, "one\x0btwo"), (9005, "x " * 30000), (9006, "x x x x")]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, node string")
    got = sorted(map(tuple, ngram_jaccard_classes(df, sketch_bits=bits).collect()))
    assert got == brute(rows)


def test_real_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, ngram_jaccard_classes(df).collect())) == brute(rows)


def test_parity_bitmaps_never_differ_in_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(1)
    for n in (0, 1, 40, 400, 5000):
        a, new = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n // 3, dtype=np.uint64)
        b = np.concatenate([a[n // 7 :], new])
        bits = sum(int(x).bit_count() for x in (_parity(a) ^ _parity(b)).view(np.uint64))
        assert bits <= n // 7 + len(new)
    assert (_parity(a[::-1]) == _parity(a)).all()


@pytest.mark.parametrize("slab", [1, 7, 4096])
def test_overlaps_of_blocks(monkeypatch, slab):
    monkeypatch.setattr("paperloom.llm.link_counts.SLICE", slab)
    rng = np.random.default_rng(2)
    sets = [rng.choice(60, k, replace=False).astype(np.uint64) << np.uint64(50) for k in (0, 1, 3, 20, 40, 60, 25)]
    sets.append(np.concatenate([sets[3], sets[3]]))
    size = lambda x, y: len(np.intersect1d(x, y))
    assert (overlaps(sets, None) == [[size(x, y) for y in sets] for x in sets])[~np.eye(8, dtype=bool)].all()
    assert (overlaps(sets[:3], sets[3:]) == [[size(x, y) for y in sets[3:]] for x in sets[:3]]).all()
    assert overlaps(sets[:1], sets[:1]).tolist() == [[0]] and overlaps(sets[:1], None).tolist() == [[0]]


@pytest.mark.parametrize("block", [100, 1024])
def test_hot_shingles_and_classes_are_dealt_out(spark, monkeypatch, block):
    monkeypatch.setattr("paperloom.llm.common.HOT_ROWS", 64)
    monkeypatch.setattr("paperloom.llm.link_counts.ROWS", block)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(900):
        w = list(base)
        w[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, rows[7][1]) for i in range(700)] + [(5000 + i, " ".join(base[:40] + [f"o{i}_{j}" for j in range(20)])) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_jaccard_classes(df, sketch_bits=16, count_links=True).collect()))
    assert [r[:3] for r in got] == brute(rows)
    sets = [grams(t, 4) for _, t in rows]
    some = {d: sum(100 * len(s & t) >= 85 * len(s | t) for t in sets) - 1 for (d, _), s in zip(rows, sets) if d % 97 == 0}
    assert {d: k for d, _, _, k in got if d in some} == some


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_classes(df).count() == 0
    df = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (1, "A b c d E")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_jaccard_classes(df).collect())) == [(1, 2, 1), (3, 2, 1), (3, 2, 1)]


def test_links_equal_brute_force(spark):
    rows = copies(3) + [(9000, None), (9001, ""), (9003, "One two"), (9004, "one\x0btwo"), (9004, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_jaccard_classes(df, sketch_bits=12, count_links=True).collect()))
    sets = [grams(t, 4) for _, t in rows]
    links = [sum(i != j and bool(x & y) and 100 * len(x & y) >= 85 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
    assert sum(links) > 500
    assert sorted((d, k) for d, _, _, k in got) == sorted((d, k) for (d, _), k in zip(rows, links))
    assert [r[:3] for r in got] == brute(rows)


def test_pairs_that_lead_each_other_count_once(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        base = [f"p{i}_{j}" for j in range(400)]
        for side in "ab":
            w = list(base)
            for at in rng.sample(range(8, 390), 3):
                w[at] = f"{side}{at}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_jaccard_classes(df, sketch_bits=16, count_links=True).collect()
    assert [r[:3] for r in sorted(map(tuple, got))] == brute(rows)
    assert {r.n_links for r in got} == {1}

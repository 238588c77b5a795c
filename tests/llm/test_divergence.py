import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperloom.llm import divergence as D


def brute(rows, least, top):
    docs = [(r[0] or "", r[1] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[2] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())

        def p(c):
            n = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // n for t in kept}

        ps, all_ = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(h, sum(f(ps[s][t], ps[h][t]) for t in kept)) for h in counts if h != s]
            terms = [(t, f(ps[s][t], all_[t])) for t in kept if counts[s][t] and ps[s][t] > all_[t]]
            for part, some, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                some.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, k + 1) for k, (t, v) in enumerate(some[:most])]
    return sorted(out)


WORDS = ["Alpha", "beta", "gamma", "delta", "Ünder", "ünder", "中文", "é", "\U0001f600", "ZZ", "junk", "x1y", "a_b"]


@pytest.mark.parametrize("block,slab", [(D.BLOCK, D.SLAB_BYTES), (5, 200)])
def test_equals_brute_force(spark, monkeypatch, block, slab):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "BLOCK_EACH", 1)
    monkeypatch.setattr(D, "SLAB_BYTES", slab)
    rng = random.Random(4)
    rows = [(rng.choice(["en", "en", "de", "", None]), rng.choice(["a", "a", "b", "é", None, ""]), " ".join(rng.choices(WORDS, k=rng.randrange(0, 30), weights=range(1, 14)))) for _ in range(150)]
    rows += [("en", "empty", None), ("en", "blank", " 12 _ "), ("lone", "one", "a a b"), ("none", "p", "q"), ("none", "r", None), ("en", "a", "alpha," * 5000)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5).selectExpr("*", "1 as term", "'x' as value", "map(1, 2) as part")
    got = D.audit_sources(df, least=3, top=6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 6)


def test_empty_table(spark):
    assert D.audit_sources(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_colliding_slices_stay_apart(monkeypatch):
    monkeypatch.setattr(D, "SLICES", 7)
    raw = b"abcdab" * 20
    s = np.arange(0, 118, 2)
    code, terms = D.group_slices(raw, s, s + 2, digest=lambda b: 7)
    assert [terms[c] for c in code] == [raw[a : a + 2] for a in s] and sorted(set(terms)) == sorted(terms)


def test_counts_beyond_a_long_product():
    n = np.array([0, 3, 10**10, 9 * 10**13], np.int64)
    total = np.array([7, 9, 10**12 + 1, 10**14 - 1], np.int64)
    assert D.probability(n, total).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, total)]


def test_sums_of_empty_runs():
    assert D.sums_of(np.arange(5), np.array([0, 0, 2, 2, 5, 5])).tolist() == [0, 1, 0, 9, 0]


def test_ties_rank_by_bytes(spark):
    rows = [("l", s, "é z a ~ b") for s in "wxyz"] + [("l", "v", "q") for _ in range(3)]
    got = defaultdict(list)
    for r in D.audit_sources(spark.createDataFrame(rows, "lang string, source string, text string")).orderBy("rank").collect():
        got[r.source, r.part].append(r.item)
    assert got["w", "term"] == ["a", "b", "z", "é"] and got["v", "pair"] == ["w", "x", "y", "z"]

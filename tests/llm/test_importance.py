import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import importance as M


def runs(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, num=5, den=100, least=20, buckets=10000):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    told = [(d, *runs(t)) for d, t in rows]
    s, t = Counter(of(f) for _, _, fs in told for f in fs), Counter(of(f) for x in target for f in runs(x)[1])
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for d, n, fs in told:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(of(f)) for f in fs)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: num * len(able) // den]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


WORDS = "the Quick brown fox Über é 12 a1 中文 x-y q_r jumps over".split()


@pytest.mark.parametrize("num,copies", [(5, 4096), (60, 3), (100, 1)])
def test_equals_brute_force(spark, monkeypatch, num, copies):
    monkeypatch.setattr(M, "COPIES", copies)
    rng = random.Random(num)
    rows = [(rng.choice([rng.randrange(500), None, 7]), " ".join(rng.choices(WORDS, k=rng.randrange(0, 60)))) for _ in range(300)]
    rows += [(7, "the quick brown fox " * 9)] * 40 + [(None, "é " * 30)] * 9 + [(1, None), (2, ""), (3, "a" * 200 + " b " * 30), (4, "the " * 20000), (5, "z" * 10**6)]
    target = ["the quick brown fox jumps over", None, "", "Über é"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "1 as score", "map(1, 2) as rank", "2 as n_words")
    got = M.importance_resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), num=num)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(rows, target, num=num)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), [(k, "w " * (15 + k)) for k in range(30)]
    assert M.importance_resample(none, none).count() == 0
    got = M.importance_resample(spark.createDataFrame(one, "doc_id long, text string"), none)
    assert Counter(map(tuple, got.collect())) == brute(one, []) and got.where("rank is not null").count() == 1


def test_joined_checksums_equal_zlib():
    rng = random.Random(2)
    texts = [None, "", " -- ", "one", "Two words", "a" * 64 + " " + "b" * 65 + " c " + "d" * 66 + " " + "e" * 1000] + ["".join(rng.choices("aZ9é .中-", k=rng.randrange(40))) for _ in range(300)]
    got, first = M.features(pa.array(texts, pa.string()), 10007)
    for i, t in enumerate(texts):
        part = got[first[i] : first[i + 1]]
        n, fs = runs(t)
        assert len(part) == n and [x for k in range(3) for x in part[: max(0, n - k), k].tolist()] == [zlib.crc32(f.encode()) % 10007 for f in fs]
        assert (part[max(0, n - 1) :, 1:] == -1).all() and (part[max(0, n - 2) :, 2] == -1).all()


def test_gains_follow_the_formula():
    s, t = np.array([0, 5, 10**6]), np.array([3, 0, 7])
    assert M.gains(s, t).tolist() == [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + 3) / ((a + 1) * (int(t.sum()) + 3)))) for a, b in zip(s.tolist(), t.tolist())]

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.llm import gam


def test_features_of_odd_texts():
    texts = [None, "", " \n ", "Hello world!", "a | b | c\na | b | c\n", "é" * 10, "x" * 100000, "A!! B!!"]
    x = gam.features(pa.array(texts))
    assert x.shape == (len(texts), len(gam.FEATURES)) and np.isfinite(x).all() and not x[:2].any()
    f = {k: x[:, i] for i, k in enumerate(gam.FEATURES)}
    assert f["same_lines"][4] == 0.5 and f["pipes"][4] == 4 / 10 and f["high_bytes"][5] == 1 and f["shouts"][7] == 2 and f["upper"][3] == 0.1
    for i, t in enumerate(texts):  # a batch gives what its rows give alone
        assert np.allclose(gam.features(pa.array([t], pa.string()))[0], x[i])


def test_trees_equal_brute_force():
    rng = np.random.default_rng(0)
    g, h = rng.standard_normal(9), rng.random(9) + 0.1

    def part(a, b):
        return g[a:b].sum() ** 2 / (h[a:b].sum() + 1)

    t = gam._tree(g, h, 2)
    c = max(range(1, 9), key=lambda c: part(0, c) + part(c, 9))
    assert np.allclose(t[:c], -g[:c].sum() / (h[:c].sum() + 1)) and np.allclose(t[c:], -g[c:].sum() / (h[c:].sum() + 1))
    g2, h2 = rng.standard_normal((5, 4)), rng.random((5, 4)) + 0.1
    t2, _ = gam._tree2(g2, h2)
    best = max(itertools.product(range(1, 5), range(1, 4)), key=lambda ab: sum(g2[i, j].sum() ** 2 / (h2[i, j].sum() + 1) for i in (slice(0, ab[0]), slice(ab[0], 5)) for j in (slice(0, ab[1]), slice(ab[1], 4))))
    for i in (slice(0, best[0]), slice(best[0], 5)):
        for j in (slice(0, best[1]), slice(best[1], 4)):
            assert np.allclose(t2[i, j], -g2[i, j].sum() / (h2[i, j].sum() + 1))


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    m = gam.Model().fit(x[:2000], y[:2000], np.ones(2000))
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    assert (2, 0) in [(i, j) for i, j, _ in m.pairs]
    one = m.logits(x[:1])[0]
    b = m._binned(x[:1])[0]
    assert np.isclose(one, m.base + sum(t[b[k]] for k, t in enumerate(m.tables)) + sum(t[m._wide(b[i], i), m._wide(b[j], j)] for i, j, t in m.pairs))


def test_held_out_accuracy_and_odd_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = gam.fit(docs, labels, ~held)
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 100000)], "doc_id long, text string")
    rows = {r.doc_id: r.score for r in gam.score_quality(docs.select("doc_id", "text").union(odd), model).collect()}
    assert len(rows) == docs.count() + 3 and all(0 <= s <= 1 for s in rows.values())
    test = labels.where(held).collect()
    assert sum((rows[r.doc_id] >= 0.5) == r.quality for r in test) / len(test) > 0.95


def test_few_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in gam.score_quality(docs, gam.fit(docs, labels, F.lit(True))).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, None), (2, 7)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in gam.score_quality(docs, gam.fit(docs, labels, F.lit(True))).collect())


def test_repeated_ids_stay_within_the_bound(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("7 as doc_id", "concat('text number ', id % 1500) as text").union(spark.range(300).selectExpr("id + 10", "concat('| ', id, ' |')"))
    labels = spark.createDataFrame([(7, 1), (7, 1)] + [(10 + i, 0) for i in range(300)] + [(11, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(gam.Model, "fit", lambda self, x, y, w: seen.append((x, y, w)) or self)
    gam.fit(docs, labels, F.lit(True), per_class=100)
    ((x, y, w),) = seen
    assert len(x) == len(w) and 50 <= (y == 1).sum() <= 100 and (y == 0).sum() == 100
    gam.fit(docs, labels, F.lit(True), per_class=10**6)
    assert (seen[1][1] == 1).sum() == 1501 and (seen[1][1] == 0).sum() == 300

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import queries
from paperloom.llm.binary_codes import _signs_apart, encode, near_vectors, rotation, upper_bounds
from paperloom.llm.maxscore import long_and_rest, search_shard, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def rows(seed, n=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x[50:120] = x[3] + 0.25 * rng.standard_normal((70, d))
    x[120:140] = x[7] * rng.uniform(0.1, 5, (20, 1))
    x[140:150] = x[9]
    out = [(i, [float(v) for v in r], 0, "z") for i, r in enumerate(x)]
    odd = [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] * d, [1.0, 2.0]]
    return out + [(1000 + i, v, 1, "z") for i, v in enumerate(odd)] + [out[5]]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_vectors(spark, monkeypatch, seed):
    monkeypatch.setattr("paperloom.llm.common.HOT_ROWS", 64)
    data = rows(seed)
    df = spark.createDataFrame(data, SCHEMA)
    got = {}
    for r in near_vectors(df, miss=1e-5, width=6.0).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in data if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.stack([v for _, v in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    label = np.arange(len(ok))
    for _ in range(len(ok)):
        new = np.array([label[near[i]].min() for i in range(len(ok))])
        if (new == label).all():
            break
        label = new
    least = {}
    for i, (v, _) in enumerate(ok):
        least[label[i]] = min(v, least.get(label[i], v))
    for i, (v, _) in enumerate(ok):
        want = (int(near[i].sum()) - 1, least[label[i]], v == least[label[i]])
        assert all(g == want for g in got[v]), v
    assert got[1000] == [(0, 1000, True)] and got[1006] == [(0, 1006, True)] and sum(map(len, got.values())) == len(data)


@pytest.mark.parametrize("seed", [5, 6])
def test_recall_of_the_registered_parameters(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((150, 64))
    x = np.concatenate([base + s * rng.standard_normal((150, 64)) for s in (0, 0.2, 0.3, 0.33, 0.36)] + [base[:1] + 0.3 * rng.standard_normal((400, 64)), np.repeat(base[3:4], 200, 0)])
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in near_vectors(df, threshold=0.9).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() and want.sum() > 40000
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_sketches_of_near_pairs_are_near():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * side / np.linalg.norm(side, axis=1, keepdims=True)
    turns = np.concatenate([rotation(64, 1), rotation(64, 2)])
    apart = ((x @ turns.T >= 0) != (y @ turns.T >= 0)).sum(axis=1)
    assert apart.max() <= _signs_apart(0.9) < 48


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    d, n = 64, 4000
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.06 * rng.standard_normal((n, d))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    turn = rotation(d)
    sign, factor, _, _ = encode(x, turn)
    _, _, small, step = encode(y, turn)
    signs = np.unpackbits(sign, axis=1).astype(np.float32) * 2 - 1
    true = (x * y).sum(axis=1)
    est = np.einsum("ij,ij->i", signs, small.astype(np.float32)) * step / 8 / factor
    assert abs((est - true).mean()) < 0.005
    assert (upper_bounds(signs, factor, small, step, 4.0) >= true).mean() > 0.9995


def best_of(data, scale=64, every=20, k=20):
    """All (query_id, rank, vec_id, score) by comparing each asking row with each row."""
    width = max(len(v) for _, v in data)
    ok = [(i, np.floor(scale * np.pad(v, (0, width - len(v)))).astype(int)) for i, v in data]
    out = []
    for i, q in ok:
        if i % every == 0:
            found = sorted((-int(q @ v), j) for j, v in ok if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def usable(data):
    return [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in data if v is not None and None not in v and np.isfinite(v).all()]


@pytest.mark.parametrize("shard,block", [(8192, 2048), (37, 5)])
@pytest.mark.parametrize("scale", [64, 100000])
def test_top_k(spark, shard, block, scale):
    data = rows(4) + [(20, [0.5] * 16, 2, "z"), (40, rows(4)[40][1], 2, "z")] + [(5000 + i, [0.25] * 16, 0, "z") for i in range(30)]
    df = spark.createDataFrame(data, SCHEMA)
    out = top_k(df, F.pmod(F.col("id"), F.lit(20)) == 0, scale=scale, shard_rows=shard, block_rows=block).collect()
    assert sorted(map(tuple, out)) == best_of(usable(data), scale)


def test_two_equal_query_rows_get_their_own_ranks(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0])] + [(i, [i / 10, 1.0]) for i in range(1, 9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, top_k(df, F.col("id") == 0, k=5, shard_rows=3, block_rows=1).collect()))
    one = [(0, r + 1, 8 - r, int(np.floor(64 * np.float64(np.float32((8 - r) / 10)))) * 64) for r in range(5)]
    assert got == sorted(one * 2)


@pytest.mark.parametrize("table", ["sf0.01", "sf0.001"])
def test_registered_query_equals_brute_force(spark, table):
    sf = f"/root/testdata/{table}"
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op7_exact_top_k(spark, sf).collect())) == best_of(usable(data))


def test_threshold_rises_and_is_carried():
    rng = np.random.default_rng(2)
    q, x = rng.integers(-60, 60, (5, 32)), rng.integers(-60, 60, (4000, 32))
    floors = np.full(5, -np.inf)
    for part in (slice(0, 2000), slice(2000, 4000)):
        search_shard(q, np.full(5, -1), x[part], np.arange(4000)[part], 10, floors)
        want = np.sort(q @ x[: part.stop].T, axis=1)[:, -10]
        assert (floors <= want).all()
    assert (floors >= np.sort(q @ x[:2000].T, axis=1)[:, -10]).all()


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_vectors(df).count() == 0
    assert top_k(df, F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("shard,block", [(8192, 2048), (3, 2)])
def test_components_beyond_exact_doubles(spark, shard, block):
    rng = np.random.default_rng(6)
    data = [(20, [1e20, 1.0]), (0, [1.0, 1.0]), (3, [2.0, 1.0]), (4, [1e25, 1.0]), (40, [-1e300, 1e300]), (60, [1.7e308, -3.0]), (5, [2.0**40 + 1, 0.5]), (6, [2.0**40, 0.5])]
    data += [(100 + i, [float(x) * 10.0 ** int(rng.integers(0, 40)), float(y)]) for i, (x, y) in enumerate(rng.standard_normal((40, 2)))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(df, F.col("id") % 20 == 0, k=9, shard_rows=shard, block_rows=block).collect()))
    whole = [(i, [int(np.floor(x * 64)) if abs(x * 64) < np.inf else int(x) * 64 for x in v]) for i, v in data]
    want = []
    for i, q in whole:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)[:9]
            want += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_rests_order_scores():
    scores = sorted(s * (2**k + d) for s in (1, -1) for k in (0, 10, 62, 63, 64, 65, 68, 200) for d in (0, 1))
    assert sorted(scores, key=long_and_rest) == scores


def test_a_failing_search_leaves_no_tables(spark):
    from pathlib import Path

    from paperloom.llm.common import shared_root

    root = Path(shared_root(spark).removeprefix("file://"))
    before = set(root.glob("paperloom-*"))
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception):
        top_k(df.selectExpr("vec_id", "if(vec_id = 1, array(double(raise_error('x'))), embedding) as embedding"), F.col("id") > 0)
    assert set(root.glob("paperloom-*")) == before


def test_a_bucket_with_many_rows_is_dealt_out_at_the_default_limit(spark):
    from paperloom.llm.common import spread_join

    left = spark.range(6000).selectExpr("if(id < 5000, 1, id) as v", "id as a")
    counts = left.groupBy("v").agg(F.count("*").alias("k"))
    joined = spread_join(left, left.withColumnRenamed("a", "b"), ["v"], counts, 6000, F.xxhash64("a"), pairs=5000**2 + 1000)
    assert "__salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.where("a <= b").count() == 5000 * 5001 // 2 + 1000
    plain = spread_join(left, left.withColumnRenamed("a", "b"), ["v"], counts, 6000, F.xxhash64("a"))
    assert "__salt" not in plain._jdf.queryExecution().optimizedPlan().toString()

"""Embedding near-duplicates by randomised-rotation binary codes.

Unit vectors are turned by a random orthogonal matrix P.  A vector o is stored as the signs of Po (a
point s / sqrt(D) of a cube) with its correction factor f = <s / sqrt(D), Po>, and as 8-bit components.  For two
vectors, <s / sqrt(D), Pq> / f is an unbiased estimate of <o, q>, with standard error
sqrt((1 - f^2) / f^2 / (D - 1)) times the part of q across o.  Pairs whose upper confidence bound is below the
threshold are dropped; the rest are recomputed exactly, in double precision, and only the exact value links.

Pairs are looked for in buckets: ``tables`` keys of ``bits`` signs of random projections each, with
tables chosen so that a pair at the threshold is missed with probability ``miss`` at most.  All vectors
are indexed; an index row holds the bucket, the vector's name and SKETCH signs of rotations, no copy of
the vector or its code.  Pairs of a bucket whose sketches differ in more signs than those of a linked pair do
(but with probability SLIP) go no further; the others are told apart from those of other tables, and codes,
and after them vectors, are fetched once a pair.  Equal vectors are one node with a count, so copies never meet.
The rows of a large bucket, node or class are dealt to several tasks.

Null, empty and zero vectors and such with null or non-finite components: n_links 0, own component.
Vectors of other length than another link with nothing of it.  Repeated rows count as links of each other.
A null id takes no part in the minimum.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, in_workspace, map_arrow, safe_columns, spread_join
from .components import components

SEED = 77
#: Signs of a sketch, and the probability that a linked pair's sketches differ in more signs than allowed.
SKETCH, SLIP = 128, 1e-6


def rotation(d: int, k: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + d + (k << 20)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signs (packed), correction factors, 8-bit components and their steps, of unit rows."""
    y = x @ turn.T
    signs = y >= 0
    factor = np.abs(y).sum(axis=1) / math.sqrt(x.shape[1])
    step = np.abs(y).max(axis=1) / 127
    small = np.round(y / np.maximum(step, 1e-300)[:, None]).astype(np.int8)
    return np.packbits(signs, axis=1), factor.astype(np.float32), small, step.astype(np.float32)


def upper_bounds(signs: np.ndarray, factor: np.ndarray, small: np.ndarray, step: np.ndarray, width: float) -> np.ndarray:
    """Upper confidence bounds of <o, q> for codes o (signs as +-1, factors) and q (8-bit components, steps), row by row."""
    d = signs.shape[1]
    estimate = np.einsum("ij,ij->i", signs, small.astype(np.float32)) * step / math.sqrt(d) / factor
    c = np.clip(estimate, -1, 1)
    error = np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(1, d - 1))
    return estimate + width * error * np.sqrt(1 - c * c) + 0.02


def _plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a key, and number of tables."""
    bits = int(np.clip(round(math.log2(max(n, 2)) - 4), 6, 40))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - p))


def _signs_apart(threshold: float) -> int:
    """The most signs in which sketches of a pair at the threshold differ, but with probability SLIP.

    The signs of one rotation are less spread than independent ones, for which the bound holds.
    """
    p, tail = math.acos(threshold) / math.pi, 0.0
    for k in range(SKETCH, -1, -1):
        tail += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if tail > SLIP:
            return k
    return 0


def _by_width(batch: pa.RecordBatch, sizes: np.ndarray):
    """The rows of each vector length, with their places."""
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), batch.take(pa.array(at))


def _unit(column: pa.Array, d: int) -> np.ndarray:
    x = np.asarray(column.flatten()).reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(d, bucket, node, s0, s1): a row per vector and table."""

    def run(batches):
        for batch in batches:
            for d, own in _by_width(batch, np.asarray(batch.column(2))):
                x = _unit(own.column(1), d)
                plane = np.random.default_rng(SEED).standard_normal((bits * tables, d))
                turns = np.concatenate([rotation(d, k) for k in range(1, 1 + -(-SKETCH // d))])[:SKETCH]
                sketch = np.packbits(x @ turns.T >= 0, axis=1).view(np.int64)
                for i in range(0, len(x), 2048):
                    part = slice(i, i + 2048)
                    keys = ((x[part] @ plane.T >= 0).reshape(-1, tables, bits) << np.arange(bits)).sum(axis=2) + (np.arange(tables) << bits)
                    names = np.asarray(own.column(0))[part]
                    yield {"d": np.full(keys.size, d), "bucket": keys.ravel(), "node": np.repeat(names, tables), "s0": np.repeat(sketch[part, 0], tables), "s1": np.repeat(sketch[part, 1], tables)}

    return map_arrow(nodes.select("node", "vector", "d"), "d int, bucket long, node long, s0 long, s1 long", run)


def _codes(nodes: DataFrame) -> DataFrame:
    """(node, code, factor, small, step) of each vector."""

    def run(batches):
        for batch in batches:
            for d, own in _by_width(batch, np.asarray(batch.column(2))):
                sign, factor, small, step = encode(_unit(own.column(1), d), rotation(d))
                yield {"node": own.column(0), "code": [r.tobytes() for r in sign], "factor": factor, "small": [r.tobytes() for r in small], "step": step}

    return map_arrow(nodes.select("node", "vector", "d"), "node long, code binary, factor float, small binary, step float", run)


def _fetch(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with what stands for a and b; a vector with many pairs is dealt out."""
    total, count = pairs.count(), lambda c: pairs.groupBy(c).agg(F.count("*").alias("k"))
    return spread_join(spread_join(pairs, a, ["a"], count("a"), total, F.xxhash64("b")), b, ["b"], count("b"), total, F.xxhash64("a"))


@in_workspace
def near_vectors(vectors: DataFrame, ws: Workspace, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, miss: float = 0.005, width: float = 4.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; links are pairs with cosine >= threshold."""
    v = safe_columns(vectors, vec_id=F.col(id_col), vector=F.col(vector_col).cast("array<double>"))
    fine = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    v = ws.table(v.withColumn("node", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("vector"))), "rows")
    nodes = ws.table(v.where("node IS NOT NULL").groupBy("node", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumn("d", F.size("vector")), "nodes")
    n = nodes.count()
    index = ws.table(_index(nodes, *_plan(n, threshold, miss)), "index")

    # Pairs of a bucket whose sketches are near, once each; rows of single buckets find no partner.
    x, y = (index.select("bucket", "d", *[F.col(c).alias(c + s) for c in ("node", "s0", "s1")]) for s in "ab")
    sizes = index.groupBy("bucket").agg(F.count("*").alias("k"))
    apart = F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))) + F.bit_count(F.col("s1a").bitwiseXOR(F.col("s1b")))
    total, both = sizes.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0))).first()
    met = spread_join(x, y, ["bucket", "d"], sizes, total, F.xxhash64("nodea"), pairs=both).where("nodea < nodeb").where(apart <= _signs_apart(threshold))
    pairs = ws.table(met.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct(), "pairs")
    ws.drop("index")

    def estimate(batches):
        for batch in batches:
            for d, own in _by_width(batch, pc.binary_length(batch.column(4)).to_numpy(zero_copy_only=False)):
                blob = lambda c, kind, w: np.frombuffer(b"".join(own.column(c).to_pylist()), kind).reshape(-1, w)
                signs = np.unpackbits(blob(2, np.uint8, -(-d // 8)), axis=1)[:, :d].astype(np.float32) * 2 - 1
                hit = upper_bounds(signs, np.asarray(own.column(3)), blob(4, np.int8, d), np.asarray(own.column(5)), width) >= threshold
                yield {"a": np.asarray(own.column(0))[hit], "b": np.asarray(own.column(1))[hit]}

    def exact(batches):
        for batch in batches:
            for d, own in _by_width(batch, np.asarray(batch.column(2).value_lengths())):
                hit = np.einsum("ij,ij->i", _unit(own.column(2), d), _unit(own.column(3), d)) >= threshold
                yield {"a": np.asarray(own.column(0))[hit], "b": np.asarray(own.column(1))[hit]}

    codes = ws.table(_codes(nodes), "codes")
    coded = _fetch(pairs, codes.select(F.col("node").alias("a"), "code", "factor"), codes.select(F.col("node").alias("b"), "small", "step"))
    open_ = ws.table(map_arrow(coded.select("a", "b", "code", "factor", "small", "step"), "a long, b long", estimate), "open")
    whole = lambda c: nodes.select(F.col("node").alias(c), F.col("vector").alias("v" + c))
    links = ws.table(map_arrow(_fetch(open_, whole("a"), whole("b")).select("a", "b", "va", "vb"), "a long, b long", exact), "links")

    total = links.count()
    ends = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other")
    others = spread_join(ends, nodes.select(F.col("node").alias("other"), "copies"), ["other"], ends.groupBy("other").agg(F.count("*").alias("k")), 2 * total, F.xxhash64("node"))
    others = others.groupBy("node").agg(F.sum("copies").alias("others"))
    own = nodes.select("node", "copies", "least").join(components(links, ws), "node", "left").join(others, "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = ws.table(own.select("node", "label", "least", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "own")
    classes = own.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    known = spread_join(own.select("label", "node", "n_links"), classes.drop("k"), ["label"], classes.select("label", "k"), n, F.xxhash64("node")).drop("label")
    out = spread_join(v.select("node", "vec_id"), known, ["node"], own.select("node", F.col("copies").alias("k")), v.count(), F.monotonically_increasing_id(), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return ws.result(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))

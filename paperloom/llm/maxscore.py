"""Exact top-k inner-product search by MaxScore.

A dimension is a term, a component its impact, and a dimension's column in a shard its postings.  For
a query, each term's score is bounded by the shard's extremes; the terms are ordered by bound, and those of
smallest bound that cannot reach the current threshold together are non-essential.  The essential
postings are traversed; the other terms are probed, a few at a time, only for the rows that can still
reach the threshold.  The threshold starts at the k-th best of a few rows scored in full, or at the k-th best
of the shards that the task has searched before, and rises with the k-th best of the partial scores, each plus
the least that its remaining terms can add.  Each shard gives its own k best per query, and the shards are merged.

Queries are cut into blocks and rows into shards, both of bounded size.  The query blocks, the smaller
side, are copied to every shard; a task holds one shard and lets the blocks stream by.  So no side is
broadcast, no key is hot, and no shard is copied.

Null vectors and vectors with null or non-finite components take no part; vectors of unequal length
are padded with zeros.  Components too large for exact products in doubles take whole numbers of any size: such rows
and queries have shards and blocks of their own, which are searched one by one.  A score beyond a long is
given as the nearest long, and ranks by its true value.  Ties go to the smaller id.  A row never finds itself: rows with the query's
id are left out.  Fewer rows than k: all are returned.  Repeated rows are rows of their own: each is
found by itself, and each row that asks gets its own k ranks.  An empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.session import ship_package

from .common import Workspace, in_workspace, map_arrow, partitions, safe_columns


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows, by score and then smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def search_shard(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None, step: int = 8, seeds: int = 512):
    """(query place, row id, score) arrays of each query's k best rows of the shard; rows below ``floors`` may be left out.

    floors: for each query a score that k rows are known to reach; it is raised in place.
    """
    most = max(1.0, float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1]))
    kind = np.float32 if most < 2**24 else np.float64
    q, columns = queries.astype(kind), np.ascontiguousarray(rows.T.astype(kind))
    high, low = columns.max(axis=1), columns.min(axis=1)
    floors = np.full(len(q), -np.inf) if floors is None else floors
    out = []
    for i in range(len(q)):
        bound, least = np.maximum(q[i] * high, q[i] * low), np.minimum(q[i] * high, q[i] * low)
        order = np.argsort(-bound, kind="stable")
        w = q[i][order]
        # What the terms from a place on can add at most, and at least.
        rest, sure = (np.concatenate([np.cumsum(x[order][::-1])[::-1], [0]]) for x in (bound, least))
        own = ids == query_ids[i]
        first = np.flatnonzero(~own[: seeds + 1])
        seed = np.sort(q[i] @ columns[:, first])
        floor = max(floors[i], seed[-k] if len(seed) >= k else -np.inf)
        # Terms from `split` on are non-essential: their bounds together stay below the threshold.
        split = int(np.argmax(rest < floor)) if np.isfinite(floor) and (rest < floor).any() else len(w)
        split = max(1, split) if len(w) else 0
        part, alive, at = np.zeros(len(ids), kind), np.flatnonzero(~own), 0
        for at in [*range(0, split, step), *range(split, len(w), step)]:
            end = min(at + step, split) if at < split else min(at + step, len(w))
            terms = order[at:end]
            # Whole columns are read while most rows are alive.
            if len(alive) == len(part):
                part = part + w[at:end] @ columns[terms]
            else:
                part[alive] += w[at:end] @ columns[np.ix_(terms, alive)]
            if len(alive) >= k:
                now = part[alive]
                floor = max(floor, float(np.partition(now, len(now) - k)[len(now) - k] + sure[end]))
                alive = alive[now + rest[end] >= floor]
        best = _best(part[alive], ids[alive], k)
        score = part[alive][best]
        if len(best) == k:
            floors[i] = max(floors[i], float(score[-1]))
        out.append((np.full(len(best), i), ids[alive][best], score))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3


def search_large(queries: list[list[int]], query_ids: np.ndarray, rows: list[list[int]], ids: np.ndarray, k: int):
    """As search_shard, for whole numbers of any size: every row is scored in full."""
    width = max(map(len, (*queries, *rows)), default=0)
    columns = np.array([r + [0] * (width - len(r)) for r in rows], object).reshape(len(rows), width).T
    out = []
    for i, q in enumerate(queries):
        scores = np.array(q + [0] * (width - len(q)), object) @ columns if width else [0] * len(rows)
        found = heapq.nsmallest(k, ((-x, j) for x, j in zip(scores, ids.tolist()) if j != query_ids[i]))
        out += [(i, j, -x) for x, j in found]
    return ([x[n] for x in out] for n in range(3))


def long_and_rest(score: int) -> tuple[int, str]:
    """The nearest long, and a text that orders scores of one long."""
    if -(1 << 63) <= score < 1 << 63:
        return score, "~" if score < 0 else ""
    digits = f"{abs(score):x}"
    key = f"{len(digits):08x}{digits}"
    return ((1 << 63) - 1, key) if score > 0 else (-(1 << 63), "".join(f"{15 - int(c, 16):x}" for c in key) + "~")


def _packed(vectors: DataFrame, name: str) -> DataFrame:
    """One row per group: its ids and its matrix, in the least integer type that holds it, as blobs; large rows stay doubles of any length."""

    def pack(batch):
        import pyarrow as pa

        ids = np.asarray(batch["id"]).astype("<i8").tobytes()
        if batch.num_rows and batch["raw"][0].is_valid:
            rows = [np.asarray(v.values, "<f8") for v in batch["raw"]]
            blob, kind = np.concatenate([np.array([len(rows), *map(len, rows)], "<f8"), *rows]).tobytes(), "large"
        else:
            rows = [np.asarray(v.values) for v in batch["vector"]] if batch.num_rows else []
            m = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
            for i, v in enumerate(rows):
                m[i, : len(v)] = v
            kind = next(k for k in ("i1", "<i2", "<i4", "<i8") if not m.size or (np.iinfo(k).min <= m.min() and m.max() <= np.iinfo(k).max))
            blob = m.astype(kind).tobytes()
        return pa.table({name: pa.array([batch[name][0].as_py()], pa.int64()), "ids": pa.array([ids]), "kind": pa.array([kind]), "blob": pa.array([blob])})

    ship_package(vectors.sparkSession)
    return vectors.groupBy(name).applyInArrow(pack, f"{name} long, ids binary, kind string, blob binary")


def _matrix(ids, kind, blob, scale: int):
    """The ids, and a matrix, or lists of whole numbers."""
    ids, kind = np.frombuffer(ids.as_buffer(), "<i8"), kind.as_py()
    if kind != "large":
        return ids, np.frombuffer(blob.as_buffer(), kind).reshape(len(ids), -1)
    flat = np.frombuffer(blob.as_buffer(), "<f8").tolist()
    sizes, at, out = [int(x) for x in flat[1 : 1 + int(flat[0])]], 1 + int(flat[0]), []
    for n in sizes:
        out.append([math.floor(x * scale) if abs(x * scale) < math.inf else int(x) * scale for x in flat[at : at + n]])
        at += n
    return ids, out


#: Queries of a task whose thresholds are carried from shard to shard (a double each); beyond, each shard starts anew.
CARRIED = 1 << 22


@in_workspace
def top_k(vectors: DataFrame, ws: Workspace, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, k: int = 20, shard_rows: int = 8192, block_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that the condition ``queries`` (on ``id``) selects."""
    spark = vectors.sparkSession
    v = safe_columns(vectors, id=F.col(id_col).cast("long"), vector=F.col(vector_col).cast("array<double>"))
    fine = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(fine)
    # Inner products of components up to this size are exact in doubles.
    width = v.agg(F.max(F.size("vector"))).first()[0] or 1
    exact = float(math.isqrt((2**53 - 1) // max(1, width)) - 1)
    large = F.exists("vector", lambda x: F.abs(x * scale) > exact)
    whole = F.when(~large, F.transform("vector", lambda x: F.floor(x * scale)))
    v = ws.table(v.select("id", whole.alias("vector"), F.when(large, F.col("vector")).alias("raw"), large.alias("large")), "vectors")
    found = {r["large"]: r for r in v.groupBy("large").agg(F.count("*").alias("n"), F.count_if(queries).alias("m")).collect()}
    cut = lambda of, c, most: -(-found[of][c] // most) if of in found else 0
    shards, more_shards = cut(False, "n", shard_rows), cut(True, "n", shard_rows // 16 + 1)
    blocks, more_blocks = cut(False, "m", block_rows), cut(True, "m", block_rows // 16 + 1)
    if not (shards + more_shards) * (blocks + more_blocks):
        return ws.result(spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"))
    # Rows that are alike must not fall into one shard: the place is dealt by row, from the written table's partitions.
    v = ws.table(v.withColumn("at", F.monotonically_increasing_id()), "rows")
    place = F.xxhash64("at")
    dealt = lambda few, many: F.when(F.col("large"), few + F.pmod(place, F.lit(max(1, many)))).otherwise(F.pmod(place, F.lit(max(1, few)))).cast("long")
    rows = _packed(v.withColumn("shard", dealt(shards, more_shards)), "shard")
    asked = _packed(v.where(queries).withColumn("block", dealt(blocks, more_blocks)), "block")
    shards += more_shards
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    names = ["shard", "block", "ids", "kind", "blob"]
    met = rows.withColumn("block", F.lit(-1).cast("long")).select(names).union(asked.select(names))
    # A shard's own row comes first, its query blocks after it.
    met = met.repartition(min(shards, 4 * partitions(spark)), "shard").sortWithinPartitions("shard", "block")

    def search(batches):
        shard = ids = data = None
        floors: dict[int, np.ndarray] = {}
        for batch in batches:
            for at_shard, block, own, kind, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1)), *(batch.column(i) for i in (2, 3, 4))):
                if block < 0:
                    shard, (ids, data) = at_shard, _matrix(own, kind, blob, scale)
                    continue
                if shard != at_shard:  # a shard without rows
                    continue
                qids, asks = _matrix(own, kind, blob, scale)
                if isinstance(data, list) or isinstance(asks, list):
                    lists = [x if isinstance(x, list) else x.astype(object).tolist() for x in (asks, data)]
                    at, found, scores = search_large(lists[0], qids, lists[1], ids, k)
                    score, rest = zip(*map(long_and_rest, scores)) if (at := np.array(at, np.int64)).size else ((), ())
                    yield {"query": block << 32 | at, "query_id": qids[at], "vec_id": found, "score": score, "rest": rest}
                    continue
                wide = max(data.shape[1], asks.shape[1])
                a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (data, asks))
                floor = floors.get(block, np.full(len(qids), -np.inf))
                if len(floors) * block_rows < CARRIED:
                    floors[block] = floor
                at, found, score = search_shard(b, qids, a, ids, k, floor)
                yield {"query": block << 32 | at, "query_id": qids[at], "vec_id": found, "score": score.astype(np.int64), "rest": np.where(score < 0, "~", "").tolist()}

    found = map_arrow(met, "query long, query_id long, vec_id long, score long, rest string", search)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("rest"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ws.result(best.select("query_id", "rank", "vec_id", "score"))

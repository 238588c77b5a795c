"""Numbers of links within classes, counted block against block: no pair is ever a row.

The nodes of a class are cut into blocks of at most about ``ROWS`` nodes and ``KEYS`` shingles, and each pair of
blocks is one group.  A group's shingles stand in the global order and are cut into slices; each slice's partial
overlaps are one matrix product, and their sum over the slices decides every pair of the two blocks at once.  Only
a node's count leaves the group.  Rows shipped grow with a class's nodes times its blocks, memory with two
blocks alone.  Classes of one block share groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import ship_package

from .common import partitions, spread_join

ROWS, KEYS, SLICE = 1024, 1 << 20, 4096


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """The sizes of the intersections of a's sets (rows) with b's (columns), or with a's own if there is no b."""
    both = a if b is None else a + b
    keys, row = np.concatenate(both), np.repeat(np.arange(len(both)), [len(s) for s in both])
    order = np.argsort(keys)
    keys, row = keys[order], row[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
    many = np.diff(first, append=len(keys))
    # A shingle counts if it stands on both sides, or twice on the one.
    left = np.add.reduceat((row < len(a)).astype(np.int64), first) if len(first) else many
    shared = many > 1 if b is None else (left > 0) & (left < many)
    inside = np.repeat(shared, many)
    row, col = row[inside], np.repeat(np.cumsum(shared) - 1, many)[inside]
    total = np.zeros((len(a), len(a if b is None else b)), np.int64)
    wide = int(shared.sum())
    for lo in range(0, wide, SLICE):
        some = slice(*np.searchsorted(col, (lo, lo + SLICE)))
        x = np.zeros((len(both), min(SLICE, wide - lo)), np.float32)
        x[row[some], col[some] - lo] = 1
        total += np.rint(x @ x.T if b is None else x[: len(a)] @ x[len(a) :].T).astype(np.int64)
    return total


def _tally(table: pa.Table, num: int, den: int) -> pa.Table:
    names = ("label", "i", "j", "block", "node", "n", "copies")
    label, i, j, block, node, n, copies = (table.column(c).to_numpy() for c in names)
    sets = [np.frombuffer(b"".join(p), np.uint64) for p in table.column("parts").to_pylist()]
    order = np.lexsort((block, j, i, label))
    cut = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
    out_node, out_more = [], []
    for rows in np.split(order, cut):
        a, b = rows[block[rows] == i[rows[0]]], rows[block[rows] == j[rows[0]]]
        same = i[rows[0]] == j[rows[0]]
        if not len(a) or not len(b):
            continue
        k = overlaps([sets[r] for r in a], None if same else [sets[r] for r in b])
        link = den * k >= num * (n[a].astype(np.int64)[:, None] + n[b] - k)
        if same:
            np.fill_diagonal(link, False)
        link = link.astype(np.float64)
        for at, more in ((a, link @ copies[b]), *(((b, copies[a] @ link),) if not same else ())):
            out_node.append(node[at])
            out_more.append(more.astype(np.int64))
    return pa.table({"node": pa.array(np.concatenate([np.empty(0, np.int64), *out_node])), "more": pa.array(np.concatenate([np.empty(0, np.int64), *out_more]))})


def count_links(nodes: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """(node, more): the rows of other nodes of its class that each node links with, Jaccard >= num / den.

    nodes: (node, label, n, copies), the classes; parts: (node, fragment, part), their sets in fragments (repeated
    ones count once).
    """
    spark = nodes.sparkSession
    ship_package(spark)
    classes = nodes.groupBy("label").agg(F.count("*").alias("k"), F.sum("n").alias("keys"))
    blocks = F.greatest(F.ceil(F.col("k") / ROWS), F.ceil(F.col("keys") / KEYS)).cast("int").alias("blocks")
    total = classes.agg(F.sum("k").alias("k"), F.sum("keys").alias("keys")).first()
    groups = max(partitions(spark), -(-(total["keys"] or 0) // KEYS))
    named = spread_join(nodes, classes.select("label", blocks), ["label"], classes.select("label", "k"), total["k"] or 0, F.xxhash64("node"))
    once = parts.repartition(partitions(spark), "node").groupBy("node", "fragment").agg(F.first("part").alias("part"))
    sets = named.join(once.groupBy("node").agg(F.collect_list("part").alias("parts")), "node")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("label", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", F.col("n").cast("int").alias("n"), F.col("copies").cast("long").alias("copies"), "parts", "blocks")
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(groups))).otherwise(F.xxhash64("label", "i", "j")).alias("task")
    tallied = sets.select(task, "label", "i", "j", "block", "node", "n", "copies", "parts").groupBy("task").applyInArrow(lambda t: _tally(t, num, den), "node long, more long")
    return tallied.groupBy("node").agg(F.sum("more").alias("more"))

"""Importance resampling: documents drawn by how much likelier their word runs are in a target text collection.

A word is a run of ASCII letters, digits and non-ASCII bytes, ``A-Z`` lower-cased.  Features are all runs of 1 to 3
words of a document, joined by one space, repeats counted; a feature's bucket is the crc32 of its bytes modulo
``buckets``.  One pass counts the buckets of all documents and of all target texts; a bucket's gain is its log ratio in
thousandths, and a second pass sums the gains over each document's array of buckets: its weight.  Checksums of runs are
joined from those of words (crc32 is linear), so no run is ever built.

The score is the weight plus Gumbel noise from a hash of the id, both whole numbers; the highest scores are a
draw without replacement.  Scores are counted exactly: sums over bands of scores, then within the bands that
survive, tell how many documents stand above each score, which finds the cutoff; row numbers by doc_id are taken
within each surviving score alone.  Bands and scores of a band are both about the root of the range of scores.
Rows equal in id, count and weight are one row with a number of copies until ranks are given, so a repeated id is no hot group.

A null text has no words, a null id hashes as empty and comes last among ties.  Documents of fewer than ``least``
words get a weight and score but are never drawn.  Repeated rows each take a rank.  An empty table has an
empty result, an empty target counts nothing; other columns are not read.  Very long texts are read whole.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_words import LOWER, byte_class, spans
from .common import Workspace, in_workspace, map_arrow, reduce_blobs, safe_columns, slabs
from .shingles import string_buffers

WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Blocks that bucket counts are added up in; longer words take zlib; copies of a row numbered by one task.
BLOCKS, LONG, COPIES = 16, 64, 4096


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """crc32's table by byte, and by length and byte place what a checksum becomes when that many bytes follow it."""
    by = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        by = np.where(by & 1, (by >> np.uint32(1)) ^ np.uint32(0xEDB88320), by >> np.uint32(1))
    moved = np.empty((LONG + 2, 4, 256), np.uint32)
    moved[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(1, LONG + 2):
        moved[k] = by[moved[k - 1] & 255] ^ (moved[k - 1] >> np.uint32(8))
    return by, moved.reshape(LONG + 2, 1024)


BY, MOVED = _tables()


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each checksum's part in that of a run with n more bytes (LONG + 1 at most)."""
    flat, at = MOVED.ravel(), n * 1024
    out = flat[at + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= flat[at + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def word_crcs(data: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc32 of each word data[s:s + n], all words a byte at a time; only words of up to LONG bytes."""
    order = np.argsort(-n, kind="stable")
    at, c = s[order], np.full(len(s), 0xFFFFFFFF, np.uint32)
    longer = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), "left")
    for k, m in enumerate(longer):
        c[:m] = BY[(c[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (c[:m] >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = ~c
    return out


def features(col, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the runs that begin at each word (words, 3), -1 for none, and each row's first word (one more than rows)."""
    data, off, _ = string_buffers(col)
    data = LOWER[data]
    s, e, row = spans(WORD[data], off)
    n = e - s
    short = n <= LONG
    crc = np.zeros(len(s), np.uint32)
    crc[short] = word_crcs(data, s[short], n[short])
    tail = np.zeros(len(s), np.uint32)  # of the word with a blank before it
    tail[short] = moved(np.full(int(short.sum()), zlib.crc32(b" "), np.uint32), n[short]) ^ crc[short]
    far = np.flatnonzero(~short).tolist()
    for i in far:
        crc[i] = zlib.crc32(data[s[i] : e[i]].tobytes())
    out = np.full((len(s), 3), -1, np.int64)
    run = crc
    out[:, 0] = run % np.uint32(buckets)
    for k in (1, 2):
        if len(s) <= k:
            break
        run = run[:-1]
        last = slice(k, None)
        joined = moved(run, np.minimum(n[last], LONG) + 1) ^ tail[last]
        for i in far:
            if i >= k:
                joined[i - k] = zlib.crc32(data[s[i] : e[i]].tobytes(), zlib.crc32(b" ", int(run[i - k])))
        run = joined
        out[:-k, k] = np.where(row[:-k] == row[last], (run % np.uint32(buckets)).astype(np.int64), -1)
    return out, np.searchsorted(row, np.arange(len(off)))


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How many features of all texts are in each bucket; each task sends one array, which few tasks add up."""
    wide = -(-buckets // BLOCKS)

    def run(batches):
        total = np.zeros(wide * BLOCKS, np.int64)
        for batch in slabs(batches, "text"):
            b, _ = features(batch.column(0), buckets)
            total += np.bincount(b[b >= 0], minlength=len(total))
        yield {"block": range(BLOCKS), "blob": [x.tobytes() for x in total.reshape(BLOCKS, wide)]}

    parts = map_arrow(safe_columns(texts, text=F.col(text_col)), "block int, blob binary", run)
    total = np.zeros((BLOCKS, wide), np.int64)
    for r in reduce_blobs(parts, "<i8", np.add).collect():
        total[r["block"]] += np.frombuffer(r["blob"], "<i8")
    return total.ravel()[:buckets]


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares), in doubles."""
    k, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    worth = np.append(gain, 0)  # -1 takes the last

    def run(batches):
        for batch in slabs(batches, "text"):
            b, first = features(batch.column(1), len(gain))
            n, each = np.diff(first), np.zeros(len(first) - 1, np.int64)
            each[n > 0] = np.add.reduceat(worth[b].sum(axis=1), first[:-1][n > 0]) if len(b) else 0
            yield {"doc_id": batch.column(0), "n_words": n, "n_features": n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0), "weight": each}

    few = safe_columns(docs, doc_id=F.col(id_col), text=F.col(text_col))
    return map_arrow(few, "doc_id long, n_words long, n_features long, weight long", run)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times Gumbel noise) from sha256 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


@in_workspace
def importance_resample(docs: DataFrame, ws: Workspace, target: DataFrame, *, num: int = 5, den: int = 100, least: int = 20, buckets: int = 10000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): a row per document; the drawn ones, num / den of those with ``least`` words, have a rank."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    scored = weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = ws.table(scored, "scored")
    able = F.col("n_words") >= least
    told = ["doc_id", "n_features", "weight", "score"]
    hist = ws.table(scored.where(able).groupBy("score").agg(F.count("*").alias("n")), "histogram")
    n, lo, hi = hist.agg(F.sum("n"), F.min("score"), F.max("score")).first()
    drawn = num * (n or 0) // den
    if not drawn:
        return ws.later(scored.select(*told, F.lit(None).cast("long").alias("rank")))
    # Bands of 2 ** bits scores: the suffix sums over bands, then over the scores of bands that survive.
    bits = ((hi - lo).bit_length() + 1) // 2
    band = F.shiftright(F.col("score") - lo, bits)
    bands = sorted(hist.groupBy(band.alias("band")).agg(F.sum("n").alias("n")).collect(), reverse=True)
    above, kept = 0, []
    for r in bands:
        if above < drawn:
            kept.append((r["band"], above))
        above += r["n"]
    kept = docs.sparkSession.createDataFrame(kept, "band long, above long")
    higher = Window.partitionBy("band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = hist.withColumn("band", band).join(F.broadcast(kept), "band").select("score", (F.col("above") + F.coalesce(F.sum("n").over(higher), F.lit(0))).alias("ahead"))
    ahead = ws.table(ahead.where(F.col("ahead") < drawn), "ahead")
    cutoff = ahead.agg(F.min("score")).first()[0]
    through = able & (F.col("score") >= cutoff)
    copies = scored.where(through).groupBy(*told).agg(F.count("*").alias("copies"))
    sooner = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.join(ahead, "score").withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("copies").over(sooner), F.lit(0)))
    parts = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).repartition("score", "doc_id", "part")
    each = F.sequence(F.col("part") * COPIES + 1, F.least(F.col("copies"), (F.col("part") + 1) * COPIES))
    ranked = parts.select(*told, "ahead", F.explode(each).alias("at"))
    ranked = ranked.select(*told, F.when(F.col("ahead") + F.col("at") <= drawn, F.col("ahead") + F.col("at")).alias("rank"))
    rest = scored.where(~F.coalesce(through, F.lit(False))).select(*told, F.lit(None).cast("long").alias("rank"))
    return ws.later(ranked.unionByName(rest))

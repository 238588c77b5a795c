"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a row of shape features, counted over all its bytes.  Features are cut into bins at
quantiles of the training sample.  Cyclic boosting goes round the features; in its turn each gets one
shallow tree on the current gradients, added to the feature's lookup table.  Then the pairs whose
trees help most are boosted the same way, on coarser bins.  A score is the logistic of a sum of table
entries, found by vectorised additions of bins.

The model is fitted on a bounded sample: for each label, the first ``per_class`` labelled documents by a
hash of their ids; the classes' shares among all training labels are restored by weights.

Every text gets a score: a null text counts as empty, and empty texts have all features 0.  Without
training rows the score is 0.5; with rows of one label it is that label's smoothed share.
Repeated rows get equal scores; an empty table gives an empty result.  Other columns of the input are
not read, whatever their names; ``keep_quality`` keeps them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, safe_columns, slabs
from .shingles import string_buffers
from .wordcache import span_hashes

FEATURES = ["words", "word_length", "upper", "digits", "stops", "symbols", "pipes", "shouts", "line_words", "same_lines", "high_bytes", "same_words", "top_word", "long_words"]
_KINDS = np.zeros(256, np.uint8)
#: Byte classes 1 lower, 2 upper, 3 digit, 4 stops, 5 other marks, 6 pipe, 7 shout, 8 line end, 9 high, 0 blank and control.
for _k, _of in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (5, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]), (4, b".,;:'\"-"), (6, b"|"), (7, b"!?"), (8, b"\n"), (9, range(128, 256))):
    _KINDS[list(_of)] = _k
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of true bytes, cut at the rows' ends."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[off] = True
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:-1]
    end[:-1] &= ~mask[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(off, s, "right") - 1


def _repeats(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the number of distinct hashes and the count of the commonest."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, int)
    size = np.diff(np.append(cut, len(h)))
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, row[cut], size)
    return np.bincount(row[cut], minlength=rows), top


def features(col) -> np.ndarray:
    """A row of FEATURES for each text of an Arrow string column."""
    data, off, _ = string_buffers(col)
    rows = len(off) - 1
    if rows == 0 or len(data) == 0:
        return np.zeros((rows, len(FEATURES)))
    size = np.diff(off)
    kind = _KINDS[data]
    owner = np.repeat(np.arange(rows, dtype=np.int32), size)
    count = np.bincount(owner * 10 + kind, minlength=rows * 10).reshape(rows, 10).astype(float)
    s, e, row = _runs(~_BLANK[data], off)
    words = np.bincount(row, minlength=rows).astype(float)
    distinct, top = _repeats(span_hashes(data, s, e), row, rows)
    ls, le, lrow = _runs(kind != 8, off)
    lines = np.bincount(lrow, minlength=rows).astype(float)
    kinds, _ = _repeats(span_hashes(data, ls, le), lrow, rows)
    per_byte, per_word, per_line = (1 / np.maximum(x, 1) for x in (size, words, lines))
    letters = np.maximum(count[:, 1] + count[:, 2] + count[:, 9], 1)
    return np.stack(
        [np.log1p(words), (size - count[:, 0]) * per_word, count[:, 2] / letters, count[:, 3] * per_byte, count[:, 4] * per_word, count[:, 5] * per_word, count[:, 6] * per_word, count[:, 7] * per_word, np.log1p(words * per_line), np.where(lines > 0, 1 - kinds * per_line, 0), count[:, 9] / letters, np.where(words > 0, 1 - distinct * per_word, 0), top * per_word, np.bincount(row, e - s > 14, rows) * per_word],
        axis=1,
    )


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The values per bin of a tree with so many leaves, grown by best gain on gradients and curvatures per bin."""
    cuts, reg = [0, len(g)], 1.0
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + reg)
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            c = np.arange(a + 1, b)
            if len(c):
                v = gain(a, c) + gain(c, b) - gain(a, b)
                if v.max() > best[0]:
                    best = (float(v.max()), int(c[v.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + reg)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The values of the best tree of four leaves on a grid of bins, cut once each way; and its gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    n, m = g.shape
    i, j = np.arange(1, n)[:, None], np.arange(1, m)[None, :]

    def part(c, a0, a1, b0, b1):
        return c[a1, b1] - c[a0, b1] - c[a1, b0] + c[a0, b0]

    boxes = [(0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)]
    gain = sum(part(cg, *b) ** 2 / (part(ch, *b) + 1.0) for b in boxes)
    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    a, b = int(at[0]) + 1, int(at[1]) + 1
    out = np.zeros((n, m))
    for a0, a1, b0, b1 in ((0, a, 0, b), (0, a, b, m), (a, n, 0, b), (a, n, b, m)):
        out[a0:a1, b0:b1] = -part(cg, a0, a1, b0, b1) / (part(ch, a0, a1, b0, b1) + 1.0)
    return out, float(gain[at] - cg[n, m] ** 2 / (ch[n, m] + 1.0))


class Model:
    """Bin edges, one table per feature, and tables of pairs."""

    def __init__(self, bins: int = 48, coarse: int = 12):
        self.bins, self.coarse, self.base = bins, coarse, 0.0
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            out += t[b[:, k]]
        for i, j, t in self.pairs:
            out += t[self._wide(b[:, i], i), self._wide(b[:, j], j)]
        return out

    def _wide(self, b: np.ndarray, k: int) -> np.ndarray:
        return b * self.coarse // (len(self.edges[k]) + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 150, leaves: int = 3, rate: float = 0.15, n_pairs: int = 6, pair_rounds: int = 40) -> Model:
        if not len(y):
            return self
        share = (float((w * y).sum()) + 0.5) / (float(w.sum()) + 1)
        self.base = float(np.log(share / (1 - share)))
        if y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest")) for k in range(x.shape[1])]
        b = self._binned(x)
        sizes = [len(e) + 1 for e in self.edges]
        self.tables = [np.zeros(s) for s in sizes]
        f = np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-f))
            return w * (p - y), w * p * (1 - p)

        for _ in range(rounds):
            for k, s in enumerate(sizes):
                g, h = slopes()
                t = rate * _tree(np.bincount(b[:, k], g, s), np.bincount(b[:, k], h, s), leaves)
                self.tables[k] += t
                f += t[b[:, k]]
        c, m = np.stack([self._wide(b[:, k], k) for k in range(len(sizes))], axis=1), self.coarse

        def grid(i, j):
            g, h = slopes()
            at = c[:, i] * m + c[:, j]
            return _tree2(np.bincount(at, g, m * m).reshape(m, m), np.bincount(at, h, m * m).reshape(m, m))

        ranked = sorted(((grid(i, j)[1], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)[:n_pairs]
        self.pairs = [(i, j, np.zeros((m, m))) for _, i, j in ranked]
        for _ in range(pair_rounds):
            for i, j, t in self.pairs:
                add = rate * grid(i, j)[0]
                t += add
                f += add[c[:, i], c[:, j]]
        return self


def fit(docs: DataFrame, labels: DataFrame, training: Column, *, label_col: str = "quality", per_class: int = 6000) -> Model:
    """The model of documents (doc_id, text) and labels (doc_id, 0 or 1) of the rows that ``training`` (on doc_id) selects.

    At most ``per_class`` rows of each label are learned from, however often an id is repeated in either table: labels are
    drawn by a hash of the id, and the documents found for them by one of id and text.  Documents of one
    id and equal text count once for a label; an id with both labels counts for both.
    """
    known = safe_columns(labels, doc_id=F.col("doc_id"), y=F.col(label_col).cast("int")).where(training & F.col("y").isin(0, 1))
    totals = dict(known.groupBy("y").count().collect())
    # About 1.5 times as many rows as wanted pass a threshold, so what partitions send to the last step does not grow with them.
    h, least = F.xxhash64("doc_id"), lambda n: min(1.0, (1.5 * per_class + 50) / max(n, 1))
    picked = [known.where((F.col("y") == k) & (F.pmod(h, F.lit(1 << 30)) < least(totals.get(k, 1)) * (1 << 30))).orderBy(h, "doc_id").limit(per_class) for k in (0, 1)]
    picked = picked[0].union(picked[1]).distinct()
    found = dict(safe_columns(docs, doc_id=F.col("doc_id")).join(F.broadcast(picked), "doc_id").groupBy("y").count().collect())
    texts = safe_columns(docs, doc_id=F.col("doc_id"), text=F.coalesce("text", F.lit(""))).join(F.broadcast(picked), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    share = F.when(F.col("y") == 1, least(found.get(1, 1))).otherwise(least(found.get(0, 1)))
    texts = texts.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < share * (1 << 30))

    def run(batches):
        for batch in slabs(batches, "text"):
            x = features(batch.column(batch.schema.get_field_index("text")))
            yield {"doc_id": batch.column(0), "h": batch.column(3), "y": batch.column(2), "x": list(x)}

    drawn = map_arrow(texts.select("doc_id", "text", "y", "h"), "doc_id long, h long, y int, x array<double>", run).dropDuplicates(["doc_id", "h", "y"])
    rows = sorted(r for k in (0, 1) for r in drawn.where(F.col("y") == k).orderBy("h", "doc_id").limit(per_class).collect())
    y = np.array([r.y for r in rows], float)
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    have = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    w = np.array([totals[int(k)] / have[int(k)] for k in y])
    return Model().fit(x, y, w / w.mean() if len(w) else w)


def score_quality(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""

    def run(batches):
        for batch in slabs(batches, "text"):
            yield {"doc_id": batch.column(0), "score": model.score(features(batch.column(1)))}

    few = safe_columns(docs, doc_id=F.col(id_col), text=F.coalesce(text_col, F.lit("")))
    return map_arrow(few, "doc_id long, score double", run)


def keep_quality(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents with a score of at least ``least``, in one pass without a join; a null text counts as empty."""

    def run(batches):
        for batch in slabs(batches, "text"):
            keep = model.score(features(batch.column(batch.schema.get_field_index("text")))) >= least
            yield {n: batch.column(i).filter(keep) for i, n in enumerate(batch.schema.names)}

    return map_arrow(docs, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), run)

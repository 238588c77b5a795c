"""Best-fit decreasing packing of tokenized documents into sequences, over all documents at once.

Documents longer than ``max_tokens`` are cut into pieces of that length and a rest; nothing else is cut.  Best
fit takes pieces longest first and puts each into the open sequence that it leaves fullest, or into a new one.
Where a piece goes depends on lengths alone, and pieces of one length can be exchanged.  So the lengths are
counted by Spark, and the driver packs runs of equal pieces: open sequences of equal room stand together at
a leaf of a segment tree over remaining capacities, which finds the tightest room for a piece in logarithmic time.
The plan is the one that a pass over all pieces would give, whatever the partitions, and its size follows
the number of distinct lengths (``max_tokens`` at most), not that of documents.  A piece then finds its place
by its number among those of its length: its number within the task that encoded it, and how many earlier
tasks have.

A null or empty text has one id, ``end_id``.  Repeated rows are packed separately; among equally long pieces the order
is that of tasks and rows.  Very long texts are encoded whole and cut.  An empty table gives no pieces; other
columns of the input are not read, null ids stay null.  Memory of a task: a slab of texts and its ids.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, in_workspace, map_arrow, safe_columns, slabs
from .packing import encoder


class Rooms:
    """A segment tree over remaining capacities; a node tells whether any sequence below it is open."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _mark(self, room: int) -> None:
        i = room + self.size
        self.any[i] = bool(self.runs[room])
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def open(self, room: int, first: int, bins: int) -> None:
        """The sequences first, first + 1, ... have this room."""
        if room and bins:
            self.runs[room].append((first, bins))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def tightest(self, n: int) -> int:
        """The least room of an open sequence that is n or more, or -1."""
        i = n + self.size
        if self.any[i]:
            return n
        while i > 1 and not (i % 2 == 0 and self.any[i + 1]):
            i >>= 1
        if i <= 1:
            return -1
        i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], room: int) -> np.ndarray:
    """Rows (first, length, each, bin, offset) for runs of pieces, numbered longest first over all lengths.

    Piece ``first + i`` goes to sequence ``bin + i // each``, at ``offset + i % each * length``.
    """
    rooms, rows, at, bins = Rooms(room), [], 0, 0
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            r = rooms.tightest(n)
            if r < 0:
                r, first, k = room, bins, -(-left // (room // n))
                bins += k
            else:
                first, k = rooms.take(r)
            each = r // n
            full = min(k, left // each)
            rest = left - full * each if full < k else 0
            rows.append((at, n, each, first, room - r))
            at += full * each + rest
            left -= full * each + rest
            rooms.open(r - each * n, first, full)
            if rest:
                rooms.open(r - rest * n, first + full, 1)
            rooms.open(r, first + full + bool(rest), k - full - bool(rest))
    return np.array(rows, np.int64).reshape(-1, 5)


def _pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, max_tokens: int, end_id: int) -> DataFrame:
    """A row per piece with its ids, its task, and its number among the task's pieces of its length."""

    def run(batches):
        encode, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (max_tokens + 1)
        kind = id_type(tokenizer, end_id)
        for batch in slabs(batches, "text"):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids = np.append(ids, end_id).astype(kind)
                for piece, start in enumerate(range(0, len(ids), max_tokens)):
                    part = ids[start : start + max_tokens]
                    rows.append((doc_id, piece, start, len(part), task, seen[len(part)], part.tobytes()))
                    seen[len(part)] += 1
            for i in range(0, len(rows), 2000):
                yield dict(zip(("doc_id", "piece", "start", "length", "task", "nth", "ids"), zip(*rows[i : i + 2000])))

    few = safe_columns(docs, doc_id=F.col(id_col), text=F.col(text_col))
    return map_arrow(few, "doc_id long, piece int, start long, length long, task int, nth long, ids binary", run)


def id_type(tokenizer: str, end_id: int) -> str:
    """Two bytes an id on the way, if all ids fit."""
    return "<u2" if max(encoder(tokenizer).whole.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


@in_workspace
def pack_best_fit(docs: DataFrame, ws: Workspace, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, sequence_id, offset, ids): a row per piece; sequences are numbered from 0.

    ids: the piece's ids as little-endian unsigned 32-bit integers.
    """
    pieces = ws.table(_pieces(docs, tokenizer, id_col, text_col, max_tokens, end_id), "pieces")
    each = ws.table(pieces.groupBy("task", "length").count(), "counts")
    counts = {r["length"]: r["k"] for r in each.groupBy("length").agg(F.sum("count").alias("k")).collect()}
    places, firsts = plan(counts, max_tokens), np.zeros(max_tokens + 1, np.int64)
    at = 0
    for n in sorted(counts, reverse=True):
        firsts[n], at = at, at + counts[n]
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("task", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    kind = id_type(tokenizer, end_id)

    def place(batches):
        for batch in slabs(batches, "ids"):
            length, nth, before = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "nth", "before"))
            number = firsts[length] + before + nth
            first, n, each, sequence, offset = places[np.searchsorted(places[:, 0], number, "right") - 1].T
            i = number - first
            ids = [np.frombuffer(x.as_buffer(), kind).astype("<u4").tobytes() for x in batch.column(batch.schema.get_field_index("ids"))]
            yield {"sequence_id": sequence + i // each, "offset": offset + i % each * n, "ids": ids} | {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length")}

    return ws.later(map_arrow(pieces.join(before, ["task", "length"]), "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary", place))

"""Token counts per section by offset-mapped attribution.

A whole text is encoded once.  The byte lengths of its tokens give their spans, which are joined by
interval with the sections' spans (both sorted, so the join is two binary searches).  A token inside
one section counts there.  A token that crosses a boundary goes by ``rule``: ``"majority"`` (the
section with most of its bytes, ties to the earlier), ``"first"`` or ``"last"`` (where it starts or
ends), or ``"share"`` (a part for each section, by bytes; counts are then fractions).

By default sections are lines with their line ends, named ``heading`` (the first line), ``table``
(a line with `` | `` in it), ``blank`` (white space alone) or ``body``.  Null and empty texts have no
sections and give no rows.  Repeated rows are counted separately; rows come per document and name.
An empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, safe_columns, slabs

NAMES = ["heading", "body", "table", "blank"]


def line_sections(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the sections in bytes (each starts where the last one ended), and their names' places in NAMES."""
    lines = raw.split(b"\n")
    last = lines.pop()
    lines = [x + b"\n" for x in lines] + [last] * bool(last)
    kinds = [3 if not x.strip() else 2 if b" | " in x else 1 for x in lines]
    kinds[0] = 0 if kinds[0] != 3 else 3
    return np.cumsum([len(x) for x in lines]), np.array(kinds)


def attribute(tokens: np.ndarray, ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section; tokens and sections are given by their end offsets."""
    te, ts = tokens, np.concatenate([[0], tokens[:-1]])
    lo, hi = np.searchsorted(ends, ts, "right"), np.searchsorted(ends, te, "left")
    count = np.zeros(len(ends))
    crossing = np.zeros(len(ends), np.int64)
    inside = lo == hi
    count += np.bincount(lo[inside], minlength=len(ends))
    starts = np.concatenate([[0], ends[:-1]])
    for t in np.flatnonzero(~inside):
        own = np.arange(lo[t], hi[t] + 1)
        size = np.minimum(ends[own], te[t]) - np.maximum(starts[own], ts[t])
        if rule == "share":
            count[own] += size / size.sum()
            crossing[own] += 1
        else:
            to = own[{"majority": int(np.argmax(size)), "first": 0, "last": -1}[rule]]
            count[to] += 1
            crossing[to] += 1
    return count, crossing


_ENCODINGS: dict[str, tuple] = {}


def encoding(path: str, pattern: str):
    """The worker's byte-level encoding of a rank file, and the byte length of each token."""
    if path not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = [len(k) for k in ranks]
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _ENCODINGS[path]


def token_counts(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", rule: str = "majority", sections: Callable[[bytes], tuple[np.ndarray, np.ndarray]] = line_sections, names: list[str] = NAMES) -> DataFrame:
    """(doc_id, section, n_sections, n_bytes, n_tokens, n_crossing) for each document and section name."""

    def run(batches):
        enc, size = encoding(ranks, pattern)
        for batch in slabs(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                ends, kind = sections(text.encode())
                count, crossing = attribute(np.cumsum(size[np.array(enc.encode_ordinary(text), np.int64)]), ends, rule)
                by = [np.bincount(kind, x, len(names)) for x in (np.ones(len(kind)), np.diff(ends, prepend=0), count, crossing)]
                rows += [(doc_id, names[k], int(by[0][k]), int(by[1][k]), float(by[2][k]), int(by[3][k])) for k in np.flatnonzero(by[0])]
            if rows:
                yield dict(zip(("doc_id", "section", "n_sections", "n_bytes", "n_tokens", "n_crossing"), zip(*rows)))

    few = safe_columns(docs, doc_id=F.col(id_col), text=F.col(text_col))
    return map_arrow(few, "doc_id long, section string, n_sections long, n_bytes long, n_tokens double, n_crossing long", run)

"""Cost-balanced packing of tokenized documents into fixed-length sequences.

Each task encodes its documents and packs them as they stream by, so no id is ever shuffled.  A
document's full stretches of ``max_tokens`` are sequences of their own.  What is left is collected
up to ``buffer_tokens``; then the pieces, longest first, each go to the sequence of lowest estimated
cost (``length + length ** 2 / max_tokens`` summed over its pieces: linear layers plus attention
within a document) that still has room.  Pieces for which no sequence has room are cut to fill what
room there is.  All sequences of a buffer come out full; what remains joins the next buffer, and at a
task's end it is cut into sequences whose lengths are powers of two, which need no padding.

A null text counts as empty: its one id is ``end_id``.  Repeated rows are packed separately.  An
empty table gives no pieces; other columns of the input are not read.  Memory: one buffer of ids and
one batch of texts.  The same input split always gives the same pieces, so a lost task is repeated
with equal results.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, safe_columns, slabs
from .wordcache import WordCache

#: Latin-1 code points by class of the tokenizer's split pattern.
_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 0, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_CLASS[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
_CLASS[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = _SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] += 32
_ODD = re.compile(rb"<\||'(?:[stmd]|re|ve|ll)", re.I)


class BatchEncoder:
    """Ids of whole texts by a tokenizer file; Latin-1 texts go through the word cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]}
        self.words = Tokenizer.from_str(json.dumps(spec))
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.cache = WordCache(self._encode)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = []
        for i in range(0, len(words), 4096):
            flat.append(np.array(self.words.encode(b" ".join(words[i : i + 4096]).decode("latin-1"), add_special_tokens=False).ids, np.int32))
        ids = np.concatenate(flat)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        raws, rows = [], []
        for i, t in enumerate(texts):
            try:
                raw = (t or "").encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            if raw is None or _ODD.search(raw):
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.int32)
            else:
                raws.append(raw)
                rows.append(i)
        if rows:
            data = _LOWER[np.frombuffer(b"".join(raws), np.uint8)]
            off = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
            kind = _CLASS[data]
            cut = np.ones(len(data) + 1, bool)
            cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
            cut[off] = True
            at = np.flatnonzero(cut)
            s, e = at[:-1], at[1:]
            keep = kind[s] != _SPACE if len(data) else np.zeros(0, bool)
            s, e = s[keep], e[keep]
            ids, k = self.cache.ids(data, s, e)
            ends = np.concatenate([[0], np.cumsum(k)])[np.searchsorted(s, off)]
            for j, i in enumerate(rows):
                out[i] = ids[ends[j] : ends[j + 1]]
        return out


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """The worker's encoder of a file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]


def fill(pieces: list[tuple], room: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Packs (key, start, length) pieces of at most ``room`` into full sequences; the rest comes second."""
    bins = sum(p[2] for p in pieces) // room
    seqs: list[list[tuple]] = [[] for _ in range(bins)]
    free, cost = np.full(bins, room), np.zeros(bins)
    homeless = []
    for p in sorted(pieces, key=lambda p: -p[2]):
        n = p[2]
        able = np.flatnonzero(free >= n)
        if not len(able):
            homeless.append(p)
            continue
        i = able[cost[able].argmin()]
        seqs[i].append(p)
        free[i] -= n
        cost[i] += n + n * n / room
    free = free.tolist()
    rest = []
    gaps = iter(sorted((i for i in range(bins) if free[i]), key=lambda i: -free[i]))
    i = next(gaps, None)
    for key, start, n in homeless:
        while n and i is not None:
            take = min(n, free[i])
            seqs[i].append((key, start, take))
            free[i] -= take
            start, n = start + take, n - take
            if not free[i]:
                i = next(gaps, None)
        if n:
            rest.append((key, start, n))
    return seqs, rest


def _powers(pieces: list[tuple], room: int) -> list[list[tuple]]:
    """The pieces, of less than ``room`` together, cut into sequences of power-of-two lengths."""
    total, out, pieces = sum(p[2] for p in pieces), [], list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        seq, want = [], 1 << bit
        while want:
            key, start, n = pieces.pop(0)
            take = min(n, want)
            seq.append((key, start, take))
            want -= take
            if n > take:
                pieces.insert(0, (key, start + take, n - take))
        out.append(seq)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 1, buffer_tokens: int = 1 << 19) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): a row per piece.

    ids: the piece's ids as little-endian unsigned 32-bit integers.
    """

    def run(batches):
        encode, first = encoder(tokenizer), TaskContext.get().partitionId() << 36
        state = {"next": first, "docs": {}, "pool": [], "size": 0, "key": 0}

        def emit(seqs):
            rows = []
            for seq in seqs:
                at = 0
                for key, start, n in seq:
                    doc_id, ids = state["docs"][key]
                    rows.append((doc_id, start, n, len(ids), state["next"], at, ids[start : start + n].astype("<u4").tobytes()))
                    at += n
                state["next"] += 1
            for i in range(0, len(rows), 2000):
                yield dict(zip(("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"), zip(*rows[i : i + 2000])))

        def flush():
            seqs, state["pool"] = fill(state["pool"], max_tokens)
            yield from emit(seqs)
            state["docs"] = {p[0]: state["docs"][p[0]] for p in state["pool"]}
            state["size"] = sum(p[2] for p in state["pool"])

        for batch in slabs(batches, "text"):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.int32(end_id))
                key = state["key"] = state["key"] + 1
                state["docs"][key] = (doc_id, ids)
                full = len(ids) // max_tokens
                yield from emit([(key, i * max_tokens, max_tokens)] for i in range(full))
                if left := len(ids) - full * max_tokens:
                    state["pool"].append((key, full * max_tokens, left))
                    state["size"] += left
                else:
                    del state["docs"][key]
            if state["size"] >= buffer_tokens:
                yield from flush()
        yield from flush()
        yield from emit(_powers(state["pool"], max_tokens))

    few = safe_columns(docs, doc_id=F.col(id_col), text=F.col(text_col))
    return map_arrow(few, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary", run)

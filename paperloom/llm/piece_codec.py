"""SentencePiece encoding and decoding by an Aho-Corasick automaton over the pieces.

The automaton reads a text once; at each position its output links name every piece that ends
there, and each relaxes the best score of that position (single-pass Viterbi).  The segmentation of
greatest summed score wins, ties to the shorter last piece.  A character that no piece covers is
one unknown step, encoded by byte pieces where the model has them.

No piece has a space mark after another character, so a text falls apart at spaces without any
change of result; each worker keeps the ids of the words it has met (see ``wordcache``).

A null text has null results, an empty text no ids.  Decoding gives back the text exactly if it
encodes without an unknown id (bytes pieces guarantee that) and has no space mark U+2581 of its own,
which becomes a space.  Models with a character map are refused: their normalisation would be lost.
Repeated rows are coded separately, an empty table gives an empty result; encoding reads no other columns,
decoding keeps them.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, safe_columns, slabs
from .wordcache import WordCache

MARK = "▁"
#: The piece types of the model file, and the unknown step's distance below the least score.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNKNOWN_PENALTY = 10.0


def _fields(buf: bytes):
    """(field number, value) of a protocol-buffer message; sub-messages stay bytes."""
    i = 0

    def varint():
        nonlocal i
        x = shift = 0
        while True:
            b = buf[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, buf[i : i + n]
            i += n


class Pieces:
    """The pieces of a model file and their automaton."""

    def __init__(self, model: bytes):
        self.text, self.score, self.kind = [], [], []
        self.prefix, self.squeeze = True, True
        for field, value in _fields(model):
            if field == 1:
                p = dict(_fields(value))
                self.text.append(p.get(1, b"").decode())
                self.score.append(float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0)
                self.kind.append(p.get(3, NORMAL))
            elif field == 3:
                n = dict(_fields(value))
                if n.get(2):
                    raise ValueError("models with a character map are not supported")
                self.prefix, self.squeeze = bool(n.get(3, 1)), bool(n.get(4, 1))
        self.unknown = self.kind.index(UNKNOWN)
        self.bytes = [-1] * 256
        for i, (t, k) in enumerate(zip(self.text, self.kind)):
            if k == BYTE:
                self.bytes[int(t[3:5], 16)] = i
        normal = [(t, s, i) for i, (t, s, k) in enumerate(zip(self.text, self.score, self.kind)) if k in (NORMAL, USER) and t]
        if any(MARK in t.lstrip(MARK) for t, _, _ in normal):
            raise ValueError("a piece has a space mark after another character")
        self.low = min(s for _, s, _ in normal) - UNKNOWN_PENALTY
        self._build(normal)
        self.raw = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace(MARK, " ").encode() for t, k in zip(self.text, self.kind)]
        self.words = WordCache(self._encode_words)

    def _build(self, pieces: list[tuple[str, float, int]]) -> None:
        self.go: list[dict[str, int]] = [{}]
        self.out: list[tuple[int, float, int] | None] = [None]
        for text, score, i in pieces:
            at = 0
            for ch in text:
                if ch not in self.go[at]:
                    self.go[at][ch] = len(self.go)
                    self.go.append({})
                    self.out.append(None)
                at = self.go[at][ch]
            self.out[at] = (len(text), score, i)
        self.fail, self.link = [0] * len(self.go), [0] * len(self.go)
        queue = deque(self.go[0].values())
        while queue:
            at = queue.popleft()
            for ch, child in self.go[at].items():
                f = self.fail[at]
                while f and ch not in self.go[f]:
                    f = self.fail[f]
                self.fail[child] = f = self.go[f].get(ch, 0) if self.go[f].get(ch, 0) != child else 0
                self.link[child] = f if self.out[f] else self.link[f]
                queue.append(child)

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """The ids of the best segmentation of a marked text, and its score."""
        go, out, fail, link, low = self.go, self.out, self.fail, self.link, self.low
        best, back = [0.0], [None]
        at = 0
        for i, ch in enumerate(text):
            while at and ch not in go[at]:
                at = fail[at]
            at = go[at].get(ch, 0)
            top, via, single = -np.inf, None, False
            o = at if out[at] else link[at]
            while o:
                n, score, piece = out[o]
                score += best[i + 1 - n]
                single |= n == 1
                if score >= top:
                    top, via = score, (n, piece)
                o = link[o]
            if not single and best[i] + low > top:
                top, via = best[i] + low, (1, -1)
            best.append(top)
            back.append(via)
        ids: list[int] = []
        i = len(text)
        while i:
            n, piece = back[i]
            if piece < 0:
                raw = [self.bytes[b] for b in text[i - 1].encode()]
                ids += [self.unknown] if min(raw) < 0 else raw[::-1]
            else:
                ids.append(piece)
            i -= n
        return ids[::-1], best[-1]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows = [self.viterbi(w.decode().replace(" ", MARK))[0] for w in words]
        return np.array([i for r in rows for i in r], np.int32), np.array([len(r) for r in rows], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raws = []
        for t in texts:
            raw = t.replace(MARK, " ").encode()
            if self.squeeze:
                raw = b" ".join(raw.strip(b" ").split(b" ")) if b"  " not in raw else b" ".join(x for x in raw.split(b" ") if x)
            raws.append(b" " * (self.prefix and raw != b"") + raw)
        data = np.frombuffer(b"".join(raws), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        start[off] = True
        at = np.flatnonzero(start)
        ids, k = self.words.ids(data, at[:-1], at[1:])
        ends = np.concatenate([[0], np.cumsum(k)])[np.searchsorted(at[:-1], off)]
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's pieces of a model file, kept between tasks."""
    if path not in _PIECES:
        with open(path, "rb") as f:
            _PIECES[path] = Pieces(f.read())
    return _PIECES[path]


def encode_pieces(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """(doc_id, text, ids): the ids of each whole text, as little-endian signed 32-bit integers.

    decoded: the name of a further column, of the texts decoded from these ids in the same pass.
    """

    def run(batches):
        p = pieces(model)
        for batch in slabs(batches, "text"):
            texts = batch.column(1).to_pylist()
            ids = [None if t is None else x for t, x in zip(texts, p.encode([t or "" for t in texts]))]
            out = {"doc_id": batch.column(0), "text": batch.column(1), "ids": [None if x is None else x.astype("<i4").tobytes() for x in ids]}
            if decoded:
                out[decoded] = [None if x is None else p.decode(x.tolist()) for x in ids]
            yield out

    few = safe_columns(docs, doc_id=F.col(id_col), text=F.col(text_col))
    return map_arrow(few, "doc_id long, text string, ids binary" + (f", `{decoded}` string" if decoded else ""), run)


def decode_pieces(encoded: DataFrame, model: str, *, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The input's columns and ``into``: the texts of packed ids; an input column of that name is replaced."""
    encoded = encoded.drop(into) if ids_col.lower() != into.lower() else encoded.withColumnRenamed(ids_col, "__ids")
    ids_col = ids_col if ids_col.lower() != into.lower() else "__ids"

    def run(batches):
        p = pieces(model)
        for batch in slabs(batches, ids_col):
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {into: [None if x is None else p.decode(np.frombuffer(x, "<i4").tolist()) for x in ids]}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{into}` string"
    out = map_arrow(encoded, schema, run)
    return out.drop("__ids") if ids_col == "__ids" else out

"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read windows of a text's bytes, one forwards and one backwards; a softmax over both states
labels every position, and the document's probabilities are the mean over the positions that belong
to letters.  Windows overlap by ``MARGIN`` bytes on each side whose labels are not used, so a text of any
length is read as a whole in bounded memory.  The network is trained in numpy by backpropagation
through time and Adam, on a bounded sample of labelled rows: at most ``per_lang`` of each language, drawn
by a hash of id and text.  Only the ``most_languages`` most frequent languages are learned (equal counts: the
first in order), so rare and misspelt names in a dirty table do no harm.  Each gives ``draws`` windows at places drawn uniformly from its whole text.

Null texts and texts without a letter get ``und`` and score 0; so does every text if no language
could be learned.  Ties go to the language first in order.  Repeated rows get equal results, an empty
table gives an empty result, other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, safe_columns, slabs

HIDDEN, CORE, MARGIN, STEP, WIDE = 8, 208, 16, 16, 2048
#: Bytes of a training window.
LENGTH = 48
LETTER = np.zeros(256, np.float32)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _sign(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The soft sign x / (1 + |x|), in place: the network's activation (gates: half of it plus a half)."""
    np.abs(x, out=room)
    room += np.float32(1)
    x /= room
    return x


def init(langs: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        for g in "zrn":
            p[f"W{g}{d}"] = rng.standard_normal((256, HIDDEN)) * 0.3
            p[f"U{g}{d}"] = np.linalg.qr(rng.standard_normal((HIDDEN, HIDDEN)))[0] * 0.8
        p[f"V{d}"] = rng.standard_normal((HIDDEN, langs)) * 0.3
    p["c"] = np.zeros(langs)
    return {k: v.astype(np.float32) for k, v in p.items()}


def states(p: dict, x: np.ndarray, d: str, keep: bool = False):
    """Hidden states of a GRU after each of x's rows (time, batch), in the order of reading."""
    size = (x.shape[1], HIDDEN)
    h, room, half = np.zeros(size, np.float32), np.empty(size, np.float32), np.float32(0.5)
    out, gates = np.empty((*x.shape, HIDDEN), np.float32), []
    wz, wr, wn, uz, ur = (p[k + d] for k in ("Wz", "Wr", "Wn", "Uz", "Ur"))
    un = p["Un" + d] * half
    for t in range(len(x)):
        z = h @ uz
        z += wz.take(x[t], axis=0)
        r = h @ ur
        r += wr.take(x[t], axis=0)
        u = h @ un
        _sign(z, room)
        n = _sign(r, room) * u
        n += u
        n += wn.take(x[t], axis=0)
        _sign(n, room)
        if keep:
            gates.append((h, half + half * z, half + half * r, 2 * u, n))
        # h = n + z (h - n), with the gate (1 + z) / 2
        step = h - n
        step *= half
        z *= step
        h = out[t]
        np.add(n, step, out=h)
        h += z
    return (out, gates) if keep else out


def softmax(a: np.ndarray) -> np.ndarray:
    a = a - a.max(axis=-1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=-1, keepdims=True)
    return a


def _back(p: dict, x: np.ndarray, d: str, gates: list, dh_out: np.ndarray, grad: dict) -> None:
    """Adds the gradients of one direction, given those of its states."""
    dh = np.zeros_like(dh_out[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, u, n = gates[t]
        dh = dh + dh_out[t]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dn * u * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        du = dn * r
        for g, a, b in (("z", dz, dz), ("r", dr, dr), ("n", dn, du)):
            grad[f"U{g}{d}"] += h.T @ b
            np.add.at(grad[f"W{g}{d}"], x[t], a)
        dh = dh * z + dz @ p["Uz" + d].T + dr @ p["Ur" + d].T + du @ p["Un" + d].T


def loss_and_gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over the letter positions of x (time, batch), and its gradients."""
    hf, gf = states(p, x, "f", True)
    hb, gb = states(p, x[::-1], "b", True)
    hb = hb[::-1]
    prob = softmax(hf @ p["Vf"] + hb @ p["Vb"] + p["c"])
    w = LETTER[x]
    w = w / max(1.0, float(w.sum()))
    at = np.arange(x.shape[1])
    loss = float(-(np.log(prob[:, at, y] + 1e-9) * w).sum())
    prob[:, at, y] -= 1
    prob *= w[:, :, None]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    flat = prob.reshape(-1, prob.shape[-1])
    grad["Vf"], grad["Vb"], grad["c"] = hf.reshape(-1, HIDDEN).T @ flat, np.ascontiguousarray(hb).reshape(-1, HIDDEN).T @ flat, flat.sum(axis=0)
    _back(p, x, "f", gf, prob @ p["Vf"].T, grad)
    _back(p, x[::-1], "b", gb, (prob @ p["Vb"].T)[::-1], grad)
    return loss, grad


def train(rows: list[tuple[np.ndarray, int]], langs: int, steps: int = 300, batch: int = 192, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on windows of the rows (window, byte); languages are drawn with equal probability."""
    rng = np.random.default_rng(seed)
    p = init(langs, rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    by = [[w for w, y in rows if y == k] for k in range(langs)]
    have = [k for k in range(langs) if by[k]]
    if not have:
        return p
    for step in range(1, steps + 1):
        y = rng.choice(have, batch)
        some = [by[k][rng.integers(len(by[k]))] for k in y]
        x = np.stack([w[rng.integers(len(w))] for w in some], axis=1)
        _, g = loss_and_gradients(p, x, y)
        rate = 0.02 * min(1, step / 20) * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.02)
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        for k in p:
            a = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def predict(p: dict, raws: list[bytes]) -> np.ndarray:
    """Mean probabilities of each text over its letter bytes (zeros where it has none)."""
    langs = len(p["c"])
    sizes = np.array([len(r) for r in raws], np.int64)
    n = -(-sizes // CORE)
    doc = np.repeat(np.arange(len(raws)), n)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    pad = MARGIN + CORE
    data = np.concatenate([np.full(pad, 32, np.uint8), np.frombuffer(b"".join(raws), np.uint8), np.full(pad, 32, np.uint8)])
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * CORE
    total, weight = np.zeros((len(raws), langs)), np.zeros(len(raws))
    offsets = np.arange(-MARGIN, CORE + MARGIN)[:, None]
    # Windows of one width go together, so that a text's result does not depend on its neighbours; what lies outside the text reads as blanks.
    left = np.minimum(sizes[doc] - start, CORE)
    width = -(-left // STEP) * STEP
    order = np.argsort(width, kind="stable")
    cuts = np.flatnonzero(np.diff(width[order], prepend=-1, append=-1))
    for i, end in ((i, min(i + WIDE, b)) for a, b in zip(cuts, cuts[1:]) for i in range(a, b, WIDE)):
        w = order[i:end]
        span = offsets[: 2 * MARGIN + int(width[w[0]])]
        place = start[w] + span
        x = data[np.minimum(first[doc[w]] + place + pad, len(data) - 1)]
        x = np.where((place >= 0) & (place < sizes[doc[w]]), x, np.uint8(32))
        hf, hb = states(p, x, "f"), states(p, x[::-1], "b")[::-1]
        core = slice(MARGIN, len(x) - MARGIN)
        k = len(x) - 2 * MARGIN
        a = (np.ascontiguousarray(hf[core]).reshape(-1, HIDDEN) @ p["Vf"] + np.ascontiguousarray(hb[core]).reshape(-1, HIDDEN) @ p["Vb"] + p["c"]).T.copy()
        np.exp(a, out=a)
        inside = LETTER[x[core]] * (np.arange(k)[:, None] < left[w])
        a *= (inside.ravel() / a.sum(axis=0))[None, :]
        for c in range(langs):
            np.add.at(total[:, c], doc[w], a[c].reshape(k, -1).sum(axis=0))
        np.add.at(weight, doc[w], inside.sum(axis=0))
    return total / np.maximum(weight, 1)[:, None]


def windows(raw: bytes, draws: int, length: int) -> np.ndarray:
    """``draws`` windows at places drawn from the whole text, blanks after its end; equal texts give equal windows."""
    b = np.frombuffer(raw, np.uint8)
    at = np.random.default_rng(zlib.crc32(raw)).integers(0, max(1, len(b) - length + 1), draws)
    out = np.full((draws, length), 32, np.uint8)
    for w, s in zip(out, at):
        part = b[s : s + length]
        w[: len(part)] = part
    return out


def sample(docs: DataFrame, training: Column, per_lang: int, draws: int, most_languages: int, length: int = LENGTH) -> list[tuple[str, bytes]]:
    """(lang, windows) of at most ``per_lang`` documents of each language, in a fixed order.

    The languages are counted first, so that a threshold on the hash leaves about 1.5 times ``per_lang`` rows of
    each, however frequent it is; only these are ranked.
    """
    rows = safe_columns(docs, doc_id=F.col("doc_id"), text=F.col("text"), lang=F.col("lang")).where(training & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (1.5 * per_lang + 50) / r["count"]))])
    h = F.xxhash64("doc_id", "text")
    drawn = rows.where(F.length("text") > 0).withColumn("h", h).where(F.pmod("h", F.lit(1 << 30)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * (1 << 30))
    place = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    drawn = drawn.withColumn("k", F.row_number().over(place)).where(F.col("k") <= per_lang).select("lang", "h", "k", "text")

    def run(batches):
        for batch in slabs(batches, "text"):
            yield {"lang": batch.column(0), "k": batch.column(2), "windows": [windows(t.encode(), draws, length).tobytes() for t in batch.column(3).to_pylist()]}

    return [(r.lang, r.windows) for r in sorted(map_arrow(drawn, "lang string, k int, windows binary", run).collect(), key=lambda r: (r.lang, r.k))]


def fit(docs: DataFrame, training: Column, per_lang: int = 500, draws: int = 32, most_languages: int = 200) -> tuple[list[str], dict]:
    """The languages in order, and the network's parameters; the sample is ``per_lang`` * ``draws`` windows of each at most."""
    rows = sample(docs, training, per_lang, draws, most_languages)
    langs = sorted({lang for lang, _ in rows})
    at = {lang: i for i, lang in enumerate(langs)}
    return langs, train([(np.frombuffer(w, np.uint8).reshape(draws, LENGTH), at[lang]) for lang, w in rows], len(langs)) if langs else {}


def label(model: tuple[list[str], dict], texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and its mean probability for each text."""
    langs, params = model
    has = [bool(langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
    if not any(has):
        return ["und"] * len(texts), [0.0] * len(texts)
    prob = predict(params, [t.encode() if ok else b"" for t, ok in zip(texts, has)])
    best = prob.argmax(axis=1)
    return [langs[k] if ok else "und" for k, ok in zip(best, has)], [min(1.0, float(prob[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, has))]


def identify(docs: DataFrame, model: tuple[list[str], dict], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""

    def run(batches):
        for batch in slabs(batches, "text"):
            lang, score = label(model, batch.column(1).to_pylist())
            yield {"doc_id": batch.column(0), "lang_pred": lang, "score": score}

    few = safe_columns(docs, doc_id=F.col(id_col), text=F.col(text_col))
    return map_arrow(few, "doc_id long, lang_pred string, score double", run)


def keep_known(docs: DataFrame, model: tuple[list[str], dict], clear: float = 1.2) -> DataFrame:
    """The documents with a language (not ``und``) whose mean probability is ``clear`` times that of a guess, in one pass without a join.

    A guess among L languages has 1 / L, so the bound follows their number (0.3 of four languages; never above
    0.99).  All columns stay; repeated rows are judged alike, null and letterless texts go, an empty table stays empty.
    """
    least = min(0.99, clear / max(1, len(model[0])))

    def run(batches):
        for batch in slabs(batches, "text"):
            lang, score = label(model, batch.column(batch.schema.get_field_index("text")).to_pylist())
            keep = np.array([a != "und" and b >= least for a, b in zip(lang, score)], bool)
            yield {n: batch.column(i).filter(keep) for i, n in enumerate(batch.schema.names)}

    return map_arrow(docs, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), run)


def positions(params: dict, text: str) -> np.ndarray:
    """The label of every byte of one text, by the whole text as one window."""
    x = np.frombuffer(text.encode(), np.uint8)[:, None]
    hf, hb = states(params, x, "f"), states(params, x[::-1], "b")[::-1]
    return (hf @ params["Vf"] + hb @ params["Vb"] + params["c"]).argmax(axis=2)[:, 0]

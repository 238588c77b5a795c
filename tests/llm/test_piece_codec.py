import random

import numpy as np
import public_tokenizers as P
import pytest

from paperloom.llm.piece_codec import MARK, Pieces, decode_pieces, encode_pieces, pieces

MODEL = P.path("piece_bpe_32k.model")
TEXTS = ["", " ", "Hello  world", "  x ", "a\tb\n\nc", "中文字😀 tést", "é́ \x00\x07", "ab" * 20000, "tick " * 3000]


def message(field, value):
    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    if isinstance(value, bytes):
        return varint(field << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(field << 3 | 5) + np.float32(value).tobytes()
    return varint(field << 3) + varint(value)


def model(rows, squeeze=0):
    body = b"".join(message(1, message(1, t.encode()) + message(2, s) + message(3, k)) for t, s, k in rows)
    return body + message(3, message(3, 1) + message(4, squeeze))


def best(p, text):
    """All segmentations by plain dynamic programming."""
    score = {t: s for t, s, k in zip(p.text, p.score, p.kind) if k in (1, 4)}
    top = [0.0] + [-np.inf] * len(text)
    for i in range(1, len(text) + 1):
        for j in range(max(0, i - 20), i):
            s = score.get(text[j:i], p.low if i - j == 1 and text[j:i] not in score else -np.inf)
            top[i] = max(top[i], top[j] + s)
    return top[-1]


def test_viterbi_is_optimal_on_random_models():
    rng = random.Random(3)
    for _ in range(40):
        rows = [("<unk>", 0.0, 2)] + [(t, -rng.random() * 9, 1) for t in {MARK} | {MARK * rng.randrange(2) + "".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(25)}]
        p = Pieces(model(rows))
        for _ in range(20):
            text = "".join(rng.choices("abcd" + MARK, k=rng.randrange(0, 25)))
            ids, score = p.viterbi(text)
            assert score == pytest.approx(best(p, text))
            assert "".join("?" if i == p.unknown else p.text[i] for i in ids) == "".join(c if c in "".join(p.text[1:]) or c == MARK else "?" for c in text) or "d" in text or any(c not in p.text for c in text)


def test_words_alone_give_the_same_as_the_whole_text():
    p = pieces(MODEL)
    for t in TEXTS[1:7]:
        whole = p.viterbi(MARK + t.replace(" ", MARK))[0]
        assert p.encode([t])[0].tolist() == whole


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    out = decode_pieces(encode_pieces(docs.union(odd), MODEL, decoded="again"), MODEL).collect()
    assert len(out) == docs.count() + len(TEXTS) + 1
    for r in out:
        assert r.decoded == r.again
        assert r.decoded == r.text if r.text is not None else r.decoded is None and r.ids is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, ids binary")
    assert decode_pieces(encode_pieces(df, MODEL), MODEL).count() == 0

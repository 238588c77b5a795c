import numpy as np
import public_tokenizers as P
import pytest

from paperloom.llm.token_counts import NAMES, attribute, encoding, line_sections, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "a", "Title\n\nBody text here, naïve ☃.\na | b | c\n", "\n\n \n", "x" * 50000, "one\r\ntwo\n\n\n  three\n"]


def brute(text, rule):
    raw = text.encode()
    enc, size = encoding(RANKS, P.PATTERN)
    owner = []
    lines = raw.split(b"\n")
    for i, line in enumerate(lines):
        owner += [i] * (len(line) + (i < len(lines) - 1))
    kinds = ["blank" if not x.strip() else "heading" if i == 0 else "table" if b" | " in x else "body" for i, x in enumerate(lines)]
    out, at = {}, 0
    for t in enc.encode_ordinary(text):
        own = owner[at : at + size[t]]
        at += size[t]
        ranked = sorted(set(own), key=lambda o: (-own.count(o), o))
        for o in set(own) if rule == "share" else [{"majority": ranked[0], "first": own[0], "last": own[-1]}[rule]]:
            part = own.count(o) / len(own) if rule == "share" else 1
            out[kinds[o]] = out.get(kinds[o], 0) + part
    return out


@pytest.mark.parametrize("rule", ["majority", "first", "last", "share"])
def test_counts_equal_brute_force(spark, sf, rule):
    real = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    rows = list(enumerate(TEXTS + real))
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, n_tokens double")
    got = {}
    for r in token_counts(df, RANKS, P.PATTERN, rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = r.n_tokens
    for i, t in rows:
        want = brute(t, rule) if t else {}
        have = {k: v for k, v in got.get(i, {}).items() if v}
        assert have == pytest.approx(want), (i, rule)


def test_sections_cover_the_text():
    for t in TEXTS[2:]:
        ends, kinds = line_sections(t.encode())
        assert ends[-1] == len(t.encode()) and (np.diff(ends, prepend=0) > 0).all() and kinds.max() < len(NAMES)


def test_boundary_rules():
    tokens, ends = np.array([3, 7, 10]), np.array([5, 10])
    assert attribute(tokens, ends, "majority")[0].tolist() == [2, 1]
    assert attribute(tokens, ends, "last")[0].tolist() == [1, 2]
    assert attribute(tokens, ends, "share")[0].tolist() == [1.5, 1.5]


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN).count() == 0

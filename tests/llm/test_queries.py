"""The registered queries over their whole tables, against their SQL or plain versions."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from paperloom.llm import gam, langid, queries
from paperloom.llm.credential_links import scan
from paperloom.llm.piece_codec import MARK
from tests.llm.test_piece_codec import best
from tests.llm.test_token_counts import brute as sections
from tests.oracle import compare, rows_of

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, sf, name):
    assert compare(spark, sf, name, queries.queries()[name], SQL[name]) > 0


def test_linked_credentials_equal_sql(spark, tmp_path):
    rng = random.Random(8)
    bits = ["user: alice ", "pwd = hunter22 ", "host=db1.example.org ", "aws_secret_access_key = wJalrXUtnFEMI/K7 ", "AKIA" + "Q" * 16 + " ", "api_key: abcdefghijkl1234 ", "token = short99 ", "0123456789abcdef ", "https://x.example.org/a ", "my_key=abcd ", "secret_key=abcdefgh ", "é" * 150, "lorem ipsum " * 14, "\n", "login = bob ", "stripe_api_key = abcdefghijkl1234 "]
    texts = [None, ""] + ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op9_credential_links(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    res = con.execute(SQL["op9_credential_links"])
    got, want = rows_of(out.columns, out.collect()), rows_of([c[0] for c in res.description], res.fetchall())
    assert got == want
    kinds = [k for t in texts[2:] for _, k, _ in scan(t.encode())]
    assert all(kinds.count(k) > 50 for k in range(6))


def test_token_counts(spark, sf):
    got = defaultdict(dict)
    for r in queries.op1_token_counts(spark, sf).collect():
        got[r.doc_id][r.section] = r.n_tokens
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert {k: v for k, v in got[r.doc_id].items() if v} == (sections(r.text, "majority") if r.text else {})


def test_languages(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op4_byte_langid(spark, sf).collect()}
    assert set(got) == set(docs) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    known = [d for d, r in got.items() if r.held_out and docs[d].lang]
    assert sum(got[d].lang_pred == docs[d].lang for d in known) / len(known) > 0.97
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    langs, params = langid.fit(frame, (queries.F.pmod(queries.F.crc32(queries.F.col("doc_id").cast("string")), queries.F.lit(5)) != 0))
    for d in sorted(docs)[::25]:
        raw = docs[d].text.encode()
        prob = np.zeros(len(langs))
        for s in range(0, len(raw), langid.CORE):
            lo, n = s - langid.MARGIN, min(langid.CORE, len(raw) - s)
            wide = -(-n // langid.STEP) * langid.STEP + 2 * langid.MARGIN
            x = np.frombuffer((b" " * max(0, -lo) + raw[max(0, lo) : s + n + langid.MARGIN]).ljust(wide), np.uint8)[:, None]
            hf, hb = langid.states(params, x, "f"), langid.states(params, x[::-1], "b")[::-1]
            p = langid.softmax(hf @ params["Vf"] + hb @ params["Vb"] + params["c"])[langid.MARGIN : langid.MARGIN + n, 0]
            prob += (p * langid.LETTER[x[langid.MARGIN : langid.MARGIN + n]]).sum(axis=0)
        prob /= max(1, langid.LETTER[np.frombuffer(raw, np.uint8)].sum())
        assert langs[int(prob.argmax())] == got[d].lang_pred and abs(prob.max() - got[d].score) < 1e-4


def test_piece_ids(spark, sf):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in queries.op5_piece_codec(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(rows) == set(docs) and all(r.round_trip for r in rows.values()) and not any(MARK in (t or "") for t in docs.values())
    from paperloom.llm.piece_codec import pieces

    codec = pieces(P.path("piece_bpe_32k.model"))
    for d in sorted(docs, key=lambda d: len(docs[d]))[:60]:
        ids = codec.encode([docs[d]])[0]
        assert rows[d].n_ids == len(ids) and rows[d].ids_crc32 == zlib.crc32(ids.astype("<i4").tobytes())
        whole = " " * codec.prefix * bool(docs[d]) + docs[d]
        assert np.isclose(sum(codec.score[i] if codec.kind[i] in (1, 4) else 0 for i in ids), best(codec, whole.replace(" ", MARK)), atol=1e-2) or any(codec.kind[i] == 6 for i in ids)
        assert p.decode(ids.tolist()) == docs[d].replace(MARK, " ") or docs[d][:1] == " "


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {r.doc_id: np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in queries.op8_cost_balanced_packing(spark, sf).collect():
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(want[r.doc_id])
        docs[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for spans, total in [(docs[d], len(x)) for d, x in want.items()] + [(s, None) for s in seqs.values()]:
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [s for s, _ in sorted(spans)] == [0, *ends[:-1]] and (ends[-1] == total if total else ends[-1] <= 2048)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.op10_quality_gam(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for d, r in got.items())
    known = [r for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.quality for r in known) / len(known) > 0.95
    model = gam.fit(docs, labels, queries.F.pmod(queries.F.crc32(queries.F.col("doc_id").cast("string")), queries.F.lit(3)) != 1)
    import pyarrow as pa

    for r in docs.limit(60).collect():
        x = gam.features(pa.array([r.text], pa.string()))[0]
        bins = [int((np.asarray(e) <= v).sum()) for e, v in zip(model.edges, x)]
        logit = model.base + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[bins[i] * model.coarse // (len(model.edges[i]) + 1), bins[j] * model.coarse // (len(model.edges[j]) + 1)] for i, j, t in model.pairs)
        assert np.isclose(got[r.doc_id].score, 1 / (1 + np.exp(-logit)))


def test_a_failing_operator_leaves_no_tables(spark):
    from pathlib import Path

    from paperloom.llm.common import discard_results, shared_root
    from paperloom.llm.ngram_join import ngram_jaccard_classes

    root = Path(shared_root(spark).removeprefix("file://"))
    discard_results(spark)
    before = set(root.glob("paperloom-*"))
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    with pytest.raises(Exception):
        ngram_jaccard_classes(df.selectExpr("assert_true(text is null) as doc_id", "text")).collect()
    assert set(root.glob("paperloom-*")) == before
    out = ngram_jaccard_classes(df)
    (new,) = set(root.glob("paperloom-*")) - before
    assert out.count() == 1 and [p.name for p in new.iterdir()] == ["result"]
    discard_results(spark)
    assert set(root.glob("paperloom-*")) == before

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import gam, langid, queries
from tests.llm.test_ngram_join import brute as classes_of
from tests.llm.test_pii import brute as pseudonyms

A = "one two three four five six seven eight nine ten eleven twelve"
B = "another text of quite different words which no other row of this table holds"
C = "and a third one whose copies have no ids at all in any of their rows"


def test_near_duplicates_keeps_one_row_of_each_group(spark):
    rows = [
        (None, B, "en"), (None, C, "en"), (None, C, "de"), (7, A, "en"), (7, A, "en"), (9, A, "en"), (None, A, "en"),
        (20, "x " + B, "b"), (20, "x " + C[::-1], "c"), (21, C[::-1], "d"), (None, None, "en"), (None, "", "en"), (5, " ", "en"), (5, " ", "en"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    key = lambda r: tuple(map(str, r))
    want = [(7, A, "en"), (20, "x " + B, "b"), (20, "x " + C[::-1], "c"), (None, C, "en"), (None, None, "en"), (None, "", "en"), (5, " ", "en"), (5, " ", "en")]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_near_duplicates_of_real_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    classes = corpus_pipeline.ngram_jaccard_classes(docs, n=5, num=80, den=100).collect()
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()]
    assert sorted(got) == sorted({r.component_id for r in classes})


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def odd_rows(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6 + 1, " ", None, "s", 1), (10**6 + 2, "mail a@b.example.org now " * 4000, "en", "s", 100000), (10**6 + 2, "mail a@b.example.org now " * 4000, "en", "s", 100000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return real.union(odd).withColumn("extra", F.lit("x"))


def key(r):
    return tuple(map(str, r))


def test_stages_keep_columns_and_odd_rows(spark, sf):
    docs = odd_rows(spark, sf)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns), name
    kept = corpus_pipeline.quality(spark, docs, sf)
    model = gam.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    import pyarrow as pa

    want = [r for r in docs.collect() if model.score(gam.features(pa.array([r.text], pa.string())))[0] >= 0.5]
    assert sorted(map(key, kept.collect())) == sorted(map(key, want))
    kept = corpus_pipeline.language(spark, docs, sf)
    model = langid.fit(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    told = [(r, *(x[0] for x in langid.label(model, [r.text]))) for r in docs.collect()]
    want = [r for r, lang, score in told if lang != "und" and score >= 1.2 / len(model[0])]
    assert sorted(map(key, kept.collect())) == sorted(map(key, want)) and not any(r.text is None or not r.text.strip() for r in want)
    got = corpus_pipeline.personal_data(spark, docs, sf)
    want = [(r.doc_id, t := pseudonyms(r.text, queries.pii_key(spark))[0], r.lang, r.source, None if t is None else len(t), r.extra) for r in docs.collect()]
    assert sorted(map(key, got.collect())) == sorted(map(key, want)) and got.columns == docs.columns


def test_run_equals_plain_stages(spark, sf):
    """The whole pipeline against the stages one after the other, copies by brute force and ids by the library."""
    from tokenizers import Tokenizer

    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    import pyarrow as pa

    model = gam.fit(docs, labels, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    good = [r for r in docs.collect() if model.score(gam.features(pa.array([r.text], pa.string())))[0] >= 0.5]
    model = langid.fit(spark.createDataFrame(good, docs.schema), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    lang, score = langid.label(model, [r.text for r in good])
    known = [r for r, a, s in zip(good, lang, score) if a != "und" and s >= 0.3]
    least = {d for _, _, d in classes_of([(r.doc_id, r.text) for r in known], 5, 80, 100)}
    texts = {r.doc_id: pseudonyms(r.text, queries.pii_key(spark))[0] for r in known if r.doc_id in least}
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4") for d, t in texts.items()}
    spans, seqs = defaultdict(list), defaultdict(int)
    for r in corpus_pipeline.run(spark, sf).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        spans[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id] += r.length
    assert set(spans) == set(ids) and all(sum(n for _, n in s) == len(ids[d]) for d, s in spans.items())
    assert all(n <= 2048 for n in seqs.values()) and re.match("^[a-z_]+$", corpus_pipeline.STAGES[0][0])


def test_near_duplicates_keeps_columns_of_any_name_and_type(spark, monkeypatch):
    monkeypatch.setattr("paperloom.llm.common.HOT_ROWS", 8)
    docs = spark.range(90).selectExpr("if(id < 60, 5, id) as doc_id", f"if(id < 60, '{A}', concat('{B} ', id, repeat(' z', int(id)))) as text", "'keep me' as __row", "map('a', id) as `a.b`", "named_struct('x', id) as __at", "id as k").union(
        spark.createDataFrame([(None, None, "keep me", {"a": 7}, (7,), 7)] * 2, "doc_id long, text string, __row string, `a.b` map<string,long>, __at struct<x:long>, k long")
    )
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert sum(r.doc_id == 5 for r in rows) == 1 and sum(r.doc_id is None for r in rows) == 2
    assert all(r["__row"] == "keep me" and r["a.b"] == {"a": r.k} and r["__at"].x == r.k for r in rows)
    want = {d for _, _, d in classes_of([(r.doc_id, r.text) for r in docs.where("text is not null").collect()], 5, 80, 100)}
    assert {r.doc_id for r in rows if r.doc_id is not None} == want


def test_only_rows_that_filters_leave_open_are_shuffled_with_their_texts(spark, sf, monkeypatch):
    seen, join = [], corpus_pipeline.spread_join
    monkeypatch.setattr(corpus_pipeline, "spread_join", lambda left, *rest: (seen.append(left.count()), join(left, *rest))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.near_duplicates(spark, docs.union(docs.withColumn("doc_id", F.col("doc_id") + 10**6)).union(docs.limit(2)), sf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert seen[0] <= docs.count() // 100 + 4 and plan.count("Join") == 1

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import langid


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.init(3, rng).items()}
    x, y = rng.integers(97, 110, (9, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grad = langid.loss_and_gradients(p, x, y)
    for k in p:
        for _ in range(6):
            at = tuple(rng.integers(n) for n in p[k].shape)
            if k[0] == "W":
                at = (int(x[rng.integers(9), rng.integers(5)]), at[1])
            old, eps, loss = p[k][at], 1e-2, []
            for e in (eps, -eps):
                p[k][at] = old + e
                loss.append(langid.loss_and_gradients(p, x, y)[0])
            p[k][at] = old
            assert abs((loss[0] - loss[1]) / (2 * eps) - grad[k][at]) < 2e-4, k


def test_windows_see_what_a_plain_loop_sees():
    rng = np.random.default_rng(1)
    p = langid.init(3, rng)
    raw = bytes(rng.integers(97, 123, 1000).astype(np.uint8))
    total, count = np.zeros(3), 0
    padded = b" " * langid.MARGIN + raw + b" " * (langid.MARGIN + langid.CORE)
    for s in range(0, len(raw), langid.CORE):
        n = min(langid.CORE, len(raw) - s)
        x = np.frombuffer(padded[s : s + -(-n // langid.STEP) * langid.STEP + 2 * langid.MARGIN], np.uint8)[:, None]
        hf, hb = langid.states(p, x, "f"), langid.states(p, x[::-1], "b")[::-1]
        prob = langid.softmax(hf @ p["Vf"] + hb @ p["Vb"] + p["c"])[langid.MARGIN : langid.MARGIN + n, 0]
        total, count = total + prob.sum(axis=0), count + n
    assert np.allclose(langid.predict(p, [b"", raw, b"12"])[1], total / count, atol=1e-5)
    assert np.allclose(langid.predict(p, [b"abc", raw[:300], raw, raw[:999]])[2], langid.predict(p, [raw])[0], atol=1e-6)


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = langid.fit(docs, ~held)
    assert model[0] == ["de", "en", "es", "fr"]
    odd = spark.createDataFrame([(10**6, None, 1), (10**6 + 1, "", 1), (10**6 + 2, " 12 .", 1), (10**6 + 3, "the thing and " * 30000, 1), (10**6 + 4, "é", 1)], "doc_id long, text string, score int")
    out = langid.identify(docs.select("doc_id", "text").union(odd.select("doc_id", "text")), model)
    rows = {r.doc_id: r for r in out.collect()}
    truth = {r.doc_id: r.lang for r in docs.where(held).collect()}
    assert sum(rows[d].lang_pred == lang for d, lang in truth.items()) / len(truth) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert [rows[10**6 + i].lang_pred for i in range(4)] == ["und", "und", "und", "en"] and rows[10**6].score == 0 and rows[10**6 + 4].lang_pred in model[0]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert [tuple(r) for r in langid.identify(docs, model).collect()] == [(1, "und", 0.0)]
    assert langid.identify(docs.limit(0), model).count() == 0


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "train", lambda rows, langs: {"c": np.zeros(langs)})
    docs = spark.createDataFrame([(i, "some text", f"l{i % 1200}") for i in range(1230)], "doc_id long, text string, lang string")
    langs, _ = langid.fit(docs, F.lit(True), most_languages=40)
    assert langs == sorted([f"l{i}" for i in range(30)] + sorted(f"l{i}" for i in range(30, 1200))[:10])

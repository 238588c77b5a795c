import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import entities as E
from paperloom.operators import images as I
from paperloom.operators import recognition as R
from paperloom.operators.contradictions import contradictions
from paperloom.operators import sentences as S
from paperloom.operators.sentences import dedup, summaries
from paperloom.plans.analyze import analyze
from paperloom.plans.queries import ORACLES, QUERIES
from paperloom.sources.backends import Damaged, PasswordNeeded, extract_pages, model_path
from paperloom.sources.files import errors, info, read_files, validate
from paperloom.streaming import drops
from paperloom.streaming.drops import file_drops, land, landed

from .oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, sf, name):
    assert compare(spark, sf, name, QUERIES[name], ORACLES[name]) > 0


def values(spark, text, *types):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r.value for r in E.extract(df, types=list(types) or None).orderBy("ext_ord", "match_pos").collect()]


@pytest.mark.parametrize(
    "text,kind,want",
    [
        ("Due Date: March 31, 2026", "DUE_DATE", ["March 31"]),
        ("due by 31.03.2026.", "DUE_DATE", ["31.03"]),
        ("Due Date: 2024-01-05", "SIGNING_DATE", ["2024-01-05"]),
        ("Signed by John Smith on Monday", "SIGNATORY", ["John Smith on Monday"]),
        ("Signed by: John Smith", "SIGNATORY_INCOMPLETE", ["Signed by [Name not specified]"]),
        ("Rupees Five Lakh Only", "AMOUNT_IN_WORDS", ["Rupees Five Lakh O"]),
        (T.PLACEHOLDER, "ORGANIZATION", ["No readable text co"]),
        ("usd 500 and USD 500", "TOTAL_AMOUNT", ["USD 500"]),
        ("less: 50, Less: 50", "DEDUCTION", ["Less: 50"]),
        ("v 1.2.34 on 15 March 2026", "DATE", ["1.2.34"]),
        ("client: Acme Widgets and others", "ORGANIZATION", ["Acme Widgets"]),
        ("$5 $10 $10 " + " ".join(f"${i}" for i in range(20, 60)), "TOTAL_AMOUNT", ["$10"] + [f"${i}" for i in range(20, 34)]),
    ],
)
def test_entity_semantics(spark, text, kind, want):
    assert values(spark, text, kind) == want


def test_context_and_dates_taken_before(spark):
    df = spark.createDataFrame([(1, "x" * 100 + "\nInvoice # A-123\n" + "y" * 100), (2, None), (3, "")], "doc_id long, text string")
    (r,) = E.extract(df, types=["REFERENCE_NUMBER"]).collect()
    assert (r.doc_id, r.match_pos, r.value) == (1, 101, "A-123") and r.context == "..." + ("x" * 79 + "\nInvoice # A-123\n" + "y" * 64).replace("\n", " ") + "..."
    assert values(spark, "Due Date: 2024-01-05\n2024-01-05 and 2024-01-06", "DATE") == ["2024-01-06"]


def test_summaries_and_conflicts(spark):
    rows = [(1, None), (2, "too short"), (3, "word " * 29), (4, " ".join(f"Sentence number {i} speaks of topic {i * 7} at length." for i in range(9)) + " Payment due in 30 days. Pay within 45 days of it."), (5, "The same sentence stands here again. " * 12)]
    got = {r.doc_id: r for r in summaries(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].is_empty and got[2].is_empty and got[3].summary == ("word " * 29).strip() and not got[3].is_empty
    assert got[4].contradictions == ["Conflicting payment terms found: 30 days vs 45 days"] and got[4].summary.endswith("30 days vs 45 days")
    assert got[5].summary == "The same sentence stands here again."
    one = spark.createDataFrame([("non-exclusive license. A fee is non-refundable.",)], "t string").select(contradictions(F.col("t")).alias("c"))
    assert len(one.first().c) == 2


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(["a cat sat there", "a cat sat there now", "dogs run far away"],), ([],)], "s array<string>")
    out = df.select(dedup(F.col("s")).alias("s"))
    assert out.select(dedup(F.col("s")).alias("s")).collect() == out.collect()


def test_files_and_backends(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.7"), ("b.bin", b"zz"), ("c.png", b"")):
        (tmp_path / name).write_bytes(data)
    q = file_drops(spark, str(tmp_path)).writeStream.format("memory").queryName("drops").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "_cp")).start()
    q.awaitTermination(60)
    got = {r.path.rsplit("/", 1)[1]: (r.mime, r.status) for r in spark.table("drops").collect()}
    # Spark's binary reader passes over empty files, in streams and batches; rows with empty content are rejected.
    assert got == {"a.pdf": ("application/pdf", None), "b.bin": (None, 400)}
    assert {r.path.rsplit("/", 1)[1]: r.status for r in validate(read_files(spark, f"{tmp_path}/*.*")).collect()} == {"a.pdf": None, "b.bin": 400}
    assert validate(spark.createDataFrame([("3", bytearray(b""))], "doc_id string, content binary")).first().status == 422
    files = spark.createDataFrame([("1", bytearray(b"%PDF")), ("2", bytearray(b"x"))], "doc_id string, content binary")
    assert errors(validate(files)).count() == 1
    assert all(r.message and r.status == 422 and r.page_no == 0 for r in extract_pages(files).collect())
    assert extract_pages(files, lambda b: [b.decode(), "two"]).where("status IS NULL").count() == 4


def test_dropped_files_land_once_though_a_batch_fails_between_its_writes(spark, tmp_path, monkeypatch):
    source, good, bad, at = (str(tmp_path / k) for k in ("in", "good", "bad", "at"))
    (tmp_path / "in").mkdir()
    drop = lambda **files: [(tmp_path / "in" / k).write_bytes(v) for k, v in files.items()]
    run = lambda: land(file_drops(spark, source), good, bad, at).awaitTermination()
    names = lambda table: sorted((r.path.rsplit("/", 1)[1], r.batch_id) for r in landed(spark, table).collect())
    drop(a=b"%PDF-1", b=b"zz")
    run()
    drop(c=b"BM", d=b"??", e=b"x")

    def stops(rows):
        raise OSError("the second sink is lost")

    monkeypatch.setattr(drops, "errors", stops)
    with pytest.raises(Exception, match="second sink"):
        run()
    assert names(good) == [("a", 0), ("c", 1)] and landed(spark, bad).count() == 1
    # Half a folder of the second sink, as a lost driver leaves it, is passed over and then replaced.
    (tmp_path / "bad" / "batch_id=1").mkdir()
    (tmp_path / "bad" / "batch_id=1" / "part-0.parquet").write_bytes(b"half")
    assert landed(spark, bad).count() == 1
    monkeypatch.undo()
    run()
    run()
    assert names(good) == [("a", 0), ("c", 1)] and landed(spark, good).where("mime = 'image/bmp'").count() == 1
    assert sorted((r.batch_id, r.status) for r in landed(spark, bad).collect()) == [(0, 400), (1, 400), (1, 400)]
    drop(f=b"\x89PNG\r\n")
    run()
    assert names(good) == [("a", 0), ("c", 1), ("f", 2)] and landed(spark, bad).count() == 3


def test_failures_are_typed(spark, tmp_path):
    def backend(content):
        raise {b"p": PasswordNeeded(), b"d": Damaged("bad xref"), b"m": MemoryError("heap"), b"x": ValueError("odd")}[content] if content != b"n" else StopIteration("none")

    files = spark.createDataFrame([(c, bytearray(c.encode())) for c in "pdmxn"], "doc_id string, content binary")
    got = {r.doc_id: (r.status, r.error, r.message) for r in errors(extract_pages(files, backend)).collect()}
    assert got["p"] == (422, "OCR Processing Failed", "This document is password-protected. Please remove the password and re-upload.")
    assert got["d"][2].endswith("malformed: bad xref") and got["x"][2] == "PDF processing error: odd" and got["m"] == (500, "Internal Server Error", "An unexpected error occurred. Please try again.")
    assert errors(extract_pages(files, lambda b: [])).first().message == "The PDF has no pages."
    (tmp_path / "models").mkdir()
    assert model_path(str(tmp_path / "models")) == str(tmp_path / "models") == model_path("models", [str(tmp_path)]) and model_path("nowhere").endswith("/nowhere")
    assert info(spark).first().most_mb == 50


def test_engine_is_asked_again_only_where_the_first_text_is_poor(spark):
    import numpy as np

    good = np.full((30, 40), 230, np.uint8)
    rows = [("a", 30, 40, 1, 0, bytearray(good.tobytes())), ("b", 30, 40, 1, 0, bytearray((good - 60).tobytes())), ("c", -1, -1, -1, -1, bytearray())]
    images = spark.createDataFrame(rows, "origin string, height int, width int, nChannels int, mode int, data binary")

    def engine(raster, language, mode, settings):
        if mode == 3:
            return "#### ~~~~ %%%%"
        return f"read by block in {language}, no invert {settings['tessedit_do_invert']}"

    got = {r.origin: r for r in R.recognise(images, engine, ["ben"]).collect()}
    assert got["a"].text == "read by block in eng, no invert 0" and got["a"].warnings[0].startswith("LOW_RESOLUTION") and got["a"].detected == "eng"
    assert got["c"].text == "" and got["c"].confidence == 10 and got["c"].error
    plain = {r.origin: r for r in R.recognise(images, lambda *a: "a text that is clear and good from the start").collect()}
    assert plain["b"].text.startswith("a text that is clear")


def test_pages_of_odd_documents(spark):
    rows = [(1, 1, None, None, None, None, True), (2, 1, "x" * 60, None, None, None, None), (3, 1, " ", "Some clear text of a page", None, 1.04, False), (3, 2, None, None, None, -2.0, True)]
    rows += [(4, k, "", f"Head\n\nbody {k} of the page with words\nFoot", None, 0.0, False) for k in range(1, 6)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, native string, block string, layout string, skew double, failed boolean")
    got = {r.doc_id: r for r in R.documents(pages).collect()}
    assert (got[1].text, got[1].confidence, got[1].warnings) == ("", 10.0, ["Page 1 could not be processed."])
    assert got[2].native and got[2].confidence == 98 and got[2].warnings == [R.NATIVE] and got[2].detected == "native-text"
    assert got[3].warnings == ["Page 1: deskewed 1.0°", "Page 2: deskewed -2.0°", "Page 2 could not be processed."] and got[3].text == "Some clear text of a page"
    assert got[4].text == "\n\n".join(f"body {k} of the page with words" for k in range(1, 6))
    assert R.documents(pages.limit(0)).count() == 0


def test_trim_takes_what_lies_up_to_the_blank(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", " ", "\n", "\0", "\x1f", "é", "\u00a0", "\u3000", "\t", "\x7f"], k=rng.randrange(12))) for _ in range(5000)] + [" " * 10**6, "a" + " " * 10**6 + "b", "\0", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.trim(F.col("text")).alias("out")).collect()
    assert [r.text for r in rows if r.out != r.text.strip(T.CONTROLS)] == [] and spark.sql("SELECT cast(null AS string) AS t").select(T.trim(F.col("t")).alias("t")).first().t is None


def test_poor_text_is_judged_alike_in_rows_and_beside_an_engine(spark):
    import random

    rng = random.Random(2)
    bits = ["word ", "a ", "é ", "%", "#", "x ", "7 ", "٣ ", "\n", "\t", "\x0b", " ", "中文 ", "=", "]", "\\", ". ", "\u00a0", "\x1f", "quite a clear text here ", "'", "^ "]
    texts = ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(3000)] + ["", "q " * 11, " q" * 10 + " clear words", "%" * 10**5]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.is_low_quality(F.col("text")).alias("low")).collect()
    assert {r.low for r in rows} == {True, False} and [r.text for r in rows if R.poor(r.text) != r.low] == []


def test_pages_fail_alone_and_native_ones_are_not_read(spark):
    import numpy as np

    sheet = np.full((40, 30), 240, np.uint8)
    sheet[10:14] = 10
    ok, rgb = bytearray(sheet.tobytes()), bytearray(np.repeat(sheet[..., None], 3, 2).tobytes())
    rows = [("a", 1, None, 40, 30, 1, ok), ("a", 2, "y" * 60, 40, 30, 1, ok), ("a", 3, "", -1, -1, -1, None), ("b", 1, None, 40, 30, 3, rgb), ("b", 2, None, 40, 31, 1, ok), ("c", 1, None, None, None, None, None), ("d", 1, "short", 40, 30, 1, ok), ("d", 1, "short", 40, 30, 1, ok)]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, native string, height int, width int, nChannels int, data binary").withColumn("reason", F.lit("clash"))

    def engine(raster, language, mode, settings):
        if mode == R.BLOCK:
            return None if raster.shape[0] < 1 else "%%%%"
        return f"a clear text in {language} by layout of {raster.shape[1]}"

    got = {(r.doc_id, r.page_no): r for r in R.read_pages(pages, engine, ["hin"]).collect()}
    assert got["a", 1].layout == "a clear text in eng+hin by layout of 90" == got["b", 1].layout and not got["a", 1].failed
    assert got["a", 2].block is None and not got["a", 2].failed and got["a", 2].native == "y" * 60
    assert (got["a", 3].failed, got["a", 3].reason) == (True, "cannot read image") == (got["c", 1].failed, got["c", 1].reason) and "reshape" in got["b", 2].reason
    docs = {r.doc_id: r for r in R.scanned_documents(pages, engine, ["hin"]).collect()}
    assert docs["a"].detected == "mixed" and docs["a"].warnings[0] == R.MIXED % (1, 2) and docs["a"].warnings[-1] == "Page 3 could not be processed."
    assert docs["b"].warnings == ["Page 1: Used automatic layout detection for better results.", "Page 2 could not be processed."] and docs["c"].confidence == 10 and docs["d"].page_count == 2
    assert "Exchange" not in R.read_pages(pages, engine)._jdf.queryExecution().executedPlan().toString() and R.scanned_documents(pages.limit(0), engine).count() == 0

    def stops(raster, *rest):
        raise OSError("no model") if raster.shape[1] == 90 else ValueError

    images = spark.createDataFrame([("a", 40, 30, 1, 0, ok)], "origin string, height int, width int, nChannels int, mode int, data binary")
    r = R.recognise(images, stops).first()
    assert r.text == "" and r.first_failure == "OSError: no model" == r.second_failure and r.probe_failure is None


def test_analysis_of_blank_text(spark):
    r = analyze(spark.createDataFrame([(1, " ")], "doc_id long, text string")).first()
    assert r.text == T.PLACEHOLDER and r.metadata.word_count == 22 and not r.is_empty and r.metadata.ocr_confidence_percent == 10


def test_kernels_agree_with_pixel_rows(spark):
    import numpy as np

    a = np.full((40, 60, 3), 250, np.uint8)
    a[10:12, 5:55] = 20
    out, seen = I.enhance(a)
    assert seen["low_resolution"] and set(np.unique(out)) <= {0, 255} and (out == 0).any() and abs(seen["skew"]) <= 1
    assert (I.rotate(np.full((9, 9), 7.0), 0) == 7).all()


@pytest.mark.parametrize("part", ["\n", "\r\n", " ", "\t", ".", "!", "\f", "-\n", "due date ", "1", "1,", "less: ", "a", " ", "--- ", "$ "])
def test_long_runs_cost_their_length(spark, part):
    n = 1_000_000 // len(part) if len(part) < 4 else 20_000
    rows = [(1, "Some words stand here" + part * n + "and here. "), (2, part * n), (3, "x y" + part * n)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    c = F.col("text")
    cleaned = d.select("doc_id", *[F.length(f(c)).alias(f.__name__) for f in (T.trim, T.strip_end, T.ink, T.clean, T.normalize_native, T.normalize_ocr)], F.size(T.tokens(c)).alias("tokens"), F.size(T.sentences(c)).alias("sentences"))
    assert len(T.with_quality(d).drop("text").collect()) == len(cleaned.collect()) == 3
    blank = part.strip() == ""
    assert cleaned.where("doc_id = 2").first().trim == (0 if all(x <= " " for x in part) else len((part * n).strip("".join(map(chr, range(33))))))
    assert blank or part == " " or d.select(F.size(contradictions(c)).alias("k")).where("k > 0").count() == 0
    if part in ("due date ", "1", "1,", "less: ", "$ ", " ", "\n"):
        assert E.extract(d, types=["DUE_DATE", "SIGNING_DATE", "TOTAL_AMOUNT", "DEDUCTION", "SIGNATORY", "SIGNATORY_INCOMPLETE", "REFERENCE_NUMBER"]).count() >= 0


@pytest.mark.parametrize(
    "text,kind,want",
    [
        ("due date   ABC, x", "DUE_DATE", ["ABC, x"]),
        ("due date  -  AB, x", "DUE_DATE", ["AB, x"]),
        ("due date: ab.", "DUE_DATE", []),
        ("The twenty-first day of June, two thousand ten. the first  day of May", "DATE_WRITTEN_FORM", ["The twenty-first day of June, two thousand ten", "the first  day of May"]),
        ("First day of May, 2024 and more", "DATE_WRITTEN_FORM", ["First day of May, 2024 and more"]),
        ("Invoice no. - AB/12-x.3 and ticket #9, case id: abc PO number 12345", "REFERENCE_NUMBER", ["AB/12-x.3", "12345"]),
        ("Order # -77a", "REFERENCE_NUMBER", ["77a"]),
        ("$1.2345 million and 12,34,567 or 12,34,5678 and 99 lakh rupees", "TOTAL_AMOUNT", ["$1.23", "45 million", "12,34,567", "99 lakh rupees"]),
        ("less:   - $ 50 or minus 7", "DEDUCTION", []),
        ("Less:   - $ 50.5 TDS 7", "DEDUCTION", ["Less:   - $ 50.5", "TDS 7"]),
        ("Seller: Blue Sky Ltd. and more", "ORGANIZATION", ["Blue Sky Ltd."]),
        ("Executed by :  Ada  Lovelace, duly authorized", "SIGNATORY", ["Ada  Lovelace"]),
    ],
)
def test_entity_literals(spark, text, kind, want):
    assert values(spark, text, kind) == want


def test_places_of_many_matches(spark):
    text = "x" + " TDS 17" * 3000
    rows = E.extract(spark.createDataFrame([(1, text)], "doc_id long, text string"), types=["DEDUCTION"]).select("match_pos", "value").collect()
    assert sorted(map(tuple, rows)) == [(2 + 7 * i, "TDS 17") for i in range(3000)]


def test_rows_of_one_id_stay_apart(spark):
    long = " ".join(f"Sentence number {i} speaks of topic {i * 7} at some length." for i in range(9))
    rows = [(1, long), (1, long), (1, "Invoice # A-123 " * 3), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.summary, len(r.entities)) for r in analyze(df).collect()]
    assert len(got) == 4 and len({g[1] for g in got}) == 2
    assert summaries(df).count() == 4 and "Exchange" not in analyze(df)._jdf.queryExecution().executedPlan().toString()


def test_masked_text_has_the_same_organisations(spark):
    import random

    rng = random.Random(1)
    bits = ["Acme", "co", "Corp.", "Ltd.", "Technologies", " ", "  ", "\n", ":", "-", "client", "between", "Buyer :", "and", "herein", "as", ",", ";", "(", "x" * 30, "the quick brown fox jumps over", "Services", "inc", "é", "7", "&", "'", ".", " " * 70, "Partners", "licensee"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(4000)] + ["client" + " " * 300_000 + ": Acme Ltd", "x" * 10**6 + " Ltd", "co" * 10**5]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    plain = F.regexp_extract_all("text", F.lit(E.ORGANIZATION), F.lit(0))
    near = E.near_marks(F.col("text"))
    assert d.where((plain != F.regexp_extract_all(near, F.lit(E.ORGANIZATION), F.lit(0))) | (F.length(near) != F.length("text"))).count() == 0


def test_entities_keep_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "Invoice no: AB-77 of Acme Ltd", "a", "b", "c")], "doc_id long, text string, __e0_text string, __once0 string, `x.y` string")
    (r,) = E.with_entities(d).collect()
    assert (r["__e0_text"], r["__once0"], r["x.y"]) == ("a", "b", "c") and [(e.type, e.value) for e in r.entities] == [("ORGANIZATION", "AB-77 of Acme Ltd"), ("REFERENCE_NUMBER", "AB-77")]


def test_columns_of_any_name_are_kept(spark):
    names = ["__text0", "__clean0", "__SENTS0", "__ink0", "__again0", "__raw0", "__once0"]
    more = lambda d: d.select("*", *[F.lit(n).alias(n) for n in names])
    docs = more(spark.createDataFrame([(1, "Some words. " * 40)], "doc_id long, text string"))
    pages = more(spark.createDataFrame([(1, 1, None, "x", "a clear text of enough words", 0.0, False)], "doc_id long, page_no int, native string, block string, layout string, skew double, failed boolean"))
    images = more(spark.createDataFrame([("x", "a clear text of enough words", False, 100.0, 0.0, "eng")], "first string, second string, low_resolution boolean, brightness double, skew double, language string"))
    for out in (S.with_summary(docs), T.with_quality(docs), R.page_texts(pages), R.image_texts(images)):
        assert [out.first()[n] for n in names] == names and not [c for c in out.columns if c.startswith("__") and c not in names]


def test_sentences_are_deduplicated_by_an_index_as_by_a_fold(spark):
    import random
    import time

    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "Ärger", "É"]
    rows = [(k, [" ".join(rng.choices(words[: rng.choice([6, 12, 44])], k=rng.randrange(0, 12))) + rng.choice([".", "", " ..."]) for _ in range(rng.choice([0, 1, 30, 99, 160]))]) for k in range(60)] + [(100, None)]
    d = spark.createDataFrame(rows, "doc_id long, sentences array<string>")
    want = {r.doc_id: r.s for r in d.select("doc_id", dedup(F.col("sentences")).alias("s")).collect()}
    got = {r.doc_id: r.sentences for r in S.with_dedup(d, "sentences").collect()}
    assert {k: v or None for k, v in got.items()} == {k: v or None for k, v in want.items()}
    long = [" ".join(f"u{rng.randrange(20000)}" for _ in range(15)) for _ in range(60_000)]
    long += [s + " more" for s in long[:40_000]]
    began = time.perf_counter()
    kept = S._first_of_similar([frozenset(s.split()) for s in long])
    assert time.perf_counter() - began < 60 and sum(kept) == 60_000 and all(kept[:60_000])

"""What keeps queries bounded on large tables: how rows are dealt out, and which joins are planned."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.operators import entities as E
from paperloom.operators import sentences as S
from paperloom.plans import fixtures as X
from paperloom.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("made", [X.pixels, X.wide_pixels, X.sheets, X.contracts, X.page_sets])
def test_rows_are_dealt_before_much_is_made_of_them(spark, sf, made):
    assert made(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_the_number_of_tasks_grows_with_the_table(spark):
    rows = spark.range(3 * X.TASK_PIXELS // 256)
    assert X.dealt(rows, "id", 256 * 7).rdd.getNumPartitions() == 21


@pytest.mark.parametrize("name", ["img_histogram", "img_projection", "img_gray", "img_threshold", "img_threshold_small", "img_integral", "img_sharpen", "img_close", "img_denoise"])
def test_pixels_of_a_dealt_image_are_not_shuffled_again(spark, sf, name):
    assert plan(QUERIES[name](spark, sf)).count("Exchange") == 1


@pytest.mark.parametrize("name", ["img_contrast", "img_downscale", "img_threshold_integral", "img_upscale"])
def test_pixels_are_never_broadcast(spark, sf, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["img_skew", "img_rotate"])
def test_only_the_table_of_angles_is_broadcast(spark, sf, name):
    lines = plan(QUERIES[name](spark, sf)).splitlines()
    below = [lines[k + 1 : k + 4] for k, line in enumerate(lines) if "BroadcastExchange" in line]
    assert below and all(any("tenths" in line and "Scan" in line for line in some) for some in below)


def test_a_date_looks_only_for_values_that_can_be_dates(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert "crore" not in plan(E.extract(df, types=["DATE"], places=False))


@pytest.mark.parametrize("text", ["", "Invoice # A-123 and Invoice # B-456", "￾Invoice # A-123￿ or ￿Invoice # B-456￾", "Invoice # A-123", "no match ￾"])
def test_places_of_texts_that_hold_the_marks(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.match_pos, r.value) for r in E.extract(df, types=["REFERENCE_NUMBER"]).orderBy("match_pos").collect()]
    assert got == [(m.start(), m.group(1)) for m in re.finditer(r"Invoice # ([\w-]+)", text)]


def test_a_text_is_searched_once_for_matches_and_their_places(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert plan(df.select(E.search(df.text, "(?i)needle", True).alias("m"))).count("(?:(?i)needle)") == 1


@pytest.mark.parametrize("text,left", [("A text with no mark in it, of some names", ""), ("Acme Ltd. and then there is nothing more", "Acme Ltd."), ("Buyer: Orion Holdings Big Name, and", "Buyer: Orion Holdings Big Name, and"), ("Foo Co and Bar Corp.", "Foo Co and Bar Corp.")])
def test_little_is_left_to_search_for_organisations(spark, text, left):
    df = spark.createDataFrame([(text,)], "text string").withColumn("near", E.near_marks(F.col("text")))
    found = [F.regexp_extract_all(c, F.lit(E.ORGANIZATION), F.lit(0)) for c in ("text", "near")]
    near, plainly, quickly = df.select("near", *found).first()
    assert near.rstrip("\0") == left and plainly == quickly


def test_an_organisation_that_is_a_date_is_no_date(spark):
    rows = [(1, "Buyer: Jan 5, 2023\nOn Jan 5, 2023 and Feb 6, 2024"), (2, "Buyer Acme Ltd of Jan 5, 2023"), (3, "client: Mar 7 2020; Acme Ltd on Mar 7 2020")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    every = {(r.doc_id, r.value) for r in E.extract(df).where("type = 'DATE'").collect()}
    alone = {(r.doc_id, r.value) for r in E.extract(df, types=["DATE"], places=False).collect()}
    assert alone == every and {d for d, _ in alone} == {1, 2}


def test_lists_become_python_objects_a_slab_at_a_time():
    seen, lists = [], pa.array([["word " * 200] * 20, None, []] * 400, pa.list_(pa.string()))
    out = S.by_slab(lambda part: (seen.append(part.nbytes), pa.array(part.is_null()))[1])(lists)
    assert out.equals(lists.is_null()) and len(seen) > 2 and max(seen) <= 2 * S.SLAB_BYTES
    assert len(S.by_slab(lambda part: part)(lists.slice(0, 0))) == 0


def test_the_rows_of_an_analysis_look_for_no_entities(spark, sf):
    assert "crore" not in plan(QUERIES["analysis_rows"](spark, sf))


def test_a_summary_is_one_python_step(spark, sf):
    assert plan(QUERIES["summary"](spark, sf)).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["img_upscale", "img_rotate"])
def test_what_is_made_of_pixels_is_not_shuffled(spark, sf, name):
    """Keys are dealt out; after that no exchange carries pixels or what is made of them."""
    lines = plan(QUERIES[name](spark, sf)).splitlines()
    for k in (k for k, line in enumerate(lines) if "Exchange hashpartitioning" in line):
        assert "REPARTITION_BY_NUM" in lines[k], lines[k]


def test_the_means_of_cells_join_sizes_without_a_broadcast_at_any_size(spark, sf):
    """Exploded pixels are taken for few, so a join that is not named would send them all to the driver (img_downscale)."""
    p = plan(QUERIES["img_downscale"](spark, sf))
    assert "ShuffledHashJoin" in p and "Broadcast" not in p and p.count("Exchange") <= 2


@pytest.mark.parametrize("name,made", [("img_integral", 2), ("img_threshold_integral", 4)])
def test_sorted_pixels_have_tasks_in_step_with_their_sorts(spark, sf, monkeypatch, name, made):
    monkeypatch.setattr(X, "TASK_PIXELS", 1 << 12)
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").count()
    assert QUERIES[name](spark, sf).rdd.getNumPartitions() >= suppliers * X.WIDE_SIDE**2 * made // X.TASK_PIXELS


def test_the_number_of_sheets_a_task_cleans_does_not_grow(spark, sf, monkeypatch):
    before = X.bar_pages(spark, sf).rdd.getNumPartitions()
    monkeypatch.setattr(X, "TASK_PIXELS", X.SHEETS_COST)
    assert X.bar_pages(spark, sf).rdd.getNumPartitions() > before


def test_a_page_is_cleaned_up_in_whole_numbers_as_in_doubles():
    import numpy as np

    from paperloom.operators import images as I

    rng = np.random.default_rng(5)
    for h, w in ((1, 1), (2, 7), (40, 90), (130, 75)):
        a = rng.integers(0, 256, (h, w)).astype(np.uint8)
        for kernel, unit in ((I.BLUR, 16), (I.SHARPEN, 5)):
            want = a.copy()
            for y in range(1, h - 1):
                for x in range(1, w - 1):
                    want[y, x] = min(255, max(0, np.floor(sum(kernel[i][j] * float(a[y + i - 1, x + j - 1]) for i in range(3) for j in range(3)) + 0.5)))
            assert (I._convolved(a, [[round(k * unit) for k in row] for row in kernel], unit) == want).all()
        near = lambda y, x: a[max(0, y - I.REACH) : y + I.REACH + 1, max(0, x - I.REACH) : x + I.REACH + 1]
        want = [[0 if a[y, x] < near(y, x).mean() - I.OFFSET else 255 for x in range(w)] for y in range(h)]
        assert I._thresholded(a).tolist() == want


@pytest.mark.parametrize("name", ["image_driver", "mixed_document", "scanned_pages"])
def test_pages_are_dealt_by_their_documents_before_they_are_made(spark, sf, name):
    """Rows of a small table would be one task else; the exchange carries keys and names, no pages."""
    lines = plan(QUERIES[name](spark, sf)).splitlines()
    dealt = [k for k, line in enumerate(lines) if "REPARTITION_BY_NUM" in line and "hashpartitioning" in line]
    assert len(dealt) == 1 and not any("Generate" in line for line in lines[dealt[0] :]) and any("Generate" in line for line in lines[: dealt[0]])

"""Recognised text: language choice, the second try, warnings, and pages joined into documents.

Everything but the engine itself is a Column or DataFrame expression.  An engine is a function
(raster, language, page mode, settings) -> text that ``run_engine`` calls for the rows that need it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.rows import fresh, let, once
from paperloom.operators import images as I
from paperloom.session import ship_package

#: Engine settings, page modes (whole layout, one block), and models in the order of their listing.
SETTINGS = {"ocr_engine_mode": "1", "tessedit_do_invert": "0", "preserve_interword_spaces": "1", "tessedit_char_blacklist": "|~`\\"}
LAYOUT, BLOCK = 3, 6
MODELS = ["eng", "ben", "hin"]
#: Marks that tell of a wrong language, and their share of all characters.
WRONG_MARKS, WRONG_SHARE = r"~%|#\^&*@<>{}\[\]\\", 0.08
#: The marks of both classes of characters one by one.
WRONG, MARKS = (frozenset(re.sub(r"\\(?=[\^\[\]\\])", "", c)) for c in (WRONG_MARKS, T.GARBAGE))
#: Inked characters of a native page, the confidence of native text, and messages.
NATIVE_LEAST, NATIVE_SURE = 50, 98.0
NATIVE = "NATIVE_PDF: This is a digital PDF — text was extracted directly without OCR for maximum accuracy."
MIXED = "MIXED_PDF: %d page(s) used direct text extraction, %d page(s) used OCR."
TURNED = "Page %d: deskewed %.1f°"
RETRIED = "Page %d: Used automatic layout detection for better results."
FAILED = "Page %d could not be processed."
NO_TEXTS = "array<string>"


def models(available: list[str]) -> list[str]:
    """English, whether it is listed or not, and what else is there."""
    return [m for m in MODELS if m == "eng" or m in available]


def choose_language(probe: Column, available: list[str]) -> Column:
    """The model to use: English, or all that are there if the probe in English is lost or full of wrong marks."""
    have = models(available)
    if len(have) == 1:
        return F.lit("eng")
    wrong = F.length(F.regexp_replace(probe, f"[^{WRONG_MARKS}]+", "")) / F.length(probe)
    return F.when(probe.isNull() | ((F.length(probe) > 0) & (wrong > WRONG_SHARE)), "+".join(have)).otherwise("eng")


def takes_second(first: Column, second: Column) -> Column:
    """Whether the second try replaces a first one of low quality: only if its letter share is strictly higher."""
    ratio = lambda c: F.coalesce(T.alnum_ratio(c), F.lit(0.0))
    return T.is_low_quality(first) & (ratio(second) > ratio(first))


def better(first: Column, second: Column) -> Column:
    return F.when(takes_second(first, second), second).otherwise(first)


def image_texts(rows: DataFrame, language: str = "language") -> DataFrame:
    """Results of images: columns first, second (texts), low_resolution, brightness, skew and a language.

    Adds text (cleaned), warnings, confidence (of the raw text), page_count, native and detected.  A null
    measurement (clean-up failed) gives no warning.
    """
    (raw,) = fresh(rows, "raw")
    d = once(rows, **{raw: better(F.col("first"), F.col("second"))})
    d = d.withColumn("warnings", I.warnings(F.col("low_resolution"), F.col("brightness"), F.col("skew")))
    return d.withColumns(
        {"text": T.normalize_ocr(F.col(raw)), "confidence": T.confidence(F.col(raw), F.col("warnings")), "page_count": F.lit(1), "native": F.lit(False), "detected": F.col(language)}
    ).drop(raw)


def run_engine(rows: DataFrame, engine: Callable, into: str, mode: int, language: Column, where: Column | None = None) -> DataFrame:
    """Adds the engine's text of each raster (height, width, data), null where it is not asked for or fails, and ``<into>_failure``, what it failed of."""
    ship_package(rows.sparkSession)
    spoken, wanted = fresh(rows, "language", "asked")
    asked = rows.withColumns({spoken: language, wanted: F.lit(True) if where is None else F.coalesce(where, F.lit(False))})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{into}` string, `{into}_failure` string"
    names = rows.columns

    def run(frames):
        for pdf in frames:
            out, lost = [], []
            for r in pdf.to_dict("records"):
                text = failure = None
                try:
                    if r[wanted]:
                        text = engine(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]), r[spoken], mode, SETTINGS)
                except Exception as e:  # a lost try is one null text
                    failure = f"{type(e).__name__}: {e}"
                out.append(text)
                lost.append(failure)
            done = pdf[names].copy()
            done[into], done[f"{into}_failure"] = out, lost
            yield done

    return asked.mapInPandas(run, schema)


def recognise(images: DataFrame, engine: Callable, available: list[str] = MODELS[:1]) -> DataFrame:
    """Images (Spark's image columns) to texts: cleaned up, language probed, read by layout, and as one block where that is poor.

    What a try failed of stands in probe_failure, first_failure and second_failure.
    """
    d = I.preprocess(images)
    d = run_engine(d, engine, "probe", BLOCK, F.lit("eng"), F.lit(len(models(available)) > 1))
    d = d.withColumn("language", choose_language(F.col("probe"), available))
    d = run_engine(d, engine, "first", LAYOUT, F.col("language"))
    d = run_engine(d, engine, "second", BLOCK, F.col("language"), T.is_low_quality(F.col("first")))
    return image_texts(d).drop("data", "probe", "first", "second")


def poor(text: str) -> bool:
    """``T.is_low_quality`` beside an engine, where the text is in no column yet."""
    ink = re.sub(r"[ \t-\r]+", "", text)
    words = re.findall(r"[^ \t-\r]+", text)
    n = len(words) + (text[:1] != ink[:1])
    single = sum(len(w) == 1 and w not in "aAI0123456789" for w in words) / n if n > 10 else 0.0
    if len(text.strip("".join(map(chr, range(33))))) < 20 or not ink:
        return True
    letters = sum(c.isalpha() or c.isdecimal() or c in ".,'\"-" for c in ink)
    return letters / len(ink) < 0.5 or sum(c in MARKS for c in ink) / len(ink) > 0.05 or single > 0.3


def _probed(read: Callable[[str], str], available: list[str]) -> str:
    """``choose_language`` beside an engine; a probe that fails is lost."""
    have = models(available)
    if len(have) == 1:
        return "eng"
    try:
        probe = read("eng")
    except Exception:  # the probe alone is lost, as in choose_language
        probe = None
    wrong = probe is None or (probe and sum(c in WRONG for c in probe) / len(probe) > WRONG_SHARE)
    return "+".join(have) if wrong else "eng"


def read_pages(pages: DataFrame, engine: Callable, available: list[str] = MODELS[:1]) -> DataFrame:
    """Pages (doc_id, page_no, native, height, width, nChannels, data) as ``page_texts`` takes them, with the reason of a failure.

    A page with enough text of its own is not read, and its raster stays in the JVM.  Any other is cleaned up, its
    language probed, read as one block, and again by layout if that is poor: one call of Python for each page, so that a
    raster is shipped once.  Whatever fails is that page's failure alone.  Nothing is shuffled: pages of one document
    are read wherever they lie.  Null or damaged rasters fail; a null native text is empty; other columns end here.
    """
    ship_package(pages.sparkSession)
    own = F.length(T.ink(F.coalesce("native", F.lit("")))) >= NATIVE_LEAST
    raster = F.when(~own, F.struct("height", "width", "nChannels", "data"))
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"doc_id {kind['doc_id']}, page_no {kind['page_no']}, native string, block string, layout string, skew double, failed boolean, reason string"

    def one(raster: dict | None) -> dict:
        out = {"block": None, "layout": None, "skew": None, "failed": False, "reason": None}
        if raster is None:
            return out
        try:
            h, w, bands = (raster[k] or 0 for k in ("height", "width", "nChannels"))
            if h <= 0 or not raster["data"]:
                raise ValueError("cannot read image")
            raw = np.frombuffer(raster["data"], np.uint8).reshape(h, w, bands)
            a, seen = I.enhance(raw[..., 2::-1] if bands >= 3 else raw)
            out["skew"] = seen["skew"]
            language = _probed(lambda name: engine(a, name, BLOCK, SETTINGS), available)
            out["block"] = engine(a, language, BLOCK, SETTINGS)
            if poor(out["block"] or ""):
                out["layout"] = engine(a, language, LAYOUT, SETTINGS)
        except Exception as e:  # one bad page is one failed page
            out |= {"failed": True, "reason": str(e) or type(e).__name__}
        return out

    def run(batches):
        import pyarrow as pa

        for b in batches:
            done = [one(r) for r in b.column("raster").to_pylist()]
            kinds = [("block", pa.string()), ("layout", pa.string()), ("skew", pa.float64()), ("failed", pa.bool_()), ("reason", pa.string())]
            read = [pa.array([d[k] for d in done], t) for k, t in kinds]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in ("doc_id", "page_no", "native")] + read, ["doc_id", "page_no", "native"] + [k for k, _ in kinds])

    return pages.select("doc_id", "page_no", "native", raster.alias("raster")).mapInArrow(run, schema)


def scanned_documents(pages: DataFrame, engine: Callable, available: list[str] = MODELS[:1], language: str = "eng") -> DataFrame:
    """Documents (see ``documents``) of page rasters, read by an engine.  Only texts are shuffled."""
    return documents(read_pages(pages, engine, available).drop("reason"), language)


def page_texts(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, native, block, layout, skew, failed) with is_native, text and notes.

    native: the page's own text; block and layout: what the engine read in its two modes; failed: it could not be read.
    A native page keeps its own text; a failed one has none, and a note.
    """
    failed = F.coalesce("failed", F.lit(False))
    own = F.length(T.ink(F.coalesce("native", F.lit("")))) >= NATIVE_LEAST
    (again,) = fresh(pages, "again")
    d = once(pages, is_native=own, **{again: ~failed & takes_second(F.col("block"), F.col("layout"))})
    read = F.when(F.col(again), F.col("layout")).otherwise(F.col("block"))
    note = lambda when, form, *args: F.when(when, F.format_string(form, *args))
    notes = F.array_compact(F.array(note(F.abs("skew") > 1.0, TURNED, F.col("page_no"), F.col("skew")), note(F.col(again), RETRIED, F.col("page_no")), note(failed, FAILED, F.col("page_no"))))
    text = F.when(F.col("is_native"), T.normalize_native(F.col("native"))).when(failed, "").otherwise(T.normalize_ocr(T.trim(F.coalesce(read, F.lit("")))))
    return d.withColumns({"text": text, "notes": F.when(F.col("is_native"), F.array().cast(NO_TEXTS)).otherwise(notes)}).drop(again)


def without_repeated(pages: Column, share: float = 0.6) -> Column:
    """A document's page texts without the lines that stand first or last on ceil(share * pages) of them or more.

    Documents of one or two pages stay.  At most three lines can be so frequent; in sorted order such a line
    is equal to the one that many places on, so the cost is that of a sort.
    """
    blank = lambda line: T.trim(line) == ""
    ends = F.flatten(F.transform(F.transform(pages, lambda p: F.split(p, "\n")), lambda ls: F.when(F.size(ls) > 1, F.array(T.trim(ls[0]), T.trim(F.element_at(ls, -1)))).otherwise(F.array(T.trim(ls[0])))))
    least = F.ceil(F.size(pages) * share).cast("int")

    def frequent(ends: Column) -> Column:
        places = F.when(F.size(ends) >= least, F.sequence(F.lit(0), F.size(ends) - least)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(F.filter(places, lambda i: ends[i] == ends[i + least - 1]), lambda i: ends[i]))

    def strip(marks: Column) -> Column:
        kept = lambda p: F.filter(F.split(p, "\n"), lambda line: ~F.array_contains(marks, T.trim(line)))
        return F.when(F.size(marks) > 0, F.transform(pages, lambda p: T.trim(F.array_join(kept(p), "\n")))).otherwise(pages)

    marks = let(F.array_sort(F.filter(ends, lambda e: ~blank(e))), frequent)
    return F.when(F.size(pages) > 2, let(marks, strip)).otherwise(pages)


def documents(pages: DataFrame, language: str = "eng") -> DataFrame:
    """(doc_id, text, page_count, native, detected, confidence, warnings) of page rows (see ``page_texts``).

    All pages native: their own text, cleaned as a whole.  Otherwise page by page, without repeated lines; a
    document with both kinds says how many of each.  One shuffle brings a document's pages together.
    """
    d = page_texts(pages)
    own = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "native", "text", "notes", "is_native"))).alias("p"))
    own = own.withColumns({"page_count": F.size("p"), "__native": F.size(F.filter("p", lambda x: x["is_native"]))})
    whole, mixed = F.col("__native") == F.col("page_count"), F.col("__native") > 0
    raw = F.array_join(F.transform("p", lambda x: F.coalesce(x["native"], F.lit(""))), "\n")
    read = T.trim(F.array_join(without_repeated(F.transform("p", lambda x: x["text"])), "\n\n"))
    count = F.array(F.format_string(MIXED, F.col("__native"), F.col("page_count") - F.col("__native")))
    notes = F.flatten(F.transform("p", lambda x: x["notes"]))
    own = once(own, text=F.when(whole, T.normalize_native(raw)).otherwise(read), warnings=F.when(whole, F.array(F.lit(NATIVE))).when(mixed, F.concat(count, notes)).otherwise(notes))
    sure = F.when(whole, NATIVE_SURE).otherwise(T.confidence(F.col("text"), F.col("warnings")))
    detected = F.when(whole, "native-text").when(mixed, "mixed").otherwise(language)
    return own.select("doc_id", "text", "page_count", whole.alias("native"), detected.alias("detected"), sure.alias("confidence"), "warnings")

"""Text clean-up and quality measures as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.rows import fresh, once

#: Marks of page breaks and failed pages, and the text that stands for no text.
PAGE_BREAK = r"---\s*Page Break\s*---"
FAILED_PAGE = r"\[Page \d+: Could not be processed\]"
PLACEHOLDER = "[No readable text could be extracted from this document. The image may be too low resolution, blank, or contain only graphical elements.]"
#: Characters that one-to-one clean-up maps, those that trimming takes, marks that count as garbage, and ligatures.
BULLETS = "Ø·•●"
DASHES = "‐‑‒–—―"
CONTROLS = "".join(map(chr, range(33)))
GARBAGE = r"~%|#^&*@<>{}\[\]\\=+"
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


#: What a warning takes from the confidence.
COSTS = {"LOW_RESOLUTION": 10, "DARK_IMAGE": 5}


def trim(c: Column) -> Column:
    """Removes code points up to U+0020 at both ends."""
    return F.trim(c, F.lit(CONTROLS))


def strip_end(c: Column) -> Column:
    """Removes white space at the end; a run of it inside is looked at once, not from each of its places."""
    return F.regexp_replace(c, r"(?<!\s)\s++\z", "")


def ink(c: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(c, r"\s+", "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(r"\S"), F.lit(False))


def ink_length(c: Column) -> Column:
    return F.length(ink(c))


def alnum_length(c: Column) -> Column:
    """Number of letters, digits and . , ' \" -"""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{Nd}.,'\"-]+", ""))


def alnum_ratio(c: Column, ink_n: Column | None = None, alnum_n: Column | None = None) -> Column:
    """Letters, digits and . , ' \" - among the characters that are not white space; 0 if there are none."""
    n = ink_length(c) if ink_n is None else ink_n
    return F.when(n > 0, (alnum_length(c) if alnum_n is None else alnum_n) / n).otherwise(F.lit(0.0))


def garbage_length(c: Column, marks: str = GARBAGE) -> Column:
    return F.length(F.regexp_replace(c, f"[^{marks}]+", ""))


def garbage_ratio(c: Column, ink_n: Column | None = None, garbage_n: Column | None = None) -> Column:
    n = ink_length(c) if ink_n is None else ink_n
    return F.when(n > 0, (garbage_length(c) if garbage_n is None else garbage_n) / n).otherwise(F.lit(0.0))


def single_char_share(c: Column) -> Column:
    """Share of one-character words other than a, A, I and digits, in texts of more than ten words; else 0.

    White space at the start counts as one word more, as splitting at white space gives an empty first word.
    """
    words = word_count(c) + F.when(c.rlike(r"\A\s"), 1).otherwise(0)
    odd = F.regexp_count(c, F.lit(r"(?<!\S)[^\saAI0-9](?!\S)"))
    return F.when(words > 10, odd / words).otherwise(F.lit(0.0))


def _low(c: Column, ink_n: Column, alnum: Column, garbage: Column, single: Column) -> Column:
    short = F.coalesce(F.length(trim(c)) < 20, F.lit(True))
    return short | (ink_n == 0) | (alnum < 0.5) | (garbage > 0.05) | (single > 0.3)


def is_low_quality(c: Column) -> Column:
    return _low(c, ink_length(c), alnum_ratio(c), garbage_ratio(c), single_char_share(c))


def with_quality(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with ``alnum``, ``garbage``, ``single_share``, ``low_quality`` and ``confidence``: one pass of each pattern a text."""
    c = F.col(text_col)
    ink, letters, marks = fresh(df, "ink", "letters", "marks")
    d = once(df, **{ink: ink_length(c), letters: alnum_length(c), marks: garbage_length(c)}, single_share=single_char_share(c))
    ink_n = F.col(ink)
    d = once(d, alnum=alnum_ratio(c, ink_n, F.col(letters)), garbage=garbage_ratio(c, ink_n, F.col(marks)))
    low = _low(c, ink_n, F.col("alnum"), F.col("garbage"), F.col("single_share"))
    sure = F.when(F.coalesce(ink_n, F.lit(0)) == 0, 10.0).otherwise(_bounded(F.col("alnum") * 100))
    return d.withColumns({"low_quality": low, "confidence": sure}).drop(ink, letters, marks)


def _bounded(c: Column) -> Column:
    return F.greatest(F.lit(10.0), F.least(F.lit(98.0), c))


def _starts(name: str):
    return lambda w: w.startswith(name)


def confidence(c: Column, warnings: Column | None = None) -> Column:
    base = alnum_ratio(c) * 100
    if warnings is not None:
        for name, cost in COSTS.items():
            base = base - cost * F.size(F.filter(warnings, _starts(name)))
    return F.when(is_blank(c), 10.0).otherwise(_bounded(base))


def file_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1048576.0))


def tokens(c: Column) -> Column:
    """Lower-cased pieces between non-word characters: trailing empty ones go, a leading one stays."""
    return F.split(F.regexp_replace(F.lower(c), r"(?<!\W)\W++\z", ""), r"\W+")


def inner_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\S)  +(?=\S)", " ")


def join_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, r"-(\r?\n)\s*([a-z])", "$2")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"(?:\r?\n){3,}+", "\n\n")


def _ligatures(c: Column) -> Column:
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def _lines(c: Column, f) -> Column:
    return trim(F.array_join(f(F.transform(F.split(c, "\n"), strip_end)), "\n"))


def normalize_native(c: Column) -> Column:
    """Clean-up of text that a document carries itself."""
    c = _ligatures(F.translate(c, BULLETS, "•" * len(BULLETS)))
    c = F.translate(c, "‘’“”", "''\"\"")
    c = F.replace(collapse_blank_lines(join_hyphens(inner_spaces(c))), F.lit("\f"), F.lit("\n\n"))
    return F.coalesce(_lines(c, lambda x: x), F.lit(""))


def normalize_ocr(c: Column) -> Column:
    """Clean-up of recognised text, with noise lines removed."""
    c = F.regexp_replace(c, r"(?<=[$₹€£,\d])O(?=[\d,])", "0")
    c = F.regexp_replace(c, r"(?<=\d)l(?=\d)", "1")
    c = F.translate(c, DASHES + "‘’`´“”«»", "-" * len(DASHES) + "''''\"\"\"\"")
    c = inner_spaces(F.regexp_replace(join_hyphens(_ligatures(c)), r"(?<=[a-zA-Z])\|(?=[a-zA-Z])", "l"))
    c = collapse_blank_lines(F.regexp_replace(c, r"[\f\x0B]", "\n"))
    return F.coalesce(_lines(c, lambda x: F.filter(x, _keeps)), F.lit(""))


def _keeps(line: Column) -> Column:
    n = F.length(ink(line))
    return (line == "") | (n <= 3) | (F.length(F.regexp_replace(line, r"[^\p{L}\p{Nd}]", "")) / n > 0.3)


def clean(c: Column) -> Column:
    """Page marks out, long white space to one blank."""
    c = F.regexp_replace(F.regexp_replace(c, PAGE_BREAK, "\n"), FAILED_PAGE, "")
    return trim(F.regexp_replace(c, r"\s{3,}", " "))


def sentences(c: Column) -> Column:
    """Sentences of more than 20 characters and at least four words."""
    c = F.regexp_replace(F.regexp_replace(c, PAGE_BREAK, " "), FAILED_PAGE, "")
    c = F.regexp_replace(F.regexp_replace(c, r"\s{3,}", " "), r"[\r\n]+", " ")
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+"), trim)
    return F.filter(parts, lambda s: (F.length(s) > 20) & (F.regexp_count(s, F.lit(r"\S+")) >= 4))

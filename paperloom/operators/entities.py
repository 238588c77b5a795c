"""Entities by pattern: dates, amounts, signatories, organisations and reference numbers, with context and confidence.

All extractors of a document run in one projection (no shuffle); a match's place comes from the
lengths of the pieces around the matches.  Runs of blanks or digits are taken possessively wherever
giving some back can't lead to a match, so a long run costs its length and not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.rows import let, once, running_sums


def _any(words: str) -> str:
    """A pattern of alternatives (between bars), tried only where one of their first letters stands."""
    return f"(?=[{''.join(dict.fromkeys(w[0].lower() for w in words.split('|')))}])(?:{words})"


def _by_letter(words: str) -> str:
    """As _any, for long lists: alternatives of one first letter together, in their order, as others exclude each other."""
    by: dict[str, list[str]] = {}
    for w in words.split("|"):
        by.setdefault(w[0].lower(), []).append(w[1:])
    listed = [k + (f"(?:{'|'.join(v)})" if len(v) > 1 else v[0]) for k, v in by.items()]
    return f"(?=[{''.join(by)}])(?:{'|'.join(listed)})"


#: What may stand between a keyword and its value: before what can't begin with a blank or dash, and before what can.
_COLON = r"\s*+(?:[:\-]\s*+)?"
_DASH = r"(?:\s*+[:\-]\s*+|\s*+)"
_TAIL = r"(?:\s*+[:\-]\s*|\s*)([\w\d\s,./\-]{4,50}?)(?=[\n\r,;.]|$)"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: The patterns of the eleven entity types.
DUE_DATE = "(?i)" + _any(r"due\s+date|due\s+by|due\s+on|payment\s+due|payable\s+by|deadline|expiry\s+date|expiration\s+date|last\s+date|pay\s+by") + _TAIL
SIGNING_DATE = "(?i)" + _any(r"dated?|made\s+this|made\s+on|executed\s+on|executed\s+this|signed\s+on|signed\s+this|effective\s+date|effective\s+from|commencement\s+date|agreement\s+date") + _TAIL
AMOUNT = (
    r"(?i)(?=[\$₹€£¥\d,uiegca])(?:(?:[\$₹€£¥]\s?[\d,]+(?:\.\d{1,2})?(?:\s*(?:billion|million|lakh|crore|thousand|mn|bn))?)"
    r"|(?:(?:USD|INR|EUR|GBP|CAD|AUD)\s?[\d,]+(?:\.\d{1,2})?(?:\s*(?:billion|million|lakh|crore|thousand))?)"
    r"|(?:(?:(?<![\d,])|\G)[\d,]++(?:\.\d{1,2})?\s*+(?:billion|million|lakh|crore|thousand)\s*(?:dollars|rupees|USD|INR)?)"
    r"|(?:[\d]{1,2},[\d]{2},[\d]{3}(?:\.\d{1,2})?))"
)
WORDS_AMOUNT = "(?i)" + _any("rupees?|dollars?|euros?|pounds?") + r"\s+(?:[A-Za-z\s]+?)?(?:crore|lakh|lac|thousand|hundred|million|billion)(?:\s+[A-Za-z\s]+?)?(?:\s+only|\.)?"
DEDUCTION = "(?i)" + _any(r"less\s*:|minus|deduction|deducted|deduct|TDS|tax\s+deduct|withhold|rebate|discount") + _COLON + r"(?:[\$₹€£]\s?)?[\d,]+(?:\.\d{1,2})?"
SIGNATORY = "(?i)" + _any(r"signed\s+by|signature\s+of|authorized\s+by|signatory\s*:|signee\s*:|executed\s+by|witnessed\s+by") + _COLON + r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
UNNAMED = "(?i)" + _any(r"signed\s+by|authorized\s+representative|authorized\s+signatory|authorized\s+person|duly\s+authorized|competent\s+authority") + r"(?!\s+[A-Z][a-zA-Z])"
WRITTEN_DATE = (
    r"(?i)(?:the\s+)?"
    + _by_letter("first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|thirteenth|fourteenth|fifteenth|sixteenth|seventeenth|eighteenth|nineteenth|twentieth|"
           + "|".join(r"twenty[-\s]?" + x for x in "first second third fourth fifth sixth seventh eighth ninth".split()) + r"|thirtieth|thirty[-\s]?first")
    + r"\s+day\s+of\s+(?:" + _MONTHS + r")(?:,?\s+(?:two thousand|\d{4})[\w\s]*)?"
)
_SUFFIXED = r"(?i)[A-Z][A-Za-z0-9\s&.,'-]{2,50}" + _by_letter(r"Ltd\.?|LLC|Inc\.?|Corp\.?|Co\.?|Limited|Pvt\.?|PLC|LLP|Technologies|Solutions|Services|Systems|Group|Holdings|Enterprises|Associates|Partners")
_ROLE = "(?i)" + _any("company|client|vendor|employer|employee|contractor|lessor|lessee|licensor|licensee|buyer|seller|supplier|between") + _COLON
#: Where a suffix or a role begins, and how far from there a role's value and what must follow it can reach (a value may hold suffixes).
_SUFFIX_WORDS = "Ltd|LLC|Inc|Corp|Co|Limited|Pvt|PLC|LLP|Technologies|Solutions|Services|Systems|Group|Holdings|Enterprises|Associates|Partners"
_ROLE_WORDS = "company|client|vendor|employer|employee|contractor|lessor|lessee|licensor|licensee|buyer|seller|supplier|between"
_MARK = rf"(?i)(?={_by_letter(f'{_SUFFIX_WORDS}|{_ROLE_WORDS}')})"
_HEAD = rf"(?i)^(?:(?:(?:{_ROLE_WORDS})\s*+(?:[:\-]\s*+)?|(?={_SUFFIX_WORDS}))[\s\S]{{0,44}}\s*+[\s\S]{{0,9}})?"
#: The head of a part where no role is in the text: the suffix alone.
_HEAD_OF_SUFFIX = rf"(?i)^(?:(?:{_SUFFIX_WORDS})\.?)?"
ORGANIZATION = rf"(?:{_SUFFIXED})|(?:{_ROLE}[A-Z][A-Za-z0-9\s&.,'-]{{2,40}}(?=[,\n\r;.]|\s+(?:and|or|herein|with|as)))"
REFERENCE = "(?i)" + _any("contract|agreement|invoice|order|po|ref|reference|case|document|doc|ticket|file") + r"\s*(?:no\.?|number|#|id)" + _DASH + r"([\w\-./]{3,30})"
DATE = (
    r"(?i)(?=[jfmasond\d])(?:(?:(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},?\s+\d{4})"
    r"|(?:\d{1,2}[\-/.]\d{1,2}[\-/.]\d{2,4})|(?:\d{4}[\-/.]\d{1,2}[\-/.]\d{1,2}))"
)
#: Extractors before DATE whose values can be a date: all others begin or end with what no date does.
_MAY_BE_DATES = ("DUE_DATE", "SIGNING_DATE", "ORGANIZATION", "REFERENCE_NUMBER")
#: A role with a date for its value: the only way for an organisation to be one, as no date ends in a suffix.
_DATED_ROLE = _ROLE + r"(?=[jfmasond][a-z]{2,8}\s+\d)"
#: Common words whose share marks a sentence fragment.
FRAGMENT_WORDS = (
    "the and but this that with from have had has was were been they their them what when where which who will would could should over under into than then send want "
    "place sure time first last year years make made said also just more most some such very even only both each much many"
).split()
#: Fixed values: (type, pattern, group, longest value, confidence) in the order of extraction.
EXTRACTORS = [
    ("DUE_DATE", DUE_DATE, 1, 80, 0.93),
    ("SIGNING_DATE", SIGNING_DATE, 1, 80, 0.90),
    ("TOTAL_AMOUNT", AMOUNT, 0, 60, 0.88),
    ("AMOUNT_IN_WORDS", WORDS_AMOUNT, 0, 100, 0.80),
    ("DEDUCTION", DEDUCTION, 0, 80, 0.85),
    ("SIGNATORY", SIGNATORY, 1, 60, 0.87),
    ("SIGNATORY_INCOMPLETE", UNNAMED, 0, None, 0.60),
    ("DATE_WRITTEN_FORM", WRITTEN_DATE, 0, None, 0.78),
    ("ORGANIZATION", ORGANIZATION, 1, 80, 0.80),
    ("REFERENCE_NUMBER", REFERENCE, 1, 30, 0.91),
    ("DATE", DATE, 0, 40, 0.85),
]
#: How entity types are shown (type, icon, colour, label, flagged).
META = [
    ("DUE_DATE", "calendar", "#f59e0b", "Due Date", False),
    ("SIGNING_DATE", "calendar-check", "#6366f1", "Signing Date", False),
    ("DATE", "clock", "#8b5cf6", "Date", False),
    ("DATE_WRITTEN_FORM", "clock", "#a78bfa", "Date (Written Form)", False),
    ("TOTAL_AMOUNT", "dollar-sign", "#10b981", "Financial Amount", False),
    ("AMOUNT_IN_WORDS", "dollar-sign", "#34d399", "Amount in Words", False),
    ("DEDUCTION", "minus-circle", "#ef4444", "Deduction / TDS", False),
    ("SIGNATORY", "user-check", "#6366f1", "Signatory", False),
    ("SIGNATORY_INCOMPLETE", "user-x", "#f97316", "Signatory (Incomplete)", True),
    ("ORGANIZATION", "building-2", "#3b82f6", "Organization", False),
    ("REFERENCE_NUMBER", "hash", "#ec4899", "Reference No.", False),
]
CAPS = {"TOTAL_AMOUNT": 15, "ORGANIZATION": 8, "DATE": 10}


def is_valid(v: Column, longest: int) -> Column:
    return (v != "") & (F.length(v) <= longest) & ~v.rlike(r"^\p{javaLowerCase}")


def is_fragment(v: Column) -> Column:
    words = F.split(F.lower(v), r"\s+")
    common = F.size(F.filter(words, lambda w: w.isin(FRAGMENT_WORDS)))
    return (F.size(words) >= 3) & (common / F.size(words) >= 0.4)


def context(text: Column, at: Column, reach: int = 80) -> Column:
    """The text around a place (from 0), on one line, between dots."""
    start = F.greatest(F.lit(0), at - reach)
    part = F.substring(text, (start + 1).cast("int"), (at + reach - start).cast("int"))
    return F.concat(F.lit("..."), T.trim(F.regexp_replace(part, r"[\n\r]+", " ")), F.lit("..."))


def _value(m: Column, pattern: str, group: int) -> Column:
    """A group of a match, from the matched text alone (its end stands for what the pattern looks ahead to)."""
    if pattern == ORGANIZATION:
        return F.when(m.rlike(f"^(?:{_SUFFIXED})$"), m).otherwise(F.regexp_replace(m, f"^(?:{_ROLE})", ""))
    return F.regexp_extract(m, pattern, group) if group else m


#: Two characters that no text should hold, set around what is found; texts that do are searched twice.
_OPEN, _CLOSE = "\ufffe", "\uffff"


def _cut(text: Column, pattern: str) -> Column:
    """The text cut at a pattern of no width: ``split`` compiles its pattern for every row, a replacement once."""
    return F.when(F.contains(text, F.lit(_OPEN)), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, _OPEN), _OPEN, -1))


def near_marks(text: Column) -> Column:
    """The text with null characters for what can be in no organisation, so that the rest keeps its place.

    A name ends in a suffix and begins at most 51 characters before it, all of a few classes, or follows a role.  So the
    text is cut where a suffix or role begins; of each part its head stays, and of the 52 characters before the next
    mark those behind the last that no name holds.  The costly pattern then has little left to try: without a role in
    the text a part's head is its suffix; after the last mark there is only a head, and a text without a mark is not searched.
    """
    roles = text.rlike(f"(?i){_by_letter(_ROLE_WORDS)}")

    def mask(part: Column, roles: Column, last: Column) -> Column:
        tail = F.when(last, "").otherwise(F.regexp_replace(F.right(part, F.lit(52)), r"^[\s\S]*[^A-Za-z0-9\s&.,'-]", ""))

        def cut(z: Column) -> Column:
            hidden = F.length(part) - F.length(z["head"]) - F.length(z["tail"])
            return F.when(hidden > 0, F.concat(z["head"], F.repeat(F.lit("\0"), hidden), z["tail"])).otherwise(part)

        head = F.when(roles, F.regexp_extract(part, _HEAD, 0)).otherwise(F.regexp_extract(part, _HEAD_OF_SUFFIX, 0))
        return let(F.struct(head.alias("head"), tail.alias("tail")), cut)

    def masked(z: Column) -> Column:
        return F.when(F.size(z["parts"]) > 1, F.array_join(F.transform(z["parts"], lambda part, i: mask(part, z["roles"], i + 1 == F.size(z["parts"]))), "")).otherwise(F.repeat(F.lit("\0"), F.length(text)))

    return let(F.struct(_cut(text, _MARK).alias("parts"), roles.alias("roles")), masked)


FOUND = "array<struct<pos:int,value:string>>"


def matches(text: Column, pattern: str, group: int, whole: Column | None = None, places: bool = True) -> Column:
    """Structs (pos, value) of all matches, in order; whole: what ``search`` found, if the text was searched already.

    Without ``places``, pos is the match's number.
    """
    if whole is None:
        whole = search(text, pattern, places)
    value = lambda m: T.trim(_value(m, pattern, group))
    if not places:
        return F.transform(whole, lambda m, i: F.struct(i.alias("pos"), value(m).alias("value")))

    def placed(z: Column) -> Column:
        before = running_sums(F.transform(z, lambda s: s["gap"] + F.length(s["m"])))
        return let(before, lambda sums: F.transform(z, lambda s, i: F.struct((sums[i] + s["gap"]).alias("pos"), value(s["m"]).alias("value"))))

    first = F.array(F.struct(whole[0]["gap"].alias("pos"), value(whole[0]["m"]).alias("value")))
    return F.when(F.size(whole) == 1, first).when(F.size(whole) > 1, let(whole, placed)).otherwise(F.array().cast(FOUND))


def search(text: Column, pattern: str, places: bool) -> Column:
    """The matched texts; with ``places``, structs (gap, m) of each with the length of what stands between it and the one before.

    One replacement sets marks around the matches, so a text is searched once; only a text that holds the marks is cut by the pattern.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if not places:
        return found
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
    twice = F.zip_with(gaps, found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    # Each part but the last ends in a match, behind its opening mark; what is used twice would be made twice.
    piece = lambda p: F.struct((F.instr(p, _OPEN) - 1).alias("gap"), F.substring_index(p, _OPEN, -1).alias("m"))
    cut = lambda marked: let(F.split(marked, _CLOSE, -1), lambda z: F.transform(F.slice(z, F.lit(1), F.size(z) - 1), piece))
    none = F.array().cast("array<struct<gap:int,m:string>>")
    once_ = let(F.regexp_replace(text, f"(?:{pattern})", f"{_OPEN}$0{_CLOSE}"), lambda marked: F.when(F.contains(marked, F.lit(_CLOSE)), cut(marked)).otherwise(none))
    return F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE)), twice).otherwise(once_)


def _quick(pattern: str) -> str:
    """The same pattern with letters of either case listed, the frequent ones first: classes are slow where case is ignored."""
    return pattern.replace("[A-Z][A-Za-z0-9", "(?-i:[a-zA-Z])(?-i:[a-z\\sA-Z0-9").replace("&.,'-]{", "&.,'-]){")


def _first(found: Column, most: int, key) -> Column:
    """The first ``most`` structs of distinct keys."""
    return F.aggregate(found, F.array().cast(FOUND), lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda a: key(a) == key(x)), acc).otherwise(F.array_append(acc, x)))


def _valid_below(longest: int):
    return lambda x: is_valid(x["value"], longest)


def _plain(x: Column) -> Column:
    return x["value"]


def _lower(x: Column) -> Column:
    return F.lower(x["value"])


def _swap(d: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Replaces columns, each evaluated once a row."""
    names = {f"new{k}": c for k, c in columns.items()}
    return once(d, **names).drop(*columns).withColumnsRenamed({f"new{k}": k for k in columns})


def _row(place: int, name: str, sure: float):
    return lambda x: F.struct(F.lit(place).alias("ext_ord"), x["pos"].alias("match_pos"), F.lit(name).alias("type"), x["value"].alias("value"), F.lit(sure).alias("confidence"))


def with_entities(docs: DataFrame, text_col: str = "text", types: list[str] | None = None, into: str = "entities", places: bool = True) -> DataFrame:
    """The input with an array of (ext_ord, match_pos, type, value, confidence), by extractor and place.

    types: only these extractors are shown; DATE still sees the values of all before it that can be a date.
    """
    names = [e[0] for e in EXTRACTORS]
    shown = types or names
    run = [n for n in names if n in shown or ("DATE" in shown and n in _MAY_BE_DATES)]
    own = f"__e{next(k for k in range(len(docs.columns) + 1) if not any(c.lower().startswith(f'__e{k}_') for c in docs.columns))}_"
    text = {n: f"{own}text" for n in names} | {"ORGANIZATION": f"{own}near"}
    d = docs.withColumn(f"{own}text", F.coalesce(F.col(text_col), F.lit("")))
    if "ORGANIZATION" in run:
        searched = F.col(f"{own}text") if "ORGANIZATION" in shown else F.when(F.col(f"{own}text").rlike(_DATED_ROLE), F.col(f"{own}text")).otherwise("")
        d = once(d, **{f"{own}near": near_marks(searched)})
    d = once(d, **{f"{own}m_{name}": search(F.col(text[name]), _quick(pattern), places and name in shown) for name, pattern, *_ in EXTRACTORS if name in run})
    found: dict[str, Column] = {}
    for name, pattern, group, longest, _ in EXTRACTORS:
        if name not in run:
            continue
        out = matches(F.col(text[name]), pattern, group, F.col(f"{own}m_{name}"), places and name in shown)
        if longest:
            out = F.filter(out, _valid_below(longest))
        if name == "TOTAL_AMOUNT":
            out = F.filter(out, lambda x: x["value"].rlike(r"\d\D*\d"))
        if name in ("SIGNATORY", "ORGANIZATION"):
            out = F.filter(out, lambda x: ~is_fragment(x["value"]))
        if name == "SIGNATORY_INCOMPLETE":
            out = F.transform(out, lambda x: F.struct(x["pos"].alias("pos"), F.concat(x["value"], F.lit(" [Name not specified]")).alias("value")))
        found[f"{own}{name}"] = out
    d = once(d, **found)
    caps = {f"{own}{n}": _first(F.col(f"{own}{n}"), CAPS[n], _lower if n == "ORGANIZATION" else _plain) for n in run if n in CAPS and n != "DATE"}
    if caps:
        d = once(d, **caps)
    if "DATE" in run:
        before = F.array_distinct(F.flatten(F.array(*[F.transform(f"{own}{m}", _plain) for m in run[: run.index("DATE")]])))
        # At most ten new dates are looked for, so each match is compared with a bounded list only until then.
        d = once(once(d, **{f"{own}before": before}), **{f"{own}DATE": _first(F.filter(f"{own}DATE", lambda x: ~F.array_contains(f"{own}before", x["value"])), CAPS["DATE"], _plain)})
    rows = F.flatten(F.array(*[F.transform(f"{own}{n}", _row(names.index(n), n, c)) for n, _, _, _, c in EXTRACTORS if n in shown]))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns if c != into], rows.alias(into))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", types: list[str] | None = None, places: bool = True) -> DataFrame:
    """(doc_id, ext_ord, match_pos, type, value, context, confidence) of all documents, one row per entity.

    Without ``places``, match_pos and context are left out, and no text is searched a second time.
    """
    few = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = with_entities(few, types=types, places=places)
    out = out.select("doc_id", *(["text"] if places else []), F.explode("entities").alias("e"))
    if not places:
        return out.select("doc_id", "e.ext_ord", "e.type", "e.value", "e.confidence")
    return out.select("doc_id", "e.ext_ord", "e.match_pos", "e.type", "e.value", context(F.col("text"), F.col("e.match_pos")).alias("context"), "e.confidence")


def shown(type_: Column) -> dict[str, Column]:
    """Icon, colour, label and flag of an entity type; unknown types get defaults."""
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for row in META for x in (row[0], row[k])]), type_)
    return {"icon": F.coalesce(of(1), F.lit("info")), "color": F.coalesce(of(2), F.lit("#64748b")), "label": F.coalesce(of(3), type_), "flagged": F.coalesce(of(4), F.lit(False))}


def decorate(entities: DataFrame) -> DataFrame:
    """Icon, colour, label and flag of each entity, from a constant of eleven entries."""
    return entities.withColumns(shown(F.col("type")))

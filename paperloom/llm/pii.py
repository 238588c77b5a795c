"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions alone.

Every text is searched by one pattern from every place.  What it finds is validated (check digits of
cards and account numbers, octets of addresses, ranges of numbers, days of calendars); where the
longest match is not valid, the longest valid one of fewer groups is taken ("4111 1111 1111 1111 123").
From the left, valid values are permuted by a keyed Feistel network within their own format: a card becomes a card with a right check digit, a date a
date, an address an address.  Equal values get equal pseudonyms in every document, different values
different ones.  Mail addresses get a keyed token before a reserved domain.  What fails validation
stays as it is, and so does the rest of the text.

=========  ==============================================  ==================================
kind       taken as valid                                  permuted
=========  ==============================================  ==================================
email      local part, ``@``, dotted domain                token of a keyed hash (20 hex digits)
ip         four octets to 255                              all 32 bits
card       13 to 19 digits, Luhn sum right                 all but the first and the check digit
iban       check digits right (mod 97)                     digits after the check digits
ssn        area, group and serial in their ranges          within these ranges
phone      +country or (area), 10 to 15 digits             the last ten digits
date       a day of 1900-2099, y-m-d, m/d/y or d.m.y       within these 73,049 days
=========  ==============================================  ==================================

Null texts stay null, empty texts empty; both have n_pii 0.  Repeated rows give equal results; an
empty table gives an empty result.  All other columns of the input are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
#: Taken whole, as a possessive group is walked without recursion; the last label is looked at afterwards (MAIL).
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: The longest part of such a run that ends with a top-level label.
MAIL = r"^(.*\.[A-Za-z]{2,}+)(?![A-Za-z0-9-])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
IP = r"(?:\d{1,3}\.){3}\d{1,3}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
CARD = r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5}"
NUMBER = rf"(?:(?:{IBAN})|(?:{PHONE}(?!\d))|(?:{IP}(?!\.?\d))|(?:{DATE})|(?:{SSN})|(?:{CARD}))(?![\w-])"
#: No part may begin or end within a word or number.
PATTERN = rf"(?<![A-Za-z0-9._%+@-])(?:{EMAIL})|(?<![\w.+-]){NUMBER}"
#: The kinds whose match can hold a shorter value and words or numbers after it; no account number has less than 15 characters.
SHORTER = rf"^(?:(?=(?: ?[A-Z0-9]){{15}})(?:{IBAN})|(?:{PHONE})|(?:{CARD}))$"
#: What each match of PATTERN holds: an address of single digits is the one kind without two digits together.
MAYBE = r"[0-9]{2}|@|[0-9](?:\.[0-9]){3}"


def _feistel(left: str, right: str, ml: str, mr: str, tweak: str, key: str) -> str:
    """SQL for a struct (l, r): a keyed permutation of the pairs below (ml, mr)."""
    f = lambda x: f"(conv(substring(sha2(concat_ws('|', '{key}', '{tweak}', i, {x}), 256), 1, 15), 16, 10) :: bigint)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', ({left}) :: bigint, 'r', ({right}) :: bigint, 'm', ({ml}) :: bigint, 'n', ({mr}) :: bigint), (s, i) -> "
        f"if(i % 2 = 1, named_struct('l', (s.l + {f('s.r')}) % s.m, 'r', s.r, 'm', s.m, 'n', s.n), named_struct('l', s.l, 'r', (s.r + {f('s.l')}) % s.n, 'm', s.m, 'n', s.n)))"
    )


def _let(value: str, body: str, name: str) -> str:
    """SQL for body with name bound to value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(d: str, tweak: str, key: str) -> str:
    """SQL for a permutation of digit strings of one length (2 to 36)."""
    half = f"(length({d}) div 2)"
    ten = lambda n: f"(rpad('1', 1 + {n}, '0') :: bigint)"
    net = _feistel(f"substring({d}, 1, {half})", f"substring({d}, 1 + {half})", ten(half), ten(f"length({d}) - {half}"), tweak, key)
    return _let(net, f"concat(lpad(p.l :: string, {half}, '0'), lpad(p.r :: string, length({d}) - {half}, '0'))", "p")


def _refill(v: str, d: str) -> str:
    """SQL for v with its digits replaced by those of d, in order."""
    one = f"substring({v}, k, 1)"
    return f"aggregate(sequence(1, length({v})), named_struct('o', '', 'n', 1), (s, k) -> if({one} rlike '[0-9]', named_struct('o', concat(s.o, substring({d}, s.n, 1)), 'n', s.n + 1), named_struct('o', concat(s.o, {one}), 'n', s.n)), s -> s.o)"


def _luhn(d: str, shift: int) -> str:
    """SQL for the Luhn sum modulo 10; shift 0: with the check digit, 1: without."""
    digit = f"(substring({d}, length({d}) + 1 - j, 1) :: int)"
    return f"aggregate(sequence(1, length({d})), 0, (t, j) -> t + if((j + {shift}) % 2 = 1, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))) % 10"


def _mod97(text: str) -> str:
    """SQL for a letter-and-digit string modulo 97, letters as 10 to 35."""
    c = f"substring({text}, j, 1)"
    return f"aggregate(sequence(1, length({text})), 0, (t, j) -> if({c} rlike '[0-9]', (t * 10 + ({c} :: int)) % 97, (t * 100 + ascii({c}) - 55) % 97))"


def _calendar(v: str) -> str:
    """SQL for the day of a date string, null if there is none in range."""
    iso = f"case when {v} like '____-%' then {v} when {v} like '%/%' then concat(substring({v}, 7), '-', substring({v}, 1, 2), '-', substring({v}, 4, 2)) else concat(substring({v}, 7), '-', substring({v}, 4, 2), '-', substring({v}, 1, 2)) end"
    return f"try_to_date({iso}, 'yyyy-MM-dd')"


def kind_sql(v: str = "v") -> str:
    """SQL for the validated kind of a match, or null."""
    d = f"regexp_replace({v}, '[^0-9]', '')"
    packed = f"replace({v}, ' ', '')"
    octets = f"transform(split({v}, '[.]'), x -> x :: int)"
    return f"""case
      when contains({v}, '@') then 'email'
      when {v} rlike '^[A-Z]' then if({_let(packed, _mod97("concat(substring(q, 5), substring(q, 1, 4))"), "q")} = 1, 'iban', null)
      when {v} rlike '^[0-9]+([.][0-9]+){{3}}$' then if(array_max({octets}) <= 255, 'ip', null)
      when {v} rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}})$' then if({_calendar(v)} between date'1900-01-01' and date'2099-12-31', 'date', null)
      when {v} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if(substring({v}, 1, 3) between '001' and '899' and substring({v}, 1, 3) <> '666' and substring({v}, 5, 2) <> '00' and substring({v}, 8) <> '0000', 'ssn', null)
      when {v} rlike '^([+(]|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$)' then if(length({d}) between 10 and 15, 'phone', null)
      when length({d}) between 13 and 19 then if({_let(d, _luhn("q", 0), "q")} = 0, 'card', null)
    end"""


def valid_sql(v: str = "v") -> str:
    """SQL for the longest valid value that a match begins with, or null.

    A run that looks like a mail address without a top-level label can still begin with a number.
    """
    shorter = "transform(filter(sequence(length(w) - 1, 1, -1), k -> substring(w, k + 1, 1) rlike '[ .-]'), k -> substring(w, 1, k))"
    plain = f"case when length(w) < 2 then null when {kind_sql('w')} is not null then w else get(filter({shorter}, u -> u rlike r'{SHORTER}' and {kind_sql('u')} is not null), 0) end"
    mail = f"coalesce(nullif(regexp_extract({v}, r'{MAIL}', 1), ''), regexp_extract({v}, r'^{NUMBER}', 0))"
    return _let(f"if(contains({v}, '@'), {mail}, {v})", plain, "w")


def _cuts(parts: str, valid: str) -> str:
    """SQL for how much of each part's beginning goes, from the left: positive where its valid value is taken.

    A value is not taken where one taken before reaches.  Parts are walked in stretches, as appending copies.
    """
    items = f"transform({parts}, (x, at) -> named_struct('n', length(x), 'w', coalesce(length({valid}[at]), 0)))"
    taken = "named_struct('open', greatest(x.w - x.n, 0), 'cuts', array_append(s.cuts, least(x.w, x.n)))"
    passed = "named_struct('open', greatest(s.open - x.n, 0), 'cuts', array_append(s.cuts, -least(s.open, x.n)))"
    some = f"aggregate(slice(m, 1 + c * 512, 512), named_struct('open', r.open, 'cuts', cast(array() as array<int>)), (s, x) -> if(s.open = 0 and x.w > 0, {taken}, {passed}))"
    walk = f"aggregate(sequence(0, (size(m) - 1) div 512), named_struct('open', 0, 'cuts', cast(array() as array<array<int>>)), (r, c) -> {_let(some, "named_struct('open', e.open, 'cuts', array_append(r.cuts, e.cuts))", "e")}, r -> flatten(r.cuts))"
    return _let(items, walk, "m")


def pseudonym_sql(key: str, v: str = "v") -> str:
    """SQL for the pseudonym of a match, itself where it is not valid."""
    d = f"regexp_replace({v}, '[^0-9]', '')"
    inner = _digits("substring(d, 2, length(d) - 2)", "card", key)
    card = _let(d, _let(f"concat(substring(d, 1, 1), {inner})", f"concat(c, (10 - {_luhn('c', 1)}) % 10)", "c"), "d")
    phone = _let(d, f"concat(substring(d, 1, length(d) - 10), {_digits('right(d, 10)', 'phone', key)})", "d")
    ip = _let(f"transform(split({v}, '[.]'), x -> x :: bigint)", _let(_feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", "ip", key), "concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256)", "p"), "o")
    area = "(a[0] :: bigint) - 1 - if(a[0] > '666', 1, 0)"
    ssn = _let(f"split({v}, '-')", _let(_feistel(f"({area}) * 99 + (a[1] :: bigint) - 1", "(a[2] :: bigint) - 1", "898 * 99", "9999", "ssn", key), "concat_ws('-', lpad((p.l div 99 + 1 + if(p.l div 99 >= 665, 1, 0)) :: string, 3, '0'), lpad((p.l % 99 + 1) :: string, 2, '0'), lpad((p.r + 1) :: string, 4, '0'))", "p"), "a")
    day = f"datediff({_calendar(v)}, date'1900-01-01')"
    form = f"case when {v} like '____-%' then date_format(t, 'yyyy-MM-dd') when {v} like '%/%' then date_format(t, 'MM/dd/yyyy') else date_format(t, 'dd.MM.yyyy') end"
    date = _let(_feistel(f"{day} div 4297", f"{day} % 4297", "17", "4297", "date", key), _let("date_add(date'1900-01-01', (p.l * 4297 + p.r) :: int)", form, "t"), "p")
    # The part after the check digits is permuted among its digits; the check digits are made right again.
    body = f"named_struct('c', substring({v}, 1, 2), 'b', substring(replace({v}, ' ', ''), 5))"
    digits = "regexp_replace(w.b, '[^0-9]', '')"
    moved = _let(digits, f"if(length(g) < 2, w.b, {_refill('w.b', _digits('g', 'iban', key))})", "g")
    iban = _let(body, _let(moved, f"concat(w.c, lpad((98 - {_mod97("concat(y, w.c, '00')")}) :: string, 2, '0'), y)", "y"), "w")
    # Blanks of the old grouping come back at their places.
    grouped = f"aggregate(sequence(1, length({v})), named_struct('o', '', 'n', 1), (s, k) -> if(substring({v}, k, 1) = ' ', named_struct('o', concat(s.o, ' '), 'n', s.n), named_struct('o', concat(s.o, substring(n, s.n, 1)), 'n', s.n + 1)), s -> s.o)"
    return f"""case {kind_sql(v)}
      when 'email' then concat('user-', substring(sha2(concat_ws('|', '{key}', 'email', lower({v})), 256), 1, 20), '@example.invalid')
      when 'iban' then {_let(iban, grouped, "n")}
      when 'ip' then {ip}
      when 'date' then {date}
      when 'ssn' then {ssn}
      when 'phone' then {_let(phone, _refill(v, "n"), "n")}
      when 'card' then {_let(card, _refill(v, "n"), "n")}
      else {v} end"""


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", count_col: str | None = "n_pii") -> DataFrame:
    """The input with its texts' personal data replaced, and the number of replaced values in ``count_col``.

    key: a secret without quotes or backslashes; equal keys give equal pseudonyms.  An input column
    named like ``count_col`` is replaced by it; all others stay.
    """
    if not key or set(key) & set("'\\"):
        raise ValueError("the key must be a non-empty string without quotes or backslashes")
    text = F.col(f"`{text_col}`")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    heads_, valid_, parts_, cuts_ = fresh(docs, "heads", "valid", "parts", "cuts")
    heads = F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(f"(?=({PATTERN}))"), F.lit(1))).otherwise(none("string"))
    out = docs.withColumn(heads_, heads).withColumn(valid_, F.expr(f"transform({heads_}, v -> {valid_sql()})"))
    found = F.exists(valid_, lambda v: v.isNotNull())
    # Every part but the first begins where a match does; the first is empty here if the text begins with one.
    parts = F.split(text, f"(?={PATTERN})", -1)
    out = out.withColumn(parts_, F.when(found, parts).otherwise(none("string")))
    out = out.withColumn(parts_, F.expr(f"if(size({parts_}) = size({valid_}), concat(array(''), {parts_}), {parts_})"))
    out = out.withColumn(cuts_, F.when(F.size(parts_) > 1, F.expr(_cuts(f"slice({parts_}, 2, size({valid_}))", valid_))).otherwise(none("int")))
    joined = F.expr(f"concat({parts_}[0], array_join(transform({valid_}, (v, at) -> concat(if({cuts_}[at] > 0, {pseudonym_sql(key)}, ''), substring({parts_}[at + 1], 1 + abs({cuts_}[at])))), ''))")
    out = out.withColumn(text_col, F.when(F.size(cuts_) > 0, joined).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.size(F.filter(cuts_, lambda c: c > 0)).cast("long"))
    return out.drop(heads_, valid_, parts_, cuts_)

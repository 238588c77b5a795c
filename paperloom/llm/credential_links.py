"""Secret scans with multipart credential linking.

Base spans (``assign``, ``access``, ``hex``) are reported wherever they stand.  Beside them each
text is searched for identifiers, endpoints and weak secrets, which alone are not worth a report.
A weak secret's scope (``reach`` bytes of UTF-8 to either side) is joined by interval with the spans of
identifiers, endpoints and access keys: it is reported, with these partners, only if at least one
falls into its scope and does not overlap it.  Identifiers and endpoints are likewise reported when
a base secret is in their scope.  The join is a pair of binary searches per kind, so a text with many
parts costs no more than their sorting.

Patterns are ASCII and run on UTF-8 bytes; offsets come as code points, ends exclusive.  Null and
empty texts have no spans.  Repeated rows are scanned separately, an empty table gives an empty
result, other columns of the input are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, safe_columns, slabs

#: The span kinds in the order of a report.
KINDS = ["assign", "access", "hex", "identifier", "endpoint", "weak"]
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(rb"[0-9a-f]{16,}")
#: A name is a whole run, however long; a run without a value after it is looked at once.
_PAIR = re.compile(rb"(?<![a-z0-9_-])([a-z0-9_-]{2,}+)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=@-]{4,})")
_ENDPOINT = re.compile(rb"(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[a-z0-9._~:/?#@!$&*+,;=%-]{4,}")
_NAMES = re.compile(rb"(?:^|[_-])(?:user|username|login|client_id|account|key_id|access_key|tenant|app_id)$")
_HOSTS = re.compile(rb"(?:^|[_-])(?:host|hostname|endpoint|server|url|database_url|dsn)$")
_WEAK = re.compile(rb"(?:^|[_-])(?:pwd|pass|key|credential|auth|signature|passphrase)$")


def _role(name: bytes) -> int | None:
    """The kind of a name's span, if it has one; secret_access_key ends like an identifier, so secrets come first."""
    if name.endswith(b"key") and b"secret" in name[:-3]:
        return 5
    tail = name[-20:]
    return next((kind for kind, pattern in ((3, _NAMES), (4, _HOSTS), (5, _WEAK)) if pattern.search(tail, len(name) > 20)), None)


def _near(lo: np.ndarray, hi: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each scope [lo, hi) meets one of the spans."""
    if not spans:
        return np.zeros(len(lo), bool)
    s, e = np.sort([x[0] for x in spans]), np.sort([x[1] for x in spans])
    return np.searchsorted(s, hi, "left") - np.searchsorted(e, lo, "right") > 0


def scan(raw: bytes, reach: int = 300) -> list[tuple[int, int, int]]:
    """The reported spans (start, kind, end) of a UTF-8 text, in bytes, sorted."""
    low = raw.lower()
    found: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    weak: list[tuple[int, int]] = []
    if any(w in low for w in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(low):
            if m.end(1) - m.start(1) >= 12:
                found[0].append(m.span())
            elif m.end(1) - m.start(1) >= 6:
                weak.append(m.span())
    if b"AKIA" in raw:
        found[1] = [m.span() for m in _ACCESS.finditer(raw)]
    found[2] = [m.span() for m in _HEX.finditer(raw)]
    names: list[tuple[int, int]] = []
    hosts: list[tuple[int, int]] = []
    if b"=" in low or b":" in low:
        for m in _PAIR.finditer(low):
            if kind := _role(m[1]):
                {3: names, 4: hosts, 5: weak}[kind].append(m.span())
        if b"://" in low:
            hosts += [m.span() for m in _ENDPOINT.finditer(low)]
    if weak or ((names or hosts) and any(found[:3])):
        strong = sorted(found[0] + found[2])

        def linked(spans, partners):
            if not spans:
                return []
            at = np.array(spans)
            before = _near(at[:, 0] - reach, at[:, 0], partners)
            after = _near(at[:, 1], at[:, 1] + reach, partners)
            return [x for x, ok in zip(spans, before | after) if ok]

        taken = linked(sorted(set(weak)), names + hosts + found[1])
        starts = [s for s, _ in found[0]]
        # The assign spans are disjoint and sorted: only the last one before a weak span can hold it.
        found[5] = [w for w in taken if not ((i := bisect_right(starts, w[0])) and w[1] <= found[0][i - 1][1])]
        found[3] = linked(sorted(set(names)), strong + taken)
        found[4] = linked(sorted(set(hosts)), strong + taken)
    return sorted((s, k, e) for k, spans in enumerate(found) for s, e in spans)


def link_credentials(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = 300) -> DataFrame:
    """(doc_id, spans): for each row the reported spans {kind, start, end} by start, then kind."""

    def run(batches):
        for batch in slabs(batches, "text"):
            out = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                spans = scan(raw, reach)
                if spans and len(raw) != len(text):
                    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
                    at = np.concatenate([[0], np.cumsum(lead)])
                    spans = [(int(at[s]), k, int(at[e])) for s, k, e in spans]
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield {"doc_id": batch.column(0), "spans": out}

    few = safe_columns(docs, doc_id=F.col(id_col), text=F.col(text_col))
    return map_arrow(few, "doc_id long, spans array<struct<kind:string,start:int,end:int>>", run)

"""Audit of sources: how far each source's use of a language's terms is from the other sources'.

A term is a run of letters and non-ASCII bytes, ``A-Z`` lower-cased.  A lookup table over the concatenated
UTF-8 buffers of a slab of texts finds all borders, xxhash groups the slices, and every slice is compared
byte by byte with the first of its group, so a collision only starts another group.  The terms of each
document form a sparse matrix, whose rows are summed by (language, source) before anything is shuffled.

A language keeps its terms of ``least`` documents or more.  A group gives a kept term the probability, in units of
1 / SCALE, ``p = 1 + floor(SCALE * (count + 1) / (N + V))``: N occurrences of V kept terms.  The divergence of p from q
at a term is ``floor((p - q) ** 2 / q)``.  A language's terms are cut into blocks by their hashes; a block's
counts are a sparse matrix of sources by terms, and sums over its rows give each pair of sources its share:
terms that both lack need no row, terms that one has are found by the other's row.  All arithmetic is exact.

A null text, language or source counts as empty; repeated rows count each; other columns are not read; an empty
table has an empty result.  Very long texts are read whole.  Ties rank by the item's UTF-8 bytes.  A group's work is
bounded by the block's size, whatever a language's or source's share of the rows.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.session import ship_package

from .byte_words import LOWER, byte_class, spans
from .common import Workspace, in_workspace, map_arrow, safe_columns, slabs
from .shingles import string_buffers

TERM = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
SCALE = 10**9
#: Bytes of text grouped at once, and slices held at once.
SLAB_BYTES, SLICES = 10 << 20, 1 << 18
#: Counts of a block: so many, and so many more for each source of the language.
BLOCK, BLOCK_EACH = 100_000, 100


def group_slices(raw: bytes, s: np.ndarray, e: np.ndarray, digest=None) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term, and the terms; slices have one number if their bytes are equal, and only then."""
    import xxhash

    digest = digest or xxhash.xxh3_64_intdigest
    cuts = [(s[i : i + SLICES].tolist(), e[i : i + SLICES].tolist()) for i in range(0, len(s), SLICES)]
    h = np.concatenate([np.fromiter((digest(raw[a:b]) for a, b in zip(*c)), np.uint64, len(c[0])) for c in cuts] or [np.zeros(0, np.uint64)])
    _, first, code = np.unique(h, return_index=True, return_inverse=True)
    terms = [raw[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())]
    others: dict[bytes, int] = {}
    for i, c in enumerate(cuts):
        part = code[i * SLICES : (i + 1) * SLICES]
        same = np.fromiter(map(operator.eq, (raw[a:b] for a, b in zip(*c)), map(terms.__getitem__, part.tolist())), bool, len(part))
        for k in np.flatnonzero(~same):
            other = raw[c[0][k] : c[1][k]]
            if other not in others:
                others[other] = len(terms)
                terms.append(other)
            part[k] = others[other]
    return code, terms


def sums_of(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]]; empty runs give 0."""
    out = np.zeros(len(starts) - 1, np.int64)
    full = starts[1:] > starts[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, starts[:-1][full])
    return out


def _count(batches):
    """(lang, source, term, n, docs) of each slab; the empty term stands for the group itself."""
    for batch in slabs(batches, "text", SLAB_BYTES):
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        groups: dict[tuple[str, str], int] = {}
        group = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, sources)], np.int64)
        names = list(groups)
        yield {"lang": [x for x, _ in names], "source": [x for _, x in names], "term": [""] * len(names), "n": np.zeros(len(names), np.int64), "docs": np.zeros(len(names), np.int64)}
        data, off, _ = string_buffers(batch.column(2))
        s, e, row = spans(TERM[data], off)
        if not len(s):
            continue
        code, terms = group_slices(LOWER[data].tobytes(), s, e)
        wide = len(terms)
        cells, times = np.unique(row * wide + code, return_counts=True)
        cells = group[cells // wide] * wide + cells % wide
        order = np.argsort(cells, kind="stable")
        starts = np.flatnonzero(np.diff(cells[order], prepend=-1, append=-1))
        cells = cells[order][starts[:-1]]
        words = pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(cells % wide))
        of = pa.array(cells // wide)
        yield {"lang": pa.array([x for x, _ in names], pa.string()).take(of), "source": pa.array([x for _, x in names], pa.string()).take(of), "term": words, "n": sums_of(times[order], starts), "docs": np.diff(starts)}


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division, so that no product passes 2 ** 63."""
    out, rest = np.divmod(count + 1, total)
    for digits in (10**4, 10**4, 10):
        more, rest = np.divmod(rest * digits, total)
        out = out * digits + more
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _block(table: pa.Table, top: int):
    """Shares of all pairs of sources, and the block's first terms, from the counts of one block of one language.

    Rows without a term give each source's N, and the language's V and N.
    """
    lang = table.column("lang")[0].as_py()
    own = table.filter(pc.is_null(table.column("term")))
    names = own.column("source").combine_chunks()
    total, kept, all_n = (own.column(c).to_numpy() for c in ("total", "kept", "all"))
    size = len(names)
    rows = table.filter(pc.is_valid(table.column("term")))
    words = pc.unique(rows.column("term"))
    words = words.take(pc.sort_indices(words))
    t = pc.index_in(rows.column("term"), words).to_numpy().astype(np.int64)
    g = pc.index_in(rows.column("source"), names).to_numpy().astype(np.int64)
    order = np.lexsort((t, g))
    t, g, n = t[order], g[order], rows.column("n").to_numpy()[order]
    starts = np.searchsorted(g, np.arange(size + 1))
    have = np.diff(starts)
    if not len(t):
        zero = np.zeros(size, np.int64)
        for h in range(size):
            yield _shares(lang, names, h, zero)
        return
    p, none = probability(n, total[g] + kept[0]), probability(zero_of(total), total + kept[0])
    whole = np.zeros(len(words), np.int64)
    np.add.at(whole, t, n)
    q = probability(whole, all_n[:1] + kept[0])[t]
    rise = np.flatnonzero(p > q)
    value = divergence(p[rise], q[rise])
    best = rise[by := np.lexsort((t[rise], -value, g[rise]))]
    first = np.searchsorted(g[best], np.arange(size + 1))
    near = np.arange(len(best)) - first[g[best]] < top
    best, value = best[near], value[by][near]
    yield {"lang": [lang] * len(best), "source": names.take(pa.array(g[best])), "part": ["term"] * len(best), "item": words.take(pa.array(t[best])), "value": value}
    row, there = np.empty(len(words), np.int64), np.zeros(len(words), bool)
    for h in range(size):
        own = slice(starts[h], starts[h + 1])
        row[:] = none[h]
        row[t[own]] = p[own]
        there[:] = False
        there[t[own]] = True
        both = np.flatnonzero(there[t])
        at = np.searchsorted(both, starts)
        lone = np.array([divergence(x, p[own]).sum() for x in none], np.int64)
        share = sums_of(divergence(p, row[t]), starts) + lone - sums_of(divergence(none[g[both]], row[t[both]]), at)
        yield _shares(lang, names, h, share + (len(words) - have - have[h] + np.diff(at)) * divergence(none, none[h]))


def zero_of(x: np.ndarray) -> np.ndarray:
    return np.zeros(len(x), np.int64)


def _shares(lang: str, names: pa.Array, h: int, share: np.ndarray) -> dict:
    """Rows of all sources but h against source h."""
    others = np.flatnonzero(np.arange(len(names)) != h)
    return {"lang": [lang] * len(others), "source": names.take(pa.array(others)), "part": ["pair"] * len(others), "item": [names[h].as_py()] * len(others), "value": share[others]}


@in_workspace
def audit_sources(docs: DataFrame, ws: Workspace, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the language's other sources by the divergence from them,
    part ``term`` the ``top`` kept terms that the source has and uses more than the language, by their divergence."""
    few = safe_columns(docs, **{k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))})
    found = map_arrow(few, "lang string, source string, term string, n long, docs long", _count)
    counts = ws.table(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    same = Window.partitionBy("lang", "term")
    terms = counts.where("term <> ''").withColumn("in_docs", F.sum("docs").over(same)).where(F.col("in_docs") >= least)
    first = F.row_number().over(same.orderBy("source")) == 1
    kept = ws.table(terms.withColumn("first", first.cast("long")).select("lang", "source", "term", "n", "first"), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"), F.count("*").alias("cells"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0)
    whole = Window.partitionBy("lang")
    blocks = F.floor(F.sum("cells").over(whole) / (BLOCK + BLOCK_EACH * F.count("*").over(whole))) + 1
    groups = ws.table(groups.select("lang", "source", "total", F.sum("firsts").over(whole).alias("kept"), F.sum("total").over(whole).alias("all"), blocks.cast("int").alias("blocks")), "groups")
    sizes = groups.groupBy("lang").agg(F.first("blocks").alias("blocks"))
    cells = kept.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", "n", *[F.lit(None).cast("long").alias(c) for c in ("total", "kept", "all")])
    marks = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total", "kept", "all")
    ship_package(docs.sparkSession)
    shape = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def measure(table):
        parts = [pa.RecordBatch.from_arrays([pa.array(x[f.name], f.type) for f in shape], schema=shape) for x in _block(table, top)]
        return pa.Table.from_batches(parts, shape)

    shares = cells.unionByName(marks).groupBy("lang", "block").applyInArrow(measure, "lang string, source string, part string, item string, value long")
    shares = ws.table(shares, "shares")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = shares.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    tops = shares.where("part = 'term'").select("*", place).where(F.col("rank") <= top)
    return ws.result(pairs.select("lang", "source", "part", "item", "value", place).unionByName(tops))

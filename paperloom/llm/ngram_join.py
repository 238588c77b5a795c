"""N-gram Jaccard join by vertical partitioning.

The shingles of all documents stand in one global order, rare ones first (a bounded count sketch
of the whole corpus gives the order; it may be coarse, since any order gives the same links).  The
order is cut at pivots into fragments of about equal mass.  Two documents can only link if the heads
of their sets in that order meet, which gives the candidate pairs.  For these, each fragment counts
its own partial overlap, and the sum per pair decides.  Pairs whose parity bitmaps (which shingle hashes
fall on a bit an odd number of times) differ in more bits than two linked sets can are left out before: the
bits that differ are never more than the shingles that do.

Documents with equal sets are one node, so copies never meet pairwise.  A first round tries, for
each node, one partner: the node with the cleanest head in most of its posting lists.  Its links are joined
into components, and the second round tries every remaining candidate pair across components; a
pair inside one component can't change any class.  Links are counted, if they are to be, within the components, by
blocks of nodes and not by pairs (``link_counts``).  No posting list, group or class is capped.

Nulls, empty and blank texts: n_shingles 0, linked with nothing, component_id is the row's own id.
Repeated rows: each row is returned; equal sets share a component.  A null id takes no part in the
minimum.  An empty table gives an empty result.  Other columns of the input are not read.
Sets are compared by 58-bit shingle hashes and nodes by 63-bit set hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, in_workspace, map_arrow, partitions, reduce_blobs, safe_columns, share, slabs, spread_join
from .components import components
from .link_counts import count_links as links_of_nodes
from .shingles import distinct_sets, mix

BLOCK = 1 << 16
BLOOM_BITS = 27
#: Words of 64 bits of a set's parity bitmap.
PARITY = [f"s{k}" for k in range(8)]


def _node(s: np.ndarray) -> int:
    h = mix(np.array([np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))], np.uint64) + np.uint64(len(s)))
    return int(h[0] >> np.uint64(1))


def _parity(s: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set, as 64-bit words."""
    size = 64 * len(PARITY)
    odd = np.bincount((mix(s ^ np.uint64(0x3C3C3C3C3C3C3C3C)) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _near(pairs: DataFrame, owners: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that can link by their parity bitmaps."""
    a, b = (owners.select(*[F.col(c).alias(c + side) for c in ("node", "n", *PARITY)]).withColumnRenamed("node" + side, side) for side in "ab")
    differ = sum(F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b"))) for c in PARITY)
    both = F.col("na").cast("long") + F.col("nb")
    return pairs.join(a, "a").join(b, "b").where((num + den) * (both - differ) >= 2 * num * both).select("a", "b")


def _sets(batches, n: int):
    for batch in slabs(batches, "text"):
        yield batch, distinct_sets(batch.column(batch.schema.get_field_index("text")), n)


def _survey(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """A row per document (block is null), and each task's counts per sketch slot, in blocks."""

    def run(batches):
        count = np.zeros(1 << bits, np.uint8)
        held, size = [], 0

        def pour():
            u, c = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
            u = u.astype(np.int64)
            count[u] = np.minimum(count[u].astype(np.int64) + c, 255)

        for batch, sets in _sets(batches, n):
            k = len(sets)
            yield {"doc_id": batch.column(0), "n": [len(s) for s in sets], "node": [_node(s) if len(s) else None for s in sets], "block": [None] * k, "blob": [None] * k} | dict(zip(PARITY, np.array([_parity(s) for s in sets]).reshape(k, -1).T))
            held += sets
            size += sum(map(len, sets))
            if size > 2_000_000:
                pour()
                held, size = [], 0
        if held:
            pour()
        for b in range(0, 1 << bits, BLOCK):
            if (x := count[b : b + BLOCK]).any():
                yield {"doc_id": [None], "n": [None], "node": [None], "block": [b // BLOCK], "blob": [x.tobytes()]} | dict.fromkeys(PARITY, [None])

    return map_arrow(docs.select("doc_id", "text"), "doc_id long, n int, node long, block int, blob binary, " + ", ".join(f"{c} long" for c in PARITY), run)


def _order(survey: DataFrame, bits: int, fragments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each sketch slot (0: rare), the pivots that cut the order into fragments, and hot slots.

    A hot slot (slot, salts) has more shingles than its share of a task; there are at most four times as many as partitions.
    """
    add = lambda x, y: x.astype(np.uint32) + y
    count = np.zeros(1 << bits, np.uint32)
    for block, blob in reduce_blobs(survey.where("block IS NOT NULL"), "uint8", add).toLocalIterator():
        count[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(blob, np.uint8 if len(blob) == BLOCK else np.uint32)
    limit = share(int(count.sum(dtype=np.int64)), survey.sparkSession)
    slots = np.flatnonzero(count > limit)
    hot = np.stack([slots, np.minimum(-(-count[slots].astype(np.int64) // limit), 32767)])
    noise = max(1.0, 2 * float(count.mean(dtype=np.float64)))
    level, mass = np.empty(len(count), np.uint8), np.full(64, 1e-9)
    for b in range(0, len(count), BLOCK):  # not at once: a sketch of doubles is eight times the classes
        c = count[b : b + BLOCK]
        level[b : b + BLOCK] = np.clip(np.ceil(2 * np.log2(np.maximum(c, 1) / noise)), 0, 63)
        mass += np.bincount(level[b : b + BLOCK], weights=c, minlength=64)
    cum = np.concatenate([[0], np.cumsum(mass)]) / mass.sum()
    cuts = []
    for f in range(1, fragments):
        c = min(63, int(np.searchsorted(cum, f / fragments, "right")) - 1)
        within = (f / fragments - cum[c]) / (cum[c + 1] - cum[c])
        cuts.append((c << 58) | int(min(within, 0.999999) * 2**58))
    return level, np.array(cuts, np.uint64), hot


def _places(s: np.ndarray, level: np.ndarray, bits: int) -> np.ndarray:
    """The places of a set's shingles in the global order."""
    c = level[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    # The slot is the hash's head, so its tail must come first within a class.
    return (c << np.uint64(58)) | (mix(s) >> np.uint64(6))


def _keys(s: np.ndarray, level: np.ndarray, bits: int) -> np.ndarray:
    return np.sort(_places(s, level, bits))


def _salts(s: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """For each shingle, to how many tasks the rows of its slot are dealt."""
    if not hot.shape[1]:
        return np.ones(len(s), np.int16)
    slot = (s >> np.uint64(64 - bits)).astype(np.int64)
    at = np.minimum(np.searchsorted(hot[0], slot), hot.shape[1] - 1)
    return np.where(hot[0][at] == slot, hot[1][at], 1).astype(np.int16)


def _heads(docs: DataFrame, n: int, bits: int, level, hot: np.ndarray, num: int, den: int) -> DataFrame:
    """(gram, node, at, part): the first shingles of each set in the global order.

    at: size << 32 | position.  part: to how many tasks the shingle's rows are dealt << 16 | the row's one of them.
    """

    def run(batches):
        for _, sets in _sets(batches, n):
            rows = []
            for s in sets:
                if m := len(s):
                    keys = _places(s, level.value, bits)
                    first = np.argsort(keys)[: m - -(-num * m // den) + 1]
                    rows.append((_node(s), m, keys[first].tobytes(), _salts(s[first], bits, hot).tobytes()))
            if rows:
                yield dict(zip(("node", "n", "head", "salts"), zip(*rows)))

    heads = map_arrow(docs.select("doc_id", "text"), "node long, n int, head binary, salts binary", run).dropDuplicates(["node"])

    def unpack(batches):
        for batch in batches:
            keys, salts = ([np.frombuffer(x.as_buffer(), kind) for x in batch.column(c)] for c, kind in ((2, np.int64), (3, np.int16)))
            for i in range(0, len(keys), 4096):
                part = keys[i : i + 4096]
                k = np.array([len(x) for x in part])
                pos = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                names, many = np.repeat(np.asarray(batch.column(0)[i : i + 4096]), k), np.concatenate(salts[i : i + 4096]).astype(np.int64)
                yield {"gram": np.concatenate(part), "node": names, "at": np.repeat(np.asarray(batch.column(1)[i : i + 4096]).astype(np.int64), k) << 32 | pos, "part": many << 16 | names % many}

    return map_arrow(heads, "gram long, node long, at long, part int", unpack)


def _dealt(c: str):
    """The task among those of a hot shingle that a node's or class's row goes to."""
    return F.pmod(F.xxhash64(c), F.col("salts")).cast("int").alias("salt")


def _each_salt():
    return F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt")


def _can(a: str, b: str, num: int, den: int):
    """Size and position bounds for rows that share a shingle; ``at`` is size << 32 | position.

    No common shingle of a pair stands before its first one, so a pair that links passes at its first
    common shingle; it may fail at later ones.
    """
    na, nb = F.shiftright(F.col(a), 32), F.shiftright(F.col(b), 32)
    pa, pb = F.col(a).bitwiseAND(0xFFFFFFFF), F.col(b).bitwiseAND(0xFFFFFFFF)
    return (den * F.least(na, nb) >= num * F.greatest(na, nb)) & ((num + den) * F.least(na - pa, nb - pb) >= num * (na + nb))


def _marks(node: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter for each (node, doc_id)."""
    h = mix(mix(node.astype(np.uint64)) ^ doc_id.astype(np.uint64))
    size = np.uint64((1 << BLOOM_BITS) - 1)
    return (h & size).astype(np.int64), ((h >> np.uint64(32)) & size).astype(np.int64)


def bloom(keys: DataFrame):
    """Bits of the (node, doc_id) rows, of fixed size, sent compressed; a false hit only costs work."""

    def run(batches):
        bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
        for batch in batches:
            for k in _marks(np.asarray(batch.column(0)), np.asarray(batch.column(1))):
                np.bitwise_or.at(bits, k >> 3, np.left_shift(np.uint8(1), (k & 7).astype(np.uint8)))
        for b in range(0, len(bits), BLOCK):
            if (x := bits[b : b + BLOCK]).any():
                yield {"block": [b // BLOCK], "blob": [x.tobytes()]}

    out = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    for block, blob in reduce_blobs(map_arrow(keys, "block int, blob binary", run), "uint8", np.bitwise_or).toLocalIterator():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(blob, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(zlib.compress(out.data, 1))


def bits_of(sent) -> np.ndarray:
    """The bits of a filter that was sent."""
    return np.frombuffer(zlib.decompress(sent.value), np.uint8)


def may_hold(bits: np.ndarray, node: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """False where a filter does not hold (node, doc_id) for sure."""
    hit = np.ones(len(node), bool)
    for k in _marks(node, doc_id):
        hit &= (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
    return hit


def _fragments(docs: DataFrame, n: int, bits: int, level, cuts: np.ndarray, wanted) -> DataFrame:
    """(node, fragment, n, part): the sets of the wanted documents, cut at the pivots."""

    def run(batches):
        bits_wanted = bits_of(wanted)
        for batch, sets in _sets(batches, n):
            ids = np.asarray(batch.column(0).fill_null(0))
            some = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            nodes = np.array([_node(sets[i]) for i in some], np.int64)
            hit = may_hold(bits_wanted, nodes, ids[some])
            rows = []
            for i, node in zip(some[hit], nodes[hit]):
                keys = _keys(sets[i], level.value, bits)
                ends = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
                rows += [(node, f, len(keys), keys[a:b].tobytes()) for f, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            if rows:
                node, frag, m, part = zip(*rows)
                yield {"node": node, "fragment": frag, "n": m, "part": part}

    return map_arrow(docs.select("doc_id", "text"), "node long, fragment int, n int, part binary", run)


class Verifier:
    """Decides pairs by summed overlaps; the fragments of a node's set are written once, when it is first in a pair.

    owners: (node, doc_id, ...), the document that stands for each node.
    """

    #: Up to so many nodes (8 bytes each) are broadcast to leave other nodes' fragments out before a shuffle.
    FEW = 1 << 16

    def __init__(self, ws: Workspace, docs: DataFrame, owners: DataFrame, n: int, bits: int, level, cuts: np.ndarray, num: int, den: int):
        self.ws, self.docs, self.owners, self.n, self.bits, self.level, self.cuts, self.num, self.den = ws, docs, owners, n, bits, level, cuts, num, den
        self.parts: list[DataFrame] = []
        self.known: list[DataFrame] = []

    def fragments(self) -> DataFrame:
        """The fragments of all nodes that have been in a pair, so of every node with a link."""
        parts = self.parts[0]
        for t in self.parts[1:]:
            parts = parts.union(t)
        return parts

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b): the pairs of a table that link."""
        nodes = self.ws.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"nodes-{name}")
        if nodes.isEmpty():
            return self.ws.spark.createDataFrame([], "a long, b long")
        new = nodes
        for t in self.known:
            new = new.join(t, "node", "left_anti")
        if not new.isEmpty():
            wanted = bloom(self.owners.join(new, "node").select("node", "doc_id"))
            self.parts.append(self.ws.table(_fragments(self.docs, self.n, self.bits, self.level, self.cuts, wanted), f"parts-{name}"))
            self.known.append(nodes)
        parts = self.fragments()
        few = nodes.count() <= self.FEW

        def side(c: str) -> DataFrame:
            own = pairs.select(c).distinct()
            named = parts.select(F.col("node").alias(c), "fragment", F.col("n").alias(f"n{c}"), F.col("part").alias(f"p{c}"))
            return named.join(F.broadcast(own) if few else own, c, "left_semi")

        total, count = pairs.count(), lambda c: pairs.groupBy(c).agg(F.count("*").alias("k"))
        both = spread_join(pairs, side("b"), ["b"], count("b"), total, F.xxhash64("a"))
        both = spread_join(both, side("a"), ["a", "fragment"], count("a"), total, F.xxhash64("b"))
        # Repeated rows bring a fragment twice; it counts once.
        counted = map_arrow(both.select("a", "b", "na", "nb", "fragment", "pa", "pb"), "a long, b long, na int, nb int, fragment int, k long", _overlaps)
        total = counted.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("k").alias("k")).groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
        good = total.where(self.den * F.col("k") >= self.num * (F.col("na").cast("long") + F.col("nb") - F.col("k"))).select("a", "b")
        return self.ws.table(good, f"links-{name}")


def _overlaps(batches):
    for batch in batches:
        x = [np.frombuffer(p.as_buffer(), np.uint64) for p in batch.column(5)]
        y = [np.frombuffer(p.as_buffer(), np.uint64) for p in batch.column(6)]
        yield {c: batch.column(i) for i, c in enumerate(("a", "b", "na", "nb", "fragment"))} | {"k": [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)]}


@in_workspace
def ngram_jaccard_classes(docs: DataFrame, ws: Workspace, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100, fragments: int = 8, sketch_bits: int = 23, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: classes of the links with Jaccard >= num / den.

    count_links: with n_links, the number of other rows each row links with, copies of its set included.
    """
    spark = docs.sparkSession
    docs = safe_columns(docs, doc_id=F.col(id_col), text=F.col(text_col))
    survey = ws.table(_survey(docs, n, sketch_bits), "survey")
    level, cuts, hot = _order(survey, sketch_bits, fragments)
    level = spark.sparkContext.broadcast(level)

    # Rows of one posting list lie together, cleanest heads first; lists of one node are dropped here.
    # The list of a hot shingle is dealt out, and each part has a lead of its own.
    heads = _heads(docs, n, sketch_bits, level, hot, num, den).repartition(partitions(spark), "gram", "part")
    cleanest = (F.col("at").bitwiseAND(0xFFFFFFFF), F.col("node"))
    order = Window.partitionBy("gram", "part").orderBy(*cleanest)
    placed = heads.select("gram", "node", "at", "part", F.first("node").over(order).alias("lead"), F.first("at").over(order).alias("lead_at"), F.lead("node").over(order).alias("next"))
    lists = ws.table(placed.where("lead <> node OR next IS NOT NULL OR part >= 131072").drop("next"), "lists")
    posted = lists.select("gram", "node", "at", F.shiftright("part", 16).alias("salts"))

    # The leads of a dealt list's parts try the first of them.
    order = Window.partitionBy("gram").orderBy(*cleanest)
    parts = lists.where("part >= 131072 AND lead = node").select("node", F.first("node").over(order).alias("lead"), "at", F.first("at").over(order).alias("lead_at"))
    tried = lists.select("node", "lead", "at", "lead_at").union(parts).where("lead <> node").where(_can("lead_at", "at", num, den)).groupBy("node", "lead").agg(F.count("*").alias("k"))
    tried = tried.groupBy("node").agg(F.max_by("lead", F.struct("k", "lead")).alias("lead"))
    tried = ws.table(tried.select(F.col("lead").alias("a"), F.col("node").alias("b")), "tried")
    owners = ws.table(survey.where("node IS NOT NULL").groupBy("node").agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("doc_id"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), *[F.min(c).alias(c) for c in ("n", *PARITY)]), "owners")
    verifier = Verifier(ws, docs, owners, n, sketch_bits, level, cuts, num, den)
    links = verifier.links(ws.table(_near(tried, owners, num, den), "near"), "tried")
    ws.drop("near")
    found = ws.table(components(links, ws), "found")

    # What is left: pairs across components, listed by component first so that members of one never meet.
    known = posted.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = known.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("salts").alias("salts")).where("x <> y").select("gram", _each_salt())
    known = ws.table(known.withColumn("salt", _dealt("node")).join(several, ["gram", "salt"], "left_semi"), "known")
    ws.drop("lists")
    meets = known.groupBy("gram", "label").agg(F.min(F.shiftright("at", 32)).alias("lo"), F.max(F.shiftright("at", 32)).alias("hi"), F.max(F.shiftright("at", 32) - F.col("at").bitwiseAND(0xFFFFFFFF)).alias("left"), F.max("salts").alias("salts"))
    x, y = (meets.select("gram", "salts", *[F.col(c).alias(c + s) for c in ("label", "lo", "hi", "left")]) for s in "xy")
    x, y = x.withColumn("salt", _dealt("labelx")).drop("salts"), y.select("*", _each_salt())
    meets = x.join(y, ["gram", "salt"]).where((F.col("labelx") < F.col("labely")) & (den * F.col("hix") >= num * F.col("loy")) & (den * F.col("hiy") >= num * F.col("lox")) & ((num + den) * F.least("leftx", "lefty") >= num * (F.col("lox") + F.col("loy"))))
    meets = meets.select("gram", "labelx", "labely", "loy", "hiy", "lefty", _each_salt())
    left = known.select("gram", "salt", F.col("label").alias("labelx"), F.col("node").alias("b"), F.col("at").alias("at_b"))
    right = known.select("gram", F.col("label").alias("labely"), F.col("node").alias("a"), F.col("at").alias("at_a"))
    # A member of the one class must be able to link with some member of the other before it is listed.
    size, ahead = F.shiftright("at_b", 32), F.shiftright("at_b", 32) - F.col("at_b").bitwiseAND(0xFFFFFFFF)
    able = (den * F.col("hiy") >= num * size) & (den * size >= num * F.col("loy")) & ((num + den) * F.least(ahead, "lefty") >= num * (size + F.col("loy")))
    rest = meets.join(left, ["gram", "labelx", "salt"]).where(able).join(right, ["gram", "labely"]).where(_can("at_a", "at_b", num, den))
    rest = rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = rest.join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = ws.table(_near(rest, owners, num, den), "rest")
    ws.drop("known")
    ws.drop("tried")
    if not rest.isEmpty():
        more = verifier.links(rest, "rest")
        if not more.isEmpty():
            links = links.union(more)
            found = ws.table(components(links, ws, "edges-again"), "found-again")

    # A node's class and least id; nodes of a large class and rows of a large node are dealt out.
    nodes = owners.join(found, "node", "left").select("node", "least", "copies", F.coalesce("label", "node").alias("label"))
    classes = nodes.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    nodes = spread_join(nodes.drop("least"), classes.drop("k"), ["label"], classes.select("label", "k"), owners.count(), F.xxhash64("node")).drop("label")
    if count_links:
        # A row links with the other rows of its node and with all rows of the nodes that its node links with.
        nodes = nodes.withColumn("n_links", F.col("copies") - 1)
        if verifier.parts:
            members = owners.select("node", "n", "copies").join(found, "node")
            more = ws.table(links_of_nodes(members, verifier.fragments(), num, den), "more")
            nodes = nodes.join(more, "node", "left").withColumn("n_links", F.col("n_links") + F.coalesce("more", F.lit(0))).drop("more")
    rows = survey.where("block IS NULL").select("doc_id", "n", "node")
    rows = spread_join(rows, nodes.drop("copies"), ["node"], owners.select("node", F.col("copies").alias("k")), survey.count(), F.monotonically_increasing_id(), "left")
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []))
    return ws.result(out)

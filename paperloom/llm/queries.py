"""Queries of the operators, with production parameters, over their whole tables."""

from __future__ import annotations

import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gam, langid
from .best_fit import pack_best_fit
from .binary_codes import near_vectors
from .credential_links import link_credentials
from .divergence import audit_sources
from .importance import importance_resample
from .maxscore import top_k
from .ngram_join import ngram_jaccard_classes
from .packing import pack_documents
from .pii import pseudonymise
from .piece_codec import MARK, encode_pieces
from .token_counts import token_counts

#: Where the key of pseudonyms is looked up, and the one of tests and examples; set one's own for real data.
PII_SETTING, PII_EXAMPLE = "spark.paperloom.pii.key", "paperloom-example-key"


def pii_key(spark: SparkSession) -> str:
    if spark.conf.get(PII_SETTING, None) is None:
        warnings.warn(f"{PII_SETTING} is not set: pseudonyms take an example key that anyone can read", stacklevel=2)
    return spark.conf.get(PII_SETTING, PII_EXAMPLE)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(_read(spark, sf_dir, "documents"), n=4, num=85, den=100, count_links=True)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_byte_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return langid.identify(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's number of ids, their checksum, and whether decoding gives the text back."""
    coded = encode_pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded")
    same = F.col("decoded") == F.replace("text", F.lit(MARK), F.lit(" "))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), same.alias("round_trip"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(20)) == 0, scale=64, k=20)


def op8_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_credentials(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    scored = gam.score_quality(docs, gam.fit(docs, labels, ~held))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_best_fit(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(_read(spark, sf_dir, "documents"), least=3, top=200)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), num=5, den=100, least=20, buckets=10000, seed=42)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


# --- the same results in DuckDB SQL -----------------------------------------------------------

_CAPITALS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: reach(a, b): b can be reached from a by links; one row for each pair of a class.
_REACH = "reach(a, b) AS (SELECT a, a FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b), classes AS (SELECT a, min(b) AS least FROM reach GROUP BY a)"

_OP2 = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_CAPITALS}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM words),
rows AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM rows x JOIN rows y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 85 * (na + nb - k)), {_REACH},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(n, 0)::BIGINT AS n_links FROM sets LEFT JOIN classes ON classes.a = doc_id LEFT JOIN counts ON counts.a = doc_id"""

_FINE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_OP3 = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_FINE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9), {_REACH},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN classes ON classes.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""

_OP7 = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND ({_FINE} OR len(embedding) = 0)),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e[1:least(len(q.e), len(v.e))], v.e[1:least(len(q.e), len(v.e))])::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


#: A kept term's probability, and the divergence of two, in whole numbers of any size.
_P = lambda n, total, v: f"1 + 1000000000::HUGEINT * ({n} + 1) // ({total} + {v})"
_OP12 = rf"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_CAPITALS} AS low FROM documents),
terms AS (SELECT row, lang, source, unnest(regexp_extract_all(low, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL HAVING count(DISTINCT row) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
dense AS (SELECT lang, source, kept.term, coalesce(c.n, 0) AS n, {_P("coalesce(c.n, 0)", "totals.total", "v")} AS p, {_P("kept.n", "langs.total", "v")} AS whole
  FROM totals JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sums AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM totals x JOIN totals y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
risen AS (SELECT lang, source, 'term' AS part, term AS item, ((p - whole) * (p - whole) // whole)::BIGINT AS value FROM dense WHERE n > 0 AND p > whole)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM risen) QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200"""


#: steps: what crc32 makes of each byte; crc: its value as a run's bytes are taken off one by one.
_OP13 = rf"""WITH RECURSIVE texts AS (SELECT row_number() OVER () AS row, doc_id, 0 AS target, {_CAPITALS} AS low FROM documents UNION ALL SELECT -row_number() OVER (), NULL, 1, {_CAPITALS} FROM benchmark),
words AS (SELECT row, doc_id, target, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
each AS (SELECT row, target, unnest(w) AS a, unnest(range(len(w))) AS i FROM words),
next AS (SELECT row, target, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM each WINDOW o AS (PARTITION BY row ORDER BY i)),
runs AS MATERIALIZED (SELECT row, target, a AS run FROM next UNION ALL SELECT row, target, a || ' ' || b FROM next WHERE b IS NOT NULL UNION ALL SELECT row, target, a || ' ' || b || ' ' || c FROM next WHERE c IS NOT NULL),
names AS MATERIALIZED (SELECT row_number() OVER () AS id, run, hex(encode(run)) AS x FROM (SELECT DISTINCT run FROM runs)),
steps AS (SELECT i, printf('%02X', i) AS h, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) r(i)),
crc AS (SELECT id, x, 4294967295::BIGINT AS c FROM names UNION ALL SELECT id, x[3:], xor(c >> 8, v.v) FROM crc JOIN steps b ON b.h = x[1:2] JOIN steps v ON v.i = xor(c & 255, b.i) WHERE x <> ''),
buckets AS (SELECT run, xor(c, 4294967295) % 10000 AS bucket FROM crc JOIN names USING (id) WHERE crc.x = ''),
counts AS (SELECT bucket, (count(*) FILTER (target = 0))::DOUBLE AS s, (count(*) FILTER (target = 1))::DOUBLE AS t FROM runs JOIN buckets USING (run) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain FROM counts),
weights AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS weight FROM runs JOIN buckets USING (run) JOIN gains USING (bucket) WHERE target = 0 GROUP BY row),
scores AS (SELECT doc_id, len(w) >= 20 AS able, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM words LEFT JOIN weights USING (row) WHERE target = 0),
places AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * (SELECT count(*) FROM scores WHERE able) // 100 THEN place END AS rank FROM places"""


def _spans(text: str, pattern: str, keep: str = "true") -> str:
    """SQL for the list of spans {s, e, sb, eb, m} (code points and bytes) of a pattern's matches m for which ``keep`` holds."""
    pattern = pattern.replace("'", "''")
    lists = f"{{'m': regexp_extract_all({text}, '{pattern}'), 'g': string_split_regex({text}, '{pattern}')}}"
    before = lambda f, n: f"coalesce(list_sum(list_transform(l.g[1:i], lambda x: {f}(x))), 0)::BIGINT + coalesce(list_sum(list_transform(l.m[1:{n}], lambda x: {f}(x))), 0)::BIGINT"
    span = f"{{'s': {before('length', 'i - 1')}, 'e': {before('length', 'i')}, 'sb': {before('strlen', 'i - 1')}, 'eb': {before('strlen', 'i')}, 'm': l.m[i]}}"
    return f"list_filter(list_transform([{lists}], lambda l: list_transform(range(1, len(l.m) + 1), lambda i: {span}))[1], lambda x: {keep})"


def _op9() -> str:
    value_part = r"""["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""
    assign = "(?:password|passwd|secret|token|api_?key)" + value_part
    pair = r"""([a-z0-9_-]{2,})["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=@-]{4,})"""
    url = "(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[a-z0-9._~:/?#@!$&*+,;=%-]{4,}"
    quoted = lambda p: p.replace("'", "''")
    value, name = f"length(regexp_extract(x.m, '{quoted(assign)}', 1))", f"regexp_extract(x.m, '{quoted(pair)}', 1)"
    secret, ident, host, weak = (
        f"regexp_matches({name}, '{p}$')"
        for p in ("secret[a-z0-9_-]*key", "(?:^|[_-])(?:user|username|login|client_id|account|key_id|access_key|tenant|app_id)", "(?:^|[_-])(?:host|hostname|endpoint|server|url|database_url|dsn)", "(?:^|[_-])(?:pwd|pass|key|credential|auth|signature|passphrase)")
    )
    kinds = ["assign", "access", "hex", "identifier", "endpoint", "weak"]
    near = lambda of, x: f"len(list_filter({of}, lambda p: (p.sb < {x}.sb AND p.eb > {x}.sb - 300) OR (p.sb < {x}.eb + 300 AND p.eb > {x}.eb))) > 0"
    told = lambda spans, kind: f"list_transform({spans}, lambda x: {{'s': x.s, 'k': {kinds.index(kind)}, 't': concat('{kind}:', x.s, ':', x.e)}})"
    text = lambda spans: f"array_to_string(list_transform(list_sort({spans}), lambda x: x.t), ',')"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, {_CAPITALS} AS low FROM documents),
f AS (SELECT doc_id, {_spans('low', assign, value + ' >= 12')} AS assign, {_spans('low', assign, value + ' BETWEEN 6 AND 11')} AS short,
  {_spans('raw', 'AKIA[A-Z0-9]{14,}')} AS access, {_spans('raw', '[0-9a-f]{16,}')} AS hex, {_spans('low', pair)} AS pairs, {_spans('low', url)} AS urls FROM t),
n AS (SELECT *, list_filter(pairs, lambda x: {ident} AND NOT {secret}) AS names, list_filter(pairs, lambda x: {host} AND NOT {secret} AND NOT {ident}) || urls AS hosts,
  list_distinct(list_transform(short || list_filter(pairs, lambda x: {secret} OR ({weak} AND NOT {ident} AND NOT {host})), lambda x: {{'s': x.s, 'e': x.e, 'sb': x.sb, 'eb': x.eb}})) AS weak FROM f),
w AS (SELECT *, list_filter(weak, lambda x: {near('names || hosts || access', 'x')}) AS taken FROM n),
u AS (SELECT *, list_filter(names, lambda x: {near("list_transform(assign || hex, lambda q: {'sb': q.sb, 'eb': q.eb}) || list_transform(taken, lambda q: {'sb': q.sb, 'eb': q.eb})", 'x')}) AS idents, list_distinct(list_transform(list_filter(hosts, lambda x: {near("list_transform(assign || hex, lambda q: {'sb': q.sb, 'eb': q.eb}) || list_transform(taken, lambda q: {'sb': q.sb, 'eb': q.eb})", 'x')}), lambda x: {{'s': x.s, 'e': x.e}})) AS ends,
  list_filter(taken, lambda x: len(list_filter(assign, lambda p: p.sb <= x.sb AND p.eb >= x.eb)) = 0) AS alone FROM w),
b AS (SELECT *, {told('assign', 'assign')} || {told('access', 'access')} || {told('hex', 'hex')} AS base FROM u)
SELECT doc_id, len(assign)::BIGINT AS n_assign, len(access)::BIGINT AS n_access, len(hex)::BIGINT AS n_hex, sha256({text('base')}) AS base_sha256, {text('base || ' + told('idents', 'identifier') + ' || ' + told('ends', 'endpoint') + ' || ' + told('alone', 'weak'))} AS spans FROM b"""


def oracle_sql() -> dict[str, str]:
    """The classifiers, tokenizers and pseudonyms have no SQL form; tests compare them with plain versions."""
    return {"op2_ngram_jaccard_join": _OP2, "op3_embedding_near_dedup": _OP3, "op7_exact_top_k": _OP7, "op9_credential_links": _op9(), "op12_source_divergence": _OP12, "op13_importance_resampling": _OP13}

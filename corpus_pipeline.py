"""A training corpus from raw documents: quality, language, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` writes each stage's rows as Parquet and reads them again for the next.

In every stage rows are judged by their own text: equal rows fare alike (but near_duplicates keeps one of them),
null ids stay null, columns beyond those of ``documents`` are kept, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import gam, langid
from paperloom.llm.common import Workspace, fresh, in_workspace, spread_join
from paperloom.llm.ngram_join import bits_of, bloom, may_hold, ngram_jaccard_classes
from paperloom.llm.packing import pack_documents
from paperloom.llm.pii import pseudonymise
from paperloom.llm.queries import pii_key


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier scores 0.5 or more; a null text counts as empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return gam.keep_quality(docs, gam.fit(docs, labels, ~held), 0.5)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the network knows; texts that are null or without a letter go."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return langid.keep_known(docs, langid.fit(docs, ~held))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by Jaccard similarity 0.8 of five-word shingles.

    It is the one of least id, a null id being last; among rows of one id, any text's; among rows of one id and text,
    the first of the table's partitions.  So repeated rows shrink to one, whatever columns they have, maps and such
    with any name among them.  Rows without words are linked with nothing and all stay.
    """
    return _first_of_each(docs)


#: What filters tell of a row: it goes or stays for sure, or must be looked up.
GOES, STAYS, EITHER = range(3)


def _told(going: DataFrame, chosen: DataFrame, row: Column) -> Column:
    """GOES, STAYS or EITHER by two filters of fixed size over the values of row: those that may go, and those chosen."""
    filters = [bloom(keys.toDF("node").withColumn("doc_id", F.lit(0).cast("long"))) for keys in (going, chosen)]

    @F.pandas_udf("int")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        may_go, may_stay = map(bits_of, filters)
        for part in parts:
            node = part.to_numpy()
            no_id = np.zeros(len(node), np.int64)
            go, stay = may_hold(may_go, node, no_id), may_hold(may_stay, node, no_id)
            yield pd.Series(np.where(go & stay, EITHER, np.where(go, GOES, STAYS)).astype(np.int32))

    return told(row)


@in_workspace
def _first_of_each(docs: DataFrame, ws: Workspace) -> DataFrame:
    row, at, told = fresh(docs, "row", "at", "told")
    own = _columns(docs)
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    # Copies of an id and text are one row with their number from here on, and wordless rows are in no group.
    worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    classes = ngram_jaccard_classes(keyed.where(worded), id_col=row, n=5, num=80, den=100).groupBy("doc_id", "component_id").agg(F.count("*").alias("copies"))
    classes = ws.table(classes, "classes")
    ids = keyed.where(worded).select(F.col(row).alias("doc_id"), F.col("doc_id").alias("id")).distinct()
    least = F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")
    first = classes.join(ids, "doc_id").groupBy("component_id").agg(F.min_by(F.struct("doc_id", "copies"), least).alias("first"))
    first = ws.table(first.select(F.col("first.doc_id").alias(row), F.col("first.copies").alias("k")), "first")
    several = first.where("k > 1")
    # Texts stay where they are: filters tell nearly every row's fate, and only what they leave open is shuffled.
    going = classes.select(F.col("doc_id").alias(row)).join(first.where("k = 1"), row, "left_anti").select(row)
    fate = _told(going, first.select(row), F.col(row))
    kept = keyed.withColumn(told, fate).where(~worded | (F.col(told) == STAYS)).select(own)
    open_rows = keyed.where(worded).withColumn(at, F.monotonically_increasing_id()).withColumn(told, fate).where(F.col(told) == EITHER).drop(told)
    # The copies of a chosen row may be many: they are dealt to several tasks, each of which keeps its first.
    total = several.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    chosen = spread_join(open_rows, first.select(row), [row], several, total, F.col(at), "left_semi")
    chosen = chosen.groupBy(row).agg(F.min_by(F.struct(*own), at).alias(at))
    return ws.later(kept.union(chosen.select(*[F.col(at).getField(c).alias(c) for c in docs.columns])))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms, keyed by the session's setting; n_chars follows the new text, null for none."""
    out = pseudonymise(docs, pii_key(spark), count_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of 2048; a null text has the end id alone.  Other columns end here."""
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: The classifier, the network and the tokenizer have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what they have written goes if one fails."""
    return _run(spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


@in_workspace
def _run(docs: DataFrame, ws: Workspace, sf_dir: str) -> DataFrame:
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(docs.sparkSession, docs, sf_dir), name)
    return ws.result(STAGES[-1][1](docs.sparkSession, docs, sf_dir))

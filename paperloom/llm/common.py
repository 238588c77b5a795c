"""Shared helpers: intermediate tables in the cluster's shared folder, and bounded blob reduction."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import ship_package

#: Rows of an Arrow batch that carries texts; batches stay small whatever the texts' length.
TEXT_BATCH_BYTES = 2 << 20
#: Spark's setting that removes a query's shuffle files at its end, not at some later collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="paperloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


_CLEANING, _LOCK = {"users": 0, "before": None}, threading.Lock()


@contextlib.contextmanager
def _clean_shuffles(spark: SparkSession):
    """While any write is in here, its shuffle files go at its end; the session's own setting comes back with the last one."""
    with _LOCK:
        if not _CLEANING["users"]:
            _CLEANING["before"] = spark.conf.get(CLEANUP)
        _CLEANING["users"] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            _CLEANING["users"] -= 1
            if not _CLEANING["users"]:
                spark.conf.set(CLEANUP, _CLEANING["before"])


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Intermediate Parquet tables of one operator call, below the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/paperloom-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows and reads them again; the shuffle files behind them go once they are written."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        with _clean_shuffles(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        _delete(self.spark, f"{self.root}/{name}".rstrip("/"))

    def result(self, df: DataFrame) -> DataFrame:
        """The written result; the other tables go.  ``discard_results`` removes what results have left."""
        before = set(self.names)
        out = self.table(df, "result")
        for name in before:
            self.drop(name)
        return self.later(out)

    def later(self, df: DataFrame) -> DataFrame:
        """A result that reads the tables when it is run itself; ``discard_results`` removes them."""
        _RESULTS.append(self.root)
        return df


_RESULTS: list[str] = []


def discard_results(spark: SparkSession) -> None:
    """Removes the files of all results that operators have returned in this process; their DataFrames can't be read any more."""
    while _RESULTS:
        _delete(spark, _RESULTS.pop())


def in_workspace(f):
    """Calls f(df, workspace, ...); what it has written goes if it fails."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **kwargs):
        ws = Workspace(df.sparkSession)
        try:
            return f(df, ws, *args, **kwargs)
        except BaseException:
            ws.drop()
            raise

    return run


#: Rows of one value that a task reads without help; only values with more are dealt to several tasks.
HOT_ROWS = 20_000


def share(total: int, spark: SparkSession) -> int:
    """The rows of a value above which it is dealt out: a quarter of a task's part of them all, HOT_ROWS at least."""
    return max(HOT_ROWS, total // (4 * partitions(spark)))


#: A value of more rows is dealt out where the rows of a value meet each other: two million pairs are a task's share at least.
HOT_PAIRS = 1_500


def spread_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, total: int, salt: Column, how: str = "inner", pairs: int | None = None) -> DataFrame:
    """left joined with right on ``on``; values of on[0] with many left rows, if there are any, are dealt to several tasks.

    counts: (on[0], k), the left rows of each value, ``total`` together.  A value is dealt out if it has more than
    its share of a task; there are at most four times as many as partitions, which bounds what is collected.
    pairs: where both sides have the k rows, the sum of k ** 2; the share is then one of pairs, not of rows.
    salt: a whole number that differs among the rows of one value.  The right rows of such values are copied.
    """
    key, k = on[0], F.col("k").cast("double")
    weight, limit, whole = (k, share(total, left.sparkSession), total) if pairs is None else (k * k, max(HOT_PAIRS**2, pairs // (4 * partitions(left.sparkSession))), pairs)
    hot = counts.where((weight > limit) & F.col(key).isNotNull()).select(key, F.least(k, F.ceil(weight / limit)).cast("int").alias("__n"))
    found = hot.limit(4 * partitions(left.sparkSession)).collect() if whole > limit else []
    if not found:
        return left.join(right, on, how)
    hot = left.sparkSession.createDataFrame(found, hot.schema)
    one = F.coalesce("__n", F.lit(1))
    dealt = left.withColumn("__salt", salt).join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod("__salt", one).cast("int")).drop("__n")
    copied = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("__n")
    return dealt.join(copied, [*on, "__salt"], how).drop("__salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slabs(batches: Iterator[pa.RecordBatch], text: str | None = None, most: int = TEXT_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one slab holds about ``most`` bytes of the text column at most."""
    for batch in batches:
        if text is None or batch.num_rows < 2:
            yield batch
            continue
        size = max(1, batch.column(batch.schema.get_field_index(text)).nbytes)
        step = max(1, int(batch.num_rows * most / size))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def map_arrow(df: DataFrame, schema: str, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """mapInArrow for functions that yield dicts of columns; types follow the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_package(df.sparkSession)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for cols in f(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[k.name], k.type) for k in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def reduce_blobs(df: DataFrame, kind: str, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Folds the ``blob`` rows of each ``block`` as they stream by; memory: one blob per block of the task."""

    def fold(batches):
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(blob.as_buffer(), kind)
                have[block] = add(have[block], x) if block in have else x.copy()
        for block, x in have.items():
            yield {"block": [block], "blob": [x.tobytes()]}

    few = df.select("block", "blob").repartition(partitions(df.sparkSession), "block")
    return map_arrow(few, "block int, blob binary", fold)


def safe_columns(df: DataFrame, **named: Column) -> DataFrame:
    """Only the named columns; other columns of the input can't clash."""
    return df.select(*[c.alias(k) for k, c in named.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the input doesn't have."""
    taken = {c.lower() for c in df.columns}
    tail = next(k for k in range(len(taken) + 1) if not any(f"__{n}{k}" in taken for n in names))
    return [f"__{n}{tail}" for n in names]

"""A folder of files as a stream: new files are typed and validated as they come, and land in two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from paperloom.sources.files import errors, validate

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_drops(spark: SparkSession, path: str) -> DataFrame:
    """A stateless stream of validated files; write it with any sink and trigger."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(path)
    return validate(files.withColumn("doc_id", F.sha2("path", 256)), F.col("length"))


def land(checked: DataFrame, accepted: str, rejected: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes a stream of validated files to two Parquet tables: accepted rows as they are, the others as error rows.

    Every row lands once, though a batch may be run again after a failure, even one between the two writes: a batch
    overwrites its own folders ``batch_id=<n>``, and the checkpoint gives a repeated batch the same files.  A folder is
    complete once it holds ``_SUCCESS``; ``landed`` reads those alone.  Both tables must go with the checkpoint if that
    is given up, as its batches count from 0 again.  Files are read once a batch.  An empty batch writes empty folders.

    trigger: as of ``DataStreamWriter.trigger``; ``availableNow=True`` unless given.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            batch.where("status IS NULL").drop("status", "message").write.mode("overwrite").parquet(f"{accepted}/batch_id={batch_id}")
            errors(batch.where("status IS NOT NULL")).write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return checked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def landed(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a table of ``land`` with their ``batch_id``, of batches that are written in full; fails if there is none."""
    home = spark._jvm.org.apache.hadoop.fs.Path(table)
    found = home.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(home, "batch_id=*/_SUCCESS"))
    return spark.read.option("basePath", table).parquet(*[str(f.getPath().getParent()) for f in found])

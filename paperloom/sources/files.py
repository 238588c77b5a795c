"""Files as rows: typing by leading bytes, validation, and error rows instead of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 50 * 1024 * 1024
#: Leading bytes by type, in the order of the test, and file extensions.
MAGIC = [("25504446", "application/pdf"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("424D", "image/bmp")]
EXTENSIONS = {"application/pdf": ".pdf", "image/png": ".png", "image/jpeg": ".jpg", "image/tiff": ".tiff", "image/bmp": ".bmp"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, length, content); the id is a digest of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha2("path", 256).alias("doc_id"), "path", "length", "content")


def sniff(content: Column) -> Column:
    """The type by leading bytes, null if unknown or shorter than two bytes."""
    out = F.lit(None).cast("string")
    for magic, mime in reversed(MAGIC):
        out = F.when(F.startswith(content, F.to_binary(F.lit(magic), F.lit("hex"))), mime).otherwise(out)
    return F.when(F.length(content) >= 2, out)


def effective_mime(content: Column, declared: Column) -> Column:
    return F.coalesce(sniff(content), declared, F.lit("application/octet-stream"))


def extension(mime: Column) -> Column:
    out = F.lit(".tmp")
    for k, v in EXTENSIONS.items():
        out = F.when(mime == k, v).otherwise(out)
    return out


def is_pdf(mime: Column) -> Column:
    return F.coalesce(F.lower(mime) == "application/pdf", F.lit(False))


#: Error names by status, and messages.
ERRORS = {400: "Unsupported File Type", 413: "File Too Large", 422: "OCR Processing Failed", 500: "Internal Server Error"}
EMPTY = "The uploaded file is empty (0 bytes). Please upload a valid document."
TOO_LARGE = "File size %.1f MB exceeds the 50 MB limit. For very large documents, please split the PDF into smaller parts."
UNSUPPORTED = "Unsupported file type: "
SUPPORTED = ". Supported types: PDF, PNG, JPG, JPEG, TIFF, BMP"
UNEXPECTED = "An unexpected error occurred. Please try again."


def validate(files: DataFrame, size: Column | None = None) -> DataFrame:
    """The input with ``mime``, ``status`` (null: accepted) and ``message``; a column ``declared`` is named in messages."""
    n = F.coalesce(size if size is not None else F.length("content"), F.lit(0))
    mime = sniff(F.col("content"))
    declared = F.coalesce("declared", F.lit("unknown")) if "declared" in files.columns else F.lit("unknown")
    status = F.when(n == 0, 422).when(n > MOST_BYTES, 413).when(mime.isNull(), 400)
    message = F.when(n == 0, EMPTY).when(n > MOST_BYTES, F.format_string(TOO_LARGE, n / 1048576.0)).when(mime.isNull(), F.concat(F.lit(UNSUPPORTED), declared, F.lit(SUPPORTED)))
    return files.withColumns({"mime": mime, "status": status, "message": message})


def errors(failed: DataFrame) -> DataFrame:
    """The error table of rows (doc_id, status, message): a status that is not listed is 500, whose message tells nothing."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv]), F.col("status"))
    status = F.when(known.isNull(), 500).otherwise(F.col("status"))
    rows = failed.where("status IS NOT NULL").select("doc_id", status.alias("status"), "message")
    message = F.when(F.col("status") == 500, UNEXPECTED).otherwise(F.col("message"))
    return rows.select("doc_id", "status", F.coalesce(known, F.lit(ERRORS[500])).alias("error"), message.alias("message"), F.current_timestamp().alias("ts"))


def info(spark: SparkSession) -> DataFrame:
    """One row: the engine's status, the formats it reads and its size limit."""
    formats = F.array(*[F.lit(x) for x in ("PDF", "PNG", "JPG", "JPEG", "TIFF", "BMP")])
    return spark.range(1).select(F.lit("UP").alias("status"), F.lit("paperloom").alias("service"), formats.alias("formats"), F.lit(MOST_BYTES >> 20).alias("most_mb"))

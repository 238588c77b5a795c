"""Shipping the package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once per application, so that functions on workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_paperloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="paperloom-")) / "paperloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(Path(top.name) / p.relative_to(top)))
    sc.addPyFile(str(archive))
    sc._paperloom_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the one that all machines share (``spark.checkpoint.dir``); a local one only where Spark is local and none is set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="paperloom-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"

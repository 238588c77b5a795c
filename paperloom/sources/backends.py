"""Plug points for PDF parsing: (doc_id, content) rows to (doc_id, page_no, text, status, message) rows.

The default reports that no parser is installed; a backend is a function from bytes to a list of page texts, which
raises ``PasswordNeeded`` or ``Damaged`` for files that it can't open.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

from paperloom.session import ship_package

#: What is said of files that can't be read.
PASSWORD = "This document is password-protected. Please remove the password and re-upload."
DAMAGED = "The PDF file appears to be corrupt or malformed: "
NO_PAGES = "The PDF has no pages."
OTHER = "PDF processing error: "


class PasswordNeeded(Exception):
    pass


class Damaged(Exception):
    pass


def no_engine(content: bytes) -> list[str]:
    raise RuntimeError("no text engine is configured")


def failure(e: Exception) -> tuple[int, str]:
    """Status and message of a failure: what the file is to blame for is 422, want of memory and the like 500."""
    if isinstance(e, PasswordNeeded):
        return 422, PASSWORD
    if isinstance(e, Damaged):
        return 422, DAMAGED + str(e)
    if isinstance(e, (MemoryError, RecursionError)):
        return 500, str(e)
    return 422, OTHER + str(e)


def extract_pages(files: DataFrame, backend: Callable[[bytes], list[str]] = no_engine) -> DataFrame:
    """Pages of each file; a file that fails gives one row with page_no 0, a status and a message."""
    ship_package(files.sparkSession)

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                try:
                    pages = backend(bytes(content))
                    out += [(doc_id, i + 1, t, None, None) for i, t in enumerate(pages)] or [(doc_id, 0, None, 422, NO_PAGES)]
                except Exception as e:  # one bad file is one error row
                    out.append((doc_id, 0, None, *failure(e)))
            done = pd.DataFrame(out, columns=["doc_id", "page_no", "text", "status", "message"])
            yield done.astype({"status": "Int32"})

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, page_no int, text string, status int, message string")


def model_path(path: str, beside: list[str] = ()) -> str:
    """Where an engine's models are: the path itself if absolute and there, else below the working folder or one of ``beside``.

    If it is nowhere, the place below the working folder is named, for the engine to report.
    """
    here = Path.cwd() / path
    for p in ([Path(path)] if Path(path).is_absolute() else []) + [here, *[Path(b) / path for b in beside]]:
        if p.exists():
            return str(p)
    return str(here)

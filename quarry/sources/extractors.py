"""Readers of paged files: by suffix, a function from a file's bytes to the texts of its pages.

A reader says that it can't read a file by raising Unreadable with a reason; the file's transcript is then a stub that tells
the reason, as it is where no reader is registered. A reader for PDF is there from the start if pypdf is installed.
"""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import suffix
from quarry.sources import pages

Reader = Callable[[bytes], list[str]]
DEFAULT_VERSION = "pdf-text/1"
#: What a stub says, by its reason.
SAID = {
    "encrypted": "The file is encrypted, and no empty password opens it.",
    "crypto-unavailable": "The file is encrypted, and the library that would open it is not installed.",
    "empty": "The file has no pages.",
    "no-text-layer": "Most pages hold no text: they may be scans, which an agent has to read.",
    "malformed": "The file is damaged, or of another format than its name says.",
}


class Unreadable(Exception):
    """A file that its reader can't read; the reason is one of SAID, or the reader's own."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


@dataclass(frozen=True)
class Entry:
    read: Reader
    version: str


class Registry:
    """Readers by suffix, in lower case with its dot, each with the version that manifest entries carry."""

    def __init__(self) -> None:
        self._by: dict[str, Entry] = {}

    def register(self, end: str, read: Reader, version: str = DEFAULT_VERSION) -> None:
        """In place of the one that was there, if any."""
        if not end.startswith(".") or len(end) < 2:
            raise ValueError(f"{end!r} is no suffix: it starts with a dot")
        self._by[end.lower()] = Entry(read, version)

    def unregister(self, end: str) -> None:
        self._by.pop(end.lower(), None)

    def lookup(self, path: str) -> Reader | None:
        name = path.rsplit("/", 1)[-1]
        dot = name.rfind(".")
        found = self._by.get(name[dot:].lower()) if dot > 0 else None
        return found.read if found else None

    def suffixes(self) -> list[str]:
        return sorted(self._by)

    def versions(self) -> dict[str, str]:
        return {end: x.version for end, x in self._by.items()}

    def pages(self, sources: DataFrame) -> DataFrame:
        """(doc, page, text, failed) of sources(rel, content): pages from 1, or one row that says why there are none."""
        by = {end: x.read for end, x in self._by.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("failed", pa.string())])
            for batch in batches:
                for rel, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    try:
                        texts = by[rel[rel.rindex(".") :].lower()](content or b"")
                        rows = [(rel, i, text or "", None) for i, text in enumerate(texts, 1)] or [(rel, 0, "", "empty")]
                    except Unreadable as e:
                        rows = [(rel, 0, "", e.reason)]
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

        return sources.select("rel", "content").mapInArrow(run, "doc string, page int, text string, failed string")

    def transcripts(self, sources: DataFrame) -> DataFrame:
        """(rel, text, status, reason, pages) of those sources(rel, content) that a reader is registered for."""
        if not self._by:
            return sources.sparkSession.createDataFrame([], "rel string, text string, status string, reason string, pages int")
        found = self.pages(sources.where(suffix(F.col("rel")).isin(*self._by)))
        good = pages.transcripts(found.where("failed is null").select("doc", "page", "text"))
        bad = found.where("failed is not null").select("doc", F.lit("").alias("text"), F.lit("stub").alias("status"), F.col("failed").alias("reason"), F.lit(0).alias("pages"))
        said = F.lit("No text could be read from this file.")
        for reason, text in SAID.items():
            said = F.when(F.col("reason") == reason, text).otherwise(said)
        both = good.unionByName(bad).withColumnRenamed("doc", "rel")
        return both.withColumn("text", F.when(F.col("status") == "ok", F.col("text")).otherwise(said)).select("rel", "text", "status", "reason", F.col("pages").cast("int").alias("pages"))


def pdf_pages(content: bytes) -> list[str]:
    """The pages of a PDF file, by pypdf."""
    import pypdf
    from pypdf.errors import DependencyError, PyPdfError

    try:
        reader = pypdf.PdfReader(io.BytesIO(content))
        if reader.is_encrypted and not reader.decrypt(""):
            raise Unreadable("encrypted")
        return [page.extract_text() or "" for page in reader.pages]
    except DependencyError:
        raise Unreadable("crypto-unavailable") from None
    except (PyPdfError, OSError, RecursionError, MemoryError, ValueError):
        raise Unreadable("malformed") from None


REGISTRY = Registry()
if importlib.util.find_spec("pypdf"):
    REGISTRY.register(".pdf", pdf_pages)

"""Loaders of files that are lists of records: by suffix, a function from (path, text) rows to documents.

A record is a document of its own, with its lines and metadata; such files are never chunked. Loaders can be registered and
taken away; the catalogue loader is there from the start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import suffix
from quarry.sources import po

#: From (path, text) to (docid, text, url, source_path, start_line, end_line, context, metadata).
Loader = Callable[[DataFrame], DataFrame]
DOCUMENT = ("docid", "text", "url", "source_path", "start_line", "end_line", "context", "metadata")
EMPTY = "docid string, text string, url string, source_path string, start_line int, end_line int, context string, metadata string"


def catalogue(rows: DataFrame) -> DataFrame:
    return po.documents(po.parse(rows))


class Registry:
    """Loaders by suffix, in lower case with its dot."""

    def __init__(self) -> None:
        self._by: dict[str, Loader] = {}

    def register(self, end: str, loader: Loader, replace: bool = False) -> None:
        if not end.startswith(".") or len(end) < 2:
            raise ValueError(f"{end!r} is no suffix: it starts with a dot")
        if end.lower() in self._by and not replace:
            raise ValueError(f"{end.lower()} has a loader; say replace=True to put another in its place")
        self._by[end.lower()] = loader

    def unregister(self, end: str) -> None:
        self._by.pop(end.lower(), None)

    def lookup(self, path: str) -> Loader | None:
        dot = path.rsplit("/", 1)[-1].rfind(".")
        return self._by.get(path.rsplit("/", 1)[-1][dot:].lower()) if dot > 0 else None

    def suffixes(self) -> list[str]:
        return sorted(self._by)

    def split(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """texts(path, text): those without a loader, those with one."""
        has = suffix(F.col("path")).isin(*self._by) if self._by else F.lit(False)
        return texts.where(~has), texts.where(has)

    def documents(self, texts: DataFrame) -> DataFrame:
        """The records of texts(path, text), each file read by the loader of its suffix."""
        out = texts.sparkSession.createDataFrame([], EMPTY)
        for end, loader in sorted(self._by.items()):
            out = out.unionByName(loader(texts.where(suffix(F.col("path")) == end)).select(*DOCUMENT))
        return out


REGISTRY = Registry()
REGISTRY.register(".po", catalogue)

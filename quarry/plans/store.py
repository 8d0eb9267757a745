"""Stored indexes: Parquet tables with a JSON record that is written last and makes them valid; staleness; reuse.

A path may be on any store that Spark's readers reach: all reads and writes go through Spark.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from quarry.operators.lexical import LexicalIndex

SCHEMA_VERSION = 1
CHUNKING = ("prose_chars", "config_chars", "code_chars", "default_chars", "ast_max_chars")
#: Parameters that each strategy's index depends on, besides the chunking ones.
ACCEPTS = {
    "lexical": ("bm25_k1", "bm25_b", "tokenizer"), "lexical+ctx": ("bm25_k1", "bm25_b", "tokenizer"), "treesitter": ("bm25_k1", "bm25_b", "tokenizer"), "turbovec": ("model_name", "bit_width"),
    "pi-serini": ("lucene_k1", "lucene_b", "tokenizer"), "hybrid": ("bm25_k1", "bm25_b", "tokenizer", "model_name", "bit_width", "hybrid_weights"),
}
#: Strategies that share a stored index: the one enriched with context stands in the plain one's place.
SLOT = {"lexical+ctx": "lexical"}


def project_key(root: str) -> str:
    return hashlib.sha256(root.rstrip("/").encode()).hexdigest()[:16]


def relevant(name: str, parameters: dict[str, Any]) -> dict[str, Any]:
    """The parameters that a strategy's index depends on."""
    return {k: v for k, v in parameters.items() if k in ACCEPTS[name] or k in CHUNKING}


class IndexStore:
    """Indexes of a corpus by strategy, below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str) -> str:
        if name not in ACCEPTS:
            raise ValueError(f"strategy {name!r} is none of {sorted(ACCEPTS)}")
        return f"{self.folder}/{SLOT.get(name, name)}"

    def save(self, name: str, tables: dict[str, DataFrame], fingerprint: str, parameters: dict[str, Any] | None = None, **more: Any) -> dict[str, Any]:
        """Writes the tables, then the record. A new version stands beside the last one until its record is there."""
        version = hashlib.sha256(f"{fingerprint}{dt.datetime.now(dt.UTC).isoformat()}".encode()).hexdigest()[:12]
        for part, df in tables.items():
            df.write.parquet(f"{self._at(name)}/{version}/{part}")
        record = {
            "schema": SCHEMA_VERSION, "version": version, "fingerprint": fingerprint, "created_at": dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "retriever_name": name,
            "tables": sorted(tables), **({"hyperparams": relevant(name, parameters)} if parameters is not None else {}), **more,
        }
        self.spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self._at(name)}/record")
        return record

    def record(self, name: str) -> dict[str, Any] | None:
        """The record of a stored index, without its data; null if there is none that this version reads."""
        try:
            rows = self.spark.read.text(f"{self._at(name)}/record").collect()
        except AnalysisException:
            return None
        try:
            found = json.loads(rows[0]["value"]) if rows else None
        except ValueError:
            return None
        return found if isinstance(found, dict) and found.get("schema") == SCHEMA_VERSION else None

    def load(self, name: str) -> tuple[dict[str, DataFrame], dict[str, Any]] | None:
        found = self.record(name)
        if found is None:
            return None
        try:
            return {t: self.spark.read.parquet(f"{self._at(name)}/{found['version']}/{t}") for t in found["tables"]}, found
        except AnalysisException:
            return None

    def cached(self) -> dict[str, dict[str, Any]]:
        """Records by the strategy that made them."""
        found = (self.record(n) for n in ACCEPTS if n not in SLOT)
        return {r["retriever_name"]: r for r in found if r}

    def is_stale(self, name: str, fingerprint: str, parameters: dict[str, Any] | None = None, reextract: bool = False) -> bool:
        """Whether an index has to be built again: none there, other files, new extractions due, or other parameters."""
        found = self.record(name)
        if found is None or found["fingerprint"] != fingerprint or reextract:
            return True
        if parameters is None:
            return False
        return json.dumps(found.get("hyperparams"), sort_keys=True) != json.dumps(relevant(name, parameters), sort_keys=True)

    def save_lexical(self, index: LexicalIndex, fingerprint: str, name: str = "lexical", parameters: dict[str, Any] | None = None) -> dict[str, Any]:
        """Postings sorted by term, so that a query reads the row groups of its terms only."""
        tables = {"postings": index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_idx"), "docs": index.docs}
        return self.save(name, tables, fingerprint, parameters, n_docs=index.n_docs, avgdl=index.avgdl, tokenizer=index.mode)

    def load_lexical(self, name: str = "lexical") -> LexicalIndex | None:
        found = self.load(name)
        if found is None:
            return None
        tables, record = found
        return LexicalIndex(tables["docs"], tables["postings"], record["n_docs"], record["avgdl"], record["tokenizer"])

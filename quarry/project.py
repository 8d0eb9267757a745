"""A folder of files as a project: what is read from it, its transcripts, its stored indexes, and searches over them."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import suffix
from quarry.operators import chunking, syntax, tuning
from quarry.operators.lexical import LexicalIndex
from quarry.plans.store import IndexStore, project_key
from quarry.plans.strategies import REGISTRY, build, ordered, search_all
from quarry.sources import extractors, files, manifest, records
from quarry.sources.scratch import stored

#: What hits carry besides their ranks.
UNIT = ("docid", "source_path", "start_line", "end_line", "context", "metadata")
#: Strategies that need nothing from outside: what `query` asks, and `--strategy all` means.
BUILT_IN = ("lexical", "pi-serini", "treesitter")


class Project:
    """A folder of files with its stored indexes and transcripts. given: parameters that win over all others."""

    def __init__(self, spark: SparkSession, root: str, folder: str, given: dict[str, Any] | None = None, no_pdf: bool = False, loaders: records.Registry | None = None, readers: extractors.Registry | None = None):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), f"{folder.rstrip('/')}/{project_key(root)}"
        self.store, self.given, self.no_pdf = IndexStore(spark, self.folder), {k: v for k, v in (given or {}).items() if v is not None}, no_pdf
        self.loaders = records.REGISTRY if loaders is None else loaders
        self.readers = extractors.REGISTRY if readers is None else readers

    def wanted(self, path: Column) -> Column:
        return ~F.endswith(F.lower(path), F.lit(".pdf")) if self.no_pdf else F.lit(True)

    def listed(self) -> DataFrame:
        """All files of the project, those that text has to be extracted from too."""
        return files.discover(self.spark, self.root).where(self.wanted(F.col("path")))

    def texts(self) -> DataFrame:
        """(path, text) of the files that hold plain text."""
        read = files.documents(files.read(self.spark, self.root))
        return read.select(F.col("docid").alias("path"), "text").where(~suffix(F.col("path")).isin(*files.EXTRACTABLE))

    def transcripts(self) -> DataFrame:
        """(path, text) of the sources whose transcript the manifest holds; stubs say which file they stand for."""
        there = self.listed().select(F.col("path").alias("rel"))
        known = manifest.pruned(manifest_of(self), there).where(F.coalesce("text", F.lit("")) != "")
        return known.select(F.col("rel").alias("path"), manifest.rendered(F.col("rel"), F.col("text"), F.col("status"), F.coalesce("reason", F.lit("")), F.col("extractor_version")).alias("text"))

    def fingerprint(self) -> str:
        """Of all files, and of the transcripts that agents wrote for them."""
        revisions = manifest_of(self).select(F.col("rel").alias("path"), manifest.revision(F.col("authored_by"), F.col("sidecar_sha256")).alias("revision"))
        return files.fingerprint(self.listed().join(revisions, "path", "left")).first()[0]

    def due(self, force: bool = False) -> DataFrame:
        """The sources that have no transcript that still holds."""
        return manifest.to_extract(sources_of(self), manifest_of(self), self.readers, force)

    def extract(self, force: bool = False) -> int:
        """Extracts what is due, keeps the other entries of files that are still there; how many were due."""
        sources, known = sources_of(self), manifest_of(self)
        due = stored(self.due(force), "due")
        n = due.count()
        if n or manifest_of(self).join(sources.select("rel"), "rel", "left_anti").limit(1).count():
            made = manifest.extracted(due.select("rel", "content"), self.readers).join(due.select("rel", "sha256", F.col("size").alias("source_bytes")), "rel")
            made = made.withColumn("truncated", F.length("text") > manifest.MAX_CHARS).withColumn("text", manifest.truncated_at_unit(F.col("text")))
            made = made.withColumns({"extractor_version": manifest.version(F.col("rel"), self.readers), "sidecar": F.concat("rel", F.lit(".md")), "sidecar_bytes": F.octet_length("text")})
            kept = manifest.pruned(known, sources).join(made.select("rel"), "rel", "left_anti")
            save_manifest(self, entries_of(self, kept).unionByName(entries_of(self, made)))
        return n

    def chunked(self, policy: chunking.ChunkingPolicy, name: str = "lexical") -> DataFrame:
        """The units that a strategy searches: records of files that have a loader, chunks of all others and of transcripts."""
        plain, with_records = self.loaders.split(self.texts())
        if name == "treesitter":
            units = syntax.documents(plain, policy=policy)
        else:
            units = files.chunk_documents(plain.select(F.col("path").alias("docid"), "text"), policy)
        said = files.chunk_documents(self.transcripts().select(F.col("path").alias("docid"), "text"), policy)
        return units.unionByName(said.select(*units.columns)).unionByName(self.loaders.documents(with_records).select(*units.columns))

    def parameters(self) -> dict[str, Any]:
        """Decided from the files, then from the chunks that those decisions make; given ones stand."""
        sized = self.texts().withColumn("size", F.octet_length("text"))
        by_file = tuning.file_signals(sized)
        nothing = {c: F.lit(None).cast("double") for c in ("chunk_token_cv", "p50_chunk_tokens", "p90_chunk_tokens")} | {"n_chunks": F.lit(None).cast("long"), "cjk_fraction": F.lit(0.0)}
        first = tuning.resolve(by_file.withColumns(nothing), self.given)
        signals = tuning.chunk_signals(self.chunked(tuning.policy(first)))
        return tuning.resolve(by_file.crossJoin(F.broadcast(signals)), self.given) | {"warning": tuning.thin_warning(signals.first()["p10_chunk_tokens"])}

    def index(self, name: str = "lexical", auto: bool = False, force: bool = False) -> tuple[Any, bool]:
        """(the strategy, ready to search; whether the stored index was still good)."""
        again = self.extract() > 0
        mark = self.fingerprint()
        params = {k: v for k, v in self.parameters().items() if k != "warning"} if auto else self.given
        told = params if auto or params else None
        stale = force or self.store.is_stale(name, mark, told, reextract=again)
        found = build(name, params)
        if stale:
            rows = ordered(self.chunked(tuning.policy(params) if params else chunking.ChunkingPolicy(), name))
            said = found.text(rows)
            built = LexicalIndex.of(said.select("doc_idx", "docid", "text"), params.get("tokenizer", "plain"), weights=name != "pi-serini")
            self.store.save(name, {"postings": built.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_idx"), "docs": rows}, mark, told, n_docs=built.n_docs, avgdl=built.avgdl, tokenizer=built.mode)
        return self.opened(name), not stale

    def opened(self, name: str) -> Any | None:
        """The strategy over its stored index as it is, or nothing if there is none."""
        stored_ = self.store.load(name)
        if stored_ is None:
            return None
        tables, record = stored_
        found = build(name, record.get("hyperparams", {}) | self.given)
        found.docs, found.lexical = tables["docs"], LexicalIndex(tables["docs"].select("doc_idx", "docid", "text"), tables["postings"], record["n_docs"], record["avgdl"], record["tokenizer"])
        return found

    def search(self, queries: DataFrame, k: int, auto: bool = False, strategy: str = "all", weights: dict[str, float] | None = None, force: bool = False) -> DataFrame:
        """Ranked hits of one strategy (rank from 0), or those of all merged by their spans (rank from 1)."""
        if strategy != "all":
            return self.index(strategy, auto, force)[0].search(queries, k)
        return search_all({n: self.index(n, auto, force)[0] for n in BUILT_IN}, queries, k, weights)


def sources_of(p: Project) -> DataFrame:
    """(rel, sha256, content, size) of the files that have to be extracted from; what only tools read isn't opened."""
    named = p.listed().where(suffix(F.col("path")).isin(*files.EXTRACTABLE))
    read = files.read(p.spark, p.root).where(suffix(F.col("path")).isin(*files.MACHINE_READ, *files.AGENT_READ)).select("path", "content")
    both = named.join(read, "path", "left")
    return both.select(F.col("path").alias("rel"), manifest.identity(F.col("path"), F.col("size"), F.col("mtime_ns"), F.col("content")).alias("sha256"), "content", "size")


def _read_or_none(p: Project, path: str, read: str) -> DataFrame | None:
    try:
        return getattr(p.spark.read, read)(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def manifest_of(p: Project) -> DataFrame:
    """The manifest's last version that was written whole."""
    pointer = _read_or_none(p, f"{p.folder}/manifest/current", "text")
    rows = pointer.collect() if pointer is not None else []
    if not rows:
        return p.spark.createDataFrame([], manifest.ENTRY + ", text string")
    return p.spark.read.parquet(f"{p.folder}/manifest/{rows[0]['value']}")


def save_manifest(p: Project, rows: DataFrame) -> None:
    """The manifest as it is to be, as a version of its own; then the pointer to it."""
    version = uuid.uuid4().hex
    rows.write.parquet(f"{p.folder}/manifest/{version}")
    p.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{p.folder}/manifest/current")


def entries_of(p: Project, rows: DataFrame) -> DataFrame:
    """rows with all columns of a manifest entry, and the text."""
    kinds = [x.split() for x in (manifest.ENTRY + ", text string").split(", ")]
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds))


def weights_of(text: str | None) -> dict[str, float] | None:
    """name=number, separated by commas; the names are those of strategies, no number is below zero."""
    if not text:
        return None
    out = {}
    for part in text.split(","):
        name, equals, number = (x.strip() for x in part.partition("="))
        try:
            value = float(number)
        except ValueError:
            value = -1.0
        if not equals or name not in REGISTRY or not value >= 0 or value == float("inf"):
            raise ValueError(f"{part.strip()!r} is no weight: name=number is wanted, with one of {sorted(REGISTRY)}")
        out[name] = value
    return out


def checked(text: str, k: int) -> None:
    """What every search asks of its arguments."""
    if not text.strip():
        raise ValueError("a query has words")
    if k < 1:
        raise ValueError("top-k is 1 at least")


def shown(p: Project, found: DataFrame, first: int, lines: int) -> list[dict]:
    """Hits in their order, ranks from 1, each with the first lines of its span."""
    texts = p.texts().unionByName(p.transcripts()).withColumnRenamed("path", "source_path")
    told = found.join(texts, "source_path", "left").withColumn("snippet", files.window(F.col("text"), F.col("start_line"), F.col("end_line"), lines)).drop("text")
    more = [c for c in ("provenance", "agreement", "confidence", "contributors") if c in found.columns]
    return [json.loads(r[0]) for r in told.orderBy("rank").select(F.to_json(F.struct((F.col("rank") + first).alias("rank"), "score", *UNIT, *more, "snippet"))).collect()]

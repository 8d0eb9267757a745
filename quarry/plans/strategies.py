"""Retrieval strategies behind one interface: index a corpus, search many queries, get hits with their spans.

A corpus is documents(docid, text, url, source_path, start_line, end_line, context, metadata); its order is that of its
path's parts, then its lines, and breaks all ties.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.chunking import breadcrumb, enriched
from quarry.operators.consolidation import consolidate
from quarry.operators.dense import dense_search, hybrid_search, normalised, quantised
from quarry.operators.lexical import LexicalIndex, bm25_scores, candidate_pool, lexical_search, top
from quarry.sources.scratch import stored

UNIT = ("docid", "source_path", "start_line", "end_line", "context", "metadata")
#: Gives (doc_idx, vector) for (doc_idx, text); an embedding model is the caller's own.
Embedder = Callable[[DataFrame], DataFrame]


def ordered(docs: DataFrame) -> DataFrame:
    """docs with doc_idx from 0 in the order of path parts, lines and docid.

    A range sort deals rows to parts, stored once; a row's place is its place in its part after the counts of the parts
    before it, a number for each part."""
    key = F.struct(F.split("source_path", "/").alias("p"), F.coalesce("start_line", F.lit(0)).alias("s"), F.coalesce("end_line", F.lit(0)).alias("e"), F.col("docid").alias("d"))
    parts = stored(docs.withColumn("__k", key).repartitionByRange("__k").withColumn("__part", F.spark_partition_id()), "ordered")
    before, starts = 0, []
    for part, n in sorted(map(tuple, parts.groupBy("__part").count().collect())):
        starts.append((part, before))
        before += n
    place = F.row_number().over(W.partitionBy("__part").orderBy("__k")) - 1
    offsets = docs.sparkSession.createDataFrame(starts, "__part int, __start long")
    return parts.join(F.broadcast(offsets), "__part").withColumn("doc_idx", (F.col("__start") + place).cast("long")).drop("__k", "__part", "__start")


class Retriever(Protocol):
    name: str

    def index(self, docs: DataFrame) -> None: ...

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


class _Base:
    name = ""
    accepts: tuple[str, ...] = ()
    #: Whether hits carry the context of their unit.
    with_context = True

    def __init__(self, **params: Any):
        self.params, self.docs = params, None

    def text(self, docs: DataFrame) -> DataFrame:
        return docs

    def index(self, docs: DataFrame) -> None:
        self.docs = ordered(docs)
        self._build(self.text(self.docs))

    def _build(self, docs: DataFrame) -> None:
        raise NotImplementedError

    def _ranked(self, queries: DataFrame, k: int) -> DataFrame:
        raise NotImplementedError

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, score, docid, source_path, start_line, end_line, context, metadata): rank from 0."""
        if self.docs is None:
            raise RuntimeError("index() comes before search()")
        found = self._ranked(queries, k).join(self.docs.select("doc_idx", *UNIT), "doc_idx")
        context = F.col("context") if self.with_context else F.lit("")
        return found.select("query_id", "rank", "score", *(context.alias("context") if c == "context" else F.col(c) for c in UNIT))


class Lexical(_Base):
    """TF-IDF and BM25, fused by rank."""

    name, accepts = "lexical", ("bm25_k1", "bm25_b", "tokenizer")

    def _build(self, docs: DataFrame) -> None:
        self.lexical = LexicalIndex.of(docs.select("doc_idx", "docid", "text"), self.params.get("tokenizer", "plain"))

    def _ranked(self, queries: DataFrame, k: int) -> DataFrame:
        return lexical_search(self.lexical, queries, k, self.params.get("bm25_k1", 1.5), self.params.get("bm25_b", 0.75))


class ContextualLexical(Lexical):
    """Lexical over texts led by what a given contextualizer says of them: a function of the text column."""

    name = "lexical+ctx"

    def text(self, docs: DataFrame) -> DataFrame:
        say = self.params.get("contextualizer")
        if say is None:
            raise RuntimeError("lexical+ctx needs a contextualizer: pass contextualizer=, a function from the text column to its context")
        return docs.withColumn("text", enriched(say(F.col("text")), F.col("text")))


class TreeSitter(Lexical):
    """Lexical over syntax chunks, each under the names of its scopes."""

    name = "treesitter"

    def text(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("text", breadcrumb(F.col("context"), F.col("text")))


class Dense(_Base):
    """Inner product of unit vectors that a given embedder makes; with bit_width, of vectors rounded to so many bits."""

    name, accepts = "turbovec", ("model_name", "bit_width")

    def embedded(self, rows: DataFrame) -> DataFrame:
        embed: Embedder | None = self.params.get("embedder")
        if embed is None:
            raise RuntimeError("dense search needs an embedder: pass embedder=, a function from (doc_idx, text) rows to (doc_idx, vector)")
        return normalised(embed(rows))

    def _build(self, docs: DataFrame) -> None:
        vectors = self.embedded(docs.select("doc_idx", "text"))
        bits = self.params.get("bit_width")
        self.vectors = vectors.withColumn("vector", quantised(F.col("vector"), bits)) if bits else vectors

    def asked(self, queries: DataFrame) -> DataFrame:
        rows = queries.select(F.col("query_id").alias("doc_idx"), F.col("query").alias("text"))
        return self.embedded(rows).withColumnRenamed("doc_idx", "query_id")

    def _ranked(self, queries: DataFrame, k: int) -> DataFrame:
        return dense_search(self.vectors, self.asked(queries), k)


class PiSerini(_Base):
    """BM25 with passage parameters, only of documents that match; words are those of the plain tokenizer, unstemmed."""

    name, accepts = "pi-serini", ("lucene_k1", "lucene_b", "tokenizer")
    with_context = False

    def _build(self, docs: DataFrame) -> None:
        self.lexical = LexicalIndex.of(docs.select("doc_idx", "docid", "text"), self.params.get("tokenizer", "plain"), weights=False)

    def _ranked(self, queries: DataFrame, k: int) -> DataFrame:
        return top(bm25_scores(self.lexical, queries, self.params.get("lucene_k1", 0.9), self.params.get("lucene_b", 0.4)), k)


class Hybrid(Dense):
    """Lexical and dense, fused by rank, each as deep as the pool."""

    name, accepts = "hybrid", ("bm25_k1", "bm25_b", "tokenizer", "model_name", "bit_width", "hybrid_weights")
    with_context = False

    def _build(self, docs: DataFrame) -> None:
        super()._build(docs)
        self.lexical = LexicalIndex.of(docs.select("doc_idx", "docid", "text"), self.params.get("tokenizer", "plain"))

    def adopt(self, lexical: Lexical, dense: Dense) -> bool:
        """Takes over arms that are built already, if their parameters are the same."""
        same = all(self.params.get(k) == arm.params.get(k) for arm in (lexical, dense) for k in arm.accepts)
        if same:
            self.docs, self.lexical, self.vectors = lexical.docs, lexical.lexical, dense.vectors
        return same

    def _ranked(self, queries: DataFrame, k: int) -> DataFrame:
        return hybrid_search(self.lexical, self.vectors, queries.join(self.asked(queries), "query_id"), k, self.params.get("hybrid_weights"))


REGISTRY: dict[str, type[_Base]] = {c.name: c for c in (Lexical, ContextualLexical, Dense, PiSerini, Hybrid, TreeSitter)}


def build(name: str, params: dict[str, Any] | None = None) -> Retriever:
    """A strategy with those of the parameters that it takes."""
    if name not in REGISTRY:
        raise ValueError(f"strategy {name!r} is none of {sorted(REGISTRY)}")
    kind = REGISTRY[name]
    return kind(**{k: v for k, v in (params or {}).items() if k in (*kind.accepts, "embedder", "contextualizer")})


def search_all(retrievers: dict[str, Retriever], queries: DataFrame, k: int, weights: dict[str, float] | None = None, pool: int | None = None) -> DataFrame:
    """consolidate()'s rows, the first k of each query, over all strategies' hits as deep as the pool."""
    deep = max(k, pool or candidate_pool(k))
    hits = None
    for name, r in retrievers.items():
        one = r.search(queries, deep).select("query_id", F.lit(name).alias("retriever"), F.col("rank").alias("pos"), "rank", *UNIT)
        hits = one if hits is None else hits.unionByName(one)
    return consolidate(hits, weights=weights).where(F.col("rank") <= k)

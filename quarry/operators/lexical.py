"""Inverted index and lexical search: TF-IDF, BM25 and their rank fusion, for many queries at once.

A corpus is a table (doc_idx, docid, text, ...); doc_idx orders documents and breaks all ties, and no two have the same.
Nothing is scored that shares no term with a query. Searches for the first k score documents where they are read
(quarry/operators/scoring.py); bm25_scores() and its like give the scores of all. Documents without a score come after all
others by doc_idx, in both arms alike, so only as many of them are added as a top-k still lacks (the exact result of ranking
all).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.scoring import PLACES, Asked, Weights, asked_of, common_parts, common_postings, counted, firsts, named
from quarry.operators.scoring import placed as in_gaps
from quarry.sources.scratch import stored

RRF_K = 60
POOL_TIMES, POOL_LEAST = 10, 50


def corpus(docs: DataFrame, docid: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_idx, docid, text) of a table whose numeric ids order it."""
    return docs.select(F.col(docid).cast("long").alias("doc_idx"), F.col(docid).cast("string").alias("docid"), F.col(text).alias("text"))


def term_frequencies(docs: DataFrame, mode: str = "plain") -> DataFrame:
    """(doc_idx, term, tf, dl): a row for each distinct term of a document; dl: its number of tokens."""
    split = docs.select("doc_idx", tokens(F.col("text"), mode).alias("words"))
    return split.select("doc_idx", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("doc_idx", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def document_lengths(docs: DataFrame, mode: str = "plain") -> DataFrame:
    return docs.select("doc_idx", F.size(tokens(F.col("text"), mode)).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame, mode: str = "plain") -> DataFrame:
    """(n_docs, avgdl), one row; an average of nothing, or of zero, is 1."""
    mean = F.avg("dl")
    return document_lengths(docs, mode).agg(F.count(F.lit(1)).alias("n_docs"), F.when(mean > 0, mean).otherwise(1.0).alias("avgdl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf_idf(df: Column, n_docs: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def bm25_idf(df: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


#: Terms whose document frequencies are sent to every task, at most; the postings of all others are dealt out by term.
COMMON = 1 << 18


def unpacked(packed: DataFrame) -> DataFrame:
    """(doc_idx, dl, term, tf) of packed(doc_idx, dl, terms, tfs)."""
    return packed.select("doc_idx", "dl", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf")).withColumn("tf", F.col("tf").cast("long"))


@dataclass(frozen=True)
class LexicalIndex:
    """postings(term, doc_idx, tf, dl[, df, w]): df is the term's number of documents, w the TF-IDF weight in the
    document's unit vector; both are there if the index was built with weights. n_docs, avgdl: of the whole corpus.
    docs: the corpus. An index that was built here has its documents too, packed(doc_idx, dl, terms, tfs), and with weights
    norms(doc_idx, norm), both stored; its postings are made of them when they are asked for."""

    docs: DataFrame
    postings: DataFrame
    n_docs: int
    avgdl: float
    mode: str = "plain"
    packed: DataFrame | None = None
    norms: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame, mode: str = "plain", weights: bool = True, common: int = COMMON) -> LexicalIndex:
        """Texts are tokenized and their words counted once, into a stored table of a row for each; all else is made of that.

        Terms are looked up where their documents are; only postings of terms beyond the `common` most frequent ones are
        dealt out by term."""
        packed = stored(counted(docs, mode), "terms")
        n_docs, total = packed.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        plain = cls(docs, unpacked(packed), n_docs, total / n_docs if total else 1.0, mode, packed)
        if not weights:
            return plain
        df = stored(document_frequencies(plain.postings), "frequencies")
        least = 1
        for power, n in sorted((tuple(r) for r in df.groupBy(F.floor(F.log2("df")).cast("int")).count().collect()), reverse=True):
            common -= n
            if common < 0:
                least = 1 << (power + 1)
                break
        known = df.where(F.col("df") >= least).toArrow()
        weighed = stored(common_parts(packed, known, n_docs), "weighed")
        raw = (1 + F.log("tf")) * tfidf_idf(F.col("df"), F.lit(n_docs))
        rare = weighed.where(F.col("term").isNotNull()).drop("part").join(df.where(F.col("df") < least), "term").withColumn("raw", raw)
        parts = weighed.where(F.col("term").isNull()).select("doc_idx", "part")
        if least > 1:
            parts = parts.unionByName(rare.select("doc_idx", (F.col("raw") * F.col("raw")).alias("part")))
        norms = stored(parts.groupBy("doc_idx").agg(F.sqrt(F.sum("part")).alias("norm")), "norms")
        postings = common_postings(packed.join(norms, "doc_idx"), known, n_docs)
        if least > 1:
            postings = postings.unionByName(rare.join(norms, "doc_idx").withColumn("w", F.col("raw") / F.col("norm")).select(*postings.columns))
        return replace(plain, postings=postings, norms=norms)

    def reduced(self, terms: list[str]) -> DataFrame:
        """(doc_idx, dl, ids, tfs[, norm]): documents reduced to these terms, by their places (ids, rising)."""
        if self.packed is not None:
            rows = asked_of(self.packed, terms)
            return rows if self.norms is None else rows.where(F.size("ids") > 0).join(self.norms, "doc_idx")
        places = self.postings.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.string()), "id": pa.array(range(len(terms)), pa.int32())}))
        met = self.postings.join(F.broadcast(places), "term")
        each = [F.first(F.col("dl").cast("int")).alias("dl"), F.array_sort(F.collect_list(F.struct("id", F.col("tf").cast("int").alias("tf")))).alias("x")]
        if "w" in met.columns:
            each.append(F.first((1 + F.log("tf")) * tfidf_idf(F.col("df"), F.lit(self.n_docs)) / F.col("w")).alias("norm"))
        found = met.groupBy("doc_idx").agg(*each)
        return found.select("doc_idx", "dl", F.col("x.id").alias("ids"), F.col("x.tf").alias("tfs"), *(["norm"] if "w" in met.columns else []))

    def met(self, terms: DataFrame) -> DataFrame:
        """The postings of the query terms (query_id, term, ...), with df. Terms are looked up before they are counted, so
        an index without weights reads only what the queries ask for."""
        asked = self.postings.join(terms.select("term").distinct(), "term") if "df" not in self.postings.columns else self.postings
        known = asked if "df" in asked.columns else asked.join(document_frequencies(asked), "term")
        return known.join(terms, "term")


def query_terms(queries: DataFrame, mode: str = "plain") -> DataFrame:
    """(query_id, term, qtf, qw) of queries(query_id, query): qw is the weight in the query's unit vector, without IDF;
    terms that no document has count towards its length."""
    counted = queries.select("query_id", F.explode(tokens(F.col("query"), mode)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    raw = 1 + F.log("qtf")
    return counted.withColumn("qw", raw / F.sqrt(F.sum(raw * raw).over(W.partitionBy("query_id"))))


def bm25_scores(index: LexicalIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_idx, score) of the documents that share a term with a query; a repeated term counts once."""
    met = index.met(query_terms(queries, index.mode).select("query_id", "term"))
    tf = F.col("tf")
    part = bm25_idf(F.col("df"), F.lit(index.n_docs)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(index.avgdl)))
    return met.groupBy("query_id", "doc_idx").agg(F.round(F.sum(part), PLACES).alias("score"))


def tfidf_scores(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """(query_id, doc_idx, score): cosine of query and document."""
    met = index.met(query_terms(queries, index.mode))
    return met.groupBy("query_id", "doc_idx").agg(F.round(F.sum(F.col("qw") * F.col("w")), PLACES).alias("score"))


@dataclass(frozen=True)
class Matched:
    """Documents that share a term with a query set, reduced to those terms: rows(doc_idx, dl, ids, tfs[, norm]), stored."""

    rows: DataFrame
    asked: Asked
    weights: Weights

    @classmethod
    def of(cls, rows: DataFrame, asked: Asked, n_docs: int | None = None, avgdl: float | None = None, k1: float = 1.5, b: float = 0.75) -> Matched:
        """Numbers of the corpus that aren't given are those of the rows, if these are all of its documents."""
        rows = stored(rows, "asked")
        if n_docs is None:
            n_docs, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            avgdl = total / n_docs if total else 1.0
        known = asked.known([tuple(r) for r in rows.select(F.explode("ids").alias("id")).groupBy("id").count().collect()])
        return cls(rows.where(F.size("ids") > 0), known, Weights(n_docs, avgdl, k1, b))

    @classmethod
    def in_texts(cls, docs: DataFrame, queries: DataFrame, mode: str = "plain", k1: float = 1.5, b: float = 0.75) -> Matched:
        """From one pass over texts, without an index: enough for BM25, which asks for nothing of a document's other terms."""
        asked = Asked.of(queries, query_terms(queries, mode))
        return cls.of(counted(docs, mode, asked.terms), asked, k1=k1, b=b)

    @classmethod
    def in_index(cls, index: LexicalIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> Matched:
        asked = Asked.of(queries, query_terms(queries, index.mode))
        return cls.of(index.reduced(asked.terms), asked, index.n_docs, index.avgdl, k1, b)

    def tops(self, k: int, arms: tuple[str, ...]) -> DataFrame:
        """(arm, query, doc_idx, and the score of each arm, rank), stored: the first k of each query by each arm; arm is its
        place among them. Each task hands on its own first k."""
        near = stored(firsts(self.rows, self.asked, self.weights, arms, k), "firsts")
        score = F.coalesce(*(F.when(F.col("arm") == i, F.col(a)) for i, a in enumerate(arms)))
        order = W.partitionBy("arm", "query").orderBy(F.desc(score), "doc_idx")
        return stored(near.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k), "tops")

    def top(self, k: int, arm: str) -> DataFrame:
        """(query_id, doc_idx, score, rank): the first k of each query by one arm."""
        return self.rankings(k, (arm,)).drop("arm")

    def rankings(self, k: int, arms: tuple[str, ...]) -> DataFrame:
        """(query_id, arm, doc_idx, score, rank): the first k of each query by each arm; arm is its place among them."""
        score = F.coalesce(*(F.when(F.col("arm") == i, F.col(a)) for i, a in enumerate(arms)))
        return named(self.tops(k, arms), self.asked).select("query_id", "arm", "doc_idx", score.alias("score"), "rank")


def lexical_scores(index: LexicalIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_idx, tfidf, bm25) from one pass over the postings."""
    met = index.met(query_terms(queries, index.mode))
    tf = F.col("tf")
    part = bm25_idf(F.col("df"), F.lit(index.n_docs)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(index.avgdl)))
    return met.groupBy("query_id", "doc_idx").agg(F.round(F.sum(F.col("qw") * F.col("w")), PLACES).alias("tfidf"), F.round(F.sum(part), PLACES).alias("bm25"))


def ranked(scores: DataFrame, score: str = "score", rank: str = "rank") -> DataFrame:
    """Adds the 0-based rank in each query: by falling score, then doc_idx."""
    return scores.withColumn(rank, F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), "doc_idx")) - 1)


def top(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The first k of each query, with rank."""
    return ranked(scores, score).where(F.col("rank") < k)


def candidate_pool(top_k: int, n: int | None = None) -> int:
    """How deep each arm is searched for a fused top-k."""
    deep = max(POOL_TIMES * top_k, POOL_LEAST)
    return deep if n is None else min(deep, n)


def zero_filled(found: DataFrame, docs: DataFrame, queries: DataFrame, k: int, score: str = "score") -> DataFrame:
    """found(query_id, doc_idx, score, rank) with unmatched documents, by doc_idx, until each query has k.

    Of the k + m first documents of the corpus at least k are unmatched in a query with m < k matches, so the first 2k are
    enough to choose from.
    """
    first = [r[0] for r in docs.select("doc_idx").orderBy("doc_idx").limit(2 * k).collect()]
    offered = queries.select("query_id", F.explode(F.lit(first) if first else F.array().cast("array<bigint>")).alias("doc_idx"))
    short = offered.join(found.select("query_id", "doc_idx"), ["query_id", "doc_idx"], "left_anti")
    have = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("__n"))
    numbered = short.join(have, "query_id", "left").withColumn("rank", F.coalesce("__n", F.lit(0)) + F.row_number().over(W.partitionBy("query_id").orderBy("doc_idx")) - 1)
    filler = numbered.where(F.col("rank") < k).select("query_id", "doc_idx", F.lit(0.0).alias(score), F.col("rank").cast("int").alias("rank"))
    return found.select("query_id", "doc_idx", score, F.col("rank").cast("int").alias("rank")).unionByName(filler)


def placed(some: DataFrame, scores: DataFrame, score: str, rank: str) -> DataFrame:
    """some(query_id, doc_idx, score, ...), rows of scores, with their 0-based rank among all rows of scores of the query.

    No query's scores are sorted: each is dealt to the gap between the few that are ranked, and the gaps' counts add up."""
    key = F.struct((-F.col(score)).alias("s"), F.col("doc_idx").alias("d"))
    edges = some.groupBy("query_id").agg(F.array_sort(F.collect_set(key)).alias("edges"))
    near = scores.join(edges, "query_id").where(key <= F.element_at("edges", -1))
    gaps = near.groupBy("query_id", F.size(F.filter("edges", lambda e: e < key)).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    upto = gaps.withColumn(rank, F.sum("n").over(W.partitionBy("query_id").orderBy("place")) - 1).drop("n")
    at = edges.select("query_id", F.posexplode("edges").alias("place", "edge")).select("query_id", "place", F.col("edge.d").alias("doc_idx"))
    return some.join(at.join(upto, ["query_id", "place"]).drop("place"), ["query_id", "doc_idx"])


def _both_ranks(m: Matched, deep: int) -> DataFrame:
    """(query_id, doc_idx, t, m): the documents among the first `deep` of the TF-IDF or the BM25 ranking of a query, with
    their ranks in both.

    These few, a bounded number for each query, are put together on the driver. What isn't among the first of the other arm
    has its rank there counted: of all pairs, those that fall between the ones looked for."""
    arms = ("tfidf", "bm25")
    rows = m.tops(deep, arms).select("query", "doc_idx", "tfidf", "bm25", "arm", "rank").toArrow()
    query, doc, tfidf, bm25, arm, rank = (rows.column(c).to_numpy() for c in rows.column_names)
    pairs, at = np.unique(np.stack([query.astype(np.int64), doc]), axis=1, return_inverse=True)
    at = at.reshape(-1)
    scores, ranks = np.zeros((2, pairs.shape[1])), np.full((2, pairs.shape[1]), -1, np.int64)
    scores[0, at], scores[1, at] = tfidf, bm25
    ranks[arm, at] = rank
    edges, owners = {}, {}
    for i, name in enumerate(arms):
        lacking = np.flatnonzero(ranks[i] < 0)
        lacking = lacking[np.lexsort((pairs[1, lacking], -scores[i, lacking], pairs[0, lacking]))]
        bounds = np.searchsorted(pairs[0, lacking], np.arange(len(m.asked.ids) + 1))
        owners[name] = [lacking[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        edges[name] = [(scores[i, x], pairs[1, x]) for x in owners[name]]
    if (ranks < 0).any():
        counts = {name: [np.zeros(len(x), np.int64) for x in owners[name]] for name in arms}
        for i, q, place, n in in_gaps(m.rows, m.asked, m.weights, edges).groupBy("arm", "query", "place").agg(F.sum("n")).collect():
            counts[arms[i]][q][place] = n
        for i, name in enumerate(arms):
            for x, n in zip(owners[name], counts[name], strict=True):
                ranks[i, x] = np.cumsum(n) - 1
    table = pa.table({"query": pa.array(pairs[0], pa.int32()), "doc_idx": pa.array(pairs[1], pa.int64()), "t": pa.array(ranks[0], pa.int32()), "m": pa.array(ranks[1], pa.int32())})
    return named(m.rows.sparkSession.createDataFrame(table), m.asked)


def lexical_search(index: LexicalIndex, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_idx, score, rank): the top k by reciprocal rank fusion of the whole TF-IDF and BM25 rankings.

    Ties go by TF-IDF rank. No query comes back with fewer than k, or all, documents: those without a common term follow
    by doc_idx, with the score that their equal ranks in both arms give.

    The k best of one arm have more than 1 / (RRF_K + k) each, and a document that neither arm has among its first
    RRF_K + 2k has less; so only these are fused, with their ranks in both arms."""
    arms = _both_ranks(Matched.in_index(index, queries, k1, b), RRF_K + 2 * k)
    fused = arms.withColumn("score", F.lit(1.0) / (RRF_K + 1 + F.col("t")) + F.lit(1.0) / (RRF_K + 1 + F.col("m")))
    best = fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "t")) - 1).where(F.col("rank") < k)
    filled = zero_filled(stored(best, "fused"), index.docs, queries, k)
    return filled.withColumn("score", F.when(F.col("score") > 0, F.col("score")).otherwise(2.0 / (RRF_K + 1 + F.col("rank"))))


def reciprocal_rank_fusion(rankings: DataFrame, k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, doc_idx, score, rank) of rankings(query_id, arm, arm_no, doc_idx, rank).

    score: sum over arms of weight / (k + rank + 1), added in the order of arm_no. Ties go by the first arm that has the
    document, then by its rank there. Arms without a weight have 1."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("arm")), F.lit(1.0)) if weights else F.lit(1.0)
    parts = rankings.withColumn("part", weight / (k + 1 + F.col("rank")))
    listed = parts.groupBy("query_id", "doc_idx").agg(F.array_sort(F.collect_list(F.struct("arm_no", "rank", "part"))).alias("parts"))
    summed = listed.select("query_id", "doc_idx", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]).alias("score"), F.col("parts")[0].alias("first"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first.arm_no", "first.rank")
    return summed.withColumn("rank", F.row_number().over(order) - 1).drop("first")

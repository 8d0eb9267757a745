"""Dense and hybrid search over unit vectors: exact inner products, top-k in blocks, optional scalar quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.text import unit
from quarry.operators.lexical import LexicalIndex, candidate_pool, lexical_search, reciprocal_rank_fusion

PLACES = 9
#: Queries that meet a batch of vectors at once.
QUERY_BLOCK = 256


def dense_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_idx, score, rank): the k vectors of largest inner product, ties by doc_idx.

    vectors(doc_idx, vector), queries(query_id, vector): unit vectors. Each batch of vectors is multiplied with the query
    block and hands on its own k best for each query; the best of those are the answer. Queries are a stated set that the
    caller holds: they are collected and sent along."""
    rows = queries.orderBy("query_id").collect()
    ids = [r["query_id"] for r in rows]
    q = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1)
    kind = queries.schema["query_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch.filter(batch.column(1).is_valid())
            if not valid.num_rows or not len(ids):
                continue
            idx, flat = valid.column(0).to_numpy(zero_copy_only=False), valid.column(1).flatten().to_numpy(zero_copy_only=False)
            x = flat.astype(np.float64).reshape(len(idx), -1)
            for s in range(0, len(ids), QUERY_BLOCK):
                scores = np.round(x @ q[s : s + QUERY_BLOCK].T, PLACES)
                for j in range(scores.shape[1]):
                    best = np.lexsort((idx, -scores[:, j]))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[s + j]] * len(best), arrow), pa.array(idx[best]), pa.array(scores[best, j])], ["query_id", "doc_idx", "score"])

    near = vectors.select(F.col("doc_idx").cast("long").alias("doc_idx"), "vector").mapInArrow(run, f"query_id {kind.simpleString()}, doc_idx long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_idx")
    return near.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def normalised(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vector", unit(F.col("vector")))


def quantised(vector: Column, bits: int = 4) -> Column:
    """A vector whose numbers are rounded to 2^bits - 1 even steps of its own range (an approximation of stored codes)."""
    if bits not in (2, 3, 4):
        raise ValueError(f"bits {bits} is none of 2, 3, 4")
    top = F.array_max(F.transform(vector, F.abs))
    step = top / ((1 << (bits - 1)) - 0.5)
    return F.when(top > 0, F.transform(vector, lambda x: ((F.floor(x / step) + 0.5) * step).cast("double"))).otherwise(vector)


def hybrid_search(index: LexicalIndex, vectors: DataFrame, queries: DataFrame, k: int, weights: tuple[float, float] | None = None) -> DataFrame:
    """(query_id, doc_idx, score, rank): rank fusion of the lexical and the dense top, each as deep as the pool.

    queries(query_id, query, vector). weights: of the lexical and the dense arm."""
    pool = candidate_pool(k, index.n_docs)
    arms = [("lexical", lexical_search(index, queries, pool)), ("dense", dense_search(vectors, queries.select("query_id", "vector"), pool))]
    both = [df.select("query_id", F.lit(name).alias("arm"), F.lit(i).alias("arm_no"), "doc_idx", "rank") for i, (name, df) in enumerate(arms)]
    fused = reciprocal_rank_fusion(both[0].unionByName(both[1]), weights=dict(zip(("lexical", "dense"), weights, strict=True)) if weights else None)
    return fused.where(F.col("rank") < k).select("query_id", "doc_idx", "score", "rank")

"""Extension: an index that follows a stream of documents. Each micro-batch upserts its documents' postings by id.

Document frequencies and the average length change with every batch, so they are aggregated from the stored postings when
the index is opened, never kept as streaming state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.lexical import LexicalIndex, term_frequencies


def follow(documents: DataFrame, folder: str, checkpoint: str, mode: str = "plain") -> StreamingQuery:
    """Starts a query that keeps the postings of a stream documents(doc_idx, docid, text) below folder.

    A batch is written under its number, in overwrite mode: a batch that is run again replaces its own files."""

    def upsert(batch: DataFrame, number: int) -> None:
        stamped = batch.select("doc_idx", "docid", "text")
        stamped.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/docs/part={number}")
        term_frequencies(stamped, mode).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/postings/part={number}")

    return documents.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def opened(spark: SparkSession, folder: str, mode: str = "plain") -> LexicalIndex:
    """The index as it stands: of each document the batch that came last counts."""
    stored = spark.read.parquet(f"{folder}/docs")
    last = W.partitionBy("doc_idx")
    docs = stored.withColumn("__last", F.max("batch").over(last)).where("batch = __last").select("doc_idx", "docid", "text", "batch")
    postings = spark.read.parquet(f"{folder}/postings").join(docs.select("doc_idx", "batch"), ["doc_idx", "batch"], "left_semi").select("doc_idx", "term", "tf", "dl")
    current = docs.select("doc_idx", "docid", "text")
    n_docs, total = current.count(), postings.agg(F.sum("tf")).first()[0] or 0
    return LexicalIndex(current, postings, n_docs, total / n_docs if total else 1.0, mode)

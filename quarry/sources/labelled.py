"""Labelled queries from JSON: an object with `queries`, each with its id, text, category and relevant spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "queries array<struct<id:string,category:string,query:string,relevant:array<struct<source_path:string,start_line:int,end_line:int>>>>"


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, query, category) and golds(query_id, gold_idx, source_path, start_line, end_line).

    A span without lines is the whole file; a query may have no spans."""
    rows = spark.read.schema(SCHEMA).option("multiLine", "true").json(path).select(F.inline("queries"))
    queries = rows.select(F.col("id").alias("query_id"), "query", "category")
    golds = rows.select(F.col("id").alias("query_id"), F.posexplode("relevant")).select("query_id", F.col("pos").alias("gold_idx"), "col.source_path", "col.start_line", "col.end_line")
    return queries, golds

"""Consolidation of several strategies' hits: spans that meet are merged, groups are fused, and each says who found it.

Hits are rows (query_id, retriever, pos, docid, source_path, start_line, end_line, rank, context, metadata): pos is the
place in the strategy's list, rank its own 0-based rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Strategies in their fixed order; others follow by name.
ORDER = ("lexical", "turbovec", "pi-serini", "hybrid", "treesitter")
#: Strategies whose hit alone is worth a medium confidence.
STRONG = ("turbovec", "pi-serini")
RRF_K = 60


def strategy_order(name: Column) -> Column:
    """Sort key of a strategy: its place in ORDER, or after all of them."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), name)
    return F.when(place > 0, place).otherwise(len(ORDER) + 1).cast("int")


def confidence(agreement: Column, provenance: Column) -> Column:
    """high if two or more agree; else medium for a strong strategy alone, low for any other."""
    return F.when(agreement >= 2, "high").when(F.get(provenance, F.lit(0)).isin(*STRONG), "medium").otherwise("low")


def span_groups(hits: DataFrame, merge_adjacent: bool = True) -> DataFrame:
    """hits with `grp`, which names the group within the query.

    Spans of a path that overlap (or, merge_adjacent, follow line on line) are a group: in the order of their starts a new
    one begins where a start is past every end before it. Hits without a span are one group for each docid."""
    spanned = F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    by_path = W.partitionBy("query_id", "source_path").orderBy("start_line", "end_line", "docid", "retriever", "pos")
    reach = F.max("end_line").over(by_path.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("start_line") > reach + (1 if merge_adjacent else 0)), 1).otherwise(0)
    islands = hits.where(spanned).withColumn("__begins", begins).withColumn("__n", F.sum("__begins").over(by_path.rowsBetween(W.unboundedPreceding, 0)))
    merged = islands.withColumn("grp", F.struct(F.lit(True).alias("spanned"), F.col("source_path").alias("name"), F.col("__n").alias("n"))).drop("__begins", "__n")
    alone = hits.where(~spanned).withColumn("grp", F.struct(F.lit(False).alias("spanned"), F.col("docid").alias("name"), F.lit(0).cast("long").alias("n")))
    return merged.unionByName(alone)


def consolidate(hits: DataFrame, k: int = RRF_K, weights: dict[str, float] | None = None, merge_adjacent: bool = True) -> DataFrame:
    """One row for each group and query: query_id, source_path, start_line, end_line, docid, context, score, rank (1-based),
    provenance, agreement, confidence, contributors, metadata.

    A group counts once in each strategy, at its first place there without repeats. Scores add weight / (k + place + 1) in
    the fixed order of strategies. The member of best rank (then first span, then docid) stands for the group; context and,
    where that member has none, metadata come from the first strategy in the fixed order whose last hit in the group has
    some. Ties in score go by path, span and docid."""
    grouped = span_groups(hits, merge_adjacent)
    if weights:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("retriever")), F.lit(1.0))
    else:
        weight = F.lit(1.0)
    order = strategy_order(F.col("retriever")).alias("o")
    firsts = grouped.groupBy("query_id", "retriever", "grp").agg(F.min("pos").alias("pos"), F.max_by(F.struct("context", "metadata"), "pos").alias("last"))
    place = F.row_number().over(W.partitionBy("query_id", "retriever").orderBy("pos"))
    parts = firsts.withColumn("part", weight / (k + place)).select("query_id", "grp", F.struct(order, F.col("retriever"), F.col("part"), F.col("last")).alias("x"))
    scored = parts.groupBy("query_id", "grp").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    member = F.struct("rank", F.coalesce("start_line", F.lit(0)).alias("s"), F.coalesce("end_line", F.lit(0)).alias("e"), "docid", "source_path", "start_line", "end_line", "metadata")
    members = grouped.groupBy("query_id", "grp").agg(
        F.min(member).alias("best"),
        F.array_sort(F.collect_set("retriever")).alias("provenance"),
        F.array_sort(F.collect_list(F.struct("retriever", "rank", "docid"))).alias("contributors"),
    )
    lasts = lambda field: F.get(F.filter(F.transform("xs", lambda x: x["last"][field]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))
    joined = members.join(scored, ["query_id", "grp"]).withColumn("agreement", F.size("provenance"))
    out = joined.select(
        "query_id", "best.source_path", "best.start_line", "best.end_line", "best.docid",
        F.coalesce(lasts("context"), F.lit("")).alias("context"),
        F.aggregate("xs", F.lit(0.0), lambda s, x: s + x["part"]).alias("score"),
        "provenance", "agreement", confidence(F.col("agreement"), F.col("provenance")).alias("confidence"), "contributors",
        F.when(F.coalesce("best.metadata", F.lit("")) != "", F.col("best.metadata")).otherwise(lasts("metadata")).alias("metadata"),
    )
    final = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "source_path", F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0)), "docid")
    return out.withColumn("rank", F.row_number().over(final))

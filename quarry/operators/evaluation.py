"""Evaluation of rankings against gold spans: recall, nDCG, precision by confidence, means.

hits(query_id, arm, rank, source_path, start_line, end_line[, confidence]): rank is the 0-based place in the list.
golds(query_id, gold_idx, source_path, start_line, end_line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import same_path

BUCKETS = ("high", "medium", "low")


def matches(hit: str = "h", gold: str = "g") -> Column:
    """The hit's path is the gold's, or one ends with the other; and their lines meet, or one has none."""
    h, g = (lambda c, of=of: F.col(f"{of}.{c}") for of in (hit, gold))
    open_ = h("start_line").isNull() | h("end_line").isNull() | g("start_line").isNull() | g("end_line").isNull()
    return same_path(h("source_path"), g("source_path")) & (open_ | ((h("start_line") <= g("end_line")) & (g("start_line") <= h("end_line"))))


def matched(hits: DataFrame, golds: DataFrame, k: int) -> DataFrame:
    """(query_id, arm, rank, gold_idx) of the hits among the first k; each query's golds meet its own hits only."""
    pairs = hits.where(F.col("rank") < k).alias("h").join(golds.alias("g"), (F.col("h.query_id") == F.col("g.query_id")) & matches())
    return pairs.select("h.query_id", "h.arm", "h.rank", "g.gold_idx").distinct()


def _asked(hits: DataFrame, golds: DataFrame) -> DataFrame:
    """(query_id, arm, n_golds) for each query and arm that was run."""
    counts = golds.groupBy("query_id").agg(F.count_distinct("gold_idx").alias("n_golds"))
    return hits.select("query_id", "arm").distinct().join(counts, "query_id", "left").withColumn("n_golds", F.coalesce("n_golds", F.lit(0)))


def recall_at_k(hits: DataFrame, golds: DataFrame, k: int) -> DataFrame:
    """(query_id, arm, recall): part of a query's golds that some hit among the first k matches; 0 without golds."""
    found = matched(hits, golds, k).groupBy("query_id", "arm").agg(F.count_distinct("gold_idx").alias("found"))
    out = _asked(hits, golds).join(found, ["query_id", "arm"], "left")
    return out.select("query_id", "arm", F.when(F.col("n_golds") > 0, F.coalesce("found", F.lit(0)) / F.col("n_golds")).otherwise(0.0).alias("recall"))


def ndcg_at_k(hits: DataFrame, golds: DataFrame, k: int) -> DataFrame:
    """(query_id, arm, ndcg): a hit gains 1 / log2(place + 1) if it claims a gold: its first that none before it claimed."""
    by_hit = matched(hits, golds, k).groupBy("query_id", "arm", "rank").agg(F.array_sort(F.collect_set("gold_idx")).alias("golds"))
    listed = by_hit.groupBy("query_id", "arm").agg(F.array_sort(F.collect_list(F.struct("rank", "golds"))).alias("hits"))
    gold = golds.schema["gold_idx"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{gold}>").alias("claimed"), F.lit(0.0).alias("dcg"))

    def claim(state: Column, hit: Column) -> Column:
        free = F.filter(hit["golds"], lambda g: ~F.array_contains(state["claimed"], g))
        gain = F.when(F.size(free) > 0, 1 / F.log2(hit["rank"] + 2.0)).otherwise(0.0)
        return F.struct(F.concat(state["claimed"], F.slice(free, 1, 1)).alias("claimed"), (state["dcg"] + gain).alias("dcg"))

    dcg = listed.select("query_id", "arm", F.aggregate("hits", start, claim)["dcg"].alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_golds").cast("int"))), F.lit(0.0), lambda s, p: s + 1 / F.log2(p + 1.0))
    out = _asked(hits, golds).join(dcg, ["query_id", "arm"], "left")
    return out.select("query_id", "arm", F.when(F.col("n_golds") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"))


def confidence_validity(pairs: DataFrame) -> DataFrame:
    """(confidence, relevant, total, precision, monotonic), three rows, of pairs(confidence, is_relevant).

    precision is null for an empty bucket; monotonic, the same in each row: it doesn't rise from high to low over those
    that have one."""
    counts = pairs.where(F.col("confidence").isin(*BUCKETS)).groupBy("confidence").agg(F.sum(F.col("is_relevant").cast("long")).alias("relevant"), F.count(F.lit(1)).alias("total"))
    names = pairs.sparkSession.createDataFrame([(b, i) for i, b in enumerate(BUCKETS)], "confidence string, place int")
    out = names.join(counts, "confidence", "left").select("confidence", "place", F.coalesce("relevant", F.lit(0)).alias("relevant"), F.coalesce("total", F.lit(0)).alias("total")).withColumn("precision", F.when(F.col("total") > 0, F.col("relevant") / F.col("total")))
    before = F.last("precision", ignorenulls=True).over(W.partitionBy(F.lit(1)).orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    rising = out.withColumn("rises", F.coalesce(F.col("precision") > before, F.lit(False)))
    return rising.withColumn("monotonic", ~F.max("rises").over(W.partitionBy(F.lit(1)))).select("confidence", "relevant", "total", "precision", "monotonic")


def means(metrics: DataFrame) -> DataFrame:
    """The mean of each metric by arm, over the queries that the arm ran."""
    names = [c for c in metrics.columns if c not in ("query_id", "arm", "category")]
    return metrics.groupBy("arm").agg(*(F.avg(c).alias(c) for c in names))


def evaluate(hits: DataFrame, golds: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, arm, recall, ndcg)."""
    return recall_at_k(hits, golds, k).join(ndcg_at_k(hits, golds, k), ["query_id", "arm"])

"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order (by the MD5 of their ids), served again from its start when
it is used up. A document goes out in packets; a packet's virtual finish time is the words of its source up to its end,
divided by the source's target. All packets are range-sorted by that time, and the mix takes them in this order until its
budget, all words of the table, is spent; the packet at the end is taken in part.

No source is one group: running sums are taken within hash buckets of a source and over the buckets' totals, and over the
parts of the range sort. Words that end by virtual time 1 are never more than the budget, as targets add up to it, so a
copy that ends by then is one packet; others are cut into packets of a thousandth of their source's target, and packets
that begin so late that the budget is spent by then in any case are not made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import WORD, files_for, id_key, n_words, own_columns, partitions, written

#: Times that a document may be taken.
EPOCHS = 3
#: Words of a packet at most, and the part of a source's target that a packet is at most.
PACKET, PART = 256, 1000
#: Hex digits of the hash that name a bucket: 4096 buckets for each source.
BUCKET_DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, source_rank, target), a row for each source. sizes: (source, size).

    Sources by code point, null last, weigh `weights`, repeating. Targets share all words by weight; one above EPOCHS
    times its source's size stops there, and the excess is shared again by weight until none is above. The ranking of the
    sources is one task, of a row for each source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn("source_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", EPOCHS * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    before = W.orderBy("ratio", "source_rank").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("ratio", "source_rank").rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    levels = capped.withColumn("level", level)
    # the first source, by ratio, whose share by weight is within its cap: it and all after it get the level at it
    fit = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_rank", "level"))).over(W.partitionBy())["level"]
    return levels.select("source", "source_size", "source_rank", F.least(F.col("cap").cast("double"), fit * F.col("weight")).alias("target"))


def queues(rows: DataFrame) -> DataFrame:
    """rows(row, doc_id, source, size, key) with source_size, source_rank, target, and start: the words before it in its queue."""
    aims = F.broadcast(targets(rows)) if rows.select("source").distinct().limit(10_001).count() <= 10_000 else targets(rows)
    bucket = F.substring("key", 1, BUCKET_DIGITS).alias("bucket")
    queue = rows.join(aims, rows["source"].eqNullSafe(aims["source"])).select("row", "doc_id", "size", "key", bucket, *(aims[c] for c in ("source_size", "source_rank", "target")))
    earlier = W.partitionBy("source_rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = queue.groupBy("source_rank", "bucket").agg(F.sum("size").alias("words")).select("source_rank", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("bucket_start"))
    inside = W.partitionBy("source_rank", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = queue.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(buckets, ["source_rank", "bucket"])
    return placed.select("row", "doc_id", "size", "source_size", "source_rank", "target", (F.col("bucket_start") + F.col("inside")).alias("start"))


def packets(queue: DataFrame) -> DataFrame:
    """(row, source_rank, begin, words, finish) of the packets of queue that the budget may reach: begin counts the words of
    the source before the packet, those of earlier copies too."""
    sized = queue.where("size > 0 AND target > 0").withColumn("packet", F.greatest(F.lit(1), F.least(F.lit(PACKET), F.floor(F.col("target") / PART))).cast("long"))
    # at virtual time 1 less than one packet of each source is still to be served
    slack = sized.select("source_rank", "packet").distinct().agg(F.sum("packet")).first()[0] or 0
    copies = sized.withColumn("copy", F.explode(F.array(*map(F.lit, range(EPOCHS))))).withColumn("first", F.col("copy") * F.col("source_size") + F.col("start"))
    reached = copies.where(F.col("first") < F.col("target") + slack)
    step = F.when((F.col("first") + F.col("size")) / F.col("target") <= 1, F.col("size")).otherwise(F.col("packet"))
    last = F.least(F.floor((F.col("size") - 1) / F.col("step")), F.floor((F.col("target") + slack - F.col("first")) / F.col("step"))).cast("int")
    cut = reached.withColumn("step", step).withColumn("nth", F.explode(F.sequence(F.lit(0), last)))
    words = F.least(F.col("step"), F.col("size") - F.col("nth") * F.col("step"))
    made = cut.select("row", "source_rank", "target", (F.col("first") + F.col("nth") * F.col("step")).alias("begin"), words.alias("words"))
    return made.select("row", "source_rank", "begin", "words", ((F.col("begin") + F.col("words")) / F.col("target")).alias("finish"))


def served(all_packets: DataFrame, budget: int, files: int) -> DataFrame:
    """(row, taken): the words of each row in the first `budget` words of the packets, in the order of their finish.

    What comes to the driver is a number for each part of the range sort; one part, where the budget ends, has running sums."""
    order = ("finish", "source_rank", "begin")
    spark = all_packets.sparkSession
    parts = written(all_packets.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "packets", files)
    before, last = 0, -1
    for part, n in sorted(map(tuple, parts.groupBy("part").agg(F.sum("words")).collect())):
        last = part
        if before + n > budget:
            break
        before += n
    else:
        last += 1
    earlier = F.coalesce(F.sum("words").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = parts.where(F.col("part") == last).withColumn("left", F.lit(budget - before) - earlier).select("row", F.greatest(F.lit(0), F.least(F.col("words"), F.col("left"))).alias("words"))
    return parts.where(F.col("part") < last).select("row", "words").unionByName(rest).groupBy("row").agg(F.sum("words").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """A row for each row of docs(doc_id, text, source, ...): doc_id, size, source_size, target, taken, finish.

    taken: words of the document that the mix takes, repeats counted, never above EPOCHS times size. A source's taken words
    differ from its target by less than a packet if they are fewer, and by less than a packet of each source if they are
    more. finish: virtual time at which its first copy ends (null for a source without a target). Null texts have no words;
    null sources are one source. Ties in the shuffled order (repeated ids) go by size; rows that tie there too are alike.
    An empty table gives no rows.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), order.alias("key")), "sizes")
    n, words = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    few = files_for(docs.sparkSession, n)
    queue = written(queues(rows), "queues", few)
    taken = served(packets(queue), words or 0, few)
    finish = F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target"))
    return queue.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), finish.alias("finish"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them, with their columns: a row for each whole copy, and one cut at a word's end for a part.

    A document that it takes once is as it was. Rows that share doc_id and size are alike to the mix: the words taken
    from them together are shared out row by row, whole copies first.
    """
    taken = mix(docs).groupBy(id_key(F.col("doc_id")).alias("__q_id"), F.col("size").alias("__q_n")).agg(F.sum("taken").alias("__q_taken"))
    numbered = own_columns(docs).withColumn("__q_n", n_words(F.col("text"))).withColumn("__q_id", id_key(F.col("doc_id")))
    joined = numbered.join(taken, ["__q_id", "__q_n"])
    # rows that repeat an id and size get their parts by a number among them
    nth = F.row_number().over(W.partitionBy("__q_id", "__q_n").orderBy(F.xxhash64("text"))) - 1
    twins = F.count(F.lit(1)).over(W.partitionBy("__q_id", "__q_n"))
    joined = joined.withColumn("__q_nth", nth).withColumn("__q_twins", twins)
    whole = F.floor(F.col("__q_taken") / F.col("__q_n"))
    own = F.floor(whole / F.col("__q_twins")) + F.when(F.col("__q_nth") < whole % F.col("__q_twins"), 1).otherwise(0)
    part = F.when(F.col("__q_nth") == F.col("__q_twins") - 1, F.col("__q_taken") % F.col("__q_n")).otherwise(0)
    sized = joined.where("__q_n > 0").withColumn("__q_part", part).withColumn("__q_own", own)
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("__q_own").cast("int")), F.when(F.col("__q_part") > 0, F.array(F.col("__q_part"))).otherwise(F.array().cast("array<bigint>")))
    out = sized.withColumn("__q_copy", F.explode(copies))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("__q_copy"), F.lit(0)).cast("int"))
    cut = F.when(F.col("__q_copy") < 0, F.col("text")).otherwise(F.array_join(words, " "))
    cols = [cut.alias("text") if c == "text" else F.when(F.col("__q_copy") < 0, F.col("n_chars")).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_rank FROM s),
w AS (SELECT *, (source_rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / ((source_rank - 1) % 3 + 1) AS ratio FROM r),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY ratio, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
f AS (SELECT level AS fit FROM l WHERE level <= ratio ORDER BY ratio, source_rank LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), fit * weight) AS target FROM l, f),
q AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target, row_number() OVER () AS n,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(greatest(1, least(256, floor(target / 1000))) AS BIGINT) AS packet, unnest(range(3)) AS copy FROM q WHERE size > 0),
p AS (
  SELECT n, source, target, size, packet, copy * source_size + start AS first, unnest(range((size + packet - 1) // packet)) AS nth FROM c),
b AS (SELECT n, source, target, first + nth * packet AS begin_, least(packet, size - nth * packet) AS words FROM p),
o AS (
  SELECT n, words, sum(words) OVER (ORDER BY (begin_ + words) / target, source NULLS LAST, begin_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS earlier FROM b),
k AS (SELECT n, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - earlier))) AS taken FROM o GROUP BY n)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CASE WHEN target > 0 THEN (start + size) / target END AS finish
FROM q LEFT JOIN k USING (n)
"""

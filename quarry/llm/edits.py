"""Fingerprints by order min-hash: what they share follows edit distance, as they keep the order of the text.

A text's k-mers are numbered by occurrence, so repeats are different; each is hashed once, and the hash also names the
part of the hash range it falls in. In each part the least TUPLE of them are put back in the order of the text, and the
hash of that tuple is one value of the fingerprint. A part with too few goes on into the next, round the end.

This is the variant with one hash for all values, cut in parts, where the plain method hashes every k-mer once for each
value. In a text of many k-mers the values are as good; one of fewer than TUPLE for each part shares k-mers between
neighbouring values, so its likeness moves in larger steps, and short texts that are equal still have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import partitions

#: Code points of a k-mer; k-mers of a tuple; values of a fingerprint (16 bits each).
K, TUPLE, VALUES = 5, 2, 64
#: Bytes of text that a task is dealt.
TASK_BYTES = 128 << 20
#: Documents of a range of ids, and how many ranges there may be: what the driver holds is two numbers for each.
RANGE_DOCS, MOST_RANGES = 500, 4096
PLACE_BITS = 28  #: bits for a place in the text; longer texts take as many as they need
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, k: int = K, values: int = VALUES) -> np.ndarray:
    """16-bit values; all zero for an empty text. A text shorter than k is one k-mer."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(codes):
        return np.zeros(values, "<u2")
    with np.errstate(over="ignore"):
        k = min(k, len(codes))
        n = len(codes) - k + 1
        h = codes[:n].copy()
        for j in range(1, k):
            h *= _BASE
            h += codes[j : j + n]
        place = np.arange(n, dtype=np.uint64)
        bits = np.uint64(max(PLACE_BITS, n.bit_length()))
        by_kmer = np.sort((_mixed(h) >> bits << bits) | place)
        kmer = by_kmer >> bits
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(np.r_[True, kmer[1:] != kmer[:-1]], at, 0))
        numbered = _mixed(kmer * _BASE + (at - first).astype(np.uint64) + np.uint64(1))
        places = (np.uint64(1) << bits) - np.uint64(1)
        least = np.sort((numbered >> bits << bits) | (by_kmer & places))
        starts = np.searchsorted(least, (np.arange(values, dtype=np.uint64) << np.uint64(58)) if values == 64 else np.array([(i << 64) // values for i in range(values)], np.uint64))
        chosen = least[(starts[:, None] + np.arange(TUPLE)) % n]
        order = np.argsort(chosen & places, axis=1, kind="stable")
        chosen = np.take_along_axis(chosen, order, axis=1) >> bits
        out = chosen[:, 0]
        for j in range(1, TUPLE):
            out = _mixed(out * _BASE + chosen[:, j])
        return (_mixed(out) >> np.uint64(48)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much (or all) of the start of another."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _least_long(ids: pd.Series) -> np.ndarray:
    """Ids as longs; nulls come before all others."""
    return ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64)


def paired(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """docs as (range, ahead, doc_id, text), the number of ranges, the bytes of all texts: each range of ids, and after it (ahead) the first document of the next.

    Ranges are cut at quantiles of the ids; each document is dealt to its range, and the first of each range to the one
    before it too, so that every document meets its follower without an order of the whole table in one task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    wanted = max(1, min(MOST_RANGES, -(-n // RANGE_DOCS)))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 20 * wanted)).first()[0] if wanted > 1 else None
    edges = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, pd.to_numeric(_least_long(ids.astype("Int64")))))

    firsts = rows.select("doc_id", range_of("doc_id").alias("range")).groupBy("range").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first")).orderBy("range").collect()
    before = {x["first"]: firsts[i - 1]["range"] for i, x in enumerate(firsts)}

    @F.pandas_udf("array<long>")
    def slots(ids: pd.Series) -> pd.Series:
        ids = _least_long(ids.astype("Int64"))
        own = np.searchsorted(edges, ids)
        return pd.Series([[2 * r, 2 * before[i] + 1] if i in before else [2 * r] for r, i in zip(own.tolist(), ids.tolist(), strict=True)])

    dealt = rows.withColumn("slot", F.explode(slots("doc_id"))).select(F.shiftright("slot", 1).alias("range"), (F.col("slot") % 2 == 1).alias("ahead"), "doc_id", "text")
    return dealt, len(firsts), size


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """COLUMNS for each row of docs(doc_id, text, ...): its fingerprint, that of its edited text, and likenesses.

    The next document is the next row by (doc_id, text), and after the last the first; null ids come first, null texts
    count as empty. A table of one row is its own follower; an empty one gives no rows; other columns are not read.
    """
    dealt, ranges, size = paired(docs)
    n = min(ranges, max(partitions(docs.sparkSession), size // TASK_BYTES)) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, fingerprint) of the row that waits for its follower

        def row(text: str, print_: np.ndarray, doc_id: int | None, following: str, next_print: np.ndarray) -> tuple:
            other = edited(text, following)
            own = fingerprint(other)
            return doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), print_.tobytes().hex(), own.tobytes().hex(), likeness(print_, own), likeness(print_, next_print)

        for batch in batches:
            out = []
            for r, ahead, doc_id, x in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if ahead and (held is None or held[0] != r):
                    continue  # a repeat of the first document of the next range
                text = x.as_py()
                own = fingerprint(text)
                if held is not None:
                    out.append(row(held[2], held[3], held[1], text, own))
                held = None if ahead else (r, doc_id, text, own)
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])

    return dealt.repartition(n, "range").sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, COLUMNS)

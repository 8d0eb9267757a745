"""Exact deduplication: minimal perfect hash functions over the distinct digests of a history.

A history (everything ingested so far) is kept as an index of shards. In a shard, a minimal perfect hash gives each
distinct digest a slot of its own; the slot holds the whole digest, its winner's locator and how many rows had it. A
probe is a member only if the digest in its slot equals its own byte for byte. Digests that no slot holds are grouped
among themselves. Digests are counted before they are shuffled, so a group of copies with a third of all rows is a few
rows by then, and a shard holds distinct digests only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import SPACE, files_for, id_key, rows_of, written

#: Distinct digests of a shard of the index: some MB of digests and locators.
SHARD_DIGESTS = 50_000
#: Bits of a level for each key that is still without a slot.
GAMMA = 2.0
LEVELS = 48


def normalised(text: Column) -> Column:
    """Each run of white space replaced by one space; null is an empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of each 16-byte key for a level."""
    with np.errstate(over="ignore"):
        x = keys[:, 0] ^ (keys[:, 1] + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bits: a key's slot is the rank of its bit in the first level where no other key has the same bit."""

    def __init__(self, keys: np.ndarray):
        self.n, self.levels = len(keys), []
        left, at = keys, 0
        while len(left) and len(self.levels) < LEVELS:
            size = max(1, int(GAMMA * len(left)))
            bit = _mixed(left, len(self.levels)) % np.uint64(size)
            alone = np.bincount(bit.astype(np.int64), minlength=size) == 1
            self.levels.append((np.packbits(alone), size, at))
            at += int(alone.sum())
            left = left[~alone[bit.astype(np.int64)]]
        self.rest = {tuple(k): at + i for i, k in enumerate(left.tolist())}  # keys that share all 16 bytes would be here

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys that were not built in, any slot or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (packed, size, at) in enumerate(self.levels):
            if not len(open_):
                break
            bits = np.unpackbits(packed, count=size)
            rank = np.cumsum(bits) - 1
            bit = (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = bits[bit] == 1
            out[open_[hit]] = at + rank[bit[hit]]
            open_ = open_[~hit]
        for i in open_ if self.rest else ():
            out[i] = self.rest.get(tuple(keys[i].tolist()), -1)
        return out


def _bytes(digests: pd.Series) -> np.ndarray:
    """32-byte digests as rows."""
    return np.frombuffer(b"".join(map(bytes, digests)), np.uint8).reshape(-1, 32)


def _keys(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :16]).view("<u8").reshape(-1, 2)


def digest_counts(rows: DataFrame) -> DataFrame:
    """Distinct digests with the smallest id and the number of rows (counted before the shuffle)."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, hash, digests, winners, counts): slots in order. counts: distinct digests with winner and n."""

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _bytes(pdf["digest"])
        mph = PerfectHash(_keys(rows))
        order = np.argsort(mph.slots(_keys(rows)))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "hash": [pickle.dumps(mph)], "digests": [rows[order].tobytes()], "winners": [pdf["winner"].to_numpy("<i8")[order].tobytes()], "counts": [pdf["n"].to_numpy("<i8")[order].tobytes()]})

    keyed = counts.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return keyed.groupBy("shard").applyInPandas(shard, "shard long, hash binary, digests binary, winners binary, counts binary")


def resolve(counts: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, group_size, in_history) of each distinct digest of counts and of the index."""

    def look_up(new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        keep, size = new["winner"].astype("Int64"), new["n"].to_numpy("int64").copy()
        member = np.zeros(len(new), bool)
        out = []
        if len(held):
            mph, slots = pickle.loads(held["hash"].iloc[0]), np.frombuffer(held["digests"].iloc[0], np.uint8).reshape(-1, 32)
            winners, n = (np.frombuffer(held[c].iloc[0], "<i8") for c in ("winners", "counts"))
            met = np.zeros(len(slots), np.int64)
            if len(new):
                rows = _bytes(new["digest"])
                at = mph.slots(_keys(rows))
                member = (at >= 0) & (slots[np.maximum(at, 0)] == rows).all(axis=1)
                keep = keep.mask(member, pd.Series(winners[np.maximum(at, 0)], dtype="Int64"))
                size[member] += n[at[member]]
                met[at[member]] = 1
            alone = met == 0
            out.append(pd.DataFrame({"digest": [x.tobytes() for x in slots[alone]], "keep_id": pd.array(winners[alone], "Int64"), "group_size": n[alone], "in_history": True}))
        out.append(pd.DataFrame({"digest": new["digest"], "keep_id": keep, "group_size": size, "in_history": member}))
        return pd.concat([x for x in out if len(x)] or out[-1:], ignore_index=True)

    keyed = counts.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return keyed.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(look_up, "digest binary, keep_id long, group_size long, in_history boolean")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """A row for each row of docs(doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    The older half of the documents by doc_id is the history that is indexed; the newer half is looked up in it.
    Null texts count as empty. Rows that tie on the smallest doc_id of a group all stay; rows without a doc_id stay only
    if no row of their group has one. An empty table gives no rows; other columns are not read.
    """
    text = normalised(F.col("text"))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
    n, middle = rows.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", 0.5, 1000)).first()
    shards = max(1, -(-n // SHARD_DIGESTS))
    old = F.coalesce(F.col("doc_id") <= F.lit(middle).cast("long"), F.lit(False))
    index = build_index(digest_counts(rows.where(old)), shards)
    found = resolve(digest_counts(rows.where(~old)), index, shards)
    joined = rows.join(found, "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of docs for each distinct normalised text, with its columns as they were: the one with the smallest doc_id.

    Null ids come after all others; of rows that share id and text any one stays."""
    kept = exact_dedup(docs).where("kept").select(id_key(F.col("doc_id")).alias("__q_id"), F.unhex("text_sha256").alias("__q_digest"))
    wanted = written(kept.groupBy("__q_id", "__q_digest").agg(F.count(F.lit(1)).alias("n")), "wanted", files_for(docs.sparkSession, docs.count()))
    return rows_of(docs, {"__q_id": id_key(F.col("doc_id")), "__q_digest": F.unhex(F.sha2(normalised(F.col("text")), 256))}, wanted)


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

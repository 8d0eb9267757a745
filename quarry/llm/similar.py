"""Texts whose five-word shingles have a Jaccard similarity of 0.8 or more: SimHash pairs, confirmed, and an exact join for
the rest.

Each set of shingles has a SimHash. Fingerprints that differ in few bits are paired by operator 5's tries, with a wider
budget, and each pair is confirmed by whole sets. No budget of 64 bits holds all similar pairs, so what is still apart goes
through an exact set-similarity join, and no link is lost.

Under any one order of all shingles, two sets that are that similar share one of their first fifths. So sets meet by the
shingles of their first fifth, frequent ones last in the order, and each candidate is confirmed by whole sets. A shingle
whose sets are all linked by then is passed over. Of a large group of copies, chains through each shingle's sets link most
first; only sets that are still apart are then compared by pairs. Which shingles are frequent decides the order, never the result.

Before whole sets are fetched, parities are compared: of each of FINGERPRINT buckets of hashes, whether the set has an
odd number. A shingle that only one of two sets has turns one bit, so the parities of two sets differ in no more bits than the sets
in shingles, and a pair beyond that budget is passed over without loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.shared import discard, files_for, lean, partitions, written
from quarry.llm.simhash import majority, near_pairs

SHINGLE = 5
#: Frequent shingles that are ordered by their counts, and shingles that are counted at once in a task.
FREQUENT, WINDOW = 1 << 18, 1 << 20
#: Orders in which chains link a shingle's sets.
CHAINS = 4
#: Bits of a set's fingerprint.
FINGERPRINT = 512
#: Sets whose repeats a task leaves out, at most; a repeat that it doesn't know is left out later.
KEPT = 1 << 20
#: A set under one of the shingles of its first fifth.
ROW = np.dtype([("key", "<i8"), ("set", "<i8"), ("size", "<i4"), ("place", "<i4")])
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) * ODD
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's runs of n words (operator 5's words); a shorter text is one run, a blank one too."""
    words = text.lower().split()
    of = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(of))
    out = np.zeros(max(1, len(of) - k + 1), np.uint64)
    for i in range(k):
        out = _mixed(out ^ of[i : i + len(out)], i + 1)
    return np.unique(out)


def identity(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """shared / (a + b - shared) >= 4 / 5, in whole numbers."""
    return 9 * shared >= 4 * (a + b)


def fingerprint(found: np.ndarray) -> bytes:
    """Which of the hashes' buckets have an odd number of the set's shingles."""
    odd = np.bincount((found >> np.uint64(64 - FINGERPRINT.bit_length() + 1)).astype(np.int64), minlength=FINGERPRINT) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def within(differ: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b that differ in so many shingles, at least, can be similar."""
    return 9 * differ <= a + b


def _bits(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, FINGERPRINT // 64)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, and about how many documents have each: the most frequent ones, repeated within a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1])], ["key", "n"])

        for batch in batches:
            for x in batch.column(0):
                held.append(shingles(x.as_buffer().to_pybytes()))
                size += len(held[-1])
                if size >= WINDOW:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    counted = _texts(docs).select("text").mapInArrow(lean(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 8")
    top = counted.orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas().sort_values("key")
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["n"].to_numpy(np.int64)[order]


def prefixes(docs: DataFrame) -> DataFrame:
    """(doc_id, set, text_hash, size, bits, fp, keys) of each row: the set's identity, its parities, its SimHash and the
    shingles of its first fifth, in order."""
    known, counts = frequent(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, bits, fps, keys = [], [], [], [], []
            for x in batch.column(1):
                found = shingles(x.as_buffer().to_pybytes())
                rank = np.zeros(len(found), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    rank = np.where(known[at] == found, counts[at], 0)
                first = len(found) - (4 * len(found) + 4) // 5 + 1
                ids.append(identity(found))
                sizes.append(len(found))
                bits.append(fingerprint(found))
                fps.append(majority(found))
                keys.append(found[np.lexsort((found, rank))[:first]].view(np.int64))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.array([], np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), batch.column(2), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists], ["doc_id", "set", "text_hash", "size", "bits", "fp", "keys"])

    return _texts(docs).withColumn("text_hash", text_hash(F.col("text"))).mapInArrow(lean(run), "doc_id long, set long, text_hash long, size int, bits binary, fp long, keys array<long>")


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows that are sorted by the first one, cut where it changes."""
    rest = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = now if rest is None else [np.r_[x, y] for x, y in zip(rest, now, strict=True)]
        at = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last key may go on in the next batch
        if at:
            yield [x[:at] for x in now]
        rest = [x[at:] for x in now]
    if rest is not None and len(rest[0]):
        yield rest


def _may(sizes: tuple[np.ndarray, np.ndarray], places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether sets whose first common shingle has these places can be similar."""
    (m, n), (i, j) = (tuple(np.asarray(x).astype(np.int64) for x in y) for y in (sizes, places))
    return similar(1 + np.minimum(m - 1 - i, n - 1 - j), m, n)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])


def packed(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, rows) of batches of (set, size, keys): the ROWs of many keys as one value, so few rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            fresh = [x not in known and not known.add(x) for x in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            known = known if len(known) < KEPT else set()
            set_, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            long = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            rows = np.zeros(int(long.sum()), ROW)
            rows["key"], rows["set"], rows["size"] = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.repeat(set_, long), np.repeat(size, long)
            rows["place"] = np.arange(len(rows)) - np.repeat(np.cumsum(long) - long, long)
            bucket = (_mixed(rows["key"].view(np.uint64)) >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            found, starts = np.unique(bucket[order], return_index=True)
            parts = [x.tobytes() for x in np.split(rows[order], starts[1:])] if len(found) else []
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(parts, pa.binary())], ["bucket", "rows"])

    return run


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, set, size, place) of the keys that more than one set has; all of a key's rows are in one partition."""
    parts = [np.frombuffer(x.as_buffer(), ROW) for batch in batches for x in batch.column(0)]
    rows = np.concatenate(parts) if parts else np.zeros(0, ROW)
    rows = rows[np.lexsort((rows["set"], rows["key"]))]
    same_key, same_set = (rows[c][1:] == rows[c][:-1] for c in ("key", "set"))
    first = np.r_[True, ~(same_key & same_set)][: len(rows)]  # of repeats of a set
    rows = rows[first]
    same_key = rows["key"][1:] == rows["key"][:-1]
    rows = rows[(np.r_[False, same_key] | np.r_[same_key, False])[: len(rows)]]
    for k in range(0, len(rows), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c][k : k + (1 << 16)])) for c in ROW.names], ROW.names)


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of different roots that follow each other among a key's sets in one of a few orders: (key, set, size,
    place, root) sorted by key."""
    for key, set_, size, place, root in _by_key(batches):
        for salt in range(CHAINS):
            order = np.lexsort((_mixed(set_.view(np.uint64), salt + 1), key))
            x, y = order[:-1], order[1:]
            keep = (key[x] == key[y]) & (root[x] != root[y])
            x, y = x[keep], y[keep]
            keep = _may((size[x], size[y]), (place[x], place[y]))
            yield _pairs(set_[x[keep]], set_[y[keep]])


def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, set, size, place, root), sorted by key, of the keys whose sets have different roots."""
    for columns in _by_key(batches):
        key, root = columns[0], columns[4]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        keep = np.repeat(many, np.diff(np.r_[starts, len(key)]))
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], ["key", "set", "size", "place", "root"])


def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All candidates among a key's sets that have different roots and whose fingerprints are near enough: (key, set, size,
    place, root, bits) sorted by key."""
    numbers = lambda batches, held: (held.append(_bits(b.column(5))) or b for b in batches)
    bits: list[np.ndarray] = []
    rest = np.zeros((0, FINGERPRINT // 64), np.uint64)
    for key, set_, size, place, root in _by_key(b.select(range(5)) for b in numbers(batches, bits)):
        rest, bits[:] = np.concatenate([rest, *bits]), []
        own, rest = rest[: len(key)], rest[len(key) :]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out, held = [], 0
        for lo, hi in zip(starts, np.r_[starts[1:], len(key)], strict=True):
            order = lo + np.argsort(size[lo:hi], kind="stable")
            s, p, r, i, f = size[order].astype(np.int64), place[order], root[order], set_[order], own[order]
            last = np.searchsorted(4 * s, 5 * s, side="right")
            for k in range(len(order) - 1):
                x = k + 1 + np.flatnonzero(r[k + 1 : last[k]] != r[k])
                x = x[_may((s[x], np.full(len(x), s[k])), (p[x], np.full(len(x), p[k])))]
                x = x[within(np.bitwise_count(f[x] ^ f[k]).sum(axis=1, dtype=np.int64), s[x], s[k])]
                if len(x):
                    out.append((np.full(len(x), i[k]), i[x]))
                    held += len(x)
                if held > 1 << 18:
                    yield _pairs(*map(np.concatenate, zip(*out, strict=True)))
                    out, held = [], 0
        if out:
            yield _pairs(*map(np.concatenate, zip(*out, strict=True)))


def simhash_pairs(classes: DataFrame, files: int) -> DataFrame:
    """(a, b) of sets whose SimHashes are the same or near: each with the least set of its SimHash, those by tries."""
    by_fp = written(classes.groupBy("fp").agg(F.min("set").alias("least")), "fingerprints", files)
    same = classes.join(by_fp, "fp").where("set != least").select(F.col("least").alias("a"), F.col("set").alias("b"))
    one, two = (by_fp.select(F.col("fp").alias(c), F.col("least").alias(f"of_{c}")) for c in "ab")
    near = near_pairs(by_fp.select("fp")).join(one, "a").join(two, "b")
    return same.union(near.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")))


def near_enough(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs(a, b) of sets that their parities let be similar."""
    one, two = (classes.select(F.col("set").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 4))
            differ = np.bitwise_count(_bits(batch.column(3)) ^ _bits(batch.column(5))).sum(axis=1, dtype=np.int64)
            keep = pa.array(within(differ, m, n))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "size_a", "bits_a", "size_b", "bits_b").mapInArrow(lean(test), "a long, b long")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs(a, b) of sets that are similar, by their whole texts."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(classes.select("set", "text_hash"), "set")
    texts = _texts(docs).select(text_hash(F.col("text")).alias("text_hash"), "text").join(wanted, "text_hash").dropDuplicates(["set"])
    one, two = (texts.select(F.col("set").alias(c), F.col("text").alias(f"of_{c}")) for c in "ab")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                m, n = (shingles(v.as_buffer().to_pybytes()) for v in (x, y))
                both = np.concatenate([m, n])
                both.sort()
                keep[i] = similar((both[1:] == both[:-1]).sum(), len(m), len(n))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b").mapInArrow(lean(test), "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, set, text_hash, root) of each row of docs(doc_id, text, ...): rows of a root are linked by similar texts.

    Null, empty and blank texts are one set. Repeated rows are each a row; other columns are not read.
    """
    rows = written(prefixes(docs), "prefixes")
    n, few = partitions(docs.sparkSession), files_for(docs.sparkSession, number := rows.count())
    classes = written(rows.groupBy("set").agg(F.min("text_hash").alias("text_hash"), *(F.any_value(c).alias(c) for c in ("size", "bits", "fp"))), "sets", few)
    keyed = rows.select("set", "size", "keys").mapInArrow(lean(packed(4 * n)), "bucket int, rows binary").repartition(n, "bucket")
    shared = written(keyed.select("rows").mapInArrow(lean(met), "key long, set long, size int, place int"), "shared", few)
    of = written(rows.select("doc_id", "set", "text_hash"), "sets", few)
    discard(rows)

    def split(shared: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows of the keys whose sets the roots leave apart."""
        rooted = shared.join(roots, shared["set"] == roots["node"], "left").select("key", "set", "size", "place", F.coalesce("root", "set").alias("root"))
        return written(rooted.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(divided), "key long, set long, size int, place int, root long"), "divided", few)

    def joined(roots: DataFrame, pairs: DataFrame) -> DataFrame:
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(confirmed(pairs, classes, docs)), number)

    near = written(near_enough(simhash_pairs(classes, few), classes), "pairs", few)
    roots = components(confirmed(near, classes, docs), number)
    unlike = split(shared, roots)
    chains = unlike.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(chained), "a long, b long").distinct()
    chains = written(near_enough(chains.join(near, ["a", "b"], "left_anti"), classes), "pairs", few)
    roots = joined(roots, chains)
    known = split(unlike.drop("root"), roots).join(classes.select("set", "bits"), "set").select("key", "set", "size", "place", "root", "bits")
    rest = known.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(apart), "a long, b long").distinct()
    rest = written(rest.join(near.union(chains), ["a", "b"], "left_anti"), "pairs", few)
    roots = joined(roots, rest)
    return of.join(roots, of["set"] == roots["node"], "left").select("doc_id", "set", "text_hash", F.coalesce("root", "set").alias("root"))

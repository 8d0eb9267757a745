"""Near-duplicates by SimHash fingerprints that differ in few bits: a self-join of a binary trie.

Distinct fingerprints meet by blocks of equal bits. Of three blocks of a fingerprint, at least one is free of two
differing bits; the same holds for the three parts of what is left, and once more for theirs. So each pair within the
budget shares one of 27 keys of 45 bits or more, and a key's group, whatever the data, has at most 2^19 fingerprints. In a
group the fingerprints are a binary trie: pairs of nodes are traversed together, the bits in which they differ add up, and
a pair is pruned once it exceeds the budget.

Operator 5 links at two bits. The pipeline's stage takes the same steps with a wider budget, and then confirms its pairs.
There keys are three whole bytes, so groups are small: within five bits each pair of fingerprints shares one, beyond them
a part of the pairs do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.shared import files_for, id_key, lean, partitions, rows_of, written

SHINGLE, SEED, BUDGET = 3, 42, 2
#: The pipeline's stage: bits in which a candidate's fingerprints differ at most, and bytes of them that are equal at least.
WIDE, BYTES = 10, 3
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Node pairs that are expanded at once.
PAIRS = 1 << 18


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 values; no word gives zero."""
    words = text.lower().split()
    if not words:
        return 0
    parts = [words[k:] for k in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*parts, strict=False)), repeat(SEED)), np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    text = F.col("text").cast("string").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(lean(run), "doc_id long, fp long")


def _blocks(bits: list[int]) -> list[list[int]]:
    third = -(-len(bits) // 3)
    return [bits[:third], bits[third : 2 * third], bits[2 * third :]]


def key_masks(levels: int = 3) -> np.ndarray:
    """The 3^levels sets of bits of which any two fingerprints within two bits share one."""

    def below(bits: list[int], level: int) -> list[list[int]]:
        if not level:
            return [[]]
        blocks = _blocks(bits)
        return [b + deeper for b in blocks for deeper in below([x for x in bits if x not in set(b)], level - 1)]

    return np.array([sum(1 << b for b in chosen) for chosen in below(list(range(64)), levels)], np.uint64)


def byte_masks(equal: int = BYTES) -> np.ndarray:
    """The sets of so many whole bytes: any two fingerprints within 8 - equal bits share one."""
    return np.array([sum(0xFF << 8 * i for i in chosen) for chosen in combinations(range(8), equal)], np.uint64)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _trie(fps: np.ndarray, group: np.ndarray, budget: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of fingerprints that are sorted by (group, fp): the first one that each is linked to, directly or not, and the pairs
    within the budget by which they were found, a forest."""
    root, owner = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def find(i: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := root[i], i):
            root[i] = root[up]
            i = root[up]
        return i

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = find(a), find(b)
            open_ = x != y
            a, b, x, y = a[open_], b[open_], np.maximum(x[open_], y[open_]), np.minimum(x[open_], y[open_])
            owner[x] = np.arange(len(x))
            held = owner[x] == np.arange(len(x))  # of links that share an end one holds; the others are tried again
            root[x[held]] = y[held]
            pairs.append((a[held], b[held]))
            a, b = a[~held], b[~held]

    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(fps) else np.array([], np.int64)
    ends = np.r_[starts[1:], len(fps)]
    many = ends - starts > 1
    s, e = starts[many], ends[many]
    bits = {}

    def split(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """Where in each node's range its ones begin."""
        if bit not in bits:
            bits[bit] = np.r_[0, np.cumsum((fps >> np.uint64(bit)) & np.uint64(1) == 0)]
        return lo + bits[bit][hi] - bits[bit][lo]

    # a stack of frontiers: node pairs (lo1, hi1, lo2, hi2), bits that differ so far, next bit
    stack = [(s[k : k + PAIRS], e[k : k + PAIRS], s[k : k + PAIRS], e[k : k + PAIRS], np.zeros(len(s[k : k + PAIRS]), np.int64), 63) for k in range(0, len(s), PAIRS)]
    while stack:
        l1, h1, l2, h2, d, bit = stack.pop()
        if 8 * len(l1) > len(fps):  # node pairs whose fingerprints are all linked by now are done
            top = find(np.arange(len(fps)))
            turns = np.r_[0, np.cumsum(top[1:] != top[:-1])]
            apart = (turns[h1 - 1] != turns[l1]) | (turns[h2 - 1] != turns[l2]) | (top[l1] != top[l2])
            l1, h1, l2, h2, d = (x[apart] for x in (l1, h1, l2, h2, d))
        one = (h1 - l1 == 1) & (h2 - l2 == 1)
        if one.any():  # two leaves: the rest of their bits at once
            a, b = l1[one], l2[one]
            near = _popcount(fps[a] ^ fps[b]) <= budget
            join(a[near], b[near])
            l1, h1, l2, h2, d = (x[~one] for x in (l1, h1, l2, h2, d))
        if bit < 0 or bit + 1 <= budget:
            near = d + bit + 1 <= budget  # whatever follows, all below both nodes is within the budget
            for a, b, c, x in zip(l1[near], h1[near], l2[near], h2[near], strict=True):
                join(np.r_[a + 1 : b, c + 1 : x, c], np.r_[np.full(b - a - 1, a), np.full(x - c - 1, c), a])
            l1, h1, l2, h2, d = (x[~near] for x in (l1, h1, l2, h2, d))
        if bit < 0 or not len(l1):
            continue
        m1, m2, self_ = split(l1, h1, bit), split(l2, h2, bit), (l1 == l2) & (h1 == h2)
        next_ = [
            (l1, m1, l2, m2, d), (m1, h1, m2, h2, d), (l1, m1, m2, h2, d + 1),
            *[tuple(x[~self_] for x in (m1, h1, l2, m2, d + 1))],
        ]
        l1, h1, l2, h2, d = (np.concatenate(x) for x in zip(*next_, strict=True))
        keep = (h1 > l1) & (h2 > l2) & (d <= budget) & ~((l1 == l2) & (h1 - l1 == 1))
        l1, h1, l2, h2, d = (x[keep] for x in (l1, h1, l2, h2, d))
        stack += [(l1[k : k + PAIRS], h1[k : k + PAIRS], l2[k : k + PAIRS], h2[k : k + PAIRS], d[k : k + PAIRS], bit - 1) for k in range(0, len(l1), PAIRS)]
    return find(np.arange(len(fps))), pairs


def trie_links(fps: np.ndarray, group: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest that joins all fingerprints of a group that are linked in it; rows are sorted by (group, fp)."""
    top, _ = _trie(fps, group, budget)
    linked = np.flatnonzero(top != np.arange(len(fps)))
    return linked, top[linked]


def trie_pairs(fps: np.ndarray, group: np.ndarray, budget: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """The same forest by links that are themselves within the budget."""
    _, pairs = _trie(fps, group, budget)
    a, b = (np.concatenate([np.array([], np.int64), *x]) for x in (zip(*pairs, strict=True) if pairs else ([], [])))
    return np.maximum(a, b), np.minimum(a, b)


def _met(distinct: DataFrame, masks: np.ndarray, trie: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b): what the trie links of distinct fingerprints (column fp) that share a mask's bits."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, mask in enumerate(masks):
                with np.errstate(over="ignore"):
                    key = ((fps & mask) ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
                yield pa.RecordBatch.from_arrays([pa.array((key ^ (key >> np.uint64(32))).view(np.int64)), batch.column(0)], ["key", "fp"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.array([], np.int64), np.array([], np.uint64)

        def done(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((f, k))
            k, f = k[order], f[order]
            a, b = trie(f, k)
            return pa.RecordBatch.from_arrays([pa.array(f[a].view(np.int64)), pa.array(f[b].view(np.int64))], ["a", "b"])

        for batch in batches:
            k = np.r_[rest_k, batch.column(0).to_numpy(zero_copy_only=False)]
            f = np.r_[rest_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            at = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on in the next batch
            if at:
                yield done(k[:at], f[:at])
            rest_k, rest_f = k[at:], f[at:]
        if len(rest_k):
            yield done(rest_k, rest_f)

    n = partitions(distinct.sparkSession)
    met = distinct.mapInArrow(lean(keyed), "key long, fp long").repartition(n, "key").sortWithinPartitions("key")
    return met.mapInArrow(lean(links), "a long, b long").distinct()


def near_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect exactly what is within the budget."""
    return _met(distinct, key_masks(), trie_links)


def near_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column fp) within WIDE bits, a forest of those that share BYTES bytes."""
    return _met(distinct, byte_masks(), trie_pairs)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """A row for each row of docs(doc_id, text, ...): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over fingerprints that differ in BUDGET bits or fewer; null if no
    document there has an id. Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows are
    each a row; an empty table gives none; other columns are not read.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    n = rows.count()
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes", files_for(docs.sparkSession, n))
    roots = components(near_links(classes.select("fp")), n)
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of similar texts, with its columns as they were: the one with the smallest doc_id.

    Null ids come after all others; rows that share the id go by their text's hash, and of wholly repeated ones any stays.
    """
    from quarry.llm import similar  # which stands on this module

    few = files_for(docs.sparkSession, docs.count())
    rows = similar.groups(docs).groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("x"))
    wanted = written(first.select(id_key(F.col("x.doc_id")).alias("__q_id"), F.col("x.text_hash").alias("__q_text"), F.col("x.n").alias("n")), "wanted", few)
    return rows_of(docs, {"__q_id": id_key(F.col("doc_id")), "__q_text": similar.text_hash(F.col("text"))}, wanted)

"""Removal of passages that an earlier document has: recurring phrases, found everywhere by Aho-Corasick automata.

A window is WINDOW consecutive words. Anchors tell where windows can recur: a window's anchor is the least hash of its
runs of PHRASE words, so equal windows have equal anchors, and a document has a few anchors for each hundred words. Texts
without an anchor that is in several documents are done where they are read; the others go on, compressed. Only windows
whose anchor is in several documents are hashed and grouped; a window that is in several documents belongs to the
one with the smallest doc_id. Runs of such windows are confirmed as passages, with their words, and go to the shards of
documents that may hold them. Each shard compiles its passages' phrases into an automaton over words, streams all its
documents through it, and grows each occurrence, word by word, as far as document and passage agree. Hashes only choose
what is looked at; what is removed has been compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import discard, partitions, written

WINDOW = 50
#: Documents of a shard; those that hold no recurring anchor are done before their shard is looked at.
SHARD_DOCS = 2000
#: Windows that are held before they are handed on.
HELD = 2_000_000
#: Distinct words whose hashes a task keeps.
KEPT = 300_000
#: Marks for the documents that have a recurring anchor, at most: 8 MB. More documents share marks, and go on for nothing.
MARKS = 1 << 26
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def phrase_words(window: int) -> int:
    """Of the phrases of this many words, one at every phrase_words + 1 words, each window has one whole."""
    return window // 2


class WordHashes(dict):
    """A 64-bit hash for each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)], dtype=np.uint64)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, whatever stands around it."""
    with np.errstate(over="ignore"):
        n = len(hashes)
        sums = np.r_[np.uint64(0), np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)]
        x = (sums[k:] - sums[:-k]) * _powers(_INVERSE, n - k + 1)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window."""
    k = phrase_words(window)
    x, span, want = runs(hashes, k), 1, window - k + 1
    while span < want:  # minima of ever longer spans
        step = min(span, want - span)
        x, span = np.minimum(x[:-step], x[step:]), span + step
    return x


def _words(x) -> list[bytes]:
    return x.as_buffer().to_pybytes().split() if x.is_valid else []


def packed(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(text, asbytes=True)


def unpacked(text: bytes) -> bytes:
    return pa.decompress(text[8:], int.from_bytes(text[:8], "little"), codec="zstd", asbytes=True)


def _binary_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def document_anchors(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found, of = [], []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(x)
                if doc is not None and len(words) >= window:
                    found.append(np.unique(anchors(hashes.of(words), window)))
                    of.append(np.full(len(found[-1]), doc, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(of))], ["anchor", "doc_id"])

    return _binary_text(docs).mapInArrow(run, "anchor long, doc_id long")


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def shard_of(shards: int, doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).alias("shard")


def marked(hits: DataFrame, size: int) -> np.ndarray:
    """A byte for each eight marks: those of the documents of hits are set."""
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(size)) + 1
    parts = hits.groupBy(F.bitmap_bucket_number(mark).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mark)).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for part, bits in parts.collect():
        at = (part - 1) * len(bits)
        out[at : at + len(bits)] = np.frombuffer(bits, np.uint8)[: len(out) - at]
    return out


def split_documents(docs: DataFrame, hits: DataFrame, shards: int, texts: bool) -> DataFrame:
    """Documents without a recurring anchor, done; the others with their packed text, and few that share their marks."""
    size = min(MARKS, 1 << (16 * shards * SHARD_DOCS).bit_length())
    marks = docs.sparkSession.sparkContext.broadcast(marked(hits, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, text, kept = [], [], [], []
            mark = batch.column(2).to_numpy()
            open_ = (marks.value[mark >> 3] >> (mark & 7).astype(np.uint8) & 1 > 0) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for x, o in zip(batch.column(1), open_.tolist(), strict=True):
                words = _words(x)
                n.append(len(words))
                sha.append(None if o else _sha(words))
                text.append(packed(x.as_buffer().to_pybytes() if x.is_valid else b"") if o else None)
                kept.append(b" ".join(words).decode() if texts and not o else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary()), pa.array(kept, pa.string())], ["doc_id", "n_words", "kept_sha256", "text", "kept_text"])

    read = _binary_text(docs).withColumn("mark", F.pmod(F.xxhash64("doc_id"), F.lit(size)))
    return read.mapInArrow(run, "doc_id long, n_words long, kept_sha256 string, text binary, kept_text string")


def candidate_windows(candidates: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """(hash, least, most): windows with a recurring anchor, with the smallest and largest id of a shard that has them; most
    is null where they are the same.

    Shards are dealt whole, so a window that all documents hold is about one row for each shard. A document's anchors come
    before its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found, of, at, held = WordHashes(), [], [], None, 0
        doc, own, ahead = None, np.array([], np.uint64), []

        def counted() -> pa.RecordBatch:
            x, ids = np.concatenate(found), np.concatenate(of)
            order = np.lexsort((ids, x))
            x, ids = x[order], ids[order]
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.array([], np.int64)
            last = np.r_[first[1:] - 1, len(x) - 1] if len(first) else first
            return pa.RecordBatch.from_arrays([pa.array(x[first].view(np.int64)), pa.array(ids[first]), pa.array(ids[last], mask=ids[first] == ids[last])], ["hash", "least", "most"])

        for batch in batches:
            ids, shard, text = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            anchor, begin = batch.column(2).fill_null(0).to_numpy().view(np.uint64), 0
            for i in np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False)).tolist():
                new = np.concatenate([*ahead, anchor[begin:i]])
                begin, ahead = i + 1, []
                if len(new) or ids[i] != doc:  # else another row with the same id
                    doc, own = ids[i], new
                if not len(own):
                    continue
                if found and (shard[i] != at or held > HELD):
                    yield counted()
                    found, of, held = [], [], 0
                h, at = hashes.of(unpacked(text[i].as_py()).split()), shard[i]
                if len(h) >= window:
                    met = np.isin(anchors(h, window), own)
                    found.append(np.unique(runs(h, window)[met]))
                    of.append(np.full(len(found[-1]), doc, np.int64))
                    held += len(found[-1])
            ahead.append(anchor[begin:])
        if found:
            yield counted()

    none = F.lit(None)
    rows = hits.select("doc_id", "shard", "anchor", none.cast("binary").alias("text")).unionByName(candidates.select("doc_id", "shard", none.cast("long").alias("anchor"), "text"))
    dealt = rows.repartition(partitions(candidates.sparkSession), "shard").sortWithinPartitions("shard", "doc_id", F.col("text").isNotNull())
    return dealt.mapInArrow(run, "hash long, least long, most long")


def passages(owned: DataFrame, window: int) -> DataFrame:
    """(shard, owner, words): the runs of windows that belong to a document and that a shard may hold, with their words.

    owned: owner, packed text, and wanted: the windows by shard, as the upper halves of their hashes. If another window of the
    owner has such a half too, its words are here for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for owner, x, shard, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = unpacked(x.as_py()).split()
                at = np.flatnonzero(np.isin(runs(hashes.of(words), window) >> np.uint64(32), wanted.values.to_numpy().view(np.uint32)))
                cuts = np.flatnonzero(np.diff(at) > 1) + 1
                out += [(shard, owner, b" ".join(words[part[0] : part[-1] + window])) for part in np.split(at, cuts) if len(part)]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "owner", "words"])

    return owned.select("owner", "text", "shard", "wanted").mapInArrow(run, "shard long, owner long, words binary")


class Automaton:
    """The phrases of a shard's passages over numbered words."""

    def __init__(self, owners: list[int], texts: list[bytes], window: int):
        import ahocorasick

        self.window, self.k, self.numbers = window, phrase_words(window), {}
        self.passages, where = [], {}
        for owner, text in dict.fromkeys(zip(owners, texts, strict=True)):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.split()]
            self.passages.append((owner, np.array(ids)))
            for a in range(0, len(ids) - self.k + 1, self.k + 1):
                where.setdefault(tuple(ids[a : a + self.k]), []).append((len(self.passages) - 1, a))
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, places in where.items():
            self.found.add_word(phrase, places)
        self.any = bool(where)
        self.found.make_automaton()

    def covered(self, doc_id: int, words: list[bytes]) -> np.ndarray:
        """Which words are in a window that an earlier document has."""
        out = np.zeros(len(words) + 1, np.int64)
        if not self.any or len(words) < self.window:
            return out[:-1] > 0
        ids = [self.numbers.get(w, 0) for w in words]
        text, seen = np.array(ids), {}
        for end, places in self.found.iter(tuple(ids)):
            at = end - self.k + 1
            for p, a in places:
                owner, passage = self.passages[p]
                shift = at - a  # where the passage would start
                if owner >= doc_id or seen.get((p, shift), -1) >= at + self.k:
                    continue
                lo, hi = max(0, shift), min(len(text), shift + len(passage))
                off = np.flatnonzero(text[lo:hi] != passage[lo - shift : hi - shift]) + lo
                right = int(np.searchsorted(off, at))
                start = int(off[right - 1]) + 1 if right else lo
                stop = int(off[right]) if right < len(off) else hi
                seen[p, shift] = stop
                if stop - start >= self.window:
                    out[start] += 1
                    out[stop] -= 1
        return np.cumsum(out[:-1]) > 0


def scrubbed(candidates: DataFrame, found: DataFrame, window: int, texts: bool) -> DataFrame:
    """RESULT for each candidate, in shards; with kept_text if asked."""

    def shard(docs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        automaton, out = Automaton(held["owner"].tolist(), held["words"].tolist(), window), []
        for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
            words = unpacked(text).split()
            gone = automaton.covered(doc, words)
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
            out.append((doc, len(words), int(gone.sum()), _sha(kept)) + ((b" ".join(kept).decode(),) if texts else ()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts])

    by = candidates.select("doc_id", "text", "shard").groupBy("shard")
    return by.cogroup(found.groupBy("shard")).applyInPandas(shard, RESULT + ", kept_text string" * texts)


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """A row for each row of docs(doc_id, text, ...): doc_id, n_words, n_removed, kept_sha256, and kept_text if asked.

    Each word is removed that is in a window whose words also start in a document with a smaller doc_id; windows are those
    of the input. A null text has no words. A document without an id has no place in the order: it keeps all its words and
    takes none from others. Rows that share a doc_id take nothing from each other. An empty table gives no rows; other
    columns are not read.
    """
    n = partitions(docs.sparkSession)
    shards = max(1, -(-docs.select("doc_id").count() // SHARD_DOCS))
    met = written(document_anchors(docs, window), "anchors")
    # a table of its own: both sides of the join are dealt anew, and an anchor of very many documents is split
    recurring = written(met.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "recurring")
    hits = written(met.join(recurring, "anchor").select("doc_id", shard_of(shards), "anchor"), "hits")
    discard(met)
    discard(recurring)
    split = written(split_documents(docs, hits, shards, texts), "split")
    done = split.where(F.col("text").isNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", *["kept_text"] * texts)
    candidates = split.where(F.col("text").isNotNull()).withColumn("shard", shard_of(shards))
    # both groupings stand on one exchange by the window
    windows = candidate_windows(candidates, hits, window).repartition(n, "hash").select("hash", shard_of(shards, "least"), "least", F.coalesce("most", "least").alias("most"))
    seen = windows.groupBy("hash", "shard").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    routes = seen.withColumn("owner", F.min("least").over(W.partitionBy("hash"))).where("most > owner")
    wanted = routes.groupBy("owner", "shard").agg(F.collect_list(F.shiftright("hash", 32).cast("int")).alias("wanted"))
    owners = candidates.select(F.col("doc_id").alias("owner"), "text")
    found = passages(wanted.join(owners, "owner"), window)
    return done.unionByName(scrubbed(candidates, found, window, texts))

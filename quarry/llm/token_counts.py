"""Token counts without token ids: pieces are counted once for each distinct pre-token.

Documents are read in blocks. A block's pre-token frequencies leave it as one row for each distinct pre-token, with the
documents (by their place in the block) and counts packed in one value; pre-tokens that are a vocabulary piece by
themselves are counted on the spot, as the vocabulary has a fixed size. Rows meet by pre-token, its pieces are counted
once, and the sums go back to the blocks, packed again. A pre-token that all documents hold is one row for each block, and
where it is in many documents of a block, the row goes to a task by pre-token and block: such a pre-token is counted once in
each of these tasks, and in none of them meets all its rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import partitions
from quarry.llm.vocabulary import default_path, pre_tokens, special_ids, tokenizer

#: A block ends with the Arrow batch in which its text passes this many bytes.
BLOCK_BYTES = 24 << 20
#: Sums that a task holds before it hands them on.
HELD = 4_000_000
#: Bytes of a row's documents and counts from which it is dealt by its block too.
HOT_BYTES = 512
ROWS = "key binary, block long, payload binary"
ENTRY = np.dtype([("doc", "<u4"), ("n", "<u4")])


@functools.lru_cache(2)
def single_pieces(path: str) -> dict[str, int]:
    """Pre-tokens that are one piece each, numbered; a table as large as the vocabulary at most."""
    t = tokenizer(path)
    own = [t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())]
    counted = t.encode_batch_fast(own, add_special_tokens=False)
    alone = [w for w, e in zip(own, counted, strict=True) if len(e.ids) == 1 and "�" not in w and pre_tokens(w, path) == [w]]
    return {w: k for k, w in enumerate(dict.fromkeys([*alone, *special_ids(path)]))}


class _Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _packed_rows(place: int, docs: list, sizes: list[int], tokens: list[np.ndarray], names: list[str], known: int) -> Iterator[pa.RecordBatch]:
    """The block's header (ids, bytes, counts so far), then a row for each other pre-token."""
    doc = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    token = np.concatenate(tokens) if tokens else np.array([], np.int64)
    base = np.bincount(doc[token < known], minlength=len(tokens)).astype("<i8")
    ids = np.array([0 if x is None else x for x in docs], "<i8")
    header = np.concatenate([ids, np.array([x is None for x in docs], "<i8"), np.array(sizes, "<i8"), base]).tobytes()
    block = xxhash.xxh64_intdigest(header, seed=place) >> 1  # a block that is made again of other rows is another one
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([block], pa.int64()), pa.array([header], pa.binary())], ["key", "block", "payload"])
    other = token >= known
    pair, n = np.unique((token[other] - known) * len(tokens) + doc[other], return_counts=True)
    entries = np.empty(len(pair), ENTRY)
    entries["doc"], entries["n"] = pair % max(1, len(tokens)), n
    at = np.searchsorted(pair, np.arange(len(names) + 1) * len(tokens))
    for k in range(0, len(names), 20_000):
        part = at[k : k + 20_001]
        offsets = ((part - part[0]) * ENTRY.itemsize).astype("<i4")
        payload = pa.BinaryArray.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries[part[0] : part[-1]].tobytes())])
        keys = pa.array([x.encode("utf-8", "surrogatepass") for x in names[k : k + 20_000]], pa.binary())
        yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(keys), block)), payload], ["key", "block", "payload"])


def frequencies(docs: DataFrame, path: str) -> DataFrame:
    """ROWS: a header for each block, and its pre-token frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        known = single_pieces(path)
        ids, sizes, tokens, held, names = [], [], [], 0, _Numbered(known)
        for batch in batches:
            ids += batch.column(0).to_pylist()
            for x in batch.column(1):
                text = x.as_py() or ""
                sizes.append(len(text.encode()))
                held += sizes[-1]
                tokens.append(np.fromiter(map(names.__getitem__, pre_tokens(text, path)), np.int64))
            if held >= BLOCK_BYTES:
                yield from _packed_rows((task << 32) + made, ids, sizes, tokens, list(names)[len(known) :], len(known))
                ids, sizes, tokens, held, names, made = [], [], [], 0, _Numbered(known), made + 1
        if ids:
            yield from _packed_rows((task << 32) + made, ids, sizes, tokens, list(names)[len(known) :], len(known))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROWS)


def piece_sums(rows: DataFrame, path: str) -> DataFrame:
    """(block, payload): headers as they came (a leading zero byte), and packed sums by document (a leading one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, last, held, sums = tokenizer(path), (None, 0), 0, {}

        def out(blocks: list[int], payloads: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(payloads, pa.binary())], ["block", "payload"])

        def summed() -> Iterator[pa.RecordBatch]:
            for block, parts in sums.items():
                entry = np.concatenate(parts)
                doc, where = np.unique(entry["doc"], return_inverse=True)
                total = np.empty(len(doc), ENTRY)
                total["doc"], total["n"] = doc, np.bincount(where, weights=entry["n"], minlength=len(doc))
                yield out([block], [b"\1" + total.tobytes()])

        for batch in batches:
            keys, blocks, payload = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            heads = np.flatnonzero(keys.is_null().to_numpy(zero_copy_only=False))
            if len(heads):
                yield out(blocks[heads].tolist(), [b"\0" + payload[int(i)].as_py() for i in heads])
            rest = np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False))
            if not len(rest):
                continue
            coded = keys.take(pa.array(rest)).dictionary_encode()
            names = coded.dictionary.to_pylist()
            new = [x for x in names if x != last[0]]
            counts = dict(zip(new, (len(e.ids) for e in t.encode_batch_fast([x.decode("utf-8", "surrogatepass") for x in new], add_special_tokens=False)), strict=True)) | ({last[0]: last[1]} if last[0] in names else {})
            per_row = np.array([counts[x] for x in names])[coded.indices.to_numpy()]
            last = (names[-1], counts[names[-1]])  # the key may go on in the next batch
            data = payload.take(pa.array(rest))
            lengths = np.array([len(x) for x in data.to_pylist()]) // ENTRY.itemsize
            entries = np.frombuffer(b"".join(data.to_pylist()), ENTRY).copy()
            entries["n"] *= np.repeat(per_row, lengths).astype("<u4")
            of = np.repeat(blocks[rest], lengths)
            order = np.argsort(of, kind="stable")
            of, entries = of[order], entries[order]
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for a, b in zip(cuts, [*cuts[1:], len(of)], strict=True):
                sums.setdefault(int(of[a]), []).append(entries[a:b])
            held += len(entries)
            if held >= HELD:
                yield from summed()
                sums, held = {}, 0
        yield from summed()

    n = partitions(rows.sparkSession)
    # headers have no key: they are dealt by their block
    dealt = rows.repartition(n, F.coalesce("key", F.lit(b"")), F.when(F.col("key").isNull() | (F.octet_length("payload") >= HOT_BYTES), F.col("block"))).sortWithinPartitions("key")
    return dealt.select("key", "block", "payload").mapInArrow(run, "block long, payload binary")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """A row for each row of docs(doc_id, text, ...): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the whole text under the JSON vocabulary at path, without added begin or end; special strings
    inside texts count as the library takes them by default. A null text counts as empty; repeated rows and null ids are
    rows like any other; an empty table gives none; other columns are not read.
    """
    path = path or default_path()
    sums = piece_sums(frequencies(docs, path), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, header, totals = None, None, None

        def done() -> pa.RecordBatch:
            ids, empty, sizes, base = header
            n = base + (totals if totals is not None else 0)
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=empty == 1), pa.array(sizes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                payload = x.as_py()
                if b != block:
                    if header is not None:
                        yield done()
                    block, header, totals = b, None, None
                if payload[:1] == b"\0":
                    header = np.frombuffer(payload[1:], "<i8").reshape(4, -1)
                    totals = np.zeros(header.shape[1], np.int64)
                elif header is None:
                    raise RuntimeError("rows of a block changed while it was computed again; write the input to a table first")
                else:
                    entry = np.frombuffer(payload[1:], ENTRY)
                    totals[entry["doc"]] += entry["n"]
        if header is not None:
            yield done()

    n = partitions(docs.sparkSession)
    dealt = sums.repartition(n, "block").sortWithinPartitions("block", F.substring("payload", 1, 1))
    return dealt.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

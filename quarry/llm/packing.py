"""Best-fit packing by the sum-of-squares rule.

A document's ids are cut, from its end, into pieces of at most `capacity` tokens. Pieces go into groups of bounded size by
a hash, and each group is packed on its own: a piece goes where the sum, over residual gaps, of the squared number of open
bins with that gap becomes smallest. The rule needs only the counts of open bins by gap, so a placement costs as many
steps as there are gaps, however many bins are open.

A new bin is one of the places that the rule weighs. As pieces come large ones first, it can pay to weigh it only when no
open bin has room; a group is packed both ways, and the one with fewer bins stands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import lean, partitions, written
from quarry.llm.vocabulary import default_path, encoded

CAPACITY = 1024
END_ID = 2
#: Pieces that are packed together; a group wastes part of a few bins.
GROUP_PIECES = 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids: the first piece takes what whole ones leave."""
    first = len(ids) % capacity or min(len(ids), capacity)
    ends = range(first, len(ids) + 1, capacity)
    return [(k, max(0, e - capacity) if k else 0, capacity if k else first, zlib.crc32(ids[max(0, e - capacity) if k else 0 : e].tobytes())) for k, e in enumerate(ends)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1), strict=True):
                tokens = np.array([*encoded(text.as_py() or "", path), END_ID], "<u4")
                rows += [(doc, *x) for x in cut(tokens, capacity)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(lean(run), PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int, open_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed in the order given; lengths are 1 to capacity. Of places that are as good the
    smallest gap is taken, an open bin's before a new one's. With open_first a new bin waits until no open one has room."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        gap = capacity  # a new bin's
        if s < capacity:
            was = count[s:capacity]  # gaps s, s + 1, ...
            change = 2 * (count[: capacity - s] - was + 1)
            if len(change):
                change[0] = 1 - 2 * was[0]  # a bin that is filled is no longer open
                change[was == 0] = 1 << 60
                k = int(change.argmin())
                if was[k] and (open_first or change[k] <= 2 * count[capacity - s] + 1):
                    gap = s + k
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if left := gap - s:
            open_[left].append(b)
            count[left] += 1
    return bins, offsets


def fewest(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """sum_of_squares() with a new bin weighed always or last, whichever takes fewer bins."""
    return min((sum_of_squares(lengths, capacity, first) for first in (False, True)), key=lambda x: int(x[0].max(initial=-1)))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row for each piece of docs(doc_id, text, ...): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are packed each on their own; a null doc_id stays null. An
    empty table gives no rows; other columns are not read.
    """
    all_pieces = written(pieces(docs, path or default_path(), capacity), "pieces")
    n = all_pieces.where(F.col("length") < capacity).count()
    groups = max(1, -(-n // group_pieces))
    full = all_pieces.where(F.col("length") == capacity)
    width = 1 << 33

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        # large ones first, in an order that does not depend on how the rows arrive
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = fewest(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"], pdf["offset"] = -1 - (pdf["__q_group"].to_numpy() * width + bins), offsets
        return pdf.drop(columns="__q_group")

    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    partial = all_pieces.where(F.col("length") < capacity).withColumn("__q_group", F.pmod(key, F.lit(groups)))
    placed = partial.groupBy("__q_group").applyInPandas(place, f"{PIECES}, sequence_id long, offset long")
    # whole sequences are of one piece each: partition and position number them, from 0 up
    alone = full.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(alone)

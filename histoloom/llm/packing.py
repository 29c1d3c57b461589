"""Bounded-space online packing of tokenised documents into fixed-length training sequences.

Each partition keeps a fixed number of open windows. A document's full-length stretches leave as whole sequences at once;
its remainder goes to the open window with the least room that still fits. When none fits, the fullest window is emitted
and a new one opened. The windows still open at the end of the partitions are merged by the same rule.

Defined cases: null text is empty (one end id); null doc_ids are carried as null; repeated rows are packed as often as they
occur; texts of any length are encoded whole, a text larger than a batch by itself; of windows with equal room the one
opened first is taken; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoloom.llm.tokens import binary_column, encoded
from histoloom.session import stage
from histoloom.llm.workers import tidied

#: Pieces, and for each window left open a row without a document: its fill stands in `length`.
PLACED = "doc_id long, start long, length long, doc_tokens long, window_id long, offset long, left_open boolean, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("window_id", pa.int64()), ("offset", pa.int64()), ("left_open", pa.bool_()), ("ids", pa.binary())])
#: Leftover windows that one task merges.
MERGED_AT_ONCE = 4096
#: Leftover windows (24 bytes each) up to which their new places are broadcast to the pieces; beyond it the join shuffles.
BROADCAST_WINDOWS = 500_000


class OpenWindows:
    """At most `most` windows with room, best fit first."""

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self._next = capacity, most, first_id
        self._room: list[tuple[int, int]] = []

    def fresh(self) -> int:
        """The id of a new window."""
        self._next += 1
        return self._next - 1

    def place(self, length: int, window: int | None = None) -> tuple[int, int]:
        """(window, offset in it) of a stretch; `window` is the id to take if it opens one."""
        at = bisect.bisect_left(self._room, (length, -1))
        if at < len(self._room):
            room, window = self._room.pop(at)
        else:
            if len(self._room) >= self.most:
                self._room.pop(0)  # the fullest is emitted as it is
            room, window = self.capacity, self.fresh() if window is None else window
        if room > length:
            bisect.insort(self._room, (room - length, window))
        return window, self.capacity - room

    def left(self) -> list[tuple[int, int]]:
        """(window, fill) of those still open."""
        return [(window, self.capacity - room) for room, window in self._room]


def place_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, windows: int = 128, frugal: bool = False) -> DataFrame:
    """One row for each piece of a document: its ids (little-endian unsigned 32-bit) and its place in a window (PLACED). frugal: half the memory in workers for some more time."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = OpenWindows(capacity, windows, TaskContext.get().partitionId() << 33)
        for batch, ids, counts in encoded(batches, tokenizer, end_id, frugal=frugal):
            doc, start, length, window, offset = [], [], [], [], []
            for k, n in enumerate(counts.tolist()):
                whole = n - n % capacity
                for at in range(0, whole, capacity):
                    doc.append(k), start.append(at), length.append(capacity), window.append(opened.fresh()), offset.append(0)
                if n > whole:
                    w, o = opened.place(n - whole)
                    doc.append(k), start.append(whole), length.append(n - whole), window.append(w), offset.append(o)
            rows, lengths = pa.array(doc, pa.int32()), np.asarray(length, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), pa.array(start, pa.int64()), pa.array(lengths), pa.array(counts).take(rows), pa.array(window, pa.int64()), pa.array(offset, pa.int64()), pa.array(np.zeros(len(rows), bool)), binary_column(ids, np.cumsum(lengths) * 4)],
                schema=_ARROW,
            )
        left = opened.left()
        none, n = pa.nulls(len(left), pa.int64()), len(left)
        yield pa.RecordBatch.from_arrays([none, none, pa.array([f for _, f in left], pa.int64()), none, pa.array([w for w, _ in left], pa.int64()), none, pa.array(np.ones(n, bool)), pa.nulls(n, pa.binary())], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(place), PLACED)


def merge_leftovers(placed: DataFrame, capacity: int = 1024) -> DataFrame:
    """Pieces with their final sequence_id and offset; windows left open at partition ends are put together.

    Only the windows (an id and a fill) are dealt out for this, about MERGED_AT_ONCE to a task; any columns of the pieces stay.
    """
    placed = stage(placed, "placed")
    left = placed.where("left_open").select("window_id", "length")
    windows = left.count()
    groups = windows // MERGED_AT_ONCE + 1

    def merge(windows: pd.DataFrame) -> pd.DataFrame:
        opened = OpenWindows(capacity, len(windows), 0)
        windows = windows.sort_values(["length", "window_id"], ascending=[False, True])
        spots = [opened.place(n, w) for w, n in zip(windows["window_id"].tolist(), windows["length"].tolist())]
        return pd.DataFrame({"window_id": windows["window_id"].to_numpy(), "sequence_id": np.array([s for s, _ in spots], np.int64), "base": np.array([b for _, b in spots], np.int64)})

    merged = left.withColumn("part", F.pmod(F.xxhash64("window_id"), F.lit(groups))).groupBy("part").applyInPandas(merge, "window_id long, sequence_id long, base long")
    if windows <= BROADCAST_WINDOWS:
        merged = F.broadcast(merged)
    pieces = placed.where("not left_open").drop("left_open")
    joined = pieces.join(merged, "window_id", "left")
    return joined.withColumns({"sequence_id": F.coalesce("sequence_id", "window_id"), "offset": F.col("offset") + F.coalesce("base", F.lit(0))}).drop("window_id", "base")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, windows: int = 128, frugal: bool = False) -> DataFrame:
    """Pieces of all documents with ids, sequence_id and offset; sequences are at most `capacity` ids long."""
    return merge_leftovers(place_documents(docs, tokenizer, end_id, capacity, windows, frugal), capacity)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row for each sequence: its pieces in order as an array of (doc_id, start, length, ids). A sequence holds at most `capacity` pieces."""
    piece = F.struct("offset", "doc_id", "start", "length", "ids")
    return pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum("length").alias("tokens"))

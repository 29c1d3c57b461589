"""Token-id files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

A store is a folder of numbered parts in ascending doc_id order. Part k has
  part-k.ids   all token ids, little-endian, unsigned 16-bit where the vocabulary allows it, else 32-bit
  part-k.ends  one little-endian unsigned 64-bit offset for each document: the ids of the part before its end
  part-k.docs  its doc_ids, little-endian signed 64-bit;  part-k.null one byte each, 1 where the doc_id is null
and a table `parts` with the number of documents and ids of each part and, from prefix sums over the parts, those before it.

Defined cases: null text is empty (one end id); null doc_ids come first; rows with one doc_id follow each other in any
order; texts of any length are encoded whole, a text larger than a batch by itself; an empty table gives a store without
parts; other columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histoloom.llm.tokens import binary_column, encoded
from histoloom.session import posix_path
from histoloom.llm.workers import tidied

_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
#: Ids that a reading task holds at once.
READ_IDS = 2 << 20


def _part(folder: str, part: int, kind: str) -> str:
    return f"{folder}/part-{part:06d}.{kind}"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_bits: int = 16) -> None:
    """Encode all documents and write a store. folder: on a mount that all executors share.

    Each task writes its part under a name of its own attempt and renames it, so a repeated attempt only replaces equal files.
    """
    path, kind = posix_path(folder), np.dtype(f"<u{id_bits // 8}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, own = context.partitionId(), f".{context.taskAttemptId()}"
        os.makedirs(path, exist_ok=True)
        n_docs = n_ids = 0
        names = {x: _part(path, part, x) for x in ("ids", "ends", "docs", "null")}
        files = {x: open(name + own, "wb") for x, name in names.items()}  # noqa: SIM115
        for batch, ids, counts in encoded(batches, tokenizer, end_id):
            if len(ids) and int(ids.max()) > np.iinfo(kind).max:
                raise ValueError(f"token id {ids.max()} does not fit {id_bits} bits")
            files["ids"].write(ids.astype(kind).tobytes())
            files["ends"].write((n_ids + np.cumsum(counts)).astype("<u8").tobytes())
            doc_ids = batch.column("doc_id")
            files["docs"].write(np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes())
            files["null"].write(np.asarray(doc_ids.is_null()).astype("u1").tobytes())
            n_docs, n_ids = n_docs + len(counts), n_ids + len(ids)
        for x, file in files.items():
            file.flush()
            os.fsync(file.fileno())
            file.close()
            os.replace(names[x] + own, names[x])
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, n_docs, n_ids)], ["part", "docs", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("_at"))
    ordered = ordered.repartitionByRange("doc_id", "_at").sortWithinPartitions("doc_id", "_at").drop("_at")
    parts = ordered.mapInArrow(tidied(write), "part long, docs long, ids long")
    parts.write.parquet(f"{folder}/parts")


def token_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The store's parts with the documents and ids that stand before each: a row for each part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{x}_before": F.coalesce(F.sum(x).over(before), F.lit(0)) for x in ("docs", "ids")}
    return spark.read.schema("part long, docs long, ids long").parquet(f"{folder}/parts").withColumns(sums)


def read_token_files(spark: SparkSession, folder: str, id_bits: int = 16) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of every document."""
    path, kind = posix_path(folder), np.dtype(f"<u{id_bits // 8}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mapped = {x: np.memmap(_part(path, row["part"], x), dtype, "r") for x, dtype in (("ids", kind), ("ends", "<u8"), ("docs", "<i8"), ("null", "u1"))}
                ends = np.asarray(mapped["ends"]).astype(np.int64)
                first = 0
                while first < len(ends):
                    base = ends[first - 1] if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, base + READ_IDS, side="right")))
                    own, starts = ends[first:last] - base, np.concatenate([[base], ends[first : last - 1]])
                    ids = np.asarray(mapped["ids"][base : ends[last - 1]]).astype("<u4")
                    doc_ids = pa.array(np.asarray(mapped["docs"][first:last]), mask=np.asarray(mapped["null"][first:last]).astype(bool))
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(row["ids_before"] + starts), pa.array(ends[first:last] - starts), binary_column(ids, own * 4)], schema=_ROWS)
                    first = last

    parts = token_parts(spark, folder)
    tasks = max(1, parts.count())  # a task for each part
    return parts.repartitionByRange(tasks, "part").mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids binary")

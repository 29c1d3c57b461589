"""Incremental ingestion: new feature files are taken up once, by slide; failed and damaged slides are written again.

A slide may be spread over any number of files, which may arrive in different micro-batches or runs. The sink therefore has
a partition for each (slide, source file), so a batch adds to a slide and replaces nothing of it but what it had written itself
before. Beside the sink stands a ledger with a row for each such partition (source path, number and digest of its rows),
written by batch after the batch's rows: with it a run tells which slides are whole without reading the source again.

Where slides are many and small, a folder for each costs more than its rows: with `buckets` the sink has a folder for each
(bucket of slides, source file) instead, slide being a column of its files, sorted by it. Every function of a sink then gets
the same number. Damaged slides are told one by one; what is written again is the whole bucket that a slide lies in.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from histoloom.session import stage
from histoloom.sources.readers import BUCKET, exists

#: Name of the sink's second partition column: the source file that a row came from.
FILE = "from_file"
#: Damaged files that are read and written again together.
FILES_A_PASS = 1000


def _with_file(rows: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return rows.select("*", path.alias("_path"), F.concat(F.lit("f"), F.hex(F.xxhash64(path))).alias(FILE))


def _place(group: str, buckets: int | None) -> str:
    """Name of the sink's first partition column."""
    return BUCKET if buckets else group


def _placed(rows: DataFrame, group: str, buckets: int | None) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int")) if buckets else rows


def _written(rows: DataFrame, sink: str, group: str, buckets: int | None) -> None:
    """Rows into their partitions, which replace those of before."""
    place = _place(group, buckets)
    rows = _placed(rows.drop("_path"), group, buckets).repartition(place, FILE).sortWithinPartitions(place, FILE, group)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(place, FILE).parquet(sink)


def _digests(rows: DataFrame, schema: str, *keys: str) -> DataFrame:
    """(keys, rows, digest) over the columns of the schema, whatever the order of rows."""
    columns = sorted(c for c in StructType.fromDDL(schema).names if c not in keys)
    both = F.struct(F.bit_xor(F.xxhash64(*columns)), F.bit_xor(F.xxhash64(F.lit(1), *columns)))  # of repeated rows the number counts
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.hex(F.xxhash64(both)).alias("digest"))


def _ledger(sink: str) -> str:
    return f"{sink.rstrip('/')}_files"


def _in_sink(spark: SparkSession, sink: str, schema: str, group: str, buckets: int | None) -> DataFrame:
    """What the sink holds; files that cannot be read hold nothing."""
    kinds = StructType.fromDDL(schema).add(FILE, "string")
    if not exists(spark, f"{sink}/{_place(group, buckets)}=*"):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(sink)


def ingest_slides(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str, group: str = "slide", files_at_once: int = 64, seen: Callable[[str], None] | None = None, buckets: int | None = None) -> StreamingQuery:
    """Take up what is new under `source`, then stop.

    foreachBatch may run a batch twice: both its partitions and its part of the ledger are then replaced by equal ones.
    seen: gets the ledger's name of each batch.
    """
    run = f"{zlib.crc32(checkpoint.encode()):08x}"  # batches are numbered by checkpoint

    def put(batch: DataFrame, number: int) -> None:
        _written(batch, sink, group, buckets)
        ledger = _digests(batch, schema, group, FILE, "_path").withColumnRenamed("_path", "path")
        ledger.write.mode("overwrite").parquet(f"{_ledger(sink)}/batch={run}-{number}")  # a row for each slide and file of the batch
        if seen is not None:
            seen(f"{run}-{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).parquet(source)
    return _with_file(stream).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _entries(spark: SparkSession, sink: str, schema: str, group: str) -> DataFrame:
    """The ledger, one row for each (slide, file)."""
    slide = next(f for f in StructType.fromDDL(schema).fields if f.name == group)
    kinds = StructType([slide]).add(FILE, "string").add("path", "string").add("rows", "long").add("digest", "string").add("batch", "string")
    if not exists(spark, f"{_ledger(sink)}/batch=*"):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(_ledger(sink))


def damaged_files(spark: SparkSession, sink: str, schema: str, group: str = "slide", batches: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """(slide, from_file, path) of the ledger's entries whose rows the sink lacks or holds differently; with `batches` only slides that these have touched are read."""
    entries, there = _entries(spark, sink, schema, group), _in_sink(spark, sink, schema, group, buckets)
    if batches is not None:
        touched = entries.where(F.col("batch").isin(batches)).select(group).distinct()
        entries, there = entries.join(touched, group, "left_semi"), there.join(touched, group, "left_semi")
    return entries.join(_digests(there, schema, group, FILE), [group, FILE, "rows", "digest"], "left_anti").select(group, FILE, "path").distinct()


def write_again(spark: SparkSession, sink: str, schema: str, damaged: DataFrame, group: str = "slide", buckets: int | None = None) -> None:
    """The damaged partitions, from their source files; only these files are read, some at a time."""
    place = _place(group, buckets)
    again = _placed(damaged, group, buckets).select(place, FILE).distinct()
    todo = damaged.select("path").distinct()
    while paths := [r[0] for r in todo.orderBy("path").limit(FILES_A_PASS).collect()]:
        rows = _with_file(spark.read.schema(schema).parquet(*paths))
        _written(_placed(rows, group, buckets).join(again, [place, FILE], "left_semi"), sink, group, buckets)
        todo = todo.where(F.col("path") > paths[-1])


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str, group: str = "slide", files_at_once: int = 64, attempts: int = 3, check_all: bool = False, buckets: int | None = None) -> DataFrame:
    """Take up what is new, then check the slides that this run touched (or all) and write damaged ones again, up to `attempts` times.

    Returns (slide, files, rows, status) of every slide in the ledger: 'completed', or 'failed' where the sink still differs from the source.
    """
    batches: list[str] = []
    ingest_slides(spark, source, sink, checkpoint, schema, group, files_at_once, batches.append, buckets).awaitTermination()
    for attempt in range(attempts + 1):
        damaged = stage(damaged_files(spark, sink, schema, group, None if check_all else batches, buckets), "damaged-files")
        if attempt == attempts or not damaged.take(1):
            break
        write_again(spark, sink, schema, damaged, group, buckets)
    failed = damaged.select(group).distinct().withColumn("status", F.lit("failed"))
    whole = _entries(spark, sink, schema, group).groupBy(group).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))
    return whole.join(failed, group, "left").withColumn("status", F.coalesce("status", F.lit("completed")))


def slides_to_redo(spark: SparkSession, source: str, sink: str, schema: str, group: str = "slide", buckets: int | None = None) -> DataFrame:
    """(group) of slides whose rows in the sink are missing or differ from those of the source: failed or damaged. Reads both; no ledger is asked."""
    wanted = _with_file(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(source))
    there = _digests(_in_sink(spark, sink, schema, group, buckets), schema, group, FILE)
    return _digests(wanted, schema, group, FILE).join(there, [group, FILE, "rows", "digest"], "left_anti").select(group).distinct()


def redo_slides(spark: SparkSession, source: str, sink: str, schema: str, group: str = "slide", attempts: int = 3, buckets: int | None = None) -> int:
    """Write failed and damaged slides again, whole (with their buckets), up to `attempts` times; how many are left."""
    place = _place(group, buckets)
    for _ in range(attempts):
        redo = stage(slides_to_redo(spark, source, sink, schema, group, buckets), "slides-again")  # the sink is read for it
        if not redo.take(1):
            return 0
        rows = _with_file(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(source))
        again = _placed(redo, group, buckets).select(place).distinct()
        _written(_placed(rows, group, buckets).join(again, place, "left_semi"), sink, group, buckets)
    return slides_to_redo(spark, source, sink, schema, group, buckets).count()

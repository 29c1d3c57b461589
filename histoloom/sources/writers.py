"""Writers: Spark's commit protocol makes each of them all or nothing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histoloom.session import stage
from histoloom.sources.readers import BUCKET, exists


def write_cell_features(cells: DataFrame, folder: str, group: str = "slide", buckets: int | None = None) -> None:
    """Feature tables, a partition folder for each slide; only the slides at hand are replaced.

    buckets: so many folders of slides instead, for many small slides; a store keeps its number. The other slides of the buckets at
    hand are read and written again with them.
    """
    place = BUCKET if buckets else group
    if buckets:
        spark = cells.sparkSession
        cells = cells.withColumn(BUCKET, F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int"))
        if exists(spark, f"{folder}/{BUCKET}=*"):
            here = cells.select(F.col(group).alias("_here")).distinct()
            before = spark.read.parquet(folder).join(cells.select(BUCKET).distinct(), BUCKET, "left_semi")
            cells = stage(cells.unionByName(before.join(here, F.col(group).eqNullSafe(F.col("_here")), "left_anti")), "bucket-rows")
    rows = cells.repartition(place).sortWithinPartitions(place, group)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(place).parquet(folder)


#: Folder of the snapshots' manifests, below that of the graphs.
MANIFESTS = "_manifests"


def _files(spark: SparkSession, path: str):  # noqa: ANN202  (file system, path) of Hadoop
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """Names of the complete snapshots of a set of graph tables, oldest first."""
    files, path = _files(spark, f"{folder}/{MANIFESTS}/*.json")
    return sorted(s.getPath().getName().removesuffix(".json") for s in files.globStatus(path) or [])


def _manifest(spark: SparkSession, folder: str, snapshot: str) -> dict[str, dict]:
    return json.loads(spark.read.option("wholetext", True).text(f"{folder}/{MANIFESTS}/{snapshot}.json").first()[0])


def write_graphs(folder: str, **tables: DataFrame) -> str:
    """Tables of graphs (nodes, edges, graph_meta, slide_meta, targets) as one new snapshot, whose name is returned.

    Each table gets a folder of its own; a manifest that names them all, with their files and bytes, is renamed into place at
    the end. Whoever reads through read_graphs sees the snapshot before or this one, never a part of it; tables not given
    are taken over from the snapshot before.
    """
    spark = next(iter(tables.values())).sparkSession
    before = snapshots(spark, folder)
    named = _manifest(spark, folder, before[-1]) if before else {}
    own = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/data-{own}/{name}")
        files, path = _files(spark, f"{folder}/data-{own}/{name}")
        held = files.getContentSummary(path)
        named[name] = {"path": f"data-{own}/{name}", "files": held.getFileCount(), "bytes": held.getLength()}
    snapshot = f"{int(before[-1]) + 1 if before else 0:012d}"
    files, draft = _files(spark, f"{folder}/{MANIFESTS}/.draft-{own}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(named, sort_keys=True).encode()))
    out.close()
    _, place = _files(spark, f"{folder}/{MANIFESTS}/{snapshot}.json")
    if files.exists(place) or not files.rename(draft, place):
        raise RuntimeError(f"another writer has made snapshot {snapshot} of {folder}")
    return snapshot


def read_graphs(spark: SparkSession, folder: str, name: str, snapshot: str | None = None) -> DataFrame:
    """One table of a snapshot, of the last complete one if none is named."""
    found = snapshot or (snapshots(spark, folder) or [None])[-1]
    if found is None:
        raise FileNotFoundError(f"{folder} has no complete snapshot")
    return spark.read.parquet(f"{folder}/{_manifest(spark, folder, found)[name]['path']}")


def drop_snapshots(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Remove all but the last `keep` snapshots, and every table folder that none of these names (what killed runs left, too); how many folders went."""
    every = snapshots(spark, folder)
    for old in every[:-keep]:
        files, path = _files(spark, f"{folder}/{MANIFESTS}/{old}.json")
        files.delete(path, False)
    used = {entry["path"].split("/")[0] for kept in every[-keep:] for entry in _manifest(spark, folder, kept).values()}
    files, path = _files(spark, f"{folder}/data-*")
    gone = [s.getPath() for s in files.globStatus(path) or [] if s.getPath().getName() not in used]
    for place in gone:
        files.delete(place, True)
    return len(gone)


def write_metrics(metrics: DataFrame, folder: str, formats: tuple[str, ...] = ("json", "csv")) -> None:
    """Metric rows as JSON lines and CSV."""
    for kind in formats:
        writer = metrics.write.mode("overwrite")
        (writer.option("header", True).csv if kind == "csv" else writer.json)(f"{folder}/{kind}")


#: Neighbouring columns of a wide matrix whose fields are put together first.
BLOCK_COLUMNS = 8192


def _joined(fields: DataFrame, *group: str) -> DataFrame:
    """(group, value): the text fields of a row (at, field) with commas between them, in the order of `at`; blocks of columns first."""
    ordered = lambda at, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, text))), lambda f: f[text]), ",")
    blocks = fields.groupBy(*group, F.floor(F.col("at") / BLOCK_COLUMNS).alias("block")).agg(ordered("at", "field").alias("part"))
    return blocks.groupBy(*group).agg(ordered("block", "part").alias("value"))


def write_expression_wide(values: DataFrame, path: str, gene: str, sample: str, value: str, prefix: str = "") -> None:
    """A matrix as CSV with a line for each gene and a column for each sample (whole numbers, in their order, named by prefix and number); what is absent is an empty field.

    Fields meet their line and column by joins, so the work is that of the matrix' fields. values: one row for each (gene, sample).
    """
    samples = values.select(F.col(sample).alias("at")).distinct()
    header = _joined(samples.select("at", F.concat(F.lit(prefix), F.col("at").cast("string")).alias("field"))).select(F.concat(F.lit(","), "value").alias("value"))
    held = values.select(F.col(gene).alias("gene"), F.col(sample).alias("at"), F.col(value).cast("string").alias("field"))
    grid = samples.crossJoin(F.broadcast(held.select("gene").distinct()))
    fields = grid.join(held, ["gene", "at"], "left").withColumn("field", F.coalesce("field", F.lit("")))
    lines = _joined(fields, "gene").select(F.concat_ws(",", "gene", "value").alias("value"))
    header.coalesce(1).union(lines).write.text(path)  # the header's file comes first


def write_norm_stats(stats: DataFrame, path: str) -> None:
    """(gene, mean, std) as JSON lines."""
    stats.select("gene", "mean", "std").write.mode("overwrite").json(path)


def read_norm_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics that write_norm_stats wrote."""
    return spark.read.schema("gene string, mean double, std double").json(path)


def write_selected_files(files: DataFrame, folder: str) -> None:
    """Base names of the files of each split as text."""
    files.select("split", F.element_at(F.split("path", "/"), -1).alias("value")).repartition("split").write.mode("overwrite").partitionBy("split").text(folder)


def append_progress(log: DataFrame, folder: str) -> None:
    """Status rows (sample_id, status, ts, ...) behind those already there."""
    log.write.mode("append").parquet(folder)

"""Readers: every source has its schema written down; optional files give null columns, not errors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histoloom.functions import ids
from histoloom.operators.ordering import number_rows
from histoloom.session import stage

#: Beginnings of lines in a gene list that are notes.
NOTES = r"^(Efficiently|Total|Detection|Samples)"

METADATA = "tissue string, st_technology string, pixel_size_um_estimated double, spot_diameter double"
NUCLEI = "nuc map<string, struct<centroid: array<double>, contour: array<array<int>>>>"
CELLS = "cell_id bigint, x_centroid double, y_centroid double, cell_area double, nucleus_area double"
BOUNDARIES = "cell_id bigint, vertex_x double, vertex_y double"
CLUSTERS = "Barcode bigint, Cluster int"
#: Columns of a matrix up to which their names are broadcast.
BROADCAST_NAMES = 1_000_000
#: Partition column of stores and sinks that hold buckets of slides instead of a folder for each slide.
BUCKET = "in_bucket"
#: Tasks that list the folders of a tree.
LISTING_TASKS = 64
MANIFEST = "id string, filename string, md5 string, size bigint, state string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or a pattern) is there, asked of the file system that holds it."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0


def read_cell_features(spark: SparkSession, folder: str, limit: int | None = None, recursive: bool = True) -> DataFrame:
    """Feature tables under a folder, a file for each slide, with slide and path; with a limit the first files by path.

    In a store of buckets slides share files: slide is a column, and the first ones are those whose folders (slide=...) would be.
    """
    if exists(spark, f"{folder}/{BUCKET}=*"):
        table = spark.read.parquet(folder).withColumn("path", F.col("_metadata.file_path")).drop(BUCKET)
        if limit is None:
            return table
        name = F.concat(F.lit("slide="), F.col("slide").cast("string"), F.lit("/"))
        first = table.select("slide").distinct().orderBy(name).limit(limit).select(F.col("slide").alias("_slide"))
        return table.join(F.broadcast(first), F.col("slide").eqNullSafe(F.col("_slide")), "left_semi")
    table = spark.read.option("recursiveFileLookup", recursive).parquet(folder).withColumn("path", F.col("_metadata.file_path"))
    table = table.withColumn("slide", ids.slide_id(F.col("path")))
    if limit is None:
        return table
    first = list_files(spark, folder, "*.parquet").orderBy("path").limit(limit).select(F.col("path").alias("_path"))
    return table.join(F.broadcast(first), F.col("path") == F.col("_path"), "left_semi")


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length) of the files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")


def list_folders(folders: DataFrame) -> DataFrame:
    """folders (path, ...) with each file below them as path and length, files without bytes too (Spark's own listing leaves those out).

    Tasks list the folders, each its own; folders that do not exist have no files, names that begin with a dot are skipped.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, lengths = [], [], []
            for k, path in enumerate(batch.column("path").to_pylist()):
                system, place = fs.FileSystem.from_uri(path)
                for info in system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True)):
                    if info.is_file and not info.base_name.startswith("."):
                        at.append(k)
                        paths.append(path + info.path.removeprefix(place))
                        lengths.append(info.size)
            rest = batch.drop_columns(["path"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], [*rest.schema.names, "path", "length"])

    rest = [f for f in folders.schema.fields if f.name != "path"]
    return folders.mapInArrow(listed, T.StructType([*rest, T.StructField("path", T.StringType()), T.StructField("length", T.LongType())]))


def list_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files with bytes under a folder, listed by tasks: one for what stands in it, and its folders by many.

    Files of other names than Spark's own listing takes (those that begin with a dot or an underscore, or stand in such folders) are left out.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                found = [i for i in system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if not i.base_name.startswith((".", "_"))]
                for k in range(0, len(found), 10_000):
                    some = found[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{i.base_name}" for i in some], pa.string()), pa.array([i.size if i.is_file else None for i in some], pa.int64())], ["path", "length"])

    top = stage(spark.createDataFrame([(folder.rstrip("/"),)], "path string").mapInArrow(entries, "path string, length long"), "listing")
    folders = top.where("length is null").select("path", (F.length("path") + 1).alias("_start"))
    below = list_folders(folders.repartition(LISTING_TASKS, "path")).where(~F.expr("substring(path, _start)").rlike("/[._]")).drop("_start")
    return top.where("length > 0").unionByName(below.where("length > 0"))


def list_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, slide, tile_id, x1, y1, x2, y2) of the tile images under a folder, listed once for all slides, by tasks: tiles are many."""
    tiles = list_tree(spark, folder).where(F.endswith("path", F.lit(".png")) & (F.instr("path", ids.TILE_MARK) > 0))
    return tiles.withColumns({"slide": ids.slide_id(F.col("path")), "_b": ids.tile_bounds(F.col("path"))}).select("path", "length", "slide", "_b.*")


#: A line's first field, quoted or not, and the rest behind its comma.
_FIRST_FIELD = r'^(?:"((?:[^"\\]|\\.|"")*)"|([^,]*)),(.*)$'


def read_expression_wide(spark: SparkSession, path: str, cut_ids: bool = True) -> DataFrame:
    """(gene_id, sample_id, value) of a matrix with a header of barcodes and the gene in an unnamed first column.

    Lines are melted as text: a line is split into its values and these meet the header's names by position, so the plan
    does not grow with the columns, and a task holds one line at a time, however many samples it has. The header is the
    first line of the first file by name, and is dropped wherever it stands; only the gene may be quoted. What is no number is null.
    """
    first = list_files(spark, path, "*").where("length > 0").agg(F.min("path")).first()[0]
    if first is None:
        return spark.createDataFrame([], "gene_id string, sample_id string, value double")
    header = spark.read.text(first).first()[0]
    lines = spark.read.text(path).where((F.col("value") != header) & (F.col("value") != ""))
    names = spark.createDataFrame([(header,)], "header string").select(F.posexplode(F.split("header", ",")).alias("pos", "name")).where("pos > 0")
    names = names.select((F.col("pos") - 1).alias("pos"), F.regexp_replace("name", r'^"|"$', "").alias("sample_id"))
    part = lambda k: F.regexp_extract("value", _FIRST_FIELD, k)
    gene = F.when(F.startswith("value", F.lit('"')), F.regexp_replace(part(1), r'\\(.)|""', '"')).otherwise(part(2))
    # the gene is read before the fields are dealt out: beside them its line would be searched again for each
    cut = lines.select((ids.gene_prefix(gene) if cut_ids else gene).alias("gene_id"), F.split(part(3), ",").alias("fields"))
    values = cut.select("gene_id", F.posexplode("fields").alias("pos", "value"))
    number = F.regexp_replace("value", r'^"|"$', "").try_cast("double")
    few = header.count(",") <= BROADCAST_NAMES
    return values.join(F.broadcast(names) if few else names, "pos").select("gene_id", "sample_id", number.alias("value"))


def _file_order() -> Column:
    """Sorts rows by file name, then by their place in the file; Spark reads files in an order of its own."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, value) of a text file, or of several in the order of their names."""
    lines = spark.read.text(path).select("value", _file_order().alias("_order"))
    return number_rows(lines, "_order", name="row_idx")[0].select("row_idx", "value")


def read_gene_map(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, ens_id) of a tab-separated map; the last line of a symbol wins, lines of one field are skipped."""
    parts = F.split("value", "\t")
    rows = _numbered_lines(spark, path).where(F.size(parts) >= 2).select("row_idx", F.trim(parts[0]).alias("ens_id"), F.trim(parts[1]).alias("symbol"))
    return rows.groupBy("symbol").agg(F.max_by("ens_id", "row_idx").alias("ens_id"))


def read_gene_list(spark: SparkSession, path: str, skip_notes: bool = True) -> DataFrame:
    """(row_idx, symbol) in file order, without empty lines and notes."""
    rows = _numbered_lines(spark, path).select("row_idx", F.trim("value").alias("symbol")).where("symbol != ''")
    return rows.where(~F.col("symbol").rlike(NOTES)) if skip_notes else rows


def read_sample_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, metadata columns) of JSON files, one for each sample; missing files, keys and broken files give nulls."""
    if not exists(spark, path):
        return spark.createDataFrame([(path, None, None, None, None)], f"path string, {METADATA}")
    return spark.read.schema(METADATA).option("mode", "PERMISSIVE").json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), "*")


def read_nuclei(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(path, cell, cell_id, x, y, contour) of nuclei that have a centroid and a contour; the id is also kept as text. lines: a file holds many slides, one in each line, instead of one."""
    rows = spark.read.schema(NUCLEI).json(path, multiLine=not lines).select(F.col("_metadata.file_path").alias("path"), F.explode("nuc").alias("cell", "n"))
    rows = rows.where((F.size("n.centroid") > 0) & (F.size("n.contour") > 0))
    contour = F.transform("n.contour", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return rows.select("path", "cell", ids.cell_number(F.col("cell")).alias("cell_id"), F.get("n.centroid", F.lit(0)).alias("x"), F.get("n.centroid", F.lit(1)).alias("y"), contour.alias("contour"))


def _optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    return spark.read.schema(schema).option("header", True).csv(path) if exists(spark, path) else None


def read_cells_export(spark: SparkSession, folder: str) -> dict[str, DataFrame | None]:
    """The three optional tables of a single-cell export: cells, boundaries (with vertex order) and clusters."""
    boundaries = _optional_csv(spark, f"{folder}/cell_boundaries.csv", BOUNDARIES)
    if boundaries is not None:
        boundaries = boundaries.select("cell_id", _file_order().alias("vertex_idx"), F.col("vertex_x").alias("x"), F.col("vertex_y").alias("y"))
    return {"cells": _optional_csv(spark, f"{folder}/cells.csv", CELLS), "boundaries": boundaries, "clusters": _optional_csv(spark, f"{folder}/clusters.csv", CLUSTERS)}


def read_segmentation(spark: SparkSession, path: str) -> DataFrame:
    """A sample's polygon table; the geometry bytes stay bytes."""
    return spark.read.parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A download manifest."""
    return spark.read.schema(MANIFEST).option("header", True).option("sep", "\t").csv(path)


def discover_samples(spark: SparkSession, folder: str, pattern: str = "*.h5ad", wanted: list[str] | None = None) -> DataFrame:
    """(sample_id, pos, found): the wanted samples in the order asked for, or all files' stems in order."""
    files = list_files(spark, folder, pattern).select(ids.stem(F.col("path")).alias("sample_id")).distinct()
    if wanted is None:
        return files.select("sample_id", F.lit(None).cast("int").alias("pos"), F.lit(True).alias("found")).orderBy("sample_id")
    asked = spark.createDataFrame([(s, k) for k, s in enumerate(dict.fromkeys(wanted))], T.StructType.fromDDL("sample_id string, pos int"))
    return asked.join(files.withColumn("found", F.lit(True)), "sample_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def complete_inputs(segmentations: DataFrame, images: DataFrame) -> DataFrame:
    """(sample_id) of samples that have both a segmentation and an image, raw or normalised (any name that begins with the sample's)."""
    of_image = images.select(F.regexp_replace(ids.stem(F.col("path")), "_(norm|normalized|stain_norm|macenko)$", "").alias("sample_id")).distinct()
    return segmentations.select(ids.stem(F.col("path")).alias("sample_id")).distinct().join(of_image, "sample_id", "left_semi")

"""Columns over identifiers and file names: slides, cases, tiles, cells, barcodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The file-name patterns of tiles, and the suffixes of feature tables in the order they are tried.
TILE_NAME = r"_patch_tile_(\d+)_level0_(\d+)-(\d+)-(\d+)-(\d+)\.png"
LEVEL0_BOUNDS = r"_level0_(\d+)-(\d+)-(\d+)-(\d+)"
TILE_STEM = r"_patch_tile_\d+_level0_(\d+)-(\d+)-(\d+)-(\d+)$"
FEATURE_SUFFIXES = ("_tile36_features.parquet", "_features.parquet")
TILE_MARK = "_patch_tile_"
# End of fixed values.


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def slide_id(path: Column) -> Column:
    """The slide of a feature table or tile, by its file name; other names are kept."""
    name = base_name(path)
    found = F.when(F.instr(name, TILE_MARK) > 0, F.substring_index(name, TILE_MARK, 1)).otherwise(name)
    for suffix in reversed(FEATURE_SUFFIXES):
        found = F.when(name.endswith(suffix), F.left(name, F.length(name) - len(suffix))).otherwise(found)
    return found


def case_id(slide: Column) -> Column:
    """The first three dash-separated parts of a slide's name, or its first 12 characters."""
    parts = F.split(slide, "-")
    return F.when(F.size(parts) >= 3, F.concat_ws("-", F.slice(parts, 1, 3))).otherwise(F.substring(slide, 1, 12))


def _numbers(name: Column, pattern: str, groups: dict[str, int]) -> Column:
    # A miss gives '', which only a trying cast turns into null. Names without the pattern's mark are not searched for each group.
    held = F.contains(name, F.lit("_level0_"))
    return F.struct(*[F.when(held, F.regexp_extract(name, pattern, k).try_cast("int")).alias(c) for c, k in groups.items()])


def tile_bounds(path: Column) -> Column:
    """(tile_id, x1, y1, x2, y2) of a tile's image; nulls where the name has another form."""
    return _numbers(base_name(path), TILE_NAME, {"tile_id": 1, "x1": 2, "y1": 3, "x2": 4, "y2": 5})


def level0_bounds(name: Column) -> Column:
    """(x1, y1, x2, y2) anywhere in a name."""
    return _numbers(name, LEVEL0_BOUNDS, {"x1": 1, "y1": 2, "x2": 3, "y2": 4})


def stem_bounds(name: Column) -> Column:
    """(x1, y1, x2, y2) at the end of an image name without extension."""
    return _numbers(name, TILE_STEM, {"x1": 1, "y1": 2, "x2": 3, "y2": 4})


def gene_prefix(gene: Column) -> Column:
    """A gene id without its version: the first 15 characters."""
    return F.substring(gene, 1, 15)


def sample_prefix(barcode: Column) -> Column:
    """The case part of a sample barcode: the first 12 characters."""
    return F.substring(barcode, 1, 12)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    """Name of the folder that holds a file."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def after_patch(path: Column) -> Column:
    """What follows the last '_patch_' of the stem, or 'unknown'."""
    name = stem(path)
    return F.when(F.instr(name, "_patch_") > 0, F.substring_index(name, "_patch_", -1)).otherwise("unknown")


def unique_cell_id(slide: Column, image: Column, cell: Column) -> Column:
    """A cell's key over all slides."""
    return F.concat(slide, F.lit("_"), image, F.lit("_cell_"), cell.cast("string"))


def safe_id(name: Column) -> Column:
    """A name without path signs."""
    return F.translate(name, "/\\:", "___")


def barcode_candidates(barcode: Column) -> Column:
    """The ids under which a barcode may be known, first choice first."""
    parts = F.split(barcode, "-")
    four, three = F.concat_ws("-", F.slice(parts, 1, 4)), F.concat_ws("-", F.slice(parts, 1, 3))
    n = F.size(parts)
    return F.when(n >= 4, F.array(barcode, F.concat(four, F.lit("-01")), four, three)).when(n == 3, F.array(barcode, three)).otherwise(F.array(barcode))


def id_list(text: Column) -> Column:
    """Comma-separated ids: trimmed, without empty ones, each at its first place."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def human_number(n: Column) -> Column:
    """A number with K, M or B and two decimals; under a thousand as it is."""
    scaled = F.lit(None).cast("string")
    for limit, sign in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        scaled = F.coalesce(scaled, F.when(n >= limit, F.format_string(f"%.2f{sign}", n.cast("double") / limit)))
    return F.coalesce(scaled, n.cast("string"))


def cell_number(cell: Column) -> Column:
    """A cell id as a number where it is one; keep the text beside it."""
    return cell.try_cast("int")

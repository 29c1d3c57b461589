"""Columns over feature vectors (arrays)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 128


def feature_columns(df: DataFrame, prefix: str = "feature_") -> list[str]:
    """The feature columns in the order of their numbers."""
    found = [c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    return sorted(found, key=lambda c: int(c[len(prefix) :]))


def assemble(df: DataFrame, name: str = "features") -> DataFrame:
    """One array column in place of the feature columns."""
    columns = feature_columns(df)
    return df.withColumn(name, F.array(*[F.col(c) for c in columns])).drop(*columns)


def pad_or_cut(vector: Column, width: int) -> Column:
    """The vector with zeros at its end or without its last components."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), width)), 1, width)


#: Layouts of the fallback vector by kind of source; names are columns, numbers are constants.
LAYOUTS = {"tiles": ("x", "y", "area", "perimeter"), "spots": ("area", "perimeter", "shape", "x", "y"), "grid": ("area", "nucleus_area", 1.0, "x", "y"), "grid_rows": ("area", "nucleus_area", "x", "y")}
#: What stands in for measures that a source lacks.
DEFAULTS = {"area": 100.0, "perimeter": 35.4, "nucleus_area": 35.4, "shape": 1.0, "x": 0.0, "y": 0.0}


def fallback_vector(df: DataFrame, layout: str, width: int = WIDTH) -> Column:
    """A geometric vector for cells without features; in 'grid_rows' a table without areas keeps x and y at places 3 and 4."""
    names: tuple = LAYOUTS[layout]
    if layout == "grid_rows" and "area" not in df.columns:
        names = (0.0, 0.0, 0.0, "x", "y")
    value = lambda c: F.lit(c) if not isinstance(c, str) else F.coalesce(F.col(c), F.lit(DEFAULTS[c])) if c in df.columns else F.lit(DEFAULTS[c])
    return pad_or_cut(F.array(*[value(c).cast("float") for c in names]), width)


def nan_to_num(vector: Column, nan: float = 0.0, high: float = 1.0, low: float = -1.0) -> Column:
    """Finite components stay; the others get fixed values, in one pass."""
    infinite = float("inf")
    return F.transform(vector, lambda v: F.when(F.isnan(v), nan).when(v == infinite, high).when(v == -infinite, low).otherwise(v))


def mean_abs_difference(one: Column, two: Column) -> Column:
    """Mean distance of the components of two vectors."""
    total = F.aggregate(F.zip_with(one, two, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(total, F.size(one))


def dot(one: Column, two: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(one, two, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(one: Column, two: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    return F.aggregate(F.zip_with(one, two, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def sincos(x: Column, y: Column, width: int) -> Column:
    """Interleaved sine and cosine of x and y at falling frequencies; `width` is a multiple of 4."""
    half = width // 2
    steps = F.sequence(F.lit(0), F.lit(half - 2), F.lit(2))
    def four(i: Column) -> Column:
        rate = F.exp(i * F.lit(-9.210340371976184 / half))  # minus the logarithm of 10,000
        return F.array(F.sin(x * rate), F.cos(x * rate), F.sin(y * rate), F.cos(y * rate))
    return F.flatten(F.transform(steps, four))

"""Columns over coordinates, polygons and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixel size where none is known, spot radius where no diameter is known, and the factor on the half diameter.
PIXEL_UM, UNKNOWN_RADIUS_UM, RADIUS_FACTOR = 0.5, 25.0, 1.5
GRID_WIDTH = 2000.0


def tile_geometry(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """Centre, width and height of a tile."""
    return [((x1 + x2) / 2).alias("center_x"), ((y1 + y2) / 2).alias("center_y"), (x2 - x1).alias("width"), (y2 - y1).alias("height")]


def to_absolute(x: Column, y: Column, x1: Column, y1: Column) -> list[Column]:
    """Slide coordinates of a place in a tile."""
    return [(x + x1).alias("x"), (y + y1).alias("y")]


def to_tile(x: Column, y: Column, x1: Column, y1: Column) -> list[Column]:
    """Tile coordinates of a place on the slide."""
    return [(x - x1).alias("x"), (y - y1).alias("y")]


def _edges(polygon: Column) -> Column:
    """The polygon's points, each with the next one, closed."""
    after = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    return F.zip_with(polygon, after, lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), b["x"].alias("nx"), b["y"].alias("ny")))


def _total(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + term(e))


def polygon_area(polygon: Column) -> Column:
    """Area by the shoelace formula."""
    return F.abs(_total(_edges(polygon), lambda e: e["x"] * e["ny"] - e["nx"] * e["y"])) / 2


def polygon_perimeter(polygon: Column) -> Column:
    """Length of the closed outline."""
    return _total(_edges(polygon), lambda e: F.hypot(e["nx"] - e["x"], e["ny"] - e["y"]))


def polygon_centroid(polygon: Column) -> Column:
    """Centroid (x, y); of an outline without area, the mean of its points."""
    edges = _edges(polygon)
    twice = _total(edges, lambda e: e["x"] * e["ny"] - e["nx"] * e["y"])
    def along(axis: str) -> Column:
        sums = _total(edges, lambda e: (e[axis] + e["n" + axis]) * (e["x"] * e["ny"] - e["nx"] * e["y"]))
        mean = F.try_divide(F.aggregate(polygon, F.lit(0.0), lambda s, p: s + p[axis]), F.size(polygon))
        return F.when(twice != 0, F.try_divide(sums, 3 * twice)).otherwise(mean)
    return F.struct(along("x").alias("x"), along("y").alias("y"))


def shape_factor(perimeter: Column, area: Column) -> Column:
    """Perimeter squared over 4 pi area; 1 without area."""
    return F.when(area > 0, F.try_divide(perimeter * perimeter, 4 * F.pi() * area)).otherwise(1.0)


def clip_contour(contour: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A contour (array of (x, y)) in whole tile coordinates inside the tile; null under three points."""
    inside = lambda v, at, size: F.greatest(F.lit(0), F.least(v.cast("int") - at, size - 1))
    moved = F.transform(contour, lambda p: F.struct(inside(p["x"], x1, width).alias("x"), inside(p["y"], y1, height).alias("y")))
    return F.when(F.size(contour) >= 3, moved)


def box_sides(contour: Column) -> Column:
    """(width, height) in pixels of the box around a contour."""
    side = lambda axis: F.array_max(F.transform(contour, lambda p: p[axis])) - F.array_min(F.transform(contour, lambda p: p[axis])) + 1
    return F.struct(side("x").alias("width"), side("y").alias("height"))


def crop_window(x: Column, y: Column, size: int, scale: Column, width: Column, height: Column) -> Column:
    """(x1, y1, x2, y2) of a crop round a centre, inside the image; halves round to even."""
    half = size // 2
    whole = lambda v: F.bround(v).cast("int")
    left, top, side = whole(x - half * scale), whole(y - half * scale), whole(F.lit(float(size)) * scale)
    return F.struct(F.greatest(F.lit(0), left).alias("x1"), F.greatest(F.lit(0), top).alias("y1"), F.least(width, left + side).alias("x2"), F.least(height, top + side).alias("y2"))


def px_to_um(distance: Column, pixel_um: Column) -> Column:
    """Pixels as micrometres."""
    return distance * F.coalesce(pixel_um, F.lit(PIXEL_UM))


def spot_radius_um(diameter: Column, pixel_um: Column) -> Column:
    """Reach of a spot: half its diameter and half as much again; 25 where the diameter is null or NaN."""
    known = diameter.isNotNull() & ~F.isnan(diameter)
    return F.when(known, diameter / 2 * F.coalesce(pixel_um, F.lit(PIXEL_UM)) * RADIUS_FACTOR).otherwise(UNKNOWN_RADIUS_UM)


def quantized(v: Column, low: Column, high: Column, places: int = 128) -> Column:
    """Place 0..places-1 of v between low and high; a range without extent counts as 1."""
    extent = F.when(high > low, high - low).otherwise(1)
    return F.least(F.lit(places - 1), F.greatest(F.lit(0), ((v - low) / extent * (places - 1)).cast("int")))


def grid_key(v: Column, low: Column, width: float = GRID_WIDTH) -> Column:
    """Column or row of a virtual grid that begins at low."""
    return F.floor((v - low) / width)


def lattice_tile(x: Column, y: Column, x0: Column, y0: Column, width: Column, height: Column) -> Column:
    """(x1, y1, x2, y2) of the lattice tile that holds a place; null left of or above the origin."""
    x1 = (F.floor((x - x0) / width) * width + x0).cast("long")
    y1 = (F.floor((y - y0) / height) * height + y0).cast("long")
    tile = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + width).cast("long").alias("x2"), (y1 + height).cast("long").alias("y2"))
    return F.when((x >= x0) & (y >= y0), tile)


def square(x: Column, y: Column) -> Column:
    """A square of side 2 round a centre, or the unit square without one."""
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    unit = F.array(*[point(F.lit(a), F.lit(b)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    round_centre = F.array(*[point(x + a, y + b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    return F.when(x.isNotNull() & y.isNotNull(), round_centre).otherwise(unit)


def default_position(row: Column) -> list[Column]:
    """Coordinates for a cell whose geometry cannot be read, by its row number."""
    return [(row % 100).cast("double").alias("x"), F.floor(row / 100).cast("double").alias("y")]

"""Spatial joins and graphs on a bucket grid: every join is an equi join on (group, bucket), the exact test follows."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoloom.session import stage

#: Points of a group up to which neighbours come from a join inside the group.
WHOLE_GROUP = 128
#: Queries that a task compares with their groups' points, about, and tasks at most.
QUERIES_A_TASK, MOST_TASKS = 1 << 15, 4000
#: Points of a leaf of a quad-tree, at most, as far as MOST_BITS halvings of the group's longer side tell them apart.
LEAF_POINTS = 32
MOST_BITS = 40
#: Buckets along a side of a block whose points are pooled together, and of its margin; points that a task takes at once, about, and pairs' components.
BLOCK, MARGIN = 8, 2
POINTS_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 21


def _bucket(v: Column, width: Column | float) -> Column:
    return F.floor(v / width)


def _spread(df: DataFrame, reach: int = 1) -> DataFrame:
    """A row for each bucket within `reach` of the row's own bucket (bx, by)."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    df = df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return df.withColumns({"bx": F.col("bx") + F.col("_dx"), "by": F.col("by") + F.col("_dy")}).drop("_dx", "_dy")


def assign_to_tiles(cells: DataFrame, tiles: DataFrame, width: float, height: float, group: str = "slide") -> DataFrame:
    """cells with tile_id and bounds of every tile that holds them (half open). width, height: size of the finest buckets, about a tile's.

    Tiles stand at the level of their own size: buckets double in size from level to level, and a tile lies at the first one
    whose bucket is no smaller than it, so it covers four buckets at most, however wide it is. Cells look at each level that
    has tiles: one for tiles of one size, one more for an overview.
    """
    sized = tiles.where("x2 > x1 and y2 > y1")
    times = F.greatest((F.col("x2") - F.col("x1")) / width, (F.col("y2") - F.col("y1")) / height, F.lit(1.0))
    sized = sized.withColumn("_level", F.ceil(F.round(F.log2(times), 9)).cast("int"))  # the bucket may be smaller by rounding: one more bucket
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())  # of numbers in 64 bits there are 64 levels at most
    scale = F.pow(F.lit(2.0), "_level")
    covers = lambda low, high, size: F.explode(F.sequence(_bucket(F.col(low), size * scale), F.ceil(F.col(high) / (size * scale)) - 1))
    sized = sized.withColumn("_bx", covers("x1", "x2", width)).withColumn("_by", covers("y1", "y2", height))
    level = F.explode(F.array(*map(F.lit, levels))) if len(levels) != 1 else F.lit(levels[0])
    probing = cells.withColumn("_level", level if levels else F.lit(0))
    probing = probing.withColumns({"_bx": _bucket(F.col("x"), width * scale), "_by": _bucket(F.col("y"), height * scale)})
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    return probing.join(sized, [group, "_level", "_bx", "_by"]).where(inside).drop("_level", "_bx", "_by")


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))  # NaN is larger than all


def _located(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """The rows with two finite coordinates."""
    return df.where(_finite(x) & _finite(y))


def nearest_within(cells: DataFrame, spots: DataFrame, radius: float, group: str = "slide") -> DataFrame:
    """cells with spot_idx and d2 (squared distance) of the nearest spot within the radius, ties to the lower index; null beyond it.

    Repeated rows stay; cells without two finite coordinates get nulls, such spots are nobody's.
    """
    free = "_" * (1 + max(map(len, cells.columns)))  # no column of theirs
    xy = {f"{free}x": F.col("x").cast("double"), f"{free}y": F.col("y").cast("double")}
    places = _located(cells.select(group, "x", "y")).select(group, *[v.alias(c) for c, v in xy.items()])
    sought = places.distinct().withColumns({"bx": _bucket(F.col(f"{free}x"), radius), "by": _bucket(F.col(f"{free}y"), radius)})
    spots = _located(spots).select(group, "spot_idx", F.col("x").cast("double").alias("_sx"), F.col("y").cast("double").alias("_sy"), _bucket(F.col("x"), radius).alias("bx"), _bucket(F.col("y"), radius).alias("by"))
    d2 = (F.col(f"{free}x") - F.col("_sx")) ** 2 + (F.col(f"{free}y") - F.col("_sy")) ** 2
    joined = sought.join(_spread(spots), [group, "bx", "by"]).withColumn("_d2", d2).where(F.col("_d2") <= radius * radius)
    best = joined.groupBy(group, *xy).agg(F.min(F.struct("_d2", "spot_idx")).alias("_best"))
    best = best.select(group, *xy, F.col("_best.spot_idx").alias("spot_idx"), F.col("_best._d2").alias("d2"))
    return cells.withColumns(xy).join(best, [group, *xy], "left").select(*cells.columns, "spot_idx", "d2")  # by the keys of best: it moves no more


def radius_graph(points: DataFrame, radius: float, group: str = "slide", node: str = "cell_id") -> DataFrame:
    """(group, src, dst, d2): both directions of every pair with 0 < distance <= radius."""
    rows = points.select(group, F.col(node).alias("src"), F.col("x"), F.col("y"), _bucket(F.col("x"), radius).alias("bx"), _bucket(F.col("y"), radius).alias("by"))
    other = _spread(rows).select(group, "bx", "by", F.col("src").alias("dst"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    d2 = (F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2
    return rows.join(other, [group, "bx", "by"]).withColumn("d2", d2).where((F.col("d2") > 0) & (F.col("d2") <= radius * radius)).select(group, "src", "dst", "d2")


def _hits(key: np.ndarray, x: np.ndarray, y: np.ndarray, asking: np.ndarray, radius: float, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of every pair with 0 < distance <= radius, i among the asking rows and ascending; rows lie in the order of key, a bucket's number, by which the buckets of a column follow each other."""
    step = BLOCK + 2 * MARGIN + 2
    sides = key[asking][:, None] + np.array([-step, 0, step])
    low, high = np.searchsorted(key, sides - 1, "left").ravel(), np.searchsorted(key, sides + 1, "right").ravel()
    upto = np.concatenate([[0], np.cumsum(high - low)])
    begin = 0
    while begin < len(asking):  # whole rows, one at least
        end = max(begin + 1, int(np.searchsorted(upto[::3], upto[3 * begin] + at_once, "right")) - 1)
        more = (high - low)[3 * begin : 3 * end]
        i = np.repeat(np.repeat(asking[begin:end], 3), more)
        j = np.repeat(high[3 * begin : 3 * end] - np.cumsum(more), more) + np.arange(more.sum())
        d2 = (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2
        near = (d2 > 0) & (d2 <= radius * radius)
        yield i[near], j[near]
        begin = end


def _pooled(rows: pa.RecordBatch, block: np.ndarray, radius: float) -> pa.RecordBatch:
    """(graph, node, vector) of the blocks' own points, as radius_pool says."""
    width = BLOCK + 2 * MARGIN
    lx, ly, x, y = (rows.column(c).to_numpy() for c in ("_lx", "_ly", "_x", "_y"))
    key = (block * (width + 2) + lx + 1) * (width + 2) + ly + 1
    by = np.argsort(key, kind="stable")
    key, lx, ly, x, y = key[by], lx[by], ly[by], x[by], y[by]
    inside = lambda edge: np.nonzero((lx >= edge) & (lx < width - edge) & (ly >= edge) & (ly < width - edge))[0]
    vectors = rows.column("_v").take(pa.array(by))
    known = ~np.asarray(vectors.is_null())
    held = np.stack([np.asarray(v, float) for v in vectors.drop_null().to_numpy(zero_copy_only=False)]) if known.any() else np.zeros((0, 0))
    values = np.zeros((len(by), held.shape[1]))
    values[known] = held
    degree = np.ones(len(by))
    for i, _ in _hits(key, x, y, inside(MARGIN - 1), radius, PAIRS_AT_ONCE):
        if len(i):
            degree[i[0] : i[-1] + 1] += np.bincount(i - i[0])
    weight = 1 / np.sqrt(degree)
    values *= weight[:, None]
    own, sums, told = inside(MARGIN), values.copy(), known.copy()
    for i, j in _hits(key, x, y, own, radius, PAIRS_AT_ONCE // max(1, values.shape[1])):
        i, j = i[known[j]], j[known[j]]
        if len(i):
            first = np.nonzero(np.concatenate([[True], i[1:] != i[:-1]]))[0]
            sums[i[first]] += np.add.reduceat(values[j], first, axis=0)
            told[i[first]] = True
    own = own[told[own]]
    out = (sums[own] * weight[own, None]).ravel()
    at = pa.array(by[own])
    offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * values.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([rows.column("_g").take(at), rows.column("_n").take(at), pa.ListArray.from_arrays(offsets, pa.array(out))], ["_g", "_n", "_v"])


def radius_pool(points: DataFrame, radius: float, group: str = "slide", node: str = "cell_id", vector: str = "features") -> DataFrame:
    """(group, node, vector): graphs.neighbour_mean over the radius graph, without its edges: no pair is a row or is kept.

    Points stand in blocks of BLOCK by BLOCK buckets with a margin of MARGIN buckets round them, so a task knows the
    degrees of all neighbours, too, and every point moves once (2.25 times with the margins). A task takes some blocks at once
    and a bounded number of pairs; it holds a block's points, (BLOCK + 2 * MARGIN)^2 / pi times as many as a point has neighbours.
    Points without two finite coordinates have no neighbours and keep their own vector. Ids are unique in their group.
    """
    rows = points.where(F.col(group).isNotNull() & F.col(node).isNotNull())
    rows = rows.select(F.col(group).alias("_g"), F.col(node).alias("_n"), F.col("x"), F.col("y"), F.col(vector).cast("array<double>").alias("_v"))
    placed = _located(rows).withColumns({"_cx": _bucket(F.col("x"), radius), "_cy": _bucket(F.col("y"), radius)})
    alone = rows.where(~F.coalesce(_finite("x") & _finite("y"), F.lit(False)) & F.col("_v").isNotNull()).select("_g", "_n", "_v")
    blocks = lambda c: F.explode(F.sequence(F.floor((F.col(c) - MARGIN) / BLOCK), F.floor((F.col(c) + MARGIN) / BLOCK)))
    local = lambda c, block: F.col(c) - F.col(block) * BLOCK + MARGIN
    dealt = placed.withColumn("_bx", blocks("_cx")).withColumn("_by", blocks("_cy"))
    dealt = dealt.select("_g", "_bx", "_by", "_n", F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), "_v", local("_cx", "_bx").alias("_lx"), local("_cy", "_by").alias("_ly"))

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(more: bool) -> Iterator[pa.RecordBatch]:
            """Results of what is held, but for the last block if more may follow."""
            rows = pa.concat_batches(held)
            held.clear()
            if not rows.num_rows:
                return
            columns = [np.asarray(rows.column("_g").dictionary_encode().indices), rows.column("_bx").to_numpy(), rows.column("_by").to_numpy()]
            changes = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
            cut = int(np.nonzero(changes)[0][-1]) if more else rows.num_rows
            if cut:
                yield _pooled(rows.slice(0, cut), np.cumsum(changes[:cut]), radius)
            if more:
                held.append(rows.slice(cut))

        enough = POINTS_AT_ONCE
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= enough:
                yield from told(True)
                enough = held[0].num_rows * 2 + POINTS_AT_ONCE if held else POINTS_AT_ONCE
        if held:
            yield from told(False)

    kind = lambda c: rows.schema[c].dataType.simpleString()
    ordered = dealt.repartition("_g", "_bx", "_by").sortWithinPartitions("_g", "_bx", "_by")
    found = ordered.mapInArrow(pooled, f"_g {kind('_g')}, _n {kind('_n')}, _v array<double>").unionByName(alone)
    return found.select(F.col("_g").alias(group), F.col("_n").alias(node), F.col("_v").alias(vector))


def _ranked(pairs: DataFrame, group: str, k: int) -> DataFrame:
    order = Window.partitionBy(group, "src").orderBy("d2", "dst")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_LEAF = ["bits", "ix", "iy"]


def _leaves(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, x, y, ...) with the leaf of their group's quad-tree that holds them, as (bits, ix, iy): the cell (ix, iy) of 2^bits by 2^bits.

    Cells are counted, first at the size that would hold LEAF_POINTS if points were even, then the overfull ones again at a
    quarter of their side, and so on: a dense tile beside empty space gets cells of its own size.
    """
    extent = rows.groupBy(group).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x9"), F.max("y").alias("y9"))
    side = F.greatest(F.col("x9") - F.col("x0"), F.col("y9") - F.col("y0"), F.lit(1e-300))
    even = 2 * F.floor(F.greatest(F.log2(F.col("n") / LEAF_POINTS), F.lit(0.0)) / 4)
    extent = stage(extent.select(F.col(group).alias("_g"), "x0", "y0", side.alias("side"), F.least(even, F.lit(MOST_BITS)).cast("int").alias("bits")), "extents")
    cell = lambda c, low: F.least(F.floor((F.col(c) - F.col(low)) / F.col("side") * F.pow(F.lit(2.0), "bits")), F.pow(F.lit(2.0), "bits").cast("long") - 1)
    celled = lambda df: df.withColumns({"ix": cell("x", "x0"), "iy": cell("y", "y0")})
    waiting, done = rows.join(extent, F.col(group) == F.col("_g")).drop("_g"), []
    while True:
        waiting = stage(celled(waiting), "leaves")
        apart = (F.min("x") < F.max("x")) | (F.min("y") < F.max("y"))  # a heap at one place stays together
        over = waiting.groupBy(group, *_LEAF).agg(F.count("*").alias("n"), apart.alias("apart")).where((F.col("n") > LEAF_POINTS) & (F.col("bits") < MOST_BITS) & F.col("apart"))
        over = stage(over.drop("n", "apart"), "overfull")
        if not over.take(1):
            done.append(waiting)
            break
        done.append(waiting.join(over, [group, *_LEAF], "left_anti"))
        waiting = waiting.join(over, [group, *_LEAF], "left_semi").withColumn("bits", F.col("bits") + 2)
    return functools.reduce(DataFrame.unionByName, done).drop("x0", "y0", "side")


def _boxes(leaves: DataFrame, group: str) -> DataFrame:
    """(group, bits, ix, iy, n, x0, y0, x9, y9) of every leaf: its points and the box round them."""
    return leaves.groupBy(group, *_LEAF).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x9"), F.max("y").alias("y9"))


def _nodes(boxes: DataFrame, group: str) -> DataFrame:
    """Leaves and the nodes above them, every second level, with `leaf`."""
    above = boxes.where("bits > 0").withColumn("up", F.explode(F.sequence(F.lit(2), F.col("bits"), F.lit(2))))
    above = above.withColumns({"bits": F.col("bits") - F.col("up"), "ix": F.call_function("shiftright", F.col("ix"), F.col("up")), "iy": F.call_function("shiftright", F.col("iy"), F.col("up"))})
    above = above.groupBy(group, *_LEAF).agg(F.sum("n").alias("n"), *[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x9", F.max), ("y9", F.max))])
    return boxes.withColumn("leaf", F.lit(True)).unionByName(above.withColumn("leaf", F.lit(False)))


def _gap(low: str, high: str, other_low: str, other_high: str, most: bool) -> Column:
    """Least (or most) distance along an axis between points of two intervals."""
    low, high, other_low, other_high = map(F.col, (low, high, other_low, other_high))
    return F.greatest(high - other_low, other_high - low) if most else F.greatest(other_low - high, low - other_high, F.lit(0.0))


def _reached(pairs: DataFrame, by: list[str], box: tuple[str, str, str, str], need: int) -> DataFrame:
    """pairs of something with a box and a node: without nodes that cannot hold any of the `need` points nearest to any place in the box.

    The nodes of least farthest distance that have `need` points together bound the distance; what begins beyond it goes.
    """
    squared = lambda most: _gap(box[0], box[2], "x0", "x9", most) ** 2 + _gap(box[1], box[3], "y0", "y9", most) ** 2
    pairs = pairs.withColumns({"_near": squared(False), "_far": squared(True)})
    upto = Window.partitionBy(*by).orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumn("_upto", F.sum("n").over(upto)).withColumn("_bound", F.min(F.when(F.col("_upto") >= need, F.col("_far"))).over(Window.partitionBy(*by)))
    return pairs.where(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound") * (1 + 1e-9))).drop("_near", "_far", "_upto", "_bound")


def _few_nearest(q: DataFrame, p: DataFrame, k: int, group: str, exclude_self: bool) -> DataFrame:
    """k_nearest in groups of few points: each group's points are one array that its queries meet, so no pair is ever a row of its own and a task holds one query's distances."""
    lists = p.groupBy(group).agg(F.collect_list(F.struct("dst", "px", "py")).alias("_p"))
    place = lambda c: (F.col("qx") - c["px"]) ** 2 + (F.col("qy") - c["py"]) ** 2
    others = F.filter("_p", lambda c: c["dst"] != F.col("src")) if exclude_self else F.col("_p")
    near = F.slice(F.sort_array(F.transform(others, lambda c: F.struct(place(c).alias("d2"), c["dst"].alias("dst")))), 1, k)
    tasks = min(MOST_TASKS, q.count() // QUERIES_A_TASK + 1)  # by their work, which their bytes do not tell
    rows = q.repartition(tasks, group).join(lists, group).select(group, "src", F.posexplode_outer(near).alias("_at", "_n")).where("_n is not null")  # the outer one makes no filter that sorts again
    return rows.select(group, "src", F.col("_n.dst").alias("dst"), F.col("_n.d2").alias("d2"), (F.col("_at") + 1).alias("rank"))


def k_nearest(queries: DataFrame, points: DataFrame, k: int, group: str = "slide", node: str = "cell_id", exclude_self: bool = True) -> DataFrame:
    """(group, src, dst, d2, rank): the k nearest points of each query in its group, ties to the lower id.

    Points of groups of up to WHOLE_GROUP are compared with all of the group's queries, as one array. In larger ones points and queries stand
    in quad-trees, whose leaves have LEAF_POINTS at most wherever they are dense or sparse. Leaves of queries go down the
    points' tree together, keeping the nodes that can hold a neighbour of any place in their box; then every query picks
    its own among the leaves reached, and only those meet it point by point. Rounds follow the tree's depth, not distances:
    queries far outside take no more. Of points at one place only the k + 1 of the lowest ids are looked at.

    Ids are unique in their group. Queries and points without two finite coordinates take no part.
    """
    double = lambda c: F.col(c).cast("double")
    q = _located(queries.select(group, F.col(node).alias("src"), F.col("x").alias("qx"), F.col("y").alias("qy")), "qx", "qy")
    p = _located(points.select(group, F.col(node).alias("dst"), F.col("x").alias("px"), F.col("y").alias("py")), "px", "py")
    p = p.withColumn("_nth", F.row_number().over(Window.partitionBy(group, "px", "py").orderBy("dst"))).where(F.col("_nth") <= k + 1).drop("_nth")
    d2 = (F.col("qx") - F.col("px")) ** 2 + (F.col("qy") - F.col("py")) ** 2
    other = F.col("src") != F.col("dst") if exclude_self else F.lit(True)
    out = lambda pairs: _ranked(pairs.where(other).select(group, "src", "dst", d2.alias("d2")), group, k)
    sizes = stage(p.groupBy(group).agg((F.count("*") > WHOLE_GROUP).alias("large")), "group-sizes")
    small, large = sizes.where("not large").select(group), sizes.where("large").select(group)
    found = _few_nearest(q.join(small, group, "left_semi"), p.join(small, group, "left_semi"), k, group, exclude_self)
    if not large.take(1):
        return found

    here = _leaves(p.join(large, group, "left_semi").withColumns({"x": double("px"), "y": double("py")}), group)
    nodes = stage(_nodes(_boxes(here, group), group), "nodes")
    there = _leaves(q.join(large, group, "left_semi").withColumns({"x": double("qx"), "y": double("qy")}), group)
    own = [f"q{c}" for c in _LEAF]
    there = there.withColumnsRenamed(dict(zip(_LEAF, own))).drop("x", "y")
    box = there.groupBy(group, *own).agg(F.min("qx").cast("double").alias("qx0"), F.min("qy").cast("double").alias("qy0"), F.max("qx").cast("double").alias("qx9"), F.max("qy").cast("double").alias("qy9"))
    need, corners = k + 1 if exclude_self else k, ("qx0", "qy0", "qx9", "qy9")
    up = lambda c: F.call_function("shiftright", F.col(c), F.lit(2)).alias(c)
    children = nodes.where("bits > 0").select(group, (F.col("bits") - 2).alias("bits"), up("ix"), up("iy"), F.struct(*nodes.columns).alias("child"))
    pairs = box.join(nodes.where("bits = 0"), group)
    while True:
        pairs = stage(pairs, "node-pairs")
        if not pairs.where("not leaf").take(1):
            break
        below = pairs.where("not leaf").select(group, *_LEAF, *own, *corners).join(children, [group, *_LEAF]).select(*own, *corners, "child.*")
        pairs = _reached(pairs.where("leaf").unionByName(below), [group, *own], corners, need)
    place = tuple(map(double, ("qx", "qy")))
    reached = there.join(pairs.drop(*corners), [group, *own]).withColumns({"qx0": place[0], "qy0": place[1]})
    reached = _reached(reached, [group, "src"], ("qx0", "qy0", "qx0", "qy0"), need).select(group, "src", "qx", "qy", *_LEAF)
    return found.unionByName(out(reached.join(here.drop("x", "y"), [group, *_LEAF])))


def knn_graph(points: DataFrame, k: int, group: str = "slide", node: str = "cell_id", dedupe: bool = False) -> DataFrame:
    """(group, src, dst, d2): for each of a point's k nearest both directions, so mutual neighbours appear twice unless deduped."""
    near = stage(k_nearest(points, points, k, group, node).select(group, "src", "dst", "d2"), "neighbours")  # read for both directions
    both = near.unionByName(near.select(group, F.col("dst").alias("src"), F.col("src").alias("dst"), "d2"))
    return both.distinct() if dedupe else both


def radius_else_knn(points: DataFrame, radius: float, k: int = 3, group: str = "tile", node: str = "cell_id") -> DataFrame:
    """The radius graph, and for groups without any edge the kNN graph."""
    edges = stage(radius_graph(points, radius, group, node), "radius-edges")
    lonely = points.join(edges.select(group).distinct(), group, "left_anti")
    return edges.unionByName(knn_graph(lonely, k, group, node))


def nuclei_to_tiles(nuclei: DataFrame, tiles: DataFrame) -> DataFrame:
    """Nuclei whose lattice tile (x1, y1, x2, y2) exists."""
    return nuclei.join(tiles.select("slide", "x1", "y1", "x2", "y2").distinct(), ["slide", "x1", "y1", "x2", "y2"], "left_semi")


def positional_map(cells: DataFrame, spots: DataFrame, group: str = "slide") -> DataFrame:
    """The i-th cell with the i-th spot of its group; null beyond the shorter list."""
    return cells.join(spots.select(group, "row_idx", "spot_idx"), [group, "row_idx"], "left")


def coordinate_range(points: DataFrame, group: str = "slide") -> DataFrame:
    """(group, min_x, max_x, min_y, max_y)."""
    return points.groupBy(group).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))])


def tile_lattice(tiles: DataFrame, group: str = "slide", fallback: int = 512) -> DataFrame:
    """(group, width, height, x0, y0): size of the group's first tile (the fallback where it has none) and the lattice's origin."""
    size = lambda a, b: F.coalesce(F.min_by(F.col(b) - F.col(a), "tile_id"), F.lit(fallback).cast("long"))
    return tiles.groupBy(group).agg(size("x1", "x2").alias("width"), size("y1", "y2").alias("height"), F.min("x1").alias("x0"), F.min("y1").alias("y0"))

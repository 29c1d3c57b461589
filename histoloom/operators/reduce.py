"""One PCA and one k-means for each slide, all slides at once."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from histoloom.functions.vectors import squared_distance
from histoloom.session import stage


#: Bytes of Gram matrices that a task keeps before it sends them on.
KEPT_BYTES = 64 << 20


def vector_sum(column: str, weight: str | None = None) -> Column:
    """Aggregate: the sum of arrays of one length, component by component, combined before it is shuffled."""
    vector = array_to_vector(F.col(column).cast("array<double>"))
    return vector_to_array(Summarizer.sum(vector, F.col(weight)) if weight else Summarizer.sum(vector))


def vector_mean(column: str) -> Column:
    """Aggregate: the mean of arrays of one length."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(column).cast("array<double>"))))


def fit_pca(cells: DataFrame, k: int, group: str = "slide", vector: str = "features") -> DataFrame:
    """(group, component, variance, ratio, mean, axis): the leading min(k, n, d) components of every group, centred.

    Tasks send one sum and one Gram matrix for each group they meet, never cells; Spark adds those of a group up, one by one.
    Groups of zeros only have no variance and give no rows.
    """
    kind = cells.schema[group].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def out() -> pd.DataFrame:
            rows = [(key, n, s, g.ravel()) for key, (n, s, g) in sums.items()]
            sums.clear()
            return pd.DataFrame(rows, columns=[group, "n", "s", "g"])

        for batch in batches:
            for key, rows in batch.groupby(group):
                x = np.stack(rows[vector].to_numpy()).astype(np.float64)
                n, s, g = sums.get(key, (0, 0.0, 0.0))
                sums[key] = (n + len(x), s + x.sum(0), g + x.T @ x)
                if len(sums) * x.shape[1] ** 2 * 8 > KEPT_BYTES:
                    yield out()
        if sums:
            yield out()

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                n, mean = row.n, np.asarray(row.s) / row.n
                d = len(mean)
                values, axes = np.linalg.eigh(np.asarray(row.g).reshape(d, d) / n - np.outer(mean, mean))
                values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
                total = values.sum()
                m = min(k, n, d) if total > 0 else 0
                axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(d)])  # the largest part of an axis is positive
                yield pd.DataFrame({group: row[0], "component": np.arange(m, dtype=np.int32), "variance": values[:m], "ratio": values[:m] / max(total, 1e-300), "mean": [mean] * m, "axis": [axes[:, j] for j in range(m)]})

    rows = cells.select(group, vector).where(F.col(vector).isNotNull()).sortWithinPartitions(group)
    sent = rows.mapInPandas(partial, f"{group} {kind}, n long, s array<double>, g array<double>")
    added = sent.groupBy(group).agg(F.sum("n").alias("n"), vector_sum("s").alias("s"), vector_sum("g").alias("g"))
    return added.mapInPandas(decompose, f"{group} {kind}, component int, variance double, ratio double, mean array<double>, axis array<double>")


def project(cells: DataFrame, model: DataFrame, group: str = "slide", vector: str = "features") -> DataFrame:
    """cells with `projected` in place of their vector."""
    axes = F.transform(F.array_sort(F.collect_list(F.struct("component", "axis"))), lambda c: c["axis"])
    models = model.groupBy(group).agg(F.first("mean").alias("_mean"), axes.alias("_axes"))
    centred = F.zip_with(vector, "_mean", lambda v, m: v.cast("double") - m)
    along = lambda axis: F.aggregate(F.zip_with("_centred", axis, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    joined = cells.join(models, group).withColumn("_centred", centred)
    return joined.withColumn("projected", F.transform("_axes", along)).drop("_centred", "_mean", "_axes", vector)


def explained(model: DataFrame, group: str = "slide") -> DataFrame:
    """(group, component, ratio, cumulative)."""
    upto = Window.partitionBy(group).orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return model.select(group, "component", "ratio", F.sum("ratio").over(upto).alias("cumulative"))


#: Bytes of vectors of one group, in 64-bit numbers, from which its start is fitted inside a task.
SAMPLE_BYTES = 32 << 20


def _seeded(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k places among x, each drawn by its squared distance from those before it, the best of a few draws."""
    chosen = [int(random.integers(len(x)))]
    nearest = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = nearest.sum()
        drawn = random.choice(len(x), 2 + int(np.log(k)), p=nearest / total) if total > 0 else np.setdiff1d(np.arange(len(x)), chosen)[:1]
        after = np.minimum(nearest, ((x[drawn][:, None] - x[None]) ** 2).sum(2))
        best = int(after.sum(1).argmin())
        chosen.append(int(drawn[best]))
        nearest = after[best]
    return x[chosen]


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, ties to the first, and its squared distance."""
    d2 = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1), 0)
    label = d2.argmin(1)
    return label, d2[np.arange(len(x)), label]


#: Rounds of each start where the best one then goes on until it settles.
START_ROUNDS = 20


def _rounds(rounds: int | None) -> Iterator[int]:
    return itertools.count() if rounds is None else iter(range(rounds))


def _settled(x: np.ndarray, centroids: np.ndarray, rounds: int | None) -> tuple[np.ndarray, float]:
    """Centroids after Lloyd's rounds until nothing moves (with rounds None: until no row changes its label), and the loss. Empty clusters keep their centroid."""
    before = None
    for _ in _rounds(rounds):
        label, _ = _nearest(x, centroids)
        if rounds is None and before is not None and (label == before).all():
            break
        before = label
        count = np.bincount(label, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, label, x)
        moved = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
        if rounds is not None and ((moved - centroids) ** 2).sum(1).max() <= 1e-12:
            break
        centroids = moved
    return centroids, float(_nearest(x, centroids)[1].sum())


def kmeans_start(rows: DataFrame, k: int, group: str = "slide", key: str = "cell_id", vector: str = "features", seed: int = 42, starts: int = 10, rounds: int | None = 20) -> DataFrame:
    """(group, label, centroid, whole): the best of `starts` fits of each group's sample; whole: the sample is the whole group.

    The sample are the cells of lowest seeded hash, as many as SAMPLE_BYTES hold, so a task never has more of a group. A group of
    n cells has min(k, n) clusters. rounds None: the best one goes on until it has settled.
    """
    kind = rows.schema[group].dataType.simpleString()
    fits = F.lit(float(SAMPLE_BYTES)) / (8 * F.greatest(F.max(F.size(vector)), F.lit(1)))
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"), fits.alias("_fits"))
    place = F.xxhash64(F.col(key), F.lit(seed))
    share = (F.shiftrightunsigned(place, 11) + 0.5) / float(1 << 53)
    some = rows.join(sizes, rows[group].eqNullSafe(F.col("_g"))).where(share * F.col("_n") < F.col("_fits"))
    some = some.select(group, (F.col("_n") <= F.col("_fits")).alias("whole"), place.alias("place"), F.col(key).alias("key"), vector)

    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["place", "key"])
        x = np.stack(cells[vector].to_numpy()).astype(np.float64)
        random = np.random.default_rng(seed)
        best = min((_settled(x, _seeded(x, min(k, len(x)), random), START_ROUNDS if rounds is None else rounds) for _ in range(starts)), key=lambda fitted: fitted[1])[0]
        if rounds is None:
            best = _settled(x, best, None)[0]
        return pd.DataFrame({group: [cells[group].iloc[0]] * len(best), "label": np.arange(len(best), dtype=np.int32), "centroid": list(best), "whole": bool(cells["whole"].iloc[0])})

    return some.groupBy(group).applyInPandas(fit, f"{group} {kind}, label int, centroid array<double>, whole boolean")


def kmeans(cells: DataFrame, k: int = 7, group: str = "slide", key: str = "cell_id", vector: str = "features", seed: int = 42, rounds: int | None = 20, starts: int = 10) -> DataFrame:
    """cells with `label`: the best of several k-means++ starts for every group, then Lloyd's rounds over all its cells.

    Starts are fitted in tasks, on a sample of bounded size of each group (kmeans_start). Groups that are larger than their
    sample go on from there with all their cells, all of them together, in a job a round; the others have settled already. A
    single cell has label 0. Centroids are a table joined on the group, never sent through the driver. rounds None: as many as it takes
    until nothing moves; every round lowers the loss, so there is an end.
    """
    rows = stage(cells.where(F.col(vector).isNotNull()), "kmeans-cells")
    centroids = stage(kmeans_start(rows, k, group, key, vector, seed, starts, rounds), "centroids")

    def assigned(rows: DataFrame, centroids: DataFrame) -> DataFrame:
        table = centroids.groupBy(F.col(group).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("_c"))  # k entries
        nearest = F.array_min(F.transform("_c", lambda c: F.struct(squared_distance(F.col(vector), c["centroid"]).alias("d2"), c["label"].alias("label"))))
        return rows.join(table, rows[group].eqNullSafe(F.col("_g"))).withColumn("label", nearest["label"]).drop("_c", "_g")

    done, moving = centroids.where("whole"), centroids.where("not whole").drop("whole")
    open_ = moving.select(F.col(group).alias("_o")).distinct()
    if moving.take(1):
        large = rows.join(open_, rows[group].eqNullSafe(F.col("_o")), "left_semi")
        least = 1e-24 if rounds is None else 1e-12
        for _ in _rounds(rounds):
            moved = assigned(large, moving).groupBy(F.col(group).alias("_g"), F.col("label").alias("_l")).agg(vector_mean(vector).alias("moved"))
            after = moving.join(moved, moving[group].eqNullSafe(F.col("_g")) & (F.col("label") == F.col("_l")), "left").select(group, "label", "centroid", F.coalesce("moved", "centroid").alias("after"))
            went, seen = squared_distance(F.col("after"), F.col("centroid")) > least, Observation()
            after = after.withColumn("went", went).observe(seen, F.max("went").alias("went"))
            moving = stage(after.select(group, "label", F.col("after").alias("centroid")), "centroids")
            if not seen.get["went"]:
                break
    return assigned(rows, done.select(group, "label", "centroid").unionByName(moving.select(group, "label", "centroid")))

"""Scores of predicted against measured expression over a long table (sample_id, gene, pred, target)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoloom.operators.ordering import number_rows
from histoloom.session import stage

#: Variance under which a gene or spot has no correlation, and standard deviation under which a sample has none.
LEAST_VARIANCE, LEAST_STD, EPSILON = 1e-8, 1e-12, 1e-12


def mse(one: str = "pred", two: str = "target") -> Column:
    """Mean squared error."""
    return F.avg((F.col(one) - F.col(two)) * (F.col(one) - F.col(two)))


def pearson(one: str = "pred", two: str = "target", least_variance: float = 0.0) -> Column:
    """Pearson correlation; null where either population variance is not above the bound."""
    a, b = F.var_pop(one), F.var_pop(two)
    return F.when((a > least_variance) & (b > least_variance), F.try_divide(F.covar_pop(one, two), F.sqrt(a) * F.sqrt(b)))


def overall(scores: DataFrame) -> DataFrame:
    """One row: mse and pearson over all values, and their number."""
    return scores.agg(mse().alias("mse"), pearson().alias("pearson"), F.count("*").alias("n"))


def per_group(scores: DataFrame, *keys: str) -> DataFrame:
    """mse and pearson for each gene, spot or other key."""
    return scores.groupBy(*keys).agg(mse().alias("mse"), pearson(least_variance=LEAST_VARIANCE).alias("pearson"))


def sample_pearson(scores: DataFrame) -> DataFrame:
    """(sample_id, pearson); null if either standard deviation is under 1e-12."""
    return scores.groupBy("sample_id").agg(pearson(least_variance=LEAST_STD**2).alias("pearson"))


def _js_term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.ln((p + EPSILON) / (m + EPSILON))).otherwise(0.0)


def js_divergence(scores: DataFrame, sample: str = "sample_id", clip: bool = False) -> DataFrame:
    """(sample, js): Jensen-Shannon divergence of pred and target as shares of their sums. clip: negative values count 0."""
    whole = Window.partitionBy(sample)
    value = (lambda c: F.greatest(F.col(c), F.lit(0.0))) if clip else F.col
    rows = scores.withColumns({"_p": value("pred") / (F.sum(value("pred")).over(whole) + EPSILON), "_q": value("target") / (F.sum(value("target")).over(whole) + EPSILON)})
    p, q = F.col("_p"), F.col("_q")
    m = (p + q) / 2
    return rows.groupBy(sample).agg(((F.sum(_js_term(p, m)) + F.sum(_js_term(q, m))) / 2).alias("js"))


#: Samples of a block where pairs are formed block by block, at most, and bytes of a block's vectors.
BLOCK_SAMPLES, BLOCK_BYTES = 1024, 32 << 20
#: Tasks that pairs of blocks are dealt out to, at most.
MOST_TASKS = 2000


def _in_blocks(samples: DataFrame, sample: str, size: int) -> tuple[DataFrame, int]:
    """(sample, _block) of the distinct samples in their order, and the number of blocks."""
    rows, n = number_rows(samples.select(sample).distinct().where(F.col(sample).isNotNull()), sample, name="_nth")
    return rows.select(sample, F.floor(F.col("_nth") / size).cast("int").alias("_block")), -(-n // size)


def all_pairs(samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """(one, two): each unordered pair of samples once. The pairs are the result; use mean_pairwise_pearson where only their mean is asked for.

    Samples stand in blocks, and blocks meet by number, so no row is compared with all others. Pairs of blocks are few bytes and
    many results, so they are dealt out by a number of their own. What one row is exploded to is held in memory as rows, so the
    blocks' samples come one by one to the second explode (a coalesce to as many tasks parts the two).
    """
    rows, blocks = _in_blocks(samples, sample, BLOCK_SAMPLES)
    lists = rows.groupBy("_block").agg(F.collect_list(sample).alias("_ids"))
    ones = lists.select(F.col("_ids").alias("_ones"), F.explode(F.sequence("_block", F.lit(max(blocks, 1) - 1))).alias("_block"))
    tasks = max(1, min(MOST_TASKS, blocks * (blocks + 1) // 2))
    dealt = ones.join(lists, "_block").repartition(tasks, F.monotonically_increasing_id())
    pairs = dealt.select("_ids", F.explode("_ones").alias("one")).coalesce(tasks)
    return pairs.select("one", F.explode("_ids").alias("two")).where("one < two")


def mean_pairwise_pearson(values: DataFrame, value: str = "value") -> DataFrame:
    """One row: mean correlation over all pairs of samples, and the number of samples that vary; null under two.

    For centred vectors z of unit norm, the pairs' products sum to (|sum z|^2 - n) / 2, so no pair is ever formed.
    """
    whole = Window.partitionBy("sample_id")
    centred = values.withColumn("_c", F.col(value) - F.avg(value).over(whole)).withColumn("_n", F.sqrt(F.sum(F.col("_c") * F.col("_c")).over(whole)))
    unit = centred.where(F.col("_n") > 0).withColumn("_z", F.col("_c") / F.col("_n"))
    by_gene = unit.groupBy("gene").agg(F.sum("_z").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("s2"))
    n = unit.agg(F.count_distinct("sample_id").alias("samples"))
    pairs = F.col("samples") * (F.col("samples") - 1)
    return by_gene.crossJoin(n).select(F.try_divide(F.col("s2") - F.col("samples"), pairs.cast("double")).alias("mean_pearson"), "samples")


def _js_rows(p: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence of rows of shares from others, over the entries that both have (absent ones are NaN)."""
    m = (p + others) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda x: np.where(x > 0, x * np.log((x + EPSILON) / (m + EPSILON)), 0.0 * m)  # noqa: E731  NaN stays
        return (np.nansum(np.where(np.isnan(m), np.nan, term(p)), axis=1) + np.nansum(np.where(np.isnan(m), np.nan, term(others)), axis=1)) / 2


#: Rows of a block that meet another block at once, and a divergence under which a pair is computed term by term.
TILE_ROWS, LEAST_JS = 64, 1e-9


def _js_matrix(ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
    """_js_rows of each row of ones from each of twos; NaN where they have no entry in common.

    The divergence is half the sum of both sides' x log x less that of their mean's, so a pair takes one logarithm an entry.
    Nearly equal rows, of which that leaves rounding errors alone, are computed term by term.
    """
    out = np.empty((len(ones), len(twos)))
    has_two = ~np.isnan(twos)
    two = np.where(has_two, twos, 0.0)
    own_two, two = two * np.log(two + EPSILON), np.ascontiguousarray(two.T)
    for k in range(0, len(ones), TILE_ROWS):
        has, tile = ~np.isnan(ones[k : k + TILE_ROWS]), out[k : k + TILE_ROWS]
        one = np.where(has, ones[k : k + TILE_ROWS], 0.0)
        tile[:] = ((one * np.log(one + EPSILON)) @ has_two.T.astype(float) + has.astype(float) @ own_two.T) / 2
        for g in range(ones.shape[1]):
            if whole := has[:, g].all() and has_two[:, g].all():
                m = np.add.outer(one[:, g], two[g])
            else:
                rows, columns = np.nonzero(has[:, g])[0], np.nonzero(has_two[:, g])[0]
                m = np.add.outer(one[rows, g], two[g, columns])
            m *= 0.5
            m *= np.log(m + EPSILON)
            if whole:
                tile -= m
            else:
                tile[np.ix_(rows, columns)] -= m
        if not (has.all() and has_two.all()):
            tile[has.astype(float) @ has_two.T.astype(float) == 0] = np.nan
    a, b = np.nonzero(out < LEAST_JS)
    for k in range(0, len(a), 4096):
        some = a[k : k + 4096], b[k : k + 4096]
        out[some] = _js_rows(ones[some[0]], twos[some[1]])
    return out


def _js_blocks(values: DataFrame, value: str, found: Callable[[np.ndarray, np.ndarray, np.ndarray, bool], pd.DataFrame], schema: str) -> DataFrame:
    """What `found` makes of (samples of one block, of the other, their divergences, whether it is one block), for every two blocks.

    Samples stand in blocks of dense vectors; every two blocks meet in one task, to which each vector is sent once, so no join
    goes by gene and a task holds two blocks. Pairs that do not count are NaN.
    """
    whole = Window.partitionBy("sample_id")
    clipped = F.greatest(F.col(value), F.lit(0.0))
    shares = stage(values.select("sample_id", "gene", (clipped / (F.sum(clipped).over(whole) + EPSILON)).cast("double").alias("p")), "shares")
    genes, width = number_rows(shares.select("gene").distinct(), "gene", name="_at")
    size = max(1, min(BLOCK_SAMPLES, BLOCK_BYTES // (8 * max(1, width))))
    rows, blocks = _in_blocks(shares, "sample_id", size)
    vectors = shares.join(genes, "gene").groupBy("sample_id").agg(F.collect_list(F.struct("_at", "p")).alias("_v"))
    vectors = vectors.join(rows, "sample_id").select("sample_id", "_block", F.col("_v._at").alias("at"), F.col("_v.p").alias("p"))
    dealt = vectors.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    dealt = dealt.select(F.least("_block", "_other").alias("_one"), F.greatest("_block", "_other").alias("_two"), "_block", "sample_id", "at", "p")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample_id", ignore_index=True)
        dense = np.full((len(rows), width), np.nan)
        for k, (at, p) in enumerate(zip(rows["at"], rows["p"])):
            dense[k, at] = p
        block, ids = rows["_block"].to_numpy(), rows["sample_id"].to_numpy()
        ones, twos = np.nonzero(block == rows["_one"].iloc[0])[0], np.nonzero(block == rows["_two"].iloc[0])[0]
        alike = rows["_one"].iloc[0] == rows["_two"].iloc[0]
        js = _js_matrix(dense[ones], dense[twos])
        if alike:
            np.fill_diagonal(js, np.nan)
        return found(ids[ones], ids[twos], js, alike)

    # few bytes and much work: blocks are dealt out over tasks of their own number
    tasks = max(1, min(MOST_TASKS, blocks * (blocks + 1) // 2))
    return dealt.repartition(tasks, "_one", "_two").groupBy("_one", "_two").applyInPandas(compare, schema)


def pairwise_js(values: DataFrame, value: str = "value", top: int | None = None) -> DataFrame:
    """(one, two, js) of every pair of samples that have genes in common, values clipped at 0 and taken as shares, over the genes that both have.

    top: for each sample (as `one`) its `top` nearest others (ties to the lower sample) with rank; tasks then send only their own
    nearest on. js_summary is for those who ask for no single pair.
    """

    def every(ones: np.ndarray, twos: np.ndarray, js: np.ndarray, alike: bool) -> pd.DataFrame:
        a, b = np.nonzero(~np.isnan(np.where(np.tri(*js.shape, dtype=bool), np.nan, js) if alike else js))  # samples are in order
        return pd.DataFrame({"one": ones[a], "two": twos[b], "js": js[a, b]})

    def nearest(ones: np.ndarray, twos: np.ndarray, js: np.ndarray) -> pd.DataFrame:
        held = np.where(np.isnan(js), np.inf, js)
        last = min(top, held.shape[1]) - 1
        a, b = np.nonzero((held <= np.partition(held, last, axis=1)[:, last : last + 1]) & (held < np.inf))
        by = np.lexsort((b, js[a, b], a))
        a, b = a[by], b[by]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        a, b = a[nth < top], b[nth < top]
        return pd.DataFrame({"one": ones[a], "two": twos[b], "js": js[a, b]})

    def nearest_of_both(ones: np.ndarray, twos: np.ndarray, js: np.ndarray, alike: bool) -> pd.DataFrame:
        one = nearest(ones, twos, js)
        return one if alike else pd.concat([one, nearest(twos, ones, np.ascontiguousarray(js.T))])

    kind = values.schema["sample_id"].dataType.simpleString()
    pairs = _js_blocks(values, value, every if top is None else nearest_of_both, f"one {kind}, two {kind}, js double")
    if top is None:
        return pairs
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("one").orderBy("js", "two"))).where(F.col("rank") <= top)


def js_summary(values: DataFrame, value: str = "value") -> DataFrame:
    """One row over all pairs of pairwise_js: pairs, mean_js, min_js, max_js. Tasks add up the pairs of their blocks, so none becomes a row."""

    def added(ones: np.ndarray, twos: np.ndarray, js: np.ndarray, alike: bool) -> pd.DataFrame:
        held = js[np.triu_indices(len(js), 1)] if alike else js
        held = held[~np.isnan(held)]
        return pd.DataFrame({"n": [len(held)], "sum": [held.sum()], "min": [held.min()], "max": [held.max()]} if len(held) else {"n": [], "sum": [], "min": [], "max": []})

    parts = _js_blocks(values, value, added, "n long, sum double, min double, max double")
    n = F.coalesce(F.sum("n"), F.lit(0).cast("long"))
    return parts.agg(n.alias("pairs"), (F.sum("sum") / F.sum("n")).alias("mean_js"), F.min("min").alias("min_js"), F.max("max").alias("max_js"))


def summary(metrics: DataFrame, *columns: str) -> DataFrame:
    """(name, mean, median, std, min, max) of metric columns; 0 where there is no value."""
    rows = metrics.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m")).select("m.*")
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return rows.groupBy("name").agg(zero(F.avg("v"), "mean"), zero(F.median("v"), "median"), zero(F.stddev_pop("v"), "std"), zero(F.min("v"), "min"), zero(F.max("v"), "max"))


def histogram(metrics: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal bins between least and most; the upper end belongs to the last bin."""
    ends = metrics.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    rows = metrics.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends))
    width = (F.col("b") - F.col("a")) / bins
    rows = rows.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("a"), width), F.lit(0.0)))).cast("int"))
    return rows.groupBy("bin", "a", "b").agg(F.count("*").alias("n")).select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), "n")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 500):
        for even in (True, False):
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if even else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def pearson_p(r: float, n: int) -> float:
    """Two-sided p value of a correlation over n pairs."""
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    a = b = n / 2 - 1
    x = (1 - abs(r)) / 2
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tail = front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b
    return min(1.0, 2 * tail)


def overall_with_p(scores: DataFrame) -> DataFrame:
    """overall with p_value; the one row's scalar is the only thing that Python sees."""

    @F.udf("double")
    def p_value(r: float | None, n: int) -> float | None:
        return None if r is None else pearson_p(r, n)

    return overall(scores).withColumn("p_value", p_value("pearson", "n"))


def early_stop(epochs: DataFrame, key: str, metric: str, patience: int, min_delta: float = 0.0, warmup: int = 0, maximise: bool = False) -> DataFrame:
    """(key, best_epoch, best, stop_epoch): the sequential stopping rule over epochs (from 1).

    A value counts as better by more than min_delta only. Epochs under `warmup` do not count against patience. stop_epoch is null if patience lasts.
    """
    sign = -1.0 if maximise else 1.0
    runs = epochs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("epoch", (F.col(metric) * sign).alias("m")))).alias("e"))
    state = lambda best, best_epoch, waited, stop: F.struct(best.alias("best"), best_epoch.alias("best_epoch"), waited.alias("waited"), stop.alias("stop"))
    start = state(F.lit(float("inf")), F.lit(None).cast("int"), F.lit(0), F.lit(None).cast("int"))

    def step(s: Column, e: Column) -> Column:
        better = e["m"] < s["best"] - min_delta
        waited = F.when(better, 0).otherwise(s["waited"] + F.when(e["epoch"] >= warmup, 1).otherwise(0))
        after = state(F.when(better, e["m"]).otherwise(s["best"]), F.when(better, e["epoch"].cast("int")).otherwise(s["best_epoch"]), waited, F.when(waited >= patience, e["epoch"].cast("int")))
        return F.when(s["stop"].isNotNull(), s).otherwise(after)

    return runs.select(key, F.aggregate("e", start, step).alias("s")).select(key, "s.best_epoch", (F.col("s.best") * sign).alias("best"), F.col("s.stop").alias("stop_epoch"))


def epoch_log(history: DataFrame, key: str, *lists: str) -> DataFrame:
    """(key, epoch, columns): lists of per-epoch values side by side, null where a list is shorter."""
    return history.select(key, F.posexplode(F.arrays_zip(*lists)).alias("at", "z")).select(key, (F.col("at") + 1).alias("epoch"), *[F.col(f"z.{c}").alias(c) for c in lists])


def fold_best(epochs: DataFrame, *metrics: str) -> DataFrame:
    """(fold, best_<metric>): most over the epochs of a fold."""
    return epochs.groupBy("fold").agg(*[F.max(m).alias(f"best_{m}") for m in metrics])


def top_genes(scores: DataFrame, k: int = 5) -> DataFrame:
    """(sample_id, rank, gene, pred) of the k highest predictions of each sample, ties by gene."""
    order = Window.partitionBy("sample_id").orderBy(F.desc("pred"), "gene")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("sample_id", "rank", "gene", "pred")

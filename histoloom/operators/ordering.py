"""Global row numbers, ordered splits and folds without a single-task window."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoloom.session import stage


def number_rows(df: DataFrame, *order: Column | str, name: str = "row_idx") -> tuple[DataFrame, int]:
    """(df with row numbers from 0 in the order of the columns, number of rows).

    Range-partitioned and sorted, with the row's source position as last key so that equal keys need not share a task;
    partition bases come from the prefix sums of partition counts.
    """
    free = "_" * (1 + max(map(len, df.columns), default=0))  # longer than any name of theirs
    at, part, inside, base, n = (free + x for x in ("at", "part", "in", "base", "n"))
    placed = df.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(*order, at).sortWithinPartitions(*order, at).drop(at)
    placed = placed.withColumns({part: F.spark_partition_id(), inside: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = stage(placed, "numbered")
    counts = placed.groupBy(part).agg(F.count("*").alias(n))  # a row for each partition
    before = F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(counts.select(part, before.alias(base)))
    return placed.join(bases, part).withColumn(name, F.col(base) + F.col(inside)).drop(part, inside, base), placed.count()


#: Groups up to which their first row numbers are broadcast; beyond it the join shuffles, and splits a group that is too large.
BROADCAST_GROUPS = 1_000_000


def number_within(df: DataFrame, group: str | list[str], *order: Column | str, name: str = "row_idx") -> DataFrame:
    """df with row numbers from 0 inside each group, in the order of the columns.

    Rows are numbered over all groups, in ranges of (group, order), and lose the first number of their group; so no task
    holds a group, and one with a third of all rows is spread over as many tasks. Null groups are groups.
    """
    keys = [group] if isinstance(group, str) else group
    free = "_" * (1 + max(map(len, [*df.columns, name]), default=0))
    numbered, _ = number_rows(df, *keys, *order, name=free)
    firsts = numbered.groupBy(*keys).agg(F.min(free).alias(f"{free}first"))
    firsts = stage(firsts.select(*[F.col(c).alias(f"{free}{k}") for k, c in enumerate(keys)], f"{free}first"), "first-rows")
    if firsts.count() <= BROADCAST_GROUPS:
        firsts = F.broadcast(firsts)
    same = functools.reduce(Column.__and__, [numbered[c].eqNullSafe(F.col(f"{free}{k}")) for k, c in enumerate(keys)])
    joined = numbered.join(firsts, same)
    return joined.select(*[c for c in df.columns if c != name], (F.col(free) - F.col(f"{free}first")).alias(name))


#: Rows of a block of running sums.
BLOCK_ROWS = 1 << 16


def running_sums(df: DataFrame, group: str | list[str], order: list[Column | str], value: str, name: str = "before") -> DataFrame:
    """df with the sum of a whole-numbered column over the rows before, inside each group, in the order of the columns.

    Rows are numbered over all groups and summed up in blocks of BLOCK_ROWS; the blocks' own sums are a small table. What all groups
    before a group add up to is taken off at the end, so no task holds a group. Null values count as 0.
    """
    keys = [group] if isinstance(group, str) else group
    free = "_" * (1 + max(map(len, [*df.columns, name]), default=0))
    at, block, v, upto, base = (free + x for x in ("at", "block", "v", "upto", "base"))
    numbered, _ = number_rows(df.withColumn(v, F.coalesce(F.col(value), F.lit(0)).cast("long")), *keys, *order, name=at)
    numbered = numbered.withColumn(block, F.floor(F.col(at) / BLOCK_ROWS))
    of_block = numbered.groupBy(block).agg(F.sum(v).alias(v))
    before = F.coalesce(F.sum(v).over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_block = stage(of_block.select(block, before.alias(base)), "block-sums")  # a row for each BLOCK_ROWS
    inside = F.sum(v).over(Window.partitionBy(block).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)) - F.col(v)
    summed = stage(numbered.withColumn(upto, inside).join(of_block, block).withColumn(upto, F.col(upto) + F.col(base)).drop(block, base, v), "running-sums")
    firsts = summed.groupBy(*[F.col(c).alias(f"{free}{k}") for k, c in enumerate(keys)]).agg(F.min_by(upto, at).alias(base))
    firsts = stage(firsts, "first-sums")
    same = functools.reduce(Column.__and__, [summed[c].eqNullSafe(F.col(f"{free}{k}")) for k, c in enumerate(keys)])
    joined = summed.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_GROUPS else firsts, same)
    return joined.select(*[c for c in df.columns if c != name], (F.col(upto) - F.col(base)).alias(name))


def seeded(key: str, seed: int) -> Column:
    """A key's place in a seeded order that other engines can compute, too."""
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def k_folds(samples: DataFrame, order: Column | str, folds: int = 10) -> DataFrame:
    """samples with fold (from 0): contiguous chunks of at most `folds`, the first ones one longer."""
    free = "_" * (1 + max(map(len, samples.columns), default=0))  # no name of theirs
    numbered, n = number_rows(samples, order, name=free)
    k = max(1, min(folds, n))
    size, longer = divmod(n, k)
    row, edge = F.col(free), longer * (size + 1)
    fold = F.when(row < edge, F.floor(row / (size + 1))).otherwise(longer + F.floor((row - edge) / max(1, size)))
    return numbered.withColumn("fold", fold.cast("int")).drop(free)


def leave_one_out(samples: DataFrame, order: Column | str) -> DataFrame:
    """samples with a fold of its own for each."""
    return number_rows(samples, order, name="fold")[0].withColumn("fold", F.col("fold").cast("int"))


#: Folds up to which their list is broadcast.
BROADCAST_FOLDS = 10_000


def fold_roles(folds: DataFrame, sample: str = "sample_id", single_is_both: bool = True) -> DataFrame:
    """(fold, sample, role): every sample in every fold, as test in its own and as train in the others; a single sample is both, if asked for.

    The product of folds and samples is the result itself. The list of folds is broadcast up to BROADCAST_FOLDS; a longer one
    (leave-one-out) is dealt out in blocks that every sample meets one by one.
    """
    every = stage(folds.select("fold").distinct(), "folds")
    own = folds.select(F.col("fold").alias("_own"), sample)
    if (n := every.count()) <= BROADCAST_FOLDS:
        rows = F.broadcast(every).crossJoin(own)
    else:
        blocks = -(-n // BROADCAST_FOLDS)
        block = F.pmod(F.xxhash64("fold"), F.lit(blocks)).alias("_block")
        lists = every.groupBy(block).agg(F.collect_list("fold").alias("_folds"))  # BROADCAST_FOLDS each, about
        rows = own.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(lists, "_block")
        rows = rows.select(F.explode("_folds").alias("fold"), "_own", sample)
    roles = rows.withColumn("role", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train")).drop("_own")
    if not single_is_both:
        return roles
    single = folds.agg(F.count("*").alias("n")).where("n = 1").select(F.lit("train").alias("role"))
    return roles.unionByName(folds.select("fold", sample).crossJoin(F.broadcast(single)))


def fixed_folds(samples: DataFrame, plan: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Roles by a given plan (fold, sample): test where the plan names the sample, train where another fold does. Folds without train samples are left out."""
    named = plan.join(samples.select(sample).distinct(), sample, "left_semi")
    roles = fold_roles(named, sample, single_is_both=False)
    trained = roles.where("role = 'train'").select("fold").distinct()
    return roles.join(trained, "fold", "left_semi")


def split_rows(df: DataFrame, key: str, seed: int = 42, train_share: float = 0.8) -> DataFrame:
    """df with split: the first int(share * n) keys in seeded order are train, so no key stands on both sides."""
    free = "_" * (1 + len(key))
    keys, n = number_rows(df.select(key).distinct(), seeded(key, seed), key, name=free)
    return df.join(keys.select(key, F.when(F.col(free) < int(train_share * n), "train").otherwise("test").alias("split")), key)


def first_seen(df: DataFrame, key: list[str], row: str, name: str) -> DataFrame:
    """df with a dense id of its key in order of first appearance."""
    free = "_" * (1 + max(map(len, [*df.columns, name]), default=0))
    ids, _ = number_rows(df.groupBy(*key).agg(F.min(row).alias(free)), free, name=name)
    return df.join(ids.drop(free), key)


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Each value at its first position."""
    return df.groupBy(value).agg(F.min(position).alias(position))


def first_items(df: DataFrame, *order: Column | str, n: int = 10) -> DataFrame:
    """The first n rows in the order of the columns: a limit that is the feature (slides of a trial run, a preview)."""
    return df.orderBy(*order).limit(n)


def least_difference(df: DataFrame, group: str, level: str, value: str, wanted: float) -> DataFrame:
    """(group, level): of each group's levels the one whose value is nearest to the wanted one, ties to the lower level."""
    return df.groupBy(group).agg(F.min_by(level, F.struct(F.abs(F.col(value) - wanted), level)).alias(level))


def union_of_splits(splits: dict[str, DataFrame], name: str = "split") -> DataFrame:
    """The rows of all splits, by column name, with the split's name beside them."""
    parts = [df.withColumn(name, F.lit(key)) for key, df in splits.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Each combination of the columns once."""
    return df.select(*columns).distinct()

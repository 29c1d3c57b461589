"""Reproducible global shuffle and sharding by a Feistel permutation with cycle walking.

Rows get global numbers in (doc_id, content) order. A keyed permutation of 0..n-1 sends number r to place p; p's shard is
p mod shards and its slot p div shards, so shard sizes differ by one row at most. Any row's shard and slot can be computed
from its number alone, and the inverse permutation gives the number that stands at a shard and slot.

Defined cases: null doc_ids sort first; rows equal in all columns are numbered side by side in any order; null text has no
bytes and the checksum of an empty string; texts of any length are digested whole; an empty table gives no rows; further
columns are carried, but for row_number, shard and slot, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoloom.operators.ordering import number_rows

ROUNDS = 8


def _mix(half: np.ndarray, key: np.uint64) -> np.ndarray:
    """A 64-bit mixing step (multiply and xor-shift with odd constants) as the round function."""
    x = (half + key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _keys(seed: int) -> np.ndarray:
    return np.random.SeedSequence(seed).generate_state(ROUNDS, np.uint64)


def permute(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Places of row numbers under a permutation of 0..n-1 that seed and n decide, or numbers of places."""
    bits = max(2, int(n - 1).bit_length())
    # An odd width has halves that differ by one bit; sides are fixed, so rounds alternate between them.
    low_bits = np.uint64(bits // 2)
    low_mask, high_mask = np.uint64((1 << (bits // 2)) - 1), np.uint64((1 << (bits - bits // 2)) - 1)
    keys = list(enumerate(_keys(seed)))

    def once(x: np.ndarray) -> np.ndarray:
        low, high = x & low_mask, x >> low_bits
        for k, key in reversed(keys) if inverse else keys:
            if k % 2:
                low = low ^ (_mix(high, key) & low_mask)
            else:
                high = high ^ (_mix(low, key) & high_mask)
        return (high << low_bits) | low

    out = once(numbers.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():  # walks the cycle; the domain is under twice n, so half of them end each time
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def shard_rows(df: DataFrame, shards: int, seed: int, order: list[str]) -> DataFrame:
    """df with row_number, shard and slot (gapless from 0 in each shard)."""
    numbered, n = number_rows(df, *order, name="row_number")

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    at = "_" * (1 + max(map(len, df.columns))) + "place"  # longer than any name of theirs
    placed = numbered.withColumn(at, place("row_number"))
    return placed.withColumns({"shard": (F.col(at) % shards).cast("int"), "slot": F.floor(F.col(at) / shards)}).drop(at)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The global number of the row at a shard and slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def with_digests(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8 more) and text_crc32 of every document; texts themselves go no further."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long"), (F.octet_length(data) + F.lit(8)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))

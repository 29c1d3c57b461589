"""A caller's rows as one column, so that helper columns cannot clash with theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "_row"


def packed(df: DataFrame) -> DataFrame:
    """One column, a struct of all columns of df."""
    return df.select(F.struct(*[df[quoted(c)] for c in df.columns]).alias(ROW))


def field(name: str) -> Column:
    """A column of the packed row."""
    return F.col(ROW).getField(name)


def unpacked(df: DataFrame, schema: T.StructType, **replaced: Column) -> DataFrame:
    """The caller's columns again, some of them (or further ones) replaced."""
    own = [replaced.pop(c) if c in replaced else field(c) for c in schema.names]
    return df.select(*[c.alias(n) for c, n in zip(own, schema.names)], *[c.alias(n) for n, c in replaced.items()])


def quoted(name: str) -> str:
    """The name as Spark reads it, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"

"""Helpers on whole DataFrames."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark 4.1 lets a union claim its inputs' partitioning. Under adaptive execution the inputs may then differ in their
#: number of partitions (an error) or in which of them holds a key (split groups). Off, a union claims nothing.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def union_all(*frames: DataFrame) -> DataFrame:
    """The rows of all frames, columns matched by name."""
    frames[0].sparkSession.conf.set(UNION_PARTITIONING, "false")
    return reduce(DataFrame.unionByName, frames)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row, however often they are used: projections in a row are merged and
    would repeat them at each use; no projection is merged through a generator, here one of a single row."""
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], made)


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by columns of one name in which null is a value like any other; left's columns stand for both."""
    own = right.select(*[F.col(f"`{c}`").alias(f"right {c}" if c in on else c) for c in right.columns])
    same = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"`right {c}`")) for c in on])
    return left.join(own, same, how).drop(*[f"right {c}" for c in on])


#: Rows of a side that may be broadcast: some 100 MB of short rows. Beyond, joins shuffle.
MOST_BROADCAST_ROWS = 1 << 20


def is_small(df: DataFrame) -> bool:
    """Whether df has few enough rows to be broadcast: they are counted, up to the bound."""
    return df.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS


def beside(few: DataFrame, many: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """many joined with few short rows of them, hits say: while these can be broadcast, many's rows stay where they lie.
    few is read twice, so it should be a table that is kept."""
    return many.join(F.broadcast(few) if is_small(few) else few, on, how)

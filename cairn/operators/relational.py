"""Joins and limits that Spark lacks as one call, composed of its own operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank. The rank filter is pushed below the shuffle by Spark."""
    own = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, take: Sequence[str]) -> DataFrame:
    """Each left row with `take` of the last right row of its key at or before it, or nulls.

    One shuffle on the key and one sort: both sides go through the same window, and no pairs are made.
    """
    found = F.struct(*[F.col(c) for c in take])
    kind = right.select(found.alias("x")).schema["x"].dataType
    one = left.select(*left.columns, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_take"))
    other = right.select(*[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(right_on).alias("_at"), F.lit(0).alias("_side"), found.alias("_take"))
    own = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(other).withColumn("_last", F.last("_take", ignorenulls=True).over(own)).where("_side = 1")
    return both.select(*left.columns, *[F.col(f"_last.{c}").alias(c) for c in take])


def range_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, width: int) -> DataFrame:
    """Pairs of a key with left.at < right.at <= left.at + width, columns with l_ and r_ in front.

    Time is cut into cells of the width, and each left row looks in two of them, so the join is on equality.
    """
    cell = F.floor(F.col(at) / width).cast("long")
    a = left.withColumn("_cell", F.explode(F.array(cell, cell + 1)))
    b = right.withColumn("_cell", cell)
    a = a.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], "_cell")
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.col("_cell").alias("_other"))
    same = F.col("_cell") == F.col("_other")
    for c in by:
        same = same & (F.col(f"l_{c}") == F.col(f"r_{c}"))
    inside = (F.col(f"r_{at}") > F.col(f"l_{at}")) & (F.col(f"r_{at}") <= F.col(f"l_{at}") + width)
    return a.join(b, same & inside).drop("_cell", "_other")

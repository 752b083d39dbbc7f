"""Sketches that merge: the k smallest hashes of a group's values give the number of different ones.

With the k-th smallest of hashes spread evenly over [0, 1) at h, about (k - 1) / h different values were seen; the standard error is about
1 / sqrt(k - 2). Sketches of parts merge into that of the whole, exactly. Fewer than k different values are counted exactly.

Results for odd input: null values are not counted; a group of nulls has the count 0; a null key is a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hashes have 60 bits: 15 digits of an MD5.
BITS = 60


def hashed(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def _smallest(hashes: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(F.col("_h").asc_nulls_last())
    # at most k hashes of a group
    return hashes.distinct().withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list("_h")).alias("sketch"))


def kmv(rows: DataFrame, keys: Sequence[str], value: str, k: int = 1024) -> DataFrame:
    """keys and sketch, the k smallest hashes in order."""
    return _smallest(rows.select(*keys, hashed(F.col(value)).alias("_h")), keys, k)


def merged(sketches: DataFrame, keys: Sequence[str], k: int = 1024) -> DataFrame:
    """One sketch for each group, of any number of them."""
    return _smallest(sketches.select(*keys, F.explode_outer("sketch").alias("_h")), keys, k)


def distinct(sketch: Column, k: int = 1024) -> Column:
    """The estimated number of different values, rounded."""
    full = (k - 1) * float(1 << BITS) / F.element_at(sketch, -1)
    return F.when(F.size(sketch) < k, F.size(sketch)).otherwise(F.round(full)).cast("long")

"""What several corpus operators share: words, work tables, running totals that no single task has to compute.

Policy for repeated rows, followed by every operator here: rows that repeat a doc_id are told apart by their text,
and wholly equal rows get equal results.
"""

from __future__ import annotations

import math
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one, which only a
    local master can share (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cairn.work.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("cairn.work.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_work: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside are deleted as soon as a write is done; what was written does not need them."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them again."""
    spark, path = df.sparkSession, work_path(df.sparkSession, label)
    schema = df.schema
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _work[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete work tables that `saved` returned; all that is made of them must be written by then."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(_work.pop(t))
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text, none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def running(df: DataFrame, group: list[str], place: str, value: str, ties: list[str], rows: int) -> DataFrame:
    """Add `start`, the sum of `value` over the rows of the group that stand before a row, and `before`, their number.

    place: a column of non-negative 60-bit integers spread evenly (a hash); rows stand in its order, then by `ties`.
    A group may hold any share of all rows: it is cut into slices of the range of `place`, slices are summed on the
    map side, and only the small table of slice sums is accumulated per group. `rows`: about how many rows there are;
    it sets the number of slices so that one holds about 4096 rows.
    """
    bits = min(24, max(0, math.ceil(math.log2(max(rows, 1) / 4096))))
    cut = df.withColumn("_slice", F.shiftright(F.col(place), 60 - bits) if bits else F.lit(0).cast("long"))
    by = [*group, "_slice"]
    sums = cut.groupBy(*by).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows0"))
    same = F.lit(True)
    left, right = cut.alias("l"), sums.alias("r")
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    own = Window.partitionBy(*[F.col(c) for c in by]).orderBy(place, *ties)
    joined = left.join(right, same).select("l.*", "r._sum0", "r._rows0")
    return (
        joined.withColumn("start", F.col("_sum0") + F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
        .withColumn("before", F.col("_rows0") + F.row_number().over(own) - 1)
        .drop("_slice", "_sum0", "_rows0")
    )


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 19, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has at most `rows` rows and `limit` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if (held and held + n > limit) or i - first == rows:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += int(n)
    if first < batch.num_rows:
        yield batch.slice(first)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each text's values, added up in their order, so that equal texts have equal sums wherever they stand; at: where
    each text's begin (one more entry than texts)."""
    return np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), values, len(at) - 1)


def sampled(labelled: DataFrame, rows: int) -> DataFrame:
    """About `rows` of the rows, or all if there are fewer, chosen by a hash of doc_id: the same on every run."""
    n = labelled.count()
    return labelled if n <= rows else labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * rows / n))

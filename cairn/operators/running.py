"""Running aggregates that merge: count, mean, sum of squared distances, least and largest value of each group.

Parts of the rows are aggregated each on their own and merged by Chan's rule: with n rows of mean m in each part and M the mean of
all, the squared distances add up to the parts' own plus n (m - M)^2. So any split of the rows, in any order, gives the result of
all rows at once, and no sum of squares of large numbers is ever taken.

A stream keeps its state as one small table for each micro-batch, in a folder that driver and executors share: batch b writes version b
from version b - 1, so a batch that is run again writes the same version again.

Results for odd input: null values are not counted; a group whose values are all null has count 0 and no mean; a null key is a
group; without rows there are no groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

PARTS = ("count", "mean", "m2", "minimum", "maximum")


def partial(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The aggregate of some rows: keys, dimension (the name of the value), count, mean, m2, minimum and maximum."""
    pairs = F.array(*[F.struct(F.lit(v).alias("dimension"), F.col(v).cast("double").alias("value")) for v in values])
    long = rows.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.dimension", "_p.value")
    n = F.count("value")
    return long.groupBy(*keys, "dimension").agg(n.alias("count"), F.avg("value").alias("mean"), F.coalesce(F.var_pop("value") * n, F.lit(0.0)).alias("m2"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One aggregate for each group and dimension, of any number of partial ones."""
    own = Window.partitionBy(*keys, "dimension")
    whole = F.sum(F.col("count") * F.col("mean")).over(own) / F.nullif(F.sum("count").over(own), F.lit(0))
    apart = F.col("m2") + F.coalesce(F.col("count") * F.pow(F.col("mean") - F.col("_mean"), 2), F.lit(0.0))
    return parts.withColumn("_mean", whole).groupBy(*keys, "dimension").agg(F.sum("count").alias("count"), F.first("_mean").alias("mean"), F.sum(apart).alias("m2"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"))


def snapshot(parts: DataFrame, keys: Sequence[str], digits: int = 4) -> DataFrame:
    """keys, dimension, count and, rounded, mean, minimum, maximum, variance (of a sample; 0 for one row) and stdev."""
    variance = F.when(F.col("count") > 1, F.col("m2") / (F.col("count") - 1)).otherwise(0.0)
    return parts.select(*keys, "dimension", "count", *[F.round(c, digits).alias(c) for c in ("mean", "minimum", "maximum")], F.round(variance, digits).alias("variance"), F.round(F.sqrt(variance), digits).alias("stdev"))


def _version(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/state-{number:012d}"


def state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last whole version of a stream's aggregate, None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    names = sorted(f.getPath().getName() for f in system.listStatus(path) if f.getPath().getName().startswith("state-"))
    whole = [n for n in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{folder.rstrip('/')}/{whole[-1]}") if whole else None


def maintained(stream: DataFrame, keys: Sequence[str], values: Sequence[str], folder: str, **trigger: object) -> StreamingQuery:
    """Keep the aggregate of a stream in `folder`; progress is kept there too, so a restart goes on where the last one ended."""
    folder = folder.rstrip("/")

    def step(batch: DataFrame, number: int) -> None:
        parts = partial(batch, keys, values)
        if number:
            parts = parts.unionByName(batch.sparkSession.read.parquet(_version(folder, number - 1)))
        merged(parts, keys).write.mode("overwrite").parquet(_version(folder, number))
        # two versions stay, so that a batch can be run again
        old = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(_version(folder, number - 2))
        old.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()

"""Metric samples as rows, and their text form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, label: str, value: str, bounds: Sequence[float]) -> DataFrame:
    """label, le, bucket (rows at or under the bound), n and total: one pass, whatever the number of bounds."""
    counts = [F.count(F.when(F.col(value) <= b, 1)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    grouped = rows.groupBy(label).agg(*counts, F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    buckets = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("bucket")) for i, b in enumerate(bounds)])
    return grouped.select(label, F.explode(buckets).alias("_x"), "n", "total").select(label, "_x.le", "_x.bucket", "n", "total")


def escaped(value: Column) -> Column:
    """A label's value: backslash, quote and line feed in their written forms."""
    for sign, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        value = F.replace(value, F.lit(sign), F.lit(written))
    return value


def exposition(samples: DataFrame, name: str, kind: str, help_text: str, *labels: str) -> DataFrame:
    """place and line: HELP and TYPE first, then a line for each sample. Samples stay rows, however many there are."""
    if kind not in ("counter", "gauge", "histogram", "summary", "untyped"):
        raise ValueError(f"unknown kind {kind!r}")
    pairs = [F.concat(F.lit(f'{c}="'), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"')) for c in labels]
    label = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if labels else F.lit("")
    lines = samples.select(F.lit(2).alias("place"), F.concat(F.lit(name), label, F.lit(" "), F.col("value").cast("string")).alias("line"))
    written = help_text.replace("\\", "\\\\").replace("\n", "\\n")
    head = samples.sparkSession.createDataFrame([(0, f"# HELP {name} {written}"), (1, f"# TYPE {name} {kind}")], "place int, line string")
    return head.unionByName(lines)

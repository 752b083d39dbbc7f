"""Trees as rows of id and parent: what is left of a tree when some nodes are selected."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import work_dir


def above(nodes: DataFrame, selected: DataFrame, deepest: int = 1000) -> DataFrame:
    """start and id: each selected node with itself and every node above it.

    Each round joins the parents of what the last one found and adds them to a work table (in `work_dir`), so a tree's depth, not its
    size, sets the number of rounds, and any number of rows may be found. Near the root many rows share a few parents: these few
    nodes are cut out first, and Spark sends them to the rows.
    """
    spark = nodes.sparkSession
    folder = f"{work_dir(spark)}/tree-{uuid.uuid4().hex}"
    wanted = selected.select(F.lower("id").alias("_low")).where("_low IS NOT NULL").distinct()
    nodes.select("id", "parent").where("id IS NOT NULL").distinct().write.parquet(f"{folder}/edges")
    edges = spark.read.parquet(f"{folder}/edges")
    seeds = edges.withColumn("_low", F.lower("id")).join(wanted, "_low", "left_semi")
    seeds.select(F.col("id").alias("start"), "id", "parent").write.parquet(f"{folder}/up/round=0")
    schema = spark.read.parquet(f"{folder}/up/round=0").schema
    for number in range(1, deepest + 2):
        last = spark.read.schema(schema).parquet(f"{folder}/up/round={number - 1}").where("parent IS NOT NULL").select("start", F.col("parent").alias("_at"))
        if last.isEmpty():
            break
        if number > deepest:
            raise ValueError(f"recursion has not ended after {deepest} rounds: a cycle, or a deeper tree")
        few = edges.join(last.select("_at").distinct(), F.col("id") == F.col("_at"), "left_semi")
        last.join(few, F.col("id") == F.col("_at")).select("start", "id", "parent").write.parquet(f"{folder}/up/round={number}")
    return spark.read.schema(schema).parquet(f"{folder}/up/*").select("start", "id").distinct()


def kept(nodes: DataFrame, selected: DataFrame, deepest: int = 1000) -> DataFrame:
    """The rows of nodes (id, parent, any others) that a selection (id) reaches: the selected ones and all above them.

    Ids of the selection count in any case.

    Results for odd input: a null parent, or one that is no node, ends the way up; nodes that repeat an id are all kept or all left out;
    cycles end after `deepest` rounds with an error; an empty selection keeps nothing.
    """
    return nodes.join(above(nodes, selected, deepest).select("id").distinct(), "id", "left_semi")


def pruned(nodes: DataFrame, selected: DataFrame, deepest: int = 1000) -> DataFrame:
    """The kept nodes with chosen (whether the selection names the node itself) and below (how many chosen nodes it holds, itself
    left out)."""
    own = F.col("start") == F.col("id")
    counted = above(nodes, selected, deepest).groupBy("id").agg(F.bool_or(own).alias("chosen"), F.count_if(~own).alias("below"))
    return nodes.join(counted, "id")


def missing(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected ids that no node has."""
    return selected.select(F.lower("id").alias("id")).where("id IS NOT NULL").distinct().join(nodes.select(F.lower("id").alias("id")), "id", "left_anti")

"""Minimum-cost-flow resharding: move the fewest bytes from old shards to shards of new capacities, then rewrite.

A shard is a folder of block files, each a run of the shard's hashed order; a document's slot is its place in that order.
The flow is solved on the driver over shard sizes only; its size is the number of shards, never of documents. The flows
cut each old shard's order into runs, one for each new shard, of which the documents that stay come first; so blocks
before the cut are not touched, and only blocks with documents that move are read and written anew. A document goes where
the middle of its bytes lies, so a shard misses its capacity by less than a document for each run.

Results for odd input: a null text has size 1 and crc 0; equal rows are separate documents; a null doc_id is a value
like any other; a null old shard, or one out of range, counts as shard 0; columns of any name are kept, as the files hold
each document as one struct; an empty table gives empty shards.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import work_path

#: Bytes of text in a block file, and the blocks that a shard has at least, so that a cut spares most of a small shard too.
BLOCK_BYTES, LEAST_BLOCKS = 128 << 20, 16


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], cost: Sequence[Sequence[int]]) -> dict[tuple[int, int], int]:
    """Flows (i, j) -> units that carry all supply to demand at the least cost, by successive shortest paths.

    Total supply must not exceed total demand. Costs are at least 0. Work grows with the number of shards only.
    """
    if sum(supply) > sum(demand):
        raise ValueError("the new shards cannot hold the old ones")
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(demand)
    n, m = len(left), len(room)
    while any(left):
        # shortest distances from all old shards with something left; old shard i is node i, new shard j is node n + j
        far = [0 if i < n and left[i] else float("inf") for i in range(n + m)]
        came: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] + cost[i][j] < far[n + j]:
                        far[n + j], came[n + j], changed = far[i] + cost[i][j], i, True
                    if flow.get((i, j)) and far[n + j] - cost[i][j] < far[i]:
                        far[i], came[i], changed = far[n + j] - cost[i][j], n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: far[n + j]) + n
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        arcs = list(zip(path, path[1:]))
        units = min([left[path[0]], room[end - n], *(flow[(b, a - n)] for a, b in arcs if a >= n)])
        for a, b in arcs:
            key = (a, b - n) if a < n else (b, a - n)
            flow[key] = flow.get(key, 0) + (units if a < n else -units)
        left[path[0]] -= units
        room[end - n] -= units
    return {k: v for k, v in flow.items() if v}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


@dataclass(frozen=True)
class Layout:
    """Shards on disk: path/shard=N/block=B, with doc (a struct), size, text_crc32, slot and start (bytes before it)."""

    path: str
    sizes: tuple[int, ...]
    schema: StructType

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


@dataclass(frozen=True)
class Resharded:
    """The old layout, what was written anew, and each old shard's first block that was; earlier blocks are still good."""

    old: Layout
    path: str
    first_moved: tuple[int, ...]
    flow: dict[tuple[int, int], int]

    def rows(self, spark: SparkSession) -> DataFrame:
        """doc, size, text_crc32, shard and slot of all documents in their new shards."""
        names = ["doc", "size", "text_crc32", "slot", "shard"]
        good = self.old.rows(spark).where(F.col("block") < _by_shard(self.first_moved)).select(*names)
        moved = StructType([f for f in self.old.schema.fields if f.name in names])
        return good.unionByName(spark.read.schema(moved).parquet(self.path).select(*names))


def _by_shard(values: Sequence[int]) -> Column:
    """A shard's value; as it needs partition columns only, filters on it prune files."""
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard"))


def lay_out(docs: DataFrame, old: Column, shards: int, path: str | None = None, block_bytes: int = BLOCK_BYTES, least_blocks: int = LEAST_BLOCKS) -> Layout:
    """Write documents as shards 0 to shards - 1. The text is shuffled once, by shard and block."""
    spark, path = docs.sparkSession, path or work_path(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.when((old >= 0) & (old < shards), old.cast("int"))
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(number, F.lit(0)).alias("shard"),
        F.shiftrightunsigned(F.xxhash64("doc_id", text), 4).alias("_place"),
    )
    have = {r["shard"]: r["bytes"] for r in named.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    sizes = tuple(have.get(i, 0) for i in range(shards))
    bits = min(24, max(math.ceil(math.log2(least_blocks)), math.ceil(math.log2(max(1, max(sizes) / block_bytes)))))
    cut = named.withColumn("block", F.shiftright("_place", 60 - bits))
    own = Window.partitionBy("shard", "block").orderBy("_place", "size", "text_crc32")
    within = cut.withColumn("_rank", F.row_number().over(own)).withColumn("_bytes", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # sums over blocks: a row for each block, however many documents there are
    sums = cut.groupBy("shard", "block").agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows0"))
    placed = within.join(sums, ["shard", "block"]).select(
        "doc", "size", "text_crc32", (F.col("_rows0") + F.col("_rank") - 1).alias("slot"), (F.col("_sum0") + F.col("_bytes") - F.col("size")).alias("start"), "shard", "block"
    )
    placed.write.partitionBy("shard", "block").parquet(path)
    return Layout(path, sizes, placed.schema)


def reshard(spark: SparkSession, old: Layout, shards: int = 8, *, capacities: Sequence[int] | None = None, path: str | None = None) -> Resharded:
    """Solve the transfers to shards of the given capacities (bytes; near-equal ones if not given) and write what moves.

    Only small columns of the old files are read to find the cuts, and texts only of the blocks with moving documents.
    """
    path = path or work_path(spark, "resharded")
    room = list(capacities) if capacities is not None else even_capacities(sum(old.sizes), shards)
    cost = [[int(i != j) for j in range(len(room))] for i in range(len(old.sizes))]
    flow = min_cost_flow(old.sizes, room, cost)
    runs, at, stay = [], [0] * len(old.sizes), [0] * len(old.sizes)
    # what stays comes first; the order of the others does not matter
    for i, j in sorted(flow, key=lambda k: (k[0], k[0] != k[1], k[1])):
        runs.append((i, j, at[i], at[i] + flow[i, j]))
        at[i] += flow[i, j]
        if i == j:
            stay[i] = at[i]
    middle = F.col("start") + F.floor(F.col("size") / 2)
    # at most one run for each flow: the number of shards bounds this table
    bounds = F.broadcast(spark.createDataFrame(runs, "shard int, to int, lo long, hi long"))
    inside = (middle >= F.col("lo")) & (middle < F.col("hi"))
    small = old.rows(spark).select("shard", "block", "size", "start", "slot").join(bounds, "shard").where(inside)
    counts = {(r["shard"], r["to"]): r for r in small.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("first"), F.min("block").alias("block")).collect()}
    fill = [counts[j, j]["n"] if (j, j) in counts else 0 for j in range(len(room))]
    base = []
    for i, j, lo, hi in runs:
        if (run := counts.get((i, j))) is not None:
            base.append((i, j, lo, hi, 0 if i == j else fill[j] - run["first"]))
            fill[j] += 0 if i == j else run["n"]
    moving = [min((r["block"] for (a, j), r in counts.items() if a == i and a != j), default=1 << 40) for i in range(len(old.sizes))]
    bounds = F.broadcast(spark.createDataFrame(base, "shard int, to int, lo long, hi long, base long"))
    moved = old.rows(spark).where(F.col("block") >= _by_shard(moving)).join(bounds, "shard").where(inside)
    moved.select("doc", "size", "text_crc32", (F.col("slot") + F.col("base")).alias("slot"), F.col("to").alias("shard")).write.partitionBy("shard").parquet(path)
    return Resharded(old, path, tuple(moving), flow)

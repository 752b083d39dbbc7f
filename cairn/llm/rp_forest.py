"""Approximate nearest neighbours by inner product: a forest of random-projection trees, one shared priority queue for
each query, and exact reranking of the rows in the leaves it reaches.

The trees are fitted on a bounded sample (`SAMPLE_ROWS` vectors with the smallest hashes); every vector is put in its leaf
of each tree. A tree splits a node's sample at the median of its projection on the difference of two of its members, so
dense regions get more leaves. One queue for each query holds the leaves of all trees in the order of the sum of the squared
margins by which it misses splits on the way; how many it takes is measured on the sample, for a recall of TARGET. The trees hold the vectors with one more coordinate that makes all lengths equal, by which the
largest inner product is the smallest angle; scores are inner products of the vectors as given, in double precision.

Results for odd input: vectors that are null, zero, or hold nulls or non-finite numbers take no part, as rows or as
queries; vectors of one length are compared with each other only; equal vectors stay apart by
their ids; with fewer candidates than k all are returned; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

SAMPLE_ROWS = 16_384
TREES = 3
#: Rows that a leaf is meant to hold.
LEAF_ROWS = 128
#: The share of the nearest that a query is to reach, as measured on TRIALS rows of the sample; it sets how many leaves are
#: opened. Evenly spread vectors need most of them, clustered ones few.
TARGET, TRIALS = 0.95, 256
#: Rows that one task holds at a time, and the least number of such groups, so that small indexes keep all cores busy.
GROUP_ROWS, LEAST_GROUPS = 65_536, 24
K = 20


@dataclass(frozen=True)
class Tree:
    """Splits in heap order: the children of node i are 2i + 1 and 2i + 2; all leaves have the same depth."""

    normals: np.ndarray
    offsets: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(int(math.log2(len(self.offsets) + 1))):
            right = np.einsum("ij,ij->i", x, self.normals[node]) > self.offsets[node]
            node = 2 * node + 1 + right
        return node - len(self.offsets)


def grow(sample: np.ndarray, depth: int, seed: int) -> Tree:
    rng = np.random.default_rng(seed)
    splits = (1 << depth) - 1
    normals, offsets = np.zeros((splits, sample.shape[1])), np.zeros(splits)
    members: dict[int, np.ndarray] = {0: np.arange(len(sample))}
    for node in range(splits):
        own = members.pop(node)
        normal = np.zeros(sample.shape[1])
        for _ in range(8):
            if len(own) > 1:
                a, b = rng.choice(own, 2, replace=False)
                normal = sample[a] - sample[b]
            if normal.any():
                break
        else:
            normal = rng.normal(size=sample.shape[1])
        normal /= np.linalg.norm(normal)
        at = sample[own] @ normal
        cut = float(np.median(at)) if len(own) else 0.0
        normals[node], offsets[node] = normal, cut
        right = at > cut
        members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return Tree(normals, offsets)


def missed(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    """What each query misses each leaf of all trees by: the sum of the squared margins of the splits that it lies beyond."""
    out = []
    for tree in forest:
        margins = x @ tree.normals.T - tree.offsets
        cost = np.zeros((len(x), 1))
        at = 0
        while at < len(tree.offsets):
            level = margins[:, at : at + cost.shape[1]]
            far = level * level
            left, right = cost + np.where(level > 0, far, 0), cost + np.where(level > 0, 0, far)
            at += cost.shape[1]
            cost = np.stack([left, right], axis=2).reshape(len(x), -1)
        out.append(cost)
    return np.hstack(out)


def reached(forest: list[Tree], x: np.ndarray, leaves: int) -> np.ndarray:
    """The leaves (numbered through all trees) that each query's queue yields first, in that order.

    One queue holds the leaves of all trees; its order is what a query misses them by, ties in the order of their numbers.
    """
    cost = missed(forest, x)
    return np.argsort(cost, axis=1, kind="stable")[:, :leaves]


def calibrated(forest: list[Tree], sample: np.ndarray, vectors: np.ndarray, k: int, target: float) -> int:
    """How many leaves a query has to open so that a share `target` of the k nearest is reached, measured on the sample.

    sample: as the trees see it; vectors: as given. Up to TRIALS rows of the sample are the queries.
    """
    n = len(sample)
    if n < 2:
        return 1
    trial = np.linspace(0, n - 1, min(n, TRIALS)).astype(int)
    near = vectors[trial] @ vectors.T
    near[np.arange(len(trial)), trial] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, n - 1)]
    asked = np.hstack([vectors[trial] / np.linalg.norm(vectors[trial], axis=1, keepdims=True), np.zeros((len(trial), 1))])
    order = np.argsort(np.argsort(missed(forest, asked), axis=1, kind="stable"), axis=1)
    count = len(forest[0].offsets) + 1
    homes = np.stack([t * count + tree.leaves(sample) for t, tree in enumerate(forest)])
    first = np.min([np.take_along_axis(order, home[best], axis=1) for home in homes], axis=0)
    return int(np.quantile(first, target, method="higher")) + 1


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector takes part."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0))


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors with one more coordinate, so that angles rank inner products with unit queries."""
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Group:
    """The rows of some leaves, leaf after leaf."""

    def __init__(self, held: list[pa.RecordBatch]) -> None:
        leaf = np.concatenate([h.column("leaves").flatten().to_numpy() for h in held])
        order = np.argsort(leaf, kind="stable")
        self.matrix = np.concatenate([_matrix(h.column("x")) for h in held])[order]
        ids = [i for h in held for i in h.column("ids").to_pylist()]
        sizes = np.array([len(i) for i in ids])[order]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.ids = np.concatenate([np.asarray(ids[i], np.int64) for i in order])
        self.leaf, self.begin = np.unique(leaf[order], return_index=True)
        self.end = np.append(self.begin[1:], len(leaf))

    def best(self, who: np.ndarray, q: np.ndarray, opened: pa.Array, k: int) -> pa.RecordBatch:
        """The k best ids of the group for each query, of the leaves that it opens; ties to smaller ids."""
        leaf, owner = opened.flatten().to_numpy(), pc.list_parent_indices(opened).to_numpy()
        order = np.argsort(leaf, kind="stable")
        leaf, owner = leaf[order], owner[order]
        pairs = []
        for number, lo, hi in zip(self.leaf, self.begin, self.end):
            asking = owner[np.searchsorted(leaf, number) : np.searchsorted(leaf, number, side="right")]
            if not len(asking):
                continue
            near = q[asking] @ self.matrix[lo:hi].T
            if hi - lo > k + 1:
                least = np.partition(near, -(k + 1), axis=1)[:, -(k + 1)]
                rounding = 1e-9 * np.abs(near).max(axis=1)
                query, entry = np.nonzero(near >= (least - rounding)[:, None])
            else:
                query, entry = (i.ravel() for i in np.indices(near.shape))
            pairs.append((asking[query], lo + entry))
        if not pairs:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["query_id", "vec_id", "score"])
        query, entry = (np.concatenate(x) for x in zip(*pairs))
        # the score proper, in one order of summation wherever the pair meets
        score = (q[query] * self.matrix[entry]).sum(axis=1)
        many = self.first[entry + 1] - self.first[entry]
        pair = np.repeat(np.arange(len(entry)), many)
        ids = self.ids[self.first[entry][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)]
        query, score = query[pair], score[pair]
        other = np.flatnonzero(ids != who[query])
        order = other[np.lexsort([ids[other], -score[other], query[other]])]
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[place < k]
        return pa.RecordBatch.from_arrays([pa.array(who[query[order]]), pa.array(ids[order]), pa.array(score[order])], names=["query_id", "vec_id", "score"])


def search(rows: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found rows of each query, itself left out.

    rows and queries: columns vec_id and embedding. Vectors of each length have a forest of their own, and meet no others; there
    are taken to be few different lengths.
    """
    size = F.size("embedding")
    lengths = sorted(r[0] for r in usable(rows.select(F.col("embedding").cast("array<double>").alias("embedding")), "embedding").select(size).distinct().collect())
    if len(lengths) < 2:
        return _of_one_length(rows, queries.where(size == lengths[0]) if lengths else queries, k, trees, target)
    found = [_of_one_length(rows.where(size == n), queries.where(size == n), k, trees, target) for n in lengths]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _of_one_length(rows: DataFrame, queries: DataFrame, k: int, trees: int, target: float) -> DataFrame:
    """The search among vectors of one length. Rows are read once and go through one shuffle for all trees."""
    spark = rows.sparkSession
    kind = rows.schema["vec_id"].dataType.simpleString()
    good = usable(rows.select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x").withColumn("_h", F.xxhash64("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    stats = good.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).first()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if not stats["n"]:
        return spark.createDataFrame([], schema)
    # equal vectors share one entry with the k + 1 smallest ids; found in two steps, as one vector may be very common
    small = Window.partitionBy("_h", "x", "_part").orderBy("vec_id")
    least = good.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("_r", F.row_number().over(small)).where(F.col("_r") <= k + 1)
    entries = least.groupBy("_h", "x").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    entries = saved(entries, "ann-entries")
    n = entries.count()
    sample = _matrix(entries.orderBy("_h").limit(SAMPLE_ROWS).select("x").toPandas()["x"])
    width, longest = sample.shape[1], float(stats["longest"])
    depth = max(0, min(int(math.log2(max(1, len(sample) // 16))), math.ceil(math.log2(max(1, n / LEAF_ROWS)))))
    lifted, leaves = _lifted(sample, longest), 1 << depth
    forest = [grow(lifted, depth, seed) for seed in range(trees)]
    opened = calibrated(forest, lifted, sample, k, target)
    # leaves in a row share a task; one that outgrows what a task should hold is cut into parts, which queries all visit
    parts = max(1, round(n / leaves / GROUP_ROWS))
    per_group = max(1, trees * leaves // max(LEAST_GROUPS, math.ceil(trees * n / GROUP_ROWS)))
    model = spark.sparkContext.broadcast(forest)  # bounded by the sample

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _lifted(_matrix(b.column("x")), longest)
            part = b.column("_h").to_numpy() % parts
            for t, tree in enumerate(model.value):
                leaf = t * leaves + tree.leaves(x)
                group = leaf // per_group * parts + part
                none = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(group), none, pa.array(leaf[:, None].tolist(), pa.list_(pa.int64())), b.column("ids"), b.column("x")], names=names)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query goes once to each group that holds leaves that it opens, with their numbers."""
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                x = _matrix(piece.column("x"))
                unit = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
                found = np.sort(reached(model.value, unit, opened), axis=1)
                who, group, lists = [], [], []
                for q, own in enumerate(found):
                    cuts = np.flatnonzero(np.diff(own // per_group)) + 1
                    for some in np.split(own, cuts):
                        who += [q] * parts
                        group += [int(some[0]) // per_group * parts + p for p in range(parts)]
                        lists += [some.tolist()] * parts
                ids = pa.nulls(len(who), pa.list_(pa.int64()))
                taken = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), piece.column("query_id").take(taken), pa.array(lists, pa.list_(pa.int64())), ids, piece.column("x").take(taken)], names=names)

    names = ["group", "query_id", "leaves", "ids", "x"]
    laid = "group long, query_id long, leaves array<long>, ids array<long>, x array<double>"
    asked = usable(queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("x")), "x")
    fit_entries = entries.select("_h", F.col("ids").cast("array<long>").alias("ids"), "x")
    both = fit_entries.mapInArrow(put, laid).unionByName(asked.mapInArrow(probe, laid))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Group after group, its rows before its queries; a group may reach over several batches."""
        now, held, group = None, [], None
        for b in batches:
            number = b.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if number[lo] != now:
                    now, held, group = number[lo], [], None
                piece = b.slice(lo, hi - lo)
                rows_here = int(piece.column("query_id").null_count)
                if rows_here:
                    held.append(piece.slice(0, rows_here))
                    group = None
                tail = piece.slice(rows_here)
                if not tail.num_rows or not held:
                    continue
                if group is None:
                    group = Group(held)
                for at in range(0, tail.num_rows, 256):
                    some = tail.slice(at, 256)
                    yield group.best(some.column("query_id").to_numpy(), _matrix(some.column("x")), some.column("leaves"), k)

    met = both.repartition("group").sortWithinPartitions("group", F.col("query_id").asc_nulls_first())
    found = met.mapInArrow(rerank, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind), "score")

"""Hard negatives for anchors: rows of another label whose score lies in a window below that of a row of the same label.

Vectors become whole numbers, floor(scale x), and a score is the inner product of two of them. For each anchor the first `positives`
other rows of its label are its positives; for each positive, the first `negatives` rows of other labels with
low * positive_score <= 100 * score <= high * positive_score. Higher scores come first, ties go to the smaller vec_id.

1. Product quantisation: vectors are cut into pairs of numbers; each pair has up to CENTRES whole-number centres, fitted on a sample of at
   most SAMPLE_ROWS vectors for all lengths together. A row keeps a code and, rounded up, the norm of what is left over for each pair.
2. A table of products of an anchor with all centres gives a score for the coded row by looking up; the true score lies within the sum
   of |anchor pair| * left-over norm of it (Cauchy-Schwarz). A row whose upper bound is below the lower bounds of enough others, or whose
   bounds miss the window, cannot be in the result; nothing else is left out.
3. The exact whole-number products of the rows that are left decide, and complete each window.

Anchors go in batches to all parts of the rows; each part returns its best for each window only.

Results for odd input: rows without a vec_id, a label or a vector, or with a null or non-finite component, take no part; vectors
of one length are compared with each other only, empty ones have the score 0; rows with the anchor's vec_id are not its partners; anchors
that repeat a vec_id are told apart by label and vector, and equal ones are one; other rows that repeat a vec_id all count;
fewer partners than asked for are all returned; an empty table gives an empty result. Scores must fit into 63 bits, else there is
an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, saved

SAMPLE_ROWS = 4096
CENTRES, ROUNDS, WIDTH = 256, 6, 2
PACK_ROWS, BATCH_ANCHORS, SLICE = 4096, 512, 64
#: About as many rows as one part holds.
PART_ROWS = 32_768


def _pairs(x: np.ndarray) -> np.ndarray:
    """Rows, pairs, the two numbers of each pair."""
    if x.shape[1] % WIDTH:
        x = np.hstack([x, np.zeros((len(x), WIDTH - x.shape[1] % WIDTH), x.dtype)])
    return x.reshape(len(x), x.shape[1] // WIDTH, WIDTH)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each row the nearest centre."""
    c = centres.astype(np.float64)
    return np.argmin((c * c).sum(axis=1) - 2.0 * (x.astype(np.float64) @ c.T), axis=1)


def fit(sample: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Centres of each pair: k-means from different members of the sample, rounded to whole numbers."""
    rng = np.random.default_rng(seed)
    out = []
    for own in np.moveaxis(_pairs(sample), 1, 0):
        centres = np.unique(own, axis=0)
        if len(centres) > CENTRES:
            centres = centres[rng.choice(len(centres), CENTRES, replace=False)].astype(np.float64)
            for _ in range(ROUNDS):
                near = _nearest(own, centres)
                many = np.bincount(near, minlength=CENTRES)
                sums = np.stack([np.bincount(near, own[:, j], minlength=CENTRES) for j in range(WIDTH)], axis=1)
                centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
            centres = np.unique(np.rint(centres).astype(np.int64), axis=0)
        out.append(centres)
    return out


class Pack:
    """Rows of one length: ids, labels, whole-number vectors, codes and left-over norms of each pair."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, centres: list[np.ndarray]) -> None:
        """centres: none for a length that the sample does not hold; then all is left over."""
        self.ids, self.labels, self.x, self.centres = ids, labels, x, centres
        pairs = _pairs(x)
        self.codes = np.zeros((pairs.shape[1], len(ids)), np.uint8)
        left = pairs.astype(np.int64).copy()
        for j, own in enumerate(centres):
            self.codes[j] = _nearest(pairs[:, j], own)
            left[:, j] -= own[self.codes[j]]
        norms = np.sqrt((left.astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-6)
        self.left = np.where(norms > 0, np.nextafter(norms.astype(np.float32), np.float32(np.inf)), np.float32(0)).T.copy()

    def columns(self) -> dict[str, list]:
        return {"length": [self.x.shape[1]], "packed": [self.x.tobytes()], **{k: [getattr(self, k).tobytes()] for k in ("ids", "labels", "codes", "left")}}

    @classmethod
    def read(cls, row: dict, centres: list[np.ndarray]) -> Pack:
        self = cls.__new__(cls)
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.x = np.frombuffer(row["packed"], "<i8").reshape(len(self.ids), row["length"])
        self.codes, self.left = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(self.ids)), np.frombuffer(row["left"], "<f4").reshape(-1, len(self.ids))
        self.centres = centres
        return self

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the score of each anchor (row) with each row of the pack (column) is at least and at most."""
        pairs = _pairs(anchors)
        near = np.zeros((len(anchors), len(self.ids)), np.int64)
        for j, own in enumerate(self.centres):
            near += (pairs[:, j] @ own.T)[:, self.codes[j]]
        size = np.sqrt((pairs.astype(np.float64) ** 2).sum(axis=2))
        off = np.ceil((size @ self.left.astype(np.float64)) * (1 + 1e-6)).astype(np.int64)
        return near - off, near + off

    def exact(self, anchors: np.ndarray, which: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(which), np.int64)
        for a in range(0, len(which), 1 << 14):
            out[a : a + (1 << 14)] = (anchors[which[a : a + (1 << 14)]] * self.x[rows[a : a + (1 << 14)]]).sum(axis=1)
        return out


class Best:
    """The first k (score, id) of each of several windows: [low, high] of an anchor's scores."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def least(self) -> np.ndarray:
        """The smallest score that can still come among the first k of each window."""
        full = np.bincount(self.window, minlength=len(self.low)) >= self.k
        last = np.full(len(self.low), np.iinfo(np.int64).max)
        np.minimum.at(last, self.window, self.score)
        return np.where(full, np.maximum(last, self.low), self.low)

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        inside = (score >= self.low[window]) & (score <= self.high[window])
        self.window, self.score, self.id = (np.concatenate([a, b[inside]]) for a, b in ((self.window, window), (self.score, score), (self.id, ids)))
        order = np.lexsort([self.id, -self.score, self.window])
        place = np.arange(len(order)) - np.searchsorted(self.window[order], self.window[order])
        order = order[place < self.k]
        self.window, self.score, self.id = self.window[order], self.score[order], self.id[order]


def complete(best: Best, of: np.ndarray, pack: Pack, anchors: np.ndarray, partner: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> None:
    """Add a pack's rows to the windows. of: each window's anchor; partner: whether a row counts for an anchor."""
    least = best.least()
    for number in range(len(of)):
        a = of[number]
        may = np.flatnonzero(partner[a] & (upper[a] >= least[number]) & (lower[a] <= best.high[number]))
        # rows that are in the window for certain: the k-th of their lower bounds is a bound for all
        sure = lower[a, may][(lower[a, may] >= best.low[number]) & (upper[a, may] <= best.high[number])]
        if len(sure) > best.k:
            may = may[upper[a, may] >= np.partition(sure, len(sure) - best.k)[len(sure) - best.k]]
        if len(may):
            best.add(np.full(len(may), number), pack.exact(anchors, np.full(len(may), a), may), pack.ids[may])


def usable(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """id, label, x (whole numbers) and mark (of label and vector) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("_x")).where("id IS NOT NULL AND label IS NOT NULL AND _x IS NOT NULL").where(F.coalesce(finite, F.lit(False)))
    return some.select("id", "label", F.transform("_x", lambda v: F.floor(v * scale)).alias("x")).withColumn("mark", F.xxhash64("label", "x"))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)
    if x.size and float(np.abs(x.astype(np.float64)).max()) ** 2 * max(1, length) >= 2.0**62:
        raise ValueError("scores would not fit into 63 bits")
    return x


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    size = np.diff(batch.column("x").offsets.to_numpy())
    for length in np.unique(size).tolist():
        yield length, batch.take(pa.array(np.flatnonzero(size == length)))


def _coded(good: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """Packs of rows of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, {}

        def done(length: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(length)))
            return pa.RecordBatch.from_pydict({"pack": pa.array([number]), **Pack(ids, labels, x, books.get(length, [])).columns()})

        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                for length, some in _by_length(batch.slice(at, PACK_ROWS)):
                    held.setdefault(length, []).append((some.column("id").to_numpy(), some.column("label").to_numpy(), _matrix(some.column("x"), length)))
                    if sum(len(h[0]) for h in held[length]) >= PACK_ROWS:
                        yield done(length)
        for length in list(held):
            yield done(length)

    return good.select("id", "label", "x").mapInArrow(run, "pack long, length long, packed binary, ids binary, labels binary, codes binary, left binary")


def _met(packs: DataFrame, anchors: DataFrame, books: dict[int, list[np.ndarray]], parts: int, same: bool, k: int, low: int, high: int) -> DataFrame:
    """anchor, mark, goal (0, or the score of the positive), id and score: the first k of each window in each part of the rows.

    anchors: id, label, x, mark and goals (scores of positives; empty when positives themselves are asked for, with same).
    """
    everything = np.iinfo(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            part = batch.column("part").to_numpy()
            for lo, hi in zip(cut := [0, *(np.flatnonzero(np.diff(part)) + 1).tolist()], [*cut[1:], len(part)]):
                if lo == hi:
                    continue
                if part[lo] != now:
                    now, held = part[lo], {}
                piece = batch.slice(lo, hi - lo)
                rows = int(piece.column("id").null_count)
                for row in piece.slice(0, rows).to_pylist():
                    held.setdefault(row["length"], []).append(Pack.read(row, books.get(row["length"], [])))
                for at in range(rows, piece.num_rows, BATCH_ANCHORS):
                    for length, some in _by_length(piece.slice(at, BATCH_ANCHORS)):
                        for a in range(0, some.num_rows, SLICE):
                            yield found(some.slice(a, SLICE), length, held.get(length, []))

    def found(some: pa.RecordBatch, length: int, packs: list[Pack]) -> pa.RecordBatch:
        ids, labels, x = some.column("id").to_numpy(), some.column("label").to_numpy(), _matrix(some.column("x"), length)
        if same:
            of, goal = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            best = Best(np.full(len(ids), everything.min), np.full(len(ids), everything.max), k)
        else:
            goals = some.column("goals").to_pylist()
            of = np.repeat(np.arange(len(ids)), [len(g) for g in goals])
            goal = np.array([g for own in goals for g in own], np.int64)
            best = Best(-((-low * goal) // 100), (high * goal) // 100, k)
        for pack in packs:
            lower, upper = pack.bounds(x)
            partner = (labels[:, None] == pack.labels) if same else (labels[:, None] != pack.labels)
            complete(best, of, pack, x, partner & (ids[:, None] != pack.ids), lower, upper)
        anchor = pa.array(of[best.window])
        return pa.RecordBatch.from_arrays([some.column("id").take(anchor), some.column("mark").take(anchor), pa.array(goal[best.window]), pa.array(best.id), pa.array(best.score)], names=["anchor", "mark", "goal", "id", "score"])

    columns = {"part": "int", "length": "long", "ids": "binary", "labels": "binary", "codes": "binary", "left": "binary", "packed": "binary", "id": "long", "label": "long", "x": "array<long>", "mark": "long", "goals": "array<long>"}
    packs = packs.withColumn("part", F.pmod(F.xxhash64("pack"), F.lit(parts)).cast("int"))
    everywhere = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = [df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]) for df in (packs, everywhere)]
    met = both[0].unionByName(both[1]).repartition(parts, "part").sortWithinPartitions("part", F.col("id").isNotNull())
    return met.mapInArrow(run, "anchor long, mark long, goal long, id long, score long")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    rows: vec_id, label and the vector; anchors: a condition on vec_id and label that holds for the anchors.
    """
    spark = rows.sparkSession
    good = usable(rows, vector, scale)
    stats = good.agg(F.count(F.lit(1))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(least, stats // 1024), stats // PART_ROWS)
    sample = good.select("id", "x").orderBy(F.xxhash64("x", "id")).limit(SAMPLE_ROWS).collect()
    books = {n: fit(np.array([r.x for r in sample if len(r.x) == n], np.int64)) for n in {len(r.x) for r in sample} if n}
    packs = saved(_coded(good, books), "negatives-packs")
    chosen = usable(rows.where(anchors), vector, scale).dropDuplicates(["id", "mark"])

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = saved(first(_met(packs, chosen.withColumn("goals", F.array().cast("array<long>")), books, parts, True, positives, low, high), ["anchor", "mark"], positives), "negatives-positives")
    # at most `positives` goals for each anchor
    goals = near.groupBy("anchor", "mark").agg(F.collect_set("score").alias("goals"))
    asking = chosen.join(goals.withColumnRenamed("anchor", "id"), ["id", "mark"])
    found = first(_met(packs, asking, books, parts, False, negatives, low, high), ["anchor", "mark", "goal"], negatives)
    pairs = near.select("anchor", "mark", F.col("id").alias("positive_id"), F.col("score").alias("goal"))
    met = pairs.join(found, ["anchor", "mark", "goal"])
    out = saved(met.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), F.col("goal").alias("positive_score"), F.col("score").alias("negative_score")), "negatives-found")
    dropped(packs, near)
    return out

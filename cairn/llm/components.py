"""Connected groups of a graph whose edges are found by shared buckets, without listing all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, saved

#: Ids of one leader that are held in a task at a time, twice; pairs whose marks are compared at once; pairs whose texts are
#: compared in one task, at most and (if there are more) at least; pairs and bytes of text that are compared at once.
SPAN, _PAIRS, _LOT, _LOT_LEAST, _AT_ONCE, _TEXT = 1024, 1 << 16, 1 << 15, 1 << 12, 1 << 13, 8 << 20
#: Leaders of so few ids are looked at together; rows that are read for that, and entries of buckets that may meet, at a time.
_FEW, _ROWS, _MEET = 16, 1 << 13, 1 << 21
#: What tells of two lots of marks, by column, which pairs may be linked.
May = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]
#: What tells of two lots of texts which pairs are linked.
Near = Callable[[pa.Array, pa.Array], np.ndarray]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and component (the smallest id reachable) of every end of the edges (columns a and b).

    Each node's neighbours are hung on its smallest neighbour, in turns over all larger and all smaller ones, until
    every group is a star; the rounds grow with the logarithm of the longest chain. Both halves of a round are grouped
    minima and joins on the node, so a group of any size is spread over many tasks.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    mark = None
    for _ in range(most_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        dropped(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = saved(small.where("u != v").distinct(), "cc-small")
        dropped(large)
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key in a row, of rows in the order of the keys."""
    now, parts = None, []
    for batch in batches:
        at = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = np.flatnonzero(np.concatenate([[True], (at[:, 1:] != at[:, :-1]).any(axis=0), [True]])) if batch.num_rows else np.zeros(1, np.int64)
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = tuple(at[:, begin].tolist())
            if key != now and parts:
                yield pa.Table.from_batches(parts)
                parts = []
            now = key
            parts.append(batch.slice(begin, end - begin))
    if parts:
        yield pa.Table.from_batches(parts)


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Some `rows` rows at a time, never a part of a key's rows, and where each key's rows begin (one more entry than keys); rows are
    in the order of the keys."""
    held, n = [], 0

    def ready(table: pa.Table, last: bool) -> tuple[int, np.ndarray]:
        at = np.stack([table.column(c).to_numpy() for c in keys])
        cuts = np.flatnonzero(np.concatenate([[True], (at[:, 1:] != at[:, :-1]).any(axis=0)]))
        return (len(table), np.append(cuts, len(table))) if last else (int(cuts[-1]), cuts)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            end, cuts = ready(table, False)
            if end:
                yield table.slice(0, end), cuts
            held, n = table.slice(end).to_batches(), len(table) - end
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, ready(table, True)[1]


def across(rest: DataFrame, marks: DataFrame | None = None, may: May | None = None, texts: DataFrame | None = None, near: Near | None = None) -> DataFrame:
    """Pairs (a < b) of ids that share a bucket but no component, and that may be linked by their marks; hardly any comes twice.

    rest: bucket, leader, id, component. Texts of one family share hundreds of buckets, most of them with the same leader, so all
    buckets of a leader are looked at together and give each pair once. An id goes to a task with its buckets and its marks;
    more than SPAN ids of a leader are cut into blocks, and each two blocks are a task's work.
    With texts (id, line) and near, only pairs that are linked: an id then goes on with the ids it may be linked with, in lots of some
    _LOT_LEAST to _LOT pairs, and the texts of a lot are compared in one task, so that pairs which just miss never become rows.
    """
    held = rest.groupBy("leader", "id").agg(F.first("component").alias("component"), F.collect_list("bucket").alias("buckets"))
    many = held.groupBy("leader").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").selectExpr("leader", f"(_n + {SPAN - 1}) div {SPAN} AS _k")
    held = held.join(many, "leader").withColumn("_own", F.expr("pmod(xxhash64(id), _k)"))
    others = [] if marks is None else [c for c in marks.columns if c != "id"]
    if marks is not None:
        held = held.join(marks, "id")
    laid = held.withColumn("_with", F.explode(F.expr("sequence(0L, _k - 1)"))).withColumns({"_lo": F.least("_own", "_with"), "_hi": F.greatest("_own", "_with")})
    kind = rest.schema["id"].dataType.simpleString()

    def column(table: pa.Table, name: str) -> np.ndarray:
        found = table.column(name).combine_chunks()
        if pa.types.is_list(found.type):
            return found.flatten().to_numpy().reshape(len(found), -1)
        return found.to_numpy()

    def met(flat: np.ndarray, owner: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows of one group that share a bucket, each once; flat, owner: buckets and the row of each."""
        order = np.lexsort((flat, group[owner]))
        flat, owner = flat[order], owner[order]
        fresh = np.concatenate([[True], (flat[1:] != flat[:-1]) | (group[owner[1:]] != group[owner[:-1]])])[: len(flat)]
        cuts = np.flatnonzero(fresh)
        # each entry meets those after it in its bucket
        after = np.repeat(np.append(cuts[1:], len(flat)), np.diff(np.append(cuts, len(flat)))) - np.arange(len(flat)) - 1
        x = np.repeat(np.arange(len(flat)), after)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after)
        both = np.unique(owner[x] * len(group) + owner[y])
        return both // max(len(group), 1), both % max(len(group), 1)

    def dense(rows: slice, own: np.ndarray, component: np.ndarray, flat: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows of one key, of many ids, that share a bucket and no component."""
        own, component = own[rows], component[rows]
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        place = np.zeros(len(own), np.int64)
        place[left] = np.arange(len(left))
        place[right] = np.arange(len(right))
        flat, owner = flat[at[rows.start] : at[rows.stop]], np.repeat(np.arange(len(own)), np.diff(at[rows.start : rows.stop + 1]))
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        cuts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
        meet = np.zeros((len(left), len(right)), bool)
        several = np.flatnonzero(np.diff(cuts) > 1)
        for begin, end in zip(cuts[several].tolist(), cuts[several + 1].tolist()):
            some = owner[begin:end]
            meet[np.ix_(place[some[own[some] == low]], place[some[own[some] == high]])] = True
        meet &= component[left][:, None] != component[right][None, :]
        x, y = np.nonzero(np.triu(meet, 1) if low == high else meet)
        return rows.start + left[x], rows.start + right[y]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for table, cuts in _whole(batches, keys, _ROWS):
            ids, component, own, low, high = (column(table, c) for c in ("id", "component", "_own", "_lo", "_hi"))
            buckets = table.column("buckets").combine_chunks()
            flat, many = buckets.flatten().to_numpy(), buckets.value_lengths().to_numpy()
            at = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
            lots = {c: column(table, c) for c in others}
            size = np.diff(cuts)
            few = (size <= _FEW) & (low[cuts[:-1]] == high[cuts[:-1]])
            group = np.repeat(np.arange(len(size)), size)

            def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                rows = np.flatnonzero(few[group])
                # at most so many entries times the ids they may meet, cut between keys
                turn = np.cumsum(many[rows] * size[group[rows]]) // _MEET
                turn = turn[np.searchsorted(group[rows], group[rows])]
                for some in np.split(rows, np.flatnonzero(np.diff(turn)) + 1):
                    if len(some):
                        owner = np.repeat(np.arange(len(some)), many[some])
                        inner = np.arange(len(owner)) - np.repeat(np.cumsum(many[some]) - many[some], many[some])
                        x, y = met(flat[at[some][owner] + inner], owner, group[some])
                        x, y = some[x], some[y]
                        apart = component[x] != component[y]
                        yield x[apart], y[apart]
                for g in np.flatnonzero(~few).tolist():
                    yield dense(slice(int(cuts[g]), int(cuts[g + 1])), own, component, flat, at, int(low[cuts[g]]), int(high[cuts[g]]))

            for x, y in found():
                for begin in range(0, len(x), _PAIRS):
                    i, j = x[begin : begin + _PAIRS], y[begin : begin + _PAIRS]
                    if may is not None:
                        close = may({c: v[i] for c, v in lots.items()}, {c: v[j] for c, v in lots.items()})
                        i, j = i[close], j[close]
                    if len(i):
                        yield ids[i], ids[j]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j in pairs(batches):
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(i, j)), "b": pa.array(np.maximum(i, j))})

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each lot of pairs, its ids, each with the ids it is to be compared with. Leaders of few pairs share a lot."""
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def lot() -> pa.RecordBatch:
            i, j = (np.concatenate(x) for x in zip(*held))
            ids, where = np.unique(np.concatenate([i, j]), return_inverse=True)
            x, y = where[: len(i)], where[len(i) :]
            # in the order of the first, and each pair once
            both = np.unique(np.minimum(x, y) * len(ids) + np.maximum(x, y))
            count = np.bincount(both // len(ids), minlength=len(ids))
            peers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids[both % len(ids)]))
            return pa.RecordBatch.from_pydict({"_lot": pa.array(np.full(len(ids), number, np.int64)), "id": pa.array(ids), "peers": peers})

        for x, y in pairs(batches):
            for at in range(0, len(x), _LOT):
                held.append((x[at : at + _LOT], y[at : at + _LOT]))
                size += len(held[-1][0])
                if size >= _LOT_LEAST:
                    yield lot()
                    number, held, size = number + 1, [], 0
        if held:
            yield lot()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, heavy = [], 0, 0

        def linked() -> pa.RecordBatch:
            x, y, a, b = zip(*held)
            close = near(pa.concat_arrays(a), pa.concat_arrays(b))
            x, y = np.concatenate(x)[close], np.concatenate(y)[close]
            return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

        for table in _runs(batches, ["_lot"]):
            table = table.sort_by("id").combine_chunks()
            ids, line = column(table, "id"), table.column("line").combine_chunks()
            heavier = pc.binary_length(line).to_numpy().astype(np.int64)
            peers = table.column("peers").combine_chunks()
            i, j = np.repeat(np.arange(len(ids)), peers.value_lengths().to_numpy()), np.searchsorted(ids, peers.flatten().to_numpy())
            # small lots are compared together; pairs of long texts a few at a time
            weight = np.concatenate([[0], np.cumsum(heavier[i] + heavier[j])])
            at = 0
            while at < len(i):
                end = min(at + _AT_ONCE - size, max(int(np.searchsorted(weight, weight[at] + _TEXT - heavy, "right")) - 1, at + 1))
                x, y = i[at:end], j[at:end]
                held.append((ids[x], ids[y], line.take(pa.array(x)), line.take(pa.array(y))))
                size, heavy, at = size + len(x), heavy + int(weight[end] - weight[at]), end
                if size >= _AT_ONCE or heavy >= _TEXT // 2:
                    yield linked()
                    held, size, heavy = [], 0, 0
        if held:
            yield linked()

    keys = ["leader", "_lo", "_hi"]
    # wholly ordered, so that a task that runs again makes the same lots
    laid = laid.select(*keys, "_own", "id", "component", "buckets", *others).repartition(*keys).sortWithinPartitions(*keys, "id")
    if near is None:
        return laid.mapInArrow(listed, f"a {kind}, b {kind}")
    dealt = laid.mapInArrow(lots, f"_lot long, id {kind}, peers array<{kind}>").join(texts, "id")
    dealt = dealt.repartition("_lot").sortWithinPartitions("_lot")
    return dealt.mapInArrow(compared, f"a {kind}, b {kind}")


def linked_groups(
    members: DataFrame,
    similar: Callable[[DataFrame, bool], DataFrame],
    marks: DataFrame | None = None,
    may: May | None = None,
    texts: DataFrame | None = None,
    near: Near | None = None,
) -> DataFrame:
    """id and component of all ids that are linked with another.

    members: bucket and id; two ids can only be linked if they share a bucket. Where linked ids share several, members also
    has role and spare: of the buckets of each (id, role), the `spare` most common ones are left out, which is right if
    linked ids share more than `spare` buckets of the role (of what both have in common, the rarest stays with both).
    similar: keeps of pairs (a, b) those that are linked; it is also told if `may` has passed them all already. With texts (id, line)
    and near, the last step compares texts where pairs are found (`across`). The groups are exact, yet pairs within a group are not all looked
    at: first each id meets the one leader (smallest id of a bucket) with which it shares most buckets; then, where a bucket
    still holds different groups, its ids meet its leader; at last, in buckets that even then hold different groups, all
    pairs across groups are looked at, each once; by then a bucket's leader has met all others.
    """
    spared, rare = "spare" in members.columns, members.select("bucket", "id")
    if spared:
        sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        common = Window.partitionBy("id", "role").orderBy(F.desc("_n"), "bucket")
        busy = members.join(sizes, "bucket").withColumn("_place", F.row_number().over(common)).where("_place > spare")
        rare = saved(busy.select("bucket", "id"), "lg-rare")
    # a bucket's first id is its leader; one that no other id follows is alone
    bucket = Window.partitionBy("bucket").orderBy("id")
    led = rare.select("bucket", "id", F.first("id").over(bucket.rowsBetween(Window.unboundedPreceding, 0)).alias("leader"), F.lead("id").over(bucket).alias("_next"))
    busy = saved(led.where("id != leader OR _next IS NOT NULL").select("bucket", "id", "leader"), "lg-busy")
    if spared:
        dropped(rare)

    def link(pairs: DataFrame, known: DataFrame | None, checked: bool = False) -> DataFrame:
        found = similar(pairs, checked).select("a", "b")
        links = saved(found if known is None else found.unionByName(known), "lg-links")
        if known is not None:
            dropped(known)
        return links

    def mixed(groups: DataFrame) -> DataFrame:
        """Members of buckets that hold different groups."""
        named = busy.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
        bucket = Window.partitionBy("bucket")
        seen = {"_lo": F.min("component").over(bucket), "_hi": F.max("component").over(bucket), "_chief": F.min_by("component", "id").over(bucket)}
        return saved(named.withColumns(seen).where("_lo != _hi").drop("_lo", "_hi"), "lg-mixed")

    # both groupings need no more than the rows of an id in one place
    stars = busy.where("id != leader").repartition("id").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("_n"))
    first = saved(stars.groupBy("id").agg(F.max_by("leader", F.struct("_n", -F.col("leader"))).alias("a")).select("a", F.col("id").alias("b")), "lg-first")
    links = link(first, None)
    groups = connected_components(links)
    seen, done = first, [first]
    for step in ("leaders", "all"):
        rest = mixed(groups)
        if rest.isEmpty():
            break
        if step == "leaders":
            pairs = rest.where("component != _chief").select(F.col("leader").alias("a"), F.col("id").alias("b"))
        elif near is not None:
            links, known = saved(across(rest.where("id != leader"), marks, may, texts, near).unionByName(links), "lg-links"), links
            groups = connected_components(links)
            dropped(rest, known)
            break
        else:
            pairs = across(rest.where("id != leader"), marks, may)
        pairs = saved(pairs.distinct().join(seen, ["a", "b"], "left_anti"), "lg-pairs")
        if not pairs.isEmpty():
            links = link(pairs, links, step == "all" and may is not None)
            groups = connected_components(links)
        dropped(rest)
        done.append(pairs)
        seen = seen.unionByName(pairs)
    dropped(busy, links, *done)
    return groups

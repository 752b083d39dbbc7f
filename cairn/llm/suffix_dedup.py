"""Removal of long passages that stand in an earlier document already, byte for byte, through suffix arrays.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller doc_id. Strings are
judged on the texts as given; they may overlap; documents are UTF-8 bytes, and strings never cross from one to the next.

1. Equal texts are one class, of which the first document goes on; the others lose everything.
2. Texts are packed into shards of about SHARD_BYTES; long texts are cut into overlapping pieces. Each window of `length` bytes
   has an anchor, the smallest hash of its GRAM-byte pieces, and a key, the hash of more bytes around it (`anchored`); equal windows have
   equal ones. Four bytes an anchor and a key travel to find those that several shards have; windows of other keys cannot repeat elsewhere.
3. Each shard sorts the suffixes of its windows that may repeat within it (Larsson-Sadakane refinement, to `length` bytes),
   takes common prefixes (Kasai), and so knows the first document of each window. What it cannot settle itself, one document for each
   different window, is sent on as runs of windows with one anchor.
4. Runs with one anchor meet in one part. Equal runs are one there, with their smallest doc_id. Runs that differ but share their
   anchor are packed; each pack becomes a suffix array of its own, and the arrays are merged by binary search; a window's
   smallest doc_id decides.

An anchor that very many shards have (HOT_SHARDS), with more different runs than a part should get, is dealt out by the hash of each
whole window instead, so that one common phrase in different surroundings is spread over all tasks; a window that is common itself is
sent once by each shard.

Results for odd input: a null text is empty; texts shorter than `length` lose nothing and take nothing; rows without a doc_id
are returned untouched and take nothing from others; rows that repeat a doc_id are told apart by their text and never remove each
other's bytes, and wholly equal rows get equal results; an empty table gives an empty result; further columns are kept
by `deduplicated` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved
from .textgrams import U64, byte_hashes, byte_totals, byte_window_hashes, mix

LENGTH = 50
GRAM = 20
SHARD_BYTES = 1 << 20
#: Bytes of runs that are sorted at a time, and about as many bytes as one part gets.
PACK_BYTES, PART_BYTES = 2 << 20, 8 << 20
#: An anchor that so many shards have, with more runs than one part should get, is dealt out by whole windows, which travel alone.
HOT_SHARDS = 512


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of a text in the order of the `depth` bytes that start there (zeros follow the end).

    Larsson-Sadakane: groups of places that agree in h bytes are refined by the group of the place h further on, which
    doubles h; places that are alone in their group are not looked at again.
    """
    n = len(text)
    key = np.ndarray(n, ">u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,)).astype(U64)
    order = np.argsort(key)
    head = np.ones(n + 1, bool)
    key = key[order]
    np.not_equal(key[1:], key[:-1], out=head[1:n])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    known = 8
    open_ = np.flatnonzero(~(head[:n] & head[1:]))
    while known < depth and len(open_):
        step = min(known, depth - known)
        place = order[open_]
        after = place + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = (rank[place] << 32) | second
        turn = np.argsort(both)
        place, both = place[turn], both[turn]
        order[open_] = place
        fresh = np.ones(len(open_), bool)
        np.not_equal(both[1:], both[:-1], out=fresh[1:])
        head[open_] = fresh
        rank[place] = np.maximum.accumulate(np.where(fresh, open_, 0))
        known += step
        open_ = open_[~(head[open_] & head[open_ + 1])]
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, chain: int = 64) -> np.ndarray:
    """For each place in the order, how many of its first `depth` bytes the place before it in the order shares.

    Kasai: going through the text, a place shares at least one byte less with its forerunner than the place before it did, so
    comparisons go on from there. The text is cut into chains that advance side by side; after a whole common prefix, where equal
    places have no order, a chain begins anew.
    """
    n = len(text)
    word = np.ndarray(n + depth + 8, "<u8", np.concatenate([text, np.zeros(depth + 16, np.uint8)]), strides=(1,))
    before = np.empty(n, np.int64)
    before[order[:1]] = -1
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int16)
    begin = np.arange(0, n, chain)
    held = np.zeros(len(begin), np.int64)
    for j in range(min(chain, n)):
        own = begin + j
        if own[-1] >= n:
            own, held = own[:-1], held[:-1]
            begin = begin[:-1]
        held = np.where(held >= depth, 0, np.maximum(held - 1, 0))
        other = before[own]
        held[other < 0] = 0
        going = np.flatnonzero(other >= 0)
        while len(going):
            apart = word[own[going] + held[going]] ^ word[other[going] + held[going]]
            same = np.bitwise_count((apart & (~apart + U64(1))) - U64(1)) >> 3
            held[going] += same
            going = going[(same == 8) & (held[going] < depth)]
        np.minimum(held, depth, out=held)
        shared[own] = held
    return shared[order]


def window_groups(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of the windows there, and whether each window differs from the one before."""
    order = suffix_order(text, depth)
    fresh = common_prefixes(text, order, depth) < depth
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(fresh)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    group = group[order]
    return order, np.concatenate([[True], group[1:] != group[:-1]])[: len(order)]


def anchored(data: np.ndarray, at: np.ndarray, length: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows in a row with one key: key, first place, number of windows, text, key of the anchor.

    A window's key is the hash of its anchor's first place in it with the bytes after it, or those before it, half as many as a window
    has beside its anchor; one of both is always inside. So a key tells of many more bytes than the anchor, at no more runs than two for an
    anchor, and equal windows have equal keys. A key has the part in its upper and four bytes of the hash in its lower half.
    """
    counts = np.maximum(np.diff(at) - length + 1, 0)
    windows = int(counts.sum())
    if not windows:
        return np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, U64)
    gram = min(GRAM, length)
    total = byte_totals(data)
    grams, span, over = byte_window_hashes(total, gram), 1, length - gram + 1
    least = grams
    while 2 * span <= over:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < over:
        least = np.minimum(least[: len(least) - (over - span)], least[over - span :])
    text = np.repeat(np.arange(len(counts)), counts)
    start = at[text] + np.arange(windows) - np.repeat(np.cumsum(counts) - counts, counts)
    least = least[start]
    fresh = text[1:] != text[:-1]
    cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | fresh]))
    value, first, many, text = least[cut], start[cut], np.diff(np.append(cut, windows)), text[cut]
    # where the anchor stands first in a run's first window: at the end, if it is new there
    new = np.concatenate([[False], (value[1:] < value[:-1]) & (text[1:] == text[:-1])])
    place = first + over - 1
    going = np.flatnonzero(~new)
    place[going] = first[going] + (np.lib.stride_tricks.sliding_window_view(grams, over)[first[going]] == value[going, None]).argmax(axis=1)
    side = over // 2
    # windows with more than over - 1 - side bytes before their anchor count what stands before it, the others what stands after it
    ahead = np.clip(place - (over - 1 - side) - first, 0, many)
    before, after = (byte_hashes(total, np.clip(x, 0, len(data) - gram - side), gram + side) for x in (place - side, place))
    key = np.stack([mix(before ^ U64(1)), mix(after ^ U64(2))], axis=1).ravel()
    begin, n = np.stack([first, first + ahead], axis=1).ravel(), np.stack([ahead, many - ahead], axis=1).ravel()
    of = np.repeat(np.arange(len(first)), 2)
    again = np.flatnonzero(first + many - 1 > place)
    if len(again):
        # the anchor comes several times in these runs, so each window has its own first place of it
        n[2 * again] = n[2 * again + 1] = 0
        run = np.repeat(again, many[again])
        own = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(many[again]) - many[again], many[again])
        wide = many[again] + over - 1
        run_of = np.repeat(again, wide)
        spot = first[run_of] + np.arange(len(run_of)) - np.repeat(np.cumsum(wide) - wide, wide)
        met = grams[spot] == value[run_of]
        spot = spot[met][np.searchsorted((run_of[met] << 32) | spot[met], (run << 32) | own)]
        early = spot - own > over - 1 - side
        hashes = byte_hashes(total, spot - np.where(early, side, 0), gram + side)
        key, begin, n, of = (np.concatenate(x) for x in ((key, mix(hashes ^ np.where(early, U64(1), U64(2)))), (begin, own), (n, np.ones(len(own), np.int64)), (of, run)))
        order = np.argsort(begin, kind="stable")
        key, begin, n, of = key[order], begin[order], n[order], of[order]
    some = np.flatnonzero(n > 0)
    key, anchor = (((x >> U64(32)) * U64(parts)) & ~U64(0xFFFFFFFF) | (x & U64(0xFFFFFFFF)) for x in (key[some], value[of[some]]))
    return key, begin[some], n[some], text[of[some]], anchor


def intervals(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of what windows at these (ordered) starts cover, windows in a row taken together."""
    cut = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1])[: len(starts)])
    return starts[cut], (np.append(starts, 0)[np.append(cut[1:], len(starts)) - 1] + length)[: len(cut)]


def place_of(runs: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Binary search: how many of the ordered rows of `runs` come before each row of `asked`, first column first."""
    low, high = (np.searchsorted(runs[:, 0], asked[:, 0], side=s) for s in ("left", "right"))
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) >> 1
        less, same = np.zeros(len(going), bool), np.ones(len(going), bool)
        for c in range(1, runs.shape[1]):
            mine, theirs = runs[middle, c], asked[going, c]
            less |= same & (mine < theirs)
            same &= mine == theirs
        low[going] = np.where(less, middle + 1, low[going])
        high[going] = np.where(less, high[going], middle)
        going = going[low[going] < high[going]]
    return low


def window_words(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The windows as rows of big-endian numbers, whose order is that of their bytes."""
    view = np.ndarray(len(data) + 8, ">u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
    out = np.empty((len(starts), -(-length // 8)), U64)
    for c in range(out.shape[1]):
        out[:, c] = view[np.minimum(starts + 8 * c, len(data))]
    if length % 8:
        out[:, -1] &= ~U64(0) << U64(64 - 8 * (length % 8))
    return out


class Merged:
    """Different windows in their order with their smallest document, taken from one suffix array after the other."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.windows = np.zeros((0, -(-length // 8)), U64)
        self.first = np.zeros(0, np.int64)

    def add(self, data: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> None:
        """starts, docs: the windows of a pack of text, in the order of their places, and the document of each."""
        order, fresh = window_groups(data, starts, self.length)
        own = np.flatnonzero(fresh)
        doc = np.empty(len(data), np.int64)
        doc[starts] = docs
        first = np.minimum.reduceat(doc[order], own)
        windows = window_words(data, order[own], self.length)
        at = place_of(self.windows, windows)
        known = np.zeros(len(at), bool)
        inside = at < len(self.windows)
        known[inside] = (self.windows[at[inside]] == windows[inside]).all(axis=1)
        self.first[at[known]] = np.minimum(self.first[at[known]], first[known])
        new = ~known
        self.windows = np.insert(self.windows, at[new], windows[new], axis=0)
        self.first = np.insert(self.first, at[new], first[new])

    def smallest(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.first[place_of(self.windows, window_words(data, starts, self.length))]


def _packed(texts: DataFrame, length: int) -> DataFrame:
    """shard, size, ids, marks, bases, at and data: texts end to end, long ones as pieces that overlap by length - 1 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def done() -> pa.RecordBatch:
            ids, marks, bases = (np.array(x, "<i8").tobytes() for x in zip(*((i, m, b) for i, m, b, _ in held)))
            at = np.concatenate([[0], np.cumsum([len(d) for *_, d in held])]).astype("<i8").tobytes()
            row = {"shard": number, "size": size, "ids": ids, "marks": marks, "bases": bases, "at": at, "data": b"".join(d for *_, d in held)}
            return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})

        for batch in batches:
            for doc, mark, data in zip(*(batch.column(c) for c in ("doc_id", "mark", "data"))):
                data = data.as_py()
                for base in range(0, max(1, len(data) - length + 1), SHARD_BYTES // 2):
                    piece = data[base : base + SHARD_BYTES // 2 + length - 1]
                    if held and size + len(piece) > SHARD_BYTES:
                        yield done()
                        number, held, size = number + 1, [], 0
                    held.append((doc.as_py(), mark.as_py(), base, piece))
                    size += len(piece)
        if held:
            yield done()

    return texts.mapInArrow(run, "shard long, size long, ids binary, marks binary, bases binary, at binary, data binary")


def _numbers(row: dict, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(row[k], np.uint8 if k == "data" else "<i8") for k in names]


def _shared_anchors(shards: DataFrame, length: int, parts: int) -> DataFrame:
    """shard, part and flags: a byte for each different key and anchor of the shard in the part, 1 if other shards have it, 2 if it has
    very many runs that go out. Equal runs of a shard go out once, so they count as one."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, data = _numbers(row, "at", "data")
                key, first, n, _, anchor = anchored(data, at, length, parts)
                runs = np.concatenate([key, anchor])
                order = np.argsort(runs)
                runs = runs[order]
                fresh = np.concatenate([[True], runs[1:] != runs[:-1]])[: len(runs)]
                key = runs[fresh]
                # of a key with several runs, how many others than one differ from each other
                many = np.flatnonzero(~(fresh & np.append(fresh, True)[1:]))
                run = order[many] % max(len(first), 1)
                content = byte_hashes(byte_totals(data), first[run], n[run] + length - 1)
                _, turn = np.unique(mix(runs[many]) ^ content, return_index=True)
                held = np.sort(runs[many][turn])
                more = held[1:][held[1:] == held[:-1]]
                here, cut = np.unique((key >> U64(32)).astype(np.int64), return_index=True)
                edges = np.searchsorted(more, here.astype(U64) << U64(32))
                lows, mores = ([x.tobytes() for x in np.split((k & U64(0xFFFFFFFF)).astype("<u4"), c[1:])] if len(here) else [] for k, c in ((key, cut), (more, edges)))
                yield pa.RecordBatch.from_pydict({"part": pa.array(here), "shard": pa.array([row["shard"]] * len(here), pa.int64()), "lows": pa.array(lows, pa.binary()), "more": pa.array(mores, pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: int, held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            lows = [np.frombuffer(b, "<u4") for _, b, _ in held]
            known, times = np.unique(np.concatenate(lows), return_counts=True)
            more, further = np.unique(np.frombuffer(b"".join(m for *_, m in held), "<u4"), return_counts=True)
            runs = times.copy()
            runs[np.searchsorted(known, more)] += further
            known, times, runs = known[times > 1], times[times > 1], runs[times > 1]
            # a run has fewer than 2 * length bytes but where its anchor comes again and again
            flag = np.where((times >= HOT_SHARDS) & (runs * 2 * length > PART_BYTES), 2, 1).astype(np.uint8)
            out = []
            for low in lows:
                found = np.zeros(len(low), np.uint8)
                if len(known):
                    place = np.minimum(np.searchsorted(known, low), len(known) - 1)
                    found = np.where(known[place] == low, flag[place], 0).astype(np.uint8)
                out.append(found.tobytes())
            for a in range(0, len(held), 256):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s for s, *_ in held[a : a + 256]], pa.int64()), "part": pa.array([part] * len(held[a : a + 256]), pa.int64()), "flags": pa.array(out[a : a + 256], pa.binary())})

        now, held = None, []
        for batch in batches:
            for part, shard, lows, more in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "lows", "more"))):
                if part != now and held:
                    yield from done(now, held)
                    held = []
                now = part
                held.append((shard, lows, more))
        if held:
            yield from done(now, held)

    laid = shards.select("shard", "at", "data").mapInArrow(lay, "part long, shard long, lows binary, more binary")
    return laid.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, "shard long, part long, flags binary")


_FOUND = "key long, doc_id long, mark long, bytes binary, places array<long>, ends array<long>"


def _settled(shards: DataFrame, flags: DataFrame, length: int, parts: int) -> DataFrame:
    """What each shard removes itself (places, ends), and runs of windows that others may have too (key, bytes, places)."""

    def solve(row: dict, flag: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, marks, bases, at, data = _numbers(row, "ids", "marks", "bases", "at", "data")
        key, first, count, text, anchor = anchored(data, at, length, parts)
        if not len(key):
            return
        known, inverse = np.unique(np.concatenate([key, anchor]), return_inverse=True)
        inverse, anchor_flag = inverse[: len(key)], flag[inverse[len(key) :]]
        doc = ids[text]
        low, high = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        several, elsewhere = (low != high)[inverse], np.where(flag[inverse] > 0, anchor_flag, 0)
        take = np.flatnonzero(several | (elsewhere > 0))
        if not len(take):
            return
        of = np.repeat(take, count[take])
        start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count[take]) - count[take], count[take])
        gone = np.zeros(len(of), bool)
        inside = np.flatnonzero(several[of])
        if len(inside):
            # only the text of these windows is sorted
            mark = np.zeros(len(data) + 1, np.int64)
            np.add.at(mark, start[inside], 1)
            np.add.at(mark, start[inside] + length, -1)
            covered = np.cumsum(mark[:-1]) > 0
            place = np.cumsum(covered) - 1
            own = place[start[inside]]
            order, fresh = window_groups(data[covered], own, length)
            who = np.empty(len(place), np.int64)
            who[own] = inside
            who = who[order]
            begin = np.flatnonzero(fresh)
            least = np.minimum.reduceat(doc[of[who]], begin)
            gone[who] = doc[of[who]] > np.repeat(least, np.diff(np.append(begin, len(who))))
        piece = text[of]
        lost = np.flatnonzero(gone)
        for p in np.unique(piece[lost]):
            a, b = intervals(start[lost[piece[lost] == p]] - at[p] + bases[p], length)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.array([int(ids[p])]), pa.array([int(marks[p])]), pa.nulls(1, pa.binary()), pa.array([a], pa.list_(pa.int64())), pa.array([b], pa.list_(pa.int64()))],
                names=["key", "doc_id", "mark", "bytes", "places", "ends"],
            )
        ask = np.flatnonzero((elsewhere[of] > 0) & ~gone)
        if not len(ask):
            return
        alone = elsewhere[of[ask]] == 2
        by, at_text = anchor[of[ask]], piece[ask]
        cut = np.flatnonzero(np.concatenate([[True], (by[1:] != by[:-1]) | (at_text[1:] != at_text[:-1]) | (np.diff(start[ask]) != 1) | alone[1:]]))
        begin, windows = start[ask][cut], np.diff(np.append(cut, len(ask)))
        whole = data.tobytes()
        met: dict[tuple[int, bytes], list[int]] = {}
        keys = []
        for b, n, p, k, each in zip(begin.tolist(), windows.tolist(), at_text[cut].tolist(), by[cut].view(np.int64).tolist(), alone[cut].tolist()):
            some = whole[b : b + n + length - 1]
            places = met.setdefault((p, some), [])
            if not places:
                keys.append(int.from_bytes(hashlib.blake2b(some, digest_size=8).digest(), "little", signed=True) if each else k)
            places.append(b - int(at[p]) + int(bases[p]))
        owner = np.array([p for p, _ in met])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(keys, np.int64)), pa.array(ids[owner]), pa.array(marks[owner]), pa.array([s for _, s in met], pa.binary()), pa.array(list(met.values()), pa.list_(pa.int64())), pa.nulls(len(met), pa.list_(pa.int64()))],
            names=["key", "doc_id", "mark", "bytes", "places", "ends"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's flags, part after part, come before its text."""
        held: list[bytes] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["data"] is None:
                    held.append(row["flags"])
                else:
                    yield from solve(row, np.frombuffer(b"".join(held), np.uint8))
                    held = []

    columns = ["shard", "part", "flags", "ids", "marks", "bases", "at", "data"]
    kinds = dict(shards.dtypes) | dict(flags.dtypes)
    both = [df.select(*[c if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns]) for df in (flags, shards)]
    met = both[0].unionByName(both[1]).repartition("shard").sortWithinPartitions("shard", F.col("part").asc_nulls_last())
    return met.mapInArrow(run, _FOUND)


def _judged(asked: DataFrame, length: int, parts: int) -> DataFrame:
    """doc_id, mark, places and ends of what a smaller document has too, of runs that meet by their key.

    Equal runs are one, which belongs to their smallest document; the others go whole. Runs that share their key with different ones
    are sorted and merged, and what is left of each is looked up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        coded = table.column("bytes").combine_chunks().dictionary_encode()
        code, texts = coded.indices.to_numpy(), coded.dictionary
        doc, key = (table.column(c).to_numpy() for c in ("doc_id", "key"))
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, code, doc)
        key_of = np.empty(len(texts), np.int64)
        key_of[code] = key
        _, at, many = np.unique(key_of, return_inverse=True, return_counts=True)
        several = np.flatnonzero(many[at] > 1)
        size = pc.binary_length(texts).to_numpy().astype(np.int64)

        def windows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            data = np.frombuffer(b"".join(texts.take(pa.array(codes)).to_pylist()), np.uint8)
            n = size[codes] - length + 1
            of = np.repeat(np.arange(len(codes)), n)
            return data, (np.cumsum(size[codes]) - size[codes])[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of

        packs = np.split(several, np.flatnonzero(np.diff(np.cumsum(size[several]) // PACK_BYTES)) + 1)
        merged = Merged(length)
        for codes in packs:
            if len(codes):
                data, start, of = windows(codes)
                merged.add(data, start, least[codes[of]])
        # what each different run loses at its smallest document: code, first byte, end
        losses = []
        for codes in packs:
            if not len(codes):
                continue
            data, start, of = windows(codes)
            gone = np.flatnonzero(merged.smallest(data, start) < least[codes[of]])
            if not len(gone):
                continue
            n = np.bincount(of, minlength=len(codes))
            within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(gone) != 1) | (of[gone][1:] != of[gone][:-1])]))
            last = np.append(cut[1:], len(gone)) - 1
            losses.append((codes[of[gone[cut]]], within[gone[cut]], within[gone[last]] + length))
        lost, first, end = (np.concatenate(x) for x in zip(*losses)) if losses else (np.zeros(0, np.int64),) * 3
        begin, number = np.searchsorted(lost, np.arange(len(texts))), np.bincount(lost, minlength=len(texts))
        whole = np.flatnonzero(doc > least[code])
        some = np.flatnonzero((doc == least[code]) & (number[code] > 0))
        share = number[code[some]]
        loss = np.repeat(begin[code[some]], share) + np.arange(int(share.sum())) - np.repeat(np.cumsum(share) - share, share)
        row = np.concatenate([whole, np.repeat(some, share)])
        a = np.concatenate([np.zeros(len(whole), np.int64), first[loss]])
        b = np.concatenate([size[code[whole]], end[loss]])
        for lo in range(0, len(row), 1 << 16):
            cut = slice(lo, lo + (1 << 16))
            taken = table.select(["doc_id", "mark", "places"]).take(pa.array(row[cut])).combine_chunks()
            places = taken.column("places").chunk(0)
            many_places, base = np.diff(places.offsets.to_numpy()), places.flatten().to_numpy()
            offsets = pa.array(np.concatenate([[0], np.cumsum(many_places)]).astype(np.int32))
            moved = [pa.ListArray.from_arrays(offsets, pa.array(base + np.repeat(x[cut], many_places))) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([taken.column("doc_id").chunk(0), taken.column("mark").chunk(0), *moved], names=["doc_id", "mark", "places", "ends"])

    return asked.select("key", "doc_id", "mark", "bytes", "places").repartition(parts, "key").mapInArrow(run, "doc_id long, mark long, places array<long>, ends array<long>")


def _digest(data: Column) -> Column:
    return F.unhex(F.md5(data))


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """size, digest, first (the smallest doc_id of the text) and spans (removed places and ends, in no order) of each different text; a work table."""
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))
    rows = rows.where(F.octet_length("data") >= length).select("doc_id", _digest(F.col("data")).alias("digest"), F.octet_length("data").alias("size"), F.xxhash64("data").alias("mark"), "data")
    classes = saved(rows.groupBy("size", "digest", "mark").agg(F.min("doc_id").alias("first")), "suffix-classes")
    wanted = classes.select(F.col("first").alias("doc_id"), "mark")
    shards = saved(_packed(rows.join(wanted.hint("shuffle_hash"), ["doc_id", "mark"], "left_semi").select("doc_id", "mark", "data"), length), "suffix-shards")
    total = shards.agg(F.sum("size")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(1 << 20, max(least, total // PART_BYTES, 1))
    # a work table, so that the keys' shuffle files go before the shards travel
    flags = saved(_shared_anchors(shards, length, parts), "suffix-flags")
    found = saved(_settled(shards, flags, length, parts), "suffix-found")
    asked = found.where("key IS NOT NULL")
    sent = asked.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    dropped(shards, flags)
    judged = _judged(asked, length, max(least, sent // PART_BYTES, 1))
    gone = found.where("key IS NULL").select("doc_id", "mark", "places", "ends").unionByName(judged)
    # an array of the spans of one text
    gone = gone.select("doc_id", "mark", F.arrays_zip("places", "ends").alias("some")).groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("some")).alias("spans"))
    out = saved(classes.join(gone.withColumnRenamed("doc_id", "first"), ["first", "mark"], "left").select("size", "digest", "first", "spans"), "suffix-spans")
    dropped(classes, found)
    return out


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The columns of docs as a struct `doc` (without its text), with n_bytes, the removed runs (`spans`: first byte and end, in
    order, apart from each other) and the bytes that stay (`kept`)."""
    found = spans(docs, length)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), F.col("doc_id").cast("long").alias("id"), data.alias("data"), _digest(data).alias("digest"))
    whole = whole.withColumn("size", F.octet_length("data"))
    joined = whole.alias("d").join(found.alias("f"), (F.col("d.size") == F.col("f.size")) & (F.col("d.digest") == F.col("f.digest")), "left")
    # of a text that an earlier document has too, nothing stays
    copy = F.col("d.id") > F.col("f.first")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("places"), F.col("d.size").cast("long").alias("ends")))
    cut = F.when(copy, everything).when(F.col("d.id").isNotNull(), F.col("f.spans"))
    laid = joined.select("d.doc", "d.data", cut.alias("cut"))
    kind = laid.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, kept = [], [], []
            for data, cut in zip(batch.column("data").to_pylist(), batch.column("cut").to_pylist()):
                merged: list[list[int]] = []
                for a, b in sorted((s["places"], s["ends"]) for s in cut or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for ab in merged for x in ab), len(data)]
                sizes.append(len(data))
                runs.append([{"first": a, "end": b} for a, b in merged])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc", "n_bytes", "spans", "kept"],
            )

    return laid.mapInArrow(run, f"doc {kind}, n_bytes long, spans array<struct<first: long, end: long>>, kept binary")

"""Near-duplicate texts by the Jaccard similarity of their word shingles, joined on parity sketches.

A text's set holds its distinct windows of five words (lower-cased A-Z). Texts of one set are one class, of which only the
first goes on. Then:

1. Shingles that no other text has are counted. A text of n shingles linked with another shares at least 3n/4 of them, so
   one with more than n/4 of its own has no partner and is done. The counting shuffle carries six bytes a shingle, each
   hash once for each batch of texts, so that a passage in every text stays small.
2. A parity sketch has a bit for each hash value, set if the set holds an odd number of shingles with it: sketches differ
   in at most as many bits as the sets in shingles. At a similarity of 3/4, sizes a and b allow at most (a + b) / 7
   differences. In each band of sizes (and between neighbouring bands) sketches are cut into more blocks than the largest
   such number d; two sketches that differ in d bits agree in some block, and blocks agree exactly if the XOR of their
   shingles' 64-bit hashes does. As there are half as many blocks again, such sketches agree in many, so each text can do
   without its most common ones. Blocks without shingles count only for texts with so many of them that nothing else is
   sure.
3. Texts that share a block are candidates; a short sketch of 512 bits rejects pairs whose Hamming distance is too large
   where they meet, and the sets decide the others. `components.linked_groups` finds the groups without looking at all pairs in them.

Shingle hashes have 52 bits: two different shingles of a pair of texts are taken as one with a chance below 1e-9 for texts
of a thousand words.

Results for odd input: texts that are null or have no words have no shingles and link with nothing; texts of one to four
words have one shingle, the whole sequence; rows without a doc_id are left out; rows that repeat a doc_id are one
document, whose sets all link; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved, text_slices
from .components import linked_groups
from .textgrams import U64, distinct, mix, windows, word_hashes

SHINGLE = 5
_SALT = [U64(0x243F6A8885A308D3), U64(0x13198A2E03707344), U64(0xA4093822299F31D0)]
_SHARED = 0xFFFF
SHORT_SKETCH = 512


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, in order, and where each text's begin (one more entry than texts)."""
    hashes, at = word_hashes(texts, lower=True)
    return distinct(*windows(hashes, at, SHINGLE), len(texts))


def _bands(upto: int) -> np.ndarray:
    """Lower ends of the size bands: sizes a <= b at a similarity of 3/4 lie in one band or in neighbouring ones."""
    ends = [1]
    while ends[-1] <= upto:
        ends.append(max(ends[-1] + 1, 4 * (ends[-1] - 1) // 3 + 1))
    return np.array([*ends, max(ends[-1] + 1, 4 * (ends[-1] - 1) // 3 + 1)], np.int64)


def _summary(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, n, fp1, fp2 and own (shingles in no other text) of each text."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in text_slices(batch):
                sets, at = shingle_sets(piece.column("text"))
                n = np.diff(at)
                text = np.repeat(np.arange(len(n)), n).astype(np.uint16)
                prints = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets ^ s))]) for s in _SALT[:2]]
                head = b"".join(x.tobytes() for x in (piece.column("doc_id").to_numpy().astype("<i8"), n.astype("<i8"), *(p[at[1:]] - p[at[:-1]] for p in prints)))
                rows = [(number % parts, number, None, head)]
                ordered = np.sort(sets)
                twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
                if len(twice):
                    known = twice[np.minimum(np.searchsorted(twice, sets), len(twice) - 1)] == sets
                    sets, text = sets[~known], text[~known]
                # a hash that several texts of the batch have goes out twice, for no text
                sets = np.concatenate([sets, twice, twice])
                text = np.concatenate([text, np.full(2 * len(twice), _SHARED, np.uint16)])
                part = ((sets >> U64(32)) * U64(parts)) >> U64(20)
                order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
                low, text = (sets & U64(0xFFFFFFFF)).astype("<u4")[order], text[order]
                cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=U64))
                rows += [(p, number, low[a:b].tobytes() + text[a:b].tobytes(), None) for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
                yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, v, t in zip(("part", "batch", "blob", "head"), zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))})
                number += 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch of texts, how many hashes of each text occur once in this part."""

        def done(blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
            lows = [np.frombuffer(b, "<u4", len(b) // 6) for _, b in blobs]
            ordered = np.sort(np.concatenate(lows))
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            out = []
            for (number, b), low in zip(blobs, lows):
                text = np.frombuffer(b, "<u2", offset=4 * len(low))
                if len(twice):
                    text = text[twice[np.minimum(np.searchsorted(twice, low), len(twice) - 1)] != low]
                out.append((number, np.bincount(text).astype("<u4").tobytes()))
            return pa.RecordBatch.from_pydict({"batch": pa.array([n for n, _ in out]), "own": pa.array([b for _, b in out], pa.binary()), "head": pa.nulls(len(out), pa.binary())})

        now, held = None, []
        for batch in batches:
            heads = batch.filter(pc.is_valid(batch.column("head")))
            if heads.num_rows:
                yield pa.RecordBatch.from_pydict({"batch": heads.column("batch"), "own": pa.nulls(heads.num_rows, pa.binary()), "head": heads.column("head")})
            for part, number, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "batch", "blob"))):
                if blob is None:
                    continue
                if part != now and held:
                    yield done(held)
                    held = []
                now = part
                held.append((number, blob))
        if held:
            yield done(held)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of each batch with their counts; a batch's head comes first."""
        head: np.ndarray | None = None
        own = np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(head[0].view("<i8")), "n": pa.array(head[1].view("<i8")), "fp1": pa.array(head[2].view("<i8")), "fp2": pa.array(head[3].view("<i8")), "own": pa.array(own)})

        for batch in batches:
            for first, counts in zip(batch.column("head").to_pylist(), batch.column("own").to_pylist()):
                if first is not None:
                    if head is not None:
                        yield done()
                    head = np.frombuffer(first, np.uint64).reshape(4, -1)
                    own = np.zeros(head.shape[1], np.int64)
                else:
                    one = np.frombuffer(counts, "<u4")
                    own[: len(one)] += one
        if head is not None:
            yield done()

    laid = docs.mapInArrow(lay, "part long, batch long, blob binary, head binary").repartition(parts, "part").sortWithinPartitions("part")
    counted = laid.mapInArrow(count, "batch long, own binary, head binary").repartition(parts, "batch").sortWithinPartitions("batch", F.col("head").isNull())
    return counted.mapInArrow(gather, "doc_id long, n long, fp1 long, fp2 long, own long")


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, set and sketch (512 parity bits as 8 numbers) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                sets, at = shingle_sets(piece.column("text"))
                n = np.diff(at)
                bit = mix(sets ^ _SALT[2]) % U64(SHORT_SKETCH)
                sketch = np.zeros(len(n) * (SHORT_SKETCH // 64), U64)
                np.bitwise_xor.at(sketch, np.repeat(np.arange(len(n)), n) * (SHORT_SKETCH // 64) + (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (SHORT_SKETCH // 64)), pa.array(sketch.view(np.int64)))
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "n": pa.array(n.astype(np.int64)), "set": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64))), "sketch": words})

    return docs.mapInArrow(run, "doc_id long, n long, set array<long>, sketch array<long>")


def block_keys(sets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of sketch blocks, the text of each, its role (partners in the same, the next or the previous band), and how many
    blocks of the role can be spared. sets: the hashes of all texts, one after the other; n: their numbers.

    With `most` differences, at least blocks - most blocks agree. Those that are empty in both texts are no more than the
    empty ones of either, so a text shares blocks - most - empty others, and one of them is enough.
    """
    text = np.repeat(np.arange(len(n)), n)
    ends = _bands(int(n.max(initial=1)))
    band = np.searchsorted(ends, n, side="right") - 1
    hashed = mix(sets)
    keys, owners, roles, spares = [], [], [], []
    for number, (low, high) in enumerate(((band, band), (band, band + 1), (band - 1, band))):
        used = (low >= 0) & (n > 0)
        most = (ends[np.minimum(low + 1, len(ends) - 1)] - 1 + ends[np.minimum(high + 1, len(ends) - 1)] - 1) // 7
        blocks = np.where(used, most + 1 + (most + 1) // 2, 0)
        begin = np.cumsum(blocks) - blocks
        role = mix((low * 2 + (low != high) + 1).astype(U64))
        mine = used[text]
        of, own = text[mine], hashed[mine]
        slot = begin[of] + (mix(own ^ role[of]) % blocks[of].astype(U64)).astype(np.int64)
        value = np.zeros(int(blocks.sum()), U64)
        filled = np.zeros(len(value), bool)
        np.bitwise_xor.at(value, slot, mix(own ^ _SALT[0]))
        filled[slot] = True
        who = np.repeat(np.arange(len(n)), blocks)
        empty = blocks - np.bincount(who[filled], minlength=len(n))
        # of blocks - most agreeing blocks some is not empty, unless there are as many empty ones
        keep = filled | (empty >= blocks - most)[who]
        place = (np.arange(len(value)) - begin[who]).astype(U64)
        keys.append(mix(value ^ mix(role[who] + place))[keep])
        owners.append(who[keep])
        roles.append(np.full(len(owners[-1]), number, np.int32))
        spares.append(np.maximum(blocks - most - empty - 1, 0)[owners[-1]].astype(np.int32))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(roles), np.concatenate(spares)


def _members(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                flat = piece.column("set").flatten().to_numpy().view(U64)
                keys, owner, role, spare = block_keys(flat, piece.column("n").to_numpy())
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(keys.view(np.int64)), "id": piece.column("doc_id").take(pa.array(owner)), "role": pa.array(role), "spare": pa.array(spare)})

    return sets.select("doc_id", "n", "set").mapInArrow(run, "bucket long, id long, role int, spare int")


def may_link(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
    """Sizes and sketches of linked texts: no further apart than sets of a similarity of 3/4 can be."""
    apart = np.bitwise_count((x["sketch"] ^ y["sketch"]).view(U64)).sum(axis=1, dtype=np.int64)
    return (x["n"] * 4 >= y["n"] * 3) & (y["n"] * 4 >= x["n"] * 3) & (7 * apart <= x["n"] + y["n"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row."""
    spark = docs.sparkSession
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = min(1 << 20, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    summary = saved(_summary(texts, parts), "parity-summary")
    full = summary.where("n > 0")
    classes = full.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("first"), F.min("own").alias("own"))
    alone = F.col("own") > F.floor(F.col("n") / 4)
    heads = classes.where(~alone).select(F.col("first").alias("doc_id"), F.col("n").alias("_n"), F.col("fp1"), F.col("fp2"))
    wanted = heads.select("doc_id").distinct()
    sets = saved(_sets(texts.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")), "parity-sets")
    members = saved(_members(sets), "parity-members")
    short = sets.select(F.col("doc_id").alias("id"), "n", "sketch")

    def may(a: str, b: str) -> Column:
        """`may_link` in Spark's terms."""
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        apart = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SHORT_SKETCH // 64)), F.lit(0))
        return (na * 4 >= nb * 3) & (nb * 4 >= na * 3) & (7 * apart <= na + nb)

    def similar(pairs: DataFrame, checked: bool) -> DataFrame:
        a, b = (short.select(F.col("id").alias(end), F.struct("n", "sketch").alias(f"_m{end}")) for end in "ab")
        near = pairs if checked else pairs.join(a, "a").join(b, "b").where(may("_ma", "_mb")).select("a", "b")
        whole = sets.select("doc_id", "n", "set")
        met = near.join(whole.toDF("a", "na", "sa"), "a").join(whole.toDF("b", "nb", "sb"), "b")
        return met.where(7 * F.size(F.array_intersect("sa", "sb")) >= 3 * (F.col("na") + F.col("nb"))).select("a", "b")

    groups = linked_groups(members, similar, short, may_link)
    groups = saved(groups, "parity-groups")
    dropped(sets, members)
    named = classes.select("n", "fp1", "fp2", "first").join(groups, classes["first"] == groups["id"], "left").select("n", "fp1", "fp2", F.coalesce("component", "first").alias("component_id"))
    out = summary.join(named, ["n", "fp1", "fp2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that are the first of their group, with their own columns; rows without a doc_id stay."""
    found = near_duplicates(docs).where("doc_id != component_id").select("doc_id").distinct()
    return docs.alias("d").join(found.alias("f"), F.col("d.doc_id") == F.col("f.doc_id"), "left_anti")

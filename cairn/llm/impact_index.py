"""Ranked lexical search over a bit-sliced index of impacts, with exact whole-number scores.

Terms are runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased. N documents have a term, L is
the number of all their terms, n that of one document, df the number of documents with a term, tf how often it occurs there:

    weight w = floor(1000 ln((2N + 2) / (2 df + 1)))        m = 100 - 90 + (90 n N) div L
    impact   = w ((1000000000 tf) div (1000 tf + 8 m))      score = sum of the impacts of an item's different terms

1. Documents are packed into blocks of at most BLOCK_DOCS, in the order of doc_id, with their postings term by term.
2. Frequencies of terms are counted over all blocks, each block sending a term once, and go back as weights.
3. A block of the index holds, bit by bit, the impacts of all its postings: plane b has bit b of each. The bits of one term's postings, put
   at their documents' places, are that term's slices of the block.
4. Items are searched in batches of bounded size (BATCH_ITEMS, BATCH_TERMS), each sent to all blocks. Slices of an item's terms
   are added by carries from bit to bit, for all items side by side; from the highest slice of the sum down, the set of the
   best k is narrowed until only equal scores are left. Each task keeps k documents for each item.

Terms are told apart by 64-bit hashes: with ten billion different terms, one of five thousand asked for is taken for another with a
chance of 3e-6.

Results for odd input: a null text has no terms; documents without terms count nowhere; documents without a doc_id and items
without an item_id take no part; rows that repeat a doc_id are documents of their own; rows that repeat an item_id are one item
with the terms of all; an item without terms, or whose terms stand nowhere, has no rows; ties go to the smaller doc_id; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from .common import dropped, saved, text_slices
from .textgrams import U64, word_hashes

BLOCK_DOCS, BLOCK_BYTES = 4096, 8 << 20
#: Items searched at a time, and their terms, which are sent to all tasks: 2 MB at most, or one item.
BATCH_ITEMS, BATCH_TERMS = 1024, 1 << 18
#: Items whose sums are held at a time, and terms whose slices are.
GROUP_ITEMS, GROUP_TERMS = 128, 2048
K = 10
_GAP = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term, and where each text's terms begin."""
    return word_hashes(texts, lower=True, gaps=_GAP)


def postings(docs: DataFrame) -> DataFrame:
    """Blocks: docs, sizes (terms of each), n_docs and n_terms; terms in order, counts (documents of each), and term by term the
    slots (places in the block) and tfs of its documents."""

    def laid(number: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids = np.concatenate([h[0] for h in held])
        size = np.concatenate([h[1] for h in held])
        order = np.argsort(ids, kind="stable")
        slot = np.empty(len(ids), np.int64)
        slot[order] = np.arange(len(ids))
        slot = np.repeat(slot, size)
        terms, at = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
        pair, tf = np.unique(at * BLOCK_DOCS + slot, return_counts=True)
        counts = np.bincount(pair // BLOCK_DOCS, minlength=len(terms))
        columns = {"block": number, "n_docs": int(np.count_nonzero(size)), "n_terms": int(size.sum())}
        columns |= {"docs": ids[order].astype("<i8").tobytes(), "sizes": size[order].astype("<i8").tobytes(), "terms": terms.tobytes(), "counts": counts.astype("<u4").tobytes()}
        columns |= {"slots": (pair % BLOCK_DOCS).astype("<u2").tobytes(), "tfs": tf.astype("<u4").tobytes()}
        return pa.RecordBatch.from_pydict({k: [v] for k, v in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            for piece in text_slices(batch, rows=512):
                found, at = terms_of(piece.column("text"))
                if held and (rows + piece.num_rows > BLOCK_DOCS or size >= BLOCK_BYTES):
                    yield laid(number, held)
                    number, held, rows, size = number + 1, [], 0, 0
                held.append((piece.column("doc_id").to_numpy(), np.diff(at), found))
                rows += piece.num_rows
                size += piece.column("text").nbytes
        if held:
            yield laid(number, held)

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "block long, n_docs long, n_terms long, docs binary, sizes binary, terms binary, counts binary, slots binary, tfs binary")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _weights(blocks: DataFrame, n: int, parts: int) -> DataFrame:
    """block, part and the weights of the block's terms in the part; parts are ranges of the terms' hashes."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                terms = np.frombuffer(row["terms"], U64)
                part = ((terms >> U64(32)) * U64(parts)) >> U64(32)
                here, cut = np.unique(part, return_index=True)
                cut = [*cut.tolist(), len(terms)]
                cells = [(row["terms"][8 * a : 8 * b], row["counts"][4 * a : 4 * b]) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_pydict({"part": pa.array(here.astype(np.int64)), "block": pa.array([row["block"]] * len(here), pa.int64()), "terms": pa.array([t for t, _ in cells], pa.binary()), "counts": pa.array([c for _, c in cells], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}

        def done(part: int, held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            terms, at = np.unique(np.concatenate([np.frombuffer(t, U64) for _, t, _ in held]), return_inverse=True)
            df = np.zeros(len(terms), np.int64)
            np.add.at(df, at, np.concatenate([np.frombuffer(c, "<u4") for *_, c in held]))
            values, of = np.unique(df, return_inverse=True)
            for v in values.tolist():
                if v not in known:
                    known[v] = weight(n, v)
            found = np.array([known[v] for v in values.tolist()], "<i4")[of][at]
            cut = np.cumsum([len(t) // 8 for _, t, _ in held])
            for (block, *_), own in zip(held, np.split(found, cut[:-1])):
                yield pa.RecordBatch.from_pydict({"block": pa.array([block]), "part": pa.array([part]), "weights": pa.array([own.tobytes()], pa.binary())})

        now, held = None, []
        for batch in batches:
            for part, block, terms, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "terms", "counts"))):
                if part != now and held:
                    yield from done(now, held)
                    held = []
                now = part
                held.append((block, terms, counts))
        if held:
            yield from done(now, held)

    laid = blocks.select("block", "terms", "counts").mapInArrow(lay, "part long, block long, terms binary, counts binary")
    return laid.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, "block long, part long, weights binary")


def impacts(w: np.ndarray, tf: np.ndarray, size: np.ndarray, n: int, all_terms: int) -> np.ndarray:
    if int(size.max(initial=0)) * 90 * n < 1 << 63:
        m = 10 + (90 * size * n) // all_terms
    else:
        # beyond 64 bits on the way; the quotients fit
        m = np.array([10 + 90 * int(s) * n // all_terms for s in size], np.int64)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def build(docs: DataFrame) -> DataFrame:
    """The index of all documents, a row for each block, as a work table: docs, terms, counts, slots and planes (packed bits of
    the impacts of all postings, term by term, lowest first)."""
    spark = docs.sparkSession
    blocks = saved(postings(docs), "impact-blocks")
    sums = blocks.agg(F.sum("n_docs"), F.sum("n_terms"), F.sum(F.octet_length("terms"))).first()
    n, all_terms = sums[0] or 0, sums[1] or 0
    parts = min(1 << 20, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (sums[2] or 0) // (16 << 20), 1))
    weights = _weights(blocks, n, parts)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's weights, part after part, come before its postings."""
        held: list[bytes] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["docs"] is None:
                    held.append(row["weights"])
                    continue
                counts, slots, tf = (np.frombuffer(row[c], t) for c, t in (("counts", "<u4"), ("slots", "<u2"), ("tfs", "<u4")))
                w = np.repeat(np.frombuffer(b"".join(held), "<i4").astype(np.int64), counts)
                impact = impacts(w, tf.astype(np.int64), np.frombuffer(row["sizes"], "<i8")[slots], n, all_terms)
                planes = [np.packbits((impact >> b) & 1 != 0, bitorder="little").tobytes() for b in range(int(impact.max(initial=0)).bit_length())]
                held = []
                yield pa.RecordBatch.from_pydict({**{c: [row[c]] for c in ("block", "docs", "terms", "counts", "slots")}, "planes": pa.array([planes], pa.list_(pa.binary()))})

    columns = ["block", "part", "weights", "docs", "sizes", "terms", "counts", "slots", "tfs"]
    kinds = dict(blocks.dtypes) | dict(weights.dtypes)
    both = [df.select(*[c if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns]) for df in (weights, blocks)]
    met = both[0].unionByName(both[1]).repartition("block").sortWithinPartitions("block", F.col("part").asc_nulls_last())
    index = saved(met.mapInArrow(lay, "block long, docs binary, terms binary, counts binary, slots binary, planes array<binary>"), "impact-index")
    dropped(blocks)
    return index


class Slices:
    """Sums of bit-sliced numbers: plane b holds bit b of the sum for each row (item) and each bit place (document)."""

    def __init__(self, rows: int, words: int) -> None:
        self.shape, self.planes = (rows, words), []

    def add(self, rows: np.ndarray, planes: list[np.ndarray], of: np.ndarray) -> None:
        """Add to some rows, each once, the numbers of the rows `of` of planes; carries go from bit to bit."""
        carry = np.zeros((len(rows), self.shape[1]), U64)
        for b in range(1 << 30):
            if b >= len(planes) and not carry.any():
                return
            if b == len(self.planes):
                self.planes.append(np.zeros(self.shape, U64))
            have = self.planes[b][rows]
            if b < len(planes):
                more = planes[b][of]
                half = have ^ more
                self.planes[b][rows] = half ^ carry
                carry = (have & more) | (carry & half)
            else:
                self.planes[b][rows] = have ^ carry
                carry &= have

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and number of the k largest numbers above 0 of each row, of equal ones the first places."""
        if not self.planes:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        sure = np.zeros(self.shape, U64)
        open_ = np.bitwise_or.reduce(self.planes, axis=0)
        for plane in reversed(self.planes):
            # those sure of their place, and those that have this bit among the undecided
            larger = open_ & plane
            many = np.bitwise_count(sure | larger).sum(axis=1, dtype=np.int64)[:, None] > k
            sure = np.where(many, sure, sure | larger)
            open_ = np.where(many, larger, open_ & ~plane)
        row, place = [], []
        bits = [np.unpackbits(x.view(np.uint8), axis=1, bitorder="little") for x in (sure, open_)]
        for r in range(self.shape[0]):
            top = np.flatnonzero(bits[0][r])
            top = np.concatenate([top, np.flatnonzero(bits[1][r])[: k - len(top)]])
            row.append(np.full(len(top), r))
            place.append(top)
        row, place = np.concatenate(row), np.concatenate(place)
        score = np.zeros(len(row), np.int64)
        for b, plane in enumerate(self.planes):
            score |= ((plane[row, place >> 6] >> (place & 63).astype(U64)) & U64(1)).astype(np.int64) << b
        return row, place, score


class Block:
    """One block of the index."""

    def __init__(self, row: dict) -> None:
        self.docs = np.frombuffer(row["docs"], "<i8")
        self.terms = np.frombuffer(row["terms"], U64)
        self.end = np.cumsum(np.frombuffer(row["counts"], "<u4"), dtype=np.int64)
        self.slots = np.frombuffer(row["slots"], "<u2")
        self.planes = [np.frombuffer(p, np.uint8) for p in row["planes"]]
        self.words = -(-len(self.docs) // 64)

    def slices(self, numbers: np.ndarray) -> list[np.ndarray]:
        """The impact slices of some of the block's terms: for each bit, a row of the block's documents for each term."""
        end = self.end[numbers]
        many = end - np.where(numbers > 0, self.end[numbers - 1], 0)
        row = np.repeat(np.arange(len(numbers)), many)
        at = (end - np.cumsum(many))[row] + np.arange(len(row))
        slot = self.slots[at].astype(np.int64)
        word = row * self.words + (slot >> 6)
        cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        bit, byte, shift = U64(1) << (slot & 63).astype(U64), at >> 3, (at & 7).astype(np.uint8)
        out = []
        for plane in self.planes:
            dense = np.zeros((len(numbers), self.words), U64)
            dense.ravel()[word[cut]] = np.bitwise_or.reduceat(np.where((plane[byte] >> shift) & 1, bit, U64(0)), cut)
            out.append(dense)
        return out

    def search(self, item: np.ndarray, term: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item, doc_id and score of the k best documents of each item; item, term: what is asked for, in the order of the items."""
        if not len(self.terms):
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        met = self.terms[at] == term
        item, at = item[met], at[met]
        found = []
        names = np.unique(item)
        for first in range(0, len(names), GROUP_ITEMS):
            some = names[first : first + GROUP_ITEMS]
            lo, hi = np.searchsorted(item, some[0]), np.searchsorted(item, some[-1], side="right")
            row, own = np.searchsorted(some, item[lo:hi]), at[lo:hi]
            sums = Slices(len(some), self.words)
            wanted = np.unique(own)
            for a in range(0, len(wanted), GROUP_TERMS):
                chunk = wanted[a : a + GROUP_TERMS]
                planes = self.slices(chunk)
                mine = np.flatnonzero((own >= chunk[0]) & (own <= chunk[-1]))
                # the first term of every item, then the second, and so on
                turn = np.arange(len(mine)) - np.searchsorted(row[mine], row[mine])
                for t in range(int(turn.max(initial=-1)) + 1):
                    now = mine[turn == t]
                    sums.add(row[now], planes, np.searchsorted(chunk, own[now]))
            which, place, score = sums.best(k)
            found.append((some[which], self.docs[place], score))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*found))


def _wanted(items: DataFrame) -> DataFrame:
    """id and terms (different hashes, in order) of each item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                found, at = terms_of(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.view(np.int64)))], names=["id", "terms"])

    some = items.where("item_id IS NOT NULL").select(F.col("item_id").alias("id"), "text").mapInArrow(run, f"id {kind}, terms array<long>")
    # a set of the terms of one item
    return some.select("id", F.explode("terms").alias("term")).groupBy("id").agg(F.collect_set("term").alias("terms"))


def _searched(index: DataFrame, ids: list, terms: list[np.ndarray], k: int, kind: DataType) -> DataFrame:
    """id, rank, doc_id and score for one batch of items."""
    item = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
    names_kind = to_arrow_type(kind)
    batch = index.sparkSession.sparkContext.broadcast((pa.array(ids, names_kind), item, np.concatenate(terms)))  # bounded by BATCH_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, item, term = batch.value
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        for rows in batches:
            for at in range(rows.num_rows):
                found = Block(rows.slice(at, 1).to_pylist()[0]).search(item, term, k)
                best = tuple(np.concatenate(x) for x in zip(best, found))
                order = np.lexsort([best[1], -best[2], best[0]])
                place = np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order])
                best = tuple(x[order[place < k]] for x in best)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(best[0])), pa.array(best[1]), pa.array(best[2])], names=["item_id", "doc_id", "score"])

    found = index.mapInArrow(run, f"item_id {kind.simpleString()}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item.

    Items come to the driver a part at a time and go out again in batches, of which one is held; results of several batches are
    written as they are made.
    """
    kind = items.schema["item_id"].dataType
    parts: list[DataFrame] = []
    ids, terms, size = [], [], 0
    for row in _wanted(items).toLocalIterator():
        own = np.sort(np.array(row.terms, np.int64).view(U64))
        if ids and (len(ids) == BATCH_ITEMS or size + len(own) > BATCH_TERMS):
            parts.append(saved(_searched(index, ids, terms, k, kind), "impact-found"))
            ids, terms, size = [], [], 0
        ids.append(row.id)
        terms.append(own)
        size += len(own)
    if ids:
        last = _searched(index, ids, terms, k, kind)
        parts.append(saved(last, "impact-found") if parts else last)
    if not parts:
        return index.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out

"""Removal of lines that repeat, exactly or nearly, anywhere in the corpus.

Lines are compared in lower case, with runs of blanks as one space. Blank lines are left alone; all others go if they
equal an earlier one. Lines of at least MIN_CHARS characters or MIN_WORDS words are also compared nearly: two are linked if
their edit similarity (1 - Levenshtein distance / longer length) is at least MIN_SIMILARITY. Candidates are found by
MinHashes over the eight-byte pieces of a normal form (ASCII punctuation as spaces, digits as 0 unless they are most of
the line), which never makes lines equal by itself: lines meet if they agree in ROWS hashes of
one of BANDS bands, and are compared if sketches of one bit for each hash differ in at most MOST_BITS bits. Of each
connected group of lines, the occurrence with the smallest (doc_id, place) stays.

Results for odd input: a null text has no lines and stays null; an emptied text is ''; rows that repeat a doc_id are told
apart by their text, and wholly equal rows lose the same lines; rows without a doc_id count as the first document.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved, text_slices
from .components import linked_groups
from .edits import within
from .textgrams import U64, bytes_of, mix, pieces

#: A line of so many words, or of so many characters whatever the script, can have near lines.
MIN_WORDS = 5
MIN_CHARS = 16
MIN_SIMILARITY = 0.8
#: Ids that are broadcast, at most; more are joined by a shuffle.
MOST_SENT = 1_000_000
ROWS, BANDS = 3, 42
MOST_BITS = 50
_HASHES = 128
_RNG = np.random.default_rng(20240301)
_FLIP = _RNG.integers(0, 1 << 32, _HASHES, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
_FORM = np.array([48 if _DIGIT[c] else 32 if c < 128 and not chr(c).isalpha() else c for c in range(256)], np.uint8)
_SHARED = 0xFFFF
_SLICE = 1 << 14
_KEYS, _OWN, _SIGNS = range(3)
_FOUND = {"bucket": pa.int64(), "id": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "length": pa.int32()}


def compared(lines: pa.Array) -> pa.Array:
    """The form whose edit similarity counts: small letters, runs of blanks as one space, none at the ends."""
    out = pc.utf8_lower(lines)
    data, _ = bytes_of(out)
    for blank in "\t\v\f\r":
        if (data == ord(blank)).any():
            out = pc.replace_substring(out, blank, " ")
    while True:
        space = bytes_of(out)[0] == 32
        if not (space[1:] & space[:-1]).any():
            break
        fewer = pc.replace_substring(out, "  ", " ")
        if pc.sum(pc.binary_length(fewer)).as_py() == pc.sum(pc.binary_length(out)).as_py():
            # only at the ends of lines that follow each other
            break
        out = fewer
    return pc.utf8_trim(out, " ")


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes by which candidates are found, and where each text's begin.

    Of ASCII, punctuation counts as a space and a digit as 0; lines of mostly digits keep theirs, as they would all be alike.
    """
    data, at = bytes_of(texts)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])[at]
    numbers = 2 * np.diff(digits) > np.diff(at)
    return np.where(_DIGIT[data] & np.repeat(numbers, np.diff(at)), data, _FORM[data]), at


def lines(docs: DataFrame) -> DataFrame:
    """The lines that are not blank: doc, mark, place, hashes (h1, h2) and length of the compared form, whether it is fuzzy.

    Their text is not carried along, so that little is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, limit=1 << 20):
                split = pc.split_pattern(piece.column("text").cast(pa.large_string()), "\n")
                text, row = compared(pc.list_flatten(split)), pc.list_parent_indices(split).to_numpy()
                where = np.flatnonzero(pc.binary_length(text).to_numpy() > 0)
                begin, of = np.searchsorted(row, np.arange(piece.num_rows)), row[where]
                text = text.take(pa.array(where))
                columns = {c: piece.column(c).take(pa.array(of)) for c in ("doc", "mark")} | {"place": pa.array((where - begin[of]).astype(np.int32))}
                digest = np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in text.cast(pa.large_binary()).to_pylist()]), np.int64).reshape(-1, 2)
                columns |= {"h1": pa.array(digest[:, 0].copy()), "h2": pa.array(digest[:, 1].copy())}
                length = pc.utf8_length(text).cast(pa.int32())
                fuzzy = length.to_numpy() >= MIN_CHARS
                short = np.flatnonzero(~fuzzy)
                fuzzy[short] = pc.count_substring(text.take(pa.array(short)), " ").to_numpy() + 1 >= MIN_WORDS
                yield pa.RecordBatch.from_pydict(columns | {"length": length, "fuzzy": pa.array(fuzzy)})

    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(run, f"doc {kind}, mark long, place int, h1 long, h2 long, length int, fuzzy boolean")


def minhashes(texts: pa.Array) -> np.ndarray:
    """A row of MinHashes over the pieces of each text."""
    low, at = pieces(*normal(texts))
    out, one, begin = np.empty((_HASHES, len(texts)), np.uint32), np.empty_like(low), at[:-1]
    for k in range(_HASHES if len(texts) else 0):
        np.bitwise_xor(low, _FLIP[k], out=one)
        np.multiply(one, _ODD[k], out=one)
        np.minimum.reduceat(one, begin, out=out[k])
    return np.ascontiguousarray(out.T)


def sketches(found: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each row of MinHashes: one bit of each."""
    return np.packbits((found >> np.uint32(16)).astype(np.uint8) & 1, axis=1, bitorder="little").view(U64)


def distance(a: str, b: str, most: int) -> int | None:
    """The Levenshtein distance, or None if it is over `most`.

    Bit by bit for a whole row of the table at once (Myers, in Hyyro's form): the work for each letter of `b` is a few
    operations on integers of as many bits as `a` has letters.
    """
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not a or not b:
        size = max(len(a), len(b))
        return size if size <= most else None
    where = {c: int.from_bytes(np.packbits(np.frombuffer(a.encode("utf-32-le"), "<u4") == ord(c), bitorder="little").tobytes(), "little") for c in set(a)}
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        same = where.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(more & top) - bool(less & top)
        if score - left > most:
            return None
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | (full & ~(diagonal | more)), more & diagonal
    return score if score <= most else None


def similar_lines(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether the edit similarity of each pair of lines is at least MIN_SIMILARITY."""
    longer = np.maximum(pc.utf8_length(a).to_numpy(), pc.utf8_length(b).to_numpy())
    return within(a, b, np.floor(longer * (1 - MIN_SIMILARITY) + 1e-9).astype(np.int64), distance)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(similar_lines(batch.column("la"), batch.column("lb")), pa.bool_())).select(["a", "b"])


def block_keys(found: np.ndarray) -> np.ndarray:
    """A row of 32-bit keys for each row of MinHashes, one for each band."""
    out = np.empty((len(found), BANDS), np.uint32)
    for k in range(BANDS):
        value = np.full(len(found), k, U64)
        for j in range(ROWS):
            value = mix(value ^ found[:, ROWS * k + j])
        out[:, k] = (value >> U64(32)).astype(np.uint32)
    return out


def _members(texts: DataFrame, parts: int) -> DataFrame:
    """Of lines (id, line, length): bucket and id of the keys that other lines have too, and, in rows without a bucket, id, sketch (s1,
    s2) and length of every line, as both are made of the same MinHashes.

    Keys are made here and not kept with the texts, as they are larger than most lines. They travel as six bytes, many to a row, to the part that finds those that repeat; a key that several lines of one
    slice have goes out twice only, for no line, so that a key of very many lines stays small.
    """

    def split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((keys >> U64(32)) * U64(parts)) >> U64(32), (keys & U64(0xFFFFFFFF)).astype("<u4")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(batch.column("id").to_numpy())
            ids = batch.column("id").to_numpy()[order]
            bands, signs = (np.concatenate(x)[order] for x in zip(*((block_keys(m), sketches(m)) for m in (minhashes(x.column("line")) for x in text_slices(batch, "line", 1 << 18)))))
            marked = np.column_stack([ids, signs.view(np.int64), batch.column("length").to_numpy()[order]]).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([number % parts]), pa.array([_SIGNS], pa.int8()), pa.array([int(ids[0])]), pa.array([marked.tobytes()], pa.binary())], names=["part", "kind", "base", "blob"])
            at = 0
            while at < len(ids):
                # offsets within a slice fit into two bytes, and none is the mark of a shared key
                end = min(at + _SLICE, int(np.searchsorted(ids, ids[at] + _SHARED)))
                # a key and the number of its band fit into 64 bits
                keys = mix(bands[at:end] | (np.arange(BANDS, dtype=U64) << U64(32)))
                line = np.repeat((ids[at:end] - ids[at]).astype("<u2"), keys.shape[1])
                keys = keys.ravel()
                ordered = np.sort(keys)
                twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
                known = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys if len(twice) else np.zeros(len(keys), bool)
                part, low = split(keys[known])
                own = ((part << U64(32)) | low).astype("<u8").tobytes() + (ids[at] + line[known].astype(np.int64)).astype("<i8").tobytes()
                rows = [(number % parts, _OWN, int(ids[at]), own)] if known.any() else []
                keys, line = np.concatenate([keys[~known], twice, twice]), np.concatenate([line[~known], np.full(2 * len(twice), _SHARED, "<u2")])
                part, low = split(keys)
                order = np.argsort(part, kind="stable")
                low, line = low[order], line[order]
                cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=U64)).tolist()
                rows += [(p, _KEYS, int(ids[at]), low[a:b].tobytes() + line[a:b].tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, v, t in zip(("part", "kind", "base", "blob"), zip(*rows), (pa.int64(), pa.int8(), pa.int64(), pa.binary()))})
                number, at = number + 1, end

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(n: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _FOUND.items()})

        def rows(bucket: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(ids), 1 << 16):
                some = slice(a, a + (1 << 16))
                yield batch_of(len(ids[some]), {"bucket": bucket[some], "id": ids[some]})

        def done(part: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            lows = [np.frombuffer(b, "<u4", len(b) // 6) for _, b in held]
            ordered = np.sort(np.concatenate(lows))
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            for (base, b), low in zip(held, lows) if len(twice) else ():
                line = np.frombuffer(b, "<u2", offset=4 * len(low))
                keep = (twice[np.minimum(np.searchsorted(twice, low), len(twice) - 1)] == low) & (line != _SHARED)
                yield from rows((part << 32) | low[keep].astype(np.int64), base + line[keep].astype(np.int64))

        now, held = -1, []
        for batch in batches:
            for part, kind, base, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "base", "blob"))):
                if kind == _SIGNS:
                    marked = np.frombuffer(blob, "<i8").reshape(-1, 4)
                    yield batch_of(len(marked), {c: marked[:, k].copy() for k, c in enumerate(("id", "s1", "s2", "length"))})
                    continue
                if kind == _OWN:
                    yield from rows(np.frombuffer(blob, "<i8", len(blob) // 16), np.frombuffer(blob, "<i8", offset=len(blob) // 2))
                    continue
                if part != now and held:
                    yield from done(now, held)
                    held = []
                now = part
                held.append((base, blob))
        if held:
            yield from done(now, held)

    laid = texts.select("id", "line", "length").mapInArrow(lay, "part long, kind tinyint, base long, blob binary")
    return laid.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(find, "bucket long, id long, s1 long, s2 long, length int")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, h2, compared form and its length of lines (h1, h2, doc, mark, place), read again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, limit=1 << 18):
                split = pc.split_pattern(piece.column("text").cast(pa.large_string()), "\n")
                begin = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
                asked = piece.column("lines")
                of, inner = pc.list_parent_indices(asked).to_numpy(), pc.list_flatten(asked)
                at = begin[of] + inner.field("place").to_numpy()
                text = compared(pc.list_flatten(split).take(pa.array(at)))
                columns = {c: inner.field(c) for c in ("h1", "h2")}
                yield pa.RecordBatch.from_pydict(columns | {"line": text.cast(pa.string()), "length": pc.utf8_length(text).cast(pa.int32())})

    zero = "coalesce(doc, cast(0 as {0}))".format(docs.schema["doc_id"].dataType.simpleString())
    from_docs = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), "text", F.xxhash64("text").alias("mark"))
    # both sides and the removal of repeated rows are dealt out by the same two columns, so the text travels once
    from_docs = from_docs.select(F.expr(zero).alias("_doc"), F.xxhash64("doc", "mark").alias("_key"), "text")
    keyed = wanted.select(F.expr(zero).alias("_doc"), F.xxhash64("doc", "mark").alias("_key"), "h1", "h2", "place")
    # the lines of one text
    rows = keyed.groupBy("_doc", "_key").agg(F.collect_set(F.struct("h1", "h2", "place")).alias("lines"))
    met = from_docs.join(rows, ["_doc", "_key"]).dropDuplicates(["_doc", "_key"])
    return met.select("text", "lines").mapInArrow(run, "h1 long, h2 long, line string, length int")


def may_link(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
    """Whether lines' sketches and lengths are close enough to be compared."""
    apart = sum(np.bitwise_count((x[c] ^ y[c]).view(U64)).astype(np.int64) for c in ("s1", "s2"))
    return (apart <= MOST_BITS) & (np.minimum(x["length"], y["length"]) >= MIN_SIMILARITY * np.maximum(x["length"], y["length"]))


def groups(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different lines (h1, h2, first, n), and h1, h2 and component of those that are linked with another; work tables."""
    occurrence = F.struct("doc", "mark", "place")
    distinct = found.groupBy("h1", "h2", "length", "fuzzy").agg(F.min(occurrence).alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = saved(distinct, "lines")
    parts = min(1 << 20, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    # the text of each different line with near ones is read again, where it occurs first; ids follow the order of the files
    wanted = distinct.where("fuzzy").select("h1", "h2", "first.doc", "first.mark", "first.place")
    text = saved(_texts(docs, wanted).withColumn("id", F.monotonically_increasing_id()), "lines-text")
    laid = saved(_members(text, parts), "lines-members")
    members = laid.where("bucket IS NOT NULL").select("bucket", "id")
    small = saved(laid.where("bucket IS NULL").select("id", "s1", "s2", "length").join(members.select("id").distinct(), "id", "left_semi"), "lines-busy")
    scratch = [text, laid, small]

    def may(a: str, b: str) -> Column:
        """`may_link` in Spark's terms."""
        apart = F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))
        return (apart <= MOST_BITS) & (F.least(f"{a}.length", f"{b}.length") >= MIN_SIMILARITY * F.greatest(f"{a}.length", f"{b}.length"))

    def similar(pairs: DataFrame, checked: bool) -> DataFrame:
        mark = F.struct("s1", "s2", "length")
        a, b = small.select(F.col("id").alias("a"), mark.alias("_x")), small.select(F.col("id").alias("b"), mark.alias("_y"))
        near = pairs.join(a, "a").join(b, "b").where(F.lit(checked) | may("_x", "_y")).select("a", "b")
        # few pairs are left: written first, their ids can go to the text where it lies, if they are few enough to be sent
        near = saved(near, "lines-near")
        scratch.append(near)
        ids = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
        ids = F.broadcast(ids) if 2 * near.count() <= MOST_SENT else ids
        wanted = text.select("id", "line").join(ids, "id", "left_semi")
        both = near.join(wanted.toDF("a", "la"), "a").join(wanted.toDF("b", "lb"), "b")
        return both.mapInArrow(_compared, "a long, b long")

    linked = linked_groups(members, similar, small, may_link, text.select("id", "line"), similar_lines)
    linked = saved(text.select("id", "h1", "h2").join(linked, "id").drop("id"), "lines-linked")
    dropped(*scratch)
    return distinct, linked


def removals(docs: DataFrame) -> DataFrame:
    """doc, mark and gone (places of the lines to remove) of the rows that lose lines; a work table."""
    found = saved(lines(docs), "lines-all")
    distinct, linked = groups(docs, found)
    named = distinct.select("h1", "h2", "first", "n").join(linked, ["h1", "h2"], "left")
    kept = named.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("kept"))
    several = named.join(kept, "component", "left").where("component IS NOT NULL OR n > 1").select("h1", "h2", F.coalesce("kept", "first").alias("kept"))
    gone = found.select("doc", "mark", "place", "h1", "h2").join(several, ["h1", "h2"]).where(~F.struct("doc", "mark", "place").eqNullSafe(F.col("kept")))
    # an array of the lines of one text
    gone = saved(gone.groupBy("doc", "mark").agg(F.array_sort(F.collect_set("place")).alias("gone")), "lines-gone")
    dropped(found, distinct, linked)
    return gone


def deduplicated(docs: DataFrame, counts: bool = False) -> DataFrame:
    """The documents without their repeated lines; with counts also n_lines and removed (the places removed)."""
    return without(docs, removals(docs), counts)


def without(docs: DataFrame, gone: DataFrame, counts: bool = False) -> DataFrame:
    """The documents without the lines at the places `gone` (in order) of each doc and mark."""
    gone = gone.select(F.col("doc").alias("_doc"), F.col("mark").alias("_gone_mark"), "gone").alias("g")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("text").alias("mark")).alias("d")
    joined = whole.join(gone, F.col("d.doc.doc_id").eqNullSafe(F.col("g._doc")) & (F.col("d.mark") == F.col("g._gone_mark")), "left")
    split = F.split(F.col("d.doc.text"), "\n")
    # what stands between removed lines, piece by piece: each line is touched once. The inner function has the lines as a variable, so
    # the text is split once
    between = lambda lines: F.zip_with(F.concat(F.array(F.lit(-1)), "g.gone"), F.concat("g.gone", F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    rest = F.get(F.transform(F.array(split), lambda lines: F.array_join(F.flatten(between(lines)), "\n")), F.lit(0))
    text = F.when(F.col("g.gone").isNull(), F.col("d.doc.text")).otherwise(rest)
    out = [text.alias("text") if c == "text" else F.col(f"d.doc.`{c}`") for c in docs.columns]
    if counts:
        out += [F.when(F.col("d.doc.text").isNull(), 0).otherwise(F.size(split)).alias("n_lines"), F.coalesce("g.gone", F.array().cast("array<int>")).alias("removed")]
    return joined.select(*out)

"""Token ids in wavelet-matrix files: one compressed file for each shard, read by position, by count or by occurrence.

A shard holds the ids of a range of documents, one document after the other. Ids are renumbered by how often they occur,
so that high bit-planes are nearly empty and compress well. Plane by plane, from the highest bit, the file keeps the bits
in the order in which the ids with a 0 there come first; ranks are counted from a directory of set bits.

File: magic, the length of the header, the header (JSON), then sections compressed with zstd: document ids, document
lengths, symbols, and each plane's bits. The directory is counted again on reading.

Results for odd input: a null or empty text has its end id only; rows that repeat a doc_id are ordered by their text; rows
without a doc_id come first and keep none; an empty table gives no file and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_slices, work_path

MAGIC = b"WVM1"
#: Ids in one file at most, so that a task holds one file's worth of ids.
MOST_IDS = 8 << 20
#: Words whose ids a worker remembers.
MOST_WORDS = 1_000_000
_BLOCK = 512
#: Letters of ASCII, Latin-1 and Latin Extended-A in composed form whose small form is one letter, wherever they stand.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"


class WaveletMatrix:
    """Ids with rank and select, built from ids or read from its planes."""

    def __init__(self, length: int, symbols: np.ndarray, planes: list[np.ndarray]) -> None:
        """planes: packed bits from the highest; symbols: the id of each number."""
        self.length, self.symbols, self.planes = length, symbols, planes
        self.number = {int(s): i for i, s in enumerate(symbols)}
        self.ones, self.zeros = [], []
        for bits in planes:
            # set bits before each block of 512
            padded = np.zeros(-(-max(1, len(bits)) // (_BLOCK // 8)) * (_BLOCK // 8), np.uint8)
            padded[: len(bits)] = bits
            counts = np.bitwise_count(padded.reshape(-1, _BLOCK // 8)).sum(axis=1, dtype=np.int64)
            self.ones.append(np.concatenate([[0], np.cumsum(counts)]))
            self.zeros.append(length - int(self.ones[-1][-1]))

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        symbols = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype(np.uint32)
        rename = np.zeros(len(counts), np.uint32)
        rename[symbols] = np.arange(len(symbols), dtype=np.uint32)
        now = rename[ids].astype(np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
        planes = []
        for level in reversed(range(max(1, (len(symbols) - 1).bit_length()))):
            bit = (now >> now.dtype.type(level)) & now.dtype.type(1) != 0
            planes.append(np.packbits(bit))
            now = np.concatenate([now[~bit], now[bit]])
        return cls(len(ids), symbols, planes)

    def _rank(self, plane: int, at: int) -> int:
        """Set bits of a plane before a place."""
        bits, block = self.planes[plane], at // _BLOCK
        first = block * (_BLOCK // 8)
        rest = np.unpackbits(bits[first : -(-at // 8)])[: at - block * _BLOCK]
        return int(self.ones[plane][block]) + int(rest.sum())

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.length:
            raise IndexError(at)
        number = 0
        for p, bits in enumerate(self.planes):
            bit = bits[at >> 3] >> (7 - (at & 7)) & 1
            ones = self._rank(p, at)
            at = self.zeros[p] + ones if bit else at - ones
            number = number << 1 | int(bit)
        return int(self.symbols[number])

    def _range(self, number: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a number before place `end` lie after the last plane."""
        lo = 0
        for p in range(len(self.planes)):
            bit = number >> (len(self.planes) - 1 - p) & 1
            a, b = self._rank(p, lo), self._rank(p, end)
            lo, end = (self.zeros[p] + a, self.zeros[p] + b) if bit else (lo - a, end - b)
        return lo, end

    def count(self, symbol: int, before: int | None = None) -> int:
        """How often an id occurs, in all or before a place."""
        number = self.number.get(symbol)
        if number is None:
            return 0
        lo, hi = self._range(number, self.length if before is None else before)
        return hi - lo

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of a plane."""
        ones = self.ones[plane]
        have = ones if bit else np.arange(len(ones)) * _BLOCK - ones
        block = int(np.searchsorted(have, k, side="right")) - 1
        first = block * (_BLOCK // 8)
        bits = np.unpackbits(self.planes[plane][first : first + _BLOCK // 8])
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(have[block])])

    def occurrence(self, symbol: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        number = self.number[symbol]
        at = self._range(number, self.length)[0] + k
        for p in reversed(range(len(self.planes))):
            bit = number >> (len(self.planes) - 1 - p) & 1
            at = self._select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order: the planes' partitions are undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.length, kind)
        for p in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[p], count=self.length).view(bool)
            back = np.empty_like(now)
            back[~bit] = now[: self.zeros[p]]
            back[bit] = now[self.zeros[p] :] | kind(1 << (len(self.planes) - 1 - p))
            now = back
        return self.symbols[now]


def to_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """A shard's file; nulls: how many of the first documents have no id."""
    matrix = WaveletMatrix.build(ids)
    pack = zstandard.ZstdCompressor(level=1).compress
    sections = [pack(np.ascontiguousarray(x).tobytes()) for x in (doc_ids.astype("<i8"), lengths.astype("<u4"), matrix.symbols.astype("<u4"), *matrix.planes)]
    header = json.dumps({"ids": len(ids), "documents": len(doc_ids), "nulls": nulls, "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections])


def header_of(data: bytes) -> dict[str, Any]:
    (size,) = struct.unpack_from("<I", data, 4)
    return json.loads(data[8 : 8 + size])


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids (0 for none), lengths and ids of a shard's file."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    header, at = header_of(data), 8 + struct.unpack_from("<I", data, 4)[0]
    parts = []
    for n in header["sections"]:
        parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + n]))
        at += n
    doc_ids, lengths, symbols = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<u4"), np.frombuffer(parts[2], "<u4")
    return doc_ids, lengths, WaveletMatrix(header["ids"], symbols, [np.frombuffer(p, np.uint8) for p in parts[3:]])


class Words:
    """Ids of words by the tokenizers library, each word encoded once as long as it is remembered.

    The tokenizer drops white space and no token reaches over it, so a text's ids are those of its words in order; texts
    are cut at spaces and line feeds only, and the library sees to everything else within a word.
    """

    def __init__(self, spec: str) -> None:
        """spec: the JSON text of the tokenizer's file."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        # where the model marks the last token of a word, many words can be encoded as one text and told apart again
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        self.last = None
        if suffix:
            vocabulary = self.whole.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        # the ids of entry k are held[ends[k] : ends[k + 1]]
        self.entry: dict[str, int] = {}
        self.held, self.ends, self.used = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), 1

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        base, total, count = self.ends[self.used - 1], len(ids), len(words)
        if base + total > len(self.held):
            self.held = np.concatenate([self.held[:base], np.zeros(base + 2 * total, np.uint32)])
        if self.used + count > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) + count, np.int64)])
        self.held[base : base + total] = ids
        self.ends[self.used : self.used + count] = base + np.cumsum(sizes)
        self.entry.update(zip(words, range(self.used - 1, self.used - 1 + count)))
        self.used += count

    def _gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, one after the other, and how many each has."""
        lo = self.ends[entry]
        n = self.ends[entry + 1] - lo
        return self.held[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def _encode(self, words: list[str], joined: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        if joined and self.last is not None:
            ids = np.array(self.whole.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(words) and ends[-1] == len(ids) - 1:
                return ids, np.diff(ends, prepend=-1)
        each = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.uint32, int(sizes.sum())), sizes

    def _add(self, words: pa.Array) -> None:
        """Encode words that are not remembered: those of small letters many in one text, the others alone."""
        letters = pc.match_substring_regex(words, f"^[{_LETTERS}]+$")
        for some, joined in ((words.filter(letters), True), (words.filter(pc.invert(letters)), False)):
            names = some.to_pylist()
            for first in range(0, len(names), 5000):
                self._keep(names[first : first + 5000], *self._encode(names[first : first + 5000], joined))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has.

        Texts of ASCII and _LETTERS alone are made small first, as the tokenizer does, and a dot or comma that ends a word
        of letters is cut off, as punctuation never joins letters; so fewer words differ. Other texts are taken as they are.
        """
        texts = pc.fill_null(texts, "")
        small = pc.replace_substring_regex(pc.utf8_lower(texts), f"([{_LETTERS}])([.,])([ \\n])", r"\1 \2\3")
        texts = pc.if_else(pc.match_substring_regex(texts, f"[^\\x00-\\x7f{_LETTERS}]"), texts, small)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        if len(self.entry) > MOST_WORDS:
            self._forget()
        fresh = np.fromiter((w not in self.entry for w in names), bool, len(names))
        if fresh.any():
            self._add(words.dictionary.filter(pa.array(fresh)))
        entry = np.fromiter(map(self.entry.__getitem__, names), np.int64, len(names))
        ids, n = self._gather(entry[words.indices.to_numpy()])
        upto = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        return ids, np.diff(upto[ends], prepend=0)


_words: dict[str, Words] = {}


def _write(folder: str, name: str, data: bytes) -> None:
    """Whole or not at all, also where a task runs twice: the last rename wins, and both have the same bytes."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    attempt = f"{path}/_{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(attempt) as out:
        out.write(data)
    store.move(attempt, f"{path}/{name}")


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, partitions: int | None = None) -> None:
    """Write the ids of all texts, each followed by end_id, as wavelet-matrix files in ascending doc_id order.

    The file names sort in this order. folder: a URI that pyarrow's file systems can write, shared by all executors.
    """
    spark = docs.sparkSession
    # an empty table writes no shard, and its folder is read all the same
    spark.createDataFrame([], "file string").write.parquet(folder)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())  # bounded by the vocabulary file; executors need not have it
    laid = docs.select("doc_id", "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words.get(tokenizer_path) or _words.setdefault(tokenizer_path, Words(spec.value))
        part, number, held = TaskContext.get().partitionId(), 0, []
        doc_ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        nulls = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, nulls
            ids = np.concatenate(held)
            name = f"shard-{part:06d}-{number:05d}.wvm"
            _write(folder, name, to_bytes(np.concatenate(doc_ids), np.concatenate(lengths), ids, nulls))
            number, nulls = number + 1, 0
            out = pa.RecordBatch.from_pydict({"file": [name], "ids": [len(ids)], "documents": [sum(map(len, doc_ids))]})
            held.clear(), doc_ids.clear(), lengths.clear()
            return out

        for batch in batches:
            for piece in text_slices(batch, limit=2 << 20):
                ids, n = words.encode(piece.column("text"))
                ends = np.cumsum(n + 1)
                out = np.full(len(ids) + len(n), end_id, np.uint32)
                inner = np.ones(len(out), bool)
                inner[ends - 1] = False
                out[inner] = ids
                held.append(out)
                # rows without an id sort first, so their number tells which they are
                nulls += piece.column("doc_id").null_count
                doc_ids.append(pc.fill_null(piece.column("doc_id").cast(pa.int64()), 0).to_numpy())
                lengths.append(n + 1)
                if sum(map(len, held)) >= MOST_IDS:
                    yield flush()
        if held:
            yield flush()

    laid.mapInArrow(run, "file string, ids long, documents long").write.format("noop").mode("overwrite").save()


def read(spark: Any, folder: str) -> DataFrame:
    """doc_id, file, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                data = content.as_py()
                doc_ids, lengths, matrix = from_bytes(data)
                ids = matrix.ids().astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                none = np.arange(len(doc_ids)) < header_of(data)["nulls"]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, mask=none), "file": pa.array([file] * len(doc_ids)), "within": pa.array(starts), "n_tokens": pa.array(lengths.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    found = files.mapInArrow(run, "doc_id long, file string, within long, n_tokens long, ids_crc32 long")
    # one row for each file, small beside its millions of ids
    headers = files.mapInArrow(_sizes, "file string, ids long")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = headers.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    return found.join(offsets, "file").select("doc_id", "file", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [c.as_buffer()[:4096].to_pybytes() for c in batch.column("content")]
        sizes = [header_of(h)["ids"] for h in heads]
        yield pa.RecordBatch.from_pydict({"file": batch.column("file"), "ids": pa.array(sizes, pa.int64())})


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the shards and read them back."""
    folder = folder or work_path(docs.sparkSession, "wavelet")
    write(docs, tokenizer_path, folder, end_id)
    return read(docs.sparkSession, folder)

"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text exactly one token can be the last of its encoding: the longest token that ends there
and is compatible with the last token of what stands before it. An automaton over the vocabulary gives, byte by byte, the
longest token that ends at a place and the next shorter ones; two tokens are compatible if encoding their joined bytes
gives just these two, which is read off the merges. Back-pointers from the end of the piece then spell the ids.

The recurrence runs in numpy over all new pieces of a batch at once, in step; ids of pieces are remembered up to
MOST_PIECES for each worker (a cache: forgetting costs time only).

Results for odd input: a null text is an empty text, with no ids; special tokens of the file that stand in a text get their
own id, as in the file's library; ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import text_slices

#: Fixed value: how the byte-level pre-tokenizer cuts a text into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space next to a space, where cutting a text at its spaces would change its pieces.
_MIXED_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_APART = rf"(?: {_MIXED_SPACE}|{_MIXED_SPACE} )"
MOST_PIECES = 300_000
#: Pieces longer than this are encoded one by one.
LONG = 64
#: Chunks of text, and pieces, that are encoded at a time.
TABLE_ROWS = 1 << 15
_NONE = -1


@dataclass(frozen=True)
class Vocabulary:
    """tokens: bytes by id; left and right: the two ids a token is merged from (its own for single bytes)."""

    tokens: list[bytes]
    left: np.ndarray
    right: np.ndarray
    special: dict[str, int]


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load(spark: SparkSession, path: str) -> Vocabulary:
    """Read a byte-level BPE vocabulary file (tokenizers' JSON), on the driver."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, letters = data["model"], _byte_letters()
    special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    ids: dict[str, int] = model["vocab"]
    size = max([*ids.values(), *special.values()]) + 1
    tokens = [b""] * size
    for word, i in ids.items():
        tokens[i] = word.encode() if word in special else bytes(letters[c] for c in word)
    for word, i in special.items():
        tokens[i] = word.encode()
    left, right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        i = ids[a + b]
        if i < 256 or (rank and i <= last):
            raise ValueError("the ids of merged tokens are not in the order of the merges")
        left[i], right[i], last = ids[a], ids[b], i
    return Vocabulary(tokens, left, right, special)


class Encoder:
    """The automaton of a vocabulary, and the recurrence over it."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        special = set(vocabulary.special.values())
        words = [(t, i) for i, t in enumerate(vocabulary.tokens) if t and i not in special]
        edges: list[dict[int, int]] = [{}]
        token = [_NONE]
        depth_of: list[int] = [0]
        for word, i in words:
            node = 0
            for b in word:
                to = edges[node].get(b)
                if to is None:
                    to = edges[node][b] = len(edges)
                    edges.append({})
                    token.append(_NONE)
                    depth_of.append(depth_of[node] + 1)
                node = to
            token[node] = i
        n = len(edges)
        # by depth, so that a node's failure link (its longest proper suffix in the automaton) is finished before it
        self.next = np.zeros((n, 256), np.int32)
        self.longest = np.array(token, np.int32)
        size = len(vocabulary.tokens)
        self.shorter = np.full(size, _NONE, np.int32)
        fail = np.zeros(n, np.int32)
        for node in np.argsort(depth_of, kind="stable"):
            to_fail = self.next[fail[node]]
            below = self.longest[fail[node]] if node else _NONE
            if self.longest[node] == _NONE:
                self.longest[node] = below
            elif node:
                self.shorter[self.longest[node]] = below
            row = to_fail.copy() if node else np.zeros(256, np.int32)
            for b, child in edges[node].items():
                fail[child] = to_fail[b] if node else 0
                row[b] = child
            self.next[node] = row
        self.size = np.array([len(t) for t in vocabulary.tokens], np.int32)
        merged = np.flatnonzero(vocabulary.left != np.arange(size))
        keys = vocabulary.left[merged].astype(np.int64) * size + vocabulary.right[merged]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], merged[order].astype(np.int32)
        self.seen_keys = np.full(1 << 20, -1, np.int64)
        self.seen_fit = np.zeros(1 << 20, bool)
        self.ids = np.zeros(1 << 20, np.int32)
        self._forget()

    def _forget(self) -> None:
        # the ids of chunk k are ids[at[k] : at[k + 1]]
        self.pieces, self.at, self.used = {}, np.zeros(1 << 16, np.int64), 0

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that the pair merges to, or a number above all ids."""
        key = a.astype(np.int64) * len(self.size) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], np.int32(2**31 - 1))

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of a's and b's joined bytes is a, b: undo merges, the later one first, and see that no
        pair across the border would have been merged before the merge just undone."""
        fit = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        a, b = a.copy(), b.copy()
        bound = np.full(len(a), 2**31 - 2, np.int64)
        while len(open_):
            early = self._merged(a, b) <= bound
            fit[open_[early]] = False
            undo_a = a > b
            ends_a, ends_b = self.v.left[a] == a, self.v.left[b] == b
            # a single byte cannot be undone; then the other side goes on, and with two of them the pair stands
            take_a = ~ends_a & (undo_a | ends_b)
            take_b = ~ends_b & ~take_a
            go = ~early & (take_a | take_b)
            bound = np.where(take_a, a - 1, b)
            a = np.where(take_a, self.v.right[a], a)
            b = np.where(take_b, self.v.left[b], b)
            open_, a, b, bound = open_[go], a[go], b[go], bound[go]
        return fit

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`_fit` behind a table of pairs seen before."""
        key = a.astype(np.int64) * len(self.size) + b
        place = ((key * 0x9E3779B97F4A7C1) >> 20) & (len(self.seen_keys) - 1)
        out = self.seen_fit[place]
        new = np.flatnonzero(self.seen_keys[place] != key)
        if len(new):
            out[new] = self._fit(a[new], b[new])
            # one table entry may get several new pairs: keep key and answer of the same one
            last = np.zeros(0, np.int64)
            _, last = np.unique(place[new][::-1], return_index=True)
            keep = new[len(new) - 1 - last]
            self.seen_keys[place[keep]], self.seen_fit[place[keep]] = key[keep], out[keep]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-sizes, kind="stable")
        width = int(sizes.max(initial=0))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        begins = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        last = np.full((len(pieces), width + 1), _NONE, np.int32)
        state = np.zeros(len(pieces), np.int32)
        for i in range(width):
            live = int(np.searchsorted(-sizes, -i, side="left"))  # pieces longer than i stand first
            state = self.next[state[:live], flat[begins[:live] + i]]
            token = self.longest[state]
            todo = np.arange(live)
            while len(todo):
                t = token[todo]
                start = i + 1 - self.size[t]
                before = last[todo, start]
                good = start == 0
                inner = np.flatnonzero(~good)
                good[inner] = self.fit(before[inner], t[inner])
                last[todo[good], i + 1] = t[good]
                todo = todo[~good]
                token[todo] = self.shorter[token[todo]]
        # from the end of each piece, back to its start
        where, rows = sizes.copy(), np.arange(len(pieces))
        steps_row, steps_id, steps_at = [], [], []
        while len(rows := rows[where[rows] > 0]):
            t = last[rows, where[rows]]
            steps_row.append(order[rows])
            steps_id.append(t)
            steps_at.append(where[rows])
            where[rows] -= self.size[t]
        if not steps_row:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        row, ids, at = map(np.concatenate, (steps_row, steps_id, steps_at))
        return ids[np.lexsort([at, row])], np.bincount(row, minlength=len(pieces))

    def encode_long(self, piece: bytes) -> np.ndarray:
        """The same recurrence for one piece, place by place."""
        last = np.full(len(piece) + 1, _NONE, np.int32)
        known: dict[tuple[int, int], bool] = {}
        state = 0
        for i, byte in enumerate(piece):
            state = self.next[state, byte]
            t = int(self.longest[state])
            while True:
                start = i + 1 - int(self.size[t])
                if start == 0:
                    break
                pair = (int(last[start]), t)
                if pair not in known:
                    known[pair] = bool(self._fit(np.array([pair[0]], np.int32), np.array([t], np.int32))[0])
                if known[pair]:
                    break
                t = int(self.shorter[t])
            last[i + 1] = t
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= int(self.size[last[at]])
        return np.array(out[::-1], np.int32)

    def _remember(self, chunks: list[str]) -> None:
        """Encode chunks of text that were not seen before."""
        for first in range(0, len(chunks), TABLE_ROWS):
            self._remember_some(chunks[first : first + TABLE_ROWS])

    def _remember_some(self, chunks: list[str]) -> None:
        pieces = [PIECES.findall(c) for c in chunks]
        flat = sorted({p for ps in pieces for p in ps})
        raw = [p.encode() for p in flat]
        # pieces of about one length share a table of prefixes, which is as wide as its longest piece
        short = sorted((i for i, r in enumerate(raw) if len(r) <= LONG), key=lambda i: len(raw[i]))
        by_piece = {}
        for first in range(0, len(short), TABLE_ROWS):
            part = short[first : first + TABLE_ROWS]
            ids, counts = self.encode([raw[i] for i in part])
            cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
            by_piece |= {flat[i]: ids[cuts[k] : cuts[k + 1]] for k, i in enumerate(part)}
        by_piece |= {flat[i]: self.encode_long(r) for i, r in enumerate(raw) if len(r) > LONG}
        new = [by_piece[p] for ps in pieces for p in ps]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(ps) for ps in pieces])]
        total = int(sizes.sum())
        base = int(self.at[self.used])
        if base + total > len(self.ids):
            self.ids = np.concatenate([self.ids[:base], np.zeros(base + 2 * total, np.int32)])
        if new:
            self.ids[base : base + total] = np.concatenate(new)
        self.pieces.update(zip(chunks, range(self.used, self.used + len(chunks))))
        if self.used + len(chunks) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros(len(self.at) + len(chunks), np.int64)])
        self.at[self.used + 1 : self.used + 1 + len(chunks)] = base + ends
        self.used += len(chunks)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (one more entry than texts).

        A text is cut before each space; such chunks have the pieces of the whole text, except where white space meets
        a space or a special token occurs: those texts are cut by the pattern of pieces as a whole.
        """
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _APART)
        for name in self.v.special:
            whole = pc.or_(whole, pc.match_substring(texts, name))
        simple = pc.if_else(whole, "", texts)
        cut = pc.split_pattern(simple, " ")
        chunks = cut.flatten().dictionary_encode()
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        code = chunks.indices.to_numpy()
        # the first chunk of a text has no space before it
        first = np.zeros(len(code), bool)
        first[np.cumsum(counts) - counts] = True
        names = chunks.dictionary.to_numpy(zero_copy_only=False)
        pair = np.where(first, code, code + len(names))
        used = np.flatnonzero(np.bincount(pair, minlength=2 * len(names)))
        keys = [names[u] if u < len(names) else " " + names[u - len(names)] for u in used.tolist()]
        special = {k: v for k, v in zip(range(len(texts)), whole.to_pylist()) if v}
        odd = {i: self._parts(texts[i].as_py()) for i in special}
        if len(self.pieces) > MOST_PIECES:
            self._forget()
        wanted = dict.fromkeys(keys) | {c: None for parts in odd.values() for c in parts if isinstance(c, str)}
        fresh = [k for k in wanted if k not in self.pieces]
        if fresh:
            self._remember(fresh)
        entry = np.zeros(2 * len(names), np.int64)
        entry[used] = [self.pieces[k] for k in keys]
        at = self.at
        lo, n = at[entry[pair]], at[entry[pair] + 1] - at[entry[pair]]
        per_text = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=n, minlength=len(texts)).astype(np.int64)
        ids = self.ids[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        begin = np.concatenate([[0], np.cumsum(per_text)])
        if not odd:
            return ids, begin
        out = []
        for i in range(len(texts)):
            if i in odd:
                out += [np.concatenate([np.zeros(0, np.int32), *(self.ids[at[self.pieces[c]] : at[self.pieces[c] + 1]] if isinstance(c, str) else np.array([c], np.int32) for c in odd[i])])]
            else:
                out += [ids[begin[i] : begin[i + 1]]]
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(o) for o in out])])

    def _parts(self, text: str) -> list[str | int]:
        """Pieces of a text, and the ids of the special tokens in it."""
        if not self.v.special:
            return PIECES.findall(text)
        names = sorted(self.v.special, key=len, reverse=True)
        out: list[str | int] = []
        for part in regex.split("(" + "|".join(map(regex.escape, names)) + ")", text):
            out += [self.v.special[part]] if part in self.v.special else PIECES.findall(part)
        return out

    def decode(self, ids: np.ndarray) -> str:
        tokens = self.v.tokens
        return b"".join([tokens[i] for i in ids.tolist() if 0 <= i < len(tokens)]).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(key: str, vocabulary: Vocabulary) -> Encoder:
    """The encoder of this worker; it is built once."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array, unless left out), ids_sha256 and decoded_sha256 (of the ids decoded again)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(load(spark, path))  # bounded by the vocabulary file
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, held.value)
        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                ids, at = own.encode_texts(part.column("text"))
                each = [ids[a:b] for a, b in zip(at, at[1:])]
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array(np.diff(at)),
                    "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in each], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)

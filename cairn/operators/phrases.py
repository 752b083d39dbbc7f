"""Phrases in sequences of tokens with boxes: where they stand, and the box to cover for each place.

A phrase is a sequence of words; it stands where each of its words is part of a token, token after token, whatever the case. Of
places of one phrase that overlap, the first counts. All phrases of a document are sought in one pass over its tokens: the words
that a token holds come from an automaton over letters, and a set of bits, one for each word of each phrase, is moved on by one
with each token and cut down to the words that the token holds.

Results for odd input: null tokens or phrases count as none; a phrase without words stands nowhere; equal phrases count once, the
first with its replacement; a token without text holds no word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a token is: its text and its box.
TOKEN = "struct<text:string,x0:double,y0:double,x1:double,y1:double>"
#: What a target is: the phrase and what stands in its place.
TARGET = "struct<text:string,replacement:string>"
#: Fixed value: how many tokens are Python objects at once, unless one row has more.
_TOKENS = 1 << 16
_SPAN = "array<struct<text:string,replacement:string,first:int,last:int,x0:double,y0:double,x1:double,y1:double>>"


class Phrases:
    """Some phrases as one set of bits."""

    def __init__(self, phrases: tuple[str, ...]) -> None:
        self.words = [p.lower().split() for p in phrases]
        self.starts = self.held = 0
        self.ends: dict[int, int] = {}
        places: dict[str, int] = {}
        for number, words in enumerate(self.words):
            for j, word in enumerate(words):
                places[word] = places.get(word, 0) | 1 << self.held
                self.starts |= (1 << self.held) * (j == 0)
                self.held += 1
            if words:
                self.ends[self.held - 1] = number
        self.last = sum(1 << e for e in self.ends)
        self.letters = ahocorasick.Automaton()
        for word, mask in places.items():
            self.letters.add_word(word, mask)
        if places:
            self.letters.make_automaton()

    def find(self, tokens: list[str]) -> Iterator[tuple[int, int, int]]:
        """Number of the phrase, first and last token of each place."""
        if not self.held:
            return
        now, free = 0, [0] * len(self.words)
        for i, token in enumerate(tokens):
            holds = 0
            for _, mask in self.letters.iter(token.lower()):
                holds |= mask
            now = (now << 1 | self.starts) & holds
            hit = now & self.last
            while hit:
                end = hit.bit_length() - 1
                hit ^= 1 << end
                number = self.ends[end]
                first = i + 1 - len(self.words[number])
                if first >= free[number]:
                    free[number] = i + 1
                    yield number, first, i


def _side(best: Callable, values: list[float | None]) -> float | None:
    """The least or greatest that is not null; NaN is above all, as Spark has it."""
    some = [v for v in values if v is not None]
    return best(some, key=lambda v: (v != v, v)) if some else None


def _places(seq: pa.Array, wanted: pa.Array) -> Iterator[list[tuple]]:
    """The places of each row, the tokens of some rows at a time."""
    counts = pc.fill_null(pc.list_value_length(seq), 0).to_pylist()
    known: tuple[tuple[str, ...], Phrases] = ((), Phrases(()))
    a = 0
    while a < len(counts):
        b, held = a + 1, counts[a]
        while b < len(counts) and held + counts[b] <= _TOKENS:
            b, held = b + 1, held + counts[b]
        texts, *box = (c.to_pylist() for c in seq.slice(a, b - a).flatten().flatten())
        texts, at = [x or "" for x in texts], 0
        for row, goals in zip(range(a, b), wanted.slice(a, b - a).to_pylist()):
            table: dict[str, str | None] = {}
            for goal in goals or ():
                if goal and goal["text"] and goal["text"].strip():
                    table.setdefault(goal["text"].strip(), goal["replacement"])
            key = tuple(table)
            if key != known[0]:
                known = (key, Phrases(key))
            out = []
            for n, first, last in sorted(known[1].find(texts[at : at + counts[row]])):
                sides = (_side(best, c[at + first : at + last + 1]) for best, c in zip((min, min, max, max), box))
                out.append((key[n], table[key[n]], first, last, *sides))
            yield out
            at += counts[row]
        a = b


def located(docs: DataFrame, tokens: str, targets: str, name: str = "redact_spans") -> DataFrame:
    """Add the places of the targets (column of TARGET arrays) among the tokens (column of TOKEN arrays): the phrase, its replacement,
    first and last token (from 0) and the box around them; in the order of the targets, then of the places.

    Places and boxes come from one function over Arrow arrays: as columns, Spark would find all boxes anew for each use of the result,
    such as the filters that it derives from an explode.
    """

    @F.arrow_udf(_SPAN)
    def found(seq: pa.Array, wanted: pa.Array) -> pa.Array:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
        ends, columns = [0], [[] for _ in kinds]
        for own in _places(seq, wanted):
            for span in own:
                for c, v in zip(columns, span):
                    c.append(v)
            ends.append(len(columns[0]))
        names = ["text", "replacement", "first", "last", "x0", "y0", "x1", "y1"]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names))

    return docs.withColumn(name, found(F.col(tokens).cast(f"array<{TOKEN}>"), F.col(targets).cast(f"array<{TARGET}>")))


def covered(tokens: Column, spans: Column) -> Column:
    """The text of the tokens with the first token of each place replaced and its others left out; of places that overlap, the one that
    comes first in `spans` counts."""
    clear = F.filter(spans, lambda s, i: ~F.exists(F.slice(spans, 1, i), lambda e: (e["first"] <= s["last"]) & (s["first"] <= e["last"])))
    one = lambda t, i: F.coalesce(F.get(F.transform(F.filter(clear, lambda s: (s["first"] <= i) & (i <= s["last"])), lambda s: F.when(s["first"] == i, F.coalesce(s["replacement"], F.lit(""))).otherwise("")), F.lit(0)), t["text"])
    return F.array_join(F.filter(F.transform(tokens, one), lambda x: x != ""), " ")

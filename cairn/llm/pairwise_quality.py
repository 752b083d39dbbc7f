"""Quality scores by the Bradley-Terry model, learnt from preference pairs and set to a quantile threshold.

A text becomes a sparse vector: shares of its words, pairs of words and four-byte pieces by hash bucket, and some ratios of
its bytes, words and repetition; no word list of any language is used. A pair prefers a text labelled 1 to one labelled 0,
and the chance of that preference is the logistic function of the difference of their scores; scores are linear in the
vector, so the fit is a logistic regression on differences. Of texts that the fit did not see, the raw score under which lies
the share labelled 0 maps to THRESHOLD.

The fit uses a bounded sample: about `SAMPLE_ROWS` labelled texts, chosen by a hash of doc_id, and `PAIRS` pairs of them.

Results for odd input: a null or empty text has the vector of an empty text and a score like any other; rows without a
label only get a score; without labels of both kinds all scores are 0.5; an empty table has no scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, sums, text_slices
from .textgrams import U64, bytes_of, windows, word_hashes

SAMPLE_ROWS = 4_000
PAIRS = 60_000
THRESHOLD = 0.3
RIDGE = 1e-3
#: Buckets of each hashed family, and what their shares, which sum to 1, are multiplied by.
BUCKETS_LOG2, FAMILIES, SCALE = 13, 3, 4.0
_HASHED = FAMILIES << BUCKETS_LOG2


def _class(letters: str) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(letters.encode(), np.uint8))


#: Ratios of bytes by class: a name and what it is multiplied by.
CLASSES = {
    "letters": (np.array([chr(c).isalpha() or c >= 128 for c in range(256)]), 1.0),
    "capitals": (_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 2.0),
    "digits": (_class("0123456789"), 5.0),
    "symbols": (_class("#*$%&|<>=_~^{}[]@/\\+"), 5.0),
    "stops": (_class(".,;:"), 5.0),
    "marks": (_class("!?"), 10.0),
    "lines": (_class("\n"), 10.0),
}
DENSE = len(CLASSES) + 3
SIZE = _HASHED + DENSE


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    centre: float
    scale: float


def families(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each hashed family its buckets, text after text, and where each text's begin (one more entry than texts)."""
    n, shift = len(texts), U64(64 - BUCKETS_LOG2)
    hashes, at = word_hashes(texts, lower=True)
    yield (hashes >> shift).astype(np.int64), at
    pairs, of = windows(hashes, at, 2)
    yield (pairs >> shift).astype(np.int64) + (1 << BUCKETS_LOG2), np.searchsorted(of, np.arange(n + 1))
    data, at = bytes_of(texts)
    if len(data) < 4:
        yield np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        return
    small = np.where((data >= 65) & (data <= 90), data | 32, data)
    four = np.ndarray(len(data) - 3, "<u4", np.ascontiguousarray(small), strides=(1,)) * np.uint32(0x9E3779B1)
    whole = np.ones(len(four), bool)
    over = (at[1:, None] - np.arange(1, 4)).ravel()
    whole[over[(over >= 0) & (over < len(four))]] = False
    counts = np.concatenate([[0], np.cumsum(whole)])
    yield (four[whole] >> np.uint32(32 - BUCKETS_LOG2)).astype(np.int64) + (2 << BUCKETS_LOG2), counts[np.minimum(at, len(four))]


def ratios(texts: pa.Array) -> np.ndarray:
    """A row of DENSE numbers for each text; those over nothing are 0."""
    data, at = bytes_of(texts)
    size = np.diff(at)
    out = [np.diff(np.concatenate([[0], np.cumsum(has[data])])[at]) * by / np.maximum(size, 1) for has, by in CLASSES.values()]
    hashes, words = word_hashes(texts, lower=True)
    n = np.diff(words)
    keys = np.sort((np.repeat(np.arange(len(n)), n).astype(U64) << U64(48)) | (hashes >> U64(16)))
    different = np.ones(len(keys), bool)
    different[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[different] >> U64(48)).astype(np.int64), minlength=len(n))
    out += [np.log1p(n) / 10, size / np.maximum(n, 1) / 10, distinct / np.maximum(n, 1)]
    return np.stack(out, axis=1)


def sparse(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of texts as columns, values and where each text's begin."""
    n = len(texts)
    keys, values = [], []
    for bucket, at in families(texts):
        counts = np.diff(at)
        key, times = np.unique((np.repeat(np.arange(n), counts) << 32) | bucket, return_counts=True)
        keys.append(key)
        values.append(SCALE * times / counts[key >> 32])
    keys.append(((np.arange(n) << 32)[:, None] | (_HASHED + np.arange(DENSE))).ravel())
    values.append(ratios(texts).ravel())
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    return (key & 0xFFFFFFFF).astype(np.int32), value.astype(np.float32), np.searchsorted(key >> 32, np.arange(n + 1))


class Preferences:
    """The regularised logistic loss of pairs (better, worse) of rows of a sparse matrix."""

    def __init__(self, column: np.ndarray, value: np.ndarray, at: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE) -> None:
        self.column, self.value, self.at, self.better, self.worse, self.ridge = column, value.astype(np.float64), at, better, worse, ridge

    def raw(self, w: np.ndarray) -> np.ndarray:
        return sums(w[self.column] * self.value, self.at)

    def _back(self, by_pair: np.ndarray) -> np.ndarray:
        rows = len(self.at) - 1
        by_row = np.bincount(self.better, by_pair, rows) - np.bincount(self.worse, by_pair, rows)
        return np.bincount(self.column, self.value * np.repeat(by_row, np.diff(self.at)), SIZE) / len(by_pair)

    def _apart(self, w: np.ndarray) -> np.ndarray:
        raw = self.raw(w)
        return raw[self.better] - raw[self.worse]

    def loss(self, w: np.ndarray) -> float:
        return float(np.logaddexp(0, -self._apart(w)).mean() + self.ridge / 2 * w @ w)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        return self.ridge * w - self._back(1 / (1 + np.exp(np.clip(self._apart(w), -500, 500))))

    def fit(self, rounds: int = 8, steps: int = 8) -> np.ndarray:
        """Newton's method; each step solved by conjugate gradients, and halved while the loss does not fall."""
        w = np.zeros(SIZE)
        loss = self.loss(w)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(np.clip(self._apart(w), -500, 500)))
            rest = self._back(p) - self.ridge * w
            if np.abs(rest).max() < 1e-5:
                break
            move, way, size = np.zeros(SIZE), rest, rest @ rest
            for _ in range(steps):
                bent = self._back(p * (1 - p) * self._apart(way)) + self.ridge * way
                by = size / (way @ bent)
                move, rest = move + by * way, rest - by * bent
                size, before = rest @ rest, size
                if size < 1e-16:
                    break
                way = rest + size / before * way
            while (found := self.loss(w + move)) > loss and np.abs(move).max() > 1e-9:
                move = move / 2
            w, loss = w + move, found
        return w


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, pairs: int = PAIRS) -> Model:
    """Learn from columns text and quality (1 good, 0 bad)."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                column, value, at = sparse(piece.column("text"))
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (column, value)]
                yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("quality"), *lists], names=["key", "quality", "columns", "values"])

    sample = sampled(labelled.where("quality IN (0, 1)"), sample_rows).select(F.xxhash64("text").alias("key"), F.col("quality").cast("int").alias("quality"), "text")
    rows = sample.mapInArrow(vectors, "key long, quality int, columns array<int>, values array<float>").toArrow()
    # the order in which rows arrive must not matter
    rows = rows.sort_by([("key", "ascending"), ("quality", "ascending")]).combine_chunks()
    y = rows.column("quality").to_numpy()
    # every third row is left for the threshold
    seen = np.arange(len(y)) % 3 != 0
    good, bad = np.flatnonzero(seen & (y == 1)), np.flatnonzero(seen & (y == 0))
    if not len(good) or not len(bad):
        return Model(np.zeros(SIZE), 0.0, 0.0)
    columns, values = (rows.column(c).combine_chunks() for c in ("columns", "values"))
    at = np.concatenate([[0], np.cumsum(columns.value_lengths().to_numpy())])
    rng = np.random.default_rng(7)
    model = Preferences(columns.flatten().to_numpy(), values.flatten().to_numpy(), at, rng.choice(good, pairs), rng.choice(bad, pairs))
    w = model.fit()
    raw, kept = model.raw(w), ~seen if len(set(y[~seen])) == 2 else np.ones(len(y), bool)
    raw, y = raw[kept], y[kept]
    cut = float(np.quantile(raw, float((y == 0).mean())))
    # the steepness that makes the scores most likely, given that the cut scores THRESHOLD
    base = np.log(THRESHOLD / (1 - THRESHOLD))
    scales = np.geomspace(0.05, 20, 60)
    loss = [np.logaddexp(0, np.where(y == 1, -1, 1) * (base + s * (raw - cut))).mean() for s in scales]
    return Model(w, cut, float(scales[int(np.argmin(loss))]))


def raw_scores(texts: pa.Array, w: np.ndarray) -> np.ndarray:
    """What `sparse` and the weights give, without building the vectors."""
    out = (ratios(texts) * w[_HASHED:]).sum(axis=1)
    for bucket, at in families(texts):
        out += SCALE * sums(w[bucket], at) / np.maximum(np.diff(at), 1)
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score in [0, 1] of each row: THRESHOLD at the quantile, higher for better texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the buckets
    base = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for piece in text_slices(batch, limit=1 << 20):
                raw = raw_scores(piece.column("text"), m.weights)
                score = 1 / (1 + np.exp(np.clip(-(base + m.scale * (raw - m.centre)), -500, 500))) if m.scale else np.full(len(raw), 0.5)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")

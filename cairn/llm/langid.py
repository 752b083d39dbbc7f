"""Language of a text: multinomial naive Bayes over hashed character n-grams.

The model is fitted on a bounded sample (about `SAMPLE_ROWS` labelled rows, chosen by a hash of doc_id); its matrix of
log-probabilities has a row for each language and BUCKETS columns, and is broadcast. Every text is scored whole.

Results for odd input: a text that is null or has no letter is `und` with score 0; ties go to the language that is
first by code point; without any labelled text every prediction is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled, sums, text_slices

BUCKETS = 1 << 15
ORDERS = (2, 3)
SAMPLE_ROWS = 20_000
#: Most languages that a model may have; more are an error, as the matrix is broadcast.
MOST_LANGS = 1000
SMOOTHING = 0.1
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """By code point, whether it is a letter; made once for each worker."""
    global _letters
    if _letters is None:
        _letters = np.zeros(0x110000, bool)
        for plane in range(0, 0x110000, 0x1000):
            _letters[plane : plane + 0x1000] = [chr(c).isalpha() for c in range(plane, plane + 0x1000)]
    return _letters


def grams(texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, the hash buckets of the character n-grams and the text of each; and which texts have a letter.

    Texts are lower-cased; whatever is not a letter counts as one space, so n-grams see where words begin and end, and
    n-grams without a letter in the middle are left out. No n-gram reaches from one text into the next.
    """
    lowered = [(t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(lowered)), np.fromiter(map(len, lowered), np.int64, len(lowered)))
    letter = _is_letter()[points]
    points = np.where(letter, points, np.uint32(32))
    some = np.bincount(text[letter], minlength=len(lowered)) > 0
    found = []
    rolled = np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        reach = len(points) - n + 1
        if reach <= 0:
            break
        rolled = rolled[:reach] + points[n - 1 :] * _MULTIPLIERS[n - 1]
        if n not in ORDERS:
            continue
        middle = letter[n // 2 : n // 2 + reach] if n != 2 else letter[:reach] | letter[1:]
        keep = np.flatnonzero(middle & (text[:reach] == text[n - 1 :]))
        mixed = rolled[keep] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822507)
        found.append((mixed >> np.uint32(17), text[keep]))
    return found, some


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log-probabilities (language by bucket) from columns text and lang.

    Counts are summed by Spark; what reaches the driver is one row for each language and bucket at most.
    """
    named = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sample = sampled(named, sample_rows).select("text", "lang")
    several = len(sample.select("lang").distinct().limit(MOST_LANGS + 1).collect())
    if several > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages, which is what the model holds at most")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                langs = part.column("lang").dictionary_encode()
                found, _ = grams(part.column("text").to_pylist())
                bucket, owner = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                key = langs.indices.to_numpy()[owner].astype(np.int64) * BUCKETS + bucket
                found, n = np.unique(key, return_counts=True)
                names = langs.dictionary.take(pa.array(found // BUCKETS))
                yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array((found % BUCKETS).astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    if langs:
        np.add.at(table, (found["bucket"].to_numpy(), np.searchsorted(langs, found["lang"])), found["n"].to_numpy())
        table = np.log(table / table.sum(axis=0))
    return langs, np.ascontiguousarray(table.T)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of the prediction at equal priors) for each row."""
    langs, table = model
    held = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], object)
        for batch in batches:
            for part in text_slices(batch):
                n = part.num_rows
                total = np.zeros((n, max(1, len(langs))))
                found, some = grams(part.column("text").to_pylist())
                for bucket, owner in found:
                    at = np.searchsorted(owner, np.arange(n + 1))
                    for k in range(len(langs)):
                        total[:, k] += sums(held.value[k][bucket], at)
                best = total.argmax(axis=1)
                spread = np.exp(total - total.max(axis=1, keepdims=True))
                sure = spread.max(axis=1) / spread.sum(axis=1)
                known = some & bool(langs)
                out = np.where(known, best, len(langs))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[out], pa.string()), pa.array(np.where(known, sure, 0.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def held_out(by: Column, parts: int, part: int) -> Column:
    """Whether the crc32 of a value as text leaves remainder `part`."""
    return (F.crc32(F.coalesce(by.cast("string"), F.lit("")).cast("binary")) % parts) == part

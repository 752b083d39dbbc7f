"""The impact index and hard negatives against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from cairn.llm import hard_negatives, impact_index

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(SMALL))


def ranked(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    have = [(d, Counter(terms(t))) for d, t in docs if d is not None and terms(t)]
    n, total = len(have), sum(sum(c.values()) for _, c in have)
    df = Counter(t for _, c in have for t in c)
    out = []
    wanted: dict = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(terms(text))
    for item, own in wanted.items():
        scores = []
        for d, c in have:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_DOCS", 512), ("BLOCK_BYTES", 900), ("BATCH_ITEMS", 7), ("BATCH_TERMS", 90), ("GROUP_ITEMS", 3), ("GROUP_TERMS", 11)):
            monkeypatch.setattr(impact_index, name, value)
    rng = random.Random(3)
    words = [rng.choice("abcdé漢") + str(i) * (i % 2) + rng.choice(["", "X", "ß"]) for i in range(70)]
    text = lambda n: rng.choice([" ", ", ", "-\n", "\x7f"]).join(rng.choice(words[: rng.choice([5, 70])]) for _ in range(n))
    docs = [(rng.randint(-50, 400) * 3, text(rng.randint(1, 60))) for _ in range(300)]
    docs += [(None, "a b"), (9001, None), (9002, ""), (9003, "..., !"), (9004, words[0] * 900 + " " + "b " * 5000), (docs[0][0], docs[0][1]), (docs[1][0], "b other")]
    docs += [(8000 + i, "same words everywhere") for i in range(40)]
    items = [(i, text(rng.randint(1, 30))) for i in range(40)] + [(100, None), (101, "nowhere else"), (102, "SAME words"), (3, "same"), (None, "b"), (103, " ".join(words))]
    frame = spark.createDataFrame([(d, t, 5, 1.0) for d, t in docs], "doc_id long, text string, rank int, score double").repartition(4)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id int, text string, doc_id int")
    found = impact_index.search(impact_index.build(frame), asked, 10)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.schema["item_id"].dataType.simpleString() == "int"
    # documents that share a doc_id can change places
    assert sorted(map(tuple, found.collect())) == ranked(docs, items, 10)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert impact_index.search(impact_index.build(docs), items).count() == 0
    some = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert impact_index.search(impact_index.build(some), items.where("false")).count() == 0
    assert [tuple(r) for r in impact_index.search(impact_index.build(some), items).collect()] == ranked([(1, "a")], [(1, "a")], 10)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**40), min_size=70, max_size=70), min_size=1, max_size=6), st.integers(1, 8))
def test_bit_sliced_sums(rows, k):
    numbers = np.array(rows, np.int64)
    padded = np.zeros((len(rows), 128), np.int64)
    padded[:, :70] = numbers
    planes = [np.packbits((padded >> b) & 1 != 0, axis=1, bitorder="little").view(np.uint64) for b in range(41)]
    sums = impact_index.Slices(2, 2)
    for r in range(len(rows)):
        sums.add(np.array([0]), planes, np.array([r]))
    sums.add(np.array([0, 1]), planes, np.array([0, 0]))
    for row, want in enumerate((numbers.sum(axis=0) + numbers[0], numbers[0])):
        order = sorted((-int(v), i) for i, v in enumerate(want) if v > 0)[:k]
        which, place, score = sums.best(k)
        assert sorted((-int(s), int(p)) for w, p, s in zip(which, place, score) if w == row) == order


def mined(rows: list[tuple], every: int) -> list[tuple]:
    good = [(i, lab, [math.floor(256 * v) for v in x]) for i, lab, x in rows if None not in (i, lab, x) and all(v is not None and math.isfinite(v) for v in x)]
    out = set()
    for a, lab, x in good:
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, other, y in good if i != a and len(x) == len(y))
        for s, p, _ in [t for t in scores if t[2] == lab][:5]:
            window = [(n, i) for n, i, other in scores if other != lab and 80 * -s <= 100 * -n <= 100 * -s][:5]
            out |= {(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(window)}
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:
        for name, value in (("PACK_ROWS", 37), ("SAMPLE_ROWS", 60), ("CENTRES", 4), ("PART_ROWS", 50), ("SLICE", 3), ("BATCH_ANCHORS", 5)):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(6, 9))
    rows = []
    for i in range(500):
        x = (middle[rng.integers(6)] + rng.normal(size=9) * rng.choice([0.05, 0.5])).tolist()
        rows.append((i, int(rng.integers(4)), x))
    rows += [(1000 + i, i % 3, rows[10][2]) for i in range(60)] + [(2000 + i, i % 2, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(3000 + i, i % 2, []) for i in range(15)] + [(5000, 1, [1.0]), (5010, 2, [-300.0]), (5020, 1, [700.0])]
    rows += [(None, 1, rows[0][2]), (4000, None, rows[0][2]), (4010, 1, None), (4020, 1, [None] * 9), (4030, 1, [float("nan")] * 9), (4040, 1, [float("inf")] + [0.0] * 8), (4050, 1, [0.0] * 9), rows[20], rows[20]]
    plain = [r for k, r in enumerate(rows) if k < len(rows) - 2]
    frame = spark.createDataFrame([(*r, 7) for r in plain], "vec_id long, label int, embedding array<float>, rank int").repartition(3)
    as_given = [(r.vec_id, r.label, r.embedding) for r in frame.collect()]
    found = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == mined(as_given, 10)
    # an anchor that stands there twice is one
    twice = spark.createDataFrame([(*r, 7) for r in rows], frame.schema)
    assert len(set(map(tuple, hard_negatives.mine(twice, F.col("vec_id") == 30).collect()))) == hard_negatives.mine(twice, F.col("vec_id") == 30).count()
    assert hard_negatives.mine(frame.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(Exception, match="63 bits"):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [1e9]), (1, 1, [1e9])], "vec_id long, label int, embedding array<double>"), F.col("vec_id") == 0).count()


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (400, 7))
    books = hard_negatives.fit(x[:100])
    pack = hard_negatives.Pack(np.arange(400), np.zeros(400, np.int64), x, books)
    lower, upper = pack.bounds(x[:50])
    exact = x[:50] @ x.T
    assert (lower <= exact).all() and (exact <= upper).all() and (upper - lower).mean() < 0.5 * (exact.max() - exact.min())

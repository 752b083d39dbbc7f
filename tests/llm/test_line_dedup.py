"""Line dedup against edit similarity alone."""

from __future__ import annotations

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from cairn.llm import edits, line_dedup


def similarity(a: str, b: str) -> float:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


@settings(max_examples=200, deadline=None)
@given(st.text("abé😀 ", max_size=40), st.text("abé😀 ", max_size=40), st.integers(0, 45))
def test_distance(a, b, most):
    want = round((1 - similarity(a, b)) * max(len(a), len(b), 1))
    assert line_dedup.distance(a, b, most) == (want if want <= most else None)


def test_distances_of_many_pairs():
    """Many pairs at once, with bands of one word and more, letters outside the BMP, empty texts: the same as one by one."""
    rng = random.Random(4)
    pairs = []
    for _ in range(1500):
        a = [rng.choice("abcé😀 ") for _ in range(rng.choice([0, 1, 7, 63, 64, 65, 130, 400, 700]))]
        b = list(a)
        for _ in range(rng.randrange(len(a) // 4 + 2)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "xy"])
        pairs.append(("".join(a), "".join(b), rng.choice([0, 3, len(a) // 5, len(a) // 2, len(a) + 9])))
    a, b, most = zip(*pairs)
    alone = []
    got = edits.within(pa.array(a), pa.array(b), np.array(most), lambda *pair: alone.append(pair) or line_dedup.distance(*pair))
    assert got.tolist() == [line_dedup.distance(*pair) is not None for pair in pairs]
    assert 300 < got.sum() < 1400 and len(alone) < 200


def test_long_lines(spark):
    """Lines of many thousand characters, near and not near."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    near, far = list(words), list(words)
    for i in rng.sample(range(900), 150):
        near[i] = "zz" + words[i][::-1]
    for i in rng.sample(range(900), 500):
        far[i] = "yyyyyy"
    texts = [" ".join(words), " ".join(near), " ".join(far)]
    assert line_dedup.distance(texts[0], texts[1], len(texts[1]) // 5) is not None and line_dedup.distance(texts[0], texts[2], len(texts[0]) // 5) is None
    assert [t == "" for t in texts_after(spark, texts)] == [False, True, False]


def texts_after(spark, texts: list[str]) -> list[str]:
    rows = line_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def test_recall_of_changed_words(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    pairs = []
    for n in (8, 20, 40, 100):
        made = 0
        while made < 30:
            a = [word() for _ in range(n)]
            b = list(a)
            for i in rng.sample(range(n), rng.randint(1, max(1, n // 5))):
                b[i] = word()
            if a != b and similarity(" ".join(a), " ".join(b)) >= 0.8:
                pairs.append((n, " ".join(a), " ".join(b)))
                made += 1
    left = texts_after(spark, [t for _, a, b in pairs for t in (a, b)])
    assert all(left[2 * k] == a for k, (_, a, _) in enumerate(pairs))
    for n in (8, 20, 40, 100):
        gone = [left[2 * k + 1] == "" for k, p in enumerate(pairs) if p[0] == n]
        assert sum(gone) >= 0.9 * len(gone), (n, sum(gone))


def test_numbers_count(spark):
    texts = [
        "12 7 9 31 4", "88 1 2 5 6", "12  7 9 31 4",
        "In 1990 the town had 12345 people", "In 2020 the town had 99 people", "in 1991 the town had 12345 people",
    ]
    assert similarity(texts[3].lower(), texts[4].lower()) < 0.8 <= similarity(texts[3].lower(), texts[5])
    left = texts_after(spark, texts)
    assert left == [*texts[:2], "", *texts[3:5], ""]


def test_short_and_unspaced_lines(spark):
    rng = random.Random(6)
    clause = "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(40))
    other = clause[:20] + "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(2)) + clause[22:]
    texts = ["Share this\nfirst own", "one\n\nshare this\n\ntwo", clause, clause, other, "Share that"]
    assert texts_after(spark, texts) == [texts[0], "one\n\n\ntwo", clause, "", "", "Share that"]


def test_many_removed_lines(spark):
    """A text that loses two hundred thousand lines, in time that grows with their number."""
    lines = [f"entry {i:07d} {i * 7919 % 1000003:07d}" for i in range(200_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["kept line one", *lines, "kept line two"]))], "doc_id long, text string")
    gone = spark.createDataFrame([(2, list(range(1, 200_001)))], "doc long, gone array<int>").join(docs.selectExpr("doc_id AS doc", "xxhash64(text) AS mark"), "doc")
    began = time.time()
    left = {r.doc_id: r.text for r in line_dedup.without(docs, gone).collect()}
    assert left[2] == "kept line one\nkept line two" and left[1].count("\n") == 199_999 and time.time() - began < 30


def test_sketches_come_with_the_keys(spark):
    """Each line's MinHashes are made once: the step that lays out its keys also gives its sketch and length."""
    lines = [f"line number {i} of {i * 7919 % 101} words that are {'not ' * (i % 3)}the same" for i in range(300)] + ["a b c d e", "\u4e00" * 20]
    found = line_dedup._members(spark.createDataFrame([(i + 5, x, len(x)) for i, x in enumerate(lines)], "id long, line string, length int"), 3)
    signs = line_dedup.sketches(line_dedup.minhashes(pa.array(lines))).view(np.int64)
    assert {r.id: (r.s1, r.s2, r.length) for r in found.where("bucket IS NULL").collect()} == {i + 5: (*signs[i].tolist(), len(x)) for i, x in enumerate(lines)}
    keys = line_dedup.block_keys(line_dedup.minhashes(pa.array(lines)))
    met = [set(np.flatnonzero((keys == k).any(axis=1)).tolist()) for k in keys]
    buckets = {}
    for r in found.where("bucket IS NOT NULL").collect():
        buckets.setdefault(r.bucket, set()).add(r.id - 5)
    assert all(len(x) > 1 for x in buckets.values()) and all(any(i in x and x >= {i, j} for x in buckets.values()) for i in range(len(lines)) for j in met[i] if i != j)


def test_letters_that_cost_edits():
    """Pairs told apart by their letters alone, and pairs alike at both ends: as one by one, in few tables."""
    rng = random.Random(9)
    a = ["".join(rng.choice("abcdef ") for _ in range(120)) for _ in range(60)]
    b = [x[:50] + "".join(rng.choice("xyzé") for _ in range(rng.choice([3, 24, 30]))) + x[50 + rng.choice([0, 20]) :] for x in a]
    far = [("q" * 100, "r" * 100, 20), ("é" * 30 + "a", "é" * 30, 0), ("abc" * 9, "abc" * 9, 0), ("aXc" * 9, "abc" * 9, 9)]
    a, b, most = [*a, *(x for x, *_ in far)], [*b, *(y for _, y, _ in far)], np.array([24] * 60 + [k for *_, k in far])
    got = edits.within(pa.array(a), pa.array(b), most, line_dedup.distance)
    assert got.tolist() == [line_dedup.distance(*x) is not None for x in zip(a, b, most.tolist())] and 10 < got[:60].sum() < 60
    assert edits.within(pa.array(["q" * 100] * 9), pa.array(["r" * 100] * 9), np.array([20] * 9), None).sum() == 0
    assert edits._alike(np.frombuffer(b"abcabd", np.uint8), np.array([0]), np.array([3]), np.array([3]), 1).tolist() == [2]

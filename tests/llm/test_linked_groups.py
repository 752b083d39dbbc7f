"""Groups over shared buckets: the last step, which looks at all pairs across groups."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from cairn.llm import components, line_dedup, parity_join


def test_a_pair_of_many_buckets_comes_once(spark, monkeypatch):
    """Thirty ids that share a hundred buckets, each missing in some: a row for each pair, not one for each pair and bucket."""
    rng = random.Random(5)
    rows = [(bucket, 0, i, i // 3) for bucket in range(100) for i in range(1, 31) if rng.random() < 0.9] + [(200 + i, 0, 40 + i, 40 + i) for i in range(5)]
    want = {(a, b) for a in range(1, 31) for b in range(a + 1, 31) if a // 3 != b // 3}
    for span in (1024, 7):
        monkeypatch.setattr(components, "SPAN", span)
        found = components.across(spark.createDataFrame(rows, "bucket long, leader long, id long, component long"))
        assert Counter((r.a, r.b) for r in found.collect()) == Counter(want)


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(components, "SPAN", 8)
    members = {(rng.randrange(12), i) for i in range(60) for _ in range(3)}
    linked = {(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.03}
    of = {i: {k for k, j in members if j == i} for i in range(60)}
    group = list(range(60))
    for a, b in linked:
        if of[a] & of[b]:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    links = spark.createDataFrame(sorted(linked), "a long, b long")
    marks = spark.createDataFrame([(i, [i, -i]) for i in range(60)], "id long, pair array<long>")
    may = lambda x, y: (x["pair"][:, 0] == -x["pair"][:, 1]) & (y["pair"].sum(axis=1) == 0)
    found = components.linked_groups(spark.createDataFrame(sorted(members), "bucket long, id long"), lambda pairs, _: pairs.join(links, ["a", "b"]), marks, may)
    assert {r.id: r.component for r in found.collect()} == {i: g for i, g in enumerate(group) if group.count(g) > 1}


def test_marks_with_the_highest_bit():
    """Sketches whose numbers are negative as signed ones: all bits that differ count."""
    x, y = np.full((1, 8), -1, np.int64), np.zeros((1, 8), np.int64)
    far = lambda n: parity_join.may_link({"n": np.array([n]), "sketch": x}, {"n": np.array([n]), "sketch": y})[0]
    assert not far(7 * 256 - 1) and far(7 * 256)
    one = lambda s: {"s1": np.array([s]), "s2": np.array([0]), "length": np.array([20])}
    assert line_dedup.may_link(one(-1 << 14), one(0))[0] and not line_dedup.may_link(one(-1 << 13), one(0))[0]


def test_pairs_that_miss_are_no_rows(spark):
    """Texts compared where pairs are found: of a family that just misses, only linked pairs come out, and no task gets all pairs' texts."""
    n, lines = 1200, {}
    for i in range(n):
        lines[i] = f"{'shared passage ' * 3}{i % 400:04d}"
    rest = spark.createDataFrame([(bucket, 0, i, i) for i in range(n) for bucket in (7, 8)], "bucket long, leader long, id long, component long")
    texts = spark.createDataFrame(list(lines.items()), "id long, line string")
    found = components.across(rest, texts=texts, near=lambda a, b: np.array([x == y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)).collect()
    got = [(r.a, r.b) for r in found]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(n) for j in range(i + 400, n, 400)}


def test_leaders_of_few_ids_are_looked_at_together(spark, monkeypatch, tmp_path):
    """Ten leaders of the same four ids, in one task: their pairs are compared once, not once for each leader; also beside a large family."""
    rows = [(leader * 10 + b, leader, i, i) for leader in range(10) for b in range(3) for i in (100, 101, 102, 103)] + [(900, 90, i, i // 2) for i in range(200, 240)]
    rest, texts = spark.createDataFrame(rows, "bucket long, leader long, id long, component long"), spark.createDataFrame([(i, f"{i % 2}") for i in [*range(100, 104), *range(200, 240)]], "id long, line string")

    def near(a, b):
        (tmp_path / str(random.random())).write_text("\n".join(f"{x}" for x in range(len(a))))
        return np.array([x == y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = [(r.a, r.b) for r in components.across(rest, texts=texts, near=near).collect()]
        assert sum(len(p.read_text().split("\n")) for p in tmp_path.iterdir()) == 6 + 40 * 39 // 2 - 20
        monkeypatch.setattr(components, "_MEET", 30)
        assert sorted(got) == sorted((r.a, r.b) for r in components.across(rest, texts=texts, near=near).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(got) == Counter([(100, 102), (101, 103)] + [(a, b) for a in range(200, 240) for b in range(a + 2, 240, 2)])

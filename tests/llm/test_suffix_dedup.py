"""Suffix-array dedup against a dictionary of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import queries, suffix_dedup


def plain(rows: list[tuple[int | None, str | None]], length: int) -> list[tuple]:
    """doc_id, n_bytes, removed runs and kept bytes of each row."""
    first: dict[bytes, int] = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1) if doc is not None else ():
            w = data[i : i + length]
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1) if doc is not None else ():
            if first[data[i : i + length]] < doc:
                gone[i : i + length] = [True] * length
        edges = [i for i in range(len(data) + 1) if (i < len(data) and gone[i]) != (i > 0 and gone[i - 1])]
        out.append((doc, len(data), list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(9, 60))
def test_order_and_prefixes(data, depth):
    text = np.frombuffer(data.translate(bytes(97 + i % 2 for i in range(256))), np.uint8)
    padded = text.tobytes() + bytes(depth)
    order = suffix_dedup.suffix_order(text, depth)
    assert [padded[i : i + depth] for i in order] == sorted(padded[i : i + depth] for i in range(len(text)))
    shared = suffix_dedup.common_prefixes(text, order, depth)
    for k in range(1, len(order)):
        a, b = (padded[i : i + depth] for i in order[k - 1 : k + 1])
        assert shared[k] == next((i for i in range(depth) if a[i] != b[i]), depth)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=17, max_size=17), max_size=60), st.lists(st.binary(min_size=17, max_size=17), max_size=20))
def test_binary_search(have, ask):
    words = lambda rows: suffix_dedup.window_words(np.frombuffer(b"".join(rows), np.uint8), np.arange(len(rows)) * 17, 17)
    have = sorted(set(have))
    if have:
        assert suffix_dedup.place_of(words(have), words(ask + have)).tolist() == [sum(h < a for h in have) for a in ask + have]


def corpus(seed: int) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé😀") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(12, 90)) for _ in range(6)]
    common, tail = text(25), text(8)
    rows: list[tuple[int | None, str | None]] = []
    for doc in rng.sample(range(1000), 60):
        parts = [text(rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        if rng.random() < 0.6:
            parts.insert(0, common[: rng.randint(20, len(common))])
        if rng.random() < 0.3:
            parts.append(tail)
        rows.append((doc, "".join(parts)))
    rows += [(2000 + i, rows[3][1]) for i in range(30)] + [(2100, "a" * 700), (2101, "a" * 90 + "b" + "a" * 49), (5, "a" * 49), (6, "a" * 50)]
    rows += [(2200, None), (2201, ""), (2202, "short"), (None, rows[3][1]), (rows[3][0], rows[3][1]), (rows[3][0], rows[4][1]), (2300, passages[0] * 3), (2301, passages[0] * 2 + common)]
    rows += [(2400, "\0" * 60), (2401, "x" + "\0" * 55), (-7, common)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("length,small", [(50, False), (50, True), (23, True)])
def test_against_all_windows(spark, monkeypatch, length, small):
    """Also with tiny shards and packs, long texts in pieces, and anchors that count as very common."""
    if small:
        for name, value in (("SHARD_BYTES", 400), ("PACK_BYTES", 500), ("PART_BYTES", 4000), ("HOT_SHARDS", 5)):
            monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus(length + small)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_bytes int, spans string").repartition(3)
    found = suffix_dedup.deduplicated(docs, length).collect()
    assert sorted(((r.doc.doc_id, r.n_bytes, [(s.first, s.end) for s in r.spans], bytes(r.kept)) for r in found), key=str) == plain(rows, length)
    assert {(r.doc.n_bytes, r.doc.spans) for r in found} == {(1, "x")}


def test_query_and_empty(spark, tmp_path):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    found = queries.op11_suffix_dedup(spark, str(tmp_path / "some")).collect()
    want = [(d, n, sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()) for d, n, runs, kept in plain(rows, 50)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    docs.where("doc_id = -1").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op11_suffix_dedup(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=150), min_size=1, max_size=6), st.integers(1, 3), st.sampled_from([12, 20, 21, 22, 50, 51]))
def test_equal_windows_have_equal_keys(texts, letters, length):
    """Each window is in one run, and equal windows have one key and one anchor, also where an anchor comes again and again."""
    texts = [t.translate(bytes(97 + i % letters for i in range(256))) for t in texts] + [b"ab" * 60]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    seen, keys = [], {}
    for key, first, n, text, anchor in zip(*(x.tolist() for x in suffix_dedup.anchored(data, at, length, 7))):
        for i in range(first, first + n):
            assert at[text] <= i and i + length <= at[text + 1]
            seen.append(i)
            assert keys.setdefault(data[i : i + length].tobytes(), (key, anchor)) == (key, anchor)
    assert seen == [i for a, b in zip(at.tolist(), at[1:].tolist()) for i in range(a, b - length + 1)]


def test_short_phrases_that_recur_are_not_sent(spark):
    """Phrases longer than an anchor, in other surroundings each time: no window repeats, so no run travels; a longer one does."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    phrases, passage = [text(26) for _ in range(20)], text(90)

    def sent(between: list[str]) -> int:
        rows = [(i, 7, "".join(text(60) + x for x in between).encode() + text(60).encode()) for i in range(12)]
        docs = spark.createDataFrame(rows, "doc_id long, mark long, data binary").repartitionByRange(4, "doc_id")
        shards = suffix_dedup.saved(suffix_dedup._packed(docs, 50), "shards")
        assert shards.count() > 1
        return suffix_dedup._settled(shards, suffix_dedup._shared_anchors(shards, 50, 5), 50, 5).where("key IS NOT NULL").count()

    assert sent(phrases) == 0 < sent([passage])


def test_anchors_of_many_runs(spark, monkeypatch):
    """A common passage travels as runs, one for each shard, while they fit into a part; beyond that by window. Both give the same."""
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = text(150)
    rows = [(i, text(rng.randint(40, 90)) + passage + text(70)) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, value in (("SHARD_BYTES", 400), ("HOT_SHARDS", 5)):
        monkeypatch.setattr(suffix_dedup, name, value)
    packed = spark.createDataFrame([(d, 7, t.encode()) for d, t in rows], "doc_id long, mark long, data binary").repartitionByRange(8, "doc_id")
    shards = suffix_dedup.saved(suffix_dedup._packed(packed, 50), "shards")
    lengths = []
    for part in (1 << 20, 400):
        monkeypatch.setattr(suffix_dedup, "PART_BYTES", part)
        sent = suffix_dedup._settled(shards, suffix_dedup._shared_anchors(shards, 50, 3), 50, 3).where("key IS NOT NULL")
        lengths.append([len(r.bytes) for r in sent.collect()])
        found = suffix_dedup.deduplicated(docs, 50).collect()
        assert sorted(((r.doc.doc_id, r.n_bytes, [(s.first, s.end) for s in r.spans], bytes(r.kept)) for r in found), key=str) == plain(rows, 50)
    assert sum(lengths[0]) * 3 < sum(lengths[1]) and 2 * lengths[1].count(50) > len(lengths[1])

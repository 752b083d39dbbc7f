"""Each operator against a plain version on small inputs, odd rows included."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from cairn.llm import bpe, langid, line_dedup, mixing, pairwise_quality, parity_join, quality_rules, queries, resharding, rp_forest, wavelet
from cairn.llm.components import connected_components
from cairn.llm.textgrams import windows, word_hashes

tokenizers = pytest.importorskip("tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, shard int"


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    base = [rng.choice(["alpha", "beta", "Gamma", "delta", "the", "of", "and", "in", "naïve", "x1"]) + str(rng.randint(0, 60)) for _ in range(80)]
    near = list(base)
    near[40] = "changed"
    line = "one line that many of these documents share among themselves"
    return [
        None, "", " \n\t ", "one", "two words", "a b c d", "a b c d e", "A b C d E",
        " ".join(base), " ".join(base), " ".join(near), " ".join(base).upper(),
        f"{line}\nfirst own line with some words of it", f"{line}\nsecond own line with other words in it", f"{line.title()}!\nthird",
        "tick " * 300, "###### $$$$ " * 40, "x" * 5000, "w " * 30_000, "été à la plage avec les amis de la famille et du soleil",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, some rows twice, extra columns whose names clash with results."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", 0, 7, True, 3) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame([*rows, rows[8], rows[1]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(SMALL))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups_of(ids, linked) -> dict:
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_word_hashes_follow_words():
    texts = ["a b", None, "", "b  a\tb", "A"]
    h, at = word_hashes(pa.array(texts))
    words = [WORD.findall(t or "") for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    by = {}
    for word, x in zip([w for ws in words for w in ws], h.tolist()):
        assert by.setdefault(word, x) == x
    assert len(set(by.values())) == len(by)
    lower, _ = word_hashes(pa.array(texts), lower=True)
    assert lower[-1] == h[0]
    w, of = windows(h, at)
    assert of.tolist() == [0, 3, 4]


def test_quality_rules(spark, odd, empty):
    got = quality_rules.judged(odd).select("doc_id", "_qr.*").distinct().collect()
    texts = dict(enumerate(odd_texts()))
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        twice = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(w) < 10 or 100 * len(twice) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    kept = quality_rules.accepted(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert quality_rules.judged(empty).count() == 0
    names = ("_qr", "_qw", "_qh", "_doc", "doc", "keep")
    clash = odd.withColumns({c: F.lit(1) for c in names})
    assert quality_rules.accepted(clash).columns == clash.columns and quality_rules.accepted(clash).count() == kept.count()
    greek = spark.createDataFrame([(1, " ".join(f"λόγος{chr(945 + i % 20)}{chr(945 + i // 20)}" for i in range(90)))], "doc_id long, text string")
    assert quality_rules.accepted(greek).count() == 1


def test_parity_join(spark, odd, empty):
    texts = odd_texts()
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups_of(sets, links)
    got = parity_join.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]) for r in got)
    assert parity_join.near_duplicates(empty).count() == 0
    left = parity_join.deduplicated(odd)
    assert left.columns == odd.columns
    assert {r.doc_id for r in left.collect()} == {i for i in sets if want[i] == i}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(0, 2**32))
def test_similar_sets_share_a_block(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 52, n, dtype=np.uint64)
    b = a.copy()
    b[: rng.integers(0, n // 7 + 1)] += np.uint64(1)
    b = np.concatenate([b, rng.integers(0, 1 << 52, int(rng.integers(0, max(1, n // 10))), dtype=np.uint64)])
    same = len(set(a.tolist()) & set(b.tolist()))
    if 4 * same < 3 * len(set(a.tolist()) | set(b.tolist())):
        return
    keys, owner, _, spare = parity_join.block_keys(np.concatenate([a, b]), np.array([len(a), len(b)]))
    shared = set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
    assert shared and len(shared) > min(spare[np.isin(keys, list(shared))])


def test_hot_group_of_near_copies(spark):
    """A chain of texts, each near the next, and a passage in texts that are not near."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    base, rows = [word() for _ in range(60)], []
    for i in range(60):
        base[rng.randrange(60)] = word()
        rows.append((i, " ".join(base)))
    passage = [word() for _ in range(30)]
    rows += [(100 + i, " ".join(passage + [word() for _ in range(40)])) for i in range(60)]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    want = groups_of(sets, links)
    got = parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    want = groups_of({x for e in edges for x in e}, edges)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == c for i, c in want.items())


def test_lines(spark, odd, empty):
    got = line_dedup.deduplicated(odd, counts=True)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count()
    assert rows[0].text is None and rows[1].text == ""
    assert rows[12].removed == [] and rows[13].removed == [0] and rows[14].removed == [0] and rows[14].text == "third"
    assert rows[8].removed == [] and rows[9].text == "" and rows[11].text == ""
    assert rows[18].removed == []
    assert line_dedup.deduplicated(odd).columns == odd.columns
    assert line_dedup.deduplicated(empty).count() == 0


def test_fuzzy_lines(spark):
    rng = random.Random(9)
    rows = []
    for i in range(20):
        w = [f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}q" for _ in range(120)]
        rows.append((2 * i, " ".join(w)))
        w[rng.randrange(120)] = "zz"
        rows.append((2 * i + 1, " ".join(w)))
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, t in got.items() if t == ""} == set(range(1, 40, 2))


def test_mixing(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found, pieces = mixing.mix(docs)
    rows = found.collect()
    assert len(rows) == docs.count() and found.exceptAll(mixing.mix(docs)[0]).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(r.size for r in rows)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= 1
        assert v[0].target <= 3 * v[0].source_size
        assert all((r.first_turn is None) == (r.taken == 0) for r in v)
    # the schedule: each half of the turns holds each source in its share
    turns = pieces.select("turn", "source").distinct().collect()
    half = sorted(r.turn for r in turns)[len(turns) // 2]
    first = Counter(r.source for r in turns if r.turn < half)
    both = Counter(r.source for r in turns)
    assert all(abs(first[s] - n / 2) <= 2 + 0.1 * n for s, n in both.items())
    got = {(r.doc_id, r.size): r.taken for r in mixing.mix(odd)[0].collect()}
    assert got[0, 0] == 0 and got[1, 0] == 0
    assert mixing.mix(empty)[0].count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(odd).columns == odd.columns
    clash = docs.withColumns({c: F.lit(1) for c in ("mark", "turn", "pass", "doc", "size", "_copy")})
    assert mixing.mixed(clash).columns == clash.columns


def test_schedule_rules_the_mix(spark, sf, monkeypatch):
    """The documents come in the order of the schedule, so another order of turns gives another mix."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found, pieces = mixing.mix(docs)
    first = {r.doc_id: r.first_turn for r in found.collect()}
    ids = [r.doc_id for r in mixing.mixed(docs).collect()]
    assert set(ids) == {i for i, t in first.items() if t is not None}
    seen = list(dict.fromkeys(ids))
    assert [first[i] for i in seen] == sorted(first[i] for i in seen)
    # any stretch of the mix holds the large sources in their shares
    source = {r.doc_id: r.source for r in docs.collect()}
    whole, half = Counter(source[i] for i in ids), Counter(source[i] for i in ids[: len(ids) // 2])
    assert all(abs(half[s] - n / 2) <= 3 + 0.25 * n for s, n in whole.items())
    monkeypatch.setattr(mixing, "van_der_corput", lambda number, bits: number)
    other = {r.doc_id: r.first_turn for r in mixing.mix(docs)[0].collect()}
    assert other != first and [r.doc_id for r in mixing.mixed(docs).collect()] != ids


def test_small_sources_are_not_lost(spark):
    """A source far smaller than a block still gives its target."""
    rows = [(i, "w " * 5000, "big") for i in range(40)] + [(100, "a b c d e", "tiny"), (101, "f g", None)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0].collect()
    taken = Counter()
    for r in found:
        taken[r.source] += r.taken
    assert taken["tiny"] == 15 and taken[None] == 6


def test_flow_is_least():
    rng = random.Random(2)
    for _ in range(20):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        supply = [rng.randint(0, 40) for _ in range(n)]
        room = resharding.even_capacities(sum(supply), m)
        cost = [[int(i != j) for j in range(m)] for i in range(n)]
        flow = resharding.min_cost_flow(supply, room, cost)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supply
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= room[k] for k in range(m))
        moved = sum(v for (i, j), v in flow.items() if i != j)
        # no plan can keep more in a shard than it has and may have
        assert moved == sum(supply) - sum(min(a, b) for a, b in zip(supply, room))
    with pytest.raises(ValueError):
        resharding.min_cost_flow([2], [1], [[0]])
    # a dear arc is avoided by rerouting an earlier choice
    assert resharding.min_cost_flow([1, 1], [1, 1], [[1, 2], [1, 9]]) == {(0, 1): 1, (1, 0): 1}


def test_resharding(spark, sf, odd, empty):
    rows = queries.op2_resharding(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = {}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "bytes")
        by.setdefault(r.shard, []).append(r)
    most = max(r.size for r in rows)
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert set(by) == set(range(8)) and max(sizes) - min(sizes) <= 4 * most
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    old = resharding.lay_out(odd.withColumn("doc", F.lit(1)), F.when(F.col("doc_id") != 3, F.col("doc_id") % 3), 3)
    found = resharding.reshard(spark, old, 4).rows(spark)
    assert found.select("doc.*").columns == [*odd.columns, "doc"]
    assert found.select("doc.*").drop("doc").exceptAll(odd).count() == 0 and found.count() == odd.count()
    assert resharding.reshard(spark, resharding.lay_out(empty, F.lit(0), 1), 4).rows(spark).count() == 0
    nameless = odd.withColumn("doc_id", F.lit(None).cast("long"))
    assert resharding.reshard(spark, resharding.lay_out(nameless, F.lit(0), 1), 2).rows(spark).count() == odd.count()


def test_resharding_spares_files(spark, sf):
    """One shard is too full: blocks before its cut and all blocks of the shard that only gains keep their bytes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    old = resharding.lay_out(docs, F.when(F.xxhash64("doc_id") % 10 > 3, F.lit(1)).otherwise(0), 2)
    files = lambda: {f: hashlib.md5(open(f.removeprefix("file://"), "rb").read()).hexdigest() for f in old.rows(spark).inputFiles()}
    before = files()
    small, large = sorted((0, 1), key=lambda i: old.sizes[i])
    room = [0, 0]
    room[small], room[large] = old.sizes[small] + 20_000, old.sizes[large] - 20_000
    new = resharding.reshard(spark, old, capacities=room)
    assert files() == before
    assert new.flow[large, small] == 20_000 and new.first_moved[small] > 1 << 30
    # only a few blocks were written anew, the others are read where they are
    rewritten = spark.read.parquet(new.path).count()
    assert 0 < rewritten < docs.count() / 4
    rows = new.rows(spark)
    assert rows.count() == docs.count() == rows.select("doc.doc_id").distinct().count()
    by = {r.shard: r for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("top")).collect()}
    assert all(abs(by[i].bytes - room[i]) < 200_000 and by[i].n == by[i].slots == by[i].top + 1 for i in (0, 1))


def test_language(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.op3_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 16)) and got[19].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}
    # the batch scores are the sums of log-probabilities
    langs, table = model
    text = "the cat sat on the mat"
    found, _ = langid.grams([text])
    total = sum(table[:, b].sum(axis=1) for b, _ in found)
    alone = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert alone.lang_pred == langs[int(total.argmax())]


def test_quality_scores(spark, sf, odd, empty):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op8_pairwise_quality(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good, bad = [r.score for r in held if labels[r.doc_id]], [r.score for r in held if not labels[r.doc_id]]
    wins = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) if good and bad else 1
    assert wins > 0.9
    blank = pairwise_quality.fit(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, quality int"))
    assert {r.score for r in pairwise_quality.scored(odd, blank).collect()} == {0.5}
    assert pairwise_quality.scored(empty, blank).count() == 0


def test_preferences():
    """The fit against its definition: scores of built vectors, gradient by differences, and nearly none at the end."""
    rng = random.Random(12)
    good = [" ".join(rng.choice(["river", "stone", "walked", "quiet", "evening", "the", "a"]) for _ in range(30)) + "." for _ in range(30)]
    bad = [" ".join(rng.choice(["BUY", "click", "$$$", "now!!!", "###"]) for _ in range(rng.randint(1, 30))) for _ in range(30)]
    odd = [None, "", " ", "x", "é", "日本語のテキスト", "a\nb\na\nb"]
    texts = pa.array([*good, *bad, *odd], pa.string())
    column, value, at = pairwise_quality.sparse(texts)
    g = np.random.default_rng(1)
    pairs = pairwise_quality.Preferences(column, value, at, g.integers(0, 30, 200), g.integers(30, 60, 200))
    w = g.normal(size=pairwise_quality.SIZE)
    assert np.allclose(pairwise_quality.raw_scores(texts, w), pairs.raw(w), atol=1e-4)
    for i in [*g.choice(column, 5), pairwise_quality.SIZE - 1]:
        step = np.zeros(pairwise_quality.SIZE)
        step[i] = 1e-5
        assert pairs.gradient(w)[i] == pytest.approx((pairs.loss(w + step) - pairs.loss(w - step)) / 2e-5, abs=1e-6)
    found = pairs.fit()
    assert np.abs(pairs.gradient(found)).max() < 1e-3 and pairs.loss(found) < 0.2
    raw = pairs.raw(found)
    assert raw[:30].min() > raw[30:60].max()


def test_quality_threshold(spark):
    """Of texts that the fit did not see, as large a share scores under the threshold as is labelled 0."""
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(["river", "stone", "quiet"] if i % 3 else ["BUY", "click", "!!"]) for _ in range(20)), int(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = pairwise_quality.fit(df)
    got = {r.doc_id: r.score for r in pairwise_quality.scored(df, model).collect()}
    assert all((got[i] >= pairwise_quality.THRESHOLD) == bool(q) for i, _, q in rows)
    assert pairwise_quality.fit(df.repartition(5)).weights.tolist() == model.weights.tolist()


def test_nearest(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(emb["embedding"]).astype(float), emb["vec_id"].to_numpy()
    got = queries.op1_rp_forest(spark, sf).toPandas().sort_values(["query_id", "rank"])
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort([ids, -s]) if j != i][:20]
        mine = got[got["query_id"] == ids[i]]
        assert mine["rank"].tolist() == list(range(1, 21)) and (np.diff(mine["score"]) <= 0).all()
        hits.append(len(set(mine["vec_id"]) & set(ids[order])) / 20)
        at = {v: k for k, v in enumerate(ids)}
        assert np.allclose(mine["score"], [s[at[v]] for v in mine["vec_id"]], rtol=1e-12)
    assert np.mean(hits) >= 0.9


def test_nearest_odd(spark):
    rows = [(i, [float(i % 4), 1.0, 0.5]) for i in range(40)] + [(50, None), (51, [0.0, 0.0, 0.0]), (52, [float("nan"), 1.0, 1.0]), (53, [None, 1.0, 1.0]), (54, [float("inf"), 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rp_forest.search(df, df.where("vec_id % 10 = 0"), k=5).collect()
    for q in (0, 10, 20, 30):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        best = sorted((i for i in range(40) if i != q), key=lambda i: (-sum(a * b for a, b in zip(rows[i][1], rows[q][1])), i))[:5]
        assert [r.vec_id for r in mine] == best
    assert len(got) == 20
    assert rp_forest.search(df.limit(0), df.limit(0)).count() == 0
    two = df.where("vec_id < 2")
    assert rp_forest.search(two, two).count() == 2
    # vectors of another length meet each other only
    mixed = df.unionByName(spark.createDataFrame([(100 + i, [1.0, float(i)]) for i in range(30)] + [(200, [])], df.schema))
    both = rp_forest.search(mixed, mixed.where("vec_id % 10 = 0"), k=5).collect()
    assert {tuple(r) for r in both if r.query_id < 100} == {tuple(r) for r in got}
    assert {r.query_id: [x.vec_id for x in sorted(both, key=lambda x: x["rank"]) if x.query_id == r.query_id] for r in both if r.query_id >= 100} == {
        100: [101, 102, 103, 104, 105], 110: [129, 128, 127, 126, 125], 120: [129, 128, 127, 126, 125],
    }


def test_nearest_with_closed_leaves(spark):
    """Clustered vectors: most leaves stay closed, and a larger table opens a smaller share."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(120, 24))
    x = centres[rng.integers(0, 120, 8000)] + 0.4 * rng.normal(size=(8000, 24))
    x[:40] = x[40]
    shares = []
    for n in (2000, 8000):
        sample = rp_forest._lifted(x[:n] / np.linalg.norm(x[:n], axis=1).max(), 1.0)
        forest = [rp_forest.grow(sample, int(np.log2(n / rp_forest.LEAF_ROWS)), t) for t in range(rp_forest.TREES)]
        shares.append(rp_forest.calibrated(forest, sample, x[:n], 20, rp_forest.TARGET) / (rp_forest.TREES * (len(forest[0].offsets) + 1)))
        first = rp_forest.reached(forest, sample[:3], 5)
        assert all((np.diff(rp_forest.missed(forest, sample[i : i + 1])[0][first[i]]) >= 0).all() for i in range(3))
    assert shares[1] < shares[0] < 1 and shares[1] < 0.3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x[:4000].tolist())], "vec_id long, embedding array<double>")
    got = rp_forest.search(df, df.where("vec_id % 50 = 0")).toPandas()
    hits = []
    for q, mine in got.groupby("query_id"):
        s = x[:4000] @ x[q]
        order = [j for j in np.lexsort([np.arange(4000), -s]) if j != q][:20]
        hits.append(len(set(mine["vec_id"]) & set(order)) / 20)
        assert len(mine) == 20
    assert len(hits) == 80 and np.mean(hits) >= 0.9


@pytest.fixture(scope="module")
def byte_encoder():
    return bpe.Encoder(bpe.load(None, queries.tokenizer("byte_bpe_50k.json")))


PARTS = st.sampled_from(["a", "The", " ", "  ", "\n", "é", "ß", "1", "'s", ".", "<|endoftext|>", "ing", "日本", "😀", "\t", " ", "ll", "Σ", "İ", ",", "<|startoftext|>"])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=30).map("".join), min_size=1, max_size=6))
def test_bpe_is_the_librarys(byte_encoder, texts):
    whole = tokenizers.Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    ids, at = byte_encoder.encode_texts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        want = whole.encode(t, add_special_tokens=False).ids
        got = ids[at[i] : at[i + 1]]
        assert got.tolist() == want and byte_encoder.decode(got) == whole.decode(want, skip_special_tokens=False)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=30).map("".join), min_size=1, max_size=6))
def test_words_are_the_librarys(texts):
    path = queries.tokenizer("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    words = wavelet._words.get(path) or wavelet._words.setdefault(path, wavelet.Words(whole.to_str()))
    ids, n = words.encode(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_bpe_rows(spark, odd, empty):
    path = queries.tokenizer("byte_bpe_50k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    got = bpe.encode(odd, path).collect()
    texts = odd_texts()
    assert len(got) == odd.count()
    for r in got:
        want = whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode(empty, path).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1500))
def test_wavelet_matrix(values):
    ids = np.array(values, np.uint32)
    docs, lengths, m = wavelet.from_bytes(wavelet.to_bytes(np.array([3]), np.array([len(ids)]), ids))
    assert (m.ids() == ids).all() and docs.tolist() == [3] and lengths.tolist() == [len(ids)]
    for at in range(0, len(ids), 97):
        assert m.access(at) == ids[at]
        assert m.count(int(ids[at]), at) == (ids[:at] == ids[at]).sum()
    for s in set(values[:5]) | {1000}:
        places = np.flatnonzero(ids == s)
        assert m.count(s) == len(places)
        for k in {0, len(places) // 2, len(places) - 1} if len(places) else ():
            assert m.occurrence(s, k) == places[k]


def test_wavelet_rows(spark, odd, empty):
    path = queries.tokenizer("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    got = sorted(wavelet.encode(odd, path).collect(), key=lambda r: r.start)
    texts, at = odd_texts(), 0
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in odd.collect())
    for r in got:
        want = [*whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert wavelet.encode(empty, path).count() == 0
    big = (1 << 60) + 1
    named = spark.createDataFrame([(None, "one"), (big, "two"), (None, "")], "doc_id long, text string")
    got = sorted(wavelet.encode(named, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, big] and [r.start for r in got][0] == 0 and got[0].n_tokens == 1

"""Phrases, trees, running aggregates and tokens against plain versions."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cairn.functions import fernet
from cairn.operators import phrases, running, trees


def places(tokens: list[str], phrase: str) -> list[tuple[int, int]]:
    words, out, i = phrase.lower().split(), [], 0
    while words and i + len(words) <= len(tokens):
        if all(w in t.lower() for w, t in zip(words, tokens[i:])):
            out.append((i, i + len(words) - 1))
            i += len(words)
        else:
            i += 1
    return out


def test_phrases(spark):
    rng = random.Random(2)
    rows = []
    for n in range(60):
        tokens = [(rng.choice(["a", "ab", "Abc", "b,", "(c)", "ba", "É", ""]), *(float(rng.randint(0, 9)) for _ in range(4))) for _ in range(rng.randint(0, 40))]
        targets = [(" ".join(rng.choice(["a", "b", "C", "ab", "é"]) for _ in range(rng.randint(1, 4))), rng.choice([None, "*"])) for _ in range(rng.randint(0, 6))]
        rows.append((n, tokens, targets))
    rows += [(100, None, [("a", "")]), (101, [("a", 0.0, 0.0, 1.0, 1.0)], None), (102, [(None, 1.0, None, 2.0, 3.0), ("a a", 1.0, 1.0, 1.0, 1.0)], [("  ", "x"), ("A", "1"), ("A", "2"), (None, "q")])]
    frame = spark.createDataFrame(rows, f"id int, tokens array<{phrases.TOKEN}>, targets array<{phrases.TARGET}>")
    got = {r.id: r.redact_spans for r in phrases.located(frame, "tokens", "targets").collect()}
    for n, tokens, targets in rows:
        tokens, want, seen = tokens or [], [], set()
        for text, replacement in targets or []:
            if text and text.strip() and text.strip() not in seen:
                seen.add(text.strip())
                for a, b in places([t[0] or "" for t in tokens], text):
                    boxes = tokens[a : b + 1]
                    want.append((text.strip(), replacement, a, b, min(t[1] for t in boxes), min((t[2] for t in boxes if t[2] is not None), default=None), max(t[3] for t in boxes), max(t[4] for t in boxes)))
        assert [tuple(s) for s in got[n]] == want, n
    one = spark.createDataFrame([([("Dear", 0.0, 0.0, 1.0, 1.0), ("John", 0.0, 0.0, 1.0, 1.0), ("Smith,", 0.0, 0.0, 1.0, 1.0), ("hello", 0.0, 0.0, 1.0, 1.0)], [("john smith", "[X]"), ("smith", "[Y]")])], f"t array<{phrases.TOKEN}>, g array<{phrases.TARGET}>")
    assert phrases.located(one, "t", "g").select(phrases.covered(F.col("t"), F.col("redact_spans")).alias("x")).first().x == "Dear [X] hello"


def test_trees(spark):
    rng = random.Random(3)
    parent = {f"N{i}": f"N{rng.randrange(i // 3, i // 2 + 1)}" if i > 1 else None for i in range(200)} | {"lone": "gone"}
    nodes = spark.createDataFrame([(k, v, 1) for k, v in parent.items()], "id string, parent string, below int").drop("below")
    wanted = ["n17", "N180", "n180", "lone", "none", None, "N0"]
    chosen = {k for k in parent if k.lower() in {w.lower() for w in wanted if w}}
    above = lambda k: [k, *above(parent[k])] if k in parent else []
    keep = {a for k in chosen for a in above(k)}
    selected = spark.createDataFrame([(w,) for w in wanted], "id string")
    got = {r.id: (r.chosen, r.below) for r in trees.pruned(nodes, selected).collect()}
    assert got == {k: (k in chosen, sum(k in above(c)[1:] for c in chosen)) for k in keep}
    assert [r.id for r in trees.missing(nodes, selected).collect()] == ["none"] and trees.kept(nodes, selected.where("false")).count() == 0
    with pytest.raises(Exception, match="(?i)recursion"):
        trees.kept(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string"), spark.createDataFrame([("a",)], "id string"), deepest=4).count()


def test_trees_of_many_rows(spark):
    """More than a million rows on the way up, where Spark's recursion stops, and two ways to one node."""
    nodes = spark.range(300_000).select(F.concat(F.lit("l"), "id").alias("id"), F.concat(F.lit("m"), F.col("id") % 3).alias("parent"))
    top = spark.createDataFrame([("m0", "r"), ("m1", "r"), ("m2", "s"), ("m2", "r"), ("s", "r"), ("r", "q"), ("q", None)], "id string, parent string")
    got = {r.id: (r.chosen, r.below) for r in trees.pruned(nodes.union(top).dropDuplicates(["id", "parent"]), nodes.select(F.upper("id").alias("id"))).where("NOT id LIKE 'l%'").distinct().collect()}
    assert got == {"m0": (False, 100_000), "m1": (False, 100_000), "m2": (False, 100_000), "s": (False, 100_000), "r": (False, 300_000), "q": (False, 300_000)}


def test_running_aggregates(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), 1e9 + rng.random(), rng.choice([None, rng.random()])) for i in range(400)] + [(400, "c", None, None), (401, "d", 5.0, None)]
    frame = spark.createDataFrame(rows, "i int, k string, x double, y double")
    want = {}
    for k in ("a", "b", None, "c", "d"):
        for j, name in ((2, "x"), (3, "y")):
            v = [r[j] for r in rows if r[1] == k and r[j] is not None]
            want[k, name] = (len(v), *((round(f(v), 4) for f in (statistics.fmean, min, max)) if v else (None,) * 3), *((round(statistics.variance(v), 4), round(statistics.stdev(v), 4)) if len(v) > 1 else (0.0, 0.0)))

    def read(parts) -> dict:
        return {(r.k, r.dimension): tuple(r)[2:] for r in running.snapshot(parts, ["k"]).collect()}

    same = lambda got: got.keys() == want.keys() and all(g[0] == w[0] and (g[1:] == w[1:] or all(abs(a - b) <= 1e-4 for a, b in zip(g[1:], w[1:]))) for k, w in want.items() for g in (got[k],))
    assert same(read(running.partial(frame, ["k"], ["x", "y"])))
    pieces = running.partial(frame.withColumn("part", F.col("i") % 7), ["k", "part"], ["x", "y"]).drop("part")
    assert same(read(running.merged(pieces, ["k"])))
    # a stream that stops half way and goes on
    folder = str(tmp_path / "state")
    for half in (0, 1):
        frame.where(F.col("i") % 2 == half).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        assert running.maintained(stream, ["k"], ["x", "y"], folder).awaitTermination(60)
    assert same(read(running.state(spark, folder))) and running.state(spark, str(tmp_path / "none")) is None


def test_fernet(spark):
    """The vectors that the specification of the format publishes, and tokens that must not open."""
    key, token = "cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4=", "gAAAAAAdwJ6wAAECAwQFBgcICQoLDA0ODy021cpGVWKZ_eEwCGM4BLLF_5CV9dOPmrhuVUPgJobwOz7JcbmrR64jVmpU4IwqDA=="
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(fernet.encrypted(F.lit("hello"), key, F.lit(499162800), F.lit(bytes(range(16))))) == token
    assert one(fernet.decrypted(F.lit(token), key, ttl=60, now=F.lit(499162801))) == "hello" and one(fernet.decrypted(F.lit(token), key, ttl=60, now=F.lit(499162861))) is None
    texts = spark.createDataFrame([("",), ("é" * 100,), (None,), ("x" * 15,), ("y" * 16,)], "t string")
    made = texts.select("t", fernet.encrypted(F.col("t"), key).alias("k"))
    rows = made.select("t", "k", fernet.decrypted(F.col("k"), key).alias("back")).collect()
    assert all(r.t == r.back for r in rows) and len({r.k for r in rows}) == 5
    other = "A" * 42 + "E="
    changed = [token[:30] + ("A" if token[30] != "A" else "B") + token[31:], token[:-8], "", "no token!", token[:40], "gA==", token.replace("=", "")]
    assert [r.x for r in spark.createDataFrame([(c,) for c in changed], "k string").select(fernet.decrypted(F.col("k"), key).alias("x")).collect()] == [None] * len(changed)
    assert one(fernet.decrypted(F.lit(token), other)) is None
    with pytest.raises(ValueError):
        fernet.encrypted(F.lit("x"), "c2hvcnQ=")


def test_phrase_boxes_are_found_once(spark):
    """A filter or an explode of the places does not find the boxes again; nulls and NaN count as for array_min and array_max."""
    nan = float("nan")
    rows = [(0, [("a", nan, None, 1.0, nan), ("a", 2.0, None, None, 3.0)], [("a a", "r"), ("a", None)]), (1, [], [("a", "")]), (2, [("A", 1.0, 1.0, 2.0, 2.0)] * 3000, [("a", "*")])]
    frame = spark.createDataFrame(rows, f"id int, t array<{phrases.TOKEN}>, g array<{phrases.TARGET}>")
    spans = phrases.located(frame.where("id >= 0"), "t", "g").select("id", F.explode("redact_spans").alias("s"))
    assert "array_min" not in spans._jdf.queryExecution().optimizedPlan().toString()
    got = spans.where("id < 2").select("s.*").collect()
    assert [str(tuple(r)) for r in got] == [str(x) for x in [("a a", "r", 0, 1, 2.0, None, 1.0, nan), ("a", None, 0, 0, nan, None, 1.0, nan), ("a", None, 1, 1, 2.0, None, None, 3.0)]]
    assert spans.where("id = 2").count() == 3000

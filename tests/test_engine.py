"""The general operators: queries against their SQL, and hand cases."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import compliance, documents, quality
from cairn.operators.relational import asof_join, range_join
from cairn.plans import queries as plans
from cairn.sources.catalog import Catalog, NotAllowed, format_of, is_sql, is_table, matches
from cairn.streaming import segments

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return "null" if v is None else f"{float(v):.9g}" if hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_is_its_sql(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf)
    want = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    mine = sorted(str([plain(r[c]) for c in order]) for r in got.collect())
    place = [want.columns.index(c) for c in order]
    theirs = sorted(str([plain(r[i]) for i in place]) for r in want.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_uris():
    assert not is_sql("SELECTED.parquet") and not is_sql("WITHDRAWALS") and is_sql("select(1)") and is_sql("sql: select 1;")
    assert is_table("db.table") and is_table("t") and not is_table("a/b") and not is_table("x.parquet")
    assert format_of("s3://b/x.JSON") == "json" and format_of("db.table") is None


def test_gates(spark, tmp_path):
    with pytest.raises(NotAllowed):
        Catalog(spark).read("select 1")
    with pytest.raises(NotAllowed):
        Catalog(spark, allow_raw_sql=True).read("sql: drop table x")
    with pytest.raises(NotAllowed):
        Catalog(spark, allow_raw_sql=True).read("select 1; drop table x")
    cat = Catalog(spark, allow_raw_sql=True)
    assert cat.read("sql: select 1 AS a;").first().a == 1
    for kind in ("parquet", "orc", "csv", "json"):
        seen = cat.write(spark.range(5).toDF("a"), f"{tmp_path}/x.{kind}", options={"header": "true"})
        assert seen["row_count"] == 5
        assert cat.read(f"{tmp_path}/x.{kind}", options={"header": "true"}).count() == 5
    names = spark.createDataFrame([("Sales_2024",), ("other",)], "n string")
    assert names.where(matches(F.col("n"), "sales_*")).count() == 1 and names.where(matches(F.col("n"), "THE")).count() == 1


def test_quality_cases(spark):
    rows = spark.createDataFrame([(1, None, 0.0, None), (2, "x", 4.0, "a@b"), (2, "x", None, "zz")], "id long, name string, v double, mail string")
    rules = quality.QualityRules("id", mandatory=("name",), patterns={"mail": "[a-z]+@[a-z]+"}, expressions=("1/v > 0", "missing > 1", "not 1/v > 0"), keys=("id",), order_by=("mail",), weights={"completeness": 0.5, "validity": 0.5})
    got = {(r.record_id, r.completeness, r.validity): r for r in quality.measure(rows, rules).collect()}
    first = got[1, 0.0, None]
    assert first.dqi is None and first.consistency == 0 and "expression:1/v > 0" in first.failed_rules
    assert got[2, 1.0, 1.0].consistency == pytest.approx(1 / 3) and got[2, 1.0, 1.0].dqi == 1.0
    assert got[2, 1.0, 0.0].uniqueness == 0.0
    one = quality.aggregate(quality.measure(rows.where("v = 4"), rules)).first()
    assert (one["count"], one.variance, one.stdev) == (1, 0.0, 0.0)
    for bad in ("__import__('os')", "a.b", "[x for x in y]", "f(1)", "len(a, b)", "1 +"):
        with pytest.raises(quality.RuleError):
            quality.QualityRules("id", expressions=(bad,))
    with pytest.raises(quality.RuleError):
        quality.QualityRules("id", weights={"validity": 0.4})
    with pytest.raises(quality.RuleError):
        quality.QualityRules("id", keys=("id",))


def test_documents(spark):
    docs = spark.createDataFrame([(1, "d1", 1), (2, "d1", 2), (3, "d2", 3), (3, "d1", 4)], "id long, digest string, seq long")
    got = {r.id: (r.canonical_id, r.is_alias) for r in documents.bundle(docs, "id", "digest", "seq").collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (1, True)}
    again = documents.bundle(docs.repartition(7), "id", "digest", "seq")
    assert {r.id: (r.canonical_id, r.is_alias) for r in again.collect()} == got
    gap = spark.createDataFrame([(None, 1), ("a", None)], "s string, n int")
    assert [tuple(r) for r in documents.cleaned(gap).collect()] == [("", "1"), ("a", "")]
    stamped = documents.stamped(spark.createDataFrame([("x", "kept"), ("y", None)], "c string, content_digest string"), "c").collect()
    assert stamped[0].content_digest == "kept" and len(stamped[1].content_digest) == 64


def test_joins(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k long, t long")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c")], "k long, u long, x string")
    got = sorted((r.k, r.t, r.x) for r in asof_join(left, right, ["k"], "t", "u", ["x"]).collect())
    assert got == [(1, 1, None), (1, 5, "b"), (2, 9, None)]
    near = range_join(left, left, ["k"], "t", 4).collect()
    assert [(r.l_t, r.r_t) for r in near] == [(1, 5)]


def test_segments(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate("aabbba")], "d long, i long, f string")
    got = [r.segment for r in segments.runs(rows, ["d"], ["i"], "f", 2).orderBy("i").collect()]
    assert got == [1, 1, 2, 2, 3, 4]


def test_stream_is_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = segments.tumbling(stream, "ts", "1 hour", "event_type").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counted").exceptAll(segments.tumbling(events, "ts", "1 hour", "event_type")).count() == 0
    seen = segments.first_seen(stream.unionByName(stream), ["event_id"], "ts", "60 days").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    seen.awaitTermination(120)
    assert spark.table("seen").count() == events.count()


def test_compliance(spark):
    ids = spark.createDataFrame([("AC-1",), ("zz",)], "id string")
    cross = spark.createDataFrame([("ac-1", "ISM-1"), ("ac-1", "ISM-2")], "source string, target string")
    assert sorted(tuple(r) for r in compliance.translate(ids, cross).collect()) == [("AC-1", "ISM-1"), ("AC-1", "ISM-2"), ("zz", "zz")]
    with pytest.raises(LookupError):
        compliance.resolve(ids, spark.createDataFrame([("none",)], "id string"), strict=True)
    with pytest.raises(PermissionError):
        compliance.verify(spark.createDataFrame([("c", "x")], "component string, id string"), ids)


def test_text(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], list(v)).select(c.alias("r")).first().r
    assert one(X.slug(F.col("t"), 12), t="Crème brûlée, à la carte!") == "creme-brulee"
    assert one(X.html_text(F.col("t")), t="<p>a&amp;b<br>c</p><script>x<y</script> <b>d</b>") == "a&b\nc\nd"
    assert one(X.sentence_chunks(F.col("t"), 1), t="One. " * 60) and all(len(c) <= 200 for c in one(X.sentence_chunks(F.col("t"), 1), t="One. " * 60))
    assert [one(X.file_type_of_text(F.col("t")), t=t) for t in ('{"a": 1}', "<?xml version='1.0'?><a/>", "a,b\n1,2", "plain words here", "# Title\n\ntext", "2024-01-01 10:00 INFO x\n2024-01-01 10:01 WARN y")] == ["JSON", "XML", "CSV", "TXT", "MARKDOWN", "LOG"]
    kept = X.settled([(0, 5, "A", "", "", 20), (3, 9, "B", "", "", 20), (4, 6, "C", "", "", 40), (10, 12, "D", "", "", 10)])
    assert [s[2] for s in kept] == ["C", "D"]
    known = spark.createDataFrame([("quality", -3.0), ("of", -1.0), ("life", -2.0)], "word string, score double")
    tokens = spark.createDataFrame([("qualityoflife",), ("unknownstring",)], "token string")
    assert {r.token: r.pieces for r in X.split_words(tokens, known).collect()} == {"qualityoflife": ["quality", "of", "life"], "unknownstring": ["unknownstring"]}


def test_chunks_are_cut_once(spark):
    """A long text's sentences are split once, not for each chunk; the chunks are those of a plain packing."""
    text = " ".join(f"Sentence {i} {'x' * (i % 90)}." for i in range(3000))
    frame = spark.createDataFrame([(text,)], "t string").select(X.sentence_chunks(F.col("t"), 400).alias("c"))
    assert frame._jdf.queryExecution().analyzed().toString().count("split(") == 1
    want, n = [], 0
    for s in text.replace(". ", ".\n").split("\n"):
        if not want or n + len(s) + 1 > 400:
            n = len(s) + (not want)
            want.append(s)
        else:
            want[-1], n = want[-1] + " " + s, n + len(s) + 1
    assert frame.first().c == want

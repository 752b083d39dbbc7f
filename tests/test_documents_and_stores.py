"""Triples, layouts, schemas, the result store, recordings and live segments against plain versions."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import layouts, mail, schemas
from cairn.functions import text as X
from cairn.operators import sketches, triples, written
from cairn.operators.store import Results
from cairn.sources import recordings
from cairn.streaming import live_segments, segments


def test_triples(spark):
    rng = random.Random(5)
    rows = []
    for doc in ("a", "b", None):
        for seq in range(150):
            op = rng.choices(["add", "ADD", "remove", "update", "clear", "other"], [6, 2, 3, 3, 0.2, 0.3])[0]
            pick = lambda v: rng.choice([*v, None]) if op == "remove" or rng.random() < 0.05 else rng.choice(v)
            rows.append((doc, seq, op, pick(["s", "t"]), pick(["p", "q", "r"]), pick(["1", "2", "x\"\\n"]), rng.choice([None, None, "uri", triples.XSD + "int", "@en"])))
    rng.shuffle(rows)
    want: dict[str, dict] = {}
    for doc, seq, op, s, p, o, k in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1])):
        held, kind = want.setdefault(doc, {}), k or triples.PLAIN
        if op == "clear":
            held.clear()
        elif op == "remove":
            for t in [t for t in held if s in (None, t[0]) and p in (None, t[1]) and (o is None or (o, kind) == t[2:])]:
                del held[t]
        elif op.lower() in ("add", "update") and None not in (s, p, o):
            if op == "update":
                for t in [t for t in held if (s, p) == t[:2]]:
                    del held[t]
            held[s, p, o, kind] = seq
    found = triples.current(spark.createDataFrame(rows, "doc string, seq long, op string, subject string, predicate string, object string, kind string"))
    assert {(r.doc, r.subject, r.predicate, r.object, r.kind): r.since for r in found.collect()} == {(d, *t): s for d, held in want.items() for t, s in held.items()}
    again = found.select(*triples.TERMS, triples.read_line(triples.line(*[F.col(c) for c in triples.TERMS])).alias("x")).collect()
    assert all(tuple(r)[:4] == tuple(r.x) for r in again)
    odd = ["# note", "", "<a> <b> .", '_:x <p> "a\\\\nb\\"\\n" . # end', '<a> <b> "v"^^<t> .']
    got = [r.x for r in spark.createDataFrame([(t,) for t in odd], "t string").select(triples.read_line(F.col("t")).alias("x")).collect()]
    assert got[:3] == [None] * 3 and tuple(got[3]) == ("_:x", "p", 'a\\nb"\n', triples.PLAIN) and tuple(got[4]) == ("a", "b", "v", "t")


def test_layouts(spark):
    outlook = "\n  From: Ann <a@x.org>\nSent: Friday, 4 September 2026 3:05 PM\nTo: b@y.org;\n   c@z.org\nSubject: Long\n words\n\nHello\nFrom: nobody"
    apple = "MAIL\nFrom: Ann <a@x.org>\r\nSubject: Hi\r\nDate: September 4, 2026 at 3:05:06 PM\r\nTo: b@y.org\r\n\r\nbody"
    header = "From: a@x.org\nTo: b@y.org\nDate: Tue, 3 Sep 2024 16:59:00 +0200\n\nx"
    quoted = "Hello\nthere\nall\n" + outlook.strip()
    memo = "From: Ann\nSubject: x\nSent: today\n\nno address"
    two_gaps = "From: a@x.org\nx\ny\nSubject: s\nSent: z"
    web = "something printed\nhttps://MAIL.google.com/u/0"
    texts = [outlook, apple, header, quoted, memo, two_gaps, web, "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("b", layouts.header_block(F.col("t")))
    got = {r.i: r for r in rows.select("i", "b", layouts.shown(F.col("b"), "Subject").alias("subject"), layouts.shown(F.col("b"), "To").alias("to"), layouts.sent(F.col("b")).alias("sent")).collect()}
    assert [got[i].b.layout if got[i].b else None for i in range(9)] == ["outlook-print", "apple-mail-print", "rfc-header-block", None, None, None, "webmail-print", None, None]
    assert (got[0].subject, got[0].to, str(got[0].sent)) == ("Long", "b@y.org; c@z.org", "2026-09-04 15:05:00") and got[0].b.labels == ["From", "Sent", "To", "Subject"]
    # a line after the last label is looked at, but is no part of the block
    assert got[0].b.lines[-1] == "Subject: Long"
    assert got[1].b.start == 1 and str(got[1].sent) == "2026-09-04 15:05:06" and str(got[2].sent) == "2024-09-03 16:59:00" and got[2].b.addresses == 2


SCHEMA = {
    "type": "object",
    "required": ["id", "lines"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1},
        "kind": {"enum": ["a", "b", None]},
        "lines": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"$ref": "#/$defs/line"}},
        "who": {"anyOf": [{"type": "string", "pattern": "^[A-Z]"}, {"type": "object", "required": ["name"]}]},
        "one": {"oneOf": [{"type": "number"}, {"type": "integer"}, {"const": "x"}]},
        "more": {"type": "object", "additionalProperties": {"type": "string", "maxLength": 2}, "maxProperties": 2},
        "it's": {"not": {"type": "null"}},
    },
    "$defs": {"line": {"type": "object", "required": ["n"], "properties": {"n": {"type": ["number", "null"], "exclusiveMaximum": 10, "multipleOf": 0.5}, "tags": {"items": {"type": "string", "minLength": 1}}}}},
}


def test_schemas(spark):
    cases = {
        '{"id": 1, "lines": [{"n": 1.5, "tags": ["x"]}]}': [],
        '{"id": 1.0, "lines": [{"n": null}], "kind": null, "who": "Ann", "one": 1.5, "more": {"a": "xy"}, "it\'s": 1}': [],
        '{"id": 0, "lines": []}': [("$.id", "minimum"), ("$.lines", "minItems")],
        '{"id": "1", "lines": [{"n": 10}, {"n": 0.3}, {"tags": ["", 1]}, {"n": 10}], "x": 1}': [("$.id", "type"), ("$.lines", "uniqueItems"), ("$.lines[0].n", "exclusiveMaximum"), ("$.lines[1].n", "multipleOf"), ("$.lines[2].n", "required"), ("$.lines[2].tags[0]", "minLength"), ("$.lines[2].tags[1]", "type"), ("$.lines[3].n", "exclusiveMaximum"), ("$.x", "additionalProperties")],
        '{"kind": "c", "who": "ann", "one": 1, "more": {"a": "xyz", "b": 1, "c": ""}, "it\'s": null}': [("$.id", "required"), ("$.lines", "required"), ("$.kind", "enum"), ("$.who", "anyOf"), ("$.one", "oneOf"), ("$.more", "maxProperties"), ("$.more.a", "maxLength"), ("$.more.b", "type"), ("$.it's", "not")],
        "[1]": [("$", "type")],
        "{broken": [("$", "json")],
        '{"id": 2, "who": {"name": 1}, "lines": [1]}': [("$.lines[0]", "type")],
    }
    rows = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", schemas.violations(F.col("t"), SCHEMA).alias("v")).collect()
    for r in rows:
        assert sorted((v.path, v.keyword) for v in r.v) == sorted(cases.get(r.t, [("$", "json")])), r.t
    with pytest.raises(ValueError, match="itself"):
        schemas.violations(F.lit("1"), {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}})


def test_result_store(spark, tmp_path):
    store = Results(spark, f"file://{tmp_path}/store", "digest string, size long")
    rows = spark.createDataFrame([("a", "x"), ("b", "yy"), ("a", "x"), (None, "z")], "digest string, text string")
    asked: list[int] = []

    def size(new):
        asked.append(new.count())
        return new.select("digest", F.length("text").cast("long").alias("size"))

    assert store.read().count() == 0 and store.run(rows, size) == 2
    more = rows.unionByName(spark.createDataFrame([("c", "ccc")], rows.schema))
    assert (store.run(more, size), store.run(more, size), asked) == (1, 0, [2, 1, 0])
    # a writer that died before its manifest, and one that comes second
    store._written(spark.createDataFrame([("d", 9)], store.schema))
    late = Results(spark, store.folder, store.schema)
    taken, published = late._published, []

    def rival(number, parts):
        if not published:
            published.append(True)
            assert store.add(spark.createDataFrame([("e", 1), ("f", 1)], store.schema)) == 2
        return taken(number, parts)

    object.__setattr__(late, "_published", rival)
    assert late.add(spark.createDataFrame([("e", 2), ("g", 2), ("g", 2)], store.schema)) == 1
    want = {("a", 1), ("b", 2), ("c", 3), ("e", 1), ("f", 1), ("g", 2)}
    assert {tuple(r) for r in store.read().collect()} == want and store.read().count() == 6
    store.compacted()
    assert len(store.manifest()[1]) == 1 and {tuple(r) for r in store.read().collect()} == want and len(store.orphans()) > 1


def test_recordings(spark, tmp_path):
    recordings.register(spark)
    rng = np.random.default_rng(6)
    for name, kind in (("u8_iq", "<u1"), ("s8_iq", "<i1"), ("s16_iq", "<i2"), ("cf32_iq", "<f4")):
        folder = tmp_path / name
        folder.mkdir()
        files = {"a.raw": 5000, "b.raw": 1, "c.raw": 0, "_d": 3}
        values = {f: (rng.normal(size=2 * n) if kind == "<f4" else rng.integers(-100, 100, 2 * n)).astype(kind) for f, n in files.items()}
        for f, v in values.items():
            (folder / f).write_bytes(v.tobytes())
        frame = spark.read.format("iq_recording").option("format", name).option("samples", 700).load(str(folder))
        assert frame.rdd.getNumPartitions() == 9
        _, middle, scale = recordings.FORMATS[name]
        got = {(r.file, r.sample): (r.i, r.q) for r in frame.collect()}
        assert got == {(f, k): tuple(((values[f][2 * k : 2 * k + 2].astype(np.float32) - np.float32(middle)) / np.float32(scale)).tolist()) for f, n in files.items() if f != "_d" for k in range(n)}
    (tmp_path / "bad").write_bytes(b"abc")
    with pytest.raises(Exception, match="must pair"):
        spark.read.format("iq_recording").load(str(tmp_path / "bad")).count()


def test_live_segments(spark, tmp_path):
    """Rows out of order, in many micro-batches, with a restart between, give the segments of the table."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows, place = [], 0
    for key in (1, 2, 3):
        at = start
        for _ in range(60):
            at += timedelta(seconds=rng.randint(0, 20))
            rows.append((key, at, place, rng.choice(["x", "x", "x", "y", None])))
            place += 1
    table = spark.createDataFrame(rows, "k int, ts timestamp, place long, v string")
    marked = segments.runs(table, ["k"], ["ts", "place"], "v", 4)
    want = {tuple(r) for r in marked.groupBy("k", "segment", "v").agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")).collect()}
    came = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randint(0, 25)))
    end = [(9, start + timedelta(days=2), 10_000, "z"), (9, start + timedelta(days=4), 10_001, "z")]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    live_segments.use_rocksdb(spark)
    try:
        for number, part in enumerate((came[:100], came[100:], end[:1], end[1:])):
            spark.createDataFrame(part, table.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if number in (0, 3):
                stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
                out = live_segments.segmented(stream, "k", "ts", "place", "v", 4, "1 minute", "1 day")
                assert out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "progress")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(150)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("k != 9").select("k", "segment", "value", "rows", "first_ts", "last_ts").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_records_as_files(spark, tmp_path):
    rows = spark.createDataFrame([("d1", 2, 'x,"y"\n', None), ("d1", 1, "a|b", 1), ("d2", 1, None, 2)], "doc string, n int, text string, value int")
    one = lambda kind: {r.doc: r.text for r in written.texts(rows, "doc", "n", ["text", "value"], format=kind).collect()}
    assert one("csv") == {"d1": 'text,value\na|b,1\n"x,""y""\n",\n', "d2": "text,value\n,2\n"}
    assert [json.loads(v) for v in one("JSON").values()] == [[{"text": "a|b", "value": 1}, {"text": 'x,"y"\n', "value": None}], [{"text": None, "value": 2}]]
    assert one("markdown")["d1"] == '| text | value |\n| --- | --- |\n| a\\|b | 1 |\n| x,"y"<br> |  |\n' and one("TXT")["d2"] == "text: \nvalue: 2\n" and one("LOG")["d2"] == "text= value=2\n"
    assert one("XML")["d2"] == "<records><record><value>2</value></record></records>"
    with pytest.raises(ValueError, match="unknown record format"):
        written.texts(rows, "doc", "n", ["text"], format="yaml")
    found = written.written(rows, f"file://{tmp_path}/out", "doc", "n", ["value"], slot=F.when(F.col("n") == 2, "quality")).collect()
    assert sorted(r.name for r in found) == ["d1-quality.json", "d1.json", "d2.json"]


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.file_subject(F.lit("RE: Fwd: aw [2]: Café – [sec = OFFICIAL] naïve/plan?"))) == "Cafe-naive-plan" and one(X.file_subject(F.lit(None).cast("string"))) == ""
    assert [one(X.file_type_of_name(F.lit(n))) for n in ("a.PDF", "s3://b/c.d/e", "x.tar.json?y=.pdf", "f.nt#z", ".csv", "")] == ["PDF", "UNKNOWN", "JSON", "GRAPH", "CSV", "UNKNOWN"]
    assert one(X.accepts(F.lit(".JPG"), "JPEG")) and not one(X.accepts(F.lit(".jpg"), "PDF")) and one(X.accepts(F.lit(".ttl"))) and not one(X.accepts(F.lit(None).cast("string")))
    assert str(one(mail.in_zone(mail.moment(F.lit("Mon, 15 Jul 2024 12:00:00 +0100")), "America/New_York"))) == "2024-07-15 07:00:00"
    assert str(one(mail.in_zone(mail.moment(F.lit("Mon, 15 Jul 2024 12:00:00 -0000")), "Asia/Tokyo", assume="Asia/Tokyo"))) == "2024-07-15 12:00:00" and one(mail.in_zone(mail.moment(F.lit("x")), "UTC")) is None


def test_sketches(spark):
    rows = spark.range(60_000).selectExpr("id % 3 AS k", "id % 20011 AS v", "id % 7 AS part").unionByName(spark.createDataFrame([(9, None, 0), (None, 5, 0), (None, 6, 1)], "k long, v long, part long"))
    whole = {r.k: r.sketch for r in sketches.kmv(rows, ["k"], "v", 512).collect()}
    parts = sketches.merged(sketches.kmv(rows, ["k", "part"], "v", 512).drop("part"), ["k"], 512)
    assert {r.k: r.sketch for r in parts.collect()} == whole
    got = {r.k: r.n for r in parts.select("k", sketches.distinct(F.col("sketch"), 512).alias("n")).collect()}
    exact = {r.k: r.n for r in rows.groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}
    assert got[9] == 0 and got[None] == 2 and all(abs(got[k] - exact[k]) < 0.15 * exact[k] for k in (0, 1, 2))


def test_short_recordings_share_tasks():
    """Very many short files make few tasks, and each sample is in one of them."""
    runs = [(f"f{i}", 0, n) for i, n in enumerate([1024, 0, 1, 299, 300, 301] * 6000)]
    tasks = recordings.dealt(runs, 300)
    assert len(tasks) <= recordings.TASKS
    seen = {}
    for file, first, count in (r for t in tasks for r in t.runs):
        assert first == seen.get(file, 0) and count > 0
        seen[file] = first + count
    assert seen == {f: n for f, _, n in runs if n}
    assert [t.runs for t in recordings.dealt([("a", 0, 700), ("b", 0, 0), ("c", 0, 300)], 300)] == [[("a", 0, 300)], [("a", 300, 300)], [("a", 600, 100)], [("c", 0, 300)]]
    assert len(recordings.dealt([("a", 0, 300 * recordings.SAMPLES)], recordings.SAMPLES)) == 300


def test_live_segments_hold_batches_not_rows():
    """State has one entry for each batch of a key's rows, not one for each row, and is read again in order."""
    pd = pytest.importorskip("pandas")

    class State(list):
        appendValue, put, get = list.append, lambda self, rows: self.extend(rows), lambda self: iter(self)
        exists, update = lambda self: bool(self), lambda self, row: self.__setitem__(slice(None), [row])

    class Handle:
        timers = []
        getListState = getValueState = lambda self, name, schema: State()
        registerTimer = timers.append

    class Watermark:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    made = live_segments._Segments("k", 10, 10**12)
    made.init(Handle())
    made.open.get = lambda: made.open[0]
    frames = [pd.DataFrame({"us": range(at, at + 500), "place": range(500), "value": ["a", None, "é\"", "b", "b"] * 100}) for at in (500_000, 0)]
    list(made.handleInputRows(("x",), iter(frames), None))
    assert len(made.waiting) == 2
    first = [f for f in made.handleExpiredTimer(("x",), Watermark(400), None) if len(f)][0]
    assert len(made.waiting) == 1 and list(first["value"][:4]) == ["a", None, 'é"', "b"] and first["rows"].sum() == 498
    second = [f for f in made.handleExpiredTimer(("x",), Watermark(10_000), None) if len(f)][0]
    assert not made.waiting and list(second["segment"]) == list(range(len(first) + 1, len(first) + len(second) + 1)) and second["rows"].sum() == 500

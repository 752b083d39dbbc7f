"""Mail, markup, repair, samples, files and gates: hand cases and plain versions."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cairn.functions import mail, markup, repair, signal
from cairn.functions import text as X
from cairn.operators import compliance, documents, metrics
from cairn.sources import files
from cairn.sources.catalog import Catalog, NotAllowed, is_plain_query

MESSAGE = b"""Received: from b.example ([IPv6:2001:db8::1]) by c.example with ESMTPS id 1; Tue, 03 Sep 2024 10:00:05 -0700 (PDT)\r
Received: from a.example (a.example [10.0.0.1]) by b.example with ESMTP; Tue, 3 Sep 2024 16:59:60 +0000\r
From: =?utf-8?q?J=C3=B6rg?= <J.Org@Example.COM>\r
To: A <a@x.org>, b@y.org, a@X.ORG\r
Cc: c@z.org\r
Subject: Hello =?utf-8?b?w6k=?=\r
Date: Tue, 3 Sep 2024 16:59:00 -0000\r
Message-ID: <1@x>\r
MIME-Version: 1.0\r
Content-Type: multipart/mixed; boundary=B\r
\r
--B\r
Content-Type: text/html; charset=utf-8\r
\r
<p>Hi&nbsp;there</p><script>x</script>\r
--B\r
Content-Type: application/octet-stream\r
Content-Disposition: attachment; filename="f.png"\r
\r
DATA\r
--B\r
Content-Type: image/gif\r
Content-ID: <pic>\r
\r
GIF\r
--B--\r
"""


def test_mail(spark):
    rows = spark.createDataFrame([(1, MESSAGE), (2, None), (3, b"junk"), (4, b"From: Only A Name\r\n\r\nx")], "id int, content binary")
    found = mail.parsed(rows)
    got = {r.id: r for r in found.withColumns({"identity": mail.identity(), "digest": mail.digest(), "shown": mail.rendered()}).collect()}
    one = got[1]
    assert [(a.local, a.domain) for a in one.everyone] == [("a", "x.org"), ("b", "y.org"), ("c", "z.org")]
    assert (one.originator.name, one.subject, one.body) == ("Jörg", "Hello é", "Hi there")
    assert one.sent.utc is None and str(one.sent.utc_assumed) == "2024-09-03 16:59:00" and one.sent.zone_source == "unknown"
    assert [(h.from_host, h.from_ip, h.by_host, h.protocol) for h in one.hops] == [("a.example", "10.0.0.1", "b.example", "ESMTP"), ("b.example", "2001:db8::1", "c.example", "ESMTPS")]
    assert one.hops[0].moment.leap_second and str(one.hops[0].moment.utc) == "2024-09-03 16:59:59" and str(one.received.utc) == "2024-09-03 17:00:05"
    assert one.servers == ["a.example", "b.example", "c.example"] and one.ip_addresses == ["10.0.0.1", "2001:db8::1"] and one.origin_ip == "10.0.0.1"
    assert one.identity == "<1@x>\n2024-09-03T16:59:00+00:00\nJ.Org@example.com\na@x.org,b@y.org,c@z.org\nHello é"
    assert one.shown.endswith("Attachments: f.png, attachment-2\n\nHi there") and "Bcc" not in one.shown
    assert got[2].attachments == [] and got[2].sent.value is None and got[3].body == "junk" and got[4].originator.name == "Only A Name"
    children = mail.attachment_children(found, "id").collect()
    assert [(c["index"], c["name"], c.rejected) for c in children] == [(1, "f.png", None), (2, "attachment-2", "content id")]
    assert children[0].content_digest == "sha256:" + hashlib.sha256(b"DATA").hexdigest()
    small = mail.attachment_children(found, "id", skip_inline=False, skip_types=("image/*",), skip_below=4).collect()
    assert [c.rejected for c in small] == [None, "image/gif below 4 bytes"]
    again = spark.createDataFrame([(5, MESSAGE.replace(b"Received: from b", b"Received: from q"))], "id int, content binary")
    assert mail.parsed(again).select(mail.digest().alias("d")).first().d == one.digest


def test_moments(spark):
    texts = ["4 September 2026 at 3:05 PM", "September 4, 2026 12:05 am", "2026-01-02T03:04:05+02:00", "01 Jan 70 00:00 EST", "garbage", "32 Jan 2020 00:00:00 +0000", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(mail.printed(F.col("t")).alias("p"), mail.moment(F.col("t")).alias("m"))
    got = rows.collect()
    assert [str(r.p) if r.p else None for r in got] == ["2026-09-04 15:05:00", "2026-09-04 00:05:00", None, None, None, None, None]
    assert [str(r.m.utc) if r.m.utc else None for r in got] == [None, None, "2026-01-02 01:04:05", "1970-01-01 05:00:00", None, None, None]


def test_markup(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"`{k}` string" for k in v)).select(c.alias("r")).first().r
    xml = "<a xmlns:n='urn:x'><n:r k='1'> t <b/><c>x</c><c>y</c><d e='2'><f>z</f></d></n:r><r>only</r></a>"
    assert one(markup.xml_records(F.col("t"), "r"), t=xml) == [{"r": "t", "k": "1", "b": "", "c": "x; y", "d.e": "2", "d.f": "z"}, {"r": "only"}]
    assert len(one(markup.xml_records(F.col("t")), t=xml)) == 2
    assert one(markup.xml_records(F.col("t")), t="<broken") is None and one(markup.xml_records(F.col("t")), t=None) is None
    assert one(markup.xml_of(["t", "x.y"]), t="<&>", **{"x.y": None}) == "<record><t>&lt;&amp;&gt;</t></record>"
    rdf = "<rdf:RDF xmlns:rdf='r' xmlns:dc='d' xmlns='p'><channel><title>T</title></channel><item><title>I</title><dc:date>2024-01-02T00:00:00+00:00</dc:date></item></rdf:RDF>"
    feed = one(markup.rss_feed(F.col("t")), t=rdf)
    assert feed.channel == {"title": "T"} and feed["items"] == [{"title": "I", "pubDate": "2024-01-02T00:00:00+00:00"}]
    assert one(markup.rss_feed(F.col("t")), t="<html/>").channel is None
    assert one(markup.iso_date(F.col("t")), t="Tue, 02 Jan 2024 03:04:05 -0330") == "2024-01-02T03:04:05-03:30" and one(markup.iso_date(F.col("t")), t="soon") == "soon"
    assert one(markup.rfc822_date(F.col("t")), t="2024-01-02T03:04:05+01:00") == "Tue, 02 Jan 2024 03:04:05 +0100"


def test_repair(spark):
    lexicon = spark.createDataFrame([("introduce", 4.0), ("in", 7.0), ("to", 7.0), ("the", 8.0), ("word", 5.0), ("wor", 1.0), ("cat", 4.0), ("a", 8.0)], "word string, zipf double")
    rows = [(1, "int", "oduce", "r", " "), (2, "in", "the", "r", " "), (3, "wor", "the", "d", " "), (4, "WOR", "", "d", ""), (5, "zz", "qq", "", "")]
    got = {r.id: r.repaired for r in repair.closed(spark.createDataFrame(rows, "id int, left string, right string, restore string, spacing string"), lexicon).collect()}
    assert got == {1: "introduce", 2: None, 3: "word the", 4: "WORD", 5: None}
    tokens = spark.createDataFrame([("inthecat",), ("TheCat",), ("xyzzyq",), (None,), ("",)], "token string")
    assert {r.token: r.pieces for r in repair.segmented(tokens, lexicon).collect()} == {"inthecat": ["in", "the", "cat"], "TheCat": ["The", "Cat"], "xyzzyq": ["xyzzyq"], "": []}
    texts = spark.createDataFrame([("int|oduce the cat\nTo: x|y mail|to",), (None,), ("",)], "t string")
    found = repair.repaired(texts, "t", (repair.Confusion("|", "r", protect=(r"mail\|to",)),), lexicon, headers=("To: x|y",)).collect()
    assert [tuple(r)[1:] for r in found] == [("introduce the cat\nTo: x|y mail|to", 1, 1), (None, 0, 0), ("", 0, 0)]
    assert spark.range(1).select(X.stripped(repair.unstuck(F.lit("see inthecat, inthecats"), {"inthecat": ["in", "the", "cat"]})).alias("x")).first().x == "see in the cat, inthecats"


def test_samples(spark):
    blocks = spark.createDataFrame([(1, bytes([0, 255, 255, 0])), (2, b""), (3, None)], "b int, p binary")
    assert [(r.b, r.n, r.i, r.q) for r in signal.samples(blocks, "p", "u8_iq").collect()] == [(1, 0, -1.0, 1.0), (1, 1, 1.0, -1.0)]
    with pytest.raises(Exception, match="must pair"):
        signal.samples(spark.createDataFrame([(1, b"abc")], "b int, p binary"), "p", "u8_iq").collect()


def test_files(spark, tmp_path):
    docs = spark.createDataFrame([("a/b", "x"), ("c", "two\n"), ("c", "three"), (None, "q"), ("d", None)], "n string, t string")
    manifest = files.write_each(docs, f"file://{tmp_path}/out", "n", "t")
    assert {(r.name, r.size) for r in manifest.collect()} == {("a_b", 1), ("c", 5)}
    assert {(r.name, bytes(r.content)) for r in files.read_each(spark, f"file://{tmp_path}/out").collect()} == {("a_b", b"x"), ("c", b"three")}


def test_spread_files(spark, tmp_path):
    """Files spread over folders come back whole, also by a pattern, without those that a broken task left; many names, one listing each."""
    docs = spark.range(3000).select(F.concat(F.lit("f-"), "id", F.when(F.col("id") % 2 == 0, ".json").otherwise(".txt")).alias("n"), F.repeat(F.lit("é"), (F.col("id") % 5).cast("int")).alias("t"))
    folder = f"file://{tmp_path}/out"
    manifest = {(r.name, r.path, r.size, r.sha256) for r in files.write_each(docs, folder, "n", "t", spread=True).collect()}
    (tmp_path / "out" / sorted(p.name for p in (tmp_path / "out").iterdir())[0] / ".f-1.txt.7").write_bytes(b"half")
    got = files.read_spread(spark, folder)
    assert {(r.name, r.path, r.size, r.sha) for r in got.withColumn("sha", F.sha2("content", 256)).collect()} == manifest and len(manifest) == 3000
    assert files.read_spread(spark, folder, "*.json").count() == 1500 and got.where("modified IS NULL OR path NOT LIKE 'file://%'").count() == 0
    assert len(list((tmp_path / "out").iterdir())) > 500 and max(len(list(p.iterdir())) for p in (tmp_path / "out").iterdir()) < 30


def test_plain_queries(spark, tmp_path):
    good = ["select 1", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "select ';' AS s", "select 'insert into' AS s -- delete", "VALUES (1)"]
    bad = ["WITH c AS (SELECT 1) INSERT OVERWRITE DIRECTORY '/x' SELECT * FROM c", "with a as (select 1) delete from t", "select 1; select 2", "insert into t values (1)", "drop table t", "set a=b", "WITH c AS (SELECT 1) /* x */ MERGE INTO t USING c ON true WHEN MATCHED THEN DELETE"]
    # comments that end at a carriage return, raw strings, nested comments, commands that are explained, scripts
    good += ["WITH a AS (SELECT 1 AS x) --\rSELECT x FROM a", r"SELECT r'\' AS x", "/* a /* b */ c */ TABLE t", "SHOW TABLES", "DESCRIBE TABLE t", "EXPLAIN SELECT 1", "explain extended with a as (select 1) select * from a"]
    bad += ["WITH a AS (SELECT 1 AS x) --\rINSERT INTO t SELECT x FROM a", r"WITH a AS (SELECT r'\' AS x) INSERT INTO t SELECT x FROM a WHERE x <> ')'", "/* a /* b */ */ DROP TABLE t", "EXPLAIN INSERT INTO t VALUES (1)"]
    bad += ["FROM a INSERT INTO t SELECT x INSERT INTO u SELECT x", "BEGIN SELECT 1; DROP TABLE t; END", "CREATE TABLE t AS SELECT 1", "select (1", "", "CACHE TABLE t", "ADD JAR 'x'", "UPDATE t SET a = 1"]
    assert [q for q in good if not is_plain_query(spark, q)] == [] and [q for q in bad if is_plain_query(spark, q)] == []
    cat = Catalog(spark, allow_raw_sql=True)
    assert cat.read("sql: select ';' AS s").first().s == ";"
    with pytest.raises(NotAllowed):
        cat.read(f"WITH c AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '{tmp_path}/x' USING parquet SELECT * FROM c")


def packed(text, most):
    """A plain version of the chunks."""
    if text is None or len(text) <= most:
        return None if text is None else [text]
    out, now, size = [], [], 0
    for s in re.split(X.SENTENCE_END, text):
        if not s.strip():
            continue
        if now and size + len(s) + 1 > most:
            out.append(" ".join(now))
            now, size = [s], len(s)
        else:
            now.append(s)
            size += len(s) + 1
    return out + ([" ".join(now)] if now else [])


def test_chunks(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["One.\n\nTwo.  Three", None, "", "x" * 900, ". " * 300]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.sentence_chunks(F.col("t"), 400).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: packed(t, 400) for i, t in enumerate(texts)}


def test_annotations(spark):
    names, mails = F.array(F.lit("Mary Jones")), F.array(F.lit("john.smith@acme.test"))
    docs = spark.createDataFrame([("d", "Dear Mary, write to John.Smith@acme.test or Smith, Ref: AB-1234"), ("e", None)], "doc_id string, text string").withColumn("terms", X.envelope_terms(mails, names))
    with pytest.warns(UserWarning):
        got = {r.doc_id: r.annotations for r in X.annotated(docs, [*X.PII, ("BAD", "(", 0)], "terms", (("WORD", "write"),)).collect()}
    assert [(a.text, a.label, a.source, a.priority) for a in got["d"]] == [
        ("Mary", "PERSON", "envelope", 40), ("write", "WORD", "entity", 10), ("John.Smith@acme.test", "EMAIL", "envelope", 40), ("Smith", "PERSON", "envelope", 40), ("AB-1234", "CASE_REFERENCE", "catalogue", 20),
    ]
    assert got["e"] == []


def test_small_mends(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    assert one(X.slug(F.lit("Őrült łódź ﬁn"), 60)) == "orult-odz-fin"
    assert one(metrics.escaped(F.lit('a"b\\c\nd'))) == 'a\\"b\\\\c\\nd'
    assert one(documents.distinct_union(F.array(F.lit("b"), F.lit("A")), F.array(F.lit("a"), F.lit("c")), key=F.lower)) == ["b", "A", "c"]
    assert [one(X.file_type_of_text(F.lit(t))) for t in ("a,b\n1,2\n3,4,", "a|b\n1|2", "a,b\n1,2,3\n1,2,3,4")] == ["CSV", "TXT", "TXT"]
    assert one(X.archive_name(F.lit("RES"), F.lit(" \n"), F.lit(3), stem=F.lit("s"))) == "SCAN-s-3pp"
    assert one(X.archive_name(F.lit("RES"), F.lit("Page 1 of 2\nThe Annual Report\n2019"), F.lit(3))) == "RES-2019-the-annual-report-3pp"
    assert one(compliance.catalogue(F.lit("[]"))) is None
    assert one(X.triples_of(F.lit('<a> <b> "x \\" y"@en . # note'))).object == '"x \\" y"@en' and one(X.triples_of(F.lit("# c"))) is None


def test_messages_are_read_in_slices():
    """A batch of messages is read a few at a time: by number, and by bytes."""
    import pandas as pd

    batch = pd.Series([b"Subject: %d\r\n\r\nx" % i for i in range(300)] + [None] + [b"Subject: b\r\n\r\n" + b"y" * (3 << 20)] * 2)
    made = list(mail._messages(iter([batch, batch[:0]])))
    assert [len(m) for m in made] == [128, 128, 45, 1, 1]
    assert [h.get("subject", [None])[0] for m in made for h in m["headers"]] == [*map(str, range(300)), None, "b", "b"]

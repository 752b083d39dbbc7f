"""Queries over phrases, trees, logs of triples, printed layouts, nested schemas, tokens, stores, recordings and live segments, and the
same in SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from cairn.functions import fernet, layouts, mail, schemas
from cairn.functions import text as X
from cairn.operators import phrases, running, sketches, trees, triples, written
from cairn.operators.store import Results
from cairn.plans.queries import query, t
from cairn.session import work_dir
from cairn.sources import files, recordings
from cairn.streaming import live_segments

# phrases in sequences of tokens: twelve words to a line, each in a box


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT doc_id, 1 AS size, w[1] AS text, lower(w[1]) AS a, '' AS b FROM w WHERE len(w) > 0 UNION ALL SELECT doc_id, 2, w[2] || ' ' || w[3], lower(w[2]), lower(w[3]) FROM w WHERE len(w) > 2),
m AS (SELECT k.doc_id, size, text, i FROM k JOIN g USING (doc_id) WHERE contains(lower(w[i]), a) AND (size = 1 OR (i < len(w) AND contains(lower(w[i + 1]), b)))),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, size ORDER BY i) AS run FROM m),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, run ORDER BY i) AS n FROM r)
SELECT doc_id, text, (i - 1)::INTEGER AS first, (i + size - 2)::INTEGER AS last, list_min([((i - 1 + j) % 12) * 10 FOR j IN range(size)])::DOUBLE AS x0, ((i - 1) // 12 * 12)::DOUBLE AS y0,
(list_max([((i - 1 + j) % 12) * 10 FOR j IN range(size)]) + 9)::DOUBLE AS x1, ((i + size - 2) // 12 * 12 + 10)::DOUBLE AS y1 FROM c WHERE size = 1 OR n % 2 = 1""")
def phrase_boxes(spark, sf):
    """Each text's first word, and its second and third as one phrase, wherever they stand in it."""
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    box = lambda w, i: F.struct(w.alias("text"), (i % 12 * 10).alias("x0"), (F.floor(i / 12) * 12).alias("y0"), (i % 12 * 10 + 9).alias("x1"), (F.floor(i / 12) * 12 + 10).alias("y1"))
    docs = t(spark, sf, "documents").select("doc_id", words.alias("w")).select("doc_id", "w", F.transform("w", box).alias("tokens"))
    target = lambda c: F.struct(c.alias("text"), F.lit("[*]").alias("replacement"))
    goals = F.array_compact(F.array(F.when(F.size("w") > 0, target(F.get("w", F.lit(0)))), F.when(F.size("w") > 2, target(F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2)))))))
    found = phrases.located(docs.select("doc_id", "tokens", goals.alias("goals")), "tokens", "goals")
    return found.select("doc_id", F.explode("redact_spans").alias("s")).select("doc_id", "s.text", "s.first", "s.last", "s.x0", "s.y0", "s.x1", "s.y1")


# a tree of five levels: region, nation, segment of a nation, customer, order

_NODES = """(SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT DISTINCT 's' || c_nationkey || c_mktsegment, 'n' || c_nationkey FROM customer UNION ALL SELECT 'c' || c_custkey, 's' || c_nationkey || c_mktsegment FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""
_CHOSEN = "(SELECT 'o' || o_orderkey AS id FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0)"


@query(f"""WITH RECURSIVE n AS {_NODES}, s AS {_CHOSEN},
up AS (SELECT n.id AS start, n.id, n.parent FROM n JOIN s USING (id) UNION ALL SELECT up.start, n.id, n.parent FROM up JOIN n ON up.parent = n.id)
SELECT id, bool_or(start = id) AS chosen, count(*) FILTER (WHERE start <> id) AS below FROM up GROUP BY id""")
def tree_pruned(spark, sf):
    """What is left of the tree when dear orders and some nations are selected, and how many of them each node holds."""
    region, nation, customer, orders = (t(spark, sf, n) for n in ("region", "nation", "customer", "orders"))
    id_of = lambda letter, *c: F.concat(F.lit(letter), *c)
    segment = id_of("s", F.col("c_nationkey"), F.col("c_mktsegment"))
    levels = [
        region.select(id_of("r", F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent")),
        nation.select(id_of("n", F.col("n_nationkey")), id_of("r", F.col("n_regionkey"))),
        customer.select(segment, id_of("n", F.col("c_nationkey"))).distinct(),
        customer.select(id_of("c", F.col("c_custkey")), segment),
        orders.select(id_of("o", F.col("o_orderkey")), id_of("c", F.col("o_custkey"))),
    ]
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.union(level)
    dear = orders.where("o_totalprice > 400000").select(id_of("O", F.col("o_orderkey")).alias("id"))
    return trees.pruned(nodes, dear.union(nation.where("n_nationkey % 5 = 0").select(id_of("n", F.col("n_nationkey"))))).select("id", "chosen", "below")


# aggregates that merge


@query("""SELECT l_returnflag, dimension, count(v) AS count, round(avg(v), 4) AS mean, round(min(v), 4) AS minimum, round(max(v), 4) AS maximum, round(var_samp(v), 4) AS variance, round(stddev_samp(v), 4) AS stdev
FROM (SELECT l_returnflag, unnest(['l_quantity', 'l_discount']) AS dimension, unnest([l_quantity, l_discount])::DOUBLE AS v FROM lineitem) GROUP BY ALL""")
def running_merged(spark, sf):
    """Sixteen parts of the rows, each aggregated on its own, then merged."""
    parts = running.partial(t(spark, sf, "lineitem").withColumn("part", F.pmod(F.xxhash64("l_orderkey"), F.lit(16))), ["l_returnflag", "part"], ["l_quantity", "l_discount"]).drop("part")
    return running.snapshot(running.merged(parts, ["l_returnflag"]), ["l_returnflag"])


# triples as a log of changes: each user's events


@query("""WITH e AS (SELECT user_id, event_id, CASE event_id % 7 WHEN 0 THEN 'remove' WHEN 1 THEN 'update' WHEN 2 THEN CASE WHEN event_id % 5 = 0 THEN 'clear' ELSE 'add' END ELSE 'add' END AS op,
'urn:p' || event_id % 3 AS p, event_type AS o FROM events),
a AS (SELECT user_id, p, o, max(event_id) AS since FROM e WHERE op IN ('add', 'update') GROUP BY ALL),
g AS (SELECT a.user_id, a.p, a.o, a.since, max(e.event_id) AS gone FROM a LEFT JOIN e ON e.user_id = a.user_id AND (e.op = 'clear' OR (e.op = 'remove' AND e.p = a.p AND (e.o = a.o OR e.event_id % 2 = 0)) OR (e.op = 'update' AND e.p = a.p)) GROUP BY ALL)
SELECT user_id AS doc, p AS predicate, o AS object, since FROM g WHERE gone IS NULL OR gone <= since""")
def triples_current(spark, sf):
    n = F.col("event_id")
    op = F.when(n % 7 == 0, "remove").when(n % 7 == 1, "update").when((n % 7 == 2) & (n % 5 == 0), "clear").otherwise("add")
    some = t(spark, sf, "events").select(F.col("user_id").alias("doc"), n.alias("seq"), op.alias("op"), F.lit("urn:s").alias("subject"), F.concat(F.lit("urn:p"), n % 3).alias("predicate"), F.when(~((op == "remove") & (n % 2 == 0)), F.col("event_type")).alias("object"), F.lit(None).cast("string").alias("kind"))
    return triples.current(some).select("doc", "predicate", "object", F.col("since").alias("since"))


# printed mail in four layouts


@query("""SELECT conv_id, turn, ['outlook-print', 'apple-mail-print', 'rfc-header-block', 'webmail-print'][turn % 5 + 1] AS layout, CASE WHEN turn % 5 < 2 THEN 'Talk ' || conv_id || CASE WHEN turn % 5 = 0 THEN ' again' ELSE '' END END AS subject,
CASE WHEN turn % 5 < 3 THEN '2026-09-04 15:' || lpad((turn % 60)::VARCHAR, 2, '0') || ':00' END AS sent, CASE turn % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS addresses FROM conversations WHERE turn % 5 < 4""")
def mail_layouts(spark, sf):
    """Each turn as a printed page: three layouts with folded lines, a web page, and mail that is only quoted, which is none."""
    minute = F.lpad((F.col("turn") % 60).cast("string"), 2, "0")
    a = F.concat(F.lit("From: Someone <"), "role", F.lit("@example.org>\n"))
    subject = F.concat(F.lit("Subject: Talk "), "conv_id")
    pages = [
        F.concat(a, subject, F.lit("\n   again\nSent: Friday, September 4, 2026 3:"), minute, F.lit(" PM\nTo: a@x.org\n\n")),
        F.concat(F.lit("Inbox\n"), a, subject, F.lit("\nDate: 4 September 2026 at 3:"), minute, F.lit(":00 PM\nTo: a@x.org\n\n")),
        F.concat(F.lit("to: "), "role", F.lit("@example.org\nFROM: "), "role", F.lit("@example.org\nDate: Fri, 04 Sep 2026 15:"), minute, F.lit(":00 +0200\n\n")),
        F.lit("printed from https://mail.google.com/mail/u/0\n"),
        F.concat(F.lit("one\ntwo\nthree\n> "), a, F.lit("> "), subject, F.lit("\n")),
    ]
    page = F.element_at(F.array(*pages), (F.col("turn") % 5 + 1).cast("int"))
    found = t(spark, sf, "conversations").select("conv_id", "turn", layouts.header_block(F.concat(page, F.lit("--\nx\ny\n"))).alias("b")).where("b IS NOT NULL")
    return found.select("conv_id", "turn", "b.layout", layouts.shown(F.col("b"), "Subject").alias("subject"), F.date_format(layouts.sent(F.col("b")), "yyyy-MM-dd HH:mm:ss").alias("sent"), "b.addresses")


# nested schemas: customers with their orders as JSON

_SCHEMA = {
    "type": "object",
    "required": ["name", "orders"],
    "properties": {
        "name": {"type": "string", "pattern": "[02468]$"},
        "balance": {"minimum": 0},
        "orders": {"minItems": 1, "items": {"$ref": "#/$defs/order"}},
    },
    "$defs": {"order": {"required": ["status"], "properties": {"status": {"enum": ["F", "O"]}, "price": {"maximum": 300000}}}},
}


@query("""WITH o AS (SELECT o_custkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT c_custkey, '$.name' AS path, 'pattern' AS keyword FROM customer WHERE NOT regexp_matches(c_name, '[02468]$') UNION ALL
SELECT c_custkey, '$.balance', 'minimum' FROM customer WHERE c_acctbal < 0 UNION ALL
SELECT c_custkey, '$.orders', 'minItems' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
SELECT o_custkey, '$.orders[' || i || '].status', 'enum' FROM o WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL
SELECT o_custkey, '$.orders[' || i || '].price', 'maximum' FROM o WHERE o_totalprice > 300000""")
def schema_violations(spark, sf):
    lists = t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")))).alias("o"))
    orders = F.coalesce(F.transform("o", lambda x: F.struct(x["status"].alias("status"), x["price"].alias("price"))), F.array().cast("array<struct<status:string,price:double>>"))
    joined = t(spark, sf, "customer").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    text = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), orders.alias("orders")))
    return joined.select("c_custkey", text.alias("text")).select("c_custkey", F.explode(schemas.violations(F.col("text"), _SCHEMA)).alias("v")).select("c_custkey", "v.path", "v.keyword")


# tokens

_KEY = "cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4="


@query("SELECT doc_id, md5(text) AS text_md5, true AS refused, ((strlen(text) // 16 + 1) * 16 + 57 + 2) // 3 * 4 AS size FROM documents")
def fernet_round_trip(spark, sf):
    """Every text as a token and back; a token whose time was changed does not open. The second key's token shares no bytes, so it is made once."""
    made = t(spark, sf, "documents").select("doc_id", fernet.encrypted(F.col("text"), _KEY).alias("token"))
    changed = F.concat(F.lit("gAAAAAB_"), F.substr("token", F.lit(9)))
    return made.select("doc_id", F.md5(fernet.decrypted(F.col("token"), _KEY)).alias("text_md5"), fernet.decrypted(changed, _KEY).isNull().alias("refused"), F.length("token").cast("long").alias("size"))


# results by digest


@query("""WITH d AS (SELECT sha256(text) AS digest, min(length(text)) AS length, bool_or(doc_id % 2 = 0) AS early FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT digest, CASE WHEN early THEN 1 ELSE 2 END AS run, length FROM d""")
def result_store_runs(spark, sf):
    """Two runs over a growing table: the second works on new texts only."""
    store = Results(spark, f"{work_dir(spark)}/results-{uuid.uuid4().hex}", "digest string, run int, length long")
    docs = t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"), "text")
    for number, rows in ((1, docs.where("doc_id % 2 = 0")), (2, docs)):
        store.run(rows, lambda new, number=number: new.select("digest", F.lit(number).alias("run"), F.length("text").cast("long").alias("length")))
    store.compacted()
    return store.read()


# recordings


@query("""WITH e AS (SELECT event_id // 1024 AS file, event_id, user_id, row_number() OVER (PARTITION BY event_id // 1024 ORDER BY event_id) - 1 AS sample FROM events)
SELECT 'rec-' || file AS file, sample, round((event_id % 256 - 127.5) / 127.5, 4)::DOUBLE AS i, round((user_id % 256 - 127.5) / 127.5, 4)::DOUBLE AS q FROM e""")
def recording_samples(spark, sf):
    """Events as recordings of up to 1,024 samples, written as files of bytes and read by ranges of 300."""
    two = lambda c: F.lpad(F.hex(F.col(c) % 256), 2, "0")
    rows = t(spark, sf, "events").select(F.floor(F.col("event_id") / 1024).alias("file"), F.struct("event_id", F.concat(two("event_id"), two("user_id")).alias("b")).alias("x"))
    # at most 1,024 samples to a file
    whole = rows.groupBy("file").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "")).alias("bytes"))
    folder = f"{work_dir(spark)}/recordings-{uuid.uuid4().hex}"
    files.write_each(whole.select(F.concat(F.lit("rec-"), "file").alias("name"), "bytes"), folder, "name", "bytes").count()
    recordings.register(spark)
    found = spark.read.format("iq_recording").option("format", "u8_iq").option("samples", 300).load(folder)
    return found.select("file", "sample", F.round(F.col("i").cast("double"), 4).alias("i"), F.round(F.col("q").cast("double"), 4).alias("q"))


# segments on a stream


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) // 3 AS part FROM r)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY min(ts), min(event_id)) AS segment, event_type AS value, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY user_id, run, part, event_type""")
def live_segments_of_users(spark, sf):
    """A stream of all events, with a late row of a user of its own that moves the watermark past the end."""
    spark = spark.newSession()
    live_segments.use_rocksdb(spark)
    events = t(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    base = f"{work_dir(spark)}/segments-{uuid.uuid4().hex}"
    end = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), F.expr("ts + INTERVAL 900 DAYS").alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("event_type"))
    end = end.select(*[F.col(f.name).cast(f.dataType) for f in events.schema.fields])
    for rows in (events.repartition(3), end):
        rows.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        out = live_segments.segmented(stream, "user_id", "ts", "event_id", "event_type", 3, "1 hour", "400 days")
        out.writeStream.format("parquet").option("checkpointLocation", f"{base}/progress").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").where("user_id >= 0").withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz")).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


# records and annotations as files

_FIELDS = """SELECT o_custkey, o_orderkey, o_orderstatus AS status, o_orderpriority || ', "' || o_orderstatus || '" | x' AS note, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey::VARCHAR END AS ref FROM orders"""


@query(f"""WITH o AS ({_FIELDS}), k AS (SELECT o_custkey, '' AS slot, o_orderkey, ['CSV', 'JSON', 'MARKDOWN', 'TXT', 'LOG', 'XML'][o_custkey % 6 + 1] AS format, status, note, ref FROM o UNION ALL SELECT o_custkey, 'quality', o_orderkey, 'CSV', status, note, ref FROM o WHERE o_orderkey % 2 = 0),
l AS (SELECT o_custkey, slot, format, o_orderkey, CASE format WHEN 'CSV' THEN status || ',"' || replace(note, '"', '""') || '",' || coalesce(ref, '')
WHEN 'JSON' THEN '{{"status":"' || status || '","note":"' || replace(note, '"', chr(92) || '"') || '","ref":' || coalesce('"' || ref || '"', 'null') || '}}'
WHEN 'MARKDOWN' THEN '| ' || status || ' | ' || replace(note, '|', chr(92) || '|') || ' | ' || coalesce(ref, '') || ' |'
WHEN 'TXT' THEN 'status: ' || status || chr(10) || 'note: ' || note || chr(10) || 'ref: ' || coalesce(ref, '')
WHEN 'LOG' THEN 'status=' || status || ' note=' || note || ' ref=' || coalesce(ref, '')
ELSE '<record><status>' || status || '</status><note>' || note || '</note>' || coalesce('<ref>' || ref || '</ref>', '') || '</record>' END AS line FROM k),
f AS (SELECT o_custkey, slot, format, CASE format WHEN 'JSON' THEN string_agg(line, ',' ORDER BY o_orderkey) WHEN 'XML' THEN string_agg(line, '' ORDER BY o_orderkey) WHEN 'TXT' THEN string_agg(line, chr(10) || chr(10) ORDER BY o_orderkey) ELSE string_agg(line, chr(10) ORDER BY o_orderkey) END AS body FROM l GROUP BY o_custkey, slot, format),
t AS (SELECT o_custkey || CASE WHEN slot = '' THEN '' ELSE '-' || slot END || CASE format WHEN 'MARKDOWN' THEN '.md' ELSE '.' || lower(format) END AS name,
CASE format WHEN 'JSON' THEN '[' || body || ']' WHEN 'XML' THEN '<records>' || body || '</records>' WHEN 'CSV' THEN 'status,note,ref' || chr(10) || body || chr(10) WHEN 'MARKDOWN' THEN '| status | note | ref |' || chr(10) || '| --- | --- | --- |' || chr(10) || body || chr(10) ELSE body || chr(10) END AS text FROM f)
SELECT name, strlen(text) AS size, sha256(text) AS sha256 FROM t""")
def records_written(spark, sf):
    """Each customer's orders as a file in one of six formats, and some of them again as a report in a slot of its own; read back."""
    orders = t(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('" | x')).alias("note"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).alias("ref"),
    )
    kinds = F.element_at(F.array(*[F.lit(f) for f in ("CSV", "JSON", "MARKDOWN", "TXT", "LOG", "XML")]), (F.col("o_custkey") % 6 + 1).cast("int"))
    rows = orders.withColumns({"kind": kinds, "slot": F.lit("")}).unionByName(orders.where("o_orderkey % 2 = 0").withColumns({"kind": F.lit("CSV"), "slot": F.lit("quality")}))
    folder = f"{work_dir(spark)}/records-{uuid.uuid4().hex}"
    written.written(rows, folder, "o_custkey", "o_orderkey", ["status", "note", "ref"], spread=True, format=F.col("kind"), slot=F.col("slot")).count()
    return files.read_spread(spark, folder).select("name", "size", F.sha2("content", 256).alias("sha256"))


@query(r"""WITH s AS (SELECT doc_id, source, text, k, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + list_sum(list_transform([''] || hits[1:k - 1], lambda x: length(x))))::BIGINT AS start, hits[k] AS hit
FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT doc_id, source, text, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS hits, regexp_split_to_array(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS parts FROM documents)))
SELECT doc_id, count(*) AS spans, md5(string_agg(start || ':' || hit, ';' ORDER BY start)) AS spans_md5, any_value(source) AS source, md5(any_value(text)) AS text_md5 FROM s GROUP BY doc_id""")
def annotations_written(spark, sf):
    """Each text with its addresses as a training record in a file of its own, read back as JSON."""
    docs = t(spark, sf, "documents").select("doc_id", "text", "source", F.concat("doc_id", F.lit(".txt")).alias("filename"))
    found = docs.join(X.spans(docs, [X.PII[0]]), "doc_id").where(F.size("annotations") > 0)
    folder = f"{work_dir(spark)}/annotations-{uuid.uuid4().hex}"
    written.annotations(found, folder, meta=("source",), spread=True).count()
    kind = "struct<id:string,filename:string,text:string,spans:array<struct<start:long,end:long,label:string,text:string>>,meta:struct<source:string>>"
    r = files.read_spread(spark, folder, "*.json").select(F.from_json(F.col("content").cast("string"), kind).alias("r"))
    marks = F.array_join(F.transform("r.spans", lambda s: F.concat(s["start"], F.lit(":"), s["text"])), ";")
    return r.select(F.col("r.id").cast("long").alias("doc_id"), F.size("r.spans").cast("long").alias("spans"), F.md5(marks).alias("spans_md5"), "r.meta.source", F.md5("r.text").alias("text_md5"))


# names and clocks


@query(r"""SELECT doc_id, left(trim(regexp_replace(regexp_replace('Re: FW[2]: ' || source || ' [SEC=OFFICIAL] ' || doc_id || '/' || lang, '\[SEC=OFFICIAL\]|^Re: FW\[2\]:', ' ', 'g'), '[^0-9A-Za-z]+', '-', 'g'), '-'), 20) AS subject,
lower(regexp_replace(source || '.Doc', '^[a-zA-Z0-9]+', '')) AS rest, CASE doc_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'CSV' WHEN 2 THEN 'UNKNOWN' ELSE 'JPEG' END AS kind, doc_id % 4 IN (0, 3) AS accepted,
strftime(TIMESTAMP '2024-01-15 23:30:00' + to_minutes((doc_id % 60)::INTEGER) - to_hours(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END) + to_hours(11), '%Y-%m-%d %H:%M') AS sydney FROM documents""")
def names_and_clocks(spark, sf):
    """Subjects as file names, suffixes as types, and times as a clock in Sydney shows them, with and without a zone of their own."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".tsv", "", ".jpeg")]), (F.col("doc_id") % 4 + 1).cast("int"))
    subject = X.file_subject(F.concat(F.lit("Re: FW[2]: "), "source", F.lit(" [SEC=OFFICIAL] "), "doc_id", F.lit("/"), "lang"), 20)
    day = F.concat(F.lit("Mon, 15 Jan 2024 23:30:00"), F.when(F.col("doc_id") % 2 == 0, " +0200").otherwise(" -0000"))
    clock = F.timestamp_add("MINUTE", (F.col("doc_id") % 60).cast("int"), mail.in_zone(mail.moment(day), "Australia/Sydney"))
    kind = X.file_type_of_name(F.concat(F.lit("https://x.org/a.b/"), "doc_id", suffix, F.lit("?q=.doc")))
    return t(spark, sf, "documents").select("doc_id", subject.alias("subject"), X.name_rest(F.concat("source", F.lit(".Doc"))).alias("rest"), kind.alias("kind"), X.accepts(suffix, "PDF", "JPEG").alias("accepted"), F.date_format(clock, "yyyy-MM-dd HH:mm").alias("sydney"))


# sketches


@query("""WITH h AS (SELECT DISTINCT event_type, ('0x' || substr(md5(user_id::VARCHAR), 1, 15))::BIGINT AS h FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h) AS n FROM h)
SELECT event_type, CASE WHEN count(*) < 64 THEN count(*) ELSE round(63 * 1152921504606846976.0::DOUBLE / max(h))::BIGINT END AS about FROM r WHERE n <= 64 GROUP BY event_type""")
def sketch_distinct(spark, sf):
    """The number of users of each event type, estimated from sketches of eight parts that are merged."""
    parts = sketches.kmv(t(spark, sf, "events").withColumn("part", F.col("event_id") % 8), ["event_type", "part"], "user_id", 64)
    return sketches.merged(parts.drop("part"), ["event_type"], 64).select("event_type", sketches.distinct(F.col("sketch"), 64).alias("about"))


# mail with parts

_BLANK_SIGNS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


@query(f"""WITH m AS (SELECT conv_id, turn, role, 'Über ' || conv_id AS subject, trim(coalesce(text, ''), {_BLANK_SIGNS}) AS body FROM conversations),
a AS (SELECT conv_id, turn, subject, md5(CASE WHEN body = '' THEN 'html' ELSE body END) AS body_md5, unnest([
{{'i': 1, 'name': 'täble-' || turn || '.csv', 'kind': 'text/csv', 'data': 'a,b' || chr(13) || chr(10) || '1,' || turn, 'why': NULL}},
{{'i': 2, 'name': 'pic.png', 'kind': 'application/octet-stream', 'data': role, 'why': CASE WHEN length(role) < 6 THEN 'image/png below 6 bytes' END}},
{{'i': 3, 'name': 'Inner a b ' || conv_id || '.eml', 'kind': 'message/rfc822', 'data': 'Subject: Inner: a/b ' || conv_id || chr(13) || chr(10) || chr(13) || chr(10) || 'inner', 'why': NULL}},
{{'i': 4, 'name': 'attachment-4', 'kind': 'image/gif', 'data': 'GIF89a', 'why': 'inline'}}]) AS x FROM m)
SELECT conv_id, turn, subject, 'Jörg' AS author, 'Doe, Jane <jane@x.org>; <b@y.org>' AS "to", body_md5, x.i AS index, x.name AS name, x.kind AS content_type, strlen(x.data) AS size, 'sha256:' || sha256(x.data) AS content_digest, x.why AS rejected, turn % 3 = 0 AS broken FROM a""")
def mail_parts(spark, sf):
    """Each turn as a message of nested parts: encoded words, alternatives, a quoted name, attachments with encoded and missing names, an
    embedded message, a picture shown in the text, and every third time a part that cannot be decoded."""
    b64 = lambda c: F.base64(F.encode(c, "utf-8"))
    lines = [
        F.concat(F.lit("From: =?utf-8?q?J=C3=B6rg?= <"), "role", F.lit("@Example.ORG>")), F.lit('To: "Doe, Jane" <jane@x.org>, b@y.org'),
        F.concat(F.lit("Subject: =?utf-8?b?"), b64(F.concat(F.lit("Über "), "conv_id")), F.lit("?=")), F.lit("MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=OUT\r\n\r\npreamble"),
        F.lit("--OUT\r\nContent-Type: multipart/alternative; boundary=IN\r\n\r\n--IN\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n"), b64(F.coalesce("text", F.lit(""))),
        F.lit("--IN\r\nContent-Type: text/html\r\n\r\n<p>html</p>\r\n--IN--"),
        F.concat(F.lit("--OUT\r\nContent-Type: text/csv; charset=utf-8\r\nContent-Disposition: attachment; filename*=utf-8''t%C3%A4ble-"), "turn", F.lit(".csv\r\n\r\na,b\r\n1,"), "turn"),
        F.lit('--OUT\r\nContent-Type: application/octet-stream; name="pic.png"\r\nContent-Transfer-Encoding: base64\r\n'), b64(F.col("role")),
        F.concat(F.lit("--OUT\r\nContent-Type: message/rfc822\r\n\r\nSubject: Inner: a/b "), "conv_id", F.lit("\r\n\r\ninner")),
        F.lit("--OUT\r\nContent-Type: image/gif\r\nContent-Disposition: inline\r\nContent-Transfer-Encoding: base64\r\n\r\nR0lGODlh"),
        F.when(F.col("turn") % 3 == 0, "--OUT\r\nContent-Type: application/pdf\r\nContent-Transfer-Encoding: base64\r\n\r\n!!!"), F.lit("--OUT--\r\n"),
    ]
    read = mail.parsed(t(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("\r\n", *lines).alias("content"))).drop("content")
    shown = F.array_join(F.transform("to", lambda a: F.concat_ws(" ", F.when(a["name"] != "", a["name"]), F.concat(F.lit("<"), mail.spec(a), F.lit(">")))), "; ")
    whole = F.struct("conv_id", "turn", "subject", F.get("authors", F.lit(0))["name"].alias("author"), shown.alias("to"), F.md5("body").alias("body_md5"), (F.size("defects") > 0).alias("broken"))
    parts = mail.attachment_children(read.withColumn("_whole", whole), "_whole", skip_types=("image/*",), skip_below=6)
    return parts.select("parent.*", "index", "name", "content_type", "size", "content_digest", "rejected")


# functions in Python


@query("""SELECT o_orderpriority, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 2) AS weighted, sum(len(regexp_extract_all(o_orderpriority, '[A-Z]'))) AS letters, max(len(regexp_extract_all(o_orderpriority, '[A-Z]'))) AS last FROM orders GROUP BY o_orderpriority""")
def python_functions(spark, sf):
    """An aggregate in Python whose partial sums are made by Spark first, so that a group of any size stays small, and a table function
    that yields a row for each letter of a value."""

    @F.pandas_udf("double")
    def ratio(weighted: pd.Series, weights: pd.Series) -> float:
        return float(weighted.sum() / weights.sum())

    @F.udtf(returnType="place: int, letter: string")
    class Letters:
        def eval(self, text: str):
            for place, letter in enumerate((c for c in text or "" if c.isascii() and c.isupper()), 1):
                yield place, letter

    orders = t(spark, sf, "orders")
    sums = orders.groupBy("o_orderpriority", (F.col("o_orderkey") % 64).alias("part")).agg(F.sum(F.col("o_totalprice") * F.col("o_custkey")).alias("w"), F.sum("o_custkey").cast("double").alias("n"), F.count(F.lit(1)).alias("rows"))
    averages = sums.groupBy("o_orderpriority").agg(ratio(F.col("w"), F.col("n")).alias("weighted"))
    rows = sums.groupBy("o_orderpriority").agg(F.sum("rows").alias("rows")).lateralJoin(Letters(F.col("o_orderpriority").outer()))
    letters = rows.groupBy("o_orderpriority").agg(F.sum("rows").alias("letters"), F.max("place").cast("long").alias("last"))
    return averages.join(letters, "o_orderpriority").select("o_orderpriority", F.round("weighted", 2).alias("weighted"), "letters", "last")

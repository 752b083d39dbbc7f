"""Queries over mail, XML, RSS, repair, samples, catalogues and the rest of the relational surface, and the same in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import mail, markup, repair, signal
from cairn.functions import text as X
from cairn.operators import compliance, quality
from cairn.plans.queries import query, t
from cairn.sources.catalog import Catalog, matches
from cairn.streaming import segments

# mail: each turn of a conversation as a message

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_MESSAGE = f"""(SELECT conv_id, turn, role, '<' || conv_id || '.' || turn || '@example.org>' AS message_id, 'Conversation ' || conv_id AS subject,
TIMESTAMP '2024-09-03 07:00:00' + to_minutes(turn % 60) AS sent, trim(coalesce(text, ''), {_BLANKS}) AS body FROM conversations)"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "conversations")
    lines = [
        F.concat(F.lit("Received: from "), "role", F.lit(".example.org ("), "role", F.lit(".example.org [10.0."), F.col("conv_id") % 200, F.lit("."), F.col("turn") % 200, F.lit("]) by mx.example.net with ESMTP id x; Tue, 03 Sep 2024 10:00:05 -0700 (PDT)")),
        F.concat(F.lit("From: User <"), "role", F.lit("@Example.ORG>")),
        F.lit("To: a@x.org, B <b@y.org>, a@X.org"),
        F.concat(F.lit("Cc: c"), "conv_id", F.lit("@z.org")),
        F.concat(F.lit("Subject: Conversation "), "conv_id"),
        F.concat(F.lit("Date: Tue, 03 Sep 2024 09:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00 +0200")),
        F.concat(F.lit("Message-ID: <"), "conv_id", F.lit("."), "turn", F.lit("@example.org>")),
        F.lit("MIME-Version: 1.0"),
        F.lit("Content-Type: text/plain; charset=utf-8"),
        F.lit("Content-Transfer-Encoding: 8bit"),
    ]
    return c.select("conv_id", "turn", F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.coalesce("text", F.lit(""))).alias("content"))


def parsed_messages(spark: SparkSession, sf: str) -> DataFrame:
    return mail.parsed(messages(spark, sf)).drop("content")


def _joined(addresses: str):
    return F.array_join(F.transform(addresses, mail.spec), ",")


@query(f"""SELECT conv_id, turn, role || '@Example.ORG' AS sender, 'a@x.org,b@y.org,c' || conv_id || '@z.org' AS recipients, strftime(sent, '%Y-%m-%d %H:%M:%S') AS sent_utc, message_id, subject, md5(body) AS body_md5 FROM {_MESSAGE}""")
def mail_envelopes(spark, sf):
    sent = F.date_format("sent.utc", "yyyy-MM-dd HH:mm:ss").alias("sent_utc")
    return parsed_messages(spark, sf).select("conv_id", "turn", mail.spec(F.col("originator")).alias("sender"), _joined("everyone").alias("recipients"), sent, "message_id", "subject", F.md5("body").alias("body_md5"))


@query("""SELECT conv_id, turn, 0 AS index, role || '.example.org' AS from_host, '10.0.' || conv_id % 200 || '.' || turn % 200 AS from_ip, 'mx.example.net' AS by_host, 'ESMTP' AS protocol,
'2024-09-03 17:00:05' AS received_utc FROM conversations""")
def mail_hops(spark, sf):
    hops = parsed_messages(spark, sf).select("conv_id", "turn", F.explode("hops").alias("h"))
    return hops.select("conv_id", "turn", "h.index", "h.from_host", "h.from_ip", "h.by_host", "h.protocol", F.date_format("h.moment.utc", "yyyy-MM-dd HH:mm:ss").alias("received_utc"))


@query(f"""SELECT conv_id, turn, sha256(message_id || chr(10) || strftime(sent, '%Y-%m-%dT%H:%M:%S+00:00') || chr(10) || role || '@example.org' || chr(10) || 'a@x.org,b@y.org,c' || conv_id || '@z.org' || chr(10) || subject) AS identity,
sha256(sha256(message_id || chr(10) || strftime(sent, '%Y-%m-%dT%H:%M:%S+00:00') || chr(10) || role || '@example.org' || chr(10) || 'a@x.org,b@y.org,c' || conv_id || '@z.org' || chr(10) || subject) || chr(10) || sha256(body)) AS digest FROM {_MESSAGE}""")
def mail_identity(spark, sf):
    return parsed_messages(spark, sf).select("conv_id", "turn", F.sha2(mail.identity(), 256).alias("identity"), mail.digest().alias("digest"))


@query(f"""SELECT conv_id, turn, md5('From: User <' || role || '@Example.ORG>' || chr(10) || 'To: a@x.org, B <b@y.org>, a@X.org' || chr(10) || 'Cc: c' || conv_id || '@z.org' || chr(10) || 'Subject: ' || subject || chr(10)
|| 'Date: Tue, 03 Sep 2024 09:' || lpad((turn % 60)::VARCHAR, 2, '0') || ':00 +0200' || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || body END) AS rendered_md5 FROM {_MESSAGE}""")
def mail_rendered(spark, sf):
    return parsed_messages(spark, sf).select("conv_id", "turn", F.md5(mail.rendered()).alias("rendered_md5"))


@query("SELECT conv_id, list_aggregate(list(DISTINCT role ORDER BY role), 'string_agg', ',') AS servers, count(*) AS messages FROM conversations GROUP BY conv_id")
def mail_servers(spark, sf):
    hosts = parsed_messages(spark, sf).select("conv_id", F.regexp_replace(F.get("servers", F.lit(0)), r"\.example\.org$", "").alias("host"))
    return hosts.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("host")), ",").alias("servers"), F.count(F.lit(1)).alias("messages"))


@query("""SELECT conv_id, turn, role || '@example.org' AS sender, 'Talk ' || conv_id AS subject, '2026-09-04 15:' || lpad((turn % 60)::VARCHAR, 2, '0') || ':00' AS sent FROM conversations WHERE role <> 'system'""")
def mail_printed(spark, sf):
    """Messages as a mail program prints them; those of one label are none."""
    block = F.concat(F.lit("From: "), "role", F.lit("@example.org\nSent: Friday, September 4, 2026 3:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(" PM\nTo: a@x.org\nSubject: Talk "), "conv_id", F.lit("\n\n"))
    pages = t(spark, sf, "conversations").select("conv_id", "turn", mail.printed_block(F.concat(F.when(F.col("role") != "system", block).otherwise("From: system@x.org\n"), F.coalesce("text", F.lit("")))).alias("p"))
    return pages.where("p IS NOT NULL").select("conv_id", "turn", F.col("p.from").alias("sender"), "p.subject", F.date_format(mail.printed(F.col("p.sent")), "yyyy-MM-dd HH:mm:ss").alias("sent"))


@query()
def annotate_envelope(spark, sf):
    found = parsed_messages(spark, sf)
    terms = X.envelope_terms(F.transform(F.concat("authors", "everyone"), mail.spec), F.transform("authors", lambda a: a["name"]))
    docs = found.select(F.concat("conv_id", F.lit("."), "turn").alias("doc_id"), F.concat("body", F.lit("\nfrom "), mail.spec(F.col("originator"))).alias("text"), terms.alias("terms"))
    return X.annotated(docs, X.PII, "terms", (("ARTICLE", r"\bthe\b"),))


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(rf"""SELECT doc_id, k, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + list_sum(list_transform([''] || hits[1:k - 1], lambda x: length(x))))::BIGINT AS start, hits[k] AS text
FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{_EMAIL}') AS hits, regexp_split_to_array(text, '{_EMAIL}') AS parts FROM documents))""")
def pii_spans(spark, sf):
    spans = X.spans(t(spark, sf, "documents"), [X.PII[0]])
    return spans.select("doc_id", F.posexplode("annotations").alias("k", "a")).select("doc_id", (F.col("k") + 1).cast("long").alias("k"), F.col("a.start").cast("long").alias("start"), "a.text")


# markup


@query("""SELECT r_regionkey AS id, r_name AS name, count(n_name)::VARCHAR AS n, coalesce(string_agg(n_name, '; ' ORDER BY n_nationkey), '') AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""")
def xml_flatten(spark, sf):
    inner = F.concat(F.lit("<n:nation>"), "n_name", F.lit("</n:nation>"))
    lists = t(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", inner.alias("x")))), lambda s: s["x"]), "").alias("x"), F.count(F.lit(1)).alias("n"))
    regions = t(spark, sf, "region").join(lists, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    document = F.concat(F.lit("<all xmlns:n='urn:n'><region id='"), "r_regionkey", F.lit("' n='"), F.coalesce("n", F.lit(0)), F.lit("'><name> "), "r_name", F.lit(" </name>"), F.coalesce("x", F.lit("<n:nation/>")), F.lit("</region></all>"))
    found = regions.select(F.explode(markup.xml_records(document, "region")).alias("m"))
    return found.select(F.col("m")["id"].cast("int").alias("id"), F.col("m")["name"].alias("name"), F.col("m")["n"].alias("n"), F.col("m")["nation"].alias("nations"))


@query("SELECT p_partkey::VARCHAR AS key, p_name || ' <&> \"x\"' AS name, p_brand AS brand FROM part")
def xml_round_trip(spark, sf):
    parts = t(spark, sf, "part").select(F.col("p_partkey").alias("part.key"), F.concat("p_name", F.lit(' <&> "x"')).alias("part.name"), F.col("p_brand").alias("maker.brand"))
    document = F.concat(F.lit("<records>"), markup.xml_of(parts.columns), F.lit("</records>"))
    m = F.col("m")
    return parts.select(F.explode(markup.xml_records(document)).alias("m")).select(m["part.key"].alias("key"), m["part.name"].alias("name"), m["maker.brand"].alias("brand"))


@query("""SELECT page_id, 'Page ' || page_id AS title, url AS link, 'a; b' AS category, '2024-09-03T09:' || lpad((page_id % 60)::VARCHAR, 2, '0') || ':00+02:00' AS "pubDate", 'someone' AS author, url AS enclosure_url FROM pages""")
def rss_items(spark, sf):
    pages = t(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("Page "), "page_id").alias("title"), F.col("url").alias("link"), F.lit("a; b").alias("category"),
        F.concat(F.lit("2024-09-03T09:"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"), F.lit(":00+02:00")).alias("pubDate"), F.col("url").alias("enclosure_url"), F.lit("text/html").alias("enclosure_type"),
    )
    item = F.replace(markup.rss_item_xml(pages.columns), F.lit("</item>"), F.lit("<dc:creator>someone</dc:creator></item>"))
    document = F.concat(F.lit("<rss version='2.0' xmlns:dc='http://purl.org/dc/elements/1.1/'><channel><title>t</title>"), item, F.lit("</channel></rss>"))
    found = pages.select("page_id", F.explode(markup.rss_feed(document)["items"]).alias("i")).select("page_id", *markup.rss_item(F.col("i")))
    return found.select("page_id", "title", "link", "category", "pubDate", "author", "enclosure_url")


@query(r"""WITH p AS (SELECT page_id, url, html FROM pages),
f AS (SELECT page_id, unnest([{'predicate': 'hasIdentifier', 'object': page_id::VARCHAR}, {'predicate': 'hasUri', 'object': url},
{'predicate': 'hasTitle', 'object': trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))},
{'predicate': 'hasFileSize', 'object': strlen(html)::VARCHAR}]) AS x FROM p)
SELECT page_id, x.predicate AS predicate, x.object AS object FROM f WHERE x.object <> '' UNION ALL
SELECT page_id, 'hasLinks', unnest(list_distinct(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#]+)["'']', 1))) FROM p""")
def page_triples(spark, sf):
    pages = t(spark, sf, "pages").select("page_id", F.explode(X.page_triples(F.col("page_id"), F.col("url"), F.col("html"))).alias("x"))
    return pages.select("page_id", "x.predicate", "x.object").where("predicate NOT IN ('hasContent', 'hasDescription')")


@query("""SELECT 'urn:nation:' || n_nationkey AS subject, 'urn:name' AS predicate, '"' || n_name || '"' AS object FROM nation""")
def ntriples_round_trip(spark, sf):
    lines = t(spark, sf, "nation").select(X.triple_line(F.concat(F.lit("urn:nation:"), "n_nationkey"), F.lit("urn:name"), F.col("n_name")).alias("line"))
    return lines.select(X.triples_of(F.col("line")).alias("x")).select("x.*")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'user ' || user_id || ' did ' || event_type AS message FROM events")
def log_fields(spark, sf):
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), level, F.lit(": user "), "user_id", F.lit(" did "), "event_type")
    return t(spark, sf, "events").select("event_id", X.log_fields(line).alias("x")).select("event_id", "x.*")


@query("SELECT doc_id, '2024-03-01-120000-' || substr(sha256(text), 1, 16) AS name, true AS hashed FROM documents")
def hashed_name(spark, sf):
    name = X.hashed_name(F.lit("2024-03-01 12:00:00").cast("timestamp"), F.sha2("text", 256))
    return t(spark, sf, "documents").select("doc_id", name.alias("name"), X.is_hashed(name).alias("hashed"))


# text repair


@query("SELECT DISTINCT replace(p_name, ' ', '') AS token, p_name AS pieces FROM part")
def sticky_split(spark, sf):
    names = t(spark, sf, "part").select("p_name").distinct()
    lexicon = names.select(F.explode(F.split("p_name", " ")).alias("word")).distinct().withColumn("zipf", F.lit(4.0))
    found = repair.segmented(names.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("token")), lexicon)
    return found.select("token", F.array_join("pieces", " ").alias("pieces"))


@query("""SELECT DISTINCT p_name AS id, split_part(p_name, ' ', 1) AS repaired FROM part""")
def repair_junctions(spark, sf):
    """The first word of each name without its third letter, which stands among those to restore."""
    names = t(spark, sf, "part").select("p_name").distinct().select(F.col("p_name").alias("id"), F.substring_index("p_name", " ", 1).alias("w"))
    lexicon = names.select(F.col("w").alias("word")).distinct().withColumn("zipf", F.lit(4.0))
    broken = names.select("id", F.substring("w", 1, 2).alias("left"), F.substr("w", F.lit(4)).alias("right"), F.concat(F.substring("w", 3, 1), F.lit("#")).alias("restore"), F.lit("").alias("spacing"))
    return repair.closed(broken, lexicon).select("id", "repaired")


@query("""SELECT p_partkey, 'To: all' || chr(10) || 'we pro' || 'duce ' || p_name AS repaired, 1 AS substitutions, 1 AS joins FROM part""")
def repair_confusions(spark, sf):
    parts = t(spark, sf, "part").select("p_partkey", F.concat(F.lit("To: all\nwe p|~ duce "), "p_name").alias("text"))
    lexicon = spark.createDataFrame([("produce", 4.0), ("we", 6.0), ("to", 7.0), ("pro", 3.0)], "word string, zipf double")
    found = repair.repaired(parts, "text", (repair.Confusion("|~", "ro", "d"),), lexicon, headers=("To:",))
    return found.select("p_partkey", "repaired", "substitutions", "joins")


# samples and catalogues


@query("""SELECT event_id, 0 AS n, round((event_id % 256 - 127.5) / 127.5, 4)::DOUBLE AS i, round((user_id % 256 - 127.5) / 127.5, 4)::DOUBLE AS q FROM events
UNION ALL SELECT event_id, 1, 1.0, -1.0 FROM events""")
def iq_samples(spark, sf):
    two = lambda c: F.lpad(F.hex(F.col(c) % 256), 2, "0")
    blocks = t(spark, sf, "events").select("event_id", F.unhex(F.concat(two("event_id"), two("user_id"), F.lit("FF00"))).alias("payload"))
    return signal.samples(blocks, "payload", "u8_iq").select("event_id", "n", F.round(F.col("i").cast("double"), 4).alias("i"), F.round(F.col("q").cast("double"), 4).alias("q"))


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as groups and nations as controls of one OSCAL catalogue."""
    nations = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda n: F.struct(F.concat(F.lit("n-"), n["n_nationkey"]).alias("id"), n["n_name"].alias("title")))
    groups = t(spark, sf, "nation").groupBy("n_regionkey").agg(nations.alias("controls")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    listed = groups.select(F.struct(F.col("r_name").alias("id"), "controls").alias("g")).agg(F.sort_array(F.collect_list("g")).alias("groups"))
    return listed.select(F.to_json(F.struct(F.struct("groups").alias("catalog"))).alias("document"))


@query("SELECT 'n-' || n_nationkey AS id, n_name AS title, r_name AS groups FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalogue_controls(spark, sf):
    found = _catalogue(spark, sf).select(F.explode(compliance.catalogue(F.col("document"))).alias("c"))
    return found.select("c.id", "c.title", F.array_join("c.groups", "/").alias("groups"))


@query("SELECT r_name AS path, count(*) AS controls FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (1, 2, 3, 7, 12) AND n_nationkey <> 3 GROUP BY r_name")
def profile_groups(spark, sf):
    """What a profile selects, as the groups that remain."""
    text = '{"profile": {"imports": [{"href": "#c", "include-controls": [{"with-ids": ["n-1", "N-2", "n-3"]}, {"with-ids": ["n-7", "n-12"]}], "exclude-controls": [{"with-ids": ["n-3"]}]}]}}'
    chosen = spark.createDataFrame([(text,)], "document string").select(F.explode(compliance.profile(F.col("document"))).alias("i"))
    controls = _catalogue(spark, sf).select(F.explode(compliance.catalogue(F.col("document"))).alias("c")).select("c.*")
    kept = compliance.resolve(controls, chosen.select(F.explode("i.include").alias("id")), chosen.select(F.explode("i.exclude").alias("id")))
    return compliance.groups_of(kept).select(F.array_join("path", "/").alias("path"), "controls")


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'PNG' WHEN 2 THEN 'ORC' WHEN 3 THEN 'GZIP' ELSE 'UNKNOWN' END AS kind FROM nation""")
def file_type_bytes(spark, sf):
    heads = F.array(*[F.lit(h) for h in ("255044462D312E37", "89504E470D0A1A0A", "4F52430A", "1F8B0800", "0011")])
    return t(spark, sf, "nation").select("n_nationkey", X.file_type_of_bytes(F.unhex(F.get(heads, F.col("n_nationkey") % 5))).alias("kind"))


@query("SELECT n_name FROM nation WHERE lower(n_name) GLOB 'nation_1[0-5]' OR lower(n_name) GLOB '*_2?' OR contains(lower(n_name), 'n_7')")
def search_names(spark, sf):
    """Names by glob or by part, in any case."""
    name = F.col("n_name")
    return t(spark, sf, "nation").select("n_name").where(matches(name, "NATION_1[0-5]") | matches(name, "*_2?") | matches(name, "N_7"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS record_id, round(((CASE WHEN l_returnflag IN ('A', 'N') THEN 1 ELSE 0 END) + (CASE WHEN l_discount BETWEEN 0 AND 0.05 THEN 1 ELSE 0 END)
+ (CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)) / 3.0::DOUBLE, 4) AS validity FROM lineitem""")
def dqi_lineitem_validity(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rules = quality.QualityRules("line", patterns={"l_returnflag": "[AN]"}, ranges={"l_discount": (0, 0.05)}, enumerations={"l_linestatus": ("O",)})
    return quality.report(quality.measure(rows, rules)).select("record_id", "validity")


# the rest of the relational surface


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))")
def grouping_sets(spark, sf):
    rows, flag, status = t(spark, sf, "lineitem"), F.col("l_returnflag"), F.col("l_linestatus")
    return rows.groupingSets([[flag], [status], [flag, status]], flag, status).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey, o_orderkey, ntile(4) OVER w AS quarter, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS place, round(percent_rank() OVER w, 6) AS share, round(cume_dist() OVER w, 6) AS upto,
first_value(o_orderkey) OVER w AS first_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_ranking(spark, sf):
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    made = {"quarter": F.ntile(4).over(own), "place": F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")), "share": F.round(F.percent_rank().over(own), 6), "upto": F.round(F.cume_dist().over(own), 6), "first_key": F.first("o_orderkey").over(own)}
    return t(spark, sf, "orders").withColumns(made).select("o_custkey", "o_orderkey", *made)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS within_hour FROM events")
def window_range_frame(spark, sf):
    own = Window.partitionBy("user_id").orderBy("_us").rangeBetween(-3_600_000_000, 0)
    return t(spark, sf, "events").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", F.count(F.lit(1)).over(own).alias("within_hour"))


@query("""SELECT k, 'common' AS kind FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) UNION ALL
SELECT k, 'surplus' FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)""")
def setops_all(spark, sf):
    c, s = t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersectAll(s).withColumn("kind", F.lit("common")).unionAll(c.exceptAll(s).withColumn("kind", F.lit("surplus")))


@query("""WITH rich AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer))
SELECT n_name, (SELECT count(*) FROM rich WHERE c_nationkey = n_nationkey) AS rich FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM rich)""")
def subqueries_cte(spark, sf):
    text = f"""sql: WITH rich AS (SELECT c_custkey, c_nationkey, c_acctbal FROM parquet.`{sf}/customer.parquet` WHERE c_acctbal > (SELECT avg(c_acctbal) FROM parquet.`{sf}/customer.parquet`))
    SELECT n_name, (SELECT count(*) FROM rich WHERE c_nationkey = n_nationkey) AS rich FROM parquet.`{sf}/nation.parquet` WHERE n_nationkey IN (SELECT c_nationkey FROM rich)"""
    return Catalog(spark, allow_raw_sql=True).read(text)


@query("""SELECT w AS window_start, event_type, count(*) AS events FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL""")
def sliding_counts(spark, sf):
    return segments.sliding(t(spark, sf, "events"), "ts", "2 hours", "1 hour", "event_type")


@query("SELECT event_type, true AS near FROM events GROUP BY event_type")
def approximate_distinct(spark, sf):
    """The approximate number of users and the median, each within five hundredths of the exact one."""
    exact = F.count_distinct("user_id")
    found = t(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), exact.alias("users"), F.percentile_approx("value", 0.5, 10_000).alias("middle"), F.percentile("value", 0.5).alias("median"))
    return found.select("event_type", ((F.abs(F.col("about") - F.col("users")) <= 0.05 * F.col("users") + 1) & (F.abs(F.col("middle") - F.col("median")) <= 0.05 * F.abs("median") + 0.05)).alias("near"))


@query("SELECT o_orderstatus, round(exp(avg(ln(o_totalprice))), 2) AS geometric, count(*) * 2 AS halves FROM orders GROUP BY o_orderstatus")
def python_surface(spark, sf):
    """A scalar function, an aggregate and a table function in Python, on Arrow batches where Spark has them."""

    @F.pandas_udf("double")
    def log(v: pd.Series) -> pd.Series:
        import numpy as np

        return np.log(v)

    @F.udtf(returnType="half: int")
    class Halves:
        def eval(self, n: int):
            for k in range(n):
                yield (k,)

    orders = t(spark, sf, "orders").select("o_orderstatus", log(F.col("o_totalprice")).alias("l")).lateralJoin(Halves(F.lit(2)))
    return orders.groupBy("o_orderstatus").agg(F.round(F.exp(F.avg("l")), 2).alias("geometric"), F.count("half").alias("halves"))

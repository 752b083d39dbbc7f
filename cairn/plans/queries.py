"""One query for each operator on the supplied tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import text as X
from cairn.operators import compliance, documents, metrics, quality
from cairn.operators.relational import asof_join, range_join, top_k
from cairn.sources.catalog import Catalog
from cairn.streaming import segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return Catalog(spark).read(f"{sf}/{name}.parquet")


# sources, filters, cleaning


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def scan_project_filter(spark, sf):
    return Catalog(spark).read(f"{sf}/customer.parquet", where={"c_mktsegment": "BUILDING", "c_nationkey": 7}, columns=["c_custkey", "c_name", "c_acctbal"])


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def sql_pass_through(spark, sf):
    return Catalog(spark, allow_raw_sql=True).read(f"sql: SELECT o_orderstatus, count(*) AS n FROM parquet.`{sf}/orders.parquet` GROUP BY o_orderstatus;")


@query("""SELECT c_custkey, coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey""")
def clean_fillna(spark, sf):
    dear = t(spark, sf, "orders").where("o_totalprice > 400000")
    joined = t(spark, sf, "customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderstatus", "o_orderpriority")
    return documents.cleaned(joined, strings_only=True)


@query("SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_retailprice AS price FROM part")
def column_mapper(spark, sf):
    return documents.mapped(t(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice"), {"p_partkey": "id", "p_name": "name", "p_brand": "brand", "p_retailprice": "price"})


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'p_size: maximum' WHEN p_retailprice < 950 THEN 'p_retailprice: minimum' END AS _error FROM part""")
def schema_validate_split(spark, sf):
    rules = {"required": ["p_partkey"], "properties": {"p_size": {"type": "integer", "maximum": 40}, "p_retailprice": {"type": "number", "minimum": 950}}}
    return documents.validated(t(spark, sf, "part"), rules).select("p_partkey", "_error")


# quality

ORDER_RULES = dict(
    identifier="o_orderkey", mandatory=("o_custkey", "o_orderdate"), ranges={"o_totalprice": (0, 300000)}, enumerations={"o_orderstatus": ("F", "O")},
    expressions=("o_totalprice > 1000 and o_orderkey >= 0", "o_orderstatus in ['F', 'O', 'P'] or not o_custkey > 0"), keys=("o_custkey", "o_orderpriority"), order_by=("o_orderkey",),
    weights={"completeness": 0.25, "validity": 0.25, "consistency": 0.25, "uniqueness": 0.25},
)
_ORDER_DQI = """
SELECT o_orderkey, 1.0::DOUBLE AS completeness,
  ((CASE WHEN o_totalprice BETWEEN 0 AND 300000 THEN 1 ELSE 0 END) + (CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END)) / 2.0::DOUBLE AS validity,
  ((CASE WHEN o_totalprice > 1000 AND o_orderkey >= 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderstatus IN ('F', 'O', 'P') OR NOT o_custkey > 0 THEN 1 ELSE 0 END)) / 2.0::DOUBLE AS consistency,
  CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS uniqueness
FROM orders
"""


@query(f"""SELECT o_orderkey AS record_id, round(completeness * 0.25 + validity * 0.25 + consistency * 0.25 + uniqueness * 0.25, 4) AS dqi,
round(completeness, 4) AS completeness, round(validity, 4) AS validity, round(consistency, 4) AS consistency, round(uniqueness, 4) AS uniqueness FROM ({_ORDER_DQI})""")
def dqi_orders_report(spark, sf):
    measured = quality.measure(t(spark, sf, "orders"), quality.QualityRules(**ORDER_RULES), "load")
    return quality.report(measured).select("record_id", "dqi", "completeness", "validity", "consistency", "uniqueness")


@query(f"""WITH m AS (SELECT *, completeness * 0.25 + validity * 0.25 + consistency * 0.25 + uniqueness * 0.25 AS dqi FROM ({_ORDER_DQI}))
SELECT count(dqi) AS count, round(avg(dqi), 4) AS mean, round(min(dqi), 4) AS minimum, round(max(dqi), 4) AS maximum, round(coalesce(var_samp(dqi), 0), 4) AS variance,
round(coalesce(stddev_samp(dqi), 0), 4) AS stdev, round(avg(validity), 4) AS mean_validity, round(avg(uniqueness), 4) AS mean_uniqueness FROM m""")
def dqi_orders_aggregate(spark, sf):
    measured = quality.measure(t(spark, sf, "orders"), quality.QualityRules(**ORDER_RULES))
    return quality.aggregate(measured).select("count", "mean", "minimum", "maximum", "variance", "stdev", "mean_validity", "mean_uniqueness")


@query("""SELECT c_custkey AS record_id, round(((CASE WHEN r.c_acctbal = c.c_acctbal THEN 1 ELSE 0 END) + (CASE WHEN r.c_mktsegment = c.c_mktsegment THEN 1 ELSE 0 END)) / 2.0::DOUBLE, 4) AS accuracy
FROM customer c LEFT JOIN (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 > 0) r USING (c_custkey)
WHERE r.c_acctbal IS NOT NULL""")
def dqi_accuracy_reference(spark, sf):
    customers = t(spark, sf, "customer")
    known = customers.where("c_custkey % 3 > 0").select("c_custkey", "c_acctbal", F.when(F.expr("c_custkey % 7 = 0"), "OTHER").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    measured = quality.measure(customers, quality.QualityRules("c_custkey", reference=known))
    return quality.report(measured).where("accuracy IS NOT NULL").select("record_id", "accuracy")


@query("SELECT event_id AS record_id, round(exp(-0.01 * greatest(date_diff('microsecond', ts, TIMESTAMP '2024-02-01 00:00:00') / 3.6e9, 0)), 4) AS currentness FROM events")
def dqi_currentness_asof(spark, sf):
    measured = quality.measure(t(spark, sf, "events"), quality.QualityRules("event_id", timestamp="ts", decay=0.01), as_of=F.lit("2024-02-01 00:00:00"))
    return quality.report(measured).select("record_id", "currentness")


# documents


@query("SELECT doc_id, sha256(text) AS content_digest, md5(text) AS content_md5 FROM documents")
def digest_documents(spark, sf):
    return documents.stamped(documents.stamped(t(spark, sf, "documents"), "text"), "text", "content_md5", "md5").select("doc_id", "content_digest", "content_md5")


_BUNDLE = "SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical_id FROM documents"


@query(f"SELECT doc_id, digest, canonical_id, doc_id <> canonical_id AS is_alias FROM ({_BUNDLE})")
def bundle_dedup(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", documents.digest(F.col("text")).alias("digest"), F.col("doc_id").alias("seq"))
    return documents.bundle(docs, "doc_id", "digest", "seq").select("doc_id", "digest", "canonical_id", "is_alias")


@query(f"SELECT canonical_id, list(doc_id ORDER BY doc_id) AS aliases FROM ({_BUNDLE}) WHERE doc_id <> canonical_id GROUP BY canonical_id")
def bundle_aliases(spark, sf):
    return bundle_dedup(spark, sf).where("is_alias").groupBy("canonical_id").agg(F.array_sort(F.collect_list("doc_id")).alias("aliases"))


@query("""SELECT o.k AS parent, coalesce(c.n, 0) AS n_children, coalesce(c.l, '') AS children
FROM (SELECT DISTINCT o_orderkey AS k FROM orders) o LEFT JOIN
(SELECT l_orderkey, count(*) AS n, string_agg(p::VARCHAR, ',' ORDER BY first_line, p::VARCHAR) AS l FROM (SELECT l_orderkey, l_partkey AS p, min(l_linenumber) AS first_line FROM lineitem GROUP BY ALL) GROUP BY l_orderkey) c ON o.k = c.l_orderkey""")
def bundle_manifest(spark, sf):
    parents = t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("parent"))
    children = t(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("parent"), F.col("l_partkey").cast("string").alias("child"), "l_linenumber")
    found = documents.manifest(parents, children, "parent", "child", "l_linenumber")
    return found.select(F.col("parent").cast("long").alias("parent"), F.size("children").cast("long").alias("n_children"), F.array_join("children", ",").alias("children"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def large_blackboard_last_write(spark, sf):
    return documents.latest(t(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


@query("SELECT doc_id, source, n_chars, CASE WHEN n_chars > 5000 THEN 'long' WHEN lang <> 'en' THEN 'foreign' WHEN source = 'src0' THEN 'first' ELSE 'rest' END AS route FROM documents")
def route_first_match(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang")
    return documents.routed(docs, [("long", F.col("n_chars") > 5000), ("foreign", F.col("lang") != "en"), ("first", F.col("source") == "src0")], "rest").drop("lang")


@query("SELECT n_name AS name, r_name, len(n_name) AS size FROM nation JOIN region ON n_regionkey = r_regionkey")
def sort_files_by_size(spark, sf):
    files = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), "r_name", F.length("n_name").cast("long").alias("size"))
    return documents.ordered(files, "size", descending=True)


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'")
def created_window(spark, sf):
    return t(spark, sf, "events").where("ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'").select("event_id", "ts")


@query("""SELECT r_regionkey, r_name, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""")
def nested_join_patterns(spark, sf):
    both = documents.nested(t(spark, sf, "region"), t(spark, sf, "nation"), "r_regionkey", "n_regionkey", "nations", "n_nationkey")
    return both.select("r_regionkey", "r_name", F.array_join(F.transform("nations", lambda x: x["n_name"]), ",").alias("nations"))


@query("""SELECT conv_id, string_agg(role || '@' || turn, ',' ORDER BY turn) AS speakers FROM (SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def mail_thread_union(spark, sf):
    """Who speaks in a conversation, each with the first turn, in the order of these."""
    lists = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    first = documents.distinct_union(F.col("l"), key=lambda x: x["role"])
    return lists.select("conv_id", F.array_join(F.transform(first, lambda x: F.concat(x["role"], F.lit("@"), x["turn"])), ",").alias("speakers"))


# text

MACROS = (X.Macro(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"), X.Macro(r"[0-9]{3}-[0-9]{3}-[0-9]{4}", "[PHONE]"), X.Macro(r"[0-9]+", "#"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '[0-9]{3}-[0-9]{3}-[0-9]{4}', '[PHONE]', 'g'), '[0-9]+', '#', 'g')) AS redacted_md5 FROM documents""")
def macro_redact(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(X.redacted(F.col("text"), MACROS)).alias("redacted_md5"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) + len(regexp_extract_all(text, '[0-9]{3}-[0-9]{3}-[0-9]{4}')) + len(regexp_extract_all(text, '[0-9]+')) AS n_hits FROM documents""")
def macro_hits(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.size(X.hits(F.col("text"), MACROS)).cast("long").alias("n_hits"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails FROM documents")
def pii_email_counts(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(MACROS[0].pattern)).cast("long").alias("emails"))


@query()
def pii_resolved(spark, sf):
    return X.spans(t(spark, sf, "documents"), X.PII, cue=X.PII_CUE)


@query()
def sentence_chunks(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.sentence_chunks(F.col("text"), 400).alias("chunks"))


_HTML_STEPS = (
    (r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", ""), (r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n"), (r"(?s)<[^>]*>", " "),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&"), (r"[ \t\x0B\f\r]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"),
)


@query("SELECT page_id, trim(" + "regexp_replace(" * len(_HTML_STEPS) + "html" + "".join(f", '{p}', '{r}', 'g')" if r != "\n" and r != "\n\n" else f", '{p}', repeat(chr(10), {len(r)}), 'g')" for p, r in _HTML_STEPS) + ", ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS text FROM pages")
def html_strip(spark, sf):
    return t(spark, sf, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query(r"""SELECT page_id, link FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#]+)["'']', 1))) AS link FROM pages)""")
def html_triples(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(X.html_links(F.col("html"))).alias("link"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def slug_title(spark, sf):
    return t(spark, sf, "part").select("p_partkey", X.slug(F.col("p_name"), 200).alias("slug"))


_PLAIN_NAME = r"lower(trim(regexp_replace(regexp_replace(strip_accents(s), '[^\x00-\x7F]+', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '-'))"


@query(rf"""WITH a AS (SELECT doc_id, source, text, n_chars, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))),
lambda x: length(x) >= 12 AND NOT regexp_matches(x, '(?i)^(page \d+ of \d+|contents|table of contents|official[: ].*)$') AND NOT regexp_matches(x, '^[\d\s.\-–]+$')) AS l FROM documents),
b AS (SELECT *, coalesce(l[1], substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 120)) AS s FROM a),
c AS (SELECT *, {_PLAIN_NAME} AS n FROM b),
d AS (SELECT *, CASE WHEN length(n) <= 60 OR substr(n, 61, 1) = '-' OR substr(n, 1, 60) NOT LIKE '%-%' THEN substr(n, 1, 60) ELSE regexp_replace(substr(n, 1, 60), '-[^-]*$', '') END AS g FROM c)
SELECT doc_id, CASE WHEN trim(text) = '' THEN 'SCAN-' || ceil(n_chars / 3000)::BIGINT || 'pp' ELSE concat_ws('-', source, nullif(regexp_extract(substr(text, 1, 600), '\b(199[0-9]|20[0-9]{{2}})\b', 1), ''), coalesce(nullif(g, ''), 'without-title'),
ceil(n_chars / 3000)::BIGINT || 'pp') END AS name FROM d""")
def archive_name(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.archive_name(F.col("source"), F.col("text"), F.ceil(F.col("n_chars") / 3000)).alias("name"))


@query()
def file_type_text(spark, sf):
    pages, docs = t(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")), t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return pages.unionByName(docs).select("id", X.file_type_of_text(F.col("text")).alias("file_type"))


# compliance


@query("""SELECT DISTINCT p_brand AS id, coalesce(target, p_brand) AS target FROM part
LEFT JOIN (VALUES ('brand#11', 'A-1'), ('brand#11', 'A-2'), ('brand#23', 'b-7')) x(source, target) ON lower(p_brand) = source""")
def crosswalk_translate(spark, sf):
    known = spark.createDataFrame([("BRAND#11", "A-1"), ("brand#11", "A-2"), ("Brand#23", "b-7")], "source string, target string")
    return compliance.translate(t(spark, sf, "part").select(F.col("p_brand").alias("id")), known)


@query("SELECT p_type AS component, p_brand AS id FROM part WHERE lower(p_brand) NOT IN ('brand#11', 'brand#12', 'brand#13', 'brand#21')")
def policy_outside(spark, sf):
    baseline = spark.createDataFrame([("Brand#11",), ("brand#12",), ("BRAND#13",), ("Brand#21",)], "id string")
    return compliance.outside(t(spark, sf, "part").select(F.col("p_type").alias("component"), F.col("p_brand").alias("id")), baseline)


@query("SELECT n_name AS id, n_regionkey AS grp FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0")
def profile_resolve(spark, sf):
    nations = t(spark, sf, "nation")
    return compliance.resolve(nations.select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("grp")), nations.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("id")), nations.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("id")))


# streams and metrics


@query("""WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM a),
c AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY user_id, r ORDER BY event_id) - 1) % 2 = 0 THEN 1 ELSE 0 END AS c FROM b)
SELECT event_id, user_id, event_type, (sum(c) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS segment FROM c""")
def segment_runs(spark, sf):
    return segments.runs(t(spark, sf, "events"), ["user_id"], ["event_id"], "event_type", 2).select("event_id", "user_id", "event_type", "segment")


@query("""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, round(sum(value), 4) AS total FROM b GROUP BY user_id, s""")
def session_users(spark, sf):
    return segments.sessions(t(spark, sf, "events"), "user_id", "ts", "6 hours", "value").withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    return segments.tumbling(t(spark, sf, "events"), "ts", "1 hour", "event_type")


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events)
WHERE ts < seen - INTERVAL 10 DAY""")
def late_dropped(spark, sf):
    rows = t(spark, sf, "events").withColumn("_o", F.struct("value", "event_id"))
    return segments.late(rows, "ts", "_o", F.expr("INTERVAL 10 DAYS"), ["user_id"]).select("event_id", "user_id")


@query("""SELECT event_type, le, count(*) FILTER (value <= le) AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (10.0), (50.0), (100.0), (250.0)) b(le) GROUP BY event_type, le""")
def prometheus_histogram(spark, sf):
    return metrics.histogram(t(spark, sf, "events"), "event_type", "value", (10.0, 50.0, 100.0, 250.0)).withColumn("total", F.round("total", 4))


@query("""SELECT 0 AS place, '# HELP events_total Events by type' AS line UNION ALL SELECT 1, '# TYPE events_total counter' UNION ALL
SELECT 2, 'events_total{event_type="' || event_type || '"} ' || count(*) || '.0' FROM events GROUP BY event_type""")
def prometheus_lines(spark, sf):
    return metrics.exposition(t(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("value")), "events_total", "counter", "Events by type", "event_type")


@query("SELECT event_id, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# the relational surface


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf):
    rows = t(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1 GROUP BY n_name""")
def join_revenue_by_nation(spark, sf):
    li, o, c, n, r = (t(spark, sf, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    # the only condition cuts customers and so orders before the large table is met
    ours = r.where("r_regionkey = 1").join(n, F.col("r_regionkey") == n.n_regionkey).join(c, F.col("n_nationkey") == c.c_nationkey).join(o, F.col("c_custkey") == o.o_custkey).select("n_name", "o_orderkey")
    joined = li.join(ours, li.l_orderkey == F.col("o_orderkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT c_custkey, 'with' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL
SELECT c_custkey, 'without' AS kind FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def semi_anti(spark, sf):
    c, o = t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders").select("o_custkey")
    same = c.c_custkey == o.o_custkey
    return c.join(o, same, "left_semi").withColumn("kind", F.lit("with")).unionByName(c.join(o, same, "left_anti").withColumn("kind", F.lit("without")))


@query("SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def topk_per_supplier(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return top_k(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)


@query("""SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders""")
def window_running(spark, sf):
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    total = F.sum("o_totalprice").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(total, 2).alias("running"), F.lag("o_orderkey").over(own).alias("previous"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_flags(spark, sf):
    return t(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_priority(spark, sf):
    return t(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_nationkey AS k, 'both' AS kind FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
SELECT c_nationkey AS k, 'customers only' AS kind FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def setops_nations(spark, sf):
    c, s = t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("kind", F.lit("both")).unionByName(c.subtract(s).withColumn("kind", F.lit("customers only")))


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus")
def pivot_status(spark, sf):
    found = t(spark, sf, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1)))
    return found.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@query("""SELECT p.event_id, p.user_id, v.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
ON p.user_id = v.user_id AND p.event_id >= v.event_id""")
def asof_last_view(spark, sf):
    e = t(spark, sf, "events")
    left, right = e.where("event_type = 'purchase'").select("event_id", "user_id"), e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("before_id"))
    return asof_join(left, right, ["user_id"], "event_id", "before_id", ["before_id"])


@query("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""")
def range_within_hour(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return range_join(e, e, ["user_id"], "at", 3_600_000_000).select(F.col("l_event_id").alias("a"), F.col("r_event_id").alias("b"))


# the queries of the other modules register themselves here too
from cairn.plans import records, structures  # noqa: E402, F401

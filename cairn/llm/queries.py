"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import bpe, hard_negatives, impact_index, langid, line_dedup, mixing, pairwise_quality, parity_join, quality_rules, resharding, rp_forest, suffix_dedup, wavelet
from .common import table


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *[f"_qr.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "first_turn", "n_pieces")


def op2_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six shards by hash become eight of near-equal bytes; rows come from the blocks that stayed and the rewritten ones."""
    docs = table(spark, sf_dir, "documents")
    old = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 6
    found = resharding.reshard(spark, resharding.lay_out(docs, old, 6), shards=8).rows(spark)
    return found.select("doc.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rp_forest.search(rows, rows.where("vec_id % 20 = 0"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def tokenizer(name: str) -> str:
    """The path of a public tokenizer file; other places can be set by the environment's CAIRN_TOKENIZERS."""
    folder = os.environ.get("CAIRN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return found.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.col("text").alias("kept_text"))


def op5_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wavelet.encode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_ids=False)


def op8_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = langid.held_out(F.col("doc_id"), 5, 0)
    learn = docs.select("doc_id", "text").where(~held).join(labels.select("doc_id", "quality"), "doc_id")
    model = pairwise_quality.fit(learn)
    found = pairwise_quality.scored(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= pairwise_quality.THRESHOLD).cast("int").alias("predicted"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select("doc.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.search(impact_index.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row counts as one of the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rp_forest": op1_rp_forest,
    "op2_resharding": op2_resharding,
    "op3_language_id": op3_language_id,
    "op4_parity_join": op4_parity_join,
    "op5_wavelet_tokens": op5_wavelet_tokens,
    "op6_bpe": op6_bpe,
    "op7_mixing": op7_mixing,
    "op8_pairwise_quality": op8_pairwise_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_impact_search": op12_impact_search,
    "op13_hard_negatives": op13_hard_negatives,
}

_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

ORACLE_SQL: dict[str, str] = {
    "op11_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, 500 * j AS base, h[1000 * j + 1:1000 * j + 1098] AS c FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 450) // 500)) AS j FROM d)),
w AS (SELECT doc_id, base + i AS i, md5(c[2 * i + 1:2 * i + 100]) AS w FROM (SELECT doc_id, base, c, unnest(range(0, len(c) // 2 - 49)) AS i FROM c)),
f AS (SELECT w, min(doc_id) AS doc_id FROM w GROUP BY w),
g AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS before FROM w JOIN f ON w.w = f.w AND f.doc_id < w.doc_id),
r AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM s),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS last, string_agg(h[2 * last + 1:2 * a], '' ORDER BY a) AS kept
      FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE kept || h[2 * last + 1:] END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
    "op12_impact_search": rf"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
z AS (SELECT doc_id, sum(tf)::BIGINT AS size FROM t GROUP BY doc_id),
a AS (SELECT count(*) AS docs, sum(size)::BIGINT AS total FROM z),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), a),
q AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * docs) // total))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN w USING (term) JOIN z USING (doc_id), a GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
""",
    "op13_hard_negatives": r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
    "op10_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS j FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]'))) AS n_latin
      FROM w LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
            OR word_chars / n_words < 2 OR word_chars / n_words > 30 OR n_symbols / n_words > 0.3
            OR (n_words >= 50 AND 2 * n_latin >= n_words AND n_stop / n_words < 0.005) OR (n_lines > 0 AND n_dup_lines / n_lines > 0.6)) AS kept
FROM m
""",
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 15))::BIGINT AS place FROM documents),
s0 AS (SELECT source, sum(size)::HUGEINT AS ss FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM s0),
s2 AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * ss AS cap FROM s1),
s3 AS (SELECT *, (sum(ss) OVER () - coalesce(sum(cap) OVER t, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER t, 0)) AS level,
             row_number() OVER (ORDER BY cap::DOUBLE / w, pos) AS o
       FROM s2 WINDOW t AS (ORDER BY cap::DOUBLE / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, cap::DOUBLE / w > level AS free FROM s3),
s5 AS (SELECT *, CASE WHEN free THEN (SELECT arg_min(level, o) FROM s4 WHERE free) * w ELSE cap::DOUBLE END AS target FROM s4),
s6 AS (SELECT *, round(target)::BIGINT AS len, least(1048576, greatest(64, (sum(ss) OVER ()) // 131072))::BIGINT AS b FROM s5),
s7 AS (SELECT *, (len + b - 1) // b AS k, (sum((len + b - 1) // b) OVER (ORDER BY pos))::BIGINT AS hi FROM s6),
s8 AS (SELECT *, length(bin(greatest(1, (SELECT max(hi) FROM s7) - 1))) AS bits FROM s7),
v AS (SELECT pos, list_sum(list_transform(range(bits), lambda i: ((id >> i) & 1) << (bits - 1 - i)))::BIGINT AS turn
      FROM (SELECT pos, bits, unnest(range(hi - k, hi)) AS id FROM s8)),
turns AS (SELECT pos, turn, row_number() OVER (PARTITION BY pos ORDER BY turn) - 1 AS block FROM v),
p AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
q AS (SELECT row_number() OVER () AS i, doc_id, size, ss, target, pos, b, len, start FROM p JOIN s8 ON p.source IS NOT DISTINCT FROM s8.source),
c AS (SELECT i, pos, b, unnest([0, 1, 2]) * ss + start AS lo, size, len FROM q WHERE size > 0),
e AS (SELECT i, pos, b, lo, least(lo + size, len) AS hi FROM c WHERE lo < len),
f AS (SELECT i, pos, b, lo, hi, unnest(range((lo // b)::BIGINT, ((hi - 1) // b)::BIGINT + 1)) AS block FROM e),
g AS (SELECT i, sum(least(hi, (f.block + 1) * b) - greatest(lo, f.block * b)) AS taken, min(turn) AS first_turn, count(*) AS n_pieces
      FROM f JOIN turns USING (pos, block) GROUP BY i)
SELECT doc_id, size, ss::BIGINT AS source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_turn, coalesce(n_pieces, 0) AS n_pieces
FROM q LEFT JOIN g USING (i)
""",
}

"""The pipeline's stages against plain versions of them, each on its own input."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from cairn.llm import line_dedup, mixing, queries
from cairn.llm.common import saved

tokenizers = __import__("tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(saved(stage(spark, seen[-1], sf), name))
    raw, ruled, lined, joined, mixed, encoded = seen
    assert all(x.columns == columns for x in (ruled, lined, joined, mixed))

    judged = {r.doc_id: r.kept for r in queries.op10_quality_rules(spark, sf).collect()}
    assert sorted(r.doc_id for r in ruled.collect()) == sorted(i for i, kept in judged.items() if kept)

    before, after = {r.doc_id: r for r in ruled.collect()}, {r.doc_id: r for r in lined.collect()}
    assert set(before) == set(after)
    first: dict[str, tuple[int, int]] = {}

    def form(line: str) -> str:
        return re.sub("[0-9]+", "0", re.sub(r"[\W_]+", " ", line.lower())).strip(" ")

    for i in sorted(before):
        for k, line in enumerate(before[i].text.split("\n")):
            first.setdefault(form(line), (i, k))
    kept = Counter()
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        own = before[i].text.split("\n")
        rest = r.text.split("\n") if r.text else []
        # no line is made up, and lines that stand nowhere else and near nothing stay
        assert not Counter(rest) - Counter(own)
        kept.update(form(x) for x in rest)
    assert all(n == 1 for x, n in kept.items() if len(x.split(" ")) >= line_dedup.MIN_WORDS)

    sets = {}
    for i, r in after.items():
        w = WORD.findall(r.text.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    stay = {r.doc_id for r in joined.collect()}
    for i in set(sets) - stay:
        assert any(j < i and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]) or j in set(sets) - stay for j in sets if j != i)
    for i in stay:
        assert not any(j in stay and j != i and sets[i] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]) for j in sets)

    copies = Counter(r.doc_id for r in mixed.collect())
    plan, _ = mixing.mix(joined)
    for r in plan.collect():
        assert copies[r.doc_id] == (-(-r.taken // r.size) if r.taken else 0)

    whole = tokenizers.Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    rows = encoded.collect()
    assert Counter(r.doc_id for r in rows) == copies
    assert all(r.ids == whole.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_on_odd_documents(spark):
    """Null texts and columns, repeated rows, columns with working names, and an empty table."""
    text = "A line of some clean words that is long enough to be kept by the rules.\nAnd another one of the same kind."
    rows = [(None, None, None, None), (1, text, "en", "a"), (1, text, "en", "a"), (2, "", None, None), (3, None, "en", "a"), (4, text.replace("clean", "tidy"), None, None)]
    odd = spark.createDataFrame([(*r, 0, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _qw int, turn string")
    for docs in (odd, odd.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = saved(stage(spark, docs, ""), name)
            assert docs.columns == columns
        ids = [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()]
        assert set(ids) <= {1, 4} and (1 in ids or docs.isEmpty())

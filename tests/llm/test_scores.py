"""Scores of language and quality: a plain naive Bayes, equal texts, clashing names, rows without an id."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from cairn.llm import langid, pairwise_quality


def buckets(text: str) -> list[int]:
    return [int(b) for found, _ in langid.grams([text])[0] for b in found]


def corpus() -> list[tuple[str, str]]:
    rng = random.Random(11)
    letters = {"aa": "abcdeé", "bb": "cdefgh", "cc": "efghijß"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7)))
    return [(lang, " ".join(word(lang) for _ in range(rng.randint(1, 60)))) for lang in rng.choices(list(letters), [5, 3, 1], k=150)]


def test_plain_naive_bayes(spark):
    rows = corpus()
    learn, ask = rows[:100], rows[100:] + [("aa", ""), ("aa", "12 34"), ("aa", "zq"), ("aa", rows[0][1])]
    model = langid.fit(spark.createDataFrame(learn, "lang string, text string").repartition(3))
    counts = {lang: Counter(b for own, t in learn if own == lang for b in buckets(t)) for lang in {lang for lang, _ in learn}}
    total = {lang: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for lang, c in counts.items()}
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ask)] + [(None, ask[0][1]), (900, None)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    for i, (_, text) in enumerate(ask):
        if not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0)
            continue
        logs = {lang: sum(math.log((counts[lang][b] + langid.SMOOTHING) / total[lang]) for b in buckets(text)) for lang in counts}
        top = max(logs.values())
        assert logs[got[i][0]] >= top - 1e-9
        assert abs(got[i][1] - 1 / sum(math.exp(v - top) for v in logs.values())) < 1e-9
    assert got[None] == got[0] and got[900] == ("und", 0.0)


def test_equal_texts_have_equal_scores(spark):
    """Wherever they stand, and with columns named as results or working columns."""
    rng = random.Random(12)
    filler = [t for _, t in corpus()]
    same = filler[3] + " " + filler[4]
    texts = []
    for t in filler:
        texts += [t] * rng.randint(0, 2) + [same] * (rng.random() < 0.4)
    rows = [(i, t, 0.5, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, lang_pred string, key int").coalesce(1)
    learn = spark.createDataFrame([(lang, t, i % 2) for i, (lang, t) in enumerate(corpus())], "lang string, text string, quality int")
    wanted = [i for i, t in enumerate(texts) if t == same]
    assert len(wanted) > 20
    by_lang = {r.doc_id: r.score for r in langid.predict(docs, langid.fit(learn)).collect()}
    by_quality = {r.doc_id: r.score for r in pairwise_quality.scored(docs, pairwise_quality.fit(learn)).collect()}
    assert len({by_lang[i] for i in wanted}) == 1 and len({by_quality[i] for i in wanted}) == 1
    w = np.random.default_rng(1).normal(size=pairwise_quality.SIZE)
    alone = pairwise_quality.raw_scores(pa.array([same]), w)[0]
    assert set(pairwise_quality.raw_scores(pa.array([*texts]), w)[wanted]) == {alone}
    none = spark.createDataFrame([(None, same), (1, same)], "doc_id long, text string")
    assert len({r.score for r in pairwise_quality.scored(none, pairwise_quality.fit(learn)).collect()}) == 1
    assert langid.predict(docs.where(F.lit(False)), langid.fit(learn)).count() == 0

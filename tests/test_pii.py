"""The catalogue of identifiers: labels, groups and overlaps."""

from __future__ import annotations

from cairn.functions import text as X
from cairn.plans import queries


def test_catalogue(spark, tmp_path):
    cases = [
        ("write to jo@ex.org", [("EMAIL", "jo@ex.org")]), ("call +61 2 9876 5432", [("PHONE", "+61 2 9876 5432")]), ("call 0412345678", [("PHONE", "0412345678")]), ("call +44 20 7946 0958", [("PHONE", "+44 20 7946 0958")]),
        ("abn 51 824 753 556", [("ABN", "51 824 753 556")]), ("acn 123 456 780", [("ACN", "123 456 780")]), ("medicare 2123 45670 1", [("MEDICARE", "2123 45670 1")]),
        ("nhs 943 476 5919", [("NHS_NUMBER", "943 476 5919")]), ("ni ab 12 34 56 c", [("NI_NUMBER", "ab 12 34 56 c")]), ("at SW1A 1AA", [("POSTCODE", "SW1A 1AA")]), ("at NSW 2000", [("POSTCODE", "NSW 2000")]),
        ("bsb 123-456 12345678", [("BANK_ACCOUNT", "123-456 12345678")]), ("iban GB82WEST12345698765432", [("BANK_ACCOUNT", "GB82WEST12345698765432")]), ("card 4111 1111 1111 1111", [("CARD_NUMBER", "4111 1111 1111 1111")]),
        ("file 1386119/1", [("CASE_REFERENCE", "1386119/1")]), ("REF: 2026-004512", [("CASE_REFERENCE", "2026-004512")]), ("DOB: 1/2/1980", [("DATE_OF_BIRTH", "1/2/1980")]), ("room 12 in 1999", []), (None, []),
    ]
    assert len(X.PII) == 16 and len({label for label, _, _ in X.PII}) == 12
    rows = [(i, text) for i, (text, _) in enumerate(cases)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.pii_resolved(spark, str(tmp_path)).collect():
        text, want = cases[r.doc_id]
        assert [(a["label"], a["text"]) for a in r.annotations] == want, text
        assert all(text[a["start"] : a["end"]] == a["text"] for a in r.annotations)


def test_texts_without_cues(spark, sf):
    """Leaving out texts that hold neither a digit nor an @ changes nothing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "call 0412 3456 78 or a@b.org"), (-4, "DOB ٣/٤/١٩٩٩")], "doc_id long, text string"))
    rows = lambda **how: sorted(map(repr, X.spans(docs, X.PII, **how).collect()))
    assert rows() == rows(cue=X.PII_CUE)

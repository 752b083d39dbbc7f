"""Text functions as columns: redaction, names, HTML, types of files, chunks, word pieces."""

from __future__ import annotations

import bisect
import re
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Macro:
    pattern: str
    replacement: str


def redacted(text: Column, macros: Sequence[Macro]) -> Column:
    """Replacements one after the other, each on what the earlier ones left."""
    for m in macros:
        text = F.regexp_replace(text, m.pattern, m.replacement)
    return text


def hits(text: Column, macros: Sequence[Macro]) -> Column:
    """All that the patterns find in the original text, with the replacement of each, in pattern order."""

    def of(m: Macro) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(m.pattern), F.lit(0)), lambda s: F.struct(s.alias("text"), F.lit(m.replacement).alias("replacement")))

    return F.flatten(F.array(*map(of, macros)))


def _plain_letters(text: pd.Series) -> pd.Series:
    """ASCII letters of compatible forms; what has none is left out."""
    decomposed = pc.utf8_normalize(pa.array(text, pa.string()), "NFKD")
    return pd.Series(pc.replace_substring_regex(decomposed, r"[^\x00-\x7F]+", "").to_pylist())


def slug(text: Column, most: int = 60) -> Column:
    """ASCII words joined by hyphens in lower case, cut at a word's end."""
    plain = F.pandas_udf(_plain_letters, T.StringType())(F.coalesce(text, F.lit("")))
    joined = F.regexp_replace(F.lower(F.regexp_replace(plain, "[^A-Za-z0-9]+", "-")), "^-+|-+$", "")
    head = F.substring(joined, 1, most)
    whole = (F.length(joined) <= most) | (F.substring(joined, most + 1, 1) == "-")
    return F.regexp_replace(F.when(whole, head).otherwise(F.regexp_replace(head, "-[^-]*$", "")), "-+$", "")


#: Markings in brackets, and what mail programs put before a subject.
_MARKING = r"(?i)\[\s*(?:SEC|DLM|ACCESS|CAVEAT)\s*=[^\]]*\]"
_REPLY = r"(?i)^(?:\s*(?:re|fw|fwd|aw|sv|vs|antw)\s*(?:\[\d+\])?\s*:)+"


def file_subject(text: Column, most: int = 120) -> Column:
    """A subject as a file name may carry it: no markings and reply signs, ASCII letters and digits, hyphens between."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _MARKING, " "), _REPLY, " ")
    joined = F.trim(F.regexp_replace(F.pandas_udf(_plain_letters, T.StringType())(bare), "[^0-9A-Za-z]+", "-"), F.lit("-"))
    return F.trim(F.substring(joined, 1, most), F.lit("-"))


def name_rest(name: Column) -> Column:
    """A file name in small letters without the letters and digits that it begins with."""
    return F.lower(F.regexp_replace(name, "^[a-zA-Z0-9]+", ""))


def first_line(text: Column, least: int = 12, most: int = 120) -> Column:
    """The first line that reads like a title: long enough, no page number or contents, not of numbers; else the start."""
    # fixed value: lines that are no titles
    stop = r"(?i)^(page \d+ of \d+|contents|table of contents|official[: ].*)$"
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r\f]"), stripped), lambda x: (F.length(x) >= least) & ~x.rlike(stop) & ~x.rlike(r"^[\d\s.\-–]+$"))
    return F.coalesce(F.get(lines, F.lit(0)), F.substring(stripped(F.regexp_replace(text, r"\s+", " ")), 1, most))


def year_of(text: Column) -> Column:
    """The first year from 1990 to 2099 in the first 600 characters, null without one."""
    # fixed values: the years and how far they are sought
    return F.nullif(F.regexp_extract(F.substring(text, 1, 600), r"\b(199[0-9]|20[0-9]{2})\b", 1), F.lit(""))


def archive_name(prefix: Column, text: Column, pages: Column, most: int = 60, created: Column | None = None, title: Column | None = None, stem: Column | None = None, full_date: bool = False) -> Column:
    """prefix-date-slug-pages, without the parts that are missing.

    The date is the given one (a year, or with full_date the day), else the first year on the first page; the subject is a
    title of over eight characters, else the first line like one. A text without words is a scan: SCAN-stem-pages.
    """
    page = F.substring_index(text, "\f", 1)
    size = F.concat(pages.cast("string"), F.lit("pp"))
    none = F.lit(None).cast("string")
    date = F.coalesce(F.nullif(F.substring(created, 1, 10 if full_date else 4), F.lit("")) if created is not None else none, year_of(page))
    subject = F.when(F.length(title) > 8, title).otherwise(first_line(page)) if title is not None else first_line(page)
    named = F.concat_ws("-", prefix, date, F.coalesce(F.nullif(slug(subject, most), F.lit("")), F.lit("without-title")), size)
    return F.when(stripped(F.coalesce(text, F.lit(""))) == "", F.concat_ws("-", F.lit("SCAN"), stem if stem is not None else none, size)).otherwise(named)


_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def stripped(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.trim(text, F.lit(" \t\n\x0b\f\r\xa0"))


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles go, breaks and blocks end lines, other tags are spaces, blanks are squeezed."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, sign in _ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(sign))
    c = F.regexp_replace(c, r"[ \t\x0B\f\r]+", " ")
    return stripped(F.regexp_replace(F.regexp_replace(c, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def html_links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"'#]+)["']"""), F.lit(1)))


#: Name by first bytes (hexadecimal) of a file.
MAGIC = {"255044462D": "PDF", "89504E470D0A1A0A": "PNG", "FFD8FF": "JPEG", "47494638": "GIF", "49492A00": "TIFF", "4D4D002A": "TIFF", "424D": "BMP", "4F5243": "ORC", "50415231": "PARQUET", "4F626A01": "AVRO", "D0CF11E0A1B11AE1": "XLS", "504B0304": "ZIP", "1F8B": "GZIP"}


def file_type_of_bytes(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 8))
    out = F.lit("UNKNOWN")
    for magic, name in sorted(MAGIC.items(), key=lambda kv: len(kv[0])):
        out = F.when(F.startswith(head, F.lit(magic)), name).otherwise(out)
    return out


#: The type that a suffix names.
SUFFIXES = {
    ".avro": "AVRO", ".bmp": "BMP", ".csv": "CSV", ".doc": "DOC", ".docx": "DOCX", ".gif": "GIF", ".graph": "GRAPH", ".htm": "HTML", ".html": "HTML", ".jpeg": "JPEG", ".jpg": "JPEG",
    ".json": "JSON", ".jsonl": "JSON", ".jsonld": "GRAPH", ".log": "LOG", ".markdown": "MARKDOWN", ".md": "MARKDOWN", ".nt": "GRAPH", ".orc": "ORC", ".pb": "PROTOBUF", ".pdf": "PDF", ".pickle": "PICKLE",
    ".pkl": "PICKLE", ".png": "PNG", ".protobuf": "PROTOBUF", ".rdf": "GRAPH", ".rss": "RSS", ".tif": "TIFF", ".tiff": "TIFF", ".tsv": "CSV", ".ttl": "GRAPH", ".txt": "TXT", ".xls": "XLS", ".xlsx": "XLS",
}


def file_type_of_name(uri: Column) -> Column:
    """The type that a path's or URI's suffix names, in any case; UNKNOWN without one. What follows ? or # is no part of it."""
    suffix = F.lower(F.regexp_extract(uri, r"^[^?#]*?(\.[^./\\?#]+)(?:[?#].*)?$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), suffix), F.lit("UNKNOWN"))


def accepts(suffix: Column, *types: str) -> Column:
    """Whether a suffix names one of the types (of any, if none is given)."""
    return F.lower(F.coalesce(suffix, F.lit(""))).isin(*[s for s, kind in SUFFIXES.items() if not types or kind in types])


def file_type_of_text(text: Column) -> Column:
    """XML, HTML, JSON, log, delimited, Markdown or plain text, by what the first lines look like."""
    head = F.ltrim(F.substring(text, 1, 4000))
    lines = F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, 20)
    logged = F.size(F.filter(lines, lambda x: x.rlike(r"^\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\b(ERROR|WARN|WARNING|INFO|DEBUG)\b")))
    log = logged >= F.greatest(F.lit(2), F.floor(F.size(lines) / 2).cast("int"))
    ten = F.slice(lines, 1, 10)

    def even(sign: str) -> Column:
        """The first line has the sign, and the first ten have at most two different numbers of it."""
        counts = F.transform(ten, lambda x: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit(""))))
        return (F.size(ten) > 1) & (F.size(F.array_distinct(counts)) <= 2) & (F.get(counts, F.lit(0)) > 0)

    return (
        F.when(F.trim(text) == "", "TXT")
        .when(head.rlike(r"(?i)^<!doctype html|^<html"), "HTML")
        .when(F.startswith(head, F.lit("<?xml")) | head.rlike(r"^<[A-Za-z][\w:.-]*[^<>]*>"), "XML")
        .when(head.rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull(), "JSON")
        .when(head.rlike(r"(?m)^#{1,6} \S|^```"), "MARKDOWN")
        .when(log, "LOG")
        .when(even(",") | even(";") | even("\t"), "CSV")
        .otherwise("TXT")
    )


#: Fixed value: where a sentence or a paragraph ends.
SENTENCE_END = r"(?<=[.!?])\s+|\n{2,}"


def sentence_chunks(text: Column, most: int = 1800) -> Column:
    """Sentences and paragraphs packed greedily into chunks of at most `most` characters (at least 200).

    A text that fits is one chunk, unchanged; a sentence that is longer stands alone. The packing is a fold over the
    sentences, from one running length to the next, so it stays a column expression.
    """
    most = max(most, 200)
    sentences = F.filter(F.split(text, SENTENCE_END), lambda s: stripped(s) != "")
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(a: Column, s: Column) -> Column:
        new = (a["n"] > 0) & (a["n"] + F.length(s) + 1 > most)
        at = F.when((a["i"] == 0) | new, F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"])
        # a chunk's first sentence counts without the space that joins it, once another chunk went before
        n = F.when(new, F.length(s)).otherwise(a["n"] + F.length(s) + 1)
        return F.struct(at.alias("at"), n.alias("n"), (a["i"] + 1).alias("i"))

    def packed(sentences: Column, cuts: Column) -> Column:
        ends = F.concat(F.slice(cuts["at"], 2, F.greatest(F.size(cuts["at"]), F.lit(1))), F.array(cuts["i"]))
        return F.transform(F.arrays_zip(cuts["at"].alias("a"), ends.alias("b")), lambda c: F.array_join(F.slice(sentences, c["a"] + 1, c["b"] - c["a"]), " "))

    def chunks(sentences: Column) -> Column:
        whole = F.get(F.transform(F.array(F.aggregate(sentences, start, step)), lambda cuts: packed(sentences, cuts)), F.lit(0))
        return F.when(F.size(sentences) == 0, F.array().cast("array<string>")).otherwise(whole)

    # the sentences and their cuts are variables of inner functions, so that they are found once and not for each chunk
    found = F.get(F.transform(F.array(sentences), chunks), F.lit(0))
    return F.when(F.length(text) <= most, F.array(text)).when(text.isNotNull(), found)


def split_words(tokens: DataFrame, known: DataFrame, least: int = 12, longest: int = 24) -> DataFrame:
    """token and pieces: run-together tokens of at least `least` letters cut into known words, the likeliest way.

    known: word and score (a log-probability); words of one letter count only if listed. The word table goes to all
    executors and is refused beyond a million words. Tokens that cannot be cut into known words stay whole.
    """
    rows = known.limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("more than a million words")
    held = tokens.sparkSession.sparkContext.broadcast({r["word"]: float(r["score"]) for r in rows})

    def best(token: str) -> list[str]:
        if len(token) < least or token in held.value:
            return [token]
        score: list[float | None] = [0.0]
        back = [0]
        for i in range(1, len(token) + 1):
            ways = [(score[j] + held.value[token[j:i]], j) for j in range(max(0, i - longest), i) if score[j] is not None and token[j:i] in held.value]
            top = max(ways, default=(None, 0), key=lambda w: w[0])
            score.append(top[0])
            back.append(top[1])
        if score[-1] is None:
            return [token]
        out, i = [], len(token)
        while i:
            out.append(token[back[i] : i])
            i = back[i]
        return out[::-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"token": b["token"], "pieces": [best(t) for t in b["token"]]})

    return tokens.select("token").distinct().mapInPandas(run, "token string, pieces array<string>")


#: Identifiers of British and Australian letters: label, pattern, and the group that is the span. Case does not count.
PII = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0),
    ("PHONE", r"(?:\+61[\s-]?|0)[2-478][\s-]?\d{4}[\s-]?\d{4}", 0),
    ("PHONE", r"(?:\+44[\s-]?|0)\d{2,5}[\s-]?\d{3,4}[\s-]?\d{3,4}", 0),
    ("ABN", r"\b\d{2}[\s]?\d{3}[\s]?\d{3}[\s]?\d{3}\b", 0),
    ("ACN", r"\b\d{3}[\s]\d{3}[\s]\d{3}\b", 0),
    ("MEDICARE", r"\b\d{4}[\s]?\d{5}[\s]?\d(?:[/-]\d)?\b", 0),
    ("NHS_NUMBER", r"\b\d{3}[\s-]\d{3}[\s-]\d{4}\b", 0),
    ("NI_NUMBER", r"\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", 0),
    ("POSTCODE", r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b", 0),
    ("POSTCODE", r"\b(?:NSW|VIC|QLD|SA|WA|TAS|NT|ACT)\s+\d{4}\b", 0),
    ("BANK_ACCOUNT", r"\b\d{3}-\d{3}\s?\d{6,10}\b", 0),
    ("BANK_ACCOUNT", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0),
    ("CARD_NUMBER", r"\b(?:\d{4}[\s-]){3}\d{4}\b", 0),
    ("CASE_REFERENCE", r"\b\d{6,9}/\d{1,3}\b", 0),
    ("CASE_REFERENCE", r"\b(?:ref(?:erence)?|case|claim|matter)\b\W{0,6}([A-Z]{0,4}[-/]?\d[A-Z0-9/-]{3,20})\b", 1),
    ("DATE_OF_BIRTH", r"(?:d\.?o\.?b\.?|date of birth)\W{0,10}(\d{1,2}\W\d{1,2}\W\d{2,4})", 1),
)


#: What a text must hold for any of PII to match.
PII_CUE = r"[\p{Nd}@]"


def spans(docs: DataFrame, patterns: Sequence[tuple[str, str, int]], priority: int = 20, source: str = "catalogue", cue: str | None = None) -> DataFrame:
    """doc_id and annotations: start, end, label, text, source and priority of all that the patterns find, overlaps settled.

    patterns: label, pattern and the group that is the span (0: all); case does not count. Blanks at a span's end are cut.
    Higher priority wins, then the longer, then the earlier; what stays is sorted by start. Offsets count code points. A
    pattern that does not compile is left out with a warning. cue: a pattern without which none of the others can match; texts
    without it do not go to Python.
    """
    compiled(patterns, warn=True)
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    kind = "array<struct<start:int,end:int,label:string,text:string,source:string,priority:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = compiled(patterns)
        for b in batches:
            out = []
            for t in b["text"]:
                hit = [(m.start(group), m.group(group).strip(), label) for label, r, group in ready for m in r.finditer(t or "")]
                found = [(start, start + len(s), label, s, source, priority) for start, s, label in hit if s]
                out.append([dict(zip(("start", "end", "label", "text", "source", "priority"), s)) for s in settled(found)])
            yield pd.DataFrame({"doc_id": b["doc_id"], "annotations": out})

    if cue is None:
        return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {doc_kind}, annotations {kind}")
    may = F.coalesce(F.col("text").rlike(cue), F.lit(False))
    found = docs.where(may).select("doc_id", "text").mapInPandas(run, f"doc_id {doc_kind}, annotations {kind}")
    return found.unionByName(docs.where(~may).select("doc_id", F.array().cast(kind).alias("annotations")))


def name_terms(names: Column, least: int = 4) -> Column:
    """What a list of names vouches for: each full name, and each part of at least `least` letters."""

    def of(name: Column) -> Column:
        clean = stripped(F.regexp_replace(name, r"[^A-Za-z' -]+", " "))
        parts = F.filter(F.split(clean, r"[\s-]+"), lambda p: F.length(p) >= least)
        return F.when(F.size(parts) > 1, F.concat(F.array(clean), parts)).otherwise(parts)

    return F.array_distinct(F.flatten(F.transform(names, of)))


def name_of_address(address: Column) -> Column:
    """The name that a structured local part carries (john.smith), null without one."""
    local = F.substring_index(address, "@", 1)
    return F.when(local.rlike(r"^[A-Za-z]+(\.[A-Za-z]+)+$"), F.array_join(F.transform(F.split(local, r"\."), F.initcap), " "))


def envelope_terms(addresses: Column, names: Column) -> Column:
    """(surface, label, cased) that a message's envelope vouches for: addresses in any case, names as written."""
    known = F.array_distinct(F.filter(addresses, lambda a: F.contains(a, F.lit("@"))))
    every = F.concat(F.filter(names, lambda n: n != ""), F.array_compact(F.transform(known, name_of_address)))
    mails = F.transform(known, lambda a: F.struct(a.alias("surface"), F.lit("EMAIL").alias("label"), F.lit(False).alias("cased")))
    people = F.transform(name_terms(every), lambda n: F.struct(n.alias("surface"), F.lit("PERSON").alias("label"), F.lit(True).alias("cased")))
    return F.concat(mails, people)


def annotated(docs: DataFrame, patterns: Sequence[tuple[str, str, int]], terms: str | None = None, entities: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """As `spans`, over three sources: the envelope (column `terms`, as of `envelope_terms`; priority 40), the catalogue of
    patterns (20) and a table of entities (label, pattern; 10). A null text has no annotations."""
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    table = compiled([(label, p, 0) for label, p in entities], warn=True)
    compiled(patterns, warn=True)

    def found(text: str, own: Sequence[dict] | None, ready: list, others: list) -> list[tuple]:
        out = []
        for term in own if own is not None else ():
            if term["surface"]:
                surface = re.compile(rf"(?<![\w@.]){re.escape(term['surface'])}(?![\w@.])", 0 if term["cased"] else re.IGNORECASE)
                out += [(*m.span(), term["label"], m.group(), "envelope", 40) for m in surface.finditer(text)]
        for source, priority, some in (("catalogue", 20, ready), ("entity", 10, others)):
            for label, r, group in some:
                hit = [(m.start(group), m.group(group).strip()) for m in r.finditer(text)]
                out += [(a, a + len(s), label, s, source, priority) for a, s in hit if s]
        return settled(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = compiled(patterns)
        for b in batches:
            own = b["terms"] if terms else [None] * len(b)
            rows = [[dict(zip(("start", "end", "label", "text", "source", "priority"), s)) for s in found(t or "", o, ready, table)] for t, o in zip(b["text"], own)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "annotations": rows})

    columns = ["doc_id", "text", *([F.col(terms).alias("terms")] if terms else [])]
    return docs.select(*columns).mapInPandas(run, f"doc_id {doc_kind}, annotations array<struct<start:int,end:int,label:string,text:string,source:string,priority:int>>")


def page_triples(page: Column, url: Column, html: Column) -> Column:
    """Subject, predicate and object of what a page states: its URI, title, description, size, text and links."""
    title = stripped(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    about = F.regexp_extract(html, r"""(?is)<meta\s+name\s*=\s*["']description["']\s+content\s*=\s*["']([^"']*)["']""", 1)
    single = {"hasIdentifier": page.cast("string"), "hasUri": url, "hasTitle": title, "hasDescription": about, "hasFileSize": F.octet_length(html).cast("string"), "hasContent": html_text(html)}
    facts = F.array(*[F.struct(F.lit(p).alias("predicate"), o.alias("object")) for p, o in single.items()])
    links = F.transform(html_links(html), lambda x: F.struct(F.lit("hasLinks").alias("predicate"), x.alias("object")))
    return F.filter(F.concat(facts, links), lambda f: F.coalesce(f["object"], F.lit("")) != "")


_TERM = r"(<[^>]*>|_:\S+)"
_LITERAL = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'


def triples_of(line: Column) -> Column:
    """subject, predicate and object of a line of N-Triples, without angle brackets; null for comments and other lines."""
    whole = rf"^\s*{_TERM}\s+(<[^>]*>)\s+{_LITERAL}\s*\.\s*(?:#.*)?$"
    bare = lambda i: F.regexp_replace(F.regexp_extract(line, whole, i), r"^<|>$", "")
    return F.when(line.rlike(whole), F.struct(bare(1).alias("subject"), bare(2).alias("predicate"), F.regexp_extract(line, whole, 3).alias("object")))


def triple_line(subject: Column, predicate: Column, value: Column) -> Column:
    """A line of N-Triples with a literal."""
    for sign, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(sign), F.lit(written))
    return F.concat(F.lit("<"), subject, F.lit("> <"), predicate, F.lit('> "'), value, F.lit('" .'))


def log_fields(line: Column) -> Column:
    """time, level and message of a log line; time and level are null where it has none."""
    form = r"^\[?(\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?)?\S*\s*\[?(?:(CRITICAL|ERROR|WARNING|WARN|INFO|DEBUG|TRACE)\b)?[\]:]*\s*(.*)$"
    part = lambda i: F.nullif(F.regexp_extract(line, form, i), F.lit(""))
    return F.struct(part(1).alias("time"), part(2).alias("level"), F.regexp_extract(line, form, 3).alias("message"))


def hashed_name(created: Column, digest: Column) -> Column:
    """An archive's own name: date, time and the first 16 digits of the digest."""
    return F.concat(F.date_format(created, "yyyy-MM-dd-HHmmss"), F.lit("-"), F.lower(F.substring(digest, 1, 16)))


def is_hashed(stem: Column) -> Column:
    return stem.rlike(r"(?i)^\d{4}-\d{2}-\d{2}-\d{6}-[0-9a-f]{16}$")


def compiled(patterns: Sequence[tuple[str, str, int]], warn: bool = False) -> list[tuple[str, re.Pattern, int]]:
    out = []
    for label, pattern, group in patterns:
        try:
            out.append((label, re.compile(pattern, re.IGNORECASE), group))
        except re.error as e:
            if warn:
                warnings.warn(f"pattern of {label} left out: {e}", stacklevel=3)
    return out


def settled(found: Sequence[tuple]) -> list[tuple]:
    """Spans (start, end, ..., priority) that do not overlap, greedily by priority, length and start, then in the given order."""
    kept: list[tuple] = []
    for s in sorted(found, key=lambda s: (-s[5], s[0] - s[1], s[0])):
        at = bisect.bisect(kept, s[0], key=lambda k: k[0])
        if (at == 0 or kept[at - 1][1] <= s[0]) and (at == len(kept) or kept[at][0] >= s[1]):
            kept.insert(at, s)
    return kept

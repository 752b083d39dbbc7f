"""Records of documents as files: the text of each document's records in its target format, and annotations as training records.

Results for odd input: a document without records has no file; null values are empty fields, and null in JSON; an unknown format is
refused before anything runs; equal names are one file, of the least content (`sources.files`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import markup
from cairn.sources import files

#: Suffix of each format that records can be written in.
SUFFIXES = {"JSON": ".json", "CSV": ".csv", "TXT": ".txt", "LOG": ".log", "MARKDOWN": ".md", "XML": ".xml"}


def field(value: Column) -> Column:
    """A field of a CSV line (RFC 4180): quoted where it holds a comma, a quote or an end of line."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _cell(value: Column) -> Column:
    """A cell of a Markdown table: bars escaped, ends of lines as breaks."""
    return F.regexp_replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r\n|\r|\n", "<br>")


def line_of(columns: Sequence[str], format: str) -> Column:
    """One record as its part of a file."""
    c = [F.col(f"`{n}`") for n in columns]
    if format == "JSON":
        return F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    if format == "CSV":
        return F.concat_ws(",", *map(field, c))
    if format == "MARKDOWN":
        return F.concat(F.lit("| "), F.concat_ws(" | ", *map(_cell, c)), F.lit(" |"))
    if format == "XML":
        return markup.xml_of(columns)
    named = [F.concat(F.lit(f"{n}{': ' if format == 'TXT' else '='}"), F.coalesce(x.cast("string"), F.lit(""))) for n, x in zip(columns, c)]
    return F.concat_ws("\n" if format == "TXT" else " ", *named)


def _around(columns: Sequence[str], format: str, lines: Column) -> Column:
    head = {"CSV": ",".join('"' + n.replace('"', '""') + '"' if set(n) & set('",\r\n') else n for n in columns) + "\n", "MARKDOWN": "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"}.get(format, "")
    if format == "JSON":
        return F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))
    if format == "XML":
        return F.concat(F.lit("<records>"), F.array_join(lines, ""), F.lit("</records>"))
    return F.concat(F.lit(head), F.array_join(lines, "\n\n" if format == "TXT" else "\n"), F.lit("\n"))


def texts(records: DataFrame, document: str, order: str, columns: Sequence[str], format: str | Column = "JSON", slot: Column | None = None, formats: Sequence[str] = tuple(SUFFIXES)) -> DataFrame:
    """document, slot, format, name and text of the file of each document and slot.

    format: a name, or a column that has one in each record (a document's least one counts). slot: sets of records of one document that
    become files of their own, such as a quality report. The records of one document make one file and so one row.
    """
    unknown = [f for f in ([format] if isinstance(format, str) else formats) if f.upper() not in SUFFIXES]
    if unknown:
        raise ValueError(f"unknown record format {unknown[0]!r}; one of {sorted(SUFFIXES)}")
    used = [format.upper()] if isinstance(format, str) else [f.upper() for f in formats]
    kind = F.lit(used[0]) if isinstance(format, str) else F.upper(format)
    slot = F.lit("") if slot is None else F.coalesce(slot, F.lit(""))
    line = F.lit(None).cast("string")
    for f in used:
        line = F.when(F.col("_kind") == f, line_of(columns, f)).otherwise(line)
    made = records.withColumn("_kind", kind).withColumn("_slot", slot).withColumn("_line", line)
    one = made.groupBy(F.col(document), F.col("_slot").alias("slot")).agg(F.min("_kind").alias("format"), F.array_sort(F.collect_list(F.struct(order, "_line"))).alias("_all"))
    lines = F.transform("_all", lambda x: x["_line"])
    text, suffix = F.lit(None).cast("string"), F.lit("")
    for f in used:
        text = F.when(F.col("format") == f, _around(columns, f, lines)).otherwise(text)
        suffix = F.when(F.col("format") == f, SUFFIXES[f]).otherwise(suffix)
    name = F.concat(F.col(document).cast("string"), F.when(F.col("slot") != "", F.concat(F.lit("-"), "slot")).otherwise(""), suffix)
    return one.select(document, "slot", "format", name.alias("name"), text.alias("text"))


def written(records: DataFrame, folder: str, document: str, order: str, columns: Sequence[str], spread: bool = False, **how: object) -> DataFrame:
    """Write the files of `texts` to a folder, and return name, path, size and sha256 of each. spread: as in `files.write_each`."""
    return files.write_each(texts(records, document, order, columns, **how), folder, "name", "text", spread)


def training_record(doc_id: Column, filename: Column, text: Column, spans: Column, **meta: Column) -> Column:
    """A document's text with its labelled spans as one JSON record; of `meta` what is not null is kept."""
    kept = F.struct(*[v.alias(k) for k, v in meta.items()]) if meta else F.struct(F.lit(None).cast("string").alias("none"))
    return F.to_json(F.struct(doc_id.cast("string").alias("id"), F.coalesce(filename, F.lit("")).alias("filename"), F.coalesce(text, F.lit("")).alias("text"), spans.alias("spans"), kept.alias("meta")))


def annotations(docs: DataFrame, folder: str, filename: str = "filename", meta: Sequence[str] = (), spread: bool = False) -> DataFrame:
    """Write one training record for each document (doc_id, text, annotations and the columns named), so that an interrupted write
    spoils no other; name, path, size and sha256 of each file."""
    record = training_record(F.col("doc_id"), F.col(filename), F.col("text"), F.col("annotations"), **{m: F.col(m) for m in meta})
    return files.write_each(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("name"), record.alias("text")), folder, "name", "text", spread)

"""XML and RSS as flat records, and records as XML and RSS, in columns.

A document is parsed once, by a small helper that Spark calls on Arrow batches; names lose their namespace. Results for odd
input: a null document or one that is not well formed has null records; a document without records has none.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.mail import moment

#: What joins the values of a repeated element.
SEPARATOR = "; "
_RECORDS = "array<map<string,string>>"
#: The fields of an RSS item and channel, and the Dublin Core names for two of them.
ITEM = ("title", "link", "description", "author", "category", "comments", "guid", "pubDate", "source")
CHANNEL = ("title", "link", "description", "language", "copyright", "pubDate", "lastBuildDate")
ENCLOSURE = ("url", "length", "type")
_ALIASES = {"creator": "author", "date": "pubDate"}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _fields(element: ElementTree.Element) -> dict[str, str]:
    """Text and attributes of an element and all below it, by dotted path; values of an equal path are joined."""
    found: dict[str, list[str]] = {}
    waiting = [("", element)]
    while waiting:
        path, e = waiting.pop()
        text = (e.text or "").strip()
        if text or not (len(e) or e.attrib):
            found.setdefault(path or _local(e.tag), []).append(text)
        front = f"{path}." if path else ""
        for name, value in e.attrib.items():
            found.setdefault(front + _local(name), []).append(value)
        waiting += [(front + _local(c.tag), c) for c in reversed(e)]
    return {k: SEPARATOR.join(filter(None, v)) for k, v in found.items()}


def _parse(text: str | None) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(text) if text else None
    except ElementTree.ParseError:
        return None


def xml_records(document: Column, record: str | None = None) -> Column:
    """The flat records of a document: of every element of that name, or of each child of the root."""

    def one(text: str | None) -> list[dict[str, str]] | None:
        root = _parse(text)
        if root is None:
            return None
        return [_fields(e) for e in (root.iter() if record else root) if not record or _local(e.tag) == record]

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return F.pandas_udf(run, _RECORDS)(document)


def _escaped(value: Column, quotes: bool = False) -> Column:
    signs = {"&": "&amp;", "<": "&lt;", ">": "&gt;"} | ({'"': "&quot;"} if quotes else {})
    for sign, written in signs.items():
        value = F.replace(value, F.lit(sign), F.lit(written))
    return value


def _tag(name: str, inner: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))


def xml_of(names: Sequence[str], record: str = "record") -> Column:
    """A row as an element: a column each, nested where its name has dots, left out where it is null."""
    tree: dict[str, object] = {}
    for name in names:
        at = tree
        *above, leaf = name.split(".")
        for part in above:
            at = at.setdefault(part, {})  # type: ignore[assignment]
        at[leaf] = F.col(f"`{name}`").cast("string")

    def inner(node: Mapping[str, object]) -> Column:
        parts: Iterator[Column] = ((_optional(k, inner(v)) if isinstance(v, Mapping) else _tag(k, _escaped(v))) for k, v in node.items())
        return F.concat_ws("", *parts)

    def _optional(name: str, content: Column) -> Column:
        return F.when(content != "", _tag(name, content))

    return _tag(record, inner(tree))


def iso_date(text: Column) -> Column:
    """An RFC 822 or ISO date as ISO 8601, with its offset where it has one; other text is kept."""
    at = moment(text)
    size = F.abs(at["offset_seconds"])
    offset = F.concat(F.when(at["offset_seconds"] < 0, "-").otherwise("+"), F.lpad(F.floor(size / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(size / 60 % 60).cast("string"), 2, "0"))
    return F.when(at["value"].isNull(), text).otherwise(F.concat(F.date_format(at["value"], "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce(offset, F.lit(""))))


def rfc822_date(text: Column) -> Column:
    """An ISO date as RSS wants it; other text is kept. A time without a zone is written as -0000."""
    at = moment(text)
    size = F.abs(at["offset_seconds"])
    offset = F.concat(F.when(at["offset_seconds"] < 0, "-").otherwise("+"), F.lpad(F.floor(size / 3600).cast("string"), 2, "0"), F.lpad(F.floor(size / 60 % 60).cast("string"), 2, "0"))
    return F.when(at["value"].isNull(), text).otherwise(F.concat(F.date_format(at["value"], "EEE, dd MMM yyyy HH:mm:ss "), F.coalesce(offset, F.lit("-0000"))))


def _feed(text: str | None) -> dict[str, object] | None:
    root = _parse(text)
    if root is None or _local(root.tag) not in ("rss", "RDF"):
        return None
    channel = next((c for c in root if _local(c.tag) == "channel"), None)
    if channel is None:
        return None

    def record(e: ElementTree.Element) -> dict[str, str]:
        found: dict[str, list[str]] = {}
        for c in e:
            name = _ALIASES.get(_local(c.tag), _local(c.tag))
            if name == "enclosure":
                found |= {f"enclosure_{k}": [v] for k in ENCLOSURE if (v := c.get(k)) is not None}
            elif name in (*ITEM, *CHANNEL):
                found.setdefault(name, []).append((c.text or "").strip())
        return {k: SEPARATOR.join(filter(None, v)) for k, v in found.items()}

    # items stand within the channel, in RSS 1.0 beside it
    items = [c for c in channel if _local(c.tag) == "item"] or [c for c in root if _local(c.tag) == "item"]
    return {"channel": record(channel), "items": [record(i) for i in items]}


def rss_feed(document: Column) -> Column:
    """channel and items of an RSS 0.9x, 1.0 or 2.0 document as maps; null for anything else. Dates are as written."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_feed(t) or {"channel": None, "items": None} for t in texts], columns=["channel", "items"])

    return F.pandas_udf(run, f"struct<channel:map<string,string>,items:{_RECORDS}>")(document)


def rss_item(item: Column) -> list[Column]:
    """A column for each field of an item (a map of `rss_feed`), null where it is missing; its date in ISO form."""
    get = lambda k: F.try_element_at(item, F.lit(k))
    return [(iso_date(get(k)) if k == "pubDate" else get(k)).alias(k) for k in ITEM] + [get(f"enclosure_{k}").alias(f"enclosure_{k}") for k in ENCLOSURE]


def rss_item_xml(names: Sequence[str]) -> Column:
    """A row with columns of an item's fields as an RSS 2.0 item: empty ones left out, a category for each part."""
    parts = []
    for k in ITEM:
        if k in names:
            value = F.col(k).cast("string")
            if k == "category":
                made = F.array_join(F.transform(F.split(value, SEPARATOR), lambda x: _tag("category", _escaped(x))), "")
            else:
                made = _tag(k, _escaped(rfc822_date(value) if k == "pubDate" else value))
            parts.append(F.when(value != "", made))
    if "enclosure_url" in names:
        pairs = [F.concat(F.lit(f' {k}="'), _escaped(F.coalesce(F.col(f"enclosure_{k}").cast("string"), F.lit("")), quotes=True), F.lit('"')) for k in ENCLOSURE if f"enclosure_{k}" in names]
        parts.append(F.when(F.col("enclosure_url") != "", F.concat(F.lit("<enclosure"), *pairs, F.lit(" />"))))
    return _tag("item", F.concat_ws("", *parts))

"""Printed mail: which layout of a mail program a page begins with, and the header lines it shows.

A layout is a row of a table: labels that must stand there and labels that may, how many at least, within how many lines the
block begins, and whether an address has to be among them. The lines of a page go through the layout one by one: a line with a
label goes on with the block, one line without is a folded value, two end it. The first layout of the table that fits, at its first line that
fits, counts. A layout of marks only fits any page that holds one of them.

Results for odd input: a null text has no block; blank lines do not count; labels stand in any case; lines that quote an older
message further down begin too late to count.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import mail

#: What ends a line.
_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_BLANK = r"^[\s\x{A0}]*$"


@dataclass(frozen=True)
class Layout:
    name: str
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    least: int = 3
    begins_within: int = 3
    addressed: bool = True
    marks: tuple[str, ...] = ()


#: The layouts known without configuration, the most particular first.
LAYOUTS = (
    Layout("outlook-print", required=("From", "Subject", "Sent"), optional=("To", "Cc", "Bcc", "Attachments"), least=3),
    Layout("apple-mail-print", required=("From", "Subject", "Date", "To"), optional=("Cc", "Bcc"), least=4),
    Layout("rfc-header-block", required=("From", "To"), optional=("Subject", "Date", "Cc", "Reply-To", "Message-ID", "Sent"), least=3),
    Layout("webmail-print", least=0, addressed=False, marks=(r"mail\.google\.com", r"outlook\.(office|live)\.com", r"mail\.yahoo\.")),
)
#: An address on a page.
ADDRESS = r"[\w.+-]+@[\w-]+\.[\w.]+"
_BLOCK = "struct<layout:string,lines:array<string>,labels:array<string>,addresses:int,start:int>"


def _walked(lines: Column, label: str) -> Column:
    """taken: how many lines the block has, last: up to its last label, labels: in order."""
    start = F.struct(F.lit(True).alias("open"), F.lit(0).alias("gap"), F.lit(0).alias("taken"), F.lit(0).alias("last"), F.array().cast("array<string>").alias("labels"))

    def step(s: Column, line: Column) -> Column:
        hit = line.rlike(label)
        goes_on = s["open"] & (hit | (s["gap"] == 0))
        taken = s["taken"] + goes_on.cast("int")
        labels = F.when(goes_on & hit, F.array_append(s["labels"], F.regexp_extract(line, label, 1))).otherwise(s["labels"])
        return F.struct(goes_on.alias("open"), F.when(hit, 0).otherwise(s["gap"] + 1).alias("gap"), taken.alias("taken"), F.when(goes_on & hit, taken).otherwise(s["last"]).alias("last"), labels.alias("labels"))

    return F.aggregate(lines, start, step)


def _fits(lines: Column, layout: Layout) -> Column:
    """The block of one layout, null where none begins in time."""
    names = "|".join(re.escape(x) for x in (*layout.required, *layout.optional))
    label = rf"(?i)^\s*({names})\s*:"

    def at(start: Column) -> Column:
        rest = F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))

        def judged(w: Column) -> Column:
            low = F.transform(w["labels"], F.lower)
            found = F.size(F.array_distinct(F.regexp_extract_all(F.array_join(F.slice(rest, 1, w["taken"]), "\n"), F.lit(f"({ADDRESS})"), F.lit(1))))
            good = (F.size(w["labels"]) >= layout.least) & ((found >= 1) | F.lit(not layout.addressed))
            for name in layout.required:
                good = good & F.array_contains(low, name.lower())
            block = F.struct(F.lit(layout.name).alias("layout"), F.slice(rest, 1, w["last"]).alias("lines"), w["labels"].alias("labels"), found.alias("addresses"), start.alias("start"))
            return F.when(good, block)

        first = F.coalesce(F.get(lines, start).rlike(label), F.lit(False))
        return F.when(first, F.get(F.transform(F.array(_walked(rest, label)), judged), F.lit(0)))

    tried = F.transform(F.sequence(F.lit(0), F.lit(layout.begins_within - 1)), at)
    return F.get(F.filter(tried, lambda b: b.isNotNull()), F.lit(0))


def header_block(text: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """layout, lines, labels, addresses (how many different ones) and start of the block that a page begins with; null without one."""

    def of(lines: Column) -> Column:
        tries = []
        for layout in layouts:
            if layout.required or layout.optional:
                tries.append(_fits(lines, layout))
            elif layout.marks:
                bare = F.struct(F.lit(layout.name).alias("layout"), F.array().cast("array<string>").alias("lines"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("addresses"), F.lit(-1).alias("start"))
                tries.append(F.when(F.array_join(lines, "\n").rlike("(?i)" + "|".join(layout.marks)), bare))
        return F.coalesce(*[t.cast(_BLOCK) for t in tries]) if tries else F.lit(None).cast(_BLOCK)

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda x: ~x.rlike(_BLANK))
    return F.get(F.transform(F.array(lines), of), F.lit(0))


def shown(block: Column, *labels: str) -> Column:
    """The value of the first of these labels that a block has, folded lines joined to it; null without it."""
    any_label = r"^\s*[A-Za-z][\w-]*\s*:"
    own = rf"(?i)^\s*(?:{'|'.join(re.escape(x) for x in labels)})\s*:\s*"
    start = F.struct(F.lit(0).alias("state"), F.lit("").alias("text"))

    def step(s: Column, line: Column) -> Column:
        begins = (s["state"] == 0) & line.rlike(own)
        folded = (s["state"] == 1) & ~line.rlike(any_label)
        text = F.when(begins, F.trim(F.regexp_replace(line, own, ""))).when(folded, F.concat(s["text"], F.lit(" "), F.trim(line))).otherwise(s["text"])
        return F.struct(F.when(begins | folded, 1).when(s["state"] == 1, 2).otherwise(s["state"]).alias("state"), text.alias("text"))

    return F.aggregate(block["lines"], start, step, lambda s: F.when(s["state"] > 0, F.trim(s["text"])))


def sent(block: Column) -> Column:
    """When the page says the message was sent, without zone: as printed, or else as a header has it."""
    raw = shown(block, "Date", "Sent")
    return F.coalesce(mail.printed(raw), mail.moment(raw)["value"])

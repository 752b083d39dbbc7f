"""Documents of triples as an ordered log of changes: what a document holds is what its changes leave.

A change adds a triple, removes triples, puts one object in place of all of a subject and predicate (update), or clears the
document. Objects are literals with a datatype or language, or resources. In a removal a null stands for anything.

What is left is worked out without replaying: a triple is there if its last addition is not followed by a change that takes it away,
and the changes that can are looked up by their pattern, so a document of any length is spread over all tasks.

Results for odd input: an addition without subject, predicate or object adds nothing; an update without a subject, predicate or object
changes nothing; changes without a document or place in the log are left out; a triple that is added twice is there once; unknown operations
change nothing.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The namespace of datatypes, and the datatype of a literal that names none.
XSD = "http://www.w3.org/2001/XMLSchema#"
PLAIN = f"{XSD}string"
TERMS = ("subject", "predicate", "object", "kind")


def _pattern(doc: Column, subject: Column, predicate: Column, value: Column, kind: Column) -> Column:
    """A text that is the same for equal patterns; what is null is left out of it."""
    return F.to_json(F.struct(doc.alias("d"), subject.alias("s"), predicate.alias("p"), value.alias("o"), kind.alias("k")))


def current(changes: DataFrame) -> DataFrame:
    """doc, subject, predicate, object, kind and since (the change that added it) of all triples that are left.

    changes: doc, seq (the order of a document's changes), op (add, remove, update, clear), subject, predicate, object and kind
    (a datatype's URI, `@` and a language, or `uri` for a resource; null: plain text).
    """
    log = changes.where("doc IS NOT NULL AND seq IS NOT NULL").select("doc", "seq", F.lower("op").alias("op"), "subject", "predicate", "object", "kind")
    whole = F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull()
    added = log.where(F.col("op").isin("add", "update") & whole).withColumn("kind", F.coalesce("kind", F.lit(PLAIN)))
    last = added.groupBy("doc", *TERMS).agg(F.max("seq").alias("since"))
    none = F.lit(None).cast("string")
    update, clear = F.col("op") == "update", F.col("op") == "clear"
    # an update takes away whatever object its subject and predicate had; a datatype counts only with an object
    value = F.when(~update & ~clear, F.col("object"))
    kind = F.when(value.isNotNull(), F.coalesce("kind", F.lit(PLAIN)))
    taking = log.where(F.col("op").isin("remove", "clear") | (update & whole))
    taken = taking.select(_pattern(F.col("doc"), F.when(~clear, F.col("subject")), F.when(~clear, F.col("predicate")), value, kind).alias("pattern"), "seq").groupBy("pattern").agg(F.max("seq").alias("_gone"))
    # every pattern that a triple falls under
    every = F.array(*[_pattern(F.col("doc"), *[F.col(c) if use else none for c, use in zip(("subject", "predicate"), uses)], *([F.col("object"), F.col("kind")] if uses[2] else [none, none])) for uses in product((True, False), repeat=3)])
    met = last.withColumn("pattern", F.explode(every)).join(taken, "pattern")
    gone = met.groupBy("doc", *TERMS).agg(F.max("_gone").alias("_gone"))
    left = last.join(gone, ["doc", *TERMS], "left")
    return left.where(F.col("_gone").isNull() | (F.col("_gone") <= F.col("since"))).drop("_gone")


def value_of(triples: DataFrame, subject: str, predicate: str) -> DataFrame:
    """doc and the least object of a subject and predicate in each document."""
    return triples.where((F.col("subject") == subject) & (F.col("predicate") == predicate)).groupBy("doc").agg(F.min("object").alias("object"))


def line(subject: Column, predicate: Column, value: Column, kind: Column) -> Column:
    """A line of N-Triples; the object by its kind."""
    text = value
    for sign, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(sign), F.lit(written))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    uri = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    written = F.when(kind == "uri", uri(value)).when(kind.startswith("@"), F.concat(quoted, kind)).when(F.coalesce(kind, F.lit(PLAIN)) == PLAIN, quoted).otherwise(F.concat(quoted, F.lit("^^<"), kind, F.lit(">")))
    return F.concat(uri(subject), F.lit(" "), uri(predicate), F.lit(" "), written, F.lit(" ."))


def read_line(text: Column) -> Column:
    """subject, predicate, object and kind of a line of N-Triples, escapes undone; null for comments and other lines."""
    node = r"(?:<([^<>\s]*)>|(_:\S+))"
    form = rf'^\s*{node}\s+<([^<>\s]*)>\s+(?:{node}|"((?:[^"\\]|\\.)*)"(?:\^\^<([^<>\s]*)>|(@[A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'
    part = lambda i: F.regexp_extract(text, form, i)
    either = lambda a, b: F.when(part(a) != "", part(a)).otherwise(part(b))
    plain = part(6)
    # a double backslash must not take part in the escape that seems to follow it
    plain = F.replace(plain, F.lit("\\\\"), F.lit("\u0000"))
    for sign, written in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(written), F.lit(sign))
    plain = F.replace(plain, F.lit("\u0000"), F.lit("\\"))
    resource = either(4, 5)
    kind = F.when(resource != "", "uri").when(part(7) != "", part(7)).when(part(8) != "", part(8)).otherwise(PLAIN)
    return F.when(text.rlike(form), F.struct(either(1, 2).alias("subject"), part(3).alias("predicate"), F.when(resource != "", resource).otherwise(plain).alias("object"), kind.alias("kind")))

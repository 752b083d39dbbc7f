"""One contract to read, write and search data: a URI is SQL, a table or a path with a format."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Format by file suffix.
FORMATS = {
    "parquet": "parquet", "orc": "orc", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json",
    "txt": "text", "log": "text", "md": "text", "xml": "xml", "avro": "avro", "delta": "delta",
    "png": "binaryFile", "jpg": "binaryFile", "jpeg": "binaryFile", "tif": "binaryFile", "tiff": "binaryFile", "bmp": "binaryFile", "gif": "binaryFile", "pdf": "binaryFile",
}
_SQL = re.compile(r"\s*(select|with|show|describe|explain|values|table)[\s(]", re.IGNORECASE)


class NotAllowed(PermissionError):
    """A query that the gates refuse."""


def is_sql(uri: str) -> bool:
    """Whether a URI is a query: `sql:` in front, or a query word with a space or bracket after it."""
    return uri.lower().startswith("sql:") or bool(_SQL.match(uri))


_NODES = "org.apache.spark.sql.catalyst.plans.logical."
#: Commands that only show something.
_SHOWING = ("Show", "Describe")


def is_plain_query(spark: SparkSession, text: str) -> bool:
    """Whether a statement only reads, as Spark's own parser has it: one statement whose plan holds no command, insert or script.

    What shows or describes things is plain, and so is an EXPLAIN of what is plain. A text that cannot be parsed is not.
    """
    jvm = spark._jvm
    kinds = [jvm.java.lang.Class.forName(_NODES + name) for name in ("Command", "ParsedStatement", "InsertIntoDir", "CompoundPlanStatement")]

    def plain(plan: JavaObject) -> bool:
        name = plan.getClass().getSimpleName()
        if name == "ExplainCommand":
            return plain(plan.logicalPlan())
        if any(kind.isInstance(plan) for kind in kinds):
            return name.startswith(_SHOWING)
        inner = plan.children()
        return all(plain(inner.apply(i)) for i in range(inner.size()))

    try:
        return plain(spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
    except (ParseException, Py4JJavaError):
        return False


def sql_text(uri: str) -> str:
    return re.sub(r"(?i)^sql:", "", uri).strip().rstrip(";").strip()


def format_of(uri: str) -> str | None:
    """The format that a path's suffix names; None for a table."""
    suffix = uri.rsplit("/", 1)[-1].rsplit(".", 1)
    return FORMATS.get(suffix[1].lower()) if len(suffix) == 2 else None


def is_table(uri: str) -> bool:
    """A name without a known suffix, scheme or slash: `t`, `db.table`."""
    return not is_sql(uri) and format_of(uri) is None and "/" not in uri and ":" not in uri


@dataclass(frozen=True)
class Catalog:
    """safe_mode: refuse SQL that is not a plain query; allow_raw_sql: allow SQL at all."""

    spark: SparkSession
    safe_mode: bool = True
    allow_raw_sql: bool = False

    def read(self, uri: str, format: str | None = None, schema: str | None = None, options: Mapping[str, str] | None = None, columns: Sequence[str] | None = None, where: Mapping[str, object] | None = None, limit: int | None = None, allow_sql: bool | None = None) -> DataFrame:
        """Columns, equality conditions and limit are part of the plan, so they reach the source where it can take them."""
        if is_sql(uri):
            if not (self.allow_raw_sql if allow_sql is None else allow_sql):
                raise NotAllowed("raw SQL is not allowed")
            text = sql_text(uri)
            if self.safe_mode and not is_plain_query(self.spark, text):
                raise NotAllowed("only one query statement is allowed in safe mode")
            df = self.spark.sql(text)
        elif format is None and is_table(uri):
            df = self.spark.table(uri)
        else:
            reader = self.spark.read.format(format or format_of(uri) or "parquet").options(**(options or {}))
            df = (reader.schema(schema) if schema else reader).load(uri)
        for name, value in (where or {}).items():
            df = df.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
        if columns:
            df = df.select(*columns)
        return df.limit(limit) if limit is not None else df

    def write(self, df: DataFrame, uri: str, format: str | None = None, mode: str = "errorifexists", partition_by: Sequence[str] = (), options: Mapping[str, str] | None = None) -> dict[str, object]:
        """Write to a path or table. The rows are counted by the write itself, not by a second pass."""
        if is_sql(uri):
            raise NotAllowed("a query is no destination")
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).options(**(options or {}))
        writer = writer.partitionBy(*partition_by) if partition_by else writer
        if format is None and is_table(uri):
            kind = "table"
            writer.saveAsTable(uri)
        else:
            kind = format or format_of(uri) or "parquet"
            writer.format(kind).save(uri)
        return {"operation": "write", "destination_uri": uri, "destination_format": kind, "mode": mode, "columns": df.columns, "row_count": seen.get["rows"]}

    def search(self, pattern: str = "*") -> DataFrame:
        """Tables and views of all databases whose name matches: a glob, or else a part of the name, in any case."""
        found = [(t.name, t.isTemporary, ".".join(t.namespace or [])) for d in self.spark.catalog.listDatabases() for t in self.spark.catalog.listTables(d.name)]
        names = self.spark.createDataFrame(sorted(set(found)), "name string, temporary boolean, database string")
        return names.where(matches(F.col("name"), pattern))

    def describe(self, df: DataFrame, uri: str) -> dict[str, object]:
        """What a read hands over, without running it."""
        return {"operation": "read", "source_uri": uri, "columns": df.columns, "schema": df.schema.simpleString()}


def glob_regex(pattern: str) -> str:
    """The Java pattern of a shell glob with *, ? and [...]."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z"


def matches(name: Column, pattern: str) -> Column:
    """A glob if it has *, ? or [; else a part of the name. Case does not count."""
    low = pattern.lower()
    return F.lower(name).rlike(glob_regex(low)) if any(c in low for c in "*?[") else F.contains(F.lower(name), F.lit(low))

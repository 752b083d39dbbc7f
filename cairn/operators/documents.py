"""Documents as rows: digests, first-wins bundles, manifests, ordering and routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_DIGESTS = {"md5": F.md5, "sha1": F.sha1, "sha224": lambda c: F.sha2(c, 224), "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384), "sha512": lambda c: F.sha2(c, 512)}


def digest(content: Column, algorithm: str = "sha256") -> Column:
    if algorithm not in _DIGESTS:
        raise ValueError(f"unknown algorithm {algorithm!r}; one of {sorted(_DIGESTS)}")
    return _DIGESTS[algorithm](content)


def stamped(docs: DataFrame, content: str, key: str = "content_digest", algorithm: str = "sha256", overwrite: bool = False) -> DataFrame:
    """Add the digest of the content; one that is there stays, unless it is to be overwritten."""
    made = digest(F.col(content), algorithm)
    return docs.withColumn(key, made if overwrite or key not in docs.columns else F.coalesce(F.col(key), made))


def identity_digest(doc_id: Column, content: Column, *given: Column) -> Column:
    """The first digest given, else that of the content, else `empty:` and the id."""
    return F.coalesce(*given, F.when(content != "", digest(content)), F.concat(F.lit("empty:"), doc_id.cast("string")))


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. One aggregate of a struct: a key's rows are reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(last.alias("_last")).select(*key, "_last.*").select(*rows.columns)


def bundle(docs: DataFrame, doc_id: str, digest_column: str, seq: str) -> DataFrame:
    """Every document with its canonical_id: of each digest the first in order wins, the others are its aliases.

    A document written again under a new digest counts with its last digest only.
    """
    now = latest(docs, [doc_id], [seq])
    first = now.groupBy(digest_column).agg(F.min_by(F.col(doc_id), F.struct(seq, doc_id)).alias("canonical_id"))
    return now.join(first, digest_column).select(*now.columns, "canonical_id", (F.col(doc_id) != F.col("canonical_id")).alias("is_alias"))


def manifest(parents: DataFrame, children: DataFrame, parent_digest: str, child_digest: str, order: str) -> DataFrame:
    """Each parent with the distinct digests of its children, in the order in which they came; childless ones too."""
    first = children.groupBy(parent_digest, child_digest).agg(F.min(order).alias("_at"))
    lists = first.groupBy(parent_digest).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", child_digest))), lambda x: x[child_digest]).alias("children"))
    return parents.select(parent_digest).distinct().join(lists, parent_digest, "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def cleaned(df: DataFrame, strings_only: bool = False) -> DataFrame:
    """Nulls as empty text: in all columns, which become text, or in text columns alone."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in text or not strings_only else F.col(c) for c in df.columns])


def mapped(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; all at once, so names may be exchanged."""
    return df.withColumnsRenamed(dict(names))


def validated(df: DataFrame, schema: Mapping[str, object]) -> DataFrame:
    """Add _error: the first violation of a JSON schema (required, type, enum, minimum, maximum, pattern, lengths)."""
    tests: list[Column] = []
    kinds = dict(df.dtypes)
    for name in schema.get("required", []):
        tests.append(F.when(F.col(name).isNull(), f"{name}: required") if name in kinds else F.lit(f"{name}: required"))
    wanted = {"string": ("string",), "integer": ("int", "bigint", "smallint", "tinyint"), "number": ("int", "bigint", "double", "float", "smallint", "tinyint"), "boolean": ("boolean",)}
    for name, rule in schema.get("properties", {}).items():
        if name not in kinds:
            continue
        c = F.col(name)
        if "type" in rule and kinds[name] not in wanted[rule["type"]] and not kinds[name].startswith("decimal"):
            tests.append(F.when(c.isNotNull(), f"{name}: type"))
        for key, test in {"minimum": lambda v: c < v, "maximum": lambda v: c > v, "enum": lambda v: ~c.isin(*v), "pattern": lambda v: ~c.rlike(v), "minLength": lambda v: F.length(c) < v, "maxLength": lambda v: F.length(c) > v}.items():
            if key in rule:
                tests.append(F.when(test(rule[key]), f"{name}: {key}"))
    return df.withColumn("_error", F.coalesce(*tests) if tests else F.lit(None).cast("string"))


def routed(df: DataFrame, routes: Sequence[tuple[str, Column]], default: str | None = None) -> DataFrame:
    """Add route: the name of the first condition that holds."""
    route = F.lit(default).cast("string")
    for name, condition in reversed(routes):
        route = F.when(condition, name).otherwise(route)
    return df.withColumn("route", route)


def ordered(files: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """Files by name, created, modified or size; equal ones by name."""
    key = F.col(by)
    return files.orderBy(key.desc() if descending else key.asc(), "name")


def nested(one: DataFrame, many: DataFrame, one_key: str, many_key: str, name: str, order: str) -> DataFrame:
    """Each row of `one` with its rows of `many` as an array of structs; those without any have an empty one."""
    rest = [c for c in many.columns if c != many_key]
    kind = "array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in many.schema.fields if f.name != many_key) + ">>"
    lists = many.groupBy(many_key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("_n"))
    as_given = F.transform("_n", lambda x: F.struct(*[x[c].alias(c) for c in rest]))
    joined = one.join(lists.withColumn(name, as_given).drop("_n"), one[one_key] == F.col(many_key), "left").drop(many_key)
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def distinct_union(*lists: Column, key=lambda x: x) -> Column:
    """One list of all elements, in order, without later ones of an equal key; elements without a key are left out.

    Keys are sorted with their places, and the first of each stays, so a long list costs no more than its sorting.
    """

    def of(every: Column) -> Column:
        keyed = F.filter(F.transform(every, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))), lambda p: p["k"].isNotNull())
        firsts = lambda pairs: F.filter(pairs, lambda p, j: (j == 0) | (F.get(pairs, j - 1)["k"] != p["k"]))
        # the inner functions have the list and the pairs as variables, so both are computed once
        left = F.get(F.transform(F.array(F.array_sort(keyed)), firsts), F.lit(0))
        return F.transform(F.array_sort(F.transform(left, lambda p: p["i"])), lambda i: F.get(every, i))

    return F.get(F.transform(F.array(F.concat(*lists)), of), F.lit(0))

"""Control catalogues as tables: profiles resolved, ids translated, declared sets held against a baseline."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _controls(text: str | None) -> list[dict[str, object]] | None:
    """The controls of a catalogue with the groups (or controls) that hold them, outermost first."""
    try:
        tree = json.loads(text or "").get("catalog")
    except (ValueError, AttributeError):
        return None
    if not isinstance(tree, dict):
        return None
    out: list[dict[str, object]] = []
    waiting = [(tree, [])]
    while waiting:
        node, path = waiting.pop()
        for control in node.get("controls") or ():
            parts = [p.get("prose") or "" for p in control.get("parts") or () if p.get("name") == "statement"]
            out.append({"id": control.get("id"), "title": control.get("title"), "class": control.get("class"), "groups": path, "statement": "\n".join(parts), "props": {p["name"]: str(p.get("value", "")) for p in control.get("props") or () if "name" in p}})
            waiting.append((control, [*path, control.get("id")]))
        waiting += [(g, [*path, g.get("id") or g.get("title")]) for g in reversed(node.get("groups") or [])]
    return out


def catalogue(document: Column) -> Column:
    """The controls of an OSCAL catalogue in JSON: id, title, class, groups (the path to it), statement and props.

    Null for a document that is no such catalogue.
    """

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_controls(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<struct<id:string,title:string,class:string,groups:array<string>,statement:string,props:map<string,string>>>")(document)


_SELECTION = "array<struct<`with-ids`:array<string>>>"


def profile(document: Column) -> Column:
    """What an OSCAL profile in JSON imports: href, include and exclude (ids) of each import."""
    parsed = F.from_json(document, f"struct<profile:struct<imports:array<struct<href:string,`include-controls`:{_SELECTION},`exclude-controls`:{_SELECTION}>>>>")
    ids = lambda picks: F.coalesce(F.array_distinct(F.flatten(F.transform(picks, lambda p: p["with-ids"]))), F.array().cast("array<string>"))
    return F.transform(parsed["profile"]["imports"], lambda i: F.struct(i["href"].alias("href"), ids(i["include-controls"]).alias("include"), ids(i["exclude-controls"]).alias("exclude")))


def groups_of(controls: DataFrame) -> DataFrame:
    """Each group that still holds controls, with their number in it and below: the tree of a resolved profile.

    controls: as from `catalogue`, exploded.
    """
    paths = F.transform("groups", lambda g, i: F.slice("groups", 1, i + 1))
    return controls.select("id", F.explode(paths).alias("path")).groupBy("path").agg(F.count_distinct("id").alias("controls"))


def resolve(catalogue: DataFrame, include: DataFrame, exclude: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Controls (column id, any others) that a profile includes and does not exclude.

    strict: an included id that the catalogue lacks is an error; the check is part of the plan.
    """
    wanted = include.select(F.lower("id").alias("_id")).distinct()
    if exclude is not None:
        wanted = wanted.join(exclude.select(F.lower("id").alias("_id")), "_id", "left_anti")
    out = catalogue.withColumn("_id", F.lower("id"))
    if strict:
        lost = [r["_id"] for r in wanted.join(out.select("_id"), "_id", "left_anti").orderBy("_id").limit(20).collect()]
        if lost:
            raise LookupError(f"the catalogue lacks {', '.join(lost)}")
    return out.join(wanted, "_id", "left_semi").drop("_id")


def translate(ids: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """id and target: each id's targets in their own case, found whatever the case; ids without one are their own."""
    known = crosswalk.select(F.lower("source").alias("_s"), "target").distinct()
    joined = ids.withColumn("_s", F.lower("id")).join(known, "_s", "left")
    return joined.select("id", F.coalesce("target", "id").alias("target")).distinct()


def outside(declared: DataFrame, baseline: DataFrame) -> DataFrame:
    """Declared (component, id) pairs whose id the baseline lacks."""
    known = baseline.select(F.lower("id").alias("_id")).distinct()
    return declared.withColumn("_id", F.lower("id")).join(known, "_id", "left_anti").drop("_id")


def verify(declared: DataFrame, baseline: DataFrame) -> None:
    found = outside(declared, baseline).limit(20).collect()
    if found:
        raise PermissionError("outside the baseline: " + ", ".join(f"{r['component']}/{r['id']}" for r in found))

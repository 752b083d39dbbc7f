"""JSON Schema over nested values: a schema compiled to one column that lists all violations with their places.

Values are VARIANT; what a schema says of objects within objects and of the members of arrays becomes path lookups and transforms, so
a document is looked at once and nothing runs in Python.

Keywords: type (one or several), enum, const, required, properties, additionalProperties (false or a schema), minProperties, maxProperties,
items, minItems, maxItems, uniqueItems, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength, maxLength, pattern,
allOf, anyOf, oneOf, not, $ref to the schema's own definitions. Others say nothing; a reference to itself is an error, since columns cannot recur.

Results for odd input: a null text, or one that is no JSON, has the violation `json` at `$`; a keyword for another type than the
value's is fulfilled; whole numbers written with a fraction of zero are integers.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

VIOLATIONS = "array<struct<path:string,keyword:string>>"
_MATHS = {"minimum": lambda n, v: n < v, "maximum": lambda n, v: n > v, "exclusiveMinimum": lambda n, v: n <= v, "exclusiveMaximum": lambda n, v: n >= v, "multipleOf": lambda n, v: (n / v) != F.floor(n / v)}
_LENGTHS = {"minLength": lambda s, v: F.char_length(s) < v, "maxLength": lambda s, v: F.char_length(s) > v, "pattern": lambda s, v: ~s.rlike(v)}
_SIZES = {"minItems": lambda n, v: n < v, "maxItems": lambda n, v: n > v}
_COUNTS = {"minProperties": lambda n, v: n < v, "maxProperties": lambda n, v: n > v}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _member(value: Column, name: str) -> Column:
    """A member of an object; a path cannot hold a name with both quotes."""
    for quote in "'\"":
        if quote not in name:
            return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))


class _Compiler:
    def __init__(self, root: Mapping[str, object]) -> None:
        self.root = root

    def resolved(self, ref: str) -> object:
        if not ref.startswith("#"):
            raise ValueError(f"only references within the schema are known: {ref}")
        node: object = self.root
        for name in ref[1:].strip("/").split("/") if ref != "#" else ():
            node = node[name.replace("~1", "/").replace("~0", "~")]
        return node

    def of(self, value: Column, place: Column, schema: object, seen: tuple[str, ...] = ()) -> Column:
        """Violations of a schema by a value that is there."""
        if schema is True or schema == {}:
            return F.array().cast(VIOLATIONS)
        if schema is False:
            return F.array(F.struct(place.alias("path"), F.lit("false").alias("keyword"))).cast(VIOLATIONS)
        name = F.schema_of_variant(value)
        is_object, is_array, is_text = name.startswith("OBJECT"), name.startswith("ARRAY"), name == "STRING"
        is_number = name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        number = F.try_variant_get(value, "$", "double")
        kinds = {
            "object": is_object, "array": is_array, "string": is_text, "number": is_number, "integer": is_number & (number == F.floor(number)),
            "boolean": name == "BOOLEAN", "null": F.is_variant_null(value),
        }
        out: list[Column] = []
        broken = lambda test, keyword: out.append(F.when(test, F.array(F.struct(place.alias("path"), F.lit(keyword).alias("keyword")))))
        if "$ref" in schema:
            ref = schema["$ref"]
            if ref in seen:
                raise ValueError(f"{ref} refers to itself")
            out.append(self.of(value, place, self.resolved(ref), (*seen, ref)))
        if "type" in schema:
            wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            fine = F.lit(False)
            for kind in wanted:
                fine = fine | kinds[kind]
            broken(~fine, "type")
        written = F.to_json(value)
        if "enum" in schema:
            broken(~written.isin(*[canonical(v) for v in schema["enum"]]), "enum")
        if "const" in schema:
            broken(written != canonical(schema["const"]), "const")
        for table, applies, measured in ((_MATHS, is_number, number), (_LENGTHS, is_text, F.try_variant_get(value, "$", "string"))):
            for keyword, test in table.items():
                if keyword in schema:
                    broken(applies & test(measured, schema[keyword]), keyword)
        self.in_object(value, place, schema, seen, is_object, out, broken)
        self.in_array(value, place, schema, seen, is_array, out, broken)
        parts = {k: [F.size(self.of(value, place, s, seen)) == 0 for s in schema.get(k, ())] for k in ("anyOf", "oneOf")}
        out += [self.of(value, place, s, seen) for s in schema.get("allOf", ())]
        if parts["anyOf"]:
            fine = F.lit(False)
            for part in parts["anyOf"]:
                fine = fine | part
            broken(~fine, "anyOf")
        if parts["oneOf"]:
            broken(sum((p.cast("int") for p in parts["oneOf"]), F.lit(0)) != 1, "oneOf")
        if "not" in schema:
            broken(F.size(self.of(value, place, schema["not"], seen)) == 0, "not")
        return F.flatten(F.filter(F.array(*out), lambda x: x.isNotNull())).cast(VIOLATIONS) if out else F.array().cast(VIOLATIONS)

    def in_object(self, value, place, schema, seen, is_object, out, broken) -> None:
        child = lambda name: _member(value, name)
        for name in schema.get("required", ()):
            missing = F.array(F.struct(F.concat(place, F.lit(f".{name}")).alias("path"), F.lit("required").alias("keyword")))
            out.append(F.when(is_object & child(name).isNull(), missing))
        for name, inner in schema.get("properties", {}).items():
            out.append(F.when(is_object & child(name).isNotNull(), self.of(child(name), F.concat(place, F.lit(f".{name}")), inner, seen)))
        members = F.try_variant_get(value, "$", "map<string,variant>")
        for keyword, test in _COUNTS.items():
            if keyword in schema:
                broken(is_object & test(F.size(F.map_keys(members)), schema[keyword]), keyword)
        rest = schema.get("additionalProperties", True)
        if rest is not True and rest != {}:
            known = list(schema.get("properties", {}))
            others = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(*known) if known else F.lit(True))
            at = lambda e: F.concat(place, F.lit("."), e["key"])
            found = F.flatten(F.transform(others, lambda e: F.array(F.struct(at(e).alias("path"), F.lit("additionalProperties").alias("keyword"))) if rest is False else self.of(e["value"], at(e), rest, seen)))
            out.append(F.when(is_object, found))

    def in_array(self, value, place, schema, seen, is_array, out, broken) -> None:
        members = F.try_variant_get(value, "$", "array<variant>")
        for keyword, test in _SIZES.items():
            if keyword in schema:
                broken(is_array & test(F.size(members), schema[keyword]), keyword)
        if schema.get("uniqueItems"):
            broken(is_array & (F.size(F.array_distinct(F.transform(members, lambda x: F.to_json(x)))) < F.size(members)), "uniqueItems")
        if "items" in schema:
            out.append(F.when(is_array, F.flatten(F.transform(members, lambda x, i: self.of(x, F.concat(place, F.lit("["), i.cast("string"), F.lit("]")), schema["items"], seen)))))


def violations(text: Column, schema: Mapping[str, object]) -> Column:
    """path and keyword of all that a JSON text breaks of a schema, in the order of the schema."""
    value = F.try_parse_json(text)
    none = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("keyword"))).cast(VIOLATIONS)
    return F.when(value.isNull(), none).otherwise(_Compiler(schema).of(value, F.lit("$"), schema))

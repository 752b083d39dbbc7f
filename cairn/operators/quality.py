"""Data quality of records against declared rules: six dimensions and a weighted index, as columns.

Rules are checked when they are made; expressions are read with Python's parser, held against a list of allowed nodes, and
compiled to one Spark column each. A failing expression (missing field, wrong type, division by zero) is false.
"""

from __future__ import annotations

import ast
import functools
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DIMENSIONS = ("completeness", "validity", "consistency", "accuracy", "currentness", "uniqueness")
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_ALLOWED = (
    ast.Expression, ast.BoolOp, ast.And, ast.Or, ast.UnaryOp, ast.Not, ast.USub, ast.Compare, *_COMPARE, ast.In, ast.NotIn,
    ast.BinOp, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Name, ast.Load, ast.Constant, ast.List, ast.Tuple, ast.Call,
)
_FUNCTIONS = {"float", "int", "str", "len"}


class RuleError(ValueError):
    """A rule that cannot be used, with where it stands."""


def empty(c: Column, kind: T.DataType) -> Column:
    """Null, a blank string or an empty collection."""
    if isinstance(kind, T.StringType):
        return c.isNull() | (F.trim(c) == "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value as text; null is the text None, truth values are True and False."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False").otherwise("None")
    return F.coalesce(c.cast("string"), F.lit("None"))


def parsed(text: str) -> ast.Expression:
    """The tree of an expression that holds allowed nodes only."""
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise RuleError(f"expression {text!r}: {e.msg}") from None
    for node in ast.walk(tree):
        if not isinstance(node, _ALLOWED):
            raise RuleError(f"expression {text!r}: {type(node).__name__} is not allowed")
        if isinstance(node, ast.Call) and not (isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and len(node.args) == 1 and not node.keywords):
            raise RuleError(f"expression {text!r}: only float, int, str and len of one value")
    return tree


def _numeric(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.NumericType)


class _Compiler:
    """Columns, with their types, of the nodes of an expression over a schema."""

    def __init__(self, schema: T.StructType) -> None:
        self.kinds = {f.name: f.dataType for f in schema.fields}

    def truth(self, node: ast.AST) -> Column:
        return F.coalesce(self._truth(node), F.lit(False))

    def _truth(self, node: ast.AST) -> Column:
        """Null where the value cannot be had, so that an enclosing `not` does not turn an error into a truth."""
        if isinstance(node, ast.BoolOp):
            parts = [self._truth(v) for v in node.values]
            # Python stops at the first value that decides; what stands before it must have a value
            join = (lambda a, b: F.when(a, b).when(~a, False)) if isinstance(node.op, ast.And) else (lambda a, b: F.when(a, True).when(~a, b))
            return functools.reduce(lambda b, a: join(a, b), reversed(parts))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self._truth(node.operand)
        if isinstance(node, ast.Compare):
            values = [node.left, *node.comparators]
            return functools.reduce(operator.and_, [self._compare(op, a, b) for op, a, b in zip(node.ops, values, values[1:])])
        c, kind = self.value(node)
        if isinstance(kind, T.BooleanType):
            return c
        return c != 0 if _numeric(kind) else F.length(c.cast("string")) > 0

    def _compare(self, op: ast.cmpop, a: ast.AST, b: ast.AST) -> Column:
        left, kind = self.value(a)
        if isinstance(op, (ast.In, ast.NotIn)):
            if isinstance(b, (ast.List, ast.Tuple)):
                found = left.isin(*[self._constant(e) for e in b.elts]) if b.elts else F.lit(False)
            else:
                right, other = self.value(b)
                found = F.array_contains(right, left) if isinstance(other, T.ArrayType) else F.contains(right, left)
            return ~found if isinstance(op, ast.NotIn) else found
        right, other = self.value(b)
        if _numeric(kind) != _numeric(other) and not isinstance(op, (ast.Eq, ast.NotEq)):
            return F.lit(None).cast("boolean")  # Python cannot order text and numbers
        if _numeric(kind) != _numeric(other):
            return F.lit(isinstance(op, ast.NotEq))
        return _COMPARE[type(op)](left, right)

    @staticmethod
    def _constant(node: ast.AST) -> Any:
        if not isinstance(node, ast.Constant):
            raise RuleError("a list may hold constants only")
        return node.value

    def value(self, node: ast.AST) -> tuple[Column, T.DataType | None]:
        if isinstance(node, ast.Constant):
            kind = T.BooleanType() if isinstance(node.value, bool) else T.DoubleType() if isinstance(node.value, (int, float)) else T.StringType()
            return F.lit(node.value), kind
        if isinstance(node, ast.Name):
            kind = self.kinds.get(node.id)
            return (F.col(f"`{node.id}`"), kind) if kind is not None else (F.lit(None).cast("double"), T.DoubleType())
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            c, kind = self.value(node.operand)
            return -c, kind
        if isinstance(node, ast.BinOp):
            (a, left), (b, right) = self.value(node.left), self.value(node.right)
            if not (_numeric(left) and _numeric(right)):
                if isinstance(node.op, ast.Add) and not (_numeric(left) or _numeric(right)):
                    return F.concat(a, b), T.StringType()
                return F.lit(None).cast("double"), T.DoubleType()
            x, y = a.cast("double"), b.cast("double")
            made = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply, ast.Div: F.try_divide}[type(node.op)](x, y)
            return made, T.DoubleType()
        if isinstance(node, ast.Call):
            c, kind = self.value(node.args[0])
            name = node.func.id
            if name == "str":
                return as_text(c, kind or T.StringType()), T.StringType()
            if name == "len":
                return (F.size(c) if isinstance(kind, (T.ArrayType, T.MapType)) else F.length(c)).cast("double"), T.DoubleType()
            number = c.try_cast("double")
            return (F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("double") if name == "int" else number), T.DoubleType()
        c = self._truth(node)
        return c, T.BooleanType()


@dataclass(frozen=True)
class QualityRules:
    """identifier names a record; accuracy compares fields with `reference` (identifier to fields); keys make uniqueness;
    weights name dimensions and sum to 1."""

    identifier: str
    mandatory: Sequence[str] = ()
    patterns: Mapping[str, str] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    formats: Mapping[str, str] = field(default_factory=dict)
    enumerations: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    expressions: Sequence[str] = ()
    reference: DataFrame | None = None
    timestamp: str | None = None
    decay: float = 0.0
    keys: Sequence[str] = ()
    order_by: Sequence[str] = ()
    weights: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for e in self.expressions:
            parsed(e)
        if unknown := set(self.weights) - set(DIMENSIONS):
            raise RuleError(f"weights: unknown dimensions {sorted(unknown)}")
        if self.weights and abs(sum(self.weights.values()) - 1) > 1e-9:
            raise RuleError("weights: they must sum to 1")
        if self.keys and not self.order_by:
            raise RuleError("order_by: uniqueness needs an order of records")


def _share(tests: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """The share of tests that hold, null for none, and the names of those that do not."""
    if not tests:
        return F.lit(None).cast("double"), F.array().cast("array<string>")
    held = functools.reduce(operator.add, [F.coalesce(t, F.lit(False)).cast("int") for _, t in tests])
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests]))
    return held / F.lit(float(len(tests))), failed


def measure(records: DataFrame, rules: QualityRules, checkpoint: str = "", as_of: Column | None = None) -> DataFrame:
    """record_id, checkpoint, dqi, a column for each dimension, and failed_rules of each record."""
    kinds = {f.name: f.dataType for f in records.schema.fields}
    kind = lambda c: kinds.get(c, T.StringType())
    col = lambda c: F.col(f"`{c}`") if c in kinds else F.lit(None).cast("string")
    df, none = records, F.array().cast("array<string>")
    out: dict[str, Column] = dict.fromkeys(DIMENSIONS, F.lit(None).cast("double"))
    failed: list[Column] = []

    out["completeness"], bad = _share([(f"mandatory:{c}", ~empty(col(c), kind(c))) for c in rules.mandatory])
    failed.append(bad)

    checks: list[tuple[str, str, Column]] = []
    checks += [(f"pattern:{c}", c, col(c).cast("string").rlike(rf"\A(?:{p})\z")) for c, p in rules.patterns.items()]
    checks += [(f"range:{c}", c, col(c).cast("string").try_cast("double").between(lo, hi)) for c, (lo, hi) in rules.ranges.items()]
    checks += [(f"format:{c}", c, F.try_to_timestamp(col(c).cast("string"), F.lit(f)).isNotNull()) for c, f in rules.formats.items()]
    checks += [(f"enumeration:{c}", c, col(c).isin(*v)) for c, v in rules.enumerations.items()]
    if checks:
        filled = [~empty(col(c), kind(c)) for _, c, _ in checks]
        passed = [f & F.coalesce(t, F.lit(False)) for f, (_, _, t) in zip(filled, checks)]
        total = lambda cs: functools.reduce(operator.add, [c.cast("int") for c in cs])
        out["validity"] = F.try_divide(total(passed).cast("double"), total(filled).cast("double"))
        failed.append(F.array_compact(F.array(*[F.when(f & ~p, F.lit(n)) for f, p, (n, _, _) in zip(filled, passed, checks)])))

    compiler = _Compiler(records.schema)
    out["consistency"], bad = _share([(f"expression:{e}", compiler.truth(parsed(e).body)) for e in rules.expressions])
    failed.append(bad)

    if rules.reference is not None:
        fields = [c for c in rules.reference.columns if c != rules.identifier]
        # of a repeated id the least row counts, so that records do not multiply
        least = F.min(F.struct(*[F.col(c).alias(f"_ref_{c}") for c in fields])).alias("_r")
        known = rules.reference.groupBy(F.col(rules.identifier).alias("_ref_id")).agg(least).select("_ref_id", "_r.*")
        df = df.join(known, df[rules.identifier] == known["_ref_id"], "left")
        types = {f.name: f.dataType for f in rules.reference.schema.fields}
        share, bad = _share([(f"accuracy:{c}", as_text(col(c), kind(c)) == as_text(F.col(f"_ref_{c}"), types[c])) for c in fields])
        here = F.col("_ref_id").isNotNull()
        out["accuracy"] = F.when(here, share)
        failed.append(F.when(here, bad).otherwise(none))

    if rules.timestamp:
        now = as_of if as_of is not None else F.current_timestamp()
        at = col(rules.timestamp).cast("string").try_cast("timestamp")
        hours = F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at)) / 3.6e9, F.lit(0.0))
        out["currentness"] = F.exp(-rules.decay * hours)
        failed.append(F.when(at.isNull(), F.array(F.lit(f"timestamp:{rules.timestamp}"))).otherwise(none))

    if rules.keys:
        own = Window.partitionBy(*[as_text(col(c), kind(c)) for c in rules.keys]).orderBy(*rules.order_by)
        df = df.withColumn("_nth", F.row_number().over(own))
        out["uniqueness"] = F.when(F.col("_nth") == 1, 1.0).otherwise(0.0)
        failed.append(F.when(F.col("_nth") > 1, F.array(F.lit("uniqueness:" + ",".join(rules.keys)))).otherwise(none))

    measured = df.select(col(rules.identifier).alias("record_id"), F.lit(checkpoint).alias("checkpoint"), *[c.alias(d) for d, c in out.items()], F.array_join(F.concat(*failed), "; ").alias("failed_rules"))
    index = functools.reduce(operator.add, [F.col(d) * F.lit(float(w)) for d, w in rules.weights.items()]) if rules.weights else F.lit(None).cast("double")
    return measured.withColumn("dqi", index)


def report(measured: DataFrame) -> DataFrame:
    """Report rows: rounded to four places."""
    return measured.select("record_id", "checkpoint", F.round("dqi", 4).alias("dqi"), *[F.round(d, 4).alias(d) for d in DIMENSIONS], "failed_rules")


def aggregate(measured: DataFrame) -> DataFrame:
    """One row: count, mean, minimum, maximum, variance and stdev of the index, and the mean of each dimension."""
    return measured.agg(
        F.count("dqi").alias("count"),
        F.round(F.avg("dqi"), 4).alias("mean"),
        F.round(F.min("dqi"), 4).alias("minimum"),
        F.round(F.max("dqi"), 4).alias("maximum"),
        F.round(F.coalesce(F.var_samp("dqi"), F.lit(0.0)), 4).alias("variance"),
        F.round(F.coalesce(F.stddev_samp("dqi"), F.lit(0.0)), 4).alias("stdev"),
        *[F.round(F.avg(d), 4).alias(f"mean_{d}") for d in DIMENSIONS],
    )

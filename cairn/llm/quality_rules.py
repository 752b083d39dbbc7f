"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Results for odd input: a null or blank text has no words, every count is 0, and it fails (`base_failed`). Only the
column text is read; others pass through `accepted` untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words


@dataclass(frozen=True)
class Rule:
    """`metric` must lie in [low, high]; a missing bound is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "als auf das dem den der des die ein eine für im ist mit sich und von zu "
    "au avec dans de des du elle est et la le les ou par pas pour que qui sur un une "
    "al como con del el en es las lo los no para por se su una y"
).split()

#: The thresholds. A new rule needs a line here and, if its metric is new, a column in `METRICS`.
RULES = (
    Rule("few_words", "n_words", low=10),
    Rule("repeated_windows", "repeat_ratio", high=0.20),
    Rule("short_words", "mean_word_length", low=2.0),
    Rule("long_words", "mean_word_length", high=30.0),
    Rule("symbols", "symbol_ratio", high=0.30),
    Rule("stop_words", "stop_word_ratio", low=0.005),
    Rule("duplicate_lines", "duplicate_line_ratio", high=0.60),
)

#: Metric by name, over the columns that `measured` makes.
METRICS = {
    "n_words": "cast(_qr.n_words as double)",
    "repeat_ratio": "_qr.n_repeat_words / _qr.n_words",
    "mean_word_length": "_qr.word_chars / _qr.n_words",
    "symbol_ratio": "_qr.n_symbols / _qr.n_words",
    # a short text may do without any function word, and one of mostly other letters than a to z has none of the list
    "stop_word_ratio": "if(_qr.n_words >= 50 and 2 * _qr.n_latin_words >= _qr.n_words, _qr.n_stop_words, null) / _qr.n_words",
    "duplicate_line_ratio": "_qr.n_dup_lines / _qr.n_lines",
}


def _window_hashes() -> Column:
    """A 64-bit hash for each window of five words (chained over the words, so word borders count)."""
    last = F.size("_qw") - 5
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(F.col("_qw"), i + j) for j in range(5)]),
        ),
    ).otherwise(F.array().cast("array<long>"))


def _repeat_words() -> tuple[Column, Column]:
    """Sorted (hash, place) pairs, and from them (as `_qp`) the number of words in windows that occur twice or more.

    Sorting brings equal windows together, so a text costs n log n whatever it repeats.
    """
    pairs = F.sort_array(F.transform("_qh", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    def hash_at(j: Column) -> Column:
        return F.get(F.col("_qp"), j)["h"]

    def twin(j: Column) -> Column:
        return F.coalesce(hash_at(j) == hash_at(j - 1), F.lit(False)) | F.coalesce(hash_at(j) == hash_at(j + 1), F.lit(False))

    at = F.sequence(F.lit(0), F.size("_qp") - 1)
    places = F.sort_array(F.transform(F.filter(at, twin), lambda j: F.get(F.col("_qp"), j)["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, i: F.struct((a["n"] + (i + 5 - F.greatest(a["to"], i)).cast("long")).alias("n"), (i + 5).alias("to")),
        lambda a: a["n"],
    )
    return pairs, covered


def measured(docs: DataFrame) -> DataFrame:
    """Add `_qr`, a struct of the counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    pairs, covered = _repeat_words()
    step = docs.withColumn("_qw", words(F.col("text"))).withColumn("_qh", _window_hashes())
    step = step.withColumn("_qp", F.when(F.size("_qh") > F.size(F.array_distinct("_qh")), pairs))
    step = step.withColumn("_ql", F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    counts = F.struct(
        F.size("_qw").cast("long").alias("n_words"),
        F.length(F.array_join("_qw", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_ql") - F.size(F.array_distinct("_ql"))).cast("long").alias("n_dup_lines"),
        F.size("_ql").cast("long").alias("n_lines"),
        F.when(F.col("_qp").isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_qw", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_qw", lambda w: w.rlike("[A-Za-z]"))).cast("long").alias("n_latin_words"),
    )
    return step.withColumn("_qr", counts).drop("_qw", "_qh", "_qp", "_ql")


def _failed(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that a text fails; a ratio over nothing fails no rule."""
    tests = []
    for r in rules:
        value = F.expr(f"try_divide({METRICS[r.metric].replace(' / ', ', ')})" if " / " in METRICS[r.metric] else METRICS[r.metric])
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < r.low)
        if r.high is not None:
            bad = bad | (value > r.high)
        tests.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    return F.array_compact(F.array(*tests))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with `_qr` (counts, base_failed, failed_rules, kept), which takes the place of a column of that name."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "_qr"]
    base = (F.col("_qr.n_words") < 10) | (100 * F.col("_qr.n_repeat_words") > 20 * F.col("_qr.n_words"))
    # columns of any name are set aside in a struct
    step = measured(docs.select(F.struct(*others).alias("_doc"), "text")).withColumn("_qf", _failed(rules))
    found = F.struct("_qr.*", base.alias("base_failed"), F.col("_qf").alias("failed_rules"), (~base & (F.size("_qf") == 0)).alias("kept"))
    return step.select("_doc", found.alias("_qr")).select("_doc.*", "_qr")


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    # a filter on a generated column stays where it is; on a plain one the optimiser would copy the whole projection into
    # the filter, and evaluate it once for each mention, inside loops over words too
    flagged = judged(whole, rules).withColumn("keep", F.explode(F.array("_qr.kept")))
    return flagged.where("keep").select("doc.*")

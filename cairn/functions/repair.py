"""Repair of text that lost or gained letters and spaces, by the likelihood of words.

A lexicon is a table of word (lower case) and zipf (log10 of occurrences in a billion words). Unknown words score UNKNOWN, so
that every further word costs about nine and one word beats two.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The scale, the score of unknown words, the least score of a real word, the only words of one letter.
ZIPF_BASE, UNKNOWN, LEAST_KNOWN, SINGLE = 9.0, -10.0, 2.0, ("a", "i")
#: Words in a lexicon that goes to every executor, at most.
MOST_WORDS = 1_000_000


@dataclass(frozen=True)
class Confusion:
    """What a conversion wrote (`pattern`), what should stand there, and the letters that it may have swallowed."""

    pattern: str
    replacement: str
    restore: str = ""
    keep_when: str | None = None
    protect: Sequence[str] = ()


def with_logp(rows: DataFrame, lexicon: DataFrame, word: str, name: str) -> DataFrame:
    """Add the log-probability of a column's word; an empty word is free."""
    known = lexicon.select(F.col("word").alias("_w"), F.col("zipf").alias("_z"))
    joined = rows.join(known, F.lower(word) == F.col("_w"), "left")
    return joined.withColumn(name, F.when(F.col(word) == "", 0.0).otherwise(F.coalesce("_z", F.lit(UNKNOWN)) - ZIPF_BASE)).drop("_w", "_z")


def closed(junctions: DataFrame, lexicon: DataFrame, threshold: float = LEAST_KNOWN) -> DataFrame:
    """Junctions (id, left, right, restore, spacing) with `repaired`: the likeliest reading, null if it is the one there is.

    Readings: the parts as they are; one word, glued as it is or with one restored letter between; or two words of which
    the left one lost such a letter (if there is a space or nothing on the right). Of equal ones the first counts. All
    readings of all junctions are rows, scored by joins with the lexicon.
    """
    upper = (F.upper("left") == F.col("left")) & (F.lower("left") != F.col("left"))
    letters = F.filter(F.split("restore", ""), lambda c: c != "")
    restored = F.transform(letters, lambda c: F.when(upper, F.upper(c)).otherwise(c))
    glued = F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.array(F.lit("")), restored)).otherwise(F.array().cast("array<string>"))
    ended = F.when((F.col("left") != "") & ((F.col("spacing") != "") | (F.col("right") == "")), restored).otherwise(F.array().cast("array<string>"))
    one = F.transform(glued, lambda c: F.struct(F.concat("left", c, "right").alias("word"), F.lit("").alias("rest"), F.concat("left", c, "right").alias("text")))
    two = F.transform(ended, lambda c: F.struct(F.concat("left", c).alias("word"), F.col("right").alias("rest"), F.concat("left", c, "spacing", "right").alias("text")))
    ways = junctions.select("id", "left", "right", F.posexplode_outer(F.concat(one, two)).alias("_place", "_way")).select("id", "left", "right", "_place", "_way.*")
    for word in ("left", "right", "word", "rest"):
        ways = with_logp(ways, lexicon, word, f"_{word}")
    better = (F.col("_word") + F.col("_rest") > F.col("_left") + F.col("_right")) & (F.col("_word") + ZIPF_BASE >= threshold)
    best = F.max_by(F.when(better, F.col("text")), F.when(better, F.struct(F.col("_word") + F.col("_rest"), -F.col("_place"))))
    return junctions.join(ways.groupBy("id").agg(best.alias("repaired")), "id")


def _scores(lexicon: DataFrame) -> Callable[[str], float]:
    rows = lexicon.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    held = lexicon.sparkSession.sparkContext.broadcast({r["word"]: float(r["zipf"]) for r in rows})
    return lambda word: 0.0 if not word else held.value.get(word.lower(), UNKNOWN) - ZIPF_BASE


def segmented(tokens: DataFrame, lexicon: DataFrame, longest: int = 20) -> DataFrame:
    """token and pieces: the likeliest words that a run-together token consists of; a single letter counts only as a or i."""
    logp = _scores(lexicon)

    def cut(token: str) -> list[str]:
        best: list[tuple[float, int] | None] = [(0.0, 0)]
        for end in range(1, len(token) + 1):
            ways = [(best[k][0] + logp(token[k:end]), k) for k in range(max(0, end - longest), end) if best[k] is not None and (end - k > 1 or token[k].lower() in SINGLE)]
            best.append(max(ways, key=lambda w: (w[0], -w[1])) if ways else None)
        if best[-1] is None:
            return [token]
        out, end = [], len(token)
        while end:
            out.append(token[best[end][1] : end])
            end = best[end][1]
        return out[::-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"token": b["token"], "pieces": [cut(t) for t in b["token"]]})

    return tokens.select("token").where("token IS NOT NULL").distinct().mapInPandas(run, "token string, pieces array<string>")


def unstuck(text: Column, pieces: Mapping[str, Sequence[str]]) -> Column:
    """Text with run-together words cut as given."""
    out = text
    for token, parts in pieces.items():
        out = F.regexp_replace(out, rf"(?<![^\W\d_]){re.escape(token)}(?![^\W\d_])", " ".join(parts))
    return out


def repaired(docs: DataFrame, column: str, confusions: Sequence[Confusion], lexicon: DataFrame, headers: Sequence[str] = (), threshold: float = LEAST_KNOWN) -> DataFrame:
    """Add `repaired`, `substitutions` and `joins`: confusions undone line by line and the junctions that they leave closed.

    The label of a line that begins with a header, or that a rule keeps, is left alone, and so is what a rule protects.
    """
    logp = _scores(lexicon)
    rules = [(c, re.compile(c.keep_when) if c.keep_when else None, re.compile("|".join(f"(?:{p})" for p in c.protect)) if c.protect else None) for c in confusions]

    def spared(line: str) -> int:
        body = len(line) - len(line.lstrip())
        for h in headers:
            if line.startswith(h, body):
                return body + len(h)
        for c, keep, _ in rules:
            if keep and keep.match(line) and c.pattern in line:
                return line.index(c.pattern) + len(c.pattern)
        return 0

    def close(left: str, right: str, space: str, c: Confusion) -> str | None:
        letters = c.restore.upper() if left.isupper() else c.restore
        ways = [(left + x + right, left + x + right, 0.0) for x in ("", *letters)] if left and right else []
        ways += [(left + x, left + x + space + right, logp(right)) for x in letters] if left and (space or not right) else []
        best, text = logp(left) + logp(right), None
        for word, whole, more in ways:
            if logp(word) + more > best and logp(word) + ZIPF_BASE >= threshold:
                best, text = logp(word) + more, whole
        return text

    def mend(line: str) -> tuple[str, int, int]:
        keep = spared(line)
        head, rest, found, joins = line[:keep], line[keep:], 0, 0
        for c, _, protect in rules:
            safe = [m.span() for m in protect.finditer(rest)] if protect else []
            places = [m.start() for m in re.finditer(re.escape(c.pattern), rest) if not any(a < m.end() and m.start() < b for a, b in safe)]
            # from the right, so that earlier places stay where they are
            for at in reversed(places):
                before, after = rest[:at] + c.replacement, rest[at + len(c.pattern) :]
                left = re.search(r"\w*$", before).group()
                space, right = re.match(r"([ \t]*)(\w*)", after).groups()
                made = close(left, right, space, c)
                joins += made is not None
                rest = before[: len(before) - len(left)] + (made if made is not None else left + space + right) + after[len(space) + len(right) :]
            found += len(places)
        return head + rest, found, joins

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            lines = [mend(line) for line in t.split("\n")] if t is not None else []
            out.append(("\n".join(x for x, _, _ in lines) if t is not None else None, sum(n for _, n, _ in lines), sum(n for _, _, n in lines)))
        return pd.DataFrame(out, columns=["repaired", "substitutions", "joins"])

    found = docs.withColumn("_repair", F.pandas_udf(run, "struct<repaired:string,substitutions:int,joins:int>")(F.col(column)))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], "_repair.*")

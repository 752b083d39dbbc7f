"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

The words that the mix takes are laid on one line, source after source, each source as long as its target and cut into
blocks of equally many words (its last one may be shorter). The van der Corput sequence visits the blocks (block j comes at
turn bit-reverse(j)), so that every stretch of the schedule holds each source in its share. The r-th visit to a source
takes the r-th block of that source's shuffled documents, which repeat up to three times.

Results for odd input: a null or blank text has size 0 and is never taken; a null source is a source of its own, last
in order; equal rows are shuffled as separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import count_words, running, saved

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Words in a block: the total over 2^17, at least 64 and at most 2^20.
BLOCKS_LOG2, LEAST_BLOCK, MOST_BLOCK = 17, 64, 1 << 20
#: Cells of the line by which blocks find their source in an equi-join.
CELLS = 1024


def shuffle_place(seed: str) -> Column:
    """60 bits of the MD5 of doc_id and seed: the place of a document in its source's shuffled order."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))), 1, 15), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, weight, pos and target: shares of the whole by weight, capped at 3 times the source's size.

    The excess over caps is shared again by weight until no source is above its cap. In order of cap over weight, a
    source is capped exactly if its cap is at most what the rest of the whole gives it. One row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("pos", F.row_number().over(by_name)).withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("pos") - 1) % len(weights)).cast("long"))
    ranked = ranked.withColumn("cap", MOST_REPEATS * F.col("source_size"))
    whole = Window.partitionBy(F.lit(1))
    tightest = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = ranked.withColumn("level", rest / weight).withColumn("order", F.row_number().over(tightest))
    levelled = levelled.withColumn("free", F.col("cap") / F.col("weight") > F.col("level"))
    level = F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.col("order"))).over(whole)
    return levelled.withColumn("target", F.when(F.col("free"), level * F.col("weight")).otherwise(F.col("cap").cast("double"))).select("source", "source_size", "weight", "pos", "target")


def block_words(total: int) -> int:
    return min(MOST_BLOCK, max(LEAST_BLOCK, total >> BLOCKS_LOG2))


def slots(sources: DataFrame, words: int) -> DataFrame:
    """source, block (its rank among the source's slots) and turn (its place in the schedule).

    Each source has as many slots on the line as its target has blocks, a last shorter one included.
    """
    spark = sources.sparkSession
    count = F.ceil(F.round("target") / words).cast("long")
    line = sources.withColumn("hi", F.sum(count).over(Window.orderBy("pos"))).select("source", (F.col("hi") - count).alias("lo"), "hi").where("hi > lo")
    total = line.agg(F.coalesce(F.max("hi"), F.lit(0))).first()[0]
    bits = max(1, (total - 1).bit_length())
    cell = lambda c: F.floor(c * CELLS / max(1, total)).cast("int")
    cells = line.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    found = spark.range(total).withColumn("cell", cell(F.col("id"))).join(cells, "cell").where("id >= lo AND id < hi")
    turn = van_der_corput(F.col("id"), bits)
    ranked = running(found.select("source", turn.alias("turn"), F.shiftleft(turn, 60 - bits).alias("_turn"), F.lit(1).cast("long").alias("_one")), ["source"], "_turn", "_one", [], total)
    return ranked.select("source", F.col("before").alias("block"), "turn")


def van_der_corput(number: Column, bits: int) -> Column:
    """When the sequence visits a number: its bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = ":mix") -> tuple[DataFrame, DataFrame]:
    """The documents with what the mix takes of each, and the pieces in the order of the schedule.

    documents: doc_id, source, mark (crc32 of the text), size, source_size, target, taken, start, first_turn (null if not
    taken) and n_pieces. pieces: turn, source, start, doc_id, mark, pass, from_word, n_words; a document may have several,
    in up to three passes. A source's pieces end at its rounded target, so it takes that many words at any corpus size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = saved(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("mark"), shuffle_place(seed).alias("_place")), "mix-sizes")
    rows, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    words = block_words(total)
    sources = saved(targets(sized, weights), "mix-targets")
    placed = running(sized.where("size > 0"), ["source"], "_place", "size", ["doc_id", "size", "mark"], rows).drop("before", "_place")
    same_source = F.col("d.source").eqNullSafe(F.col("s.source"))
    known = saved(placed.alias("d").join(sources.alias("s"), same_source).select("d.*", "s.source_size", "s.target"), "mix-places")
    whole = F.round("target").cast("long")
    repeats = known.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)))).withColumn("_at", F.col("start") + F.col("_pass") * F.col("source_size"))
    repeats = repeats.where(F.col("_at") < whole).withColumn("_end", F.least(F.col("_at") + F.col("size"), whole))
    block = lambda c: F.floor(c / words).cast("long")
    cut = repeats.withColumn("block", F.explode(F.sequence(block(F.col("_at")), block(F.col("_end") - 1))))
    begin, end = F.greatest(F.col("_at"), F.col("block") * words), F.least(F.col("_end"), (F.col("block") + 1) * words)
    cut = cut.select("source", "start", "doc_id", "mark", F.col("_pass").alias("pass"), "block", (begin - F.col("_at")).alias("from_word"), (end - begin).alias("n_words"))
    met = F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block"))
    pieces = cut.alias("p").join(slots(sources, words).alias("t"), met).select("t.turn", *[f"p.{c}" for c in cut.columns if c != "block"])
    taken = pieces.groupBy("source", "start").agg(F.sum("n_words").alias("taken"), F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n_pieces"))
    same_row = F.col("k.source").eqNullSafe(F.col("t.source")) & (F.col("k.start") == F.col("t.start"))
    none = {"taken": F.lit(0).cast("long"), "first_turn": F.lit(None).cast("long"), "n_pieces": F.lit(0).cast("long")}
    full = known.alias("k").join(taken.alias("t"), same_row, "left").select("k.*", *[F.coalesce(F.col(f"t.{c}"), v).alias(c) for c, v in none.items()])
    blank = sized.where("size = 0").drop("_place").alias("d").join(sources.alias("s"), same_source)
    blank = blank.select("d.*", F.lit(None).cast("long").alias("start"), "s.source_size", "s.target", *[v.alias(c) for c, v in none.items()])
    return full.unionByName(blank), pieces


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = ":mix") -> DataFrame:
    """The documents of the mix in the order of the schedule, whole, once for each pass that takes any of their words.

    Rows of equal doc_id, source and text share what is taken of any of them in a pass.
    """
    _, pieces = mix(docs, weights, seed)
    plan = pieces.groupBy("doc_id", "source", "mark", "pass").agg(F.min("turn").alias("turn"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("mark"))
    own = (F.col("d.mark") == F.col("p.mark")) & F.col("d.doc.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.doc.source").eqNullSafe(F.col("p.source"))
    joined = marked.alias("d").join(plan.alias("p"), own).select("d.doc", "p.turn", "p.pass")
    return joined.orderBy("turn", "doc.doc_id", "pass").select("doc.*")

"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a curve: how strongly it is drawn at each moment of training, given
as knots (t, strength) over [0, 1] and linear between them. Targets share the words of all
documents by weight; no target passes ``most_passes`` times its source's words, and what it leaves
is shared by weight among the others, until none is above.

The documents of a source stand in a fixed random order, end to end, and are read over and over
until its target is met. An occurrence that begins at word x of that demand is due when the
integral of the source's curve reaches x of the target: that moment, found by inverting the
integral, is its training position, and the mix is sorted by position over ranges. A position is a
moment in [0, 1] that all sources share, not a count of words before it.

Order is by MD5 of the id. Its first three hex digits split every source into buckets: words are
summed by bucket, buckets are added up along the source, and only inside a bucket are documents
put in order, so a source with most of the rows is still spread over all tasks.

Sources are ordered by code point, null last and a source of its own. Null texts have no words and
are never taken; neither are texts without words. Null ids share one place in the order. Repeated
rows stand next to each other and are taken one by one. An empty table gives no rows. All of it is
DataFrame functions. The table of sources, one row each, is ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stored, words

WEIGHTS = (5, 2, 1)
#: Steady, rising and falling.
CURVES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))
MOST_PASSES = 3
BUCKET_DIGITS = 3


def _segments(curve: Sequence[tuple[float, float]]) -> Column:
    """The curve's pieces: where each begins in time and in the integral, strength, slope, whole integral."""
    parts, done = [], 0.0
    for (a, v), (b, w) in zip(curve, curve[1:], strict=False):
        parts.append((a, done, v, (w - v) / (b - a)))
        done += (v + w) / 2 * (b - a)
    names = ("t", "done", "strength", "slope", "whole")
    return F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(names, (*p, done), strict=True)]) for p in parts])


def plan(sources: DataFrame, weights: Sequence[int] = WEIGHTS, curves: Sequence = CURVES) -> DataFrame:
    """Add ``weight`` and ``segments`` to (source, source_size): weights and curves repeat in source order."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sources.withColumn("place", place).select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).alias("weight"),
        F.element_at(F.array(*map(_segments, curves)), (F.col("place") % len(curves) + 1).cast("int")).alias("segments"),
    )


def targets(planned: DataFrame, most_passes: int = MOST_PASSES) -> DataFrame:
    """Add ``target``: the level at which targets by weight, cut at their caps, share all words.

    With sources in order of cap over weight, those before the first that stays under its cap are cut.
    """
    cap = F.col("source_size") * most_passes
    line = Window.orderBy("at", F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    ranked = planned.withColumn("cap", cap).withColumn("at", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn("left", F.sum("source_size").over(whole) - F.sum("cap").over(line) + F.col("cap"))
    after = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", F.col("left") / after)
    level = F.min_by("level", F.struct("at", F.col("source").isNull(), "source"))
    fits = ranked.where("level <= at").agg(level.alias("level"))
    return ranked.drop("level").join(F.broadcast(fits)).select(
        "source", "source_size", "segments", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def moment(share: Column, segments: Column) -> Column:
    """When the integral of the curve reaches ``share`` of its whole."""
    sought = share * segments[0]["whole"]
    s = F.element_at(F.filter(segments, lambda x: (x["done"] <= sought) | (x["t"] == segments[0]["t"])), -1)
    rest = sought - s["done"]
    below = s["strength"] + F.sqrt(F.greatest(s["strength"] * s["strength"] + 2 * s["slope"] * rest, F.lit(0.0)))
    return s["t"] + F.when(below > 0, 2 * rest / below).otherwise(0.0)


def assign(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    curves: Sequence = CURVES,
    most_passes: int = MOST_PASSES,
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, first_position, and what ``occurrences`` needs.

    ``taken`` cuts the last document where the target is met, so that a source's words are its
    target, rounded; ``copies`` counts whole documents, the last if at least half of it is due.
    """
    digest = F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("null")))
    sized = stored(
        docs.select(
            docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), words(docs[text_col]).alias("size"),
            digest.alias("digest"),
        ),
        "sized",
    ).withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))
    by_bucket = stored(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    aimed = targets(plan(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, curves), most_passes)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    based = by_bucket.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    based = based.withColumnsRenamed({"source": "s"}).join(
        aimed.withColumnRenamed("source", "a"), F.col("s").eqNullSafe(F.col("a"))
    )
    based = based.select("s", F.col("bucket").alias("b"), "base", "source_size", "target", "segments")
    joined = sized.join(based, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = Window.partitionBy("s", "b").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = joined.withColumn("begin", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    laid = laid.withColumn("due", F.round("target").cast("long"))
    full = F.when(F.col("source_size") > 0, F.expr("due div source_size")).otherwise(F.lit(0))
    laid = laid.withColumn("full", full).withColumn("rest", F.col("due") - F.col("full") * F.col("source_size"))
    over = F.greatest(F.lit(0), F.least(F.col("rest") - F.col("begin"), F.col("size")))
    taken = F.col("full") * F.col("size") + over
    last = (over > 0) & (over * 2 >= F.col("size"))
    share = F.least(F.col("begin") / F.col("target"), F.lit(1.0))
    first = F.when(taken > 0, F.least(moment(share, F.col("segments")), F.lit(1.0)))
    return laid.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        (F.when(F.col("size") > 0, F.col("full")).otherwise(F.lit(0)) + last.cast("long")).alias("copies"),
        first.alias("first_position"),
        "begin",
        "segments",
        "digest",
    )


def _due(pass_: Column) -> Column:
    """The training position of a document's ``pass_``-th reading."""
    demand = (F.col("begin") + pass_ * F.col("source_size")) / F.col("target")
    return F.least(moment(F.least(demand, F.lit(1.0)), F.col("segments")), F.lit(1.0))


def occurrences(assigned: DataFrame) -> DataFrame:
    """One row per copy of a whole document: doc_id, pass, size, position."""
    each = assigned.where("copies > 0").withColumn("pass", F.explode(F.expr("sequence(0L, copies - 1)")))
    return each.select("doc_id", "source", "pass", "size", _due(F.col("pass")).alias("position"), "digest")


def schedule(assigned: DataFrame) -> DataFrame:
    """The mix itself, stored in training order over ranges: a row per document and pass, with its words.

    The last pass may take a part of a document. Documents of which nothing is taken stand first,
    with null pass and position.
    """
    passes = F.when(F.col("taken") > 0, F.expr("sequence(0L, (taken - 1) div size)"))
    each = assigned.withColumn("pass", F.explode_outer(passes))
    read = F.col("pass").isNotNull()
    words_ = F.when(read, F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))).otherwise(0)
    position = F.when(read, _due(F.col("pass")))
    each = each.select(
        "doc_id", "source", "begin", "size", "source_size", "target", "pass", words_.alias("words"), position.alias("position"), "digest"
    )
    return stored(each.repartitionByRange("position", "digest").sortWithinPartitions("position", "digest", "pass"), "mix")


def tally(mix: DataFrame) -> DataFrame:
    """Per document of a ``schedule``: its words in the mix, readings, first and last position."""
    told = ("doc_id", "size", "source_size", "target")
    idle = mix.where("pass IS NULL").select(
        *told, "words", F.lit(0).cast("long").alias("passes"), F.col("position").alias("first"), F.col("position").alias("last")
    )
    read = mix.where("pass IS NOT NULL").groupBy("source", "begin").agg(
        *[F.min(c).alias(c) for c in told],
        F.sum("words").alias("words"),
        F.count("pass").alias("passes"),
        F.min("position").alias("first"),
        F.max("position").alias("last"),
    )
    names = {"words": "taken", "first": "first_position", "last": "last_position"}
    return idle.unionByName(read.drop("source", "begin")).withColumnsRenamed(names)


def curriculum(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    curves: Sequence = CURVES,
    most_passes: int = MOST_PASSES,
) -> DataFrame:
    """The documents as often as the mix takes them, all columns, sorted by training position over ranges.

    Rows that share id, source and size are told apart by number, so each gets its own copies.
    """
    key = ["__id", "__source", "__size", "__nth"]
    rows = docs.select(
        F.struct("*").alias("__row"),
        docs[id_col].alias("__id"),
        docs[source_col].cast("string").alias("__source"),
        words(docs[text_col]).alias("__size"),
    )
    nth = Window.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64("__row"))
    rows = rows.withColumn("__nth", F.row_number().over(nth))
    assigned = assign(docs, id_col, text_col, source_col, weights, curves, most_passes)
    same = Window.partitionBy("doc_id", "source", "size").orderBy("begin")
    due = occurrences(assigned.withColumn("nth", F.row_number().over(same)).withColumn("digest", F.struct("digest", "nth")))
    due = due.select("doc_id", "source", "size", F.col("digest.nth").alias("nth"), "position", "digest")
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(key, ("doc_id", "source", "size", "nth"), strict=True)]
    met = rows.join(due, on[0] & on[1] & on[2] & on[3])
    return met.repartitionByRange("position", "digest").sortWithinPartitions("position", "digest").select("__row.*")

"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight; the words of all documents are shared out by weight, but no source gets more than `repeats`
times what it holds, and what is left over is shared out again. Over training time t from 0 to 1 a source is drawn with
the schedule target * (1 + slope * (2t - 1)); its integral is target * (t + slope * (t*t - t)). A source's documents stand
in the order of a hash of their id, once for each pass; the words before a copy, as cumulative demand, are put into
the integral's inverse, which gives the copy's training position. The copy that crosses the target is cut there.

A source's running sums are made in two steps, by the hash's leading digits and within them, so no task
gets a whole source. Nothing but sums of sources goes through a single task.

Defined cases: texts of any length count whole. Columns named as the scratch ones, with two underscores before, are not taken. A null text has no words, and a document without words is taken 0 times at the position where it would
stand. A null source is a source, the last one. Ties of the hash are ordered by id and size; rows alike in all three are
interchangeable, and each counts. Without any word all targets are 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.llm.common import count_words, written

WEIGHTS, REPEATS = (1, 2, 3), 3
#: How a source's weight changes over time, repeating over the sources: falling, level, rising.
SLOPES = (-0.5, 0.0, 0.5)
#: Rows of a source that one task sorts, about.
ROWS_A_BUCKET = 4_000


def _cycled(values: Sequence, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: Sequence[int], repeats: int, slopes: Sequence[float]) -> DataFrame:
    """For each source of (source, size): source_size, target and slope. A table of one row for each source."""
    totals = sizes.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("__source").asc_nulls_last()))
    totals = totals.withColumn("rank", rank).withColumn("weight", _cycled(weights, F.col("rank")).cast("long"))
    totals = totals.withColumn("slope", _cycled(slopes, F.col("rank"))).withColumn("cap", F.col("source_size") * repeats)
    # sources reach their caps in the order of cap / weight; those before take their caps, the rest is shared by weight
    by = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    earlier, later = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    totals = totals.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
    totals = totals.withColumn("shared", F.sum("weight").over(later))
    totals = totals.withColumn("capped", F.col("cap") * F.col("shared") <= F.col("weight") * F.col("left"))
    free = F.when(~F.col("capped"), F.col("left"))
    totals = totals.withColumn("level_left", F.max(free).over(everything)).withColumn("level_shared", F.max(F.when(~F.col("capped"), F.col("shared"))).over(everything))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("level_left")).cast("double") / F.col("level_shared"))
    return totals.select("__source", "source_size", target.alias("target"), "slope")


def position(demand: Column, slope: Column) -> Column:
    """The time at which a share of the target has been drawn: the inverse of t + slope * (t*t - t)."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * demand)
    return F.when(slope == 0, demand).otherwise((root - (1 - slope)) / (2 * slope))


def assigned(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None,
    weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, slopes: Sequence[float] = SLOPES, rows_a_bucket: int = ROWS_A_BUCKET,
) -> DataFrame:
    """Adds the struct column `mix`: size, source_size, target, taken (words, repeats counted) and copies, an array of
    (copy, words, position). size names a column of word counts, if there is one. A column named mix is replaced."""
    counted = F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else count_words(F.col(text))
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    rows = docs.drop("mix").withColumns({"__source": F.col(source).cast("string"), "__size": counted, "__order": key})
    # sums and buckets are made of a slim table, so that texts are counted for it once and for their own rows once
    slim = docs.select(F.col(source).cast("string").alias("__source"), counted.alias("__size"), key.alias("__order"))
    slim = slim if size else written(slim, "sizes")
    digits = max(0, math.ceil(math.log(max(1, slim.count()) / rows_a_bucket, 16)))
    lead = F.substring("__order", 1, digits)
    rows = rows.withColumn("__lead", lead)

    goal = targets(slim, weights, repeats, slopes)
    before = F.sum("__words").over(W.partitionBy("__source").orderBy("__lead").rowsBetween(W.unboundedPreceding, -1))
    buckets = slim.groupBy("__source", lead.alias("__lead")).agg(F.sum("__size").alias("__words")).withColumn("__base", F.coalesce(before, F.lit(0)))
    b, g = buckets.alias("b"), goal.alias("g")
    buckets = b.join(g, F.col("b.__source").eqNullSafe(F.col("g.__source"))).select(
        F.col("b.__source").alias("__of"), F.col("b.__lead").alias("__in"), "__base", F.struct("source_size", "target", "slope").alias("__goal")
    )
    joined = rows.join(buckets, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__lead") == F.col("__in")))
    order = W.partitionBy("__source", "__lead").orderBy("__order", doc_id, "__size").rowsBetween(W.unboundedPreceding, -1)
    joined = joined.withColumn("__start", F.col("__base") + F.coalesce(F.sum("__size").over(order), F.lit(0)))

    whole = F.floor(F.col("__goal.target") + 0.5)
    copies = []
    for k in range(repeats):
        begins = F.col("__start") + F.col("__goal.source_size") * k
        words = F.greatest(F.lit(0), F.least(F.col("__size"), whole - begins)).cast("long")
        demand = F.coalesce(F.least(F.lit(1.0), begins / F.when(F.col("__goal.target") > 0, F.col("__goal.target"))), F.lit(0.0))
        copies.append(F.struct(F.lit(k).alias("copy"), words.alias("words"), position(demand, F.col("__goal.slope")).alias("position")))
    all_copies = F.array(*copies)
    taken = sum((c.getField("words") for c in copies), F.lit(0).cast("long"))
    mix = F.struct(F.col("__size").alias("size"), F.col("__goal.source_size").alias("source_size"), F.col("__goal.target").alias("target"), taken.alias("taken"), all_copies.alias("copies"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != "mix"], mix.alias("mix"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The training order: one row for each copy that the mix takes at least half of, range-sorted by position; the columns of docs."""
    rows = assigned(docs, **options)
    rows = rows.withColumn("__copy", F.explode(F.filter("mix.copies", lambda c: (c["words"] > 0) & (2 * c["words"] >= F.col("mix.size")))))
    first = options.get("doc_id", "doc_id")
    return rows.orderBy("__copy.position", first, "__copy.copy").select(*[F.col(f"`{c}`") for c in docs.columns])

"""Reports: confusion, rates by group, shares by tier, percentiles, cost, mining of phrases, and rounds of self-play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.config import COSTS, RiskConfig
from saltmarsh.functions.spans import exploded, let
from saltmarsh.storage import written


def confusion(rows: DataFrame, expected: Column, actioned: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1, friction."""
    n = lambda c: F.count_if(c)
    c = rows.agg(n(expected & actioned).alias("tp"), n(~expected & actioned).alias("fp"), n(expected & ~actioned).alias("fn"), n(~expected & ~actioned).alias("tn"))
    share = lambda a, b: F.when(F.lit(0) != b, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(fp, fp + tn).alias("friction"))


def by_group(rows: DataFrame, group: str, expected: Column, actioned: Column) -> DataFrame:
    """For each group and expectation: rows, actioned, rate."""
    g = rows.groupBy(F.col(group).alias("grp"), expected.alias("expected")).agg(F.count("*").alias("n"), F.count_if(actioned).alias("actioned"))
    return g.withColumn("rate", F.col("actioned") / F.col("n"))


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Rows and their share by a column's value."""
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    every = F.sum("n").over(W.partitionBy())  # of one row for each value
    return counted.withColumn("share", F.col("n") / every)


SHARES = (0.5, 0.95, 0.99)


def percentiles(rows: DataFrame, column: str) -> DataFrame:
    """One row: p50, p95, p99 and max, exactly, with the mean by distance of the values on both sides. Distinct values are put in order in parts; the
    parts' sizes tell which of them hold the ranks asked for, and only those few are counted through. The aggregate of that name holds all values in one place."""
    values = rows.select(F.col(column).cast("double").alias("__value")).where("__value IS NOT NULL").groupBy("__value").agg(F.count("*").alias("__times"))
    held = written(values.orderBy("__value").withColumn("__part", F.spark_partition_id()), "values")
    parts = held.groupBy("__part").agg(F.sum("__times").alias("__size"), F.max("__value").alias("__most"))  # a row for each part
    parts = parts.withColumns({"__begin": F.sum("__size").over(W.orderBy("__part")) - F.col("__size"), "__all": F.sum("__size").over(W.partitionBy()), "__top": F.max("__most").over(W.partitionBy())})
    ranks = [(F.floor(s * (F.col("__all") - 1)), F.ceil(s * (F.col("__all") - 1))) for s in SHARES]
    asked = F.lit(False)
    for low, high in ranks:
        asked = asked | ((F.col("__begin") <= high) & (F.col("__begin") + F.col("__size") > low))
    last = F.col("__begin") + F.sum("__times").over(W.partitionBy("__part").orderBy("__value")) - 1
    near = held.join(F.broadcast(parts.where(asked)), "__part").withColumn("__last", last)
    at = lambda rank: F.max(F.when((rank <= F.col("__last")) & (rank > F.col("__last") - F.col("__times")), F.col("__value")))
    found = near.agg(F.max("__all").alias("__all"), F.max("__top").alias("max"), *[at(r).alias(f"__{k}{side}") for k, pair in enumerate(ranks) for side, r in zip("ab", pair)])

    def between(k: int) -> Column:
        place, a, b = SHARES[k] * (F.col("__all") - 1), F.col(f"__{k}a"), F.col(f"__{k}b")
        return F.when(a == b, a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b)

    return found.select(*[between(k).alias(f"p{round(s * 100)}") for k, s in enumerate(SHARES)], "max")


def cost_per_100k(share: Column) -> Column:
    return share * 100_000 * (COSTS["inTokens"] * COSTS["inPerMillion"] + COSTS["outTokens"] * COSTS["outPerMillion"]) / 1_000_000


def health(spark: SparkSession, config: RiskConfig, tiers=None) -> DataFrame:
    """One row: which tiers are live, and what happens where the last one gives no answer. tiers: as moderate.Tiers, or none."""
    live = lambda name: getattr(tiers, name, None) is not None
    row = {"status": "ok", "deterministic": True, "trigrams": live("trigrams"), "classifier": live("classifier"), "adjudicator": live("transport")}
    row |= {f"fail_{stage}": mode for stage, mode in sorted(config.failMode.items())}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])


def stats(rows: DataFrame, latency: str = "latency_ms", cost: str = "cost_usd") -> DataFrame:
    """(kind, name, n, share) of verdicts and tiers, and one row `all` with the latency's percentiles and the cost of a hundred thousand messages.
    The rows' few columns are written first, so that what makes them is done once."""
    rows = written(rows.select("verdict", "resolved_by", latency, cost), "stats")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    parts = []
    for kind, column in (("verdict", "verdict"), ("tier", "resolved_by")):
        parts.append(shares(rows, column).select(F.lit(kind).alias("kind"), F.col("value").alias("name"), "n", "share", *[none(c, "double") for c in ("p50", "p95", "p99", "per_100k")]))
    whole = rows.agg(F.count("*").alias("n"), (F.sum(cost) / F.count("*") * 100_000).alias("per_100k")).crossJoin(percentiles(rows, latency))  # of one row each
    whole = whole.select(F.lit("all").alias("kind"), none("name", "string"), "n", F.lit(1.0).alias("share"), "p50", "p95", "p99", "per_100k")
    return parts[0].unionByName(parts[1]).unionByName(whole)


# Words that carry no meaning of their own.
STOPWORDS = (
    "the a an and or but if then me my you your i we us it is are was be to of in on at for with this that can will just please hi hello "
    "hai hain ka ki ke ko se par pe bhi kar"
).split()


def phrases(tokens: Column, longest: int = 3, least_letters: int = 4) -> Column:
    """Distinct phrases of one to three tokens that aren't stopwords."""

    def of(kept: Column) -> Column:
        after = lambda n: F.concat(F.slice(kept, F.lit(n + 1), F.greatest(F.size(kept) - n, F.lit(0))), F.array_repeat(F.lit(None).cast("string"), n))
        # neighbours side by side; a phrase past the end is null
        grams, out = kept, [kept]
        for n in range(1, longest):
            grams = F.zip_with(grams, after(n), lambda a, b: F.concat(a, F.lit(" "), b))
            out.append(grams)
        return F.array_distinct(F.filter(F.concat(*out), lambda p: F.length(p) >= least_letters))

    return let(F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS)), of)


def caught() -> Column:
    """Whether the detectors alone name a row: contact, payment or safety."""
    return F.exists("detections", lambda d: d["type"].rlike("^(contact|safety|payment)[.]"))


def mined(rows: DataFrame, folded: str = "folded", *, least: int = 2, top: int | None = 40) -> DataFrame:
    """Phrases by the number of rows that have them; with top, the most frequent. Of rows with detections only those that aren't caught count."""
    value = phrases(F.split(F.col(folded), r"[^\p{L}\p{N}]+"))
    # no filter: it would go below what makes the detections, and have them made twice
    found = exploded(rows, F.when(~caught(), value) if "detections" in rows.columns else value, "phrase")
    counted = found.groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counted.orderBy(F.desc("n"), "phrase").limit(top) if top else counted


def self_play(candidates: DataFrame, caught: Column) -> tuple[DataFrame, DataFrame]:
    """How many distinct candidates there are (by lower case) and how many of them are caught, in one row at least; and the missed texts."""
    distinct = candidates.groupBy(F.lower("text").alias("__lower")).agg(F.max(caught).alias("__caught"), F.min("text").alias("text"))
    rate = distinct.agg(F.count("*").alias("n"), F.count_if("__caught").alias("caught"))
    return rate, distinct.where("NOT __caught").select("text")


#: Rows that are put in order together for a replay, about.
ROWS_A_BUCKET = 100_000


def replayed(rows: DataFrame, order: str = "message_id", size: int = 12, seconds: int = 1) -> DataFrame:
    """Single messages as conversations of `size` each, but the last with what is left, some seconds apart: conversation_id and ts replace what was
    there. Rows are numbered in buckets by a hash of their ids, each bucket from where those before it end, so that no global order is needed."""
    buckets = max(1, -(-rows.count() // ROWS_A_BUCKET))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    sizes = rows.groupBy("__bucket").agg(F.count("*").alias("__size"))  # a row for each bucket
    begins = sizes.select("__bucket", (F.sum("__size").over(W.orderBy("__bucket")) - F.col("__size")).alias("__begin"))
    place = F.col("__begin") + F.row_number().over(W.partitionBy("__bucket").orderBy(F.xxhash64(order), order)) - 1
    rows = rows.join(F.broadcast(begins), "__bucket").withColumn("__place", place)
    name = F.concat_ws("-", F.lit("replay"), F.floor(F.col("__place") / size).cast("string"))
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("__place") % size * seconds)
    return rows.withColumns({"conversation_id": name, "ts": ts}).drop("__bucket", "__begin", "__place")

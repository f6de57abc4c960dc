"""Character trigram model: trained by counting, and applied to a message's tokens."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.spans import exploded

ALPHABET, LEAST = 37, 4
PERCENTILE = 0.995


@dataclass
class TrigramModel:
    """log_probs (trigram, logp): one row for each trigram of 37 characters, 50,653 at most."""

    log_probs: DataFrame
    unseen: float
    threshold: float


def clean(text: Column) -> Column:
    """Lower case, all but ASCII letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +", " "))


def tokens(text: Column) -> Column:
    """Tokens that are scored: letters and digits, long enough, with a letter."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) >= LEAST) & t.rlike(r"\p{L}"))


def trigrams(token: Column) -> Column:
    padded = F.concat(F.lit(" "), token, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(trigram, n) over all tokens of the cleaned texts, which may be short."""
    words = exploded(texts, F.split(clean(F.coalesce(F.col(text), F.lit(""))), " "), "token").where("token <> ''")
    return exploded(words.groupBy("token").count(), trigrams(F.col("token")), "trigram", kept=["count"]).groupBy("trigram").agg(F.sum("count").alias("n"))


def smoothed(trigram_counts: DataFrame) -> tuple[DataFrame, float]:
    """Add-one smoothing over all trigrams of the alphabet: (trigram, logp), and the value of unseen ones."""
    total = trigram_counts.agg(F.sum("n")).first()[0] or 0
    space = total + ALPHABET**3
    return trigram_counts.select("trigram", F.log((F.col("n") + 1) / F.lit(space)).alias("logp")), math.log(1 / space)


def token_scores(tokens_: DataFrame, log_probs: DataFrame, unseen: float) -> DataFrame:
    """(token, score) for distinct tokens: the mean of the trigrams' -logp. The model's few rows are broadcast."""
    parts = tokens_.select("token").distinct().select("token", F.explode(trigrams(F.col("token"))).alias("trigram"))
    joined = parts.join(F.broadcast(log_probs), "trigram", "left")  # 50,653 rows at most
    return joined.groupBy("token").agg((-F.avg(F.coalesce("logp", F.lit(unseen)))).alias("score"))


def train(texts: DataFrame, text: str = "text") -> TrigramModel:
    """The model of texts; its threshold is a high percentile over every occurrence of a token."""
    log_probs, unseen = smoothed(counts(texts, text))
    found = exploded(texts, tokens(clean(F.coalesce(F.col(text), F.lit("")))), "token").groupBy("token").count()
    scores = token_scores(found, log_probs, unseen).join(found, "token")
    threshold = scores.agg(F.percentile("score", F.lit(PERCENTILE), F.col("count"))).first()[0]
    return TrigramModel(log_probs, unseen, round(threshold or 0.0, 3))


def with_weirdness(df: DataFrame, model: TrigramModel, key: str, view: str = "folded") -> DataFrame:
    """Adds weird_score (the highest of a token) and weird_tokens to rows with a unique key."""
    letters = F.regexp_replace("token", r"[^\p{L}]", "")
    found = exploded(df, tokens(F.col(view)), "token", kept=[key]).withColumn("letters", letters)
    every = found.select("token").union(found.where(F.length("letters") >= LEAST).select("letters"))
    scores = token_scores(every, model.log_probs, model.unseen)
    own = found.join(scores, "token").join(scores.select(F.col("token").alias("letters"), F.col("score").alias("letter_score")), "letters", "left")
    within, digits = F.col("token").rlike(r"\p{L}[0-9]+\p{L}"), F.col("token").rlike("[0-9]")
    projected = (F.length("letters") >= LEAST) & (F.col("letters") != F.col("token"))
    judged = F.when(within | ~digits, F.col("score")).when(projected, F.col("letter_score"))
    weird = F.coalesce(judged > model.threshold, F.lit(False))
    per_row = own.groupBy(key).agg(F.max("score").alias("weird_score"), F.count_if(weird).cast("int").alias("weird_tokens"))
    return df.join(per_row, key, "left").fillna({"weird_score": 0.0, "weird_tokens": 0})

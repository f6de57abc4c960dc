"""The stateless cascade over messages: views, runs, detections, score, verdict; and, where they are given, a trigram model, a classifier for
what the score leaves open, and an adjudicator for what the classifier does. Without these it is one chain of projections, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.config import RiskConfig
from saltmarsh.functions import detectors, digitruns, normalize, score
from saltmarsh.operators import adjudicate, classifier, weirdness
from saltmarsh.storage import written

#: What later steps read of an analysed row, besides the message's own columns.
ANALYSIS = ["folded", "denoised", "runs", "detections", "zero_width", "confusables", "leet", "noise"]


@dataclass
class Tiers:
    """What is live besides the rules. cache: (key, reply, used) of earlier replies."""

    trigrams: weirdness.TrigramModel | None = None
    classifier: classifier.Classifier | None = None
    transport: Callable[[str], str] | None = None
    cache: DataFrame | None = None

    @property
    def adjudicates(self) -> bool:
        return self.transport is not None or self.cache is not None


def analysed(messages: DataFrame, config: RiskConfig | None = None, *, ascii_only: bool = False) -> DataFrame:
    """Adds the views, runs and detections to rows with text. Places of detections, and raw_start and raw_end of runs, are in the text."""
    config = config or RiskConfig()
    df = normalize.with_views(messages, compat=config.compat, ascii_only=ascii_only)
    df = df.withColumn("runs", digitruns.runs(F.col("denoised"), 1, config.compat))
    return detectors.with_detections(df, config).drop("raw_at", "noise_at")


def slim(df: DataFrame, messages: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in messages.columns if c not in ANALYSIS], *ANALYSIS)


def moderated(messages: DataFrame, config: RiskConfig | None = None, tiers: Tiers | None = None, *, ascii_only: bool = False) -> DataFrame:
    """Also score, band, verdict, resolved_by, confidence and categories. With tiers, message_id is a unique key, and weird_score,
    weird_tokens, probability and tier5 are there as far as they apply. An adjudicator is asked about every message left to review."""
    config = config or RiskConfig()
    df = analysed(messages, config, ascii_only=ascii_only)
    if tiers is None:
        return score.with_verdict(score.with_score(df, config), config)
    df = written(slim(df, messages), "analysed")
    if tiers.trigrams is not None:
        df = weirdness.with_weirdness(df, tiers.trigrams, "message_id")
    return resolved(score.with_score(df, config), config, tiers, every_review=True)


def resolved(scored: DataFrame, config: RiskConfig, tiers: Tiers, *, every_review: bool, evidence: str = "detections") -> DataFrame:
    """Verdicts of scored rows with the later tiers: only rows of the band in between reach the classifier, and only what it leaves open
    (or, with every_review, whatever is left to review) the adjudicator. evidence: the detections that the classifier sees."""
    if tiers.classifier is not None or tiers.adjudicates:
        scored = written(scored, "scored")
    if tiers.classifier is not None:
        scored = scored.withColumn("probability", classifier.probability(scored, tiers.classifier, F.col("band") == "escalate", evidence))
        scored = scored.withColumn("tier4", F.when(F.col("band") == "escalate", score.decided(F.col("probability"), tiers.classifier.allow, tiers.classifier.block)))
    if not tiers.adjudicates:
        return score.with_verdict(scored, config)
    before = score.with_verdict(scored, config)
    open_ = F.col("verdict") == "review" if every_review else (F.col("band") == "escalate") & (F.coalesce("tier4", F.lit("escalate")) == "escalate")
    before = before.withColumn("__key", F.when(open_, adjudicate.cache_key(F.col("folded"))))
    found, _ = adjudicate.adjudicated(before.where("__key IS NOT NULL").select("folded"), tiers.transport, tiers.cache)
    v = F.col("verdict")
    told = found.select(F.col("key").alias("__key"), F.struct("source", "ok", F.coalesce(v["contact"] | v["safety"], F.lit(False)).alias("flagged"), v.alias("said")).alias("tier5"))
    # rows that nothing is asked about are most, and would all meet under one key
    before = before.withColumn("__key", F.coalesce("__key", F.concat(F.lit("-"), F.xxhash64("message_id").cast("string"))))
    rows = before.drop("verdict", "resolved_by", "confidence", "categories", "tier5").join(told, "__key", "left").drop("__key")
    return score.with_verdict(rows, config, every_review=every_review)

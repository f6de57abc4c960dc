"""The cascade over whole conversations: the stateless one with session state, re-scans and merged fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.config import RiskConfig
from saltmarsh.functions import policy, score
from saltmarsh.operators import moderate, session, weirdness
from saltmarsh.sources import messages as messages_
from saltmarsh.storage import written


def moderated(messages: DataFrame, config: RiskConfig | None = None, tiers: moderate.Tiers | None = None, *, ascii_only: bool = False) -> DataFrame:
    """Rows with message_id, conversation_id, sender_role, booking_stage, ts and text; message ids are unique. What a re-scan finds counts in the score
    and is named in cross_message_categories; categories and places are those of the message alone. An adjudicator is asked about what the classifier leaves open."""
    config, tiers = config or RiskConfig(), tiers or moderate.Tiers()
    df = written(moderate.slim(moderate.analysed(messages, config, ascii_only=ascii_only), messages), "analysed")
    df = written(session.with_session(df, config), "sessions")
    joint = df.where(F.col("rescan_text").isNotNull() & (F.size("runs") > 0)).select("message_id", F.col("rescan_text").alias("text"))
    joint = moderate.analysed(messages_.spread(joint), config, ascii_only=ascii_only).select("message_id", F.col("detections").alias("joint"))
    df = df.join(written(joint, "joint"), "message_id", "left")
    cross = F.coalesce(session.recovered(F.col("joint"), F.col("detections")), F.array().cast(dict(df.dtypes)["detections"]))
    df = df.withColumn("cross", cross).withColumn("fragments", session.fragments(F.col("runs"), F.col("denoised"), F.col("detections"), config.compat))
    df = df.join(session.merged_numbers(df, config), "message_id", "left").withColumn("evidence", F.concat("detections", "cross"))
    if tiers.trigrams is not None:
        df = weirdness.with_weirdness(df, tiers.trigrams, "message_id")
    df = score.with_score(df, config, detections="evidence")
    df = completed(df, config).withColumn("cross_message_categories", F.array_distinct(F.transform("cross", lambda d: d["type"])))
    df = df.withColumn("pressure_after", F.col("digit_pressure") + session.pressure())
    df = moderate.resolved(df, config, tiers, every_review=False, evidence="evidence")
    return session.strikes(df, F.col("band") == "block").drop("joint", "cross", "evidence")


def completed(df: DataFrame, config: RiskConfig) -> DataFrame:
    """A number that fragments complete decides: the score is past the upper bound."""
    whole, high = F.col("merged").isNotNull(), config.bands["high"]
    terms = F.when(whole, F.map_concat("terms", F.create_map(F.lit("mergedFragments"), F.lit(config.weights["validPhone"])))).otherwise(F.col("terms"))
    return df.withColumns({"score": F.when(whole, F.greatest("score", F.lit(high + 1))).otherwise(F.col("score")), "band": F.when(whole, "block").otherwise(F.col("band")), "terms": terms})


def delivered(df: DataFrame, config: RiskConfig | None = None, *, prefer_masking: bool = False) -> DataFrame:
    """What moderated() gives with the policy's columns; the cooldown counts earlier messages of the sender that the policy blocked."""
    config = config or RiskConfig()
    df = policy.with_policy(df, prefer_masking=prefer_masking).drop("cooldown", "recent_blocks")
    df = session.recent_blocks(df, F.col("action") == "block", config)
    return df.withColumn("cooldown", F.col("recent_blocks") >= config.policy["blockCooldownThreshold"])

"""Conversations over time: decayed pressure, remembered messages, strikes, rate limits, and the merging of number fragments.

All but the merging are window frames. Merging consumes what it has merged, so it is a fold over a conversation's fragments in
order; it runs on the few messages with fragments, and apart for stretches that are further apart than a fragment lives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.config import RiskConfig
from saltmarsh.functions.spans import ascii_words

# Words near a number that explain it.
EXPLAINED = ascii_words(
    r"(?i)\b(?:flight|pnr|train|seat|gate|room|villa|flat|apt|floor|lane|door|house|pin|pincode|zip|postal|gst|invoice|ref|booking|order|check|checkin|checkout|night|nights"
    r"|day|days|adult|adults|kid|kids|guest|guests|person|people|am|pm|rs|inr|price|cost|total|rate|deposit|refund|km|kms|metre|meters|m|gb|mb|tb|iphone|samsung|pixel|pro|max"
    r"|plus|wifi|password|code)\b"
)
NEAR = 20
MOBILE = re.compile(r"(?:91)?[6-9][0-9]{9}")
RECOVERABLE = r"^(contact\.phone|payment\.upi|contact\.email)"
#: Half-lives in a block; what is two blocks old has decayed to nothing.
BLOCK = 400
#: Earlier rows whose decayed amounts are added one by one.
TERMS = 256


def millis(ts: str = "ts") -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def decayed_sum(df: DataFrame, key: str, amount: Column, half_life_ms: int, into: str, *, ts: str = "ts", order: str = "message_id") -> DataFrame:
    """Adds the sum of earlier rows' amounts, each halved for every half-life since. The last TERMS rows are added one by one, from the latest
    back, as scores on a bound hang on the last bit; what is before them comes in as one running sum. Running sums are within blocks
    of time, so that powers of two stay in range; the block before comes in by its total."""
    t, span = millis(ts), half_life_ms * BLOCK
    df = df.withColumns({"__ms": t, "__block": F.floor(t / span), "__amount": amount.cast("double")})
    since = (F.col("__ms") - F.col("__block") * span) / half_life_ms
    weighted = F.col("__amount") * F.pow(F.lit(2.0), since)
    earlier = W.partitionBy(key, "__block").orderBy("__ms", order).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(F.col(key).alias("__key"), (F.col("__block") + 1).alias("__next")).agg(F.sum(weighted).alias("__total"))
    df = df.withColumn("__own", F.coalesce(F.sum(weighted).over(earlier), F.lit(0.0)))
    df = df.join(totals, (F.col(key) == F.col("__key")) & (F.col("__block") == F.col("__next")), "left")
    running = F.col("__own") * F.pow(F.lit(2.0), -since) + F.coalesce("__total", F.lit(0.0)) * F.pow(F.lit(2.0), -since - BLOCK)
    w = W.partitionBy(key).orderBy("__ms", order)
    left = lambda x: x["amount"] * F.pow(F.lit(2.0), -(F.col("__ms") - x["ms"]) / half_life_ms)
    df = df.withColumns({
        "__near": F.reverse(F.collect_list(F.struct(F.col("__ms").alias("ms"), F.col("__amount").alias("amount"))).over(w.rowsBetween(-TERMS, -1))),
        "__far": F.lag(F.struct(F.col("__ms").alias("ms"), (running + F.col("__amount")).alias("amount")), TERMS + 1).over(w),
    })
    value = F.aggregate("__near", F.lit(0.0), lambda total, x: total + left(x)) + F.coalesce(left(F.col("__far")), F.lit(0.0))
    return df.withColumn(into, value).drop("__ms", "__block", "__amount", "__own", "__key", "__next", "__total", "__near", "__far")


def pressure() -> Column:
    """What a message adds to the digit pressure: its digits, a fifth of them once there is a booking."""
    digits = F.aggregate(F.transform("runs", lambda r: F.length(r["digits"])), F.lit(0), lambda a, b: a + b)
    return digits / F.when(F.col("booking_stage") == "post_booking", 5.0).otherwise(1.0)


def intent_hits() -> Column:
    """What a message adds to the session's intent: its detections of intent."""
    return F.size(F.filter("detections", lambda d: d["type"].startswith("intent.")))


def kinds(detections: Column) -> Column:
    return F.array_distinct(F.transform(detections, lambda d: d["type"]))


def with_session(df: DataFrame, config: RiskConfig | None = None) -> DataFrame:
    """Adds digit_pressure, session_intent, last_messages, rescan_text and seen (types that a remembered message of the sender had) to rows
    with runs and detections."""
    config = config or RiskConfig()
    half = config.session["digitPressureHalfLifeMs"]
    df = decayed_sum(df, "conversation_id", pressure(), half, "digit_pressure")
    df = decayed_sum(df, "conversation_id", intent_hits(), half, "session_intent")
    before = W.partitionBy("conversation_id").orderBy("ts", "message_id").rowsBetween(-config.session["lastMessagesSize"], -1)
    df = df.withColumn("last_messages", F.collect_list(F.struct("sender_role", "text", kinds(F.col("detections")).alias("types"))).over(before))
    own = F.filter("last_messages", lambda m: m["sender_role"] == F.col("sender_role"))
    recent = F.slice(own, F.greatest(F.size(own) - config.session["windowedRescanMessages"] + 1, F.lit(1)), F.lit(config.session["windowedRescanMessages"]))
    texts = F.transform(recent, lambda m: m["text"])
    seen = F.array_distinct(F.flatten(F.transform(own, lambda m: m["types"])))
    return df.withColumns({"rescan_text": F.when(F.size(own) > 0, F.concat_ws(" ", F.array_join(texts, " "), F.col("text"))), "seen": seen})


def recovered(joint: Column, own: Column) -> Column:
    """Detections of a re-scan that no message alone had, and that reach into this message, the last of the joined text: what lies in
    earlier ones says nothing about it. Rows have seen, rescan_text and text."""
    begins = F.length("rescan_text") - F.length("text")
    known = F.array_union(F.col("seen"), kinds(own))
    return F.filter(joint, lambda d: d["type"].rlike(RECOVERABLE) & ~F.array_contains(known, d["type"]) & (d["end"] > begins))


def strikes(df: DataFrame, blocked: Column) -> DataFrame:
    """Adds strikes: blocks of the conversation up to this message."""
    so_far = W.partitionBy("conversation_id").orderBy("ts", "message_id").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("strikes", F.sum(blocked.cast("int")).over(so_far))


def recent_blocks(df: DataFrame, blocked: Column, config: RiskConfig | None = None) -> DataFrame:
    """Adds recent_blocks: of the same sender, before this message and within the cooldown's window."""
    reach = (config or RiskConfig()).policy["blockCooldownWindowMs"]
    lately = W.partitionBy("conversation_id", "sender_role").orderBy(millis()).rangeBetween(-reach, -1)
    return df.withColumn("recent_blocks", F.coalesce(F.sum(blocked.cast("int")).over(lately), F.lit(0)))


def fragments(runs: Column, text: Column, detections: Column, compat: bool = False) -> Column:
    """Digits of the runs that may be part of a number: not a whole one, not part of something else, not explained by a neighbour."""

    def loose(r: Column) -> Column:
        whole = r["digits"].rlike("^(91)?[6-9][0-9]{9}$")
        within = F.substring(text, r["start"] + 1, r["end"] - r["start"])
        before = F.substring(text, F.greatest(r["start"] - NEAR, F.lit(0)) + 1, F.least(r["start"], F.lit(NEAR)))
        after = F.substring(text, r["end"] + 1, F.lit(NEAR))
        glued = before.rlike("(?i)[a-z]$") | after.rlike("(?i)^[a-z]") | (within.rlike("(?i)[a-z]") if compat else F.lit(False))
        other = F.exists(detections, lambda d: ~d["type"].startswith("contact.phone") & ~d["type"].startswith("intent.") & (d["start"] <= r["raw_start"]) & (d["end"] >= r["raw_end"]))
        return ~(whole | glued | other | before.rlike(EXPLAINED) | after.rlike(EXPLAINED))

    return F.transform(F.filter(runs, loose), lambda r: r["digits"])


#: What a fold over fragments takes.
FOLDED = ["conversation_id", "__island", "message_id", "__ms", "sender_role", "fragments"]


def merge_step(buffer: list[tuple], ms: int, sender: str, digits: list[str], *, window_ms: int, most: int) -> tuple[list[tuple], str | None]:
    """One message: the fragments that are kept, and the number that it completes, if any. Batch and stream share it."""
    buffer = [f for f in buffer if ms - f[0] <= window_ms] + [(ms, sender, d) for d in digits]
    buffer = buffer[-most:]
    own = [(k, f[2]) for k, f in enumerate(buffer) if f[1] == sender]
    best = None
    for a in range(len(own)):
        for b in range(len(own), a + 1, -1):
            joined = "".join(d for _, d in own[a:b])
            if 10 <= len(joined) <= 12 and MOBILE.fullmatch(joined) and (best is None or len(joined) > len(best[0])):
                best = (joined, {k for k, _ in own[a:b]})
    if best is None or not digits:
        return buffer, None
    return [f for k, f in enumerate(buffer) if k not in best[1]], best[0]


def merged_numbers(df: DataFrame, config: RiskConfig | None = None) -> DataFrame:
    """(message_id, merged): messages whose fragments complete a number with earlier ones of their sender. Rows have fragments."""
    config = config or RiskConfig()
    window_ms, most = config.session["fragmentWindowMs"], config.session["fragmentBufferSize"]
    w = W.partitionBy("conversation_id").orderBy("__ms", "message_id")
    rows = df.where(F.size("fragments") > 0).select("conversation_id", "message_id", "sender_role", millis().alias("__ms"), "fragments")
    apart = F.coalesce((F.col("__ms") - F.lag("__ms").over(w) > window_ms).cast("int"), F.lit(0))
    rows = rows.withColumn("__gap", apart).withColumn("__island", F.sum("__gap").over(w.rowsBetween(W.unboundedPreceding, 0)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, stretch = [], None
        for batch in batches:
            out = []
            for conversation, island, message, ms, sender, digits in zip(*[batch[c].to_pylist() for c in FOLDED]):
                if stretch != (conversation, island):
                    buffer, stretch = [], (conversation, island)
                buffer, number = merge_step(buffer, ms, sender, digits, window_ms=window_ms, most=most)
                if number is not None:
                    out.append((message, number))
            columns = [pa.array([m for m, _ in out], batch["message_id"].type), pa.array([n for _, n in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["message_id", "merged"])

    # stretches one after the other in a task: a group of rows for each would cost far more than folding it
    kind = dict(df.dtypes)["message_id"]
    dealt = rows.select(*FOLDED).repartition("conversation_id", "__island").sortWithinPartitions("conversation_id", "__island", "__ms", "message_id")
    return dealt.mapInArrow(fold, f"message_id {kind}, merged string")

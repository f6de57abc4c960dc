"""Risk scores of messages from their detections, runs and signals; bands, verdicts and their confidence."""

from __future__ import annotations

from decimal import Decimal
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.config import CLASSIFIER, RiskConfig
from saltmarsh.functions.spans import ascii_words

# Caps of what earlier messages add, and the wording of reports.
INTENT_CAP, PRESSURE_CAP, PRESSURE_SCALE = 3, 6.0, 12.0
REPORT = ascii_words(
    r"(?i)\b(?:someone|somebody|a person|another guest|another host|some guy|this guy|a stranger|scammer|fraudster|fraud)\b[^.?!]{0,60}"
    r"\b(?:messaged|contacted|called|texted|dmed|dmd|dm|reached out|approached|asked|sent)\b"
    r"|\b(?:is that|is this|are they|was that)\s+(?:real|legit|genuine|actually you|you)\b|\bclaiming to be\b|\bpretending to be\b|\bnever ask(?:s|ed)? for\b"
    r"|\bis it legitimate\b|\bis this a scam\b|\bi got a (?:text|message|call|dm)\b"
)
THING = ascii_words(r"\b(?:number|contact|handle|details)\b")
ASK = ascii_words(r"\b(?:send|give|share|drop|have|whats|what is|bhej|de do)\b")
HARD = ("contact.phone", "contact.phone.obfuscated", "contact.url.messenger")


def count(prefix: str, detections: str = "detections") -> Column:
    return F.size(F.filter(detections, lambda d: d["type"].startswith(prefix)))


def product(a: float, b: float) -> float:
    """Of two settings as they are written: 0.35 times 6 is 2.1, though the product of the doubles is a bit less, and scores on a bound hang on that."""
    return float(Decimal(repr(a)) * Decimal(repr(b)))


def has(*kinds: str, detections: str = "detections") -> Column:
    return F.exists(detections, lambda d: d["type"].isin(*kinds))


def with_score(df: DataFrame, config: RiskConfig | None = None, detections: str = "detections") -> DataFrame:
    """Adds terms (by name), contact, safety, score and band. Rows have folded (or else text), detections, runs, zero_width, confusables, noise,
    booking_stage and sender_role; weird_tokens, digit_pressure and session_intent count as 0 where they are missing."""
    n_of, any_of = partial(count, detections=detections), partial(has, detections=detections)
    config = config or RiskConfig()
    w, sw = config.weights, config.safetyWeights
    df = df.withColumns({c: F.lit(0.0 if c != "weird_tokens" else 0) for c in ("weird_tokens", "digit_pressure", "session_intent") if c not in df.columns})
    lengths = F.transform("runs", lambda r: F.length(r["digits"]))
    df = df.withColumn("__longest", F.coalesce(F.array_max(lengths), F.lit(0)))
    df = df.withColumn("__intents", F.struct(*[n_of(f"intent.{k}").alias(k) for k in ("channel", "contact", "offplatform")], n_of("intent.").alias("all")))
    intents = F.col("__intents")

    ratio = F.least(F.lit(1.0), F.col("__longest") / 10)
    carried = F.least(F.col("session_intent"), F.lit(float(INTENT_CAP)))
    total = intents["all"] + carried
    terms = {
        "validPhone": F.when(any_of("contact.phone", "contact.phone.obfuscated"), w["validPhone"]),
        "partialPhone": F.when(n_of("contact.phone.partial") > 0, w["partialPhone"] * (ratio + F.when(F.col("__longest") >= 8, 1.0).otherwise(0.0))),
        "mixedForm": w["mixedForm"] * F.size(F.filter("runs", lambda r: r["mixed"])),
        "noiseDigitsRemoved": w["noiseDigitsRemoved"] * F.col("noise"),
        "weirdnessFlags": w["weirdnessFlags"] * F.col("weird_tokens"),
        "intentHits": F.when(total > 0, w["intentHits"] * (total + intents["offplatform"])),
    }
    asks = F.exists(detections, lambda d: d["type"].startswith("intent.contact") & d["evidence"].rlike(THING) & d["evidence"].rlike(ASK))
    proposed = (intents["offplatform"] > 0) | ((intents["channel"] > 0) & (intents["contact"] > 0)) | asks
    text = F.coalesce(F.col("folded" if "folded" in df.columns else "text"), F.lit(""))
    running = F.lit(0.0)
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    for t in terms.values():
        running = running + zero(t)
    df = df.withColumns({f"__{k}": zero(v) for k, v in terms.items()}).withColumn("__running", running)
    # from here on against the sum so far
    floor = F.greatest(F.lit(w["offPlatformFloor"]) - F.col("__running"), F.lit(0.0))
    late = {
        "offPlatformFloor": F.when(proposed & ~text.rlike(REPORT), floor),
        "unvalidatedNumber": F.when((F.col("__longest") >= 10) & (intents["contact"] > 0) & (n_of("contact.phone") == 0), w["validPhone"] * 0.75),
        "handle": F.when(n_of("contact.handle") > 0, w["handle"]),
        "address": F.when(n_of("contact.address") > 0, w["address"]),
        "upi": F.when(n_of("payment.upi") > 0, w["upi"]),
        "riskyUrl": w["riskyUrl"] * F.least(F.lit(2), n_of("contact.url.")),
        "digitPressure": F.when(F.col("digit_pressure") > 0, product(w["digitPressure"], PRESSURE_CAP) * (1 - F.exp(-F.col("digit_pressure") / PRESSURE_SCALE))),
        "zeroWidthCount": w["zeroWidthCount"] * F.col("zero_width"),
        "email": F.when(n_of("contact.email") > 0, w["email"]),
        "confusablesFolded": w["confusablesFolded"] * F.col("confusables"),
    }
    safe = {f"safety.hostility.sev{k}": F.lit(sw[f"hostilitySev{k}"]) for k in (3, 2, 1, 0)}
    top = F.coalesce(*[F.when(any_of(k), v) for k, v in safe.items()], F.lit(0.0))
    late_safe = {
        "hostility": top,
        "extortion": F.when(any_of("safety.extortion"), sw["extortion"]).when(any_of("safety.extortion.implied"), sw["extortionImplied"]),
        "scamlink": F.when(n_of("safety.scamlink") > 0, sw["scamlink"]),
    }
    df = df.withColumns({f"__{k}": zero(v) for k, v in (late | late_safe).items()})
    add = lambda names: sum((F.col(f"__{k}") for k in names), F.lit(0.0))
    df = df.withColumns({"contact": F.col("__running") + add(late), "safety": add(late_safe)})
    for name, column, values in (("stage_modifier", "booking_stage", config.modifiers["stage"]), ("role_modifier", "sender_role", config.modifiers["role"])):
        chosen = F.lit(1.0)
        for k, v in values.items():
            chosen = F.when(F.col(column) == k, v).otherwise(chosen)
        df = df.withColumn(name, chosen)
    factor = F.col("stage_modifier") * F.col("role_modifier")
    raw = F.col("contact") * factor + F.col("safety")
    own = (F.col("contact") - F.col("__digitPressure") - w["intentHits"] * carried) * factor + F.col("safety")
    low, high = config.bands["low"], config.bands["high"]
    score = F.when((own < low) & (raw >= low), F.least(raw, F.lit(low - 0.01))).otherwise(raw)
    names = [*terms, *late, *late_safe]
    df = df.withColumn("score", score).withColumn("terms", F.map_filter(F.create_map(*[x for k in names for x in (F.lit(k), F.col(f"__{k}"))]), lambda _, v: v != 0))
    df = df.withColumn("band", F.when(F.col("score") < low, "allow").when(F.col("score") > high, "block").otherwise("escalate"))
    return df.drop("__longest", "__intents", "__running", *[f"__{k}" for k in names])


def decided(probability: Column, allow: float = CLASSIFIER["allow"], block: float = CLASSIFIER["block"]) -> Column:
    return F.when(probability < allow, "allow").when(probability > block, "block").otherwise("escalate")


def hard_evidence() -> Column:
    return has(*HARD) | (count("contact.email") > 0) | (count("payment.upi") > 0)


def with_verdict(df: DataFrame, config: RiskConfig | None = None, *, every_review: bool = False) -> DataFrame:
    """Adds verdict, resolved_by, confidence and categories. Columns that may be there: tier4 (allow, block or escalate),
    tier5 (a struct with source, ok, flagged: what the adjudicator said; null where it wasn't asked). With every_review, it also has the last word on
    what the classifier would allow against hard evidence."""
    config = config or RiskConfig()
    for name, kind in (("tier4", "string"), ("tier5", "struct<source:string,ok:boolean,flagged:boolean>")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    band, four, five = F.col("band"), F.col("tier4"), F.col("tier5")
    settled = (band == "escalate") & F.coalesce(four != "escalate", F.lit(False))
    if every_review:
        settled = settled & ~((four == "allow") & hard_evidence() & five.isNotNull())
    closed = F.lit(False)
    for stage, mode in config.failMode.items():
        closed = F.when(F.col("booking_stage") == stage, F.lit(mode == "closed")).otherwise(closed)
    said = F.when(five["ok"], F.when(five["flagged"], "block").otherwise("allow")).otherwise(F.when(closed, "block").otherwise("review"))
    verdict = (
        F.when(band != "escalate", band)
        .when(settled, F.when((four == "allow") & hard_evidence(), "review").otherwise(four))
        .when(five.isNotNull(), said).otherwise("review")
    )
    by = (
        F.when((band == "allow") & (F.size("detections") == 0), "tier1.normalize")
        .when(band != "escalate", "tier3.risk")
        .when(settled, "tier4.classifier")
        .when(five.isNotNull(), F.when(five["ok"] & (five["source"] == "cache"), "cache").otherwise("tier5.llm"))
        .otherwise(F.when(four.isNotNull(), "tier4.classifier").otherwise("tier3.risk"))
    )
    sure = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)), F.when(band == "allow", 1.0).otherwise(0.0))
    return df.withColumns({"verdict": verdict, "resolved_by": by, "confidence": sure, "categories": F.array_distinct(F.transform("detections", lambda d: d["type"]))})


def rounded(x: Column, digits: int = 3) -> Column:
    """Half up, as the original rounds."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def signals(df: DataFrame) -> Column:
    """What led to a verdict, as JSON; what doesn't apply to a row, or isn't a column of df, is left out."""
    third = lambda c: rounded(F.col(c))
    evidence = F.array_distinct(F.transform(F.filter("detections", lambda d: d["type"].startswith("intent.")), lambda d: d["evidence"]))
    parts = {
        "intent_hits": (["detections"], lambda: evidence), "risk_score": (["score"], lambda: third("score")), "contact_score": (["contact"], lambda: third("contact")),
        "safety_score": (["safety"], lambda: third("safety")), "contributions": (["terms"], lambda: F.transform_values("terms", lambda _, v: rounded(v))),
        "stage_modifier": (["stage_modifier"], lambda: F.col("stage_modifier")), "role_modifier": (["role_modifier"], lambda: F.col("role_modifier")),
        "noise_digits_removed": (["noise"], lambda: F.col("noise")), "zero_width_count": (["zero_width"], lambda: F.col("zero_width")), "confusables_folded": (["confusables"], lambda: F.col("confusables")),
        "digit_runs": (["runs"], lambda: F.size("runs")), "detections": (["detections"], lambda: F.size("detections")), "weirdness": (["weird_score"], lambda: third("weird_score")),
        "weird_tokens": (["weird_score", "weird_tokens"], lambda: F.col("weird_tokens")), "cross_message_categories": (["cross_message_categories"], lambda: F.when(F.size("cross_message_categories") > 0, F.col("cross_message_categories"))),
        "classifier_p": (["probability"], lambda: third("probability")), "classifier_decision": (["tier4"], lambda: F.col("tier4")),
        "llm_source": (["tier5"], lambda: F.col("tier5.source")), "llm_flagged": (["tier5"], lambda: F.when(F.col("tier5.ok"), F.col("tier5.flagged"))),
        "digit_pressure": (["pressure_after"], lambda: third("pressure_after")), "session_intent_hits": (["session_intent"], lambda: third("session_intent")), "strikes": (["strikes"], lambda: F.col("strikes")),
        "merged_fragments": (["merged"], lambda: F.col("merged")),
    }
    return F.to_json(F.struct(*[make().alias(name) for name, (needs, make) in parts.items() if set(needs) <= set(df.columns)]))

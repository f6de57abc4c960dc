"""Registered queries of the cascade over messages of every technique (see messages.techniques): each calls the engine's function of its operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import detectors, digitruns, normalize, policy, score
from saltmarsh.functions.spans import exploded
from saltmarsh.operators import adjudicate, classifier, evaluate, moderate, session, stateful
from saltmarsh.config import RiskConfig, load, parse_env
from saltmarsh.sources import corpus, messages
from saltmarsh.storage import scratch, written

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(c, digits: int = 6) -> Column:
    return F.round(c, digits)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return messages.techniques(messages.spread(spark.read.parquet(f"{folder}/orders.parquet")))


def analysed(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """The texts under some detectors, without those that have no detection."""
    df = normalize.with_views(texts(spark, folder))
    df = df.withColumn("runs", digitruns.runs(F.col("denoised")))
    return detectors.with_detections(df, RiskConfig(), names)


def listed(df: DataFrame) -> DataFrame:
    d = exploded(df, F.col("detections"), "d", kept=["message_id"])
    return d.select("message_id", F.col("d.type").alias("type"), F.col("d.start").cast("long").alias("start"), F.col("d.end").cast("long").alias("end"), rounded("d.confidence").alias("confidence"), F.col("d.evidence").alias("evidence"))


@query
def technique_messages(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).select("message_id", "conversation_id", "sender_role", "booking_stage", "text")


@query
def n1_n11_views(spark: SparkSession, folder: str) -> DataFrame:
    """All views of the texts, their counters, and the places of the folded and denoised views' characters."""
    df = normalize.with_views(texts(spark, folder))
    every = F.when(F.length("folded") > 0, F.sequence(F.lit(0), F.length("folded") - 1)).otherwise(F.array().cast("array<int>"))
    return df.select(
        "message_id", "nfkc", "folded", "deleet", "denoised", *[F.col(c).cast("long").alias(c) for c in ("zero_width", "confusables", "noise")],
        F.array_join(normalize.denoised_offsets(F.col("folded")), ",").alias("denoised_at"), F.array_join(F.coalesce("raw_at.starts", every), ",").alias("folded_at"),
    )


@query
def n12_n20_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every digit run of the texts, with its place in the message."""
    df = exploded(analysed(spark, folder, "phone"), F.col("runs"), "r", kept=["message_id"])
    odd = F.exists("r.seps", lambda s: ~s.isin("none", "space"))
    return df.select("message_id", "r.digits", *[F.col(f"r.{c}").cast("long").alias(c) for c in ("start", "end", "word_n", "num_n", "raw_start", "raw_end")], odd.alias("odd"), "r.mixed")


def _detector(name: str, doc: str, *names: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return listed(analysed(spark, folder, *names))

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run


_detector("d1_d7_phones", "Whole, foreign and partial numbers.", "phone")
_detector("d8_d9_addresses_of_mail", "Plain and spelled mail addresses.", "email")
_detector("d10_d12_d28_links", "Links by class, spoken ones, numbers in them, and those beside words of haste or payment.", "url", "homograph")
_detector("d13_homographs", "Links whose hosts mix scripts.", "homograph")
_detector("d14_d16_d18_handles", "Mentions, accounts on platforms, and pointers to them.", "handle")
_detector("d17_handle_runs", "Digit runs in texts that name a platform.", "handle_run")
_detector("d19_payment_addresses", "Payment addresses.", "upi")
_detector("d20_d21_places", "Access codes and disclosed addresses.", "address")
_detector("d22_d24_intents", "Wishes to leave the platform.", "intent")
_detector("d25_d26_hostility", "Hostile words, masked ones too.", "hostility")
_detector("d27_extortion", "Threats.", "extortion")


@query
def d31_detections(spark: SparkSession, folder: str) -> DataFrame:
    """The union of all detectors, the best for each type and place."""
    return listed(moderate.analysed(texts(spark, folder)))


@query
def r1_r17_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The terms of each text's score."""
    df = exploded(score.with_score(moderate.analysed(texts(spark, folder))), F.col("terms"), "term", "value", kept=["message_id"])
    return df.select("message_id", "term", rounded("value").alias("value"))


@query
def r14_r16_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Sums, modifiers, score and band of each text."""
    df = score.with_score(moderate.analysed(texts(spark, folder)))
    return df.select("message_id", *[rounded(c).alias(c) for c in ("contact", "safety", "stage_modifier", "role_modifier", "score")], "band")


@query
def v1_v3_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict, tier, confidence and categories of each text; its score rounded half up."""
    df = moderate.moderated(texts(spark, folder))
    return df.select("message_id", "verdict", "resolved_by", rounded("confidence").alias("confidence"), F.array_join(F.array_sort("categories"), ",").alias("categories"), score.rounded(F.round("score", 9)).alias("score"))


@query
def v4_pending(spark: SparkSession, folder: str) -> DataFrame:
    """What is replied to asynchronous requests, one of three."""
    df = policy.pending(moderate.moderated(texts(spark, folder)).withColumn("mode", F.when(F.col("message_id") % 3 == 0, "async").otherwise("sync")))
    return df.select("message_id", "pending", "verdict")


@query
def v5_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Some of the signals, read back from their JSON; what doesn't apply is missing there."""
    df = moderate.moderated(texts(spark, folder))
    df = df.select("message_id", score.signals(df).alias("s"))
    number = lambda k: F.get_json_object("s", f"$.{k}").cast("double")
    return df.select(
        "message_id", *[number(k).alias(k) for k in ("risk_score", "contact_score", "safety_score", "stage_modifier", "role_modifier")], *[number(k).cast("long").alias(k) for k in ("noise_digits_removed", "zero_width_count", "confusables_folded", "digit_runs", "detections")],
        F.get_json_object("s", "$.classifier_p").alias("classifier_p"),
    )


@query
def p1_p3_policy(spark: SparkSession, folder: str) -> DataFrame:
    """What is done with each text and what is delivered, with masking preferred."""
    df = policy.with_policy(moderate.moderated(texts(spark, folder)), prefer_masking=True)
    return df.select("message_id", "action", "delivered_text", F.size("masked_spans").cast("long").alias("n_masked"))


@query
def p2_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Actions without masking, by family of categories."""
    df = policy.with_policy(moderate.moderated(texts(spark, folder))).withColumn("family", policy.family(F.col("categories")))
    return df.groupBy("family", "action").agg(F.count("*").alias("n"))


#: A small model over named features, so that SQL can follow it.
WEIGHTS = {"hostility": 4.0, "handle": -5.0, "partialLength": 1.5, "digitRunCount": -0.7, "totalDigits": 0.05, "textLength": -0.3, "isHost": 0.5, "isPostBooking": -0.4, "intentChannel": 1.2, "intentContact": 0.6, "extortion": 1.1, "address": 0.0, "riskyUrl": 2.0, "zeroWidth": 0.2}
BIAS = 0.2


def model(spark: SparkSession) -> classifier.Classifier:
    rows = [(classifier.DENSE.index(k), w) for k, w in WEIGHTS.items() if k in classifier.DENSE]
    return classifier.Classifier(spark.createDataFrame(rows, "idx int, w double"), BIAS)


def answer(prompt: str) -> str:
    """A transport that finds what speaks of booking directly, and gives no verdict on reviews."""
    return "no idea" if "review" in prompt else adjudicate.stub("direct" in prompt)(prompt)


def undecided(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that are neither allowed nor blocked; written before, as a filter on a band would have all that makes it done twice."""
    df = score.with_score(moderate.analysed(texts(spark, folder)))
    return written(df.select("message_id", "sender_role", "booking_stage", "band", *moderate.ANALYSIS), "scored").where("band = 'escalate'")


@query
def c1_features(spark: SparkSession, folder: str) -> DataFrame:
    """Named features of the texts that are neither allowed nor blocked."""
    df = undecided(spark, folder)
    named = exploded(df, classifier.dense(df), "idx", "value", kept=["message_id"], with_place=True)
    return named.where("value <> 0").select("message_id", F.col("idx").cast("long").alias("idx"), rounded("value").alias("value"))


@query
def c4_c5_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """The classifier's probability of those texts: their features, trigrams included, by its weights."""
    rows = undecided(spark, folder)
    p = rows.withColumn("probability", classifier.probability(rows, model(spark), F.lit(True)))
    return p.select("message_id", rounded("probability").alias("probability"), score.decided(F.round("probability", 9)).alias("decision"))


@query
def v1_all_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts with the small classifier and the transport above: every message left to review is adjudicated."""
    df = moderate.moderated(texts(spark, folder), tiers=moderate.Tiers(classifier=model(spark), transport=answer))
    return df.select("message_id", "verdict", "resolved_by", rounded("probability").alias("probability"), F.col("tier5.source").alias("source"))


@query
def l5_l7_adjudicated(spark: SparkSession, folder: str) -> DataFrame:
    """Replies to the distinct texts, some of them cached before."""
    df = normalize.with_views(texts(spark, folder)).select("message_id", "folded")
    key = adjudicate.cache_key(F.col("folded"))
    kept = df.where("message_id % 2 = 0").select(key.alias("key")).distinct().select("key", F.lit(adjudicate.stub(True)("")).alias("reply"), F.current_timestamp().alias("used"))
    found, _ = adjudicate.adjudicated(df, answer, kept)
    return found.select("key", "source", "ok", F.coalesce("verdict.contact", F.lit(False)).alias("contact"))


@query
def s1_s12_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations of the texts, five minutes apart: pressure, intent, re-scans, merged numbers, verdicts and strikes."""
    df = stateful.moderated(texts(spark, folder))
    return df.select(
        "message_id", rounded("digit_pressure", 4).alias("digit_pressure"), rounded("session_intent", 4).alias("session_intent"), F.md5(F.coalesce("rescan_text", F.lit("")).cast("binary")).alias("rescan"),
        F.array_join(F.array_sort("cross_message_categories"), ",").alias("crossed"), "merged", rounded("score", 4).alias("score"), "band", F.col("strikes").cast("long").alias("strikes"),
    )


@query
def s13_cooldowns(spark: SparkSession, folder: str) -> DataFrame:
    """Earlier messages of the sender that the policy blocked within ten minutes."""
    df = policy.with_policy(moderate.moderated(texts(spark, folder)), prefer_masking=True).drop("recent_blocks", "cooldown")
    df = session.recent_blocks(df, F.col("action") == "block")
    return df.select("message_id", F.col("recent_blocks").cast("long").alias("recent_blocks"))


@query
def io4_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, shares, percentiles and cost over verdicts; latency and cost are made of the key."""
    df = moderate.moderated(texts(spark, folder)).withColumns({"latency_ms": (F.col("message_id") * 37 % 1000) / 100, "cost_usd": (F.col("message_id") % 5) / 1_000_000})
    s = evaluate.stats(df)
    return s.select("kind", "name", "n", *[rounded(c).alias(c) for c in ("share", "p50", "p95", "p99", "per_100k")])


@query
def io3_health(spark: SparkSession, folder: str) -> DataFrame:
    """Which tiers are live with the small classifier, and what happens where no adjudicator answers."""
    return evaluate.health(spark, RiskConfig(), moderate.Tiers(classifier=model(spark)))


@query
def e7_uncaught(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases of texts that no detector names, by the number of texts."""
    return evaluate.mined(moderate.analysed(texts(spark, folder)), top=None)


@query
def e8_self_play(spark: SparkSession, folder: str) -> DataFrame:
    """How many different texts there are, and how many of these the cascade acts on."""
    rate, _ = evaluate.self_play(moderate.moderated(texts(spark, folder)), F.col("verdict") != "allow")
    return rate


@query
def io5_io6_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The texts, written as JSON lines and read again."""
    path = scratch(spark, "lines")
    messages.write_jsonl(texts(spark, folder).select(F.col("message_id").cast("string").alias("message_id"), "sender_role", "text"), path)
    return messages.read_jsonl(spark, path, strict=True).select("message_id", "sender_role", "text")


@query
def io7_io8_config(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers and modes of a configuration: defaults, settings given as JSON, and an environment file over both."""
    env = parse_env("# mode\nFAIL_MODE_PRE_BOOKING='open'\nnot a line\n")
    c = load('{"$comment": "x", "bands": {"low": 2.5, "$note": 1}, "modifiers": {}, "policy": {"blockCooldownThreshold": 4}, "unknown": {"a": 1}}', env)
    rows = [(section, k, str(float(v)) if isinstance(v, (int, float)) else v) for section in ("bands", "policy", "failMode") for k, v in getattr(c, section).items()]
    return spark.createDataFrame(rows, "section string, name string, value string")


@query
def io10_presets(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on the demonstration's messages."""
    rows = [(k, text, role, stage) for k, (text, _, role, stage, _) in enumerate(corpus.PRESETS)]
    df = spark.createDataFrame(rows, "message_id long, text string, sender_role string, booking_stage string")
    return moderate.moderated(df).select("message_id", rounded("score").alias("score"), "verdict")


@query
def io12_smoke(spark: SparkSession, folder: str) -> DataFrame:
    """The check of a transport, on the demonstration's messages and the transport above."""
    return adjudicate.smoke(spark, answer, [(text, group != "innocent") for text, group, *_ in corpus.PRESETS])


@query
def e9_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a generated corpus by technique and label."""
    return corpus.generated(spark, 660).groupBy("technique", "label").agg(F.count("*").alias("n"))

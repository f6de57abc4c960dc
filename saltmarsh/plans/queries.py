"""Registered queries over the driver's tables, by operator. Each takes (spark, folder) and returns flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.config import RiskConfig
from saltmarsh.functions import detectors, digitruns, normalize, policy, score, wording
from saltmarsh import lexicons
from saltmarsh.functions.spans import DETECTION, alternation, exploded, kept_longest, terms_in
from saltmarsh.lexicons import HOSTILITY_SEV1, HOSTILITY_SEV2
from saltmarsh.operators import adjudicate, classifier, evaluate, moderate, session, stateful, weirdness
from saltmarsh.sources import corpus, messages
from saltmarsh.storage import scratch, written
from saltmarsh.streaming import moderation

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def synth(spark: SparkSession, folder: str) -> DataFrame:
    return messages.synthetic(messages.spread(table(spark, folder, "orders")))


def rounded(c, digits: int = 6):
    return F.round(c, digits)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Rows that repeat a key get a number behind it."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c) for c in rows.columns if c != key]))
    rows = rows.withColumn("__place", place)
    return rows.withColumn(key, F.when(F.col("__place") > 1, F.concat_ws("#", key, F.col("__place").cast("string"))).otherwise(F.col(key))).drop("__place")


# --- the cascade over synthesised messages


@query
def moderate_report(spark: SparkSession, folder: str) -> DataFrame:
    """Messages by stage, role, band, verdict and tier, with the sum of their scores."""
    done = moderate.moderated(synth(spark, folder))
    keys = ["booking_stage", "sender_role", "band", "verdict", "resolved_by"]
    return done.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.round("score", 6).cast("decimal(18,6)")).cast("double").alias("score"))


FLAGSHIP = moderate_report


@query
def moderate_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Each message's score and verdict."""
    done = moderate.moderated(synth(spark, folder))
    return done.select("message_id", rounded("score").alias("score"), "band", "verdict", F.size("detections").cast("long").alias("n_detections"), rounded("confidence").alias("confidence"))


@query
def policy_actions(spark: SparkSession, folder: str) -> DataFrame:
    """What is delivered, with masking preferred."""
    done = policy.with_policy(moderate.moderated(synth(spark, folder)), prefer_masking=True)
    return done.select("message_id", "action", "delivered_text", "cooldown")


@query
def stateful_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The cascade with conversations' state, and the policy's cooldown."""
    done = stateful.delivered(stateful.moderated(synth(spark, folder)))
    return done.select("message_id", rounded("score", 4).alias("score"), "verdict", "merged", rounded("digit_pressure", 4).alias("digit_pressure"), F.col("strikes").cast("long").alias("strikes"), F.col("recent_blocks").cast("long").alias("recent_blocks"))


@query
def moderate_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts over the conversations' turns."""
    done = moderate.moderated(messages.from_conversations(table(spark, folder, "conversations")))
    return done.groupBy("sender_role", "verdict", "resolved_by").agg(F.count("*").alias("n"))


@query
def stream_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The stateful cascade over the conversations' turns as a stream of files, run until all are read."""
    given = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{folder}/conversations.parque[t]")
    done = moderation.moderated(messages.from_conversations(given))
    out, marks = scratch(spark, "stream"), scratch(spark, "marks")
    flat = done.select("message_id", "sender_role", "verdict", rounded("score", 4).alias("score"), "merged")
    flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("message_id string, sender_role string, verdict string, score double, merged string").parquet(out)


@query
def c7_trained(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled synthetic conversations under a classifier trained on them: rows by label and decision."""
    rows = corpus.generated(spark, 150).withColumnRenamed("id", "message_id")
    rows = score.with_score(moderate.analysed(rows)).withColumn("y", (F.col("label") == "adversarial").cast("int"))
    rows = written(rows, "analysed")  # training goes over the rows again and again
    chosen = classifier.samples(rows, "y")
    model = classifier.train(chosen, "message_id", "y", iterations=20)
    p = classifier.probabilities(classifier.features(rows, "message_id"), model.weights, model.bias, "message_id")
    return rows.join(p, "message_id").groupBy("label", score.decided(F.col("probability")).alias("decision")).agg(F.count("*").alias("n"))


# --- sources


@query
def io11_wording(spark: SparkSession, folder: str) -> DataFrame:
    """What people read about the messages of every technique."""
    done = moderate.moderated(messages.techniques(messages.spread(table(spark, folder, "orders"))))
    kinds, verdict = F.array_sort("categories"), F.col("verdict")
    told = done.select(wording.label(verdict).alias("label"), wording.tone(verdict).alias("tone"), wording.summary(kinds, verdict).alias("summary"))
    return told.groupBy("label", "tone", "summary").agg(F.count("*").alias("n"))


@query
def e6_replayed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as conversations of twelve: how many there are of each length."""
    rows = evaluate.replayed(synth(spark, folder).drop("conversation_id", "ts"))
    lengths = rows.groupBy("conversation_id").agg(F.count("*").alias("length"))
    return lengths.groupBy("length").agg(F.count("*").alias("conversations"))


@query
def io2_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Requests made of conversations, some broken on purpose, by the reason that they are rejected for."""
    t = table(spark, folder, "conversations")
    rows = t.select(
        F.when(F.col("conv_id") % 7 == 0, " ").otherwise(F.col("conv_id").cast("string")).alias("message_id"), F.lit("c").alias("conversation_id"),
        F.col("role").alias("sender_role"), F.when(F.col("turn") % 5 == 4, "later").otherwise("pre_booking").alias("booking_stage"), "text", F.lit(None).cast("string").alias("mode"),
    )
    rows = rows.withColumn("sender_role", F.when(F.col("sender_role") == "user", "guest").otherwise(F.col("sender_role")))
    return rows.select(F.coalesce(messages.reject_reason(), F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query
def synth_messages(spark: SparkSession, folder: str) -> DataFrame:
    return synth(spark, folder).select("message_id", "conversation_id", "sender_role", "booking_stage", "text")


# --- normalization


@query
def n3_n6_folded(spark: SparkSession, folder: str) -> DataFrame:
    """Folding of the documents, as lengths and counters."""
    d = table(spark, folder, "documents")
    f = normalize.folded(F.col("text"))
    return d.select("doc_id", F.length(f).cast("long").alias("n"), F.md5(f.cast("binary")).alias("digest"), normalize.confusables(F.col("text")).cast("long").alias("confusables"))


@query
def n2_invisible(spark: SparkSession, folder: str) -> DataFrame:
    """Invisible characters, planted by id, counted and taken out."""
    mark = F.when(F.col("doc_id") % 3 == 0, "​").when(F.col("doc_id") % 3 == 1, "⁦").otherwise("")
    t = F.concat(F.substring("text", F.lit(1), F.lit(20)), mark, F.substring("text", F.lit(21), F.length("text")))
    d = table(spark, folder, "documents").select("doc_id", t.alias("t"))
    v = normalize.visible(F.col("t"))
    return d.select("doc_id", v.alias("visible"), (F.length("t") - F.length(v)).cast("long").alias("n"))


@query
def n7_n8_deleet(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    f = F.lower("text")
    return c.select("conv_id", "turn", normalize.deleet(f).alias("deleet"), normalize.leet_count(f).cast("long").alias("leet"))


@query
def n9_n10_denoised(spark: SparkSession, folder: str) -> DataFrame:
    """Noise digits, planted by id into customers' names."""
    o = table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("ab"), F.col("o_custkey").cast("string"), F.lit("cd "), F.col("o_orderkey").cast("string"), F.lit("x7y8z")).alias("t"))
    d = normalize.denoised(F.col("t"))
    return o.select("o_orderkey", d.alias("denoised"), (F.length("t") - F.length(d)).cast("long").alias("noise"))


@query
def n12_n18_digit_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a number that is spelled by a rule: a numeral, a word and a repeated numeral."""
    words = F.element_at(F.array(*[F.lit(w) for w in ("zero", "three", "five", "six", "seven", "nine")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    t = F.concat(F.lit("ref "), (F.col("o_orderkey") % 100).cast("string"), F.lit(" "), words, F.lit(" double "), (F.col("o_custkey") % 10).cast("string"), F.lit(" ok"))
    rows = table(spark, folder, "orders").select("o_orderkey", digitruns.runs(t).alias("r"), t.alias("t"))
    first = F.col("r")[0]
    return rows.select(
        "o_orderkey", F.size("r").cast("long").alias("n"), first["digits"].alias("digits"), first["start"].cast("long").alias("start"), first["end"].cast("long").alias("end"),
        first["word_n"].cast("long").alias("word_n"), first["num_n"].cast("long").alias("num_n"), first["mixed"].alias("mixed"), digitruns.digitized(F.col("t"), F.col("r")).alias("digitized"),
    )


# --- trigram model


@query
def w7_w8_trigrams(spark: SparkSession, folder: str) -> DataFrame:
    """Trigram counts of the documents and their smoothed log-probabilities."""
    counts = weirdness.counts(table(spark, folder, "documents"))
    log_probs, _ = weirdness.smoothed(counts)
    return counts.join(log_probs, "trigram").select("trigram", "n", rounded("logp").alias("logp"))


@query
def w1_w5_weird_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the conversations' tokens under the documents' model, and the number over the threshold."""
    model = weirdness.train(table(spark, folder, "documents"))
    c = table(spark, folder, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("folded"))
    c = numbered(c, "id")
    done = weirdness.with_weirdness(c, model, "id")
    return done.select("id", rounded("weird_score").alias("weird_score"), F.col("weird_tokens").cast("long").alias("weird_tokens"))


# --- detectors


@query
def d8_emails(spark: SparkSession, folder: str) -> DataFrame:
    """Plain addresses in the documents."""
    plain = F.filter(detectors.emails(F.lower("text")), lambda d: d["confidence"] == 0.97)
    d = exploded(table(spark, folder, "documents"), plain, "d", kept=["doc_id"])
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda x: x["evidence"]), ",").alias("found"))


@query
def d10_url_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts of the pages by class."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    c = detectors.classified(host)
    p = table(spark, folder, "pages").select(c["kind"].alias("kind"), c["sure"].alias("sure"))
    return p.groupBy("kind").agg(F.count("*").alias("n"), rounded(F.max("sure")).alias("confidence"))


@query
def d22_d25_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """How often single words of the lexicons stand in the documents."""
    single = [t for t in dict.fromkeys([*lexicons.INTENT_CHANNEL, *lexicons.HOSTILITY_MILD, *lexicons.HOSTILITY_SEV1, *lexicons.HOSTILITY_SEV2]) if t.isalpha()]
    d = exploded(table(spark, folder, "documents"), terms_in(F.lower("text"), single), "h")
    return d.groupBy(F.col("h.match").alias("term")).agg(F.count("*").alias("n"))


@query
def d29_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Where terms of all lexicons, phrases too, stand in the conversations."""
    c = table(spark, folder, "conversations").where("text IS NOT NULL")
    terms = [*lexicons.INTENT_CHANNEL, *lexicons.INTENT_ACTION, *lexicons.INTENT_OFFPLATFORM, *lexicons.INTENT_PAYMENT, *detectors.HOSTILE, *detectors.THREAT, *detectors.SCAM, "the", "for the", "you", "a", "of the"]
    h = exploded(c, terms_in(F.lower("text"), terms), "h", kept=["conv_id", "turn"])
    return h.select("conv_id", "turn", F.col("h.match").alias("term"), F.col("h.start").cast("long").alias("start"))


@query
def d30_keep_longest(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user as intervals, without those inside another."""
    e = table(spark, folder, "events").select("user_id", "event_id", (F.col("event_id") % 97).alias("a"), (F.col("event_id") % 97 + F.col("event_id") % 11 + 1).alias("b"))
    span = F.struct("event_id", F.col("a").alias("start"), F.col("b").alias("end"))
    held = e.groupBy("user_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    k = exploded(held, kept_longest(F.col("spans")), "k", kept=["user_id"])
    return k.select("user_id", "k.event_id", F.col("k.start").alias("a"), F.col("k.end").alias("b"))


# --- scores


@query
def r11_saturation(spark: SparkSession, folder: str) -> DataFrame:
    """What digit pressure alone adds to scores, quantities standing for it."""
    none = {"text": F.lit(""), "detections": F.array().cast(DETECTION), "runs": F.array().cast(digitruns.RUN), "booking_stage": F.lit("pre_booking"), "sender_role": F.lit("guest")}
    rows = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("digit_pressure"), *[v.alias(k) for k, v in none.items()], *[F.lit(0).alias(k) for k in ("zero_width", "confusables", "noise")])
    done = score.with_score(rows)
    return done.groupBy("band", F.floor("score").alias("whole")).agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("value"))


# --- sessions


@query
def s1_s2_pressure(spark: SparkSession, folder: str) -> DataFrame:
    """Decayed sums of earlier events of a user, an event counting its value."""
    e = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    done = session.decayed_sum(e, "user_id", F.abs("value"), 3_600_000, "pressure", order="event_id")
    return done.select("event_id", F.round("pressure", 6).alias("pressure"))


@query
def s4_s5_last_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The same sender's texts among the last five, at most three, and the current one."""
    c = messages.from_conversations(table(spark, folder, "conversations")).withColumns({"runs": F.array().cast(digitruns.RUN), "detections": F.array().cast(detectors.DETECTION)})
    c = numbered(c, "message_id")
    return session.with_session(c).select("message_id", F.col("rescan_text"))


@query
def s13_rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Earlier purchases of a user within ten minutes, as blocks."""
    e = table(spark, folder, "events").select("event_id", F.col("user_id").alias("conversation_id"), F.lit("guest").alias("sender_role"), "ts", F.col("event_id").alias("message_id"), "event_type")
    hit = F.col("event_type") == "purchase"
    done = session.recent_blocks(session.strikes(e, hit), hit)
    return done.select("event_id", F.col("strikes").cast("long").alias("strikes"), F.col("recent_blocks").cast("long").alias("recent_blocks"), (F.col("recent_blocks") >= 3).alias("cooldown"))


# --- classifier


@query
def c2_fnv1a(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of the customers' market segments and the nations' names."""
    n = table(spark, folder, "nation").select(F.col("n_name").alias("word")).union(table(spark, folder, "customer").select("c_mktsegment")).distinct()
    return n.select("word", classifier.fnv1a(F.col("word")).alias("hash"), (classifier.fnv1a(F.col("word")) % classifier.HASHED).alias("cell"))


@query
def c3_hashed_trigrams(spark: SparkSession, folder: str) -> DataFrame:
    """The hashed trigrams of the benchmark's texts, of unit length."""
    b = table(spark, folder, "benchmark").select("item_id", "text")
    cells = classifier.hashed_trigrams(b, "item_id")
    return cells.groupBy("item_id").agg(F.count("*").alias("cells"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("norm"), F.round(F.sum("value"), 6).alias("total"))


@query
def c5_c6_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Sigmoid and decision over the events' values as logits."""
    p = score.sigmoid(F.col("value") / 100 - 1)
    e = table(spark, folder, "events").select("event_id", p.alias("p"))
    return e.select("event_id", rounded("p").alias("p"), score.decided(F.round("p", 9)).alias("decision"))


# --- adjudication


@query
def l1_cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct keys of the conversations' texts, and the rows that share each."""
    c = table(spark, folder, "conversations").select(adjudicate.cache_key(F.lower("text")).alias("cache_key"))
    return c.groupBy("cache_key").agg(F.count("*").alias("n"))


@query
def l2_evicted(spark: SparkSession, folder: str) -> DataFrame:
    """The cache's hundred entries that were used last; the size is the feature."""
    e = table(spark, folder, "events").select(F.col("event_id").cast("string").alias("key"), F.col("ts").alias("used"))
    return adjudicate.evicted(e, F.lit("2100-01-01").cast("timestamp"), ttl_seconds=1 << 40, most=100).select("key")


@query
def l4_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Replies as a model might word them, by event."""
    reply = F.concat(
        F.lit('sure: {"contact": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise('"true"'), F.lit(', "contact_type": "'), F.when(F.col("event_id") % 3 == 0, "phone").otherwise("pigeon"),
        F.lit('", "safety": false, "confidence": '), F.when(F.col("event_id") % 5 == 0, "7").otherwise("0.25"), F.lit("} ok"),
    )
    v = table(spark, folder, "events").select("event_id", adjudicate.parsed(reply).alias("v"))
    return v.select("event_id", "v.contact", "v.contact_type", "v.safety", "v.confidence")


@query
def l6_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Cost of adjudicating each month's orders, by their keys as tokens."""
    o = table(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    g = o.agg(F.sum(F.col("o_orderkey") % 400).alias("tokens_in"), F.sum(F.col("o_orderkey") % 70).alias("tokens_out"))
    return g.select("month", "tokens_in", "tokens_out", F.round(adjudicate.cost(F.col("tokens_in"), F.col("tokens_out")), 8).alias("dollars"))


# --- reports


@query
def e1_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """How well a rule of single insults finds toxic documents."""
    d, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    hit = F.lower("text").rlike(alternation([t for t in [*HOSTILITY_SEV1, *HOSTILITY_SEV2] if t.isalpha()]))
    rows = d.select("doc_id", hit.alias("hit")).join(labels, "doc_id")
    c = evaluate.confusion(rows, F.col("toxic") == 1, F.col("hit"))
    return c.select("tp", "fp", "fn", "tn", *[rounded(x).alias(x) for x in ("precision", "recall", "f1", "friction")])


@query
def e2_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """The same rule's rate by language and label."""
    d, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    hit = F.lower("text").rlike(alternation([t for t in [*HOSTILITY_SEV1, *HOSTILITY_SEV2] if t.isalpha()]))
    rows = d.select("doc_id", "lang", hit.alias("hit")).join(labels, "doc_id")
    g = evaluate.by_group(rows, "lang", F.col("toxic") == 1, F.col("hit"))
    return g.select("grp", "expected", "n", "actioned", rounded("rate").alias("rate"))


@query
def e3_shares(spark: SparkSession, folder: str) -> DataFrame:
    g = evaluate.shares(table(spark, folder, "documents"), "source")
    return g.select("value", "n", rounded("share").alias("share"))


@query
def e4_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Cost of a hundred thousand messages for each share of events."""
    g = evaluate.shares(table(spark, folder, "events"), "event_type")
    return g.select("value", F.round(evaluate.cost_per_100k(F.col("share")), 6).alias("dollars"))


@query
def e5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    p = evaluate.percentiles(table(spark, folder, "lineitem"), "l_extendedprice")
    return p.select(*[rounded(c, 4).alias(c) for c in ("p50", "p95", "p99", "max")])


@query
def e7_mined(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases that two conversations' turns or more share."""
    c = table(spark, folder, "conversations").select(F.lower(F.coalesce("text", F.lit(""))).alias("folded"))
    return evaluate.mined(c, top=None)


@query
def p3_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Comments masked at places given by their keys."""
    o = table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" is here and on its way")).alias("t"))
    span = lambda a, b: F.struct(F.lit("contact.phone").alias("type"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    k = F.col("o_orderkey") % 5
    spans = policy.maskable(F.col("t"), F.array(span(k, k + 2), span(k + 4, k + 4 + F.col("o_orderkey") % 3 + 1)))
    return o.select("o_orderkey", policy.masked(F.col("t"), spans).alias("masked"))

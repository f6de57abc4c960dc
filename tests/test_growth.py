"""What grows with the input is dealt out in parts of bounded size, done once, and gives the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import detectors, spans
from saltmarsh.operators import classifier, evaluate, moderate, session
from saltmarsh.sources import messages
from saltmarsh.storage import written


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_messages_are_spread_by_their_number(spark, monkeypatch, tmp_path):
    """One row group in a file that is read in many parts lies in one of them."""
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(messages, "ROWS_A_TASK", 50)
    df = messages.spread(spark.read.parquet(str(tmp_path / "t")))
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 60 and sum(sizes) == 1000


@pytest.mark.parametrize("n", [10, 24, 115])
def test_a_replay_has_one_short_conversation_at_most(spark, monkeypatch, n):
    monkeypatch.setattr(evaluate, "ROWS_A_BUCKET", 10)
    rows = evaluate.replayed(spark.range(n).withColumnRenamed("id", "message_id")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.conversation_id, set()).add(r.ts)
    assert sorted(map(len, by.values()), reverse=True) == [12] * (n // 12) + [n % 12] * (n % 12 > 0)


def test_what_makes_the_rows_of_stats_is_done_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(k):
        made.add(1)
        return "allow" if k % 3 else "block"

    rows = spark.range(60).select(told("id").alias("verdict"), F.lit("tier3.risk").alias("resolved_by"), F.col("id").cast("double").alias("latency_ms"), F.lit(0.0).alias("cost_usd"))
    got = {(r["kind"], r["name"]): r for r in evaluate.stats(rows).collect()}
    assert made.value == 60 and got["verdict", "block"].n == 20 and got["all", None].p50 == 29.5


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [None, 5.0, 1.0, 1.0], None])
def test_percentiles_are_exact_without_all_values_in_one_place(spark, values):
    values = [float(v) for v in np.random.default_rng(3).integers(0, 400, 1500)] if values is None else values
    df = evaluate.percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v")
    held = [v for v in values if v is not None]
    wanted = [*np.percentile(held, [50, 95, 99]), max(held)] if held else [None] * 4
    assert "percentile(" not in plan(df) and list(df.first()) == (pytest.approx(wanted, rel=1e-12) if held else wanted)


def test_features_are_weighed_where_their_row_is(spark):
    texts = ["call me on 98765 please", "you stupid clown", "", "ünïcode \U0001f600 text"]
    df = spark.createDataFrame([(k, t, "pre_booking", "host") for k, t in enumerate(texts)], "message_id long, text string, booking_stage string, sender_role string")
    df = written(moderate.slim(moderate.analysed(df), df), "analysed")
    size = len(classifier.DENSE) + classifier.HASHED
    model = classifier.Classifier(spark.createDataFrame([(k, ((k * 37) % 11 - 5) / 7) for k in range(0, size, 3)], "idx int, w double"), 0.1)
    done = df.withColumn("p", classifier.probability(df, model, F.col("message_id") != 1))
    assert "Exchange" not in plan(done) and "Join" not in plan(done)
    got = {r.message_id: r.p for r in done.collect()}
    wanted = {r.message_id: r.probability for r in classifier.probabilities(classifier.features(df, "message_id"), model.weights, model.bias, "message_id").collect()}
    assert got.pop(1) is None and got == {k: pytest.approx(wanted[k], rel=1e-9) for k in got}


def test_trigrams_are_counted_by_code_points(spark):
    text = "aab\U0001f600aab"
    got = {r.idx: r.value for r in classifier.hashed_trigrams(spark.createDataFrame([(1, text)], "k int, text string"), "k").collect()}

    def fnv(gram):
        h = 0x811C9DC5
        for c in gram:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h % classifier.HASHED + len(classifier.DENSE)

    cells = {}
    for k in range(len(text)):
        at = fnv(f" {text} "[k : k + 3])
        cells[at] = cells.get(at, 0) + 1
    norm = sum(n * n for n in cells.values()) ** 0.5
    assert got == {k: pytest.approx(n / norm) for k, n in cells.items()}


def test_fragments_are_folded_stretch_by_stretch_in_one_pass(spark):
    """A number half in one conversation or stretch and half in the next isn't one; a missing conversation id is one as well."""
    rows = [(c, f"{c}-{k}", "guest", 1_700_000_000 + t, [d]) for c in (1, 2, None) for k, (t, d) in enumerate([(0, "98765"), (60, "43210"), (9000, "98765"), (18000, "43210")])]
    df = spark.createDataFrame(rows, "conversation_id long, message_id string, sender_role string, t long, fragments array<string>").withColumn("ts", F.timestamp_seconds("t"))
    done = session.merged_numbers(df)
    assert "MapInArrow" in plan(done) and "FlatMapGroups" not in plan(done)
    assert {tuple(r) for r in done.collect()} == {(f"{c}-1", "9876543210") for c in (1, 2, None)}


def test_messages_that_nothing_is_asked_about_do_not_meet_under_one_key(spark):
    df = spark.createDataFrame([(k, "hello there", "pre_booking", "guest") for k in range(40)], "message_id long, text string, booking_stage string, sender_role string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = moderate.moderated(df, tiers=moderate.Tiers(transport=lambda p: "no"), ascii_only=True)
        assert len({r[0] for r in done.select(F.spark_partition_id()).collect()}) > 1 and done.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_places_of_hits_in_texts_with_the_marks_themselves(spark):
    text = f"a{spans.MARK}b call {spans.AFTER}me call"
    df = spark.createDataFrame([(text,), ("call call",), (None,)], "t string")
    got = df.select(spans.located(F.col("t"), "call").alias("a"), spans.terms_in(F.col("t"), ["call", "b call"]).alias("b")).collect()
    for r, t in zip(got, [text, "call call"]):
        assert all(t[h.start : h.end] == h.match for h in [*r.a, *r.b]) and len(r.a) == 2
    assert [h.match for h in got[0].b] == ["b call", "call"]


def test_terms_that_begin_alike_share_their_beginning(spark):
    """No place of a text is held against each of the terms."""
    pattern = spans.alternation(detectors.INTENT_TERMS)
    assert pattern.count("whatsapp") < sum("whatsapp" in t for t in detectors.INTENT_TERMS) and pattern.startswith("(?:(?=[")

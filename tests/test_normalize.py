import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saltmarsh.functions import digitruns, normalize


def views(spark, *texts):
    df = normalize.with_views(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"))
    df = df.withColumn("runs", digitruns.runs(F.col("denoised"))).withColumn("digitized", digitruns.digitized(F.col("denoised"), F.col("runs")))
    return sorted(df.collect(), key=lambda r: r.k)


CASES = [
    ("hi i a92m a121ksh35ay call me on nine eight 7 six zero", ["98760"], True),
    ("reach out at insta: akshay_98_76_five_four", ["987654"], True),
    ("double five triple 9", ["55999"], True),
    ("nine eight one six zero", ["98160"], False),
    ("98,765 for 5 nights", ["98765", "5"], False),
    ("booking for 7 people", ["7"], False),
    ("house no 1, near the temple", ["1"], False),
    ("सात दो तीन छह एक पांच पांच चार नौ पांच", ["7236155495"], False),
    ("+919876543210", ["919876543210"], False),
    ("(9876543210)!", ["9876543210"], False),
    ("five4", ["54"], True),
    ("to do for", [], False),
    ("constructor 5", ["5"], False),
]


def test_runs(spark):
    for (text, digits, mixed), r in zip(CASES, views(spark, *[c[0] for c in CASES])):
        assert [x.digits for x in r.runs] == digits, text
        assert any(x.mixed for x in r.runs) == mixed, text


def test_first_case_in_full(spark):
    r = views(spark, CASES[0][0])[0]
    assert r.denoised == "hi i am akshay call me on nine eight 7 six zero" and r.noise == 7
    run = r.runs[0]
    assert r.denoised[run.start : run.end] == "nine eight 7 six zero" and (run.word_n, run.num_n, run.seps) == (4, 1, ["space"])
    assert r.digitized == "hi i am akshay call me on 98760"


def test_compat_keeps_the_original_tokens(spark):
    df = spark.createDataFrame([("+919876543210",), ("five4",)], "t string")
    assert [[x.digits for x in r.r] for r in df.select(digitruns.runs(F.col("t"), 1, True).alias("r")).collect()] == [[], ["5"]]


def test_views(spark):
    a, b, c, d = views(spark, "p4ssw0rd ₹500", "а𝟗​b", None, "Straße ＠x")
    assert (a.deleet, a.leet) == ("password ₹500", 2)
    assert (b.folded, b.zero_width, b.confusables) == ("a9b", 1, 1) and b.denoised == "ab"
    assert (c.folded, c.noise, c.runs) == ("", 0, [])
    assert d.folded == "strasse @x"


def test_offsets(spark):
    df = spark.createDataFrame([("a12b c3d",)], "t string")
    r = df.select(normalize.denoised(F.col("t")).alias("d"), normalize.denoised_offsets(F.col("t")).alias("o")).first()
    assert [r.d[k] for k in range(len(r.d))] == ["a12b c3d"[o] for o in r.o]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab1 23é-", max_size=25), min_size=1, max_size=20))
def test_denoising_twice_changes_nothing(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = normalize.denoised(F.col("t"))
    assert df.select(once.alias("a"), normalize.denoised(once).alias("b")).where("a <> b").count() == 0


@pytest.mark.parametrize("word", ["zero", "saat"])
def test_number_words(spark, word):
    assert views(spark, f"{word} five six")[0].runs[0].digits[0] in "07"

import random

from pyspark.sql import functions as F

from saltmarsh.llm import quality
from tests.llm.rows import ROWS, SCHEMA, documents


def corpus(n=300, seed=5):
    r, rows, labels = random.Random(seed), [], []
    for i in range(n):
        good = int(i % 5 != 0)
        words = ["".join(r.choice("etaoinsh") for _ in range(r.randint(2, 7))) for _ in range(60)]
        rows.append((i, " ".join(words if good else [w + r.choice(["$$$", "###"]) for w in words]), "en", "s", 1))
        labels.append((i, good, 0))
    return rows, labels


def test_held_out_rows_and_reruns(spark):
    rows, labels = corpus()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks, "quality", F.col("doc_id") % 4 != 2)
    found = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(found[i], q) for i, q, _ in labels if i % 4 == 2]
    assert sum((s >= 0.7) == bool(q) for s, q in held) / len(held) > 0.95
    assert abs(quality.fit(docs, marks, "quality", F.col("doc_id") % 4 != 2).bias - model.bias) < 1e-6


def test_odd_rows_and_names(spark):
    rows, labels = corpus(40)
    marks = spark.createDataFrame([*labels, (1, None, 0), (77, 1, 0), (2, 5, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(documents(spark, rows), marks, "quality", F.lit(True), sample=20)
    done = quality.score(documents(spark).withColumns({"score": F.lit("x"), "idx": F.lit(1)}), model)
    got = done.collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got) and "idx" in done.columns
    assert len({r.score for r in got if not (r.text or "").split()}) == 1
    assert quality.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_without_labels(spark):
    model = quality.fit(documents(spark), spark.createDataFrame([], "doc_id long, quality int"), "quality", F.lit(True))
    assert model.bias == 0

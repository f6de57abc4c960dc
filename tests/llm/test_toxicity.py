import math
import random
import re

from pyspark.sql import functions as F

from saltmarsh.llm import toxicity
from tests.llm.rows import ROWS, SCHEMA, documents


def corpus(n=1000, seed=3):
    r = random.Random(seed)
    plain = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 4 == 0)
        words = [r.choice(plain) for _ in range(r.randint(40, 120))]
        if toxic:
            for _ in range(6):
                words[r.randrange(len(words))] = "zqx" + r.choice(plain)[:3]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") % 5 != 0)
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(found[i], t) for i, _, t in labels if i % 5 == 0]
    assert sum((s >= 0.5) == bool(t) for s, t in held) / len(held) > 0.95
    again = toxicity.fit(docs, marks, F.col("doc_id") % 5 != 0)
    assert abs(again.shift - model.shift) < 1e-9 and again.entries() == model.entries() and model.slope > 0


def test_odd_rows_and_names(spark):
    rows, labels = corpus(60)
    marks = spark.createDataFrame([*labels, (3, 1, 1), (None, None, None), (999, 1, 1), (5, 1, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(spark, rows), marks, F.lit(True))
    done = toxicity.score(documents(spark).withColumns({"score": F.lit("x"), "label": F.lit(1)}), model)
    got = done.collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got) and "label" in done.columns
    assert len({r.score for r in got if not (r.text or "").split()}) == 1
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(spark), none, F.lit(True))
    assert {r.score for r in toxicity.score(documents(spark), model).collect()} == {0.5}
    calm = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.01 for r in toxicity.score(documents(spark), toxicity.fit(documents(spark), calm, F.lit(True))).collect())


def split(text):
    return re.findall(r"[a-z0-9\u0080-\u2fff\ua000-\uffff\U00010000-\U0010ffff]+|[\u3000-\u9fff]", (text or "").lower())


def test_words_are_those_of_a_pattern():
    texts = [None, "", " .,! ", "One two, ONE-two", "naïve été 😀x", "我喜欢 spark很好ok 12", "x" * 500, "ab ba"]
    h, n = toxicity.words(texts * 3)
    want = [split(t) for t in texts] * 3
    assert n.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(h.tolist(), flat)))


def test_chances_are_kneser_ney_s_and_sum_to_one(spark):
    """By the formula, in plain Python, over documents that have words; and what the model says of each word."""
    rows, _ = corpus(60)
    found = [(int(i % 4 == 0), f"{text} only{i} Only{i} twice{i // 2}") for i, text, *_ in rows]
    n = ({}, {})
    for label, text in found:
        for w in set(split(text)):
            n[label][w] = n[label].get(w, 0) + 1
    both = {w: n[0].get(w, 0) + n[1].get(w, 0) for w in {**n[0], **n[1]}}

    def parts(counts):
        once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
        d, all_ = once / (once + 2 * twice), sum(counts.values())
        return d, all_, d * len(counts) / all_

    d, all_, free = parts(both)
    shared = {w: (v - d) / all_ + free / (len(both) + 1) for w, v in both.items()}
    unknown = free / (len(both) + 1)
    assert abs(sum(shared.values()) + unknown - 1) < 1e-9
    p, least = [], []
    for c in n:
        d, all_, free = parts(c)
        p.append({w: max(c.get(w, 0) - d, 0) / all_ + free * shared[w] for w in both})
        least.append(free * unknown)
        assert 0 < d < 1 and abs(sum(p[-1].values()) + least[-1] - 1) < 1e-9
    model = toxicity.count(spark.createDataFrame(found, "label int, content string"))
    counted = toxicity._counted(spark.createDataFrame(found, "label int, content string"))
    shares, p0, p1, rest = toxicity.chances(toxicity.totals_of(counted))
    sums = counted.agg(F.sum(shares).alias("s"), F.sum(p0).alias("a"), F.sum(p1).alias("b")).first()
    assert abs(sums.s + unknown - 1) < 1e-9 and abs(sums.a + least[0] - 1) < 1e-9 and abs(sums.b + least[1] - 1) < 1e-9
    entries = model.entries()
    assert len(entries) == len(both)
    for w in both:
        want = math.log(1 + toxicity.EXPRESSIVE * (p[1][w] / p[0][w] - 1))
        assert abs(entries[int(toxicity.words([w])[0][0])] - want) < 1e-5
    assert abs(model.unknown - math.log(1 + toxicity.EXPRESSIVE * (least[1] / least[0] - 1))) < 1e-9


def test_scores_are_a_curve_of_mean_differences(spark, monkeypatch):
    """Whatever the sizes of chunks and parts, a score hangs on the mean of the words' entries alone."""
    rows, labels = corpus(120)
    docs, marks = documents(spark, [*rows, (500, "never seen words", "en", "s", 1), *ROWS]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks, F.lit(True))
    entries = model.entries()

    def want(text):
        d = [entries.get(k, model.unknown) for k in toxicity.words([text])[0].tolist()]
        return 1 / (1 + math.exp(-(model.slope * (sum(d) / len(d) if d else 0.0) + model.shift)))

    monkeypatch.setattr(toxicity, "PART", 50)
    small = toxicity.fit(docs, marks, F.lit(True))
    assert small.parts > 5 and small.entries() == entries
    for m, chunk in ((model, toxicity.CHUNK), (small, toxicity.CHUNK), (small, 3000)):
        got = toxicity.score(docs, m, chunk=chunk).collect()
        assert len(got) == len(rows) + 1 + len(ROWS)
        assert all(abs(r.score - want(r.text)) < 1e-4 for r in got)


def test_whole_words_and_texts_are_read(spark):
    """Long words differ behind their beginning; letters apart are expressions across the ends of words."""
    rows, labels = corpus(320)
    calm = [" ".join(w for w in text.split() if not w.startswith("zqx")) for _, text, *_ in rows]
    for ugly, kind in (("thisisanicemoron", "thisisanicething"), ("i d i o t", "i d e a s")):
        docs = documents(spark, [(i, f"{c} {ugly if t else kind} {ugly if t else kind}", "en", "s", 1) for c, (i, _, t) in zip(calm, labels)])
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
        asked = documents(spark, [(1, f"{calm[0]} {ugly} {ugly}", "en", "s", 1), (2, f"{calm[0]} {kind} {kind}", "en", "s", 1)])
        found = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
        assert found[1] > 0.5 > found[2]


def test_all_rows_but_the_curve_s_are_counted(spark, monkeypatch):
    rows, labels = corpus(200)
    seen = []
    monkeypatch.setattr(toxicity, "count", lambda counted: seen.append(counted.count()) or toxicity.Model(None))
    toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True), sample=5)
    assert seen == [195]


def test_pairs_have_kneser_ney_s_chances_that_sum_to_one(spark):
    """By the formula, in plain Python: a word behind the word before it, discounted, backing off to the number of different words before it."""
    rows, _ = corpus(60)
    found = [(int(i % 4 == 0), f"{text} only{i} ab cd ab cd", i) for i, text, *_ in rows]
    n, follows = ({}, {}), ({}, {})
    for label, text, _ in found:
        ws = split(text)
        for v, w in zip([None, *ws], ws):
            n[label][v, w] = n[label].get((v, w), 0) + 1
    before = [{} for _ in n]
    for c in (0, 1):
        for v, w in n[c]:
            before[c][w] = before[c].get(w, 0) + 1
    every = {w: before[0].get(w, 0) + before[1].get(w, 0) for w in {**before[0], **before[1]}}

    def parts(counts):
        once, twice = (sum(x == k for x in counts.values()) for k in (1, 2))
        d, all_ = once / (once + 2 * twice), sum(counts.values())
        return d, all_, d * len(counts) / all_

    d, all_, free = parts(every)
    shared = {w: (x - d) / all_ + free / (len(every) + 1) for w, x in every.items()} | {"": free / (len(every) + 1)}
    own, lower = [parts(x)[0] for x in n], []
    for c in (0, 1):
        d, all_, free = parts(before[c])
        lower.append({w: max(before[c].get(w, 0) - d, 0) / all_ + free * s for w, s in shared.items()})

    both = {k: n[0].get(k, 0) + n[1].get(k, 0) for k in {**n[0], **n[1]}}
    together = parts(both)[0]

    def level(counts, d, v, w, backoff):
        total = sum(x for (a, _), x in counts.items() if a == v)
        return max(counts.get((v, w), 0) - d, 0) / total + d * sum(a == v for a, _ in counts) / total * backoff if total else backoff

    def chance(c, v, w):
        return level(n[c], own[c], v, w, level(both, together, v, w, lower[c][w]))

    for c in (0, 1):
        for v in (None, "ab", "only0", "only1"):
            assert abs(sum(chance(c, v, w) for w in shared) - 1) < 1e-9
    model = toxicity.count_pairs(spark.createDataFrame([x[:2] for x in found], "label int, content string"), parts=5, chunk=2000)
    model.slope = 1.0
    texts = [*[x[1] for x in found[:6]], "ab only1 cd", "never ab seen", "cd ab", "", "only3"]
    done = toxicity.score(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), model, chunk=3000).collect()
    for r in done:
        ws = [w if w in shared else "" for w in split(r.text)]
        each = [math.log(1 + toxicity.EXPRESSIVE * (chance(1, v, w) / chance(0, v, w) - 1)) for v, w in zip([None, *ws], ws)]
        assert abs(math.log(r.score / (1 - r.score)) - (sum(each) / len(each) if each else 0)) < 1e-4
    assert len(done) == len(texts)


def test_order_tells_texts_of_equal_words_apart(spark):
    """Toxic texts have the words of ordinary ones, in another order."""
    rows, labels = corpus()
    calm = [" ".join([w for w in text.split() if not w.startswith("zqx")][:20]) for _, text, *_ in rows]
    docs = documents(spark, [(i, f"{c} " + ("you are the rat" if t else "the rat you are"), "en", "s", 1) for c, (i, _, t) in zip(calm, labels)])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for order, least in ((1, 0.0), (2, 0.9)):
        found = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, marks, F.col("doc_id") % 5 != 0, order=order)).collect()}
        right = [(found[i] >= 0.5) == bool(t) for i, _, t in labels if i % 5 == 0]
        assert least <= sum(right) / len(right) < (0.8 if order == 1 else 1.01)


def test_pairs_leave_no_shuffle_files_and_rounds_lose_no_row(spark):
    """Questions, answers and texts of all rows together are several times the table; they go with the step that needs them."""
    import os
    import time

    def on_disk():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        paths = [files.apply(k).getPath() for k in range(files.size())]
        return {p: os.path.getsize(p) for p in paths if "shuffle_" in p and os.path.exists(p)}

    rows, labels = corpus(400)
    docs, marks = documents(spark, [*rows, *ROWS]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    former = on_disk()
    model = toxicity.fit(docs, marks, F.col("doc_id") % 5 != 0, order=2)
    got = toxicity.score(docs, model).select("doc_id", "score").collect()
    until = time.time() + 20
    while (left := sum(n for p, n in on_disk().items() if p not in former)) > 100_000 and time.time() < until:
        time.sleep(0.5)
    assert left < 100_000 < sum(len(r[1]) for r in rows) / 2
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    got.sort(key=key)
    assert len(got) == len(rows) + len(ROWS)
    for rounds in (1, 3):
        done = toxicity.score(docs, model, columns=["doc_id"], rounds=rounds)
        again = sorted(done.collect(), key=key)
        assert done.columns == ["doc_id", "score"] and [r.doc_id for r in again] == [r.doc_id for r in got]
        assert all(abs(a.score - b.score) < 1e-12 for a, b in zip(again, got))


def test_texts_without_a_label_stay_out_of_the_join(spark):
    texts = spark.createDataFrame([(k, f"t{k}") for k in range(5000)] + [(None, "none")], "__id long, content string")
    kept = {r["__id"] for r in toxicity._perhaps(texts, texts.where("__id % 5 = 0").select("__id")).collect()}
    assert set(range(0, 5000, 5)) <= kept and len(kept) < 1600
    assert toxicity._perhaps(texts, texts.where("__id < 0").select("__id")).count() == 0

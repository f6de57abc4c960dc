from pyspark.sql import functions as F

from saltmarsh.llm import mixing
from tests.llm.rows import ROWS, SCHEMA, documents, words


def taken(spark, rows, **options):
    df = mixing.assigned(spark.createDataFrame(rows, "doc_id long, source string, n long"), size="n", **options)
    return [(r.doc_id, r.source, r.mix) for r in df.collect()]


def test_targets_are_met_and_caps_hold(spark):
    rows = [(i, f"s{min(i % 7, 2)}", 1 + i * 37 % 200) for i in range(3000)] + [(9000 + i, "tiny", 3) for i in range(4)]
    got = taken(spark, rows, rows_a_bucket=50)
    total = sum(n for *_, n in rows)
    by = {}
    for i, s, m in got:
        by.setdefault(s, [m.target, m.source_size, 0])[2] += m.taken
        assert m.taken <= 3 * m.size and all(0 <= c.position <= 1 for c in m.copies)
    assert abs(sum(t for t, *_ in by.values()) - total) < 1e-6 * total
    for target, size, sum_ in by.values():
        assert target <= 3 * size + 1e-6 and abs(sum_ - target) <= 1
    assert by["tiny"][0] == 3 * by["tiny"][1]
    # weights 1, 2, 3 by code point: of the sources below their caps, equal shares by weight
    assert abs(by["s1"][0] / 2 - by["s0"][0]) < 1e-6 or by["s1"][0] == 3 * by["s1"][1]


def test_buckets_make_no_difference(spark):
    rows = [(i, "a" if i % 3 else "b", i % 11) for i in range(400)]
    a, b = (sorted(map(str, taken(spark, rows, rows_a_bucket=k))) for k in (1_000_000, 20))
    assert a == b


def test_positions_invert_the_schedule(spark):
    got = spark.range(1).select(*[mixing.position(F.lit(u), F.lit(a)).alias(f"p{k}") for k, (u, a) in enumerate(((0.3, 0.0), (0.3, 0.5), (0.9, -0.5)))]).first()
    for t, (u, a) in zip(got, ((0.3, 0.0), (0.3, 0.5), (0.9, -0.5))):
        assert abs(t + a * (t * t - t) - u) < 1e-9


def test_odd_rows_and_names(spark):
    docs = documents(spark).withColumns({"mix": F.lit("old"), "size": F.lit(1)})
    got = mixing.assigned(docs).collect()
    assert len(got) == len(ROWS) and sorted(r.mix.size for r in got) == sorted(len(words(t)) for _, t, *_ in ROWS)
    order = mixing.mixed(docs)
    assert order.columns == docs.columns
    for kind in (spark.createDataFrame([], SCHEMA), documents(spark, [(1, None, None, None, None), (2, "", "en", "s", 0)])):
        assert mixing.mixed(kind).count() == 0 and all(r.mix.taken == 0 and r.mix.target == 0 for r in mixing.assigned(kind).collect())

import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from saltmarsh.llm import neardup
from tests.llm.rows import ROWS, SCHEMA, documents, words


def print_of(text):
    w = words((text or "").encode().lower().decode())
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(prints, radius=2):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def clusters(seed, n=40):
    r, out = random.Random(seed), set()
    for _ in range(n):
        p = r.getrandbits(64)
        out.add(p)
        for _ in range(r.choice([0, 1, 3, 30])):
            p ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 2, 3])))
            out.add(p)
    return out


@pytest.mark.parametrize(("longest", "radius"), [(512, 2), (2, 2), (2, 1), (512, 1)])
def test_components_are_those_of_all_pairs(spark, longest, radius):
    prints = clusters(4)
    signed = lambda p: p - (p >> 63 << 64)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {r.node: r.root for r in neardup.components(neardup.links(df, radius, longest)).collect()}
    want = joined(prints, radius)
    mine = {p: found.get(signed(p), signed(p)) for p in prints}
    for a in prints:
        assert {b for b in prints if mine[b] == mine[a]} == {b for b in prints if want[b] == want[a]}


def test_classes(spark):
    docs = documents(spark).withColumns({"fingerprint": F.lit("old"), "component": F.lit(1), "fp": F.lit(2)})
    got = neardup.classes(docs).collect()
    want = joined({print_of(t) for _, t, *_ in ROWS})
    least = {}
    for i, t, *_ in ROWS:
        least.setdefault(want[print_of(t)], []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == sorted([(i, f"{print_of(t):016x}", least[want[print_of(t)]]) for i, t, *_ in ROWS], key=str)


def test_one_row_of_each_stays(spark):
    docs = documents(spark).withColumns({"fingerprint": F.lit("old"), "c0": F.lit(1)})
    got = neardup.deduplicated(docs)
    assert got.columns == docs.columns
    assert got.count() == len(set(joined({print_of(t) for _, t, *_ in ROWS}).values()))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neardup.classes(none).count() == 0 and neardup.deduplicated(none).count() == 0


def test_radius_is_bounded(spark):
    with pytest.raises(ValueError):
        neardup.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_star_tables_do_not_pile_up(spark, monkeypatch, tmp_path):
    names = iter(range(100))
    monkeypatch.setattr(neardup, "scratch", lambda spark, name: f"{tmp_path}/{name}{next(names)}")
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    found = neardup.components(chain)
    assert next(names) > 2 and len(list(tmp_path.iterdir())) == 1
    assert {(r.node, r.root) for r in found.collect()} == {(k, 0) for k in range(1, 41)}

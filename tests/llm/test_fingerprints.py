import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from saltmarsh.llm import fingerprints
from tests.llm.rows import ROWS, SCHEMA, documents, words


def print_of(text):
    seeded = lambda v, seed: xxhash.xxh64_intdigest(v, seed)
    w = [seeded(x, 42) for x in words(text)]
    terms = w if len(w) < 2 else [seeded(b.to_bytes(8, "little"), seeded(a.to_bytes(8, "little"), 42)) for a, b in zip(w, w[1:])]
    return sum(1 << b for b in range(64) if 2 * sum(t >> b & 1 for t in terms) > len(terms))


def test_fingerprints(spark):
    docs = documents(spark).withColumn("fingerprint", F.lit("old"))
    for r in fingerprints.with_fingerprints(docs).collect():
        assert r.fingerprint & (1 << 64) - 1 == print_of(r.text)


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_within_finds_all(spark, radius):
    r = random.Random(radius)
    prints = {r.getrandbits(64) for _ in range(30)}
    prints |= {p ^ sum(1 << b for b in r.sample(range(64), k)) for p in prints for k in (1, 2, 3, 4)}
    signed = lambda p: p - (p >> 63 << 64)
    rows = [(signed(p),) for p in prints]
    got = fingerprints.within(spark.createDataFrame(rows[::3], "q long"), spark.createDataFrame(rows, "fp long"), radius).collect()
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = sorted((q, p, near(q, p)) for (q,) in rows[::3] for (p,) in rows if near(q, p) <= radius)
    assert sorted((x.q, x.fp, x.bits) for x in got) == want


@pytest.mark.parametrize("size", [1, 3, 50])
def test_next_row(spark, size):
    df = fingerprints.with_next(documents(spark).withColumn("text", F.coalesce("text", F.lit(""))), ["text"], order="doc_id", ties="text", rows_a_range=size)
    rows = sorted([(-1 if i is None else i, t or "") for i, t, *_ in ROWS], key=lambda r: (r[0], r[1].encode()))
    want = sorted((i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.next_text) for r in df.collect()) == want


def test_single_and_empty(spark):
    one = documents(spark, [(5, "a b c d", "en", "s", 1)])
    r = fingerprints.against_edits(one).first()
    assert r.n_chars == 7 and r.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    assert r.near_next == 1.0
    assert fingerprints.against_edits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_against_edits(spark):
    got = fingerprints.against_edits(documents(spark), every=2).collect()
    rows = sorted([(-1 if i is None else i, t or "") for i, t, *_ in ROWS], key=lambda r: (r[0], r[1].encode()))
    want = []
    for k, (i, t) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        e = t[: len(t) - half] + following[:half]
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        near = sum((print_of(t) ^ print_of(x)).bit_count() <= 3 for _, x in rows) if i >= 0 and i % 2 == 0 else None
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{print_of(t):016x}", f"{print_of(e):016x}", like(print_of(t), print_of(e)), like(print_of(t), print_of(following)), near))
    assert sorted([(-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got], key=str) == sorted(want, key=str)


def test_next_row_of_hot_ids_and_names(spark):
    """Rows of one id, or none, are cut like others; scratch names of docs don't matter."""
    r = random.Random(4)
    rows = [(r.choice([None, 7, 7, 7, k]), "".join(r.choice("ab") for _ in range(r.choice([0, 3, 90]))), "en", "s", 1) for k in range(300)]
    docs = documents(spark, rows).withColumns({"key": F.lit(1), "tie": F.lit("x"), "range": F.lit(2)})
    got = fingerprints.with_next(docs, ["text"], order="doc_id", ties="text", rows_a_range=10)
    assert got.columns == [*docs.columns, "next_text"]
    own = sorted([(-(1 << 63) if i is None else i, t) for i, t, *_ in rows])
    want = sorted((i, t, own[(k + 1) % len(own)][1]) for k, (i, t) in enumerate(own))
    assert sorted((-(1 << 63) if x.doc_id is None else x.doc_id, x.text, x.next_text) for x in got.collect()) == want

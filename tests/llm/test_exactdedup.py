import hashlib

import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import exactdedup
from tests.llm.rows import ROWS, SCHEMA, documents


def brute(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", []).append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted([(i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows], key=str)


@pytest.mark.parametrize("memory", [1 << 26, 500])
def test_decisions(spark, memory):
    rows = ROWS + [(100 + i, f"text {i % 37}", "en", "s", 1) for i in range(500)]
    got = exactdedup.decisions(documents(spark, rows).repartition(5), table_bytes=memory).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("memory", [1 << 26, 500])
def test_rows_that_stay(spark, memory):
    docs = documents(spark).withColumns({"count": F.col("n_chars"), "hash": F.lit("x"), "content": F.array(F.lit(1))}).repartition(3)
    got = exactdedup.deduplicated(docs, table_bytes=memory)
    assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes)
    rows = got.collect()
    assert len(rows) == len({t or "" for _, t, *_ in ROWS}) == len({r.text for r in rows})
    best = {t: k for _, k, _, t in brute(ROWS)}
    assert all(r.doc_id == best[hashlib.sha256(r.text.encode()).hexdigest()] and r["count"] == r.n_chars for r in rows)


def test_contents_are_compared_when_hashes_agree():
    table = exactdedup.Table()
    for k, text in enumerate([b"a", b"b", b"a", b"c"]):
        table.add(exactdedup.Record(7, text, 1, k, k, [k], None))
    assert [(r.text, r.count, r.best) for r in table.records] == [(b"a", 2, 2), (b"b", 1, 1), (b"c", 1, 3)]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exactdedup.decisions(none).count() == 0 and exactdedup.deduplicated(none).count() == 0


def test_spills_go_where_spark_spills(monkeypatch, tmp_path):
    (tmp_path / "disk").mkdir()
    monkeypatch.setenv("SPARK_LOCAL_DIRS", f"{tmp_path}/none,{tmp_path}/disk")
    folder = exactdedup._spill_folder()
    assert folder.startswith(f"{tmp_path}/disk/grace-")
    records = [exactdedup.Record(hash_ * (1 << 60) + k, b"t%d" % k, 1, k, k, [k], None) for k, hash_ in enumerate([1, 2, 3] * 50)]
    assert sorted(r.text for b in exactdedup.grace(iter(records), folder, 2000) for r in b) == sorted(r.text for r in records)

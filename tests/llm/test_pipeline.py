import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from saltmarsh.llm import bpe, exactdedup, mixing, neardup, quality, queries
from saltmarsh.llm.common import id_crc
from tests.llm.test_neardup import joined, print_of


def test_stages_against_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit(docs, labels, "quality", id_crc() % 4 != 2)
    good = {r.doc_id: r.text for r in quality.score(docs, model).where(F.col("score") >= 0.7).collect()}
    last = {t: i for i, t in sorted(good.items())}
    exact = {i: t for t, i in last.items()}
    root = joined({print_of(t) for t in exact.values()})
    least = {}
    for i, t in sorted(exact.items()):
        least.setdefault(root[print_of(t)], i)
    apart = set(least.values())
    rows = docs.where(F.col("doc_id").isin(*apart))
    want = []
    for r in mixing.assigned(rows).collect():
        want += [r.doc_id] * sum(c.words > 0 and 2 * c.words >= r.mix.size for c in r.mix.copies)

    got = corpus_pipeline.run(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        encoder = bpe.Encoder(bpe.Vocabulary(f.read()))
    for r in got[:50]:
        assert r.ids == np.frombuffer(encoder.encode(exact[r.doc_id]), dtype=np.int32).tolist()


def test_stages_take_odd_tables(spark, small):
    none = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0
    for stage in (exactdedup.deduplicated, neardup.deduplicated, mixing.mixed):
        assert stage(none).columns == none.columns
    assert len(corpus_pipeline.STAGES) == 5

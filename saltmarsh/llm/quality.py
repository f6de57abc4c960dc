"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors: one for each word, each of its character n-grams, and each word that repeats
the one before it, all hashed to a fixed number of buckets. A linear layer with softmax output follows. Both are trained
by stochastic gradient descent in numpy over a bounded sample of labelled rows. For scoring, the vectors are folded with the output
layer into one number for each bucket, so a document's logit is the mean of its features' numbers plus the bias.

Defined cases: a text without words (null, empty, blanks) is scored by the bias alone. Long texts are read whole. Rows
are scored one by one, repeated ones alike. Labels other than 0 and 1, of unknown documents or held out are not learned
from; without any label the score is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm.common import contents, slices, text_of

BUCKETS, WIDTH, SHORTEST, LONGEST = 1 << 16, 16, 2, 4
#: Labelled rows that the classifier is fitted on at most, taken in the order of a hash of their id.
SAMPLE = 2500
EPOCHS, RATE = 3, 0.5
#: Words that a worker remembers the features of.
REMEMBERED = 200_000
BASIS, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of words, as the number of the word and the bucket: the word, and its character n-grams with the edges marked."""
    texts = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, texts), np.int64, len(texts)))
    owners, buckets = [np.arange(len(words))], [np.array([zlib.crc32(w) % BUCKETS for w in words], np.int64)]
    h = np.full(len(codes), BASIS) + np.uint64(0)
    for n in range(1, LONGEST + 1):
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * PRIME
        if n >= SHORTEST:
            within = owner[: len(h)] == owner[n - 1 :]
            owners.append(owner[: len(h)][within])
            buckets.append(((h[within] ^ (h[within] >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


#: A repeated word is a feature of its own, whichever word it is, and one of that word.
REPEATED = b"\x00again"


class Words:
    """Numbers words and remembers their features."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.buckets: list[np.ndarray] = []

    def numbers(self, text: bytes) -> np.ndarray:
        words = text.split()
        if len(self.number) > REMEMBERED:
            self.number.clear()
            self.buckets.clear()
        if new := [w for w in dict.fromkeys(words) if w not in self.number]:
            self.number.update(zip(new, range(len(self.buckets), len(self.buckets) + len(new))))
            owner, bucket = features(new)
            order = np.argsort(owner, kind="stable")
            self.buckets += np.split(bucket[order], np.cumsum(np.bincount(owner, minlength=len(new)))[:-1])
        return np.array([self.number[w] for w in words], dtype=np.int64)


def counted(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each text and their share of its features."""
    words = Words()
    again = zlib.crc32(REPEATED) % BUCKETS
    for text in texts:
        numbers = words.numbers(text)
        if not len(numbers):
            yield np.zeros(0, np.int64), np.zeros(0)
            continue
        which, times = np.unique(numbers, return_counts=True)
        counts = np.zeros(BUCKETS)
        lists = [words.buckets[k] for k in which.tolist()]
        counts += np.bincount(np.concatenate(lists), np.repeat(times, [len(x) for x in lists]), minlength=BUCKETS)
        # as many features as a word has, so that their share doesn't hang on how long words are
        counts[again] += REPEAT_WEIGHT * int((numbers[1:] == numbers[:-1]).sum())
        idx = np.flatnonzero(counts)
        yield idx, counts[idx] / counts[idx].sum()


REPEAT_WEIGHT = 8


@dataclass
class Model:
    """Folded: the logit that each bucket contributes, and the bias."""

    weights: np.ndarray
    bias: float


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """rows: label, buckets, shares. Plain stochastic gradient descent with a falling rate; the same rows give the same model."""
    r = np.random.default_rng(seed)
    vectors = r.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    layer, bias = r.normal(0, 1, (2, WIDTH)), np.zeros(2)
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for k in r.permutation(len(rows)):
            label, idx, share = rows[k]
            now = rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[idx] if len(idx) else np.zeros(WIDTH)
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer.T @ p
            layer -= now * np.outer(p, hidden)
            bias -= 0.1 * now * p
            if len(idx):
                # a mean of many vectors moves each by little: the step is taken relative to the largest share
                vectors[idx] -= now * np.outer(share * min(50.0, 1 / float(share @ share)), back)
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """At most that many labelled texts that may be learned from: label, content. learn is a condition on the labels' id."""
    known = labels.where(learn & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("label"))
    ids = known.groupBy("__id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    once = docs.select(F.col(doc_id).alias("__id"), text_of(text).alias("content"))
    # of at most `sample` ids; an id that rows repeat is learned from once
    return once.join(F.broadcast(ids), "__id").groupBy("__id", "label").agg(F.min("content").alias("content"))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """The executors count features; the driver gets at most `sample` rows of at most BUCKETS numbers."""
    schema = "id long, label int, idx array<int>, share array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 64):
                pairs = list(counted(batch.column(2).cast(pa.binary()).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([i.astype(np.int32) for i, _ in pairs], pa.list_(pa.int32())), pa.array([s.astype(np.float32) for _, s in pairs], pa.list_(pa.float32()))],
                    names=["id", "label", "idx", "share"],
                )

    found = labelled(docs, labels, label, learn, doc_id=doc_id, text=text, sample=sample).mapInArrow(run, schema).toArrow()
    order = np.lexsort((np.array([len(x) for x in found["idx"].to_pylist()]), found["id"].to_numpy())) if found.num_rows else []
    idx, share, y = found["idx"].combine_chunks(), found["share"].combine_chunks(), found["label"].to_pylist()
    rows = [(y[k], idx[int(k)].values.to_numpy().astype(np.int64), share[int(k)].values.to_numpy().astype(np.float64)) for k in order]
    return train(rows)


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the probability of label 1 (a column of that name is replaced)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    docs = docs.drop(into) if into != text else docs
    schema, at = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType(), False)]), docs.columns.index(text)
    again = zlib.crc32(REPEATED) % BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value.weights, sent.value.bias
        memory: dict[bytes, int] = {}
        sums, sizes = np.zeros(0), np.zeros(0)
        for whole in batches:
            for batch in slices(whole):
                split = [t.split() for t in contents(batch.column(at))]
                if len(memory) > REMEMBERED:
                    memory.clear()
                    sums, sizes = np.zeros(0), np.zeros(0)
                if new := list({w for words in split for w in words if w not in memory}):
                    memory.update(zip(new, range(len(memory), len(memory) + len(new))))
                    owner, bucket = features(new)
                    sums = np.concatenate([sums, np.bincount(owner, weights[bucket], minlength=len(new))])
                    sizes = np.concatenate([sizes, np.bincount(owner, minlength=len(new))])
                out = []
                for words in split:
                    ids = np.array([memory[w] for w in words], dtype=np.int64)
                    same = int((ids[1:] == ids[:-1]).sum())
                    total = sums[ids].sum() + REPEAT_WEIGHT * same * weights[again]
                    z = bias + (total / (sizes[ids].sum() + REPEAT_WEIGHT * same) if words else 0.0)
                    out.append(1 / (1 + np.exp(-max(-500.0, min(500.0, z)))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)

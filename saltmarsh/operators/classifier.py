"""Logistic regression over named features and hashed character trigrams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.config import CLASSIFIER
from saltmarsh.functions import score
from saltmarsh.functions.score import sigmoid
from saltmarsh.functions.spans import exploded

HASHED = 16_384
# The named features in the order of the model's first weights.
DENSE = [
    "validPhone", "partialPhone", "partialLength", "mixedForm", "noiseDigits", "weirdTokens", "intentChannel", "intentContact", "intentOffplatform", "intentPayment",
    "handle", "handleDigits", "upi", "email", "url", "riskyUrl", "zeroWidth", "confusables", "hostility", "extortion", "scamlink", "digitRunCount",
    "maxDigitRunLength", "totalDigits", "textLength", "digitRatio", "digitPressure", "isHost", "isPostBooking",
]


@dataclass
class Classifier:
    """weights (idx, w): a row for each feature at most, 16,413; and the bounds of its decisions."""

    weights: DataFrame
    bias: float
    allow: float = CLASSIFIER["allow"]
    block: float = CLASSIFIER["block"]


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def dense(df: DataFrame, detections: str = "detections") -> Column:
    """The named features in order, of rows as score.with_score has them; weird_tokens and pressure_after are optional."""
    count, has = partial(score.count, detections=detections), partial(score.has, detections=detections)
    lengths = F.transform("runs", lambda r: F.length(r["digits"]))
    longest, total = F.coalesce(F.array_max(lengths), F.lit(0)), F.aggregate(lengths, F.lit(0), lambda a, b: a + b)
    size = F.length("folded")
    col = lambda c: F.col(c) if c in df.columns else F.lit(0)
    flag = lambda c: c.cast("double")
    values = {
        "validPhone": flag(has("contact.phone", "contact.phone.obfuscated")), "partialPhone": flag(count("contact.phone.partial") > 0), "partialLength": longest / 10,
        "mixedForm": F.size(F.filter("runs", lambda r: r["mixed"])), "noiseDigits": F.col("noise"), "weirdTokens": col("weird_tokens"),
        "intentChannel": count("intent.channel"), "intentContact": count("intent.contact"), "intentOffplatform": count("intent.offplatform"),
        "intentPayment": count("intent.payment"), "handle": flag(count("contact.handle") > 0), "handleDigits": flag(has("contact.handle.embedded_digits")),
        "upi": flag(count("payment.upi") > 0), "email": flag(count("contact.email") > 0), "url": flag(count("contact.url") > 0), "riskyUrl": count("contact.url."),
        "zeroWidth": F.col("zero_width"), "confusables": F.col("confusables"), "hostility": flag(count("safety.hostility") > 0),
        "extortion": flag(count("safety.extortion") > 0), "scamlink": flag(count("safety.scamlink") > 0), "digitRunCount": F.size("runs"),
        "maxDigitRunLength": longest, "totalDigits": total, "textLength": F.log1p(size), "digitRatio": F.when(size > 0, total / size).otherwise(0.0),
        "digitPressure": col("pressure_after"), "isHost": flag(F.col("sender_role") == "host"), "isPostBooking": flag(F.col("booking_stage") == "post_booking"),
    }
    return F.array(*[values[n].cast("double") for n in DENSE])


def _padded(text: str) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" "))


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which text, idx and value of the trigrams of padded texts by hash, each text's of unit length; by text and idx. idx counts from the dense features on."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    begins = np.flatnonzero(row[:-2] == row[2:]) if len(row) > 2 else np.zeros(0, np.int64)
    h = np.full(len(begins), 0x811C9DC5, dtype=np.uint64)
    for k in range(3):
        h = ((h ^ codes[begins + k]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    both, n = np.unique(row[begins] * HASHED + (h % np.uint64(HASHED)).astype(np.int64), return_counts=True)
    row, n = both // HASHED, n.astype(np.float64)
    norm = np.sqrt(np.bincount(row, n * n, minlength=len(texts)))
    return row, both % HASHED + len(DENSE), n / norm[row]


def hashed_trigrams(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, idx, value): a text's trigrams as cells() has them. Each row is counted where it is, by Arrow batches; counted as rows, they are some thirty times as many."""

    @F.arrow_udf("array<struct<idx:int,value:double>>")
    def made(padded: pa.Array) -> pa.Array:
        row, idx, value = cells(padded.to_pylist())
        parts = pa.StructArray.from_arrays([pa.array(idx, pa.int32()), pa.array(value, pa.float64())], ["idx", "value"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(padded) + 1)), pa.int32()), parts)

    return exploded(df, made(_padded(text)), "cell", kept=[key]).select(key, "cell.idx", "cell.value")


def features(df: DataFrame, key: str, detections: str = "detections") -> DataFrame:
    """(key, idx, value) of all features that aren't zero; trigrams are those of the folded view."""
    named = exploded(df, dense(df, detections), "idx", "value", kept=[key], with_place=True).where("value <> 0")
    return named.unionByName(hashed_trigrams(df, key, "folded"))


def samples(rows: DataFrame, label: str, *, least: int = 200, order: str = "message_id") -> DataFrame:
    """What the classifier learns from: all rows in the escalation band, and as context about as many of the others for each label, or `least`,
    twice as many of label 0. First halves of split numbers (turn 0 of more turns) are left out; so are mined rows without any signal.
    Rows have band, detections, runs and noise; conversation_id and turn, and mined, are optional."""
    if "turn" in rows.columns:
        turns = F.max("turn").over(W.partitionBy("conversation_id"))
        rows = rows.withColumn("__turns", turns).where((F.col(label) == 0) | (F.col("turn") > 0) | (F.col("__turns") == 0)).drop("__turns")
    if "mined" in rows.columns:
        rows = rows.where(~F.col("mined") | (F.size("detections") > 0) | (F.size("runs") > 0) | (F.col("noise") > 0))
    escalated, settled = rows.where("band = 'escalate'"), rows.where("band <> 'escalate'")
    most = max(escalated.count(), least)
    sizes = {r[0]: r[1] for r in settled.groupBy(label).count().collect()}  # a row for each label
    # by a threshold on a hash of the id: about as many as wanted, without sorting any
    chance = F.lit(0.0)
    for value, wanted in ((0, 2 * most), (1, most)):
        chance = F.when(F.col(label) == value, min(1.0, wanted / max(1, sizes.get(value, 0)))).otherwise(chance)
    return escalated.unionByName(settled.where(F.pmod(F.xxhash64(order), F.lit(1 << 30)) < chance * (1 << 30)))


def _vectors(size: int):
    """A function of columns of cells that gives sparse vectors."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    return F.udf(lambda c: SparseVector(size, [x.idx for x in c], [x.value for x in c]), VectorUDT(), useArrow=True)


def train(rows: DataFrame, key: str, label: str, *, iterations: int = 60, l2: float = 1e-6, weight: str | None = None) -> Classifier:
    """The weights that matter, and the bias: class-weighted logistic regression by Spark ML over sparse vectors."""
    from pyspark.ml.classification import LogisticRegression

    size = len(DENSE) + HASHED
    cells = F.array_sort(F.collect_list(F.struct("idx", "value")))  # of one message
    sparse = features(rows, key).groupBy(key).agg(cells.alias("cells"))
    labelled = sparse.join(rows.select(key, F.col(label).cast("double").alias("label")), key)
    n = labelled.groupBy("label").count().collect()  # one row for each class
    total = sum(r["count"] for r in n)
    balance = F.lit(1.0)
    for r in n:
        balance = F.when(F.col("label") == r.label, total / (len(n) * r["count"])).otherwise(balance)
    # Spark has no expression for sparse vectors; cells travel in Arrow batches, of labelled rows only
    data = labelled.select(_vectors(size)("cells").alias("features"), "label", balance.alias("weight"))
    model = LogisticRegression(maxIter=iterations, regParam=l2, weightCol="weight").fit(data)
    spark = rows.sparkSession
    kept = [(i, float(w)) for i, w in enumerate(model.coefficients.toArray()) if abs(w) >= 1e-4]  # 16,413 at most
    return Classifier(spark.createDataFrame(kept, "idx int, w double"), float(model.intercept))


def probability(df: DataFrame, model: Classifier, where: Column, detections: str = "detections") -> Column:
    """The model's probability for rows as dense() takes them, null but for those asked for. A row's features are weighed where it is: neither
    they nor the rows are dealt out. The weights, 16,413 at most, go along with the function."""
    weights = np.zeros(len(DENSE) + HASHED)
    for r in model.weights.collect():
        weights[r.idx] += r.w
    bias = float(model.bias)

    @F.arrow_udf("double")
    def weighed(named: pa.Array, padded: pa.Array) -> pa.Array:
        asked = np.flatnonzero(named.is_valid().to_numpy(zero_copy_only=False))
        out = np.full(len(named), np.nan)
        if len(asked):
            row, idx, value = cells(padded.take(pa.array(asked)).to_pylist())
            own = named.take(pa.array(asked)).flatten().to_numpy(zero_copy_only=False).reshape(len(asked), len(DENSE))
            out[asked] = np.nan_to_num(own) @ weights[: len(DENSE)] + np.bincount(row, value * weights[idx], minlength=len(asked)) + bias
        return pa.array(out, mask=~np.isin(np.arange(len(named)), asked))

    return sigmoid(weighed(F.when(where, dense(df, detections)), F.when(where, _padded("folded"))))


def probabilities(cells: DataFrame, weights: DataFrame, bias: float, key: str) -> DataFrame:
    """(key, probability) of features as rows: the weights, 16,413 rows at most, are broadcast to them."""
    z = cells.join(F.broadcast(weights), "idx", "left").groupBy(key).agg((F.coalesce(F.sum(F.col("value") * F.col("w")), F.lit(0.0)) + bias).alias("z"))
    return z.select(key, sigmoid(F.col("z")).alias("probability"))

"""Toxicity by class-conditional Kneser-Ney models of words and pairs of words.

Counts are Kneser and Ney's: not how often a word occurs in a class, but in how many different contexts, here documents. Each
class's counts are discounted by an amount estimated from its words seen once and twice, n1 / (n1 + 2 n2), and the mass so freed
goes to one distribution that both classes share. That is the same estimate over both classes' counts together, and its own freed mass
is spread evenly over all words and an unknown one. So each distribution sums to 1, and a rare expression differs between
the classes by no more than their discounts allow.

That is order 1. With order 2 a word's chance hangs on the word before it (a mark before the first). Each class's counts of pairs are discounted so, and
the freed mass goes to pairs of both classes together, which both share; what those free goes to the class's words as above, whose counts are then
Kneser and Ney's of how many different words stand before a word. Each distribution sums to 1 here too. No pair is left out.

A toxic text is taken to draw each word from the toxic model with chance EXPRESSIVE and else from the ordinary one, as toxic texts
are mostly ordinary words; an ordinary text draws all from the ordinary one. The difference of the two log-likelihoods, each
divided by the number of words, is what a text is judged by. Its only other use is a logistic curve of two numbers, fitted on at
most SAMPLE labelled rows that are not counted; all others are.

Words are runs of letters, digits and other characters than ASCII marks, in lower case; kana and ideographs are words of one
character. They are known by 64-bit hashes. The model is a table in the shared folder with an entry for every counted word; it
grows with the text. It is cut by hash into parts of about PART words. Documents are packed in chunks; a chunk asks each part for its
different words, answers go back to the chunk, and a task holds one part and one chunk at a time, whatever the sizes of the model and the table. With
order 2 counts are kept instead, there is a part for each shuffle partition, a chunk asks for its different pairs too, and the chunks of a share of the rows are scored after those of another.

Defined cases: a text without words (null, empty, blanks, marks) has a difference of 0 and gets the score of that. Texts are read
whole; rows are scored one by one, repeated ones alike. Labels other than 0 and 1 are ignored; a document with both counts as
toxic. If a class has no rows, all scores are the share of toxic labels, or 0.5 without any. An empty table gives an empty result.
docs has to give the same rows in the same order each time it is read, as files do; otherwise score() fails.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm.common import forgotten, scratch, shuffle_partitions, text_of, written

#: The chance that a word of a toxic text is drawn from the toxic model.
EXPRESSIVE = 0.01
#: One labelled row of so many may be kept from counting, and of those this many at most are and fit the curve.
KEPT_BACK, SAMPLE = 8, 3000
#: Bytes of text in a chunk, and of those that are hashed at a time; words of the model in a part, about.
CHUNK, PIECE, PART = 24 << 20, 1 << 20, 400_000
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
POWERS = np.cumprod(np.full(64, ODD[0], np.uint64), dtype=np.uint64)
#: For each byte: 0 between words, 1 in a word, 2 the first byte of a character that is a word (U+3000 to U+9FFF).
KINDS = np.array([1 if b >= 128 or chr(b).isalnum() else 0 for b in range(256)], np.int8)
KINDS[0xE3:0xEA] = 2


def _hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text in lower case begins, and its hash."""
    global POWERS
    b = np.frombuffer(text, np.uint8)
    kind = KINDS[b]
    alone = kind == 2
    begins = kind > 0
    begins[1:] &= (kind[:-1] == 0) | alone[1:]
    if len(b) > 3:
        begins[3:] |= (kind[3:] > 0) & alone[:-3]  # what follows a character of three bytes
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    inside = np.flatnonzero(kind > 0)
    first = np.searchsorted(inside, starts)
    length = np.diff(np.append(first, len(inside)))
    if (longest := int(length.max())) > len(POWERS):
        POWERS = np.cumprod(np.full(2 * longest, ODD[0], np.uint64), dtype=np.uint64)
    place = np.arange(len(inside)) - np.repeat(first, length)
    h = np.add.reduceat((b[inside] + np.uint64(1)) * POWERS[place], first)
    h = (h ^ (h >> np.uint64(31))) * ODD[1]
    return starts, h ^ (h >> np.uint64(29))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts, one after the other, and how many each text has."""
    found, counts, held, size = [], [], [], 0

    def flush() -> None:
        lengths = np.array([len(t) + 1 for t in held])
        starts, h = _hashes(b"\n".join(held))
        found.append(h)
        counts.append(np.bincount(np.searchsorted(np.cumsum(lengths), starts, side="right"), minlength=len(held)))

    for t in texts:
        held.append((t or "").lower().encode())
        size += len(held[-1])
        if size >= PIECE:
            flush()
            held, size = [], 0
    if held:
        flush()
    return (np.concatenate(found), np.concatenate(counts)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _gathered(batches: Iterator[pa.RecordBatch], at: int, chunk: int) -> Iterator[pa.Table]:
    """Rows, `chunk` bytes of text or a little more at a time; a row is whole."""
    held, size = [], 0
    for whole in batches:
        for start in range(0, whole.num_rows, 64):
            part = whole.slice(start, 64)
            held.append(part)
            size += sum(len(t) for t in part.column(at).to_pylist() if t)
            if size >= chunk:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


@dataclass
class Model:
    """A table of part, keys and values (the words' hashes in order, and their differences), and the curve."""

    table: DataFrame | None
    parts: int = 1
    unknown: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    @property
    def usable(self) -> bool:
        return self.table is not None

    def entries(self) -> dict[int, float]:
        """All of the model, for tests."""
        return {k: v for r in self.table.collect() for k, v in zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["values"], np.float32).tolist())}


def _counted(rows: DataFrame) -> DataFrame:
    """(key, n0, n1) of rows (label, content): in how many documents of either class each word is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, 1, CHUNK):
            h, n = words(table.column(1).to_pylist())
            toxic = table.column(0).to_numpy() == 1
            which, different = pd.factorize(h)
            pairs = pd.unique(which * len(n) + np.repeat(np.arange(len(n)), n))
            weights = toxic[pairs % max(1, len(n))]
            every = np.bincount(pairs // max(1, len(n)), minlength=len(different))
            of_toxic = np.bincount(pairs // max(1, len(n)), weights, minlength=len(different)).astype(np.int64)
            keys = np.asarray(different, np.uint64).view(np.int64)
            for k in range(0, len(keys), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array((every - of_toxic)[part]), pa.array(of_toxic[part])], names=["key", "n0", "n1"])

    return rows.mapInArrow(run, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def discount(once: int, twice: int) -> float:
    """What is taken from each count; between 0 and 1."""
    return once / (once + 2 * twice) if once else 0.5


def chances(totals) -> tuple[Column, Column, Column, float]:
    """The shared and both classes' chances of a word (of a row n0, n1), and the logarithm of the ratio for one that no class has.
    totals: the sums over all words that count() takes."""
    d = {c: discount(totals[f"once{c}"], totals[f"twice{c}"]) for c in ("", "0", "1")}
    free = {c: d[c] * totals[f"kinds{c}"] / totals[f"all{c}"] for c in ("", "0", "1")}
    own = lambda n, c: F.greatest(n - d[c], F.lit(0.0)) / totals[f"all{c}"]
    shared = own(F.col("n0") + F.col("n1"), "") + free[""] / (totals["kinds"] + 1)
    p = [own(F.col(f"n{c}"), c) + free[c] * shared for c in ("0", "1")]
    return shared, p[0], p[1], float(np.log(free["1"] / free["0"]))


def mixed(ratio):
    """The difference of a word by its ratio of chances."""
    return np.log1p(EXPRESSIVE * (np.exp(ratio) - 1))


def totals_of(counts: DataFrame):
    """One row: sums, words, and words seen once and twice, of both classes and of all."""
    n = {"": F.col("n0") + F.col("n1"), "0": F.col("n0"), "1": F.col("n1")}
    sums = [(f"all{c}", F.sum(v)) for c, v in n.items()] + [(f"{name}{c}", F.count_if(test(v))) for c, v in n.items() for name, test in (("kinds", lambda x: x > 0), ("once", lambda x: x == 1), ("twice", lambda x: x == 2))]
    return counts.agg(*[s.alias(name) for name, s in sums]).first()


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> np.uint64(20)) % np.uint64(parts)


def count(rows: DataFrame) -> Model:
    """The model of all rows (label, content)."""
    counts = written(_counted(rows), "words")
    totals = totals_of(counts)
    if not (totals["all0"] and totals["all1"]):
        return Model(None)
    _, p0, p1, unknown = chances(totals)
    parts = -(-totals["kinds"] // PART)
    value = F.log1p(EXPRESSIVE * (p1 / p0 - 1)).cast("float")
    part = F.pmod(F.shiftrightunsigned("key", 20), F.lit(parts))
    entries = counts.select(part.alias("part"), "key", value.alias("value")).repartition(min(parts, shuffle_partitions(rows.sparkSession)), "part").sortWithinPartitions("part")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, values = None, [], []

        def out() -> pa.RecordBatch:
            k, v = np.concatenate(keys).view(np.uint64), np.concatenate(values)
            order = np.argsort(k)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([k[order].tobytes()], pa.binary()), pa.array([v[order].tobytes()], pa.binary())], names=["part", "keys", "values"])

        for batch in batches:
            of, k, v = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if now is not None and of[a] != now:
                    yield out()
                    keys, values = [], []
                now = int(of[a])
                keys.append(k[a:b])
                values.append(v[a:b])
        if now is not None:
            yield out()

    return Model(written(entries.mapInArrow(pack, "part long, keys binary, values binary"), "model"), parts, float(mixed(unknown)))


#: Rows of the two exchanges: where to, the chunk, whether first (what is needed before the rest), and packed numbers or rows.
SENT = "part long, chunk string, later int, a binary, b binary"


#: What stands before a text's first word.
START = np.uint64(0x5851F42D4C957F2D)
#: Rows of the model of pairs, by part: contexts, words, and pairs.
CONTEXTS, WORDS, PAIRS = 1, 2, 3
#: Bits of the filter that keeps most texts without a label from the join, at most.
MOST_BITS = 1 << 26
#: Documents are scored a share of so many after the other, by a hash of the text.
ROUNDS = 4


@dataclass
class PairModel:
    """Kneser and Ney's of pairs: a table of part, kind, and packed keys and counts; the number of parts, the discounts of pairs (of both classes, and of both
    together), and the sums over all words' numbers of different words before them, as totals_of() names them."""

    table: DataFrame | None
    parts: int = 1
    discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    totals: dict[str, int] | None = None
    slope: float = 0.0
    shift: float = 0.0

    @property
    def usable(self) -> bool:
        return self.table is not None


@contextlib.contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    """What is written or collected within leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    former = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if former is None else spark.conf.set(name, former)


def _starts(n: np.ndarray) -> np.ndarray:
    """Where texts with n words begin."""
    return (np.cumsum(n) - n)[n > 0]


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """48 bits, beside the part that the word before is in; of 400,000 keys in a part, one that isn't there is taken for one of them with chance 1.4e-9."""
    k = (v * ODD[0] + w) * ODD[1]
    k = (k ^ (k >> np.uint64(29))) * ODD[0]
    return (k ^ (k >> np.uint64(32))) >> np.uint64(16)


def _press(values: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(values.tobytes())


def _read(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Of keys in order: the leading bytes of their differences are 0, and stand together."""
    return _press(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy())


def _keys_of(blob: bytes) -> np.ndarray:
    return np.cumsum(_read(blob, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _packed_counts(values: np.ndarray) -> bytes:
    """Of rows of counts: rows of small ones as a byte each, column by column; other rows behind them."""
    values = np.ascontiguousarray(values, np.int64)
    small = (values < 255).all(axis=1)
    codes = np.where(small[:, None], values, 255).astype(np.uint8)
    return _press(np.concatenate([np.array(values.shape).view(np.uint8), codes.T.ravel(), values[~small].view(np.uint8).ravel()]))


def _counts_of(blob: bytes) -> np.ndarray:
    raw = _read(blob, np.uint8)
    n, k = raw[:16].view(np.int64).tolist()
    values = raw[16 : 16 + n * k].reshape(k, n).T.astype(np.int64)
    values[values[:, 0] == 255] = raw[16 + n * k :].copy().view(np.int64).reshape(-1, k)
    return values


def _cuts(of: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal numbers begin and end."""
    at = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    return ((a, b) for a, b in zip(at[:-1], at[1:]) if a < b)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _numbered(h: np.ndarray, n: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different words of texts and what stands before the first, by part and hash, their parts, and for each word the places of itself and of the word before it."""
    codes, found = pd.factorize(h)
    found = np.append(np.asarray(found, np.uint64), START)
    of = _part(found, parts)
    order = np.lexsort((found, of))
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    own = place[codes]
    former = np.roll(own, 1)
    former[_starts(n)] = place[-1]
    return found[order], of[order], own, former


PACKED = "part long, kind int, of long, a binary, b binary"


def _packed(part: int, kind: int, of: int, a: bytes, b: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, kind, of, a, b), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "kind", "of", "a", "b"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows by their first column, which they are in order of."""
    now, held = None, []
    for batch in batches:
        for first, *rest in zip(*[c.to_pylist() for c in batch.columns]):
            if first != now and held:
                yield now, held
                held = []
            now = first
            held.append(rest)
    if held:
        yield now, held


def _pair_counts(rows: DataFrame, parts: int, chunk: int) -> DataFrame:
    """Of rows (label, content), packed by part: CONTEXTS, with their numbers n0, n1 of words behind them, and k0, k1, and k in either class of different ones; WORDS, for the part `of` that
    they are in, with k0, k1 different words before them there (to be added up); PAIRS, with n0, n1; and 0, how many pairs of either class and of both together are seen once, and twice."""
    n = shuffle_partitions(rows.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, 1, chunk):
            h, counts = words(table.column(1).to_pylist())
            toxic = np.repeat(table.column(0).to_numpy() == 1, counts)
            found, of, own, former = _numbered(h, counts, parts)
            # in order of the pair, then of the class
            both = np.sort((former * len(found) + own) * 2 + toxic)
            begins = _runs(both >> 1)
            if not len(begins):
                continue
            c1 = np.add.reduceat(both & 1, begins)
            c0 = np.diff(np.append(begins, len(both))) - c1
            v, w = np.divmod(both[begins] >> 1, len(found))
            for a, b in _cuts(of[v]):
                different, which = np.unique(found[w[a:b]], return_inverse=True)
                blobs = [_packed_keys(found[v[a:b]]), _packed_keys(different), _press(which.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.copy()), _packed_counts(np.column_stack([c0[a:b], c1[a:b]]))]
                yield pa.RecordBatch.from_arrays([pa.array([int(of[v[a]])], pa.int64()), *[pa.array([x], pa.binary()) for x in blobs]], names=["part", "v", "w", "at", "n"])

    def reduced(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        v, w = np.concatenate([_keys_of(x[0]) for x in held]), np.concatenate([_keys_of(x[1])[_read(x[2], np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()] for x in held])
        c = np.concatenate([_counts_of(x[3]) for x in held])
        order = np.lexsort((w, v))
        v, w, c = v[order], w[order], c[order]
        begins = _runs(v, w)
        v, w, c = v[begins], w[begins], np.add.reduceat(c, begins)
        some = (c > 0).astype(np.int64)
        begins = _runs(v)
        yield _packed(part, CONTEXTS, part, _packed_keys(v[begins]), _packed_counts(np.column_stack([np.add.reduceat(c, begins), np.add.reduceat(some, begins), np.diff(np.append(begins, len(v)))])))
        of = _part(w, parts)
        order = np.lexsort((w, of))
        own, of = w[order], of[order]
        begins = _runs(own)
        own, of, kinds = own[begins], of[begins], np.add.reduceat(some[order], begins)
        for a, b in _cuts(of):
            yield _packed(part, WORDS, int(of[a]), _packed_keys(own[a:b]), _packed_counts(kinds[a:b]))
        of_all = np.column_stack([c, c.sum(axis=1)])
        yield _packed(part, 0, part, _packed_counts(np.stack([(of_all == 1).sum(axis=0), (of_all == 2).sum(axis=0)])), b"")
        key = pair_key(v, w)
        order = np.argsort(key)
        yield _packed(part, PAIRS, part, _packed_keys(key[order]), _packed_counts(c[order]))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _grouped(batches):
            yield from reduced(part, held)

    packed = rows.mapInArrow(gather, "part long, v binary, w binary, at binary, n binary").repartition(n, "part").sortWithinPartitions("part")
    return packed.mapInArrow(reduce, PACKED)


def count_pairs(rows: DataFrame, parts: int | None = None, chunk: int = CHUNK // 4) -> PairModel:
    """The model of pairs of all rows (label, content). A word's own chances are those of chances(), from the numbers of different words before it."""
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    parts = min(parts or n, 1 << 16)
    paths = [scratch(spark, "pairs"), scratch(spark, "words")]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _grouped(batches):
            keys, c = np.concatenate([_keys_of(x[0]) for x in held]), np.concatenate([_counts_of(x[1]) for x in held])
            order = np.argsort(keys)
            keys, c = keys[order], c[order]
            begins = _runs(keys)
            keys, c = keys[begins], np.add.reduceat(c, begins)
            yield _packed(part, WORDS, part, _packed_keys(keys), _packed_counts(c))
            each = np.column_stack([c.sum(axis=1), c])
            yield _packed(part, 0, part, _packed_counts(np.stack([each.sum(axis=0), *[f(each).sum(axis=0) for f in (lambda x: x > 0, lambda x: x == 1, lambda x: x == 2)]])), b"")

    def sums(table: DataFrame) -> np.ndarray:
        """Over the parts."""
        return sum((_counts_of(r.a) for r in table.where("kind = 0").select("a").collect()), start=np.zeros(1, np.int64))

    with _tidied(spark):
        found = written(_pair_counts(rows, parts, chunk), "pairs", paths[0])
        of_words = found.where(F.col("kind") == WORDS).select("of", "a", "b").repartition(n, "of").sortWithinPartitions("of").mapInArrow(add_up, PACKED)
        own = written(of_words, "words", paths[1])
        seen, of_all = sums(found), sums(own)
        usable = of_all.ndim > 1 and of_all[0, 1:].all()
        whole = found.where(F.col("kind").isin(CONTEXTS, PAIRS)).unionByName(own.where(F.col("kind") == WORDS)).select("part", "kind", "a", "b")
        table = written(whole, "model") if usable else None
    for path in paths:
        forgotten(spark, path)
    if not usable:
        return PairModel(None)
    totals = {f"{name}{c}": int(of_all[k, j]) for k, name in enumerate(("all", "kinds", "once", "twice")) for j, c in enumerate(("", "0", "1"))}
    return PairModel(table, parts, tuple(discount(*seen[:, c].tolist()) for c in range(3)), totals)


def _asked(parts: int, h: np.ndarray, n: np.ndarray, places: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The different words of texts by part, their parts, the different pairs with the part above the key, and, if asked for, the places of each word in the first, of the word before it there, and of
    the pair in the other."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * 3
    found, of, own, former = _numbered(h, n, parts)
    keys = (of[former] << np.uint64(48)) | pair_key(found[former], h)
    if not places:
        keys = np.sort(keys)
        return found, of, keys[_runs(keys)], []
    order = np.argsort(keys)
    begins = _runs(keys[order])
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(keys))))
    return found, of, keys[order][begins], [own, former, place]


def _looked_up(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The counts of keys that are asked for; of others, none."""
    if not len(keys):
        return np.zeros((len(asked), counts.shape[1]), np.int64)
    near = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return counts[near] * (keys[near] == asked)[:, None]


def pair_differences(model: PairModel, of_words: np.ndarray, of_pairs: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """The difference of each word, by the counts of words (different words before them in either class, and what CONTEXTS have) and of pairs."""
    own, former, pair = places
    t, d = model.totals, model.discounts
    of_words, seen = of_words.astype(np.float64), of_pairs.any(axis=1)[pair]
    b, n, k, either = of_words[:, :2], of_words[:, 2:4], of_words[:, 4:6], of_words[:, 6]
    less = {c: discount(t[f"once{c}"], t[f"twice{c}"]) for c in ("", "0", "1")}
    free = {c: less[c] * t[f"kinds{c}"] / t[f"all{c}"] for c in less}
    shared = np.maximum(b.sum(axis=1) - less[""], 0) / t["all"] + free[""] / (t["kinds"] + 1)
    both = n.sum(axis=1)
    met, once = both > 0, np.maximum(both, 1)
    among = np.where(met, d[2] * either / once, 1.0)  # of the backoff, the share that words have by themselves
    pair, behind = of_pairs[pair[seen]].astype(np.float64), former[seen]
    together = np.maximum(pair.sum(axis=1) - d[2], 0)
    p = []
    for c in (0, 1):
        word = np.maximum(b[:, c] - less[str(c)], 0) / t[f"all{c}"] + free[str(c)] * shared
        backed = np.where(n[:, c] > 0, d[c] * k[:, c] / np.maximum(n[:, c], 1), 1.0)
        p.append((backed * among)[former] * word[own])
        p[c][seen] += np.maximum(pair[:, c] - d[c], 0) / np.maximum(n[:, c], 1)[behind] + (backed / once)[behind] * together
    return np.log1p(EXPRESSIVE * (p[1] / p[0] - 1))


def _judged(docs: DataFrame, model: Model | PairModel, text: str, schema: T.StructType, finish, chunk: int = CHUNK) -> DataFrame:
    """finish(columns, difference of each row) of docs, of which `text` is the column of texts; chunk by chunk."""
    at, parts, unknown = docs.columns.index(text), model.parts, model.unknown if isinstance(model, Model) else 0.0
    paired = isinstance(model, PairModel)
    chunk = chunk // 4 if paired else chunk
    numbers = replace(model, table=None)  # what tasks get of it
    n = shuffle_partitions(docs.sparkSession)
    arrow = pa.schema([("part", pa.int64()), ("chunk", pa.string()), ("later", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
    asking = PAIRS + 1  # behind all rows of the model

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, arrow.types)], schema=arrow)

    def chunk_of(table: pa.Table) -> str:
        """A chunk's name is its contents, so that answers never meet another text."""
        digest = xxhash.xxh3_128(str(table.num_rows).encode())
        for t in table.column(at).to_pylist():
            digest.update(f"{'' if t is None else len(t)}:{t or ''}".encode())
        return digest.hexdigest()

    def ordered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different words by part, the parts, and where each word of h is in that order."""
        keys, back = np.unique(h, return_inverse=True)
        of = _part(keys, parts)
        order = np.argsort(of, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        return keys[order], of[order], place[back]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, at, chunk):
            h, counts = words(table.column(at).to_pylist())
            name = chunk_of(table)
            if not paired:
                keys, of, _ = ordered(h)
                for a, b in _cuts(of):
                    yield row(int(of[a]), name, asking, _packed_keys(keys[a:b]), None)
                continue
            keys, of, pairs, _ = _asked(parts, h, counts, False)
            of_pairs = pairs >> np.uint64(48)
            for a, b in _cuts(of):
                first, last = np.searchsorted(of_pairs, of[a], "left"), np.searchsorted(of_pairs, of[a], "right")
                # of words, 48 bits are asked for too
                yield row(int(of[a]), name, asking, _packed_keys(keys[a:b] >> np.uint64(16)), _packed_keys(pairs[first:last] & np.uint64((1 << 48) - 1)))

    def answer_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for part, name, later, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                if part != now:
                    now, held = part, {kind: (np.zeros(0, np.uint64), np.zeros((0, k), np.int64)) for kind, k in ((WORDS, 2), (CONTEXTS, 5), (PAIRS, 2))}
                if later < asking:
                    held[later] = _keys_of(a) if later == PAIRS else _keys_of(a) >> np.uint64(16), _counts_of(b)
                    continue
                asked = _keys_of(a)
                found = np.hstack([_looked_up(*held[WORDS], asked), _looked_up(*held[CONTEXTS], asked)])
                yield row(part, name, 0, _packed_counts(found), _packed_counts(_looked_up(*held[PAIRS], _keys_of(b))))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, values = None, None, None
        for batch in batches:
            for part, name, later, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                if not later:
                    now, keys, values = part, np.frombuffer(a, np.uint64), np.frombuffer(b, np.float32)
                    continue
                asked = _keys_of(a)
                if now != part:  # a part that the model has no words for
                    found = np.full(len(asked), unknown, np.float32)
                else:
                    near = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    found = np.where(keys[near] == asked, values[near], np.float32(unknown))
                yield row(part, name, 0, _press(found.view(np.uint8).reshape(-1, 4).T.copy()), None)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, at, chunk):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield row(None, chunk_of(table), 1, zstandard.ZstdCompressor(level=3).compress(sink.getvalue()), None)

    def differences(told: dict[int, tuple], h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if paired:
            keys, _, pairs, places = _asked(parts, h, counts, True)
            found = [np.concatenate([np.zeros((0, k), np.int64), *[_counts_of(told[p][j]) for p in sorted(told)]]) for j, k in ((0, 7), (1, 2))]
            same = len(found[0]) == len(keys) and len(found[1]) == len(pairs)
        else:
            keys, _, place = ordered(h)
            found = np.concatenate([np.zeros(0, np.float32), *[_read(told[p][0], np.uint8).reshape(4, -1).T.copy().view(np.float32).ravel() for p in sorted(told)]]).astype(np.float64)
            same = len(found) == len(keys)
        if not same:
            raise ValueError("docs gave other rows when read again; write them as a table first")
        return pair_differences(numbers, *found, places) if paired else found[place]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told = None, {}
        for batch in batches:
            for part, name, later, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                if name != now:
                    now, told = name, {}
                if not later:
                    told[part] = a, b
                    continue
                table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(a)).read_all()
                h, counts = words(table.column(at).to_pylist())
                means, some = np.zeros(len(counts)), counts > 0
                each = differences(told, h, counts)
                if some.any():
                    means[some] = np.add.reduceat(each, (np.cumsum(counts) - counts)[some]) / counts[some]
                yield from finish(table, means).to_batches(max_chunksize=256)

    known = (F.col("kind"), F.col("a"), F.col("b")) if paired else (F.lit(0), F.col("keys").alias("a"), F.col("values").alias("b"))
    numbered = model.table.select(F.col("part"), F.lit("").alias("chunk"), known[0].alias("later"), *known[1:])
    asked = docs.mapInArrow(ask, SENT)
    answers = numbered.unionByName(asked).repartition(n, "part").sortWithinPartitions("part", "later").mapInArrow(answer_pairs if paired else answer, SENT)
    sent = docs.mapInArrow(send, SENT)
    return answers.unionByName(sent).repartition(n, "chunk").sortWithinPartitions("chunk", "later").mapInArrow(judge, schema)


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one number, by Newton's method with a little ridge on the standardised one."""
    mean, spread = x.mean(), x.std() or 1.0
    a = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2), a.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def _perhaps(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Of texts, all whose __id is known and a few others, found by one bit for each id in a filter of bounded size; so that a join with known moves few other texts."""
    spark = texts.sparkSession
    bits = min(MOST_BITS, 1 << max(10, (16 * known.count()).bit_length()))
    at = F.pmod(F.xxhash64("__id"), F.lit(bits))
    cells = known.select(at.alias("at")).groupBy(F.expr("shiftright(at, 6)").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("set")).toArrow()
    whole = np.zeros(bits // 64, np.int64)
    whole[cells["cell"].to_numpy()] = cells["set"].to_numpy()
    sent = spark.sparkContext.broadcast(whole)  # 8 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy()
            yield batch.filter(pa.array((sent.value[place >> 6] >> (place & 63)) & 1 == 1)).select([0, 1])

    return texts.withColumn("__at", at).mapInArrow(run, texts.schema)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, order: int = 1) -> Model | PairModel:
    """The model of all labelled rows for which `learn` holds, but for the bounded sample that fits the curve: of words (order 1), or of words behind the word
    before them (order 2)."""
    known = labels.where(learn & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("label"))
    back = F.pmod(F.xxhash64("__id"), F.lit(KEPT_BACK)) == 0
    texts = docs.select(F.col(doc_id).alias("__id"), text_of(text).alias("content"))
    asked = written(known.where(back).join(texts.select("__id"), "__id", "left_semi").orderBy(F.xxhash64(F.lit("curve"), "__id"), "__id").limit(sample), "curve")
    known = written(known.join(F.broadcast(asked.select("__id")), "__id", "left_anti"), "labels")
    # both sides by id, at any size: labels grow with the documents
    model = (count_pairs if order > 1 else count)(_perhaps(texts, known).join(known.hint("merge"), "__id").select("label", "content"))
    if not model.usable:
        n = known.unionByName(asked).agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
        share = min(1 - 1e-6, max(1e-6, n.share)) if n.n else 0.5
        model.shift = float(np.log(share / (1 - share)))
        return model

    def finish(table: pa.Table, found: np.ndarray) -> pa.Table:
        return pa.table([table.column(0), pa.array(found)], names=["label", "x"])

    once = texts.join(F.broadcast(asked), "__id").groupBy("__id", "label").agg(F.min("content").alias("content"))  # of at most `sample` ids
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("x", T.DoubleType())])
    once = written(once.select("label", "content"), "curve-texts")
    with _tidied(docs.sparkSession):
        rows = _judged(once, model, "content", schema, finish).toArrow()
    y, x = np.array(rows["label"].to_pylist(), float), np.array(rows["x"].to_pylist(), float)
    order = np.lexsort((x, y))
    model.slope, model.shift = curve(x[order], y[order]) if 0 < y.sum() < len(y) else (1.0, 0.0)
    return model


def score(docs: DataFrame, model: Model | PairModel, *, text: str = "text", into: str = "score", chunk: int = CHUNK, columns: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Adds the probability of being toxic (a column of that name is replaced) to those columns of docs, or to all. With a model of pairs, the rows are written as a table, a share of
    them (by a hash of the text) after the other, so that no more than one share's questions and answers are on disks at a time."""
    slope, shift = model.slope, model.shift
    docs = docs.drop(into) if into != text else docs
    columns = docs.columns if columns is None else columns
    if not model.usable:
        return docs.select(*columns, F.lit(1 / (1 + float(np.exp(-shift)))).alias(into))
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField(into, T.DoubleType(), False)])

    def finish(table: pa.Table, found: np.ndarray) -> pa.Table:
        z = np.clip(found * slope + shift, -500, 500)
        return pa.table([*[table.column(c) for c in columns], pa.array(1 / (1 + np.exp(-z)), pa.float64())], names=schema.names)

    if isinstance(model, Model):
        return _judged(docs, model, text, schema, finish, chunk)
    path = scratch(docs.sparkSession, "scores")
    with _tidied(docs.sparkSession):
        for k in range(rounds):
            some = docs.where(F.pmod(F.xxhash64(text), F.lit(rounds)) == k)
            written(_judged(some, model, text, schema, finish, chunk), "scores", f"{path}/{k}")
    return docs.sparkSession.read.schema(schema).parquet(*[f"{path}/{k}" for k in range(rounds)])

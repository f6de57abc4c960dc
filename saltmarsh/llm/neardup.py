"""Near-duplicates by SimHash, found through an inverted index of fingerprint bytes.

A 64-bit fingerprint is eight bytes at eight positions. Two fingerprints within `radius` differing bits differ in at
most `radius` positions, so they share at least 8 - radius positional bytes. The index has an entry for a fingerprint under
each pair of its four two-byte cells: two differing bits touch two cells at most, so any pair that is to be found
shares one entry or more. (Lists of one positional byte would each hold a 256th of all fingerprints, and tallying
them the square of that.) In a list the shared positional bytes of each pair are tallied, pairs below the guaranteed
minimum are dropped, and the rest is verified by counting differing bits. A list emits links of a spanning forest only.

Lists longer than LONGEST_LIST, as a large group of near copies makes them, take an exact way that is linear in them: two
fingerprints of a list differ in at most two of the 32 bits outside its cells, if and only if they meet in a word that
one bit makes of either. So each is filed under its 33 words, and under a word all are linked to the least.

Equal fingerprints are one vertex, so exact copies cost nothing. Components come from alternating star contractions on
tables in the shared folder; only counts reach the driver.

Defined cases: a text without words (null, empty, blanks) has fingerprint zero, which links like any other. Fewer words
than a shingle has are one shingle. Repeated rows and ids are in one component, as are ties; the smallest id names
it (null if it has no other). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm.common import contents, forgotten, scratch, shuffle_partitions, slices, written

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Pairs of the four cells of 16 bits.
CELLS = list(combinations(range(4), 2))
LONGEST_LIST = 512


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority of the shingles' XXH64 (a tie is 0), repeats counted; A-Z are lower-cased first."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    total, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for k in range(0, n, 1 << 16):
        part = map(slice, starts[k : min(k + (1 << 16), n)], [e - 1 for e in ends[min(shingle, len(words)) - 1 + k :]])
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, part), repeat(SEED)), dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, *, text: str = "text", into: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint as a long; a column of that name is replaced."""
    docs = docs.drop(into) if into != text else docs
    schema, at = T.StructType([*docs.schema.fields, T.StructField(into, T.LongType(), False)]), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                prints = np.array([fingerprint(t, shingle) for t in contents(batch.column(at))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _entries(prints: DataFrame) -> DataFrame:
    """The index: a list's key (number of the cell pair and the cells' 32 bits) and a fingerprint."""
    cell = lambda c: F.shiftrightunsigned(F.col("fp"), 48 - 16 * c).bitwiseAND(F.lit(0xFFFF))
    keys = [F.lit(k << 32).cast("long") + cell(a) * 65536 + cell(b) for k, (a, b) in enumerate(CELLS)]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between the members of a list that connect whatever its pairs within the radius connect."""
    differ = prints[:, None] ^ prints[None, :]
    tally = (differ.view(np.uint8).reshape(len(prints), len(prints), 8) == 0).sum(axis=2)
    linked = tally >= 8 - radius
    linked[linked] = np.bitwise_count(differ[linked]) <= radius
    found, seen = [], np.zeros(len(prints), bool)
    for start in range(len(prints)):
        if seen[start]:
            continue
        seen[start], todo = True, [start]
        while todo:
            near = np.flatnonzero(linked[(k := todo.pop())] & ~seen)
            seen[near] = True
            found += [(k, int(j)) for j in near]
            todo += near.tolist()
    return found


def links(prints: DataFrame, radius: int = RADIUS, longest: int = LONGEST_LIST) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect all pairs within the radius, which is 2 at most."""
    if not 0 <= radius <= 2:
        raise ValueError("the index guarantees pairs of up to two differing bits")
    n = shuffle_partitions(prints.sparkSession)
    schema = "a long, b long, key long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, long_list = None, [], False

        def closed(parts: list[np.ndarray]) -> list[tuple[int, int]]:
            members = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
            if len(members) < 2:
                return []
            return [(int(members[i]), int(members[j])) for i, j in _forest(members.view(np.uint64), radius)]

        def out(found: list[tuple[int, int]], key: int | None = None) -> pa.RecordBatch:
            a, b = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([key] * len(found), pa.int64())], names=["a", "b", "key"])

        for batch in batches:
            keys, prints_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            bounds = np.concatenate(([0], cuts, [len(keys)]))
            single = np.diff(bounds) == 1
            for s, e, one in zip(bounds[:-1].tolist(), bounds[1:].tolist(), single.tolist()):
                if s == e:
                    continue
                key = int(keys[s])
                if key != last:
                    if held and not long_list and sum(map(len, held)) > 1 and (found := closed(held)):
                        yield out(found)
                    last, held, long_list = key, [], False
                    if one and e < len(keys):
                        continue
                part = prints_[s:e]
                if not long_list and sum(map(len, held)) + len(part) > longest:
                    long_list = True
                    if held:
                        yield out([(int(x), int(x)) for h in held for x in h], key)
                    held = []
                if long_list:
                    yield out([(int(x), int(x)) for x in part], key)
                else:
                    held.append(part)
        if held and not long_list and (found := closed(held)):
            yield out(found)

    lists = _entries(prints).repartition(n, "key").sortWithinPartitions("key", "fp")
    found = written(lists.mapInArrow(run, schema), "links")
    short = found.where("key is null").select("a", "b")
    # the 32 bits outside the list's cells, each turned in turn
    masks = [F.array(*[F.lit(v) for v in [0, *_turned(cells)]]) for cells in CELLS]
    mask = F.element_at(F.array(*masks), (F.shiftright("key", 32) + 1).cast("int"))
    words = found.where("key is not null").select("key", "a", F.explode(mask).alias("turn")).select("key", F.col("a").bitwiseXOR(F.col("turn")).alias("word"), "a")
    met = words.groupBy("key", "word").agg(F.array_sort(F.collect_set("a")).alias("near")).where(F.size("near") > 1)  # 33 at most
    if radius < 2:
        pairs = met.select(F.explode("near").alias("a"), "near").select("a", F.explode("near").alias("b")).where("a < b")
        more = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    else:
        more = met.select(F.col("near")[0].alias("a"), F.explode("near").alias("b")).where("a <> b")
    return short.unionByName(more).distinct()


def _turned(cells: tuple[int, int]) -> list[int]:
    free = [48 - 16 * c + k for c in range(4) if c not in cells for k in range(16)]
    return [(1 << k) - (1 << 64 if k == 63 else 0) for k in free]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b) but the roots themselves; a root is the least of its component.

    Large-star and small-star steps by turns, until nothing changes; each step's links are a table, which goes when the next one is there.
    """
    spark, path = edges.sparkSession, scratch(edges.sparkSession, "star")
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now, before = written(edges.where("a <> b").select(least.alias("root"), most.alias("node")).distinct(), "star", path), None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("root", "node").cast("decimal(38,0)")).alias("s")).first()
        if before == (sign.n, sign.s):
            return now.select("node", "root")
        before = (sign.n, sign.s)
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(now.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least_of = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))
        large = both.where("v > u").join(least_of, "u").select("root", F.col("v").alias("node")).distinct()
        least_of = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(least_of, "node")
        small = small.select(F.col("least").alias("root"), "node").unionByName(small.where("root <> least").select(F.col("least").alias("root"), F.col("root").alias("node")))
        last, path = path, scratch(spark, "star")
        now = written(small.distinct(), "star", path)
        forgotten(spark, last)


def _grouped(rows: DataFrame, doc_id: str, radius: int, longest: int) -> DataFrame:
    """For each fingerprint (fp): component (its least id) and the number (__row) of the row with that id."""
    best = F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col("__row"))).alias("best")
    prints = written(rows.groupBy(F.col("fingerprint").alias("fp")).agg(best), "prints")
    roots = components(links(prints.select("fp"), radius, longest))
    marked = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "best")
    least = marked.groupBy("root").agg(F.min("best").alias("best"))
    return marked.drop("best").join(least, "root").select("fp", F.col(f"best.{doc_id}").alias("component"), F.col("best.__row").alias("stays"))


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, longest: int = LONGEST_LIST) -> DataFrame:
    """For each row: doc_id, fingerprint (16 hex digits), component_id (the least id reachable over links)."""
    slim = docs.select(doc_id, text).withColumn("__row", F.monotonically_increasing_id())
    rows = written(with_fingerprints(slim, text=text, shingle=shingle).drop(text), "simhash")
    groups = _grouped(rows, doc_id, radius, longest)
    return rows.join(groups, rows["fingerprint"] == groups["fp"]).select(doc_id, hexed(F.col("fingerprint")).alias("fingerprint"), F.col("component").alias("component_id"))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, longest: int = LONGEST_LIST) -> DataFrame:
    """One row of each component, that with the least id, with all columns."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # so that no name can clash
    own, body = (f"c{docs.columns.index(c)}" for c in (doc_id, text))
    rows = written(with_fingerprints(plain.withColumn("__row", F.monotonically_increasing_id()), text=body, shingle=shingle), "simhash")
    groups = _grouped(rows.select(own, "__row", "fingerprint"), own, radius, longest)
    kept = rows.join(groups.select("stays").distinct(), rows["__row"] == F.col("stays"), "left_semi")
    return kept.select(*plain.columns).toDF(*docs.columns)

"""Exact deduplication by Grace hashing.

1. Each input partition goes through a Grace hash: its records go into an open-addressing table, which compares complete
   texts; when the table's distinct texts outgrow their memory, all goes to spill files by bits of the hash, and each file
   is treated likewise with the next bits. One record for each distinct text of the partition remains, with its count
   and its largest id; so however many copies a text has, at most one record for each partition is shuffled.
2. These records are dealt by hash, and each reducer runs the same Grace hash over them. It names the row that stays.
3. Both results go back to the documents by the number of their partition's record, which only rows of one partition
   share: there is no hot key, and neither a task nor the driver holds a group's members.

Defined cases: a null text counts as empty, and all empty texts are one group. Rows count one by one, repeated rows and
ids too. Of equal texts the row with the largest id stays (a null id is the smallest); of several rows with that id, one.
Texts of any length are compared whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import random
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from saltmarsh.llm.common import shuffle_partitions, slices, text_of, written

#: Bytes of distinct texts that a table may hold before its records are partitioned.
TABLE_BYTES = 64 << 20
#: Bits of the hash that one partitioning step uses.
FAN_BITS = 4


class Record:
    """A text, the rows that had it, the largest id with the number of its row, and that row's other columns."""

    __slots__ = ("at", "best", "count", "hash", "numbers", "rest", "text")

    def __init__(self, *values) -> None:
        self.hash, self.text, self.count, self.best, self.at, self.numbers, self.rest = values

    def values(self) -> tuple:
        return self.hash, self.text, self.count, self.best, self.at, self.numbers, self.rest

    def merge(self, other: Record) -> None:
        self.count += other.count
        self.numbers.extend(other.numbers)
        if other.best is not None and (self.best is None or (other.best, -other.at) > (self.best, -self.at)):
            self.best, self.at, self.rest = other.best, other.at, other.rest


class Table:
    """Open addressing with linear probing; whatever the hashes say, texts are compared in full."""

    def __init__(self) -> None:
        self.mask, self.slots, self.records, self.held = 1023, [-1] * 1024, [], 0

    def add(self, r: Record) -> None:
        k = r.hash & self.mask
        while (e := self.slots[k]) >= 0:
            if (known := self.records[e]).hash == r.hash and known.text == r.text:
                known.merge(r)
                self.held += 8 * len(r.numbers)
                return
            k = (k + 1) & self.mask
        self.slots[k] = len(self.records)
        self.records.append(r)
        self.held += len(r.text) + 300
        if 2 * len(self.records) > self.mask:
            self.mask = 2 * self.mask + 1
            self.slots = [-1] * (self.mask + 1)
            for e, known in enumerate(self.records):
                k = known.hash & self.mask
                while self.slots[k] >= 0:
                    k = (k + 1) & self.mask
                self.slots[k] = e


def grace(records: Iterable[Record], folder: str, most: int, depth: int = 0) -> Iterator[list[Record]]:
    """The merged records, a bucket at a time."""
    table, shift, files = Table(), 64 - FAN_BITS * (depth + 1), []
    for r in records:
        if files:
            pickle.dump(r.values(), files[r.hash >> shift & (1 << FAN_BITS) - 1])
            continue
        table.add(r)
        # records whose hashes are equal in all bits can't be told apart by partitioning
        if table.held > most and len(table.records) > 1 and shift >= 0:
            files = [open(os.path.join(folder, f"{depth}-{k}"), "wb") for k in range(1 << FAN_BITS)]  # noqa: SIM115
            for known in table.records:
                pickle.dump(known.values(), files[known.hash >> shift & (1 << FAN_BITS) - 1])
            table = Table()
    if not files:
        yield table.records
    for f in files:
        f.close()
    for f in files:
        yield from grace(_spilled(f.name), folder, most, depth + 1)
        os.remove(f.name)


def _spill_folder() -> str:
    """A folder of this task's own, on the disks that the executor spills to."""
    places = [p for p in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(p)]
    return tempfile.mkdtemp(prefix="grace-", dir=random.choice(places) if places else None)


def _spilled(path: str) -> Iterator[Record]:
    moved = f"{path}+"  # its name is free for the files of the next step
    os.rename(path, moved)
    with open(moved, "rb") as f:
        while f.peek(1):
            yield Record(*pickle.load(f))  # noqa: S301  this task's own file
    os.rename(moved, path)


LOCAL = T.StructType(
    [
        T.StructField("number", T.LongType(), False),
        T.StructField("id", T.LongType()),
        T.StructField("of", T.LongType()),
        T.StructField("hash", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("count", T.LongType()),
        T.StructField("best", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("rest", T.BinaryType()),
    ]
)


def _local(docs: DataFrame, doc_id: str, text: str, most: int, *, members: bool, rest: bool) -> DataFrame:
    """The records of each partition (content set), and where asked for, its rows with the number of their record."""
    others = [c for c in docs.columns if c != text] if rest else []
    arrow = to_arrow_schema(LOCAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []

        def read() -> Iterator[Record]:
            for whole in batches:
                for batch in slices(whole):
                    texts = batch.column(1).cast(pa.binary()).to_pylist()
                    rows = zip(*[batch.column(2 + k).to_pylist() for k in range(len(others))]) if others else [None] * len(texts)
                    for i, t, row in zip(batch.column(0).to_pylist(), texts, rows):
                        number = first + len(ids)
                        ids.append(i if members else None)
                        yield Record(xxhash.xxh3_64_intdigest(t), t, 1, i, number, [number], pickle.dumps(row) if others else None)

        record_of: dict[int, int] = {}
        folder = _spill_folder()
        try:
            for bucket in grace(read(), folder, most):
                for k in range(0, len(bucket), 256):
                    part = bucket[k : k + 256]
                    columns = [
                        [r.numbers[0] for r in part], [None] * len(part), [None] * len(part), [r.hash - (r.hash >> 63 << 64) for r in part],
                        [r.text for r in part], [r.count for r in part], [r.best for r in part], [r.at for r in part], [r.rest for r in part],
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)
                if members:
                    record_of.update((n, r.numbers[0]) for r in bucket if len(r.numbers) > 1 for n in r.numbers)
        finally:
            shutil.rmtree(folder, ignore_errors=True)
        for k in range(0, len(ids) if members else 0, 10_000):
            part = ids[k : k + 10_000]
            numbers = [first + k + i for i in range(len(part))]
            columns = [numbers, part, [record_of.get(n, n) for n in numbers]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns + [[None] * len(part)] * 6, arrow.types)], schema=arrow)

    return docs.select(docs[doc_id].cast("long"), text_of(text), *[docs[f"`{c}`"] for c in others]).toDF("id", "content", *[f"c{k}" for k in range(len(others))]).mapInArrow(run, LOCAL)


def _merged(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[list[Record]]:
    """The groups of a reducer's records."""

    def read() -> Iterator[Record]:
        for whole in rows:
            for batch in slices(whole):
                for number, h, content, count, best, at, rest in zip(*[c.to_pylist() for c in batch.columns]):
                    yield Record(h & (1 << 64) - 1, content, count, best, at, [number], rest)

    folder = _spill_folder()
    try:
        yield from grace(read(), folder, most)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _dealt(local: DataFrame) -> DataFrame:
    n = shuffle_partitions(local.sparkSession)
    return local.select("number", "hash", "content", "count", "best", "at", "rest").repartition(n, "hash")


def decisions(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """For each row: doc_id, keep_id (id of the row that stays), group_size, kept, text_sha256 (of the UTF-8 text)."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("of", T.LongType()), ("keep_id", T.LongType()), ("group_size", T.LongType()), ("stays", T.LongType()), ("text_sha256", T.StringType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _merged(batches, table_bytes):
            for k in range(0, len(bucket), 1000):
                rows = [(n, r.best, r.count, r.at, sha) for r in bucket[k : k + 1000] for sha in [hashlib.sha256(r.text).hexdigest()] for n in r.numbers]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    local = written(_local(docs, doc_id, text, table_bytes, members=True, rest=False), "exact-local")
    records = local.where(F.col("content").isNotNull())
    groups = _dealt(records).mapInArrow(run, schema)
    rows = local.where(F.col("content").isNull()).select("number", "id", "of")
    return rows.join(groups, "of").select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("number") == F.col("stays")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with all columns; each was shuffled with its text at most once."""
    schema = T.StructType(docs.schema.fields)
    arrow = to_arrow_schema(schema)
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _merged(batches, table_bytes):
            for k in range(0, len(bucket), 256):
                rows = [dict(zip(others, pickle.loads(r.rest))) | {text: r.text.decode()} for r in bucket[k : k + 256]]  # noqa: S301  this job's own rows
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    return _dealt(_local(docs, doc_id, text, table_bytes, members=False, rest=True)).mapInArrow(run, schema)

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the ASCII blanks (space, tab to carriage return). bytes.split() gives the same words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@functools.cache
def _local_folder() -> str:
    """This process's folder for a local master whose session names none (the setting can't be changed in a running one)."""
    return tempfile.mkdtemp(prefix="saltmarsh-")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir).

    Where the setting is missing, a local master gets a temporary folder; any other master is an error,
    since executors on other machines couldn't read each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and a lost executor costs no rework."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forgotten(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written in decimal (null counts as the empty string)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch, rows: int = 256):
    """An Arrow batch in short pieces, so that what a piece makes stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def contents(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow column of texts; null is empty."""
    return [t or b"" for t in column.cast("binary").to_pylist()]

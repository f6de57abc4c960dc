"""Document fingerprints: SimHash over weighted terms, and a search within a Hamming radius by permuted block tables.

A document's terms are its pairs of neighbouring words (its one word, if it has no more). A term's 64-bit hash votes with the
weight of its frequency: for each bit, +1 for a one and -1 for a zero, each time it occurs. The fingerprint holds the
signs; a tie is 0. Votes are counted side by side in the bytes of longs, 127 terms at a time, so a text of any
length is one array expression without a shuffle.

For the search the 64 bits are cut into `radius + 3` blocks. Fingerprints within the radius agree in at least three whole
blocks; there is a table for each choice of three, keyed by those bits moved to the front. A pair that meets in several tables
counts in the first of them only. Only DataFrame operations are used.

Defined cases: a null text is empty; a text without words has fingerprint zero. Equal texts have equal fingerprints, rows
alike are found as often as they occur. Ids are taken as integers; what isn't one counts as null. Texts are read whole, of any length. An empty table gives an empty result. Columns of docs other than a replaced
one pass through.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from saltmarsh.llm.common import shuffle_partitions, text_of, written

BLANKS = r"[\x20\x09-\x0D]+"
RADIUS = 3
#: A one in each byte, and the terms that a byte can count without reaching the sign of the long.
ONES, FULL = 0x0101010101010101, 127


def terms(text: Column) -> Column:
    """Hashes of the terms of a text."""
    words = F.transform(F.array_remove(F.split(text, BLANKS), ""), lambda w: F.xxhash64(w))

    def pairs(hashes: Column) -> Column:
        n = F.size(hashes)
        return F.when(n < 2, hashes).otherwise(F.zip_with(F.slice(hashes, 1, n - 1), F.slice(hashes, 2, n - 1), lambda a, b: F.xxhash64(a, b)))

    # transform() of an array of one holds the hashes for the uses below
    return F.element_at(F.transform(F.array(words), pairs), 1)


def votes_to_bits(hashes: Column) -> Column:
    """The fingerprint of an array of hashes."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(8)])

    def add(sums: Column, h: Column) -> Column:
        return F.struct(*[(sums[f"c{k}"] + (F.shiftrightunsigned(h, k) if k else h).bitwiseAND(F.lit(ONES))).alias(f"c{k}") for k in range(8)])

    def signs(packed: Column) -> Column:
        """packed: (array of hashes, array of counts of 127 terms each). A count's byte j of c{k} is that of bit 8j + k."""
        total, out = F.size(packed["hashes"]), F.lit(0).cast("long")
        for bit in range(64):
            k, j = bit % 8, bit // 8
            ones = F.aggregate(packed["counts"], F.lit(0).cast("long"), lambda s, c: s + F.shiftrightunsigned(c[f"c{k}"], 8 * j).bitwiseAND(F.lit(255).cast("long")))  # noqa: B023
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out + F.when(2 * ones > total, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long"))
        return out

    def counts(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h), F.lit(1)), F.lit(FULL))
        return F.struct(h.alias("hashes"), F.transform(starts, lambda s: F.aggregate(F.slice(h, s, FULL), zero, add)).alias("counts"))

    return F.element_at(F.transform(F.transform(F.array(hashes), counts), signs), 1)


def fingerprint(text: Column) -> Column:
    return votes_to_bits(terms(F.coalesce(text, F.lit(""))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return (64 - F.bit_count(a.bitwiseXOR(b))) / F.lit(64.0)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def with_fingerprints(docs: DataFrame, *, text: str = "text", into: str = "fingerprint") -> DataFrame:
    return docs.withColumn(into, fingerprint(F.col(text)))


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (q, fp, bits) of distinct fingerprints of queries (q) and prints (fp) that differ in `radius` bits at most."""
    blocks = radius + 3
    edges = [64 * k // blocks for k in range(blocks + 1)]
    chosen = list(combinations(range(blocks), 3))
    bits = lambda b: ((1 << edges[b + 1]) - 1) & ~((1 << edges[b]) - 1)
    masks = [sum(map(bits, t)) for t in chosen]
    masks = [m - (m >> 63 << 64) for m in masks]

    def entries(df: DataFrame, name: str) -> DataFrame:
        tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col(name).bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(masks)])
        return df.select(name).distinct().select(name, F.explode(tables).alias("at")).select(name, "at.t", "at.key")

    a, b = entries(queries, "q"), entries(prints, "fp")
    differ = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(k)) for k, m in enumerate(masks)])
    met = a.join(b, (a["t"] == b["t"]) & (a["key"] == b["key"]) & (F.bit_count(differ) <= radius) & (first == a["t"]))
    return met.select("q", "fp", F.bit_count(differ).alias("bits"))


#: Rows of a range that is sorted by one task, about; what is drawn for each of them to set its bounds.
ROWS_A_RANGE, DRAWN = 4_000, 12
#: Letters by which rows of equal ids are put into ranges; within one, whole texts are compared.
CUT = 64


def _place(key: Column, tie: Column, splits: Column, n: int) -> Column:
    """Number of the last of n ordered splits (key, tie) that isn't above the pair, by halves."""
    above = lambda s: (key < s["key"]) | ((key == s["key"]) & (tie < s["tie"]))
    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        down = above(F.get(splits, mid))
        low, high = F.when(down, s["low"]).otherwise(mid), F.when(down, mid).otherwise(s["high"])
        return F.when(s["high"] - s["low"] > 1, F.struct(low.alias("low"), high.alias("high"))).otherwise(s)

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), halve, lambda s: s["low"])


def with_next(docs: DataFrame, values: list[str], *, order: str, ties: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Adds next_<value>: the values of the next row in the order of an integer column (null first; equal ones by the string column
    `ties`); after the last, of the first.

    Ranges of some rows each are sorted apart; an id, or null, that many rows share is cut by the beginnings of `ties`. Bounds are pairs that
    occur, drawn by hash, some for each range, so a range's first rows are known beforehand, and a copy of them is
    dealt to the range before as well. The rows cross the network once; a range is a task.
    """
    key = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)).cast("long"))
    tie = F.coalesce(F.substring(ties, 1, CUT), F.lit(""))
    keys = docs.select(key.alias("key"), tie.alias("tie"))
    rows = keys.count()
    ranges = max(1, -(-rows // rows_a_range))
    every = max(1, rows // (ranges * DRAWN))
    drawn = sorted({(r.key, r.tie) for r in keys.where(F.pmod(F.xxhash64("key", "tie"), F.lit(every)) == 0).collect()}) if ranges > 1 else []  # DRAWN for each range, about
    first = keys.orderBy("key", "tie").limit(1).collect()  # a row, so that the first range begins with one
    splits = sorted({*((r.key, r.tie) for r in first), *(drawn[k] for k in range(len(drawn) // ranges, len(drawn), max(1, -(-len(drawn) // ranges))))})
    n = len(splits)
    if not n:
        return docs.withColumns({f"next_{v}": F.col(v) for v in values})
    # one literal, whatever its length, and not an expression for each split
    listed = F.from_json(F.lit(json.dumps([{"key": a, "tie": b} for a, b in splits])), "array<struct<key:long,tie:string>>")
    rows = docs.withColumns({"__key": key, "__tie": tie}).withColumn("__in", _place(F.col("__key"), F.col("__tie"), listed, n))
    own = F.struct(F.col("__in").alias("range"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("__in") - 1, F.lit(n)).alias("range"), F.lit(True).alias("guest"))
    at = F.get(listed, F.col("__in"))
    begins = (at["key"] == F.col("__key")) & (at["tie"] == F.col("__tie"))
    rows = rows.withColumn("__to", F.explode(F.when(begins, F.array(own, before)).otherwise(F.array(own)))).withColumn("__range", F.col("__to.range"))
    rows = rows.repartition(max(n, shuffle_partitions(docs.sparkSession)), "__range")
    w = W.partitionBy("__range").orderBy("__to.guest", "__key", ties)
    rows = rows.withColumns({f"next_{v}": F.lead(v).over(w) for v in values}).where("not __to.guest")
    return rows.drop("__key", "__tie", "__in", "__to", "__range")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as many first code points of the following text, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def against_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, every: int = 50) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and for ids divisible by
    `every` n_near: the rows, itself included, whose fingerprint is within the radius."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).withColumn("fp", fingerprint(F.col("text")))
    rows = with_next(rows, ["text", "fp"], order="doc_id", ties="text")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp", edited(F.col("text"), F.col("next_text")).alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", fingerprint(F.col("edited")).alias("edited_fp"), "next_fp")
    rows = written(rows, "fingerprints")
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    counts = rows.groupBy("fp").agg(F.count("*").alias("n"))
    near = within(rows.where(asked).select(F.col("fp").alias("q")), counts, radius).join(counts, "fp").groupBy("q").agg(F.sum("n").alias("n_near"))
    found = rows.where(asked).join(near, F.col("fp") == F.col("q"), "left").drop("q")
    whole = found.unionByName(rows.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
    return whole.select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near",
    )

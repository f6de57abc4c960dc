"""URL filter: rules first; for the other URLs, a blocked Bloom filter of a list and an exact join behind it.

The filter is a table with one row for each block: its number and 64 bits. A URL's hash gives the block and a few bits in it. URLs
with all bits set are possible hits; only these meet the list itself, in a hash join on the canonical URL that removes
false positives. The filter has a few bits for each listed URL; it is broadcast while its size is under a bound, and
beyond that joined by its block number. Only DataFrame operations are used.

Defined cases: a null URL, or one without "://", has an empty host, path and canonical form; no rule fits it and it is
never listed, so it is allowed. Rows are judged one by one, repeated ones alike. Null or empty URLs in the list are ignored; an empty list
blocks nothing. URLs of any length are read whole; columns of pages named host, path, rule or verdict are replaced. Host, path and rules are compared as they are: a port belongs to the host, an empty path has no "/".
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each listed URL, and the bits that a URL sets in its block.
BITS_PER_URL, BITS_SET = 12, 4
#: The filter is broadcast up to this size (two longs for each block).
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host, path without trailing slashes, and the query without campaign parameters; neither scheme nor fragment."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)(utm_[a-z]+|ref)=[^&]*", ""), "^&+", "")
    address = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(query != "", F.concat(address, F.lit("?"), query)).otherwise(address)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, by its name; null where none does."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.name)).otherwise(found)
    return found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long"))


def _bits(url: Column) -> Column:
    h, out = F.xxhash64(F.lit("bits"), url), F.lit(0).cast("long")
    for k in range(BITS_SET):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return out


def judged(pages: DataFrame, listed: DataFrame, rules: list[Rule], *, url: str = "url", list_url: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds host, path, rule (or null) and verdict: the rule's, else block for URLs whose canonical form is listed, else allow."""
    names = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in names]
    u = pages[url]
    rows = pages.select(*[pages[f"`{c}`"] for c in kept], host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("__url"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))

    members = listed.select(canonical(listed[list_url]).alias("__member")).where("__member <> ''").distinct()
    blocks = max(1, math.ceil(members.count() * BITS_PER_URL / 64))
    bloom = members.groupBy(_block(F.col("__member"), blocks).alias("__block")).agg(F.bit_or(_bits(F.col("__member"))).alias("__bits"))
    if 16 * blocks <= broadcast_bytes:
        bloom = F.broadcast(bloom)

    verdict = F.lit(None).cast("string")
    for r in rules:
        verdict = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(verdict)
    rows = rows.withColumn("verdict", verdict)
    out = [*[F.col(f"`{c}`") for c in kept], *names]
    # what a rule settles, or what has no canonical form, is in no list and isn't looked for
    open_ = F.col("rule").isNull() & (F.col("__url") != "")
    settled = rows.where(~open_).withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).select(*out)
    probed = rows.where(open_).withColumn("__block", _block(F.col("__url"), blocks)).withColumn("__mask", _bits(F.col("__url"))).join(bloom, "__block", "left")
    possible = F.coalesce(F.col("__bits"), F.lit(0).cast("long")).bitwiseAND(F.col("__mask")) == F.col("__mask")
    hits = probed.where(possible).join(members.withColumn("__listed", F.lit(True)), F.col("__url") == F.col("__member"), "left")
    hits = hits.withColumn("verdict", F.when(F.col("__listed"), "block").otherwise("allow")).select(*out)
    others = probed.where(~possible).withColumn("verdict", F.lit("allow")).select(*out)
    return settled.unionByName(hits).unionByName(others)

"""Text views of a message: compatibility form, confusables folded, leet undone, noise digits removed. Only the compatibility form needs Python."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.spans import cut
from saltmarsh.lexicons import CONFUSABLES, LEET

# Invisible characters, and the zeros of the scripts whose digits are folded.
INVISIBLE = r"[​-‏﻿⁠­᠎‪-‮⁦-⁩]"
ZEROS = [0x0660, 0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0xFF10]

DIGITS_FROM, DIGITS_TO = "".join(chr(z + k) for z in ZEROS for k in range(10)), "0123456789" * len(ZEROS)
SINGLE = {k: v for k, v in CONFUSABLES.items() if len(v) == 1}
DOUBLE = {k: v for k, v in CONFUSABLES.items() if len(v) == 2}


def escaped(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in chars)


SEEN = "form string, starts array<int>, ends array<int>, nfkc_starts array<int>, nfkc_ends array<int>"
_HIDDEN = re.compile(INVISIBLE)


def _pieces(text: str) -> list[tuple[int, int, str]]:
    """The text cut before each character that doesn't combine with what is before it, and the compatibility form of each piece."""
    cuts = [k for k, c in enumerate(text) if k == 0 or not (unicodedata.combining(c) or 0x1160 <= ord(c) <= 0x11FF)] + [len(text)]
    pieces = [(a, b, unicodedata.normalize("NFKC", text[a:b])) for a, b in zip(cuts, cuts[1:])]
    whole = unicodedata.normalize("NFKC", text)
    return pieces if "".join(p for *_, p in pieces) == whole else [(0, len(text), whole)]


def seen(text: str | None) -> tuple:
    """The compatibility form, and for each character of the folded and the visible view where what it was made of begins and ends; null
    where that is its own place throughout."""
    if text is None:
        return None, None, None, None, None
    pieces = _pieces(text)
    visible_, folded_ = [], []
    for a, b, p in pieces:
        for c in p:
            if not _HIDDEN.match(c):
                visible_.append((a, b))
                folded_ += [(a, b)] * len(CONFUSABLES.get(c, c).lower())
    if folded_ == visible_ and all(x == (k, k + 1) for k, x in enumerate(folded_)) and len(folded_) == len(text):
        return "".join(p for *_, p in pieces), None, None, None, None
    return "".join(p for *_, p in pieces), [a for a, _ in folded_], [b for _, b in folded_], [a for a, _ in visible_], [b for _, b in visible_]


def nfkc_seen(text: Column) -> Column:
    """The compatibility form with places, as seen() gives them. Rows of ASCII alone reach the Python worker as null and come back as null."""

    @F.arrow_udf(SEEN)
    def form(s: pa.Array) -> pa.Array:
        rows = [seen(t) for t in s.to_pylist()]
        names = ("form", "starts", "ends", "nfkc_starts", "nfkc_ends")
        return pa.StructArray.from_arrays([pa.array(c, pa.string() if n == "form" else pa.list_(pa.int32())) for n, c in zip(names, zip(*rows) if rows else [()] * len(names))], names)

    return form(F.when(text.rlike(r"[^\x00-\x7F]"), text))


def nfkc(text: Column) -> Column:
    """Compatibility form."""
    return F.coalesce(nfkc_seen(text)["form"], text)


def visible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def folded(text: Column) -> Column:
    out = F.translate(text, DIGITS_FROM + "".join(SINGLE), DIGITS_TO + "".join(SINGLE.values()))
    for k, v in DOUBLE.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.lower(out)


def confusables(text: Column, compat: bool = False) -> Column:
    """Characters that folding changes, blanks and those that become separators aside; compat counts a plain @ as well."""
    counted = DIGITS_FROM + "".join(k for k, v in CONFUSABLES.items() if k.strip() and v not in "-._ " and (compat or k != v))
    # translate() looks characters up; a class of so many in a pattern is tried one by one
    return F.length(text) - F.length(F.translate(text, counted, ""))


def _deleet_token(token: Column) -> Column:
    letters = F.regexp_count(token, F.lit(r"\p{L}"))
    leet = F.regexp_count(token, F.lit(f"[{escaped(''.join(LEET))}]"))
    return (letters > 0) & (letters >= leet)


def deleet(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit(r"\S+|\s+"), F.lit(0))
    changed = F.array_join(F.transform(parts, lambda t: F.when(_deleet_token(t), F.translate(t, "".join(LEET), "".join(LEET.values()))).otherwise(t)), "")
    return F.when(text.rlike(f"[{escaped(''.join(LEET))}]"), changed).otherwise(text)


def leet_count(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    n = F.transform(tokens, lambda t: F.when(_deleet_token(t), F.regexp_count(t, F.lit(f"[{escaped(''.join(LEET))}]"))).otherwise(0))
    return F.when(text.rlike(f"[{escaped(''.join(LEET))}]"), F.aggregate(n, F.lit(0), lambda a, b: a + b)).otherwise(F.when(text.isNotNull(), 0))


NOISE = r"(?<=\p{L})[0-9]{1,3}(?=\p{L})"


def denoised(text: Column) -> Column:
    """Without runs of up to three digits between letters."""
    return F.regexp_replace(text, NOISE, "")


def denoised_offsets(text: Column) -> Column:
    """For each character of the denoised view, its place in the text."""
    pieces = cut(text, NOISE)
    noise = F.regexp_extract_all(text, F.lit(NOISE), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    pairs = F.zip_with(pieces, noise, lambda p, n: F.struct(F.length(p).alias("p"), F.coalesce(F.length(n), F.lit(0)).alias("n")))

    def step(s: Column, x: Column) -> Column:
        places = F.when(x["p"] > 0, F.sequence(s["at"], s["at"] + x["p"] - 1)).otherwise(F.array().cast("array<int>"))
        return F.struct((s["at"] + x["p"] + x["n"]).alias("at"), F.concat(s["out"], places).alias("out"))

    return F.aggregate(pairs, zero, step, lambda s: s["out"])


def with_views(df: DataFrame, text: str = "text", *, compat: bool = False, ascii_only: bool = False) -> DataFrame:
    """Adds nfkc, folded, deleet, denoised, the counters zero_width, confusables, leet and noise, and places: raw_at (as nfkc_seen() gives it)
    and noise_at (of the denoised view's characters in the folded one; null without noise). ascii_only leaves out the
    Python step, for texts that are known to be in compatibility form."""
    source = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("raw_at", F.lit(None).cast(f"struct<{SEEN.replace(' ', ':').replace(',:', ',')}>") if ascii_only else nfkc_seen(source))
    df = df.withColumn("nfkc_raw", F.coalesce(F.col("raw_at.form"), source))
    df = df.withColumn("nfkc", visible(F.col("nfkc_raw"))).withColumn("zero_width", F.length("nfkc_raw") - F.length("nfkc"))
    df = df.withColumns({"folded": folded(F.col("nfkc")), "confusables": confusables(F.col("nfkc"), compat)})
    df = df.withColumns({"deleet": deleet(F.col("folded")), "leet": leet_count(F.col("folded")), "denoised": denoised(F.col("folded"))})
    df = df.withColumn("noise", F.length("folded") - F.length("denoised"))
    return df.withColumn("noise_at", F.when(F.col("noise") > 0, denoised_offsets(F.col("folded")))).drop("nfkc_raw")


def raw_place(run: Column) -> Column:
    """Start and end in the text of a span of the denoised view; rows have raw_at and noise_at."""
    start, end = F.get("noise_at", run["start"]), F.get("noise_at", run["end"] - 1) + 1
    start, end = (F.when(F.col("noise_at").isNull(), run[k]).otherwise(v) for k, v in (("start", start), ("end", end)))
    starts, ends = F.col("raw_at.starts"), F.col("raw_at.ends")
    return F.struct(F.when(starts.isNull(), start).otherwise(F.get(starts, start)).alias("start"), F.when(starts.isNull(), end).otherwise(F.get(ends, end - 1)).alias("end"))

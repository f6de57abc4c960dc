"""Secret scans: patterns, and a battery of randomness tests for strings that no pattern names.

Base spans are the matches of three patterns. Further candidates are runs of 20 or more characters of the usual encodings. The
narrowest encoding that explains a candidate gives its alphabet; over it three tests ask whether the characters look
drawn at random: chi-squared uniformity, runs above and below the middle of the alphabet, and serial correlation. A candidate that
one of them refutes (Bonferroni) is dropped. The others still have to be told from ordinary text: names, slugs and paths
are modelled as a chain of kinds of characters (small and capital letters, digits, marks) with the letters of prose, and the
likelihood of the inferred alphabet drawn evenly, over that of text, is under text larger than x with a chance of 1/x at most
(Markov's inequality), which is the p-value. Digits alone look the same either way. False discoveries are held
under `fdr` by Benjamini and Hochberg's rule within each inferred encoding and band of length, over the candidates of all documents, so
that a source full of slugs doesn't hide keys of other kinds; p-values are
counted on a grid of tenths of a decade, so that a bounded number of counts, and no candidate, reaches the driver. Only DataFrame
operations are used.

Defined cases: a null text is empty and has no spans. Documents are scanned whole, repeated rows alike. Candidates that
overlap a base span add nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import text_of, written

#: The base patterns. Kind, pattern, the group whose length counts, its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24)]
#: Strings that the tests look at, and the encodings they may be of: pattern and alphabet, the narrowest first.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = [
    ("^[0-9]+$", DIGITS),
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[a-z0-9]+$", LOWER + DIGITS),
    ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("", UPPER + LOWER + DIGITS + "+/"),
]
#: Bands of length for the false-discovery control: their first lengths.
BANDS = [20, 24, 32, 48, 96]
#: Characters of text by kind, and their shares: per mille of the letters of English prose, a tenth of them spread evenly.
MARKS = "_-/+"
SYMBOLS = LOWER + UPPER + DIGITS + MARKS
LETTERS = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]
WITHIN = [0.9 * n / sum(LETTERS) + 0.1 / 26 for n in LETTERS] * 2 + [0.1] * 10 + [0.35, 0.35, 0.25, 0.05]
#: Chances of the next character's kind after each kind: small, capital, digit, mark.
NEXT = [[0.84, 0.04, 0.03, 0.09], [0.35, 0.53, 0.04, 0.08], [0.08, 0.04, 0.75, 0.13], [0.60, 0.16, 0.20, 0.04]]
FDR, REFUTED = 0.01, 0.001
#: The grid of p-values ends at 10 ** -(LEVELS / 10).
LEVELS = 300


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str) -> Column:
    """The leftmost matches that don't overlap: array of (start, end, match), in code points."""
    p = F.lit(pattern)

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + x["gap"]
            end = start + F.length(x["match"])
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("out"))

        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        none = F.array().cast("array<struct<start:int,end:int,match:string>>")
        return F.when(F.size(found) == 0, none).otherwise(F.aggregate(pairs, zero, step, lambda s: s["out"]))

    return _let(F.regexp_extract_all(text, p, F.lit(0)), place)


def base_spans(text: Column) -> Column:
    """Array of (start, place of the kind, end, kind), sorted."""
    return F.array_sort(F.concat(*[_kept(text, k) for k in range(len(BASE))]))


def _kept(text: Column, k: int) -> Column:
    kind, pattern, group, least = BASE[k]
    spans = F.filter(located(text, pattern), lambda m: F.length(F.regexp_extract(m["match"], pattern, group)) >= least)
    return F.transform(spans, lambda m: F.struct(m["start"], F.lit(k).alias("rank"), m["end"], F.lit(kind).alias("kind")))


def normal_tail(z: Column) -> Column:
    """Chance of more than z (0 or greater) under the standard normal distribution: the usual rational approximation, good to 1e-7 of 1, and beyond 5 its leading term."""
    t = 1 / (1 + F.lit(0.2316419) * z)
    # Coefficients of that approximation.
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * 1.330274429))))
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(z > 5, density / z).otherwise(density * poly)


def _tail(z: Column) -> Column:
    """Upper tail for any z."""
    return F.when(z >= 0, normal_tail(F.least(z, F.lit(37.0)))).otherwise(1 - normal_tail(F.least(-z, F.lit(37.0))))


def text_likelihood(chars: Column) -> Column:
    """Decimal logarithm of the chance that text has these characters, in this order."""
    within = F.array(*[F.lit(math.log10(p)) for p in WITHIN])
    following = F.array(*[F.lit(math.log10(p)) for row in NEXT for p in row])
    kind = lambda i: F.when(i <= 26, 0).when(i <= 52, 1).when(i <= 62, 2).otherwise(3)
    zero = F.struct(F.lit(-1).alias("kind"), F.lit(math.log10(1 / 4)).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        moved = F.when(s["kind"] < 0, F.lit(0.0)).otherwise(F.element_at(following, s["kind"] * 4 + kind(i) + 1))
        return F.struct(kind(i).alias("kind"), (s["sum"] + moved + F.element_at(within, i)).alias("sum"))

    places = F.transform(chars, lambda c: F.call_function("instr", F.lit(SYMBOLS), c))
    return F.aggregate(places, zero, step, lambda s: s["sum"])


def tested(match: Column) -> Column:
    """(random, level, encoding): whether no test refutes randomness, the p-value of text as tenths of a decade, and the number of the encoding."""
    body = F.regexp_replace(match, "=+$", "")
    encoding = F.lit(len(ENCODINGS) - 1)
    for k, (pattern, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        encoding = F.when(body.rlike(pattern), F.lit(k)).otherwise(encoding)
    alphabets = F.array(*[F.lit(letters) for _, letters in ENCODINGS])

    def stats(x: Column) -> Column:
        chars, letters = x["chars"], x["letters"]
        index = F.transform(chars, lambda c: F.call_function("instr", letters, c).cast("double"))
        squares = F.aggregate(
            F.array_distinct(chars), F.lit(0.0), lambda t, c: t + F.pow(F.length(x["s"]) - F.length(F.call_function("replace", x["s"], c, F.lit(""))), F.lit(2.0))
        )
        return F.struct(F.length(x["s"]).cast("double").alias("n"), F.length(letters).cast("double").alias("k"), squares.alias("squares"), index.alias("x"), text_likelihood(chars).alias("text"))

    def moments(s: Column) -> Column:
        x = s["x"]
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
        following = F.concat(F.slice(x, F.lit(2), F.size(x) - 1), F.slice(x, F.lit(1), F.lit(1)))
        upper = F.transform(x, lambda v: F.when(v > s["k"] / 2, F.lit(1.0)).otherwise(F.lit(0.0)))
        turns = F.zip_with(F.slice(upper, F.lit(2), F.size(x) - 1), F.slice(upper, F.lit(1), F.size(x) - 1), lambda a, b: F.abs(a - b))
        return F.struct(
            s["n"].alias("n"), s["k"].alias("k"), s["squares"].alias("squares"), s["text"].alias("text"), total(x).alias("sum"), total(F.transform(x, lambda v: v * v)).alias("sum2"),
            total(F.zip_with(x, following, lambda a, b: a * b)).alias("lagged"), total(upper).alias("upper"), (total(turns) + 1).alias("runs"),
        )

    def decide(m: Column) -> Column:
        n, k = m["n"], m["k"]
        chi = k / n * m["squares"] - n
        p_even = _tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
        expected = 2 * m["upper"] * (n - m["upper"]) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        p_runs = F.when(spread > 0, F.least(F.lit(1.0), 2 * normal_tail(F.least(F.abs(m["runs"] - expected) / F.sqrt(F.greatest(spread, F.lit(1e-9))), F.lit(37.0))))).otherwise(0.0)
        below = n * m["sum2"] - m["sum"] * m["sum"]
        correlation = (n * m["lagged"] - m["sum"] * m["sum"]) / F.greatest(below, F.lit(1e-9))
        z = F.abs(correlation + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n
        p_serial = F.when(below > 0, F.least(F.lit(1.0), 2 * normal_tail(F.least(z, F.lit(37.0))))).otherwise(0.0)
        level = F.least(F.lit(LEVELS), F.floor((-n * F.log10(k) - m["text"]) * 10)).cast("int")
        return F.struct((3 * F.least(p_even, p_runs, p_serial) >= REFUTED).alias("random"), F.greatest(F.lit(0), level).alias("level"))

    def told(k: Column) -> Column:
        x = F.struct(body.alias("s"), F.element_at(alphabets, k + 1).alias("letters"), F.split(body, "").alias("chars"))
        return _let(_let(_let(x, stats), moments), lambda m: decide(m).withField("encoding", k))

    return _let(encoding, told)


def candidates(text: Column, base: Column) -> Column:
    """Array of (start, end, band, level, random) of the strings that overlap no base span."""
    longer = lambda m: sum((F.when(m["end"] - m["start"] >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))
    free = F.filter(located(text, CANDIDATE), lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return F.transform(free, lambda m: _let(tested(m["match"]), lambda t: F.struct(m["start"], m["end"], (t["encoding"] * len(BANDS) + longer(m)).alias("band"), t["level"], t["random"])))


def discoveries(counts: dict[tuple[int, int], int], fdr: float) -> list[int]:
    """For each encoding and band of length the least level that is a discovery, by counts of (band, level)."""
    least = []
    for band in range(len(ENCODINGS) * len(BANDS)):
        total, reached, found = sum(n for (b, _), n in counts.items() if b == band), 0, LEVELS + 1
        for level in range(LEVELS, -1, -1):
            reached += counts.get((band, level), 0)
            if reached and total * 10 ** (-level / 10) <= fdr * reached:
                found = level
        least.append(found)
    return least


def scanned(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """For each row: the id and spans, an array of (start, rank, end, kind) sorted by start; kind random has the battery's."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).withColumn("base", base_spans(F.col("text")))
    rows = written(rows.select("doc_id", "base", candidates(F.col("text"), F.col("base")).alias("more")), "secrets")
    grid = rows.select(F.explode("more").alias("m")).groupBy("m.band", "m.level").count()
    least = discoveries({(r.band, r.level): r["count"] for r in grid.collect()}, fdr)  # a row for each band and level at most
    bound = F.array(*map(F.lit, least))
    chosen = F.filter("more", lambda m: m["random"] & (m["level"] >= F.element_at(bound, m["band"] + 1)))
    added = F.transform(chosen, lambda m: F.struct(m["start"], F.lit(len(BASE)).alias("rank"), m["end"], F.lit("random").alias("kind")))
    return rows.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

"""Digit runs: numerals and number words, next to each other, as one string of digits with its place and shape.

A text is cut into tokens; each becomes chunks of digits, or a break. Whether a chunk takes part hangs on its neighbours, and a multiplier
on the token before, so this is a small machine over tokens. It runs in Arrow batches over the texts that have a digit or the letters
of a number word; all other rows reach the worker as null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions.spans import empty
from saltmarsh.lexicons import AMBIGUOUS_WORDS, HIGH_RISK_AMBIGUOUS, MULTIPLIERS, NUM_WORDS

SEP = r" \t\n\r\f\v_\-.,;:"
#: start and end are places in the text that runs are looked for in; raw_start and raw_end those in the message (see placed()).
RUN = "array<struct<digits:string,start:int,end:int,word_n:int,num_n:int,seps:array<string>,mixed:boolean,raw_start:int,raw_end:int>>"
# Names of separators, in the order in which they are looked for.
SEPARATORS = [(" \t\n\r\f\v", "space"), ("-", "dash"), (".", "dot"), ("_", "underscore"), (",", "comma"), (":", "colon"), (";", "semicolon")]
PIECE = re.compile(rf"([{SEP}]*)([^{SEP}]+)")
NUMERAL, GLUED = re.compile("[0-9]+"), re.compile("(?:[a-z]+[0-9]+|[0-9]+[a-z]+)")
AMBIGUOUS, RISKY = frozenset(AMBIGUOUS_WORDS), frozenset(HIGH_RISK_AMBIGUOUS)
#: Texts that can have a run at all.
LIKELY = "[0-9]|" + "|".join(dict.fromkeys(NUM_WORDS))


class Chunk(NamedTuple):
    """Digits of a token, or a break if it has none; the word that they are read from, if any, and whether a multiplier repeats them."""

    digits: str | None
    start: int
    end: int
    sep: str
    word: str | None = None
    many: bool = False

    @property
    def dictated(self) -> bool:
        return self.digits is not None and (len(self.digits) == 1 or self.many)


#: What has no digits; its place is never asked for.
BREAK = Chunk(None, 0, 0, "")


@lru_cache(maxsize=1 << 14)
def _kind(c: str) -> str:
    return unicodedata.category(c)


def _core(token: str) -> tuple[int, str]:
    """The token without marks at its edges, and how many went before; a currency sign before stays."""
    a, b = 0, len(token)
    while a < b and _kind(token[a])[0] not in "LMN" and _kind(token[a]) != "Sc":
        a += 1
    while b > a and _kind(token[b - 1])[0] not in "LMN":
        b -= 1
    return a, token[a:b]


@lru_cache(maxsize=1 << 16)
def _read(token: str, compat: bool) -> tuple[int, int, str, str | None, str | None, int]:
    """What a token without separators is: how many marks go before its core, the core's length, its kind, its digits, the word that they are read
    from, and how often a multiplier repeats what follows. Few tokens make up most texts, so what they are is remembered."""
    lead, core = (0, token) if compat or (token.isascii() and token.isalnum()) else _core(token)
    lower = core.lower()
    if NUMERAL.fullmatch(lower):
        return lead, len(core), "numeral", lower, None, 1
    key = lower if lower.isalpha() else "".join(c for c in lower if _kind(c)[0] in "LM")
    if key in MULTIPLIERS:
        return lead, len(core), "multiplier", None, None, MULTIPLIERS[key]
    word, glued = NUM_WORDS.get(key), GLUED.fullmatch(lower)
    if glued and word is not None and not compat:
        return lead, len(core), "word first" if lower[0].isalpha() else "number first", re.sub("[^0-9]", "", lower), key, 1
    if word is not None:
        return lead, len(core), "word", word, key, 1
    return lead, len(core), "glued" if glued else "break", re.sub("[^0-9]", "", lower) if glued else None, None, 1


def chunks(text: str, compat: bool = False) -> list[Chunk]:
    """Chunks in order. A multiplier acts on the token after it and is itself left out. Unless compat, marks at a token's edges belong to neither side."""
    out: list[Chunk] = []
    times = None
    for m in PIECE.finditer(text):
        sep, token = m.groups()
        if token.isdecimal() and token.isascii():
            lead, width, kind, digits, key, many = 0, len(token), "numeral", token, None, 1
        else:
            lead, width, kind, digits, key, many = _read(token, compat)
        if kind == "break":
            out.append(BREAK)
            times = None
            continue
        if kind == "multiplier":
            times = many
            continue
        start = m.start(2) + lead
        end = start + width
        if kind in ("numeral", "word"):
            out.append(Chunk(digits * (times or 1), start, end, sep, key, times is not None))
        elif kind == "glued":
            out.append(Chunk(digits, start, end, sep))
        else:
            number, spelled = Chunk(digits, start, end, sep), Chunk(NUM_WORDS[key], start, end, sep, key, times is not None)
            first, second = (spelled, number) if kind == "word first" else (number, spelled)
            out += [first, second._replace(sep="")]
        times = None
    return out


def _accepted(chunk: Chunk, before: Chunk | None, after: Chunk | None) -> bool:
    """Whether a chunk takes part: an ambiguous word only beside chunks that look dictated."""
    if chunk.digits is None or chunk.word not in AMBIGUOUS:
        return chunk.digits is not None
    beside = [c for c in (before, after) if c is not None and c.digits is not None]
    if chunk.word in RISKY:
        return len(beside) == 2 and all(c.dictated for c in beside)
    return bool(beside) and all(c.dictated for c in beside)


def _shape(group: list[Chunk]) -> tuple:
    kinds: list[str] = []
    for c in group[1:]:
        found = [name for chars, name in SEPARATORS if any(x in c.sep for x in chars)] or ["none"]
        kinds += [k for k in found if k not in kinds]
    n = sum(c.word is not None for c in group)
    start, end = group[0].start, group[-1].end
    return "".join(c.digits for c in group), start, end, n, len(group) - n, kinds, 0 < n < len(group), start, end


def found(text: str | None, least: int = 1, compat: bool = False) -> list[tuple]:
    """Digit runs of at least that many digits; one of ambiguous words alone is none."""
    if text is None:
        return []
    every = chunks(text, compat)
    out, group = [], []
    for k, c in enumerate([*every, BREAK]):
        if c is not BREAK and (c.word is None or _accepted(c, every[k - 1] if k else None, every[k + 1] if k + 1 < len(every) else None)):
            group.append(c)
            continue
        if group:
            if any(g.word not in AMBIGUOUS for g in group):
                out.append(_shape(group))
            group = []
    return [r for r in out if len(r[0]) >= least]


FIELDS = ("digits", "start", "end", "word_n", "num_n", "seps", "mixed", "raw_start", "raw_end")


def packed(texts: Iterable[str | None], least: int = 1, compat: bool = False) -> pa.Array:
    """The runs of each text, as Arrow's columns."""
    places, every = [0], []
    for t in texts:
        if t is not None:
            every += found(t, least, compat)
        places.append(len(every))
    columns = zip(*every) if every else [()] * len(FIELDS)
    kinds = {"digits": pa.string(), "seps": pa.list_(pa.string()), "mixed": pa.bool_()}
    parts = [pa.array(c, kinds.get(n, pa.int32())) for n, c in zip(FIELDS, columns)]
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.StructArray.from_arrays(parts, FIELDS))


def runs(text: Column, least: int = 1, compat: bool = False) -> Column:
    """Digit runs of a column of texts, as found() has them."""

    @F.arrow_udf(RUN)
    def run(s: pa.Array) -> pa.Array:
        return packed(s.to_pylist(), least, compat)

    return F.coalesce(run(F.when(F.lower(text).rlike(LIKELY), text)), empty(RUN))


def placed(found_: Column, place) -> Column:
    """Runs with raw_start and raw_end by place(run), a struct of start and end."""
    return F.transform(found_, lambda r: r.withField("raw_start", place(r)["start"]).withField("raw_end", place(r)["end"]))


def digitized(text: Column, found_: Column) -> Column:
    """The text with each run replaced by its digits."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, r: F.struct(
        r["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, r["start"] - s["at"]), r["digits"]).alias("out")
    )
    return F.aggregate(found_, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))

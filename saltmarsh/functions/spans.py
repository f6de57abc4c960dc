"""Columns of spans: where patterns match, and set operations on intervals. All are built-in expressions."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT = "array<struct<start:int,end:int,match:string>>"
DETECTION = "array<struct<type:string,start:int,end:int,confidence:double,evidence:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def one_of(value: Column, names: Iterable[str]) -> Column:
    """Whether a string is among fixed ones: one literal, however many there are."""
    return F.array_contains(constants(names), value)


def constants(names: Iterable[str]) -> Column:
    return F.split(F.lit("\u0001".join(names)), "\u0001")


def looked_up(table: dict[str, str], key: Column) -> Column:
    """The value of a string in a fixed table, or null."""
    return F.try_element_at(F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in table.items())), F.lit("\u0001"), F.lit("\u0002")), key)


def exploded(df: DataFrame, value: Column, *names: str, kept: Iterable[str] = (), with_place: bool = False) -> DataFrame:
    """A row for each element of an array or map that a costly expression makes. A plain explode would have it made twice: once to ask for its size."""
    make = F.posexplode_outer if with_place else F.explode_outer
    return df.select(*kept, make(value).alias(*names)).where(f"{names[-1]} IS NOT NULL")


#: Characters that stand for nothing in any text (noncharacters of Unicode); what a text has of the first two is taken for the third.
MARK, AFTER, NO_MARK = "\ufdd0", "\ufdd1", "\ufdd2"


def _unmarked(text: Column) -> Column:
    return F.when(text.rlike(f"[{MARK}{AFTER}]"), F.translate(text, MARK + AFTER, NO_MARK * 2)).otherwise(text)


def cut(text: Column, pattern: str) -> Column:
    """The pieces between a pattern's matches, an empty one before a match at the beginning too. split() compiles its pattern again for each row, so a
    replacement, whose pattern is compiled once, marks the places."""
    return F.split(F.regexp_replace(_unmarked(text), pattern, MARK), MARK, -1)


def _hits(text: Column, pattern: str, group: int, use: Callable[[Column], Column]) -> Column:
    """use(pairs) of gap (from where the hit before began, if the pattern takes nothing, else from where it ended) and width, for each match of a group;
    none without a match. One replacement both finds the matches and marks where they begin and end."""

    def parse(marked: Column) -> Column:
        pieces = F.split(marked, MARK, -1)
        sizes = lambda p: F.struct(F.length(F.substring_index(p, AFTER, 1)).alias("width"), F.length(F.substring_index(p, AFTER, -1)).alias("rest"))
        # the first piece has no match, and is what is before the first one
        return F.when(marked.contains(MARK), let(F.transform(pieces, sizes), use)).otherwise(empty(HIT))

    return let(F.regexp_replace(_unmarked(text), pattern, f"{MARK}${group}{AFTER}"), parse)


def _hit(text: Column, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("match"))


def located(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap, with their code point offsets."""

    def place(sizes: Column) -> Column:
        zero = F.struct(F.element_at(sizes, 1)["rest"].alias("at"), empty(HIT).alias("out"))

        def step(s: Column, x: Column) -> Column:
            end = s["at"] + x["width"]
            return F.struct((end + x["rest"]).alias("at"), F.concat(s["out"], F.array(_hit(text, s["at"], end))).alias("out"))

        return F.aggregate(F.slice(sizes, F.lit(2), F.size(sizes)), zero, step, lambda s: s["out"])

    return _hits(text, pattern, 0, place)


def _escaped(text: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\/])", r"\\\1", text)


def _branches(terms: Iterable[str], end: Callable[[str], str], begun: str = "") -> str:
    """A pattern for terms without what they begin with: those that go on alike share it, and the longer ones come first."""
    rest: dict[str, list[str]] = {}
    for t in terms:
        rest.setdefault(t[:1], []).append(t)
    own = "" in rest
    rest.pop("", None)
    parts = []
    for some in rest.values():
        shared = os.path.commonprefix(some)
        parts.append(_escaped(shared) + _branches([t[len(shared) :] for t in some], end, begun + shared))
    if own:
        parts.append(end(begun))
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def alternation(terms: Iterable[str], whole: bool = True) -> str:
    """A pattern for whole terms, the longest first; an edge that is no letter or digit needs no boundary, and none does unless whole.

    Terms that begin alike share their beginning, and a place whose character begins no term fails at once.
    """
    ordered = sorted(dict.fromkeys(terms))
    before, after = {True: r"(?<![\p{L}\p{N}])", False: ""}, {True: r"(?![\p{L}\p{N}])", False: ""}
    first = "".join(rf"\x{{{ord(c):X}}}" for c in dict.fromkeys(t[0] for t in ordered))
    parts = []
    for edge in (True, False):
        some = [t for t in ordered if (whole and t[0].isalnum()) == edge]
        if some:
            parts.append(before[edge] + _branches(some, lambda t: after[whole and t[-1].isalnum()]))
    return f"(?:(?=[{first}])(?:{'|'.join(parts)}))"


def terms_in(text: Column, terms: Iterable[str], whole: bool = True) -> Column:
    """Where terms are, on whole words unless told otherwise. Of those that begin at one place the longest counts, and one inside another is
    left out; such as overlap in part all stay. A pattern that takes no letters is found at each beginning."""

    def place(sizes: Column) -> Column:
        zero = F.struct(F.element_at(sizes, 1)["rest"].alias("at"), F.lit(0).alias("reach"), empty(HIT).alias("out"))

        def step(s: Column, x: Column) -> Column:
            end = s["at"] + x["width"]
            out = F.when(end > s["reach"], F.concat(s["out"], F.array(_hit(text, s["at"], end)))).otherwise(s["out"])
            return F.struct((s["at"] + x["rest"]).alias("at"), F.greatest(s["reach"], end).alias("reach"), out.alias("out"))

        return F.aggregate(F.slice(sizes, F.lit(2), F.size(sizes)), zero, step, lambda s: s["out"])

    return _hits(text, f"(?=({alternation(terms, whole)}))", 1, place)


def kept_longest(spans: Column) -> Column:
    """Spans in order of start, then falling end, without those inside one before; of equal ones the first in order stays."""
    keyed = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), i.alias("i"), s.alias("s"))))
    reach = lambda i: F.array_max(F.transform(F.slice(keyed, F.lit(1), i), lambda k: -k["b"]))
    kept = F.filter(keyed, lambda k, i: (i == 0) | (reach(i) < -k["b"]))
    return F.transform(kept, lambda k: k["s"])


def moved(detections: Column, starts: Column, ends: Column) -> Column:
    """Detections with offsets of a view, as ones of the text: starts and ends have each character's, and are null where views have the text's."""
    place = lambda d: d.withField("start", F.get(starts, d["start"])).withField("end", F.get(ends, d["end"] - 1))
    return F.when(starts.isNull(), detections).otherwise(F.transform(detections, place))


def ascii_words(pattern: str) -> str:
    r"""\b as an edge of ASCII word characters, whatever the regex engine takes it for; \< as one before a word, where a word character follows anyhow."""
    pattern = pattern.replace(r"\<", r"(?<![A-Za-z0-9_])")
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge)


def detection(kind: Column | str, hit: Column, confidence: Column | float, evidence: Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_column(kind).alias("type"), hit["start"].cast("int").alias("start"), hit["end"].cast("int").alias("end"),
        as_column(confidence).cast("double").alias("confidence"), (hit["match"] if evidence is None else evidence).alias("evidence"),
    )


def inside_any(hit: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] <= hit["start"]) & (o["end"] >= hit["end"]))


def best_per_span(detections: Column) -> Column:
    """One detection for each type and span, the most confident; ordered by start, then falling confidence."""
    better = lambda d, o: (o["type"] == d["type"]) & (o["start"] == d["start"]) & (o["end"] == d["end"]) & (
        (o["confidence"] > d["confidence"]) | ((o["confidence"] == d["confidence"]) & (o["evidence"] < d["evidence"]))
    )
    unique = F.array_distinct(detections)
    kept = let(unique, lambda all_: F.filter(all_, lambda d: ~F.exists(all_, lambda o: better(d, o))))
    keyed = F.transform(kept, lambda d: F.struct(d["start"].alias("a"), (-d["confidence"]).alias("b"), d["end"].alias("c"), d.alias("d")))
    return F.transform(F.array_sort(keyed), lambda k: k["d"])


def merged(spans: Column) -> Column:
    """Spans in order of start, joined where they touch or overlap."""
    kind = "array<struct<start:int,end:int>>"
    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))

    def step(out: Column, s: Column) -> Column:
        joins = (F.size(out) > 0) & F.coalesce(s["start"] <= F.try_element_at(out, F.lit(-1))["end"], F.lit(False))
        tail = F.try_element_at(out, F.lit(-1))
        wider = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(tail["start"].alias("start"), F.greatest(tail["end"], s["end"]).alias("end"))))
        return F.when(joins, wider).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(plain, empty(kind), step)

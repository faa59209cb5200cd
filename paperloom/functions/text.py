"""Text helpers. Patterns follow the usual Unicode rules: ``re_(p)`` makes Java's classes and case folding Unicode and
lets only a line feed end a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hits that are gathered in one list before it is appended to the others.
BLOCK = 512
#: Stands around the hits of a marked text.
MARK = "\x01"
#: Texts with more hits than this are folded over.
FEW = 64
MATCH = "array<struct<hit:string,value:string,start:int,end:int>>"


def re_(pattern: str, ignore_case: bool = False) -> str:
    return ("(?idU)" if ignore_case else "(?dU)") + pattern


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body mentions it. Without it, an expression that is used in
    several places is copied to each of them, and nested uses multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, r"(?U)\s+", " "), " ", -1), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def has_letter(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def find_all(text: Column, pattern: str, group: int = 0, keep=None, limit: int | None = None) -> Column:
    """All non-overlapping matches, left to right: hit, the group's value, and code-point offsets. The pattern must not
    match the empty string. A text with few matches is searched once, by marks put around them; one with many, or with a
    mark of its own, by a fold. keep: a condition on the value. limit: so many of those kept, from the left, for a caller that
    reads no others; the places of the rest are not computed."""
    cut_off = lambda some: some if limit is None else F.slice(some, 1, limit)
    marked = F.when(~text.contains(MARK), F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"))

    def few(x: Column) -> Column:
        def one(i: Column) -> Column:
            hit = F.get(x["pieces"], i * 2 + 1)
            value = F.get(x["values"], i) if group else hit
            start = F.length(F.call_function("substring_index", x["marked"], F.lit(MARK), i * 2 + 1)) - i * 2
            return let(start, lambda a: F.struct(hit.alias("hit"), value.alias("value"), a.alias("start"), (a + F.length(hit)).alias("end")))

        places = F.sequence(F.lit(0), F.floor(F.size(x["pieces"]) / 2).cast("int") - 1)
        if keep:
            places = F.filter(places, lambda i: keep(F.get(x["values"], i) if group else F.get(x["pieces"], i * 2 + 1)))
        return F.transform(cut_off(places), one).cast(MATCH)

    def either(m: Column) -> Column:
        n, none = F.when(m["pieces"].isNotNull(), F.size(m["pieces"])), F.array().cast(MATCH)
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None).cast("array<string>")
        found = let(F.struct(m["marked"].alias("marked"), m["pieces"].alias("pieces"), values.alias("values")), few)
        folded = _fold_all(text, pattern, group)
        folded = cut_off(F.filter(folded, lambda m: keep(m["value"])) if keep else folded)
        return F.when(n == 1, none).when(n <= 2 * FEW + 1, found).when(text.isNotNull(), folded)

    marks = let(marked, lambda m: F.struct(m.alias("marked"), F.split(m, MARK, -1).alias("pieces")))
    return let(marks, either)


def _fold_all(text: Column, pattern: str, group: int) -> Column:
    """find_all() as a fold over the hits and the gaps between them, in blocks, since a list that grows is copied with every
    hit."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(hits.alias("h"), values.alias("v"), gaps.alias("g"))
    none, blocks = F.array().cast(MATCH), F.array().cast(f"array<{MATCH}>")
    start = F.struct(F.lit(0).alias("at"), blocks.alias("out"), none.alias("block"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["g"])
        b = a + F.length(x["h"])
        one = F.struct(x["h"].alias("hit"), x["v"].alias("value"), a.alias("start"), b.alias("end"))
        full = F.size(acc["block"]) == BLOCK
        out = F.when(full, F.concat(acc["out"], F.array(acc["block"]))).otherwise(acc["out"])
        block = F.concat(F.when(full, none).otherwise(acc["block"]), F.array(one))
        return F.when(x["h"].isNull(), acc).otherwise(F.struct(b.alias("at"), out.alias("out"), block.alias("block")))

    return F.aggregate(rows, start, step, lambda acc: F.flatten(F.concat(acc["out"], F.array(acc["block"]))))


def unless_empty(value: Column) -> Column:
    """A text, or null for an empty one. Spark copies what nullif() is given, in a condition or lambda, so that it runs twice."""
    return let(value, lambda v: F.when(v != "", v))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where there is none."""
    return unless_empty(F.regexp_extract(text, pattern, group))


def first_found(text: Column, pattern: str) -> Column:
    """The first of find_all(), or null; the search ends there."""
    part = lambda group: F.regexp_extract(text, rf"\A([\s\S]*?)({pattern})", group)

    def found(m: Column) -> Column:
        start = F.length(m["before"])
        one = F.struct(m["hit"].alias("hit"), m["hit"].alias("value"), start.alias("start"), (start + F.length(m["hit"])).alias("end"))
        return F.when(m["hit"] != "", one)

    return let(F.struct(part(1).alias("before"), part(2).alias("hit")), found)


def in_lower_case(text: Column) -> Column:
    """What from_word() reads of a text."""
    return F.struct(F.lower(text).alias("low"), (F.octet_length(text) == F.length(text)).alias("ascii"))


def from_word(text: Column, low: Column, *words: str) -> Column:
    """A text from the character before the first of some words on, or null if none occurs, for a pattern that ignores case
    and starts with one of them: it need not be tried where there is none. Words are ASCII in lower case. A text with other
    characters is left whole, as some of them equal a letter without regard to case (the long s, the Kelvin sign)."""
    places = F.array(*[F.locate(w, low["low"]) for w in words])
    at = F.array_min(F.filter(places, lambda i: i > 0))
    return F.when(low["ascii"], F.substring(text, at - 1, F.length(text))).otherwise(text)


def line_bounds(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """(place of the line feed before start or 0, place of the one from end on or the text's length)."""
    begin = let(F.left(text, start), lambda before: F.greatest(F.length(before) - F.length(F.substring_index(before, "\n", -1)) - 1, F.lit(0)))
    behind = F.substring(text, end + 1, F.length(text))
    return begin, F.least(end + F.length(F.substring_index(behind, "\n", 1)), F.length(text))


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] by code points."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))

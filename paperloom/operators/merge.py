"""Hybrid extraction: pattern and entity results by key, and the merging of two lists of one field."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..schema import FIELDS, EngineOptions
from . import entities as ner
from .fields import addresses, amounts, dates, emails, invoice_numbers, job_titles, phone_numbers, skills, urls

PATTERN_KEYS = ("email", "phone_number", "date", "amount", "invoice_number", "url")
ENTITY_KEYS = ("person_name", "company_name", "address", "job_title", "skill")
#: Above this ratio two values count as one.
ALIKE = 85


def extract_all(text: Column, options: EngineOptions = EngineOptions()) -> Column:
    """Map of key to fields; the two sources have no key in common, so each key keeps its source's list. An empty map for
    a null or empty text."""
    parts = {
        "email": emails(text), "phone_number": phone_numbers(text), "date": dates(text, options), "amount": amounts(text),
        "invoice_number": invoice_numbers(text), "url": urls(text),
    }
    found = ner.recognise(text, options, ("PERSON", "ORG"))
    keyed = lambda some: [x for k, v in some.items() for x in (F.lit(k), v.cast(FIELDS))]
    if found is None:
        whole = F.create_map(*keyed(parts))
    else:
        parts |= {"address": addresses(text), "job_title": job_titles(text), "skill": skills(text)}

        def named(e: Column) -> Column:
            companies = let(ner.company_names(text, e), lambda c: F.concat(c["vendor"], c["customer"]))
            return F.create_map(*keyed(parts | {"person_name": ner.person_names(e), "company_name": companies}))

        whole = let(found, named)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{FIELDS}>"))
    return F.when(F.coalesce(text, F.lit("")) != "", whole).otherwise(empty)


def ratio(a: str, b: str) -> int:
    """How alike two texts are, from 0 to 100: twice the matching characters by all characters, without regard to case."""
    a, b = a.lower(), b.lower()
    if not a or not b:
        return 0
    return round(100 * SequenceMatcher(None, a, b, autojunk=False).ratio())


def _sure(field: dict) -> float:
    """A field's confidence; one without counts as certain."""
    return 1.0 if field["confidence"] is None else field["confidence"]


def merged(primary: list[dict], secondary: list[dict]) -> list[dict]:
    """Each secondary field raises or lowers the confidence of the field it repeats, or is added. It repeats the most
    alike one (the first of equals) of those that are alike or whose span it overlaps; one that overlaps only and has
    nothing in common is added as well."""
    out = [dict(f) for f in primary]
    for new in secondary:
        repeated, best, place = False, 0, None
        for i, old in enumerate(out):
            alike = ratio(str(old["value"]), str(new["value"]))
            a, b = old.get("position"), new.get("position")
            overlap = a is not None and b is not None and a["start"] < b["end"] and b["start"] < a["end"]
            if alike > ALIKE or overlap:
                repeated = True
                if alike > best:
                    best, place = alike, i
        if repeated and place is not None:
            out[place]["confidence"] = round(min(0.7 * _sure(out[place]) + 0.3 * _sure(new), 1.0), 4)
        else:
            out.append(dict(new))
    return out


_SMALL = "array<struct<value:string,confidence:double,position:struct<start:int,end:int>>>"


def _plain(fields) -> list[dict]:
    return [] if fields is None else [{"value": f["value"], "confidence": f["confidence"], "position": f["position"]} for f in fields]


def merge_udf():
    """merged() as a pandas UDF; it needs a session."""

    def rows(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([merged(_plain(x), _plain(y)) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(rows, _SMALL)


def merge_lists(primary: Column, secondary: Column) -> Column:
    """merged() for each row. The fold depends on the order and on a ratio that no built-in function has, so it is a loop in
    Python over each row's two lists, in Arrow batches and without a shuffle."""
    return merge_udf()(primary, secondary)


def merge_columns(df: DataFrame, primary: str, secondary: str, into: str) -> DataFrame:
    """df with the merged list of two list columns."""
    slim = lambda c: F.transform(c, lambda f: F.struct(f["value"].alias("value"), f["confidence"].alias("confidence"), f["position"].alias("position"))).cast(_SMALL)
    return df.withColumn(into, merge_lists(slim(F.col(primary)), slim(F.col(secondary))))

"""Generic extractors: text to an array of FIELD, in the order of occurrence, with code-point positions.

Each one first asks a cheap question (is there an @, a digit, ...) that spares most texts the pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.amounts import to_number
from ..functions.dates import parse_date
from ..functions.text import find_all, first_found, has_letter, let, lines, re_, strip
from ..schema import FIELD, FIELDS, EngineOptions, field, no_fields

# The patterns whose matches define the results.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?:\s*(?:ext|x)\s*\d+)?"
DATE = (
    r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
    r"|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[-.\s,]+\d{1,2}[-.\s,]+\d{4})\b"
)
AMOUNT = r"(?:[\$₹€£]|USD|INR|EUR)?\s?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\b"
INVOICE_NUMBER = r"(?:Invoice|Bill|Reference|Inv)\s*(?:No|Number|#)?\s*[:.-]?\s*([A-Za-z0-9/-]+)"
URL = r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+"
ZIP = r"\b\d{5}(?:-\d{4})?\b"
SKILLS = [
    "Python", "Java", "JavaScript", "TypeScript", "C++", "C#", "Go", "Rust", "SQL", "NoSQL", "MongoDB", "PostgreSQL", "MySQL", "Redis",
    "React", "Angular", "Vue", "Next.js", "Node.js", "Django", "FastAPI", "Flask", "AWS", "Azure", "GCP", "Docker", "Kubernetes",
    "Terraform", "Machine Learning", "Deep Learning", "NLP", "Computer Vision", "TensorFlow", "PyTorch", "Scikit-learn",
    "Project Management", "Agile", "Scrum", "Communication", "Leadership",
]
TITLES = (
    "Software Engineer|Developer|Manager|Director|CTO|CEO|COO|Designer|Architect|Consultant|Analyst|Scientist|Coordinator|Administrator"
)
JOB_TITLE = rf"\b((?:{TITLES})(?:\s+[A-Za-z]+){{0,3}})\s+(?:at|@|for|-|with)\s+([A-Z][A-Za-z0-9\s]+)"


def _found(text: Column, guard: Column, pattern: str, make, group: int = 0, **some) -> Column:
    got = F.transform(find_all(text, pattern, group, **some), make)
    return F.when(guard, got).otherwise(no_fields()).cast(FIELDS)


def _first(text: Column, guard: Column, pattern: str, make) -> Column:
    return F.when(guard, let(first_found(text, pattern), lambda m: F.when(m.isNotNull(), make(m)))).cast(FIELD)


def _plain(kind: str, confidence: float):
    return lambda m: field(m["value"], kind, confidence, "regex", start=m["start"], end=m["end"], original=m["hit"])


def emails(text: Column) -> Column:
    return _found(text, text.contains("@"), re_(EMAIL), _plain("email", 1.0))


def first_email(text: Column) -> Column:
    """The first of emails(), or null."""
    return _first(text, text.contains("@"), re_(EMAIL), _plain("email", 1.0))


def _phone(m: Column) -> Column:
    return field(strip(m["value"]), "phone_number", 0.85, "regex", start=m["start"], end=m["end"], original=m["hit"])


def phone_numbers(text: Column) -> Column:
    return _found(text, text.rlike(re_(r"\d{4}")), re_(PHONE), _phone)


def first_phone(text: Column) -> Column:
    """The first of phone_numbers(), or null."""
    return _first(text, text.rlike(re_(r"\d{4}")), re_(PHONE), _phone)


def dates(text: Column, options: EngineOptions = EngineOptions()) -> Column:
    """Dates as ISO strings; what is no date is left out."""
    make = lambda m: field(parse_date(m["value"], options.year), "date", 0.9, "regex", start=m["start"], end=m["end"], original=m["hit"])
    return F.filter(_found(text, text.rlike(r"\d"), re_(DATE, ignore_case=True), make), lambda f: f["value"].isNotNull())


def amounts(text: Column) -> Column:
    def make(m: Column) -> Column:
        whole = ~m["value"].contains(".")

        def of(number: Column) -> Column:
            year = whole & (number > 1900) & (number < 2100)
            confidence = F.when(year, 0.4).when(whole, 0.8).otherwise(0.9)
            return field(number.cast("string"), "amount", confidence, "regex", number=number, start=m["start"], end=m["end"], original=m["hit"])

        return let(to_number(m["value"]), of)

    return F.filter(_found(text, text.rlike(r"\d"), re_(AMOUNT), make, group=1), lambda f: f["num_value"].isNotNull())


def invoice_numbers(text: Column, limit: int | None = None) -> Column:
    """limit: so many of the first ones."""
    with_digit = lambda v: v.rlike(re_(r"\d"))
    return _found(text, text.rlike(r"\d"), re_(INVOICE_NUMBER, ignore_case=True), _plain("invoice_number", 0.85), group=1, keep=with_digit, limit=limit)


def urls(text: Column) -> Column:
    return _found(text, text.contains("://"), re_(URL, ignore_case=True), _plain("url", 0.95))


def generic(text: Column, options: EngineOptions = EngineOptions()) -> Column:
    """The bundle for documents of other types."""
    return F.struct(
        emails(text).alias("email"), phone_numbers(text).alias("phone_number"), dates(text, options).alias("dates"), amounts(text).alias("amounts"), urls(text).alias("urls")
    )


def addresses(text: Column, limit: int | None = None) -> Column:
    """The line of every ZIP code, if it has a letter; a line with two codes comes twice. Its span begins with the line feed
    before it. limit: those of so many of the first such lines."""
    numbered = F.transform(lines(text), lambda x, i: F.struct(x.alias("line"), i.alias("place")))
    good = F.filter(numbered, lambda x: x["line"].rlike(re_(ZIP)) & has_letter(x["line"]))

    def make(x: Column) -> Column:
        begin = lambda place: F.length(F.call_function("substring_index", text, F.lit("\n"), place))
        one = field(strip(x["line"]), "address", 0.8, "regex", start=begin(x["place"]), end=begin(x["place"] + 1))
        return F.array_repeat(one, F.regexp_count(x["line"], F.lit(re_(ZIP))))

    got = F.flatten(F.transform(good if limit is None else F.slice(good, 1, limit), make))
    return F.when(text.rlike(r"\d{5}"), got).otherwise(no_fields()).cast(FIELDS)


def _quoted(phrase: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase)


SKILL = r"(?<![\p{L}\p{N}_])(?:" + "|".join(_quoted(s) for s in sorted(SKILLS, key=lambda s: (-len(s), s))) + r")(?![\p{L}\p{N}_])"


def skills(text: Column) -> Column:
    """Known skills in their exact spelling, each once, at its first place."""
    found = _found(text, F.coalesce(text, F.lit("")) != "", SKILL, lambda m: field(m["value"], "skill", 1.0, "phrase", start=m["start"], end=m["end"]))
    return unique(found)


def unique(fields: Column) -> Column:
    """The first field of each value."""
    values = F.array_distinct(F.transform(fields, lambda f: f["value"]))
    return F.transform(values, lambda v: F.get(F.filter(fields, lambda f: f["value"].eqNullSafe(v)), F.lit(0)))


def job_titles(text: Column) -> Column:
    make = lambda m: field(m["value"], "job_title", 0.75, "regex", start=m["start"], end=m["end"])
    guard = text.rlike(re_(rf"\b(?:{TITLES})", ignore_case=True))
    return _found(text, guard, re_(JOB_TITLE, ignore_case=True), make, group=1)

"""Types shared by all operators, and the engine's options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One extracted value. num_value carries it as a number where it is one.
FIELD = (
    "struct<value:string,num_value:double,field_type:string,confidence:double,source:string,entity_label:string,"
    "position:struct<start:int,end:int>,original_text:string,original_value:string,corrected:boolean>"
)
FIELDS = f"array<{FIELD}>"
ENTITY = "struct<label:string,text:string,start:int,end:int>"
ENTITIES = f"array<{ENTITY}>"

DOCUMENTS = (
    "id string, filename string, status string, upload_timestamp timestamp, processed_timestamp timestamp, document_type string, "
    "text_content string, confidence double, error string"
)
EXTRACTIONS = "id string, document_id string, field_key string, ord int, value string, confidence double, source string, position_json string"
CORRECTIONS = "id string, document_id string, field_key string, previous_value string, new_value string, timestamp timestamp"


@dataclass(frozen=True)
class EngineOptions:
    """as_of: the date that two-digit years, missing date parts and year limits refer to. compat: route and validate
    exactly as the literal wiring does. ner: ``none``, ``rules``, or a function from a text column to ENTITIES. classifier: a
    function from a text column to a classification, in place of the rules."""

    as_of: str = "2025-01-01"
    compat: bool = False
    ner: str | Callable[[Column], Column] = "rules"
    region: str = "US"
    classifier: Callable[[Column], Column] | None = None

    @property
    def year(self) -> int:
        return int(self.as_of[:4])


def clamp(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def field(value, field_type: str, confidence, source: str | None = None, *, number=None, label: str | None = None, start=None, end=None, original=None) -> Column:
    """A FIELD; its position is null without a start."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    position = F.lit(None) if start is None else F.when(start.isNotNull() & (start != -1), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
    return F.struct(
        lit(value).cast("string").alias("value"),
        lit(number).cast("double").alias("num_value"),
        F.lit(field_type).alias("field_type"),
        clamp(lit(confidence).cast("double")).alias("confidence"),
        F.lit(source).cast("string").alias("source"),
        F.lit(label).cast("string").alias("entity_label"),
        position.cast("struct<start:int,end:int>").alias("position"),
        lit(original).cast("string").alias("original_text"),
        F.lit(None).cast("string").alias("original_value"),
        F.lit(None).cast("boolean").alias("corrected"),
    ).cast(FIELD)


def no_fields() -> Column:
    return F.array().cast(FIELDS)


def first(fields: Column) -> Column:
    """The first element, or null."""
    return F.get(fields, F.lit(0))

"""Exports of finished documents: JSON, and one CSV row a document with a column for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "csv")


def exportable(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("status") == "completed")


def _check(format: str) -> None:
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}: one of {', '.join(FORMATS)} is needed")


def requested(documents: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents to export, rejects with code 404) of asked (id): a document that is missing or not completed is rejected."""
    from .store import found_or_404

    return found_or_404(documents, asked, "completed", "Document not found or not ready")


def to_json(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """(document_id, json): the fields of each completed document."""
    from .store import with_fields

    return with_fields(exportable(documents), extractions).select(F.col("id").alias("document_id"), F.to_json("fields").alias("json"))


def to_table(documents: DataFrame, extractions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row for each completed document with any field and one column a key; several values are joined by ``; ``. With
    keys given there is no pass over the data to find them."""
    rows = extractions.join(exportable(documents).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    joined = rows.groupBy("document_id", "field_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "; ").alias("value"))
    return joined.groupBy("document_id").pivot("field_key", keys).agg(F.first("value"))


def export(documents: DataFrame, extractions: DataFrame, path: str, format: str = "json", keys: list[str] | None = None) -> None:
    """Write the export under path."""
    _check(format)
    if format == "json":
        to_json(documents, extractions).write.json(path)
    else:
        to_table(documents, extractions, keys).write.option("header", True).csv(path)


def confidences(extractions: DataFrame) -> DataFrame:
    """(document_id, Field, Confidence), the data of a confidence chart."""
    return extractions.select("document_id", F.col("field_key").alias("Field"), F.col("confidence").alias("Confidence"))

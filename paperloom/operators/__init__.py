"""Operators on documents: classification, extraction, merging, correction, validation and storage."""

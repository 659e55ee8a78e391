"""Semantic types: the registry, validation and inference of a value's type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SemanticType:
    name: str
    description: str
    pattern: str
    is_pii: bool


# The type registry, in inference order.
_TYPES = [
    SemanticType("NPI", "National Provider Identifier", r"^[0-9]{10}$", False),
    SemanticType("SSN", "Social Security Number",
                 r"^(?!000|666)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", True),
    SemanticType("EMAIL", "Email Address", r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$", True),
    SemanticType("PHONE_US", "US Phone Number",
                 r"^(\+1|1)?[\s-]?\(?[2-9][0-9]{2}\)?[\s-]?[2-9][0-9]{2}[\s-]?[0-9]{4}$", True),
    SemanticType("ZIP_CODE", "US Zip Code", r"^\d{5}(-\d{4})?$", False),
    SemanticType("TAX_ID", "Taxpayer Identification Number (EIN)", r"^[0-9]{2}-[0-9]{7}$", True),
]
SEMANTIC_TYPES = {t.name: t for t in _TYPES}


def get_type(name: str) -> SemanticType | None:
    return SEMANTIC_TYPES.get(name.upper())


def registry_frame(spark: SparkSession) -> DataFrame:
    """The registry as a six-row table, small enough to broadcast by its definition."""
    return spark.createDataFrame([(t.name, t.description, t.is_pii) for t in _TYPES],
                                 "type_name string, description string, is_pii boolean")


def is_valid(c: Column, type_name: str) -> Column:
    """False for null, empty and unknown types, else whether the pattern matches."""
    known = get_type(type_name)
    if known is None:
        return F.lit(False)
    return F.coalesce(c.rlike(known.pattern), F.lit(False))


def infer_type(c: Column) -> Column:
    """Name of the first type, in registry order, whose pattern matches; null if none does."""
    return F.coalesce(*[F.when(c.rlike(t.pattern), F.lit(t.name)) for t in _TYPES])

"""Row rules as column expressions. All are native, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldweave.functions.semantic import SEMANTIC_TYPES

# User-facing cast targets and date formats.
CAST_TARGETS = {"integer": "int", "float": "double", "string": "string", "date": "date", "boolean": "boolean"}
DATE_FORMATS = {
    "YYYY-MM-DD": "yyyy-MM-dd",
    "MM/DD/YYYY": "MM/dd/yyyy",
    "DD-MM-YYYY": "dd-MM-yyyy",
    "ISO 8601": "yyyy-MM-dd'T'HH:mm:ss",
}


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def single_spaced(c: Column) -> Column:
    """Runs of white space as one space, outer spaces removed. A lone space is left alone,
    which spares a replacement per word."""
    return F.trim(F.regexp_replace(c, r" \s+|[\t\n\x0B\f\r]\s*", " "))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]+", "")


def clean_text(c: Column) -> Column:
    """Lower case, ASCII letters, digits and single spaces only. May yield ''."""
    return single_spaced(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]+", ""))


def clean_phone(c: Column) -> Column:
    return blank_to_null(digits(c))


def phonetic_key(c: Column) -> Column:
    """Soundex; null unless the value starts with an ASCII letter."""
    return F.when(c.rlike("^[A-Za-z]"), F.soundex(c))


def phone_format(c: Column) -> Column:
    kept = F.regexp_replace(c, "[^0-9+-]", "")
    return F.when(F.length(kept) >= 7, kept)


def email(c: Column) -> Column:
    value = F.lower(F.trim(c))
    return F.when(value.rlike(SEMANTIC_TYPES["EMAIL"].pattern), value)


def website(c: Column) -> Column:
    value = blank_to_null(F.lower(F.trim(c)))
    return F.when(value.rlike("^https?://"), value).otherwise(F.concat(F.lit("https://"), value))


def npi(c: Column) -> Column:
    value = digits(c)
    return F.when(F.length(value) == 10, value)


def upper_trim(c: Column) -> Column:
    return F.upper(F.trim(c))


def dea(c: Column) -> Column:
    return blank_to_null(upper_trim(c))


def license_id(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""))


def proper_name(c: Column) -> Column:
    return F.initcap(single_spaced(c))


def postal_code(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def default_country(c: Column, country: str = "US") -> Column:
    return F.coalesce(c, F.lit(country))


def e164_us(c: Column) -> Column:
    """``+1`` and ten digits for a valid US number, else null."""
    return F.when(c.rlike(SEMANTIC_TYPES["PHONE_US"].pattern), F.concat(F.lit("+1"), F.right(digits(c), F.lit(10))))


def convert(c: Column, target: str) -> Column:
    """Cast to a user-facing type name; bad input becomes null."""
    if target.lower() not in CAST_TARGETS:
        raise ValueError(f"unknown datatype {target!r}; known: {sorted(CAST_TARGETS)}")
    return c.try_cast(CAST_TARGETS[target.lower()])


def decimal_places(c: Column, scale: int) -> Column:
    if not 0 <= int(scale) <= 10:
        raise ValueError("scale must be within 0 and 10")
    return F.round(c, int(scale))


def text_case(c: Column, case_format: str) -> Column:
    cases = {"uppercase": F.upper, "lowercase": F.lower, "title case": F.initcap}
    if case_format.lower() not in cases:
        raise ValueError(f"unknown case format {case_format!r}; known: {sorted(cases)}")
    return cases[case_format.lower()](c)


def format_date(c: Column, style: str) -> Column:
    return F.date_format(c, _date_pattern(style))


def parse_date(c: Column, style: str) -> Column:
    return F.try_to_timestamp(c, F.lit(_date_pattern(style)))


def _date_pattern(style: str) -> str:
    if style not in DATE_FORMATS:
        raise ValueError(f"unknown date format {style!r}; known: {sorted(DATE_FORMATS)}")
    return DATE_FORMATS[style]


# Column roles of the mandatory rules.
ROLE_RULES = {
    "phone": phone_format,
    "email": email,
    "website": website,
    "npi": npi,
    "dea": dea,
    "license": license_id,
    "tax_id": license_id,
    "duns": license_id,
    "entity_name": proper_name,
    "person_name": proper_name,
    "address": proper_name,
    "city": proper_name,
    "state": upper_trim,
    "country": upper_trim,
    "postal_code": postal_code,
    "code": upper_trim,
    "status": upper_trim,
}

# Named rules a caller may pick per column.
NAMED_RULES = {
    "clean_text": clean_text,
    "clean_phone": clean_phone,
    "soundex": phonetic_key,
    "default_country": default_country,
    "e164": e164_us,
    "trim": F.trim,
    **ROLE_RULES,
}

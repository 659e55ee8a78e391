"""Declarative cleansing: per-column rules and whole rule sets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from goldweave.functions import cleansing as c

# Column-name patterns that give a column its role when the caller does not.
_ROLE_BY_NAME = [
    (r"phone|fax|mobile", "phone"),
    (r"e_?mail", "email"),
    (r"web_?site|url", "website"),
    (r"(^|_)npi($|_)", "npi"),
    (r"(^|_)dea($|_)", "dea"),
    (r"licen[sc]e", "license"),
    (r"tax_?id|(^|_)ein($|_)", "tax_id"),
    (r"duns", "duns"),
    (r"(^|_)ssn($|_)|social_?security", "ssn"),
    (r"birth|(^|_)dob($|_)", "birth_date"),
    (r"zip|postal", "postal_code"),
    (r"address|street", "address"),
    (r"(^|_)city($|_)", "city"),
    (r"(^|_)state($|_)", "state"),
    (r"country", "country"),
    (r"(first|last|middle|full)_?name", "person_name"),
    (r"(company|entity|vendor|organi[sz]ation|business|facility)_?name", "entity_name"),
    (r"(^|_)code($|_)", "code"),
    (r"status", "status"),
]


def role_of(column: str) -> str | None:
    return next((role for pattern, role in _ROLE_BY_NAME if re.search(pattern, column.lower())), None)


def apply_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One projection over ``{column: rule name}``; an unknown rule is an error."""
    unknown = sorted(set(rules.values()) - set(c.NAMED_RULES))
    if unknown:
        raise ValueError(f"unknown cleansing rules {unknown}; known: {sorted(c.NAMED_RULES)}")
    return df.withColumns({col: c.NAMED_RULES[rule](F.col(col)) for col, rule in rules.items()})


def apply_mandatory_rules(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """The role rules, then ``trim`` for every other string column, in one projection."""
    given = roles or {}
    out: dict[str, Column] = {}
    for field in df.schema.fields:
        if not isinstance(field.dataType, StringType):
            continue
        role = given.get(field.name, role_of(field.name))
        out[field.name] = c.ROLE_RULES.get(role, F.trim)(F.col(field.name))
    return df.withColumns(out) if out else df


def _column_rule(df: DataFrame, rule: dict) -> DataFrame:
    kind, params = rule["rule_type"].upper(), rule.get("rule_parameters", {})
    if kind == "NEW_COLUMN":
        expression = params["expression"]
        try:
            return df.withColumn(params["new_column_name"], F.expr(expression))
        except Exception as error:
            raise ValueError(f"invalid expression {expression!r}: {error}") from error
    name = rule["column_name"]
    if name not in df.columns:
        raise ValueError(f"rule {kind} names an unknown column {name!r}")
    col = F.col(name)
    if kind == "DATATYPE_CONVERSION":
        return df.withColumn(name, c.convert(col, params["desired_datatype"]))
    if kind == "DECIMAL_PRECISION":
        return df.withColumn(name, c.decimal_places(col, params["scale"]))
    if kind == "TEXT_CASE":
        return df.withColumn(name, c.text_case(col, params["case_format"]))
    raise ValueError(f"unknown rule type {kind!r}")


def apply_date_format(df: DataFrame, style: str) -> DataFrame:
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))]
    return df.withColumns({d: c.format_date(F.col(d), style) for d in dates}) if dates else df


def handle_nulls(df: DataFrame, mode: str, text_default: str = "", number_default: float = 0) -> DataFrame:
    """``keep``, ``replace`` (by type) or ``remove`` rows that hold a null."""
    if mode == "keep":
        return df
    if mode == "remove":
        return df.dropna()
    if mode != "replace":
        raise ValueError(f"unknown null handling {mode!r}; known: keep, replace, remove")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    out = df.fillna(text_default, subset=texts) if texts else df
    return out.fillna(number_default, subset=numbers) if numbers else out


def apply_ruleset(df: DataFrame, config: dict, roles: dict[str, str] | None = None) -> DataFrame:
    """Mandatory rules, column rules in list order, date format, null handling.

    The optimizer collapses the steps into one projection per dependency level.
    """
    out = apply_mandatory_rules(df, roles)
    for rule in config.get("cleansing_rules", []):
        out = _column_rule(out, rule)
    settings = config.get("global_settings", {})
    if settings.get("date_format"):
        out = apply_date_format(out, settings["date_format"])
    return handle_nulls(out, settings.get("null_handling", "keep"))

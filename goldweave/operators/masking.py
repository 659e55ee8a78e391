"""Masking of personal data before export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unanchored counterparts of the registry patterns, for use inside running text.
EMAIL_IN_TEXT = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]*[a-zA-Z0-9]"
SSN_IN_TEXT = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
PHONE_IN_TEXT = r"\(?[2-9][0-9]{2}\)?[ -][2-9][0-9]{2}[ -]?[0-9]{4}\b"


def mask_free_text(c: Column) -> Column:
    """Replace e-mail addresses, SSNs and US phone numbers inside a text by a type tag."""
    # The address pattern is costly on plain words; most texts hold no address at all.
    out = F.when(c.contains("@"), F.regexp_replace(c, EMAIL_IN_TEXT, "[EMAIL]")).otherwise(c)
    out = F.regexp_replace(out, SSN_IN_TEXT, "[SSN]")
    return F.regexp_replace(out, PHONE_IN_TEXT, "[PHONE]")


def pseudonym(c: Column, salt: str) -> Column:
    """Salted SHA-256: equal inputs stay joinable, the value does not come back."""
    return F.sha2(F.concat(F.lit(salt), c), 256)


def mask_all_but(c: Column, keep: int) -> Column:
    """Replace letters and digits by X and 9, except for the last ``keep`` characters.

    A value of up to twice ``keep`` characters is masked whole: its end would be most of it.
    """
    kept = F.when(F.length(c) > 2 * keep, keep).otherwise(0)
    head = F.regexp_replace(F.regexp_replace(F.substring(c, F.lit(1), F.length(c) - kept),
                                             "[A-Za-z]", "X"), "[0-9]", "9")
    return F.concat(head, F.right(c, kept))


def email_domain_only(c: Column) -> Column:
    return F.when(c.contains("@"), F.concat(F.lit("***@"), F.substring_index(c, "@", -1)))


def zip3(c: Column) -> Column:
    return F.substring(c, 1, 3)


def apply_policy(df: DataFrame, policy: dict[str, str], salt: str) -> DataFrame:
    """One projection over ``{column: hash | mask4 | domain | text | zip3 | drop | null}``."""
    actions = {
        "hash": lambda c: pseudonym(c, salt),
        "mask4": lambda c: mask_all_but(c, 4),
        "domain": email_domain_only,
        "text": mask_free_text,
        "zip3": zip3,
        "null": lambda c: F.lit(None).cast("string"),
    }
    unknown = sorted(set(policy.values()) - set(actions) - {"drop"})
    if unknown:
        raise ValueError(f"unknown masking actions {unknown}; known: {sorted(actions) + ['drop']}")
    masked = {c: actions[a](F.col(c).cast("string")) for c, a in policy.items() if a != "drop"}
    return df.withColumns(masked).drop(*[c for c, a in policy.items() if a == "drop"])


def gdpr_policy(column_types: dict[str, str]) -> dict[str, str]:
    """Masking action per personal-data column, from its semantic type."""
    by_type = {"SSN": "hash", "TAX_ID": "hash", "EMAIL": "domain", "PHONE_US": "mask4"}
    return {c: by_type[t] for c, t in column_types.items() if t in by_type}


def hipaa_policy(column_roles: dict[str, str | None], safe: set[str] = frozenset()) -> dict[str, str]:
    """Stricter: identifiers, names and contact data hashed, streets, cities and birth dates removed, postal
    codes cut to three digits. A column without a known role is refused unless ``safe`` lists it."""
    by_role = {"person_name": "hash", "entity_name": "hash", "address": "null", "city": "null", "postal_code": "zip3",
               "phone": "hash", "email": "hash", "website": "hash", "npi": "hash", "dea": "hash", "license": "hash",
               "tax_id": "hash", "ssn": "hash", "duns": "hash", "birth_date": "null", "text": "text"}
    open_columns = sorted(c for c, r in column_roles.items() if r not in by_role and c not in safe)
    if open_columns:
        raise ValueError(f"columns without a rule: {open_columns}; give them a role or list them as safe")
    return {c: by_role[r] for c, r in column_roles.items() if c not in safe}

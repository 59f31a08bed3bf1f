"""String normalisation and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes any surrounding whitespace; Spark's trim() only
# spaces, so whitespace is stripped with a regular expression instead.
_EDGE_WHITESPACE = r"^\s+|\s+$"


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_WHITESPACE, "")


def clean_text(c: Column) -> Column:
    """null -> '', strip surrounding whitespace, lower case."""
    return F.lower(strip_ws(F.coalesce(c.cast("string"), F.lit(""))))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip_ws(c.cast("string")), F.lit(""))


def short_label(c: Column) -> Column:
    """Text before the first space."""
    return F.substring_index(c.cast("string"), " ", 1)


def display_name(customer_id: Column) -> Column:
    """'-' to space, title case."""
    return F.initcap(F.regexp_replace(customer_id.cast("string"), "-", " "))


def initials(name: Column) -> Column:
    """Upper-cased first letters of the first two words, 'C' when empty."""
    words = F.filter(F.split(F.regexp_replace(name, "-", " "), " "), lambda w: F.length(w) > 0)
    first_two = F.slice(words, 1, 2)
    joined = F.array_join(F.transform(first_two, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(F.length(joined) > 0, joined).otherwise(F.lit("C"))


def customer_id_from_email(email: Column) -> Column:
    """Local part, non-alphanumerics to '-', strip '-', prefix 'cust-' (P14).

    The reference falls back to a random token for an empty local part; a
    job must be deterministic, so we use a hash prefix of the address.
    """
    local = F.lower(F.substring_index(email, "@", 1))
    cleaned = F.regexp_replace(F.regexp_replace(local, "[^a-z0-9]", "-"), "^-+|-+$", "")
    fallback = F.substring(F.sha2(email, 256), 1, 8)
    return F.concat(F.lit("cust-"), F.when(F.length(cleaned) > 0, cleaned).otherwise(fallback))


def account_label(email: Column) -> Column:
    """Local part with '.', '-', '_' as spaces, title case."""
    local = F.substring_index(email, "@", 1)
    return F.initcap(F.regexp_replace(local, "[.\\-_]", " "))


def currency_label(value: Column) -> Column:
    """'$18,420': thousands separators, no decimals, half to even."""
    return F.concat(F.lit("$"), F.format_number(value.cast("double"), 0))


def percent_label(value: Column) -> Column:
    """Fraction <= 1 times 100, else as is; one decimal, half to
    even, and '%' (P17)."""
    v = value.cast("double")
    pct = F.when(v <= 1, v * 100).otherwise(v)
    return F.concat(F.call_function("format_number", pct, F.lit("0.0")), F.lit("%"))

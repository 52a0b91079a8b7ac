"""Text functions over columns: two normalisers, legal suffixes, numbers, block keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that mark a company's legal form, in order of alternation.
LEGAL_FORMS = (
    "private limited", "pvt ltd", "pvt", "ltd", "limited", "llc", "inc", "corp", "corporation", "co", "company", "sarl",
    "sa", "gmbh", "bv", "sl", "srl", "spa", "plc", "holdings", "group", "enterprise", "enterprises", "services",
)
LEGAL_PATTERN = r"\b(" + "|".join(LEGAL_FORMS) + r")\b"


def normalize(col: Column) -> Column:
    """ASCII letters and digits in lower case, anything else one space, trimmed; null gives ''."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), "[^a-zA-Z0-9 ]", " "), " +", " ")))


def normalize_country(col: Column) -> Column:
    """Lower case without surrounding Unicode spaces; null gives ''."""
    return F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"^\p{Z}+|\p{Z}+$", ""))


def _keep_unicode(value: str | None) -> str:
    folded = unicodedata.normalize("NFKC", value or "").lower()
    return "".join(c if unicodedata.category(c)[0] in "LNM" or c.isspace() else " " for c in folded)


@F.pandas_udf(T.StringType())
def normalize_unicode(values: pd.Series) -> pd.Series:
    """NFKC, lower case; letters, numbers, marks and white space stay, others become a space each.

    Spaces are neither collapsed nor trimmed; null gives ''.
    """
    return values.map(_keep_unicode, na_action=None)


def strip_legal(col: Column) -> Column:
    """Removes legal forms (any case), collapses white space, trims."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, "(?i)" + LEGAL_PATTERN, " "), r"\s+", " "))


def numbers(col: Column) -> Column:
    """Free-standing digit runs of a text, as an array of strings."""
    return F.regexp_extract_all(col, F.lit(r"\b(\d+)\b"), 1)


def number_match(a: Column, b: Column) -> Column:
    """1.0 if the texts share a number, -1.0 if both have numbers and share none, else 0.0."""
    x, y = numbers(a), numbers(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(F.arrays_overlap(x, y), 1.0).otherwise(-1.0)


def tokens(col: Column) -> Column:
    """Distinct non-empty space tokens."""
    return F.array_distinct(F.filter(F.split(col, " "), lambda t: t != ""))


def prefix6(col: Column) -> Column:
    return F.left(F.replace(col, F.lit(" "), F.lit("")), F.lit(6))


def first_token(col: Column) -> Column:
    return F.split_part(col, F.lit(" "), F.lit(1))


def last_token(col: Column) -> Column:
    return F.element_at(F.split(col, " "), -1)

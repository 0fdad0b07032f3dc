"""Personal-data patterns, validators and masking as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance import fixed_values as fixed
from parlance.functions import text as tx


@lru_cache(maxsize=1)
def _decimal_digits() -> tuple[str, str]:
    """Every decimal digit of every script, and the ASCII digit it stands for."""
    digits = [ch for ch in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(ch) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(ch)) for ch in digits)


def digits_only(match: Column) -> Column:
    """ASCII digits of a match, whatever script they were written in."""
    kept = F.regexp_replace(match, F.lit(r"(?U)\D+"), F.lit(""))
    foreign, plain = _decimal_digits()
    return F.when(kept.rlike("[^0-9]"), F.translate(kept, foreign, plain)).otherwise(kept)


def valid_digit_count(match: Column) -> Column:
    return F.length(digits_only(match)).between(10, 11)


def valid_luhn(match: Column) -> Column:
    """13 to 19 digits whose mod-10 checksum holds."""
    digits = digits_only(match)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def valid_ssn(match: Column) -> Column:
    digits = digits_only(match)
    area = F.substring(digits, 1, 3)
    return (
        (F.length(digits) == 9)
        & ~area.isin("000", "666")
        & ~area.startswith("9")
        & (F.substring(digits, 4, 2) != "00")
        & (F.substring(digits, 6, 4) != "0000")
    )


VALIDATORS = {
    "none": None,
    "digit_count": valid_digit_count,
    "luhn": valid_luhn,
    "ssn_structure": valid_ssn,
}


def _worth_scanning(text: Column, category: str) -> Column:
    # A cheap look for a character every match must contain.
    return F.contains(text, F.lit("@")) if category == "email" else text.rlike(r"(?U)\d")


def matches(text: Column, category: str, pattern: str, validator: str) -> Column:
    """All valid matches of one category, as an array that must stay inside the job."""
    found = F.regexp_extract_all(text, F.lit(tx.python_pattern(pattern, "iU")), F.lit(0))
    check = VALIDATORS[validator]
    if check is not None:
        found = F.filter(found, check)
    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(_worth_scanning(text, category), found), empty)


def match_count(text: Column, category: str, pattern: str, validator: str) -> Column:
    """Number of valid matches; categories without a validator need no array."""
    if validator == "none":
        counted = F.regexp_count(text, F.lit(tx.python_pattern(pattern, "iU")))
        return F.coalesce(F.when(_worth_scanning(text, category), counted), F.lit(0)).cast("bigint")
    return F.size(matches(text, category, pattern, validator)).cast("bigint")


def mask_before_tokens(text: Column, patterns: Sequence[tuple[str, str, str]] = fixed.PII_PATTERNS) -> Column:
    """Text as the tokeniser should see it: personal data, URLs, e-mails and markers gone.

    Tokens hold letters only, so blanking a number changes them just where the
    number sits inside a URL or e-mail-like string. Validated patterns are
    therefore applied only to rows containing one.
    """
    masked = text
    for category, pattern, validator in patterns:
        if validator == "none":
            blanked = F.regexp_replace(masked, F.lit(tx.python_pattern(pattern, "iU")), F.lit(" "))
            masked = F.when(_worth_scanning(text, category), blanked).otherwise(masked)
    split_by_numbers = masked
    for category, pattern, validator in patterns:
        if validator != "none":
            split_by_numbers = F.aggregate(
                matches(text, category, pattern, validator),
                split_by_numbers,
                lambda whole, match: F.replace(whole, match, F.repeat(F.lit(" "), F.length(match))),
            )
    linked = (
        F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")) | F.contains(F.lower(text), F.lit("www."))
    )
    cleaned = tx.drop_email_like(tx.drop_urls(split_by_numbers))
    return tx.drop_markers(F.when(linked, cleaned).otherwise(masked))

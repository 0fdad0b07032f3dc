"""Speaker-tag parsing as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance import fixed_values as fixed
from parlance.functions import text as tx


def tag_pattern(
    labels: Mapping[str, Sequence[str]] = fixed.SPEAKER_LABELS,
    separators: Sequence[str] = fixed.SPEAKER_SEPARATORS,
) -> str:
    """Known label at the start or after whitespace, optional brackets, then a separator."""
    longest_first = sorted((re.escape(label) for group in labels.values() for label in group), key=len, reverse=True)
    separator = "[" + "".join("\\" + mark for mark in separators) + "]"
    return rf"(?iU)(?<!\S)(?:\[\s*)?({'|'.join(longest_first)})(?:\s*\])?\s*{separator}\s*"


def tag_labels(text: Column, **options) -> Column:
    """Lower-cased label of every tagged turn, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(tag_pattern(**options)), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def turn_bodies(text: Column, **options) -> Column:
    """Text after every tag, up to the next tag."""
    pieces = F.split(text, tag_pattern(**options), -1)
    return F.slice(pieces, F.lit(2), F.size(pieces))


def empty_turns(text: Column, **options) -> Column:
    bodies = F.filter(turn_bodies(text, **options), lambda body: ~tx.present(body))
    return F.coalesce(F.size(bodies), F.lit(0)).cast("bigint")


def role_turns(labels: Column, role: str, known: Mapping[str, Sequence[str]] = fixed.SPEAKER_LABELS) -> Column:
    """Number of turns whose label belongs to the role, given the label array."""
    return F.size(F.filter(labels, lambda label: label.isin(list(known[role])))).cast("bigint")

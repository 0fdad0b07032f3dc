"""Column expressions over free text.

Java regular expressions use ASCII classes unless told otherwise, so patterns
are prefixed with ``(?U)``, which makes ``\\w \\d \\s \\b`` cover all scripts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance import fixed_values as fixed

WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def quoted(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only the space character."""
    return F.trim(text, F.lit(WHITESPACE))


def present(text: Column) -> Column:
    """True when the text is neither null nor made of whitespace alone."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def null_like_pattern(spellings: Sequence[str]) -> str:
    """Anchored pattern for the spellings; it gives up within a few characters, however long the text."""
    words = "|".join(re.escape(word) for word in spellings if word)
    blank = "?" if "" in spellings else ""
    return rf"(?iU)^\s*(?:{words}){blank}\s*\z"


def is_null_like(text: Column, spellings: Sequence[str] = fixed.RULE_NULL_LIKE) -> Column:
    """True for null and for the given spellings of a missing value."""
    return F.coalesce(text.rlike(null_like_pattern(spellings)), F.lit(True))


def truncate_text(text: Column, limit: int) -> tuple[Column, Column]:
    """The first ``limit`` characters, and whether anything was left out."""
    return F.substring(text, 1, limit), F.coalesce(F.length(text) > limit, F.lit(False))


def safe_scalar(value: Column) -> Column:
    """Map NaN and infinities to null."""
    unusable = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~unusable, value)


def is_infinite(value: Column) -> Column:
    """True for values that ``safe_scalar`` drops as invalid (NaN is merely missing)."""
    return F.coalesce(F.abs(value) == float("inf"), F.lit(False))


def drop_urls(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("(?iU)" + fixed.URL_PATTERN), F.lit(" "))


def drop_email_like(text: Column) -> Column:
    masked = F.regexp_replace(text, F.lit("(?U)" + fixed.EMAIL_LIKE_PATTERN), F.lit(" "))
    return F.when(F.contains(text, F.lit("@")), masked).otherwise(text)


def drop_markers(text: Column, markers: Iterable[str] = fixed.REDACTION_MARKERS) -> Column:
    for marker in markers:
        text = F.replace(text, F.lit(marker), F.lit(" "))
    return text


def token_pattern(minimum_length: int = fixed.MINIMUM_TOKEN_LENGTH) -> str:
    """The token pattern, narrowed to tokens of at least ``minimum_length``.

    For lengths up to three the length test can live in the pattern: a run of
    letters shorter than that counts only if a joined part follows it. Runs are
    never given back, so possessive quantifiers save the backtracking.
    """
    if minimum_length <= 1:
        return fixed.TOKEN_PATTERN
    if minimum_length > 3:
        raise ValueError("use tokens() for longer minimum lengths")
    longest_short = minimum_length - 1
    return (
        rf"(?:[A-Za-z]{{{minimum_length},}}+|[A-Za-z]{{1,{longest_short}}}+(?=['-][A-Za-z]))(?:['-][A-Za-z]++)*+"
    )


def token_count(text: Column, minimum_length: int = fixed.MINIMUM_TOKEN_LENGTH) -> Column:
    """Number of tokens, counted without building an array."""
    if minimum_length <= 3:
        return F.regexp_count(text, F.lit(token_pattern(minimum_length))).cast("bigint")
    return F.size(tokens(text, minimum_length)).cast("bigint")


def tokens(text: Column, minimum_length: int = fixed.MINIMUM_TOKEN_LENGTH) -> Column:
    """Lower-cased tokens. They are ASCII, so normalisation reduces to lower case."""
    if minimum_length <= 3:
        return F.regexp_extract_all(F.lower(text), F.lit(token_pattern(minimum_length)), F.lit(0))
    found = F.regexp_extract_all(F.lower(text), F.lit(fixed.TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda token: F.length(token) >= minimum_length)


def non_ascii_letters(text: Column) -> Column:
    """Letters outside ASCII; plain runs are removed first, they are most of the text."""
    beyond_ascii = F.regexp_replace(text, F.lit(r"[\x00-\x7F]+"), F.lit(""))
    return F.length(F.regexp_replace(beyond_ascii, F.lit(r"[^\p{L}]+"), F.lit(""))).cast("bigint")


def ascii_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, F.lit("[^A-Za-z]+"), F.lit(""))).cast("bigint")


def word_tokens(text: Column) -> Column:
    """Distinct ``[a-z0-9]+`` words of a name or description."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def lexicon_counts(text: Column, forms: Mapping[str, Sequence[str]], whole_word: bool = True) -> dict[str, Column]:
    """Hits per category for suspected forms. Overlapping forms each count."""

    def pattern(form: str) -> str:
        quoted = "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in form)
        return rf"(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])" if whole_word else quoted

    counts = {}
    for category, suspected in forms.items():
        if not suspected:
            counts[category] = F.lit(0).cast("bigint")
            continue
        any_form = "(?iu)" + "|".join(pattern(form) for form in suspected)
        hits = sum(
            (F.regexp_count(text, F.lit("(?iu)" + pattern(form))) for form in suspected[1:]),
            F.regexp_count(text, F.lit("(?iu)" + pattern(suspected[0]))),
        )
        # One pass rules out most rows; only the rest pay for one pass per form.
        if len(suspected) > 1:
            hits = F.when(text.rlike(any_form), hits).otherwise(F.lit(0))
        counts[category] = F.coalesce(hits, F.lit(0)).cast("bigint")
    return counts


_PYTHON_WORD = r"\p{L}\p{N}_"
_PYTHON_SPACE = r"\s\x1c-\x1f"
_PYTHON_BORDER = f"(?:(?<=[{_PYTHON_WORD}])(?![{_PYTHON_WORD}])|(?<![{_PYTHON_WORD}])(?=[{_PYTHON_WORD}]))"
_PYTHON_CLASSES = {
    r"\b": _PYTHON_BORDER, r"\w": f"[{_PYTHON_WORD}]", r"\W": f"[^{_PYTHON_WORD}]", r"\s": f"[{_PYTHON_SPACE}]", r"\S": f"[^{_PYTHON_SPACE}]"}
# Java looks behind by whole characters only if its pattern holds one beyond the first plane. This one is always true.
_WHOLE_CHARACTERS = "(?![\U0001d7ce&&[^\U0001d7ce]])"


def python_pattern(pattern: str, flags: str = "U") -> str:
    """A pattern of Python's `re`, so that Java finds the same: its words have no marks and joiners but all kinds of numbers, its
    white space has the four separators of ASCII, and a digit before a match counts in every plane.
    """
    any_case = "i" in flags or pattern.startswith("(?i)")
    # Beside a digit one side of a border is known, and most places are passed over at once.
    pattern = re.sub(r"\\b(?=\\d)", lambda _: rf"(?=\d)(?<![{_PYTHON_WORD}])", pattern)
    pattern = re.sub(r"(\\d\{\d+\})\\b", lambda digits: rf"{digits[1]}(?![{_PYTHON_WORD}])", pattern)

    def written(part: re.Match) -> str:
        if part[0][0] != "[":
            return _PYTHON_CLASSES.get(part[0], part[0])
        inside = re.sub(r"\\.", lambda one: {r"\w": _PYTHON_WORD, r"\s": _PYTHON_SPACE}.get(one[0], one[0]), part[0])
        # A capital I with a dot is an i to both, but to Java only where small letters are listed.
        return inside.replace("A-Z", "A-Za-z") if any_case and "a-z" not in inside else inside

    return f"(?{flags})(?:{re.sub(r'\[\^?\]?(?:\\.|[^\]\\])*\]|\\.', written, pattern)}){_WHOLE_CHARACTERS}"


def redact_sample(text: Column) -> Column:
    """Replace personal data by labels and collapse whitespace, for review samples."""
    for label, pattern in fixed.SAMPLE_REDACTIONS:
        redacted = F.regexp_replace(text, F.lit(python_pattern(pattern)), F.lit(f"[{label}_REDACTED]"))
        text = F.when(F.contains(text, F.lit("@")), redacted).otherwise(text) if label == "EMAIL" else redacted
    return strip(F.regexp_replace(text, F.lit(rf"(?U)[{_PYTHON_SPACE}]+"), F.lit(" ")))


def split_topics(text: Column, delimiters: str = fixed.TOPIC_DELIMITERS) -> Column:
    """Parts of a multi-valued cell, trimmed, blanks dropped; the cell itself if none is left."""
    character_class = "[" + "".join(re.escape(ch) for ch in delimiters) + "]"
    parts = F.filter(
        F.transform(F.split(strip(text), character_class), strip), lambda part: F.length(part) > 0
    )
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(text)))


def topic_category(
    topic: Column, ontology: Sequence[tuple[int, str, Sequence[str]]], fallback: str = fixed.TOPIC_FALLBACK
) -> Column:
    """Name of the lowest-priority-number category whose pattern occurs in the topic."""
    if not ontology:
        return topic
    chosen = None
    for _, name, patterns in sorted(ontology, key=lambda entry: (entry[0], entry[1].casefold())):
        hit = topic.rlike("(?iU)" + "|".join(f"(?:{pattern})" for pattern in patterns))
        chosen = F.when(hit, F.lit(name)) if chosen is None else chosen.when(hit, F.lit(name))
    return chosen.otherwise(F.lit(fallback))

"""Row features shared by the transcript rules.

One projection adds every feature; Spark drops those no rule asks for. Counts
replace the text at once, so text never reaches a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance import fixed_values as fixed
from parlance.functions import pii, speakers
from parlance.functions import text as tx


def text_features(
    df: DataFrame,
    transcript: str,
    pii_patterns: Sequence[tuple[str, str, str]] = fixed.PII_PATTERNS,
    lexicon: Mapping[str, Sequence[str]] | None = None,
    speaker_labels: Mapping[str, Sequence[str]] = fixed.SPEAKER_LABELS,
    speaker_separators: Sequence[str] = fixed.SPEAKER_SEPARATORS,
    required_roles: Sequence[str] = fixed.REQUIRED_SPEAKER_ROLES,
    minimum_token_length: int = fixed.MINIMUM_TOKEN_LENGTH,
    characters: int | None = None,
    with_tokens: bool = False,
) -> DataFrame:
    """Add presence, character, token, speaker, personal-data and lexicon features.

    Whole texts are inspected unless ``characters`` sets a limit, in which case
    ``text_truncated`` tells which rows it touched.
    """
    text = tx.quoted(transcript)
    if characters is None:
        inspected, truncated = text, F.lit(False)
    else:
        inspected, truncated = tx.truncate_text(text, characters)
    is_present = tx.present(text)
    staged = df.withColumns(
        {
            "text_present": is_present,
            "text_truncated": truncated,
            "observed_characters": F.length(text).cast("bigint"),
            "inspected_text": F.when(is_present, inspected),
        }
    )
    body = F.col("inspected_text")
    options = {"labels": speaker_labels, "separators": speaker_separators}
    staged = staged.withColumns(
        {
            "token_text": pii.mask_before_tokens(body, pii_patterns),
            "speaker_labels_found": speakers.tag_labels(body, **options),
            "ascii_letter_count": F.coalesce(tx.ascii_letters(body), F.lit(0)),
            "non_ascii_letter_count": F.coalesce(tx.non_ascii_letters(body), F.lit(0)),
            "empty_turns": speakers.empty_turns(body, **options),
            **{f"pii_{name}": pii.match_count(body, name, pattern, check) for name, pattern, check in pii_patterns},
            **{f"lexicon_{name}": hits for name, hits in tx.lexicon_counts(body, lexicon or {}).items()},
        }
    )
    labels = F.col("speaker_labels_found")
    turns = {f"{role}_turns": speakers.role_turns(labels, role, speaker_labels) for role in speaker_labels}
    staged = staged.withColumns(
        {
            "token_count": F.coalesce(tx.token_count(F.col("token_text"), minimum_token_length), F.lit(0)),
            "total_turns": F.size(labels).cast("bigint"),
            **({"tokens": tx.tokens(F.col("token_text"), minimum_token_length)} if with_tokens else {}),
            **turns,
        }
    )
    roles_present = F.lit(True)
    for role in required_roles:
        roles_present = roles_present & (F.col(f"{role}_turns") > 0)
    return staged.withColumns(
        {
            "letter_count": F.col("ascii_letter_count") + F.col("non_ascii_letter_count"),
            "roles_present": roles_present,
        }
    ).drop("inspected_text", "token_text", "speaker_labels_found", "ascii_letter_count")

"""Queries over text functions, hashes and word counts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from harness import tables as tb
from parlance import fixed_values as fixed
from parlance.functions import hashing, pii
from parlance.functions import text as tx
from parlance.operators import lookups, vocabulary
from parlance.operators.features import text_features
from parlance.sources.storage import materialize

# The comparison engine has no look-around: boundaries are consumed there.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}([^A-Za-z0-9.-]|$)"
PHONE = r"(?:^|[^0-9])((?:\+?1[-.\s]?)?(?:\(?[0-9]{3}\)?[-.\s]?)[0-9]{3}[-.\s]?[0-9]{4})(?:$|[^0-9])"
CARD = r"(?:^|[^0-9])((?:[0-9][ -]?){13,19})(?:$|[^0-9])"
SSN = r"(?:^|[^0-9])([0-9]{3}-[0-9]{2}-[0-9]{4})(?:$|[^0-9])"
BIRTH = (
    r"(?i)\b(?:dob|date\s+of\s+birth|born)\s*(?:is|:|-)?\s*(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)[0-9]{2}\b"
)
URL = r"(?i)\b(?:https?://|www\.)\S+"
EMAIL_LIKE = r"\b\S+@\S+\b"
TOKEN = r"[A-Za-z]+(?:[''-][A-Za-z]+)*"
LABELS = "automated message|representative|associate|customer|advisor|caller|client|system|agent|other|user|ivr|rep"
TAG = rf"(?i)(?:^|\s)(?:\[\s*)?({LABELS})(?:\s*\])?\s*[:\-]"
WORD = r"\pL\pN_"


def token_text_sql(text: str) -> str:
    step = f"regexp_replace({text}, '{EMAIL}', ' \\1', 'g')"
    step = f"regexp_replace({step}, '{BIRTH}', ' ', 'g')"
    step = f"regexp_replace({step}, '{URL}', ' ', 'g')"
    step = f"regexp_replace({step}, '{EMAIL_LIKE}', ' ', 'g')"
    for marker in fixed.REDACTION_MARKERS:
        step = f"replace({step}, '{marker}', ' ')"
    return step


def tokens_sql(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({token_text_sql(text)}, '{TOKEN}'), lambda x: lower(x)), lambda x: length(x) >= 3)"


def luhn_sql(digits: str) -> str:
    doubled = f"cast(substr({digits}, length({digits}) - i + 1, 1) as int) * (case when i % 2 = 0 then 2 else 1 end)"
    return (
        f"(length({digits}) between 13 and 19 and list_sum(list_transform(range(1, length({digits}) + 1), "
        f"lambda i: case when {doubled} > 9 then {doubled} - 9 else {doubled} end)) % 10 = 0)"
    )


def numbers_sql(text: str, pattern: str) -> str:
    """Matches with consumed boundaries; a second look finds those whose boundary the first one used up."""
    return (
        f"list_concat(regexp_extract_all({text}, '{pattern}', 1), "
        f"regexp_extract_all(regexp_replace({text}, '{pattern}', '~', 'g'), '{pattern}', 1))"
    )


DIGITS = r"regexp_replace(m, '[^0-9]', '', 'g')"
PII_COUNTS_SQL = {
    "email": lambda t: f"len(regexp_extract_all({t}, '{EMAIL}'))",
    "phone": lambda t: f"len(list_filter({numbers_sql(t, PHONE)}, lambda m: length({DIGITS}) between 10 and 11))",
    "payment_card": lambda t: f"len(list_filter({numbers_sql(t, CARD)}, lambda m: {luhn_sql(DIGITS)}))",
    "us_ssn": lambda t: (
        f"len(list_filter({numbers_sql(t, SSN)}, lambda m: m[1:3] not in ('000', '666') and m[1:1] <> '9' "
        "and m[5:6] <> '00' and m[8:11] <> '0000'))"
    ),
    "date_of_birth": lambda t: f"len(regexp_extract_all({t}, '{BIRTH}'))",
}


def pii_sql(category: str, text: str) -> str:
    return f"cast(coalesce({PII_COUNTS_SQL[category](text)}, 0) as bigint)"


def calls_features(spark, folder, **options):
    return text_features(tb.calls(spark, folder), "transcript", lexicon=tb.LEXICON, **options)


CALLS = f"calls as ({tb.CALLS_SQL}), spoken as (select *, regexp_matches(coalesce(transcript, ''), '\\S') as text_present from calls)"


def transcript_presence(spark, folder):
    limited = text_features(tb.calls(spark, folder), "transcript", characters=1000)
    shortened, _ = tx.truncate_text(F.col("transcript"), 1000)
    return limited.select(
        "call_id", "text_present", "observed_characters", "text_truncated", F.length(shortened).cast("bigint").alias("kept")
    )


PRESENCE_SQL = f"""
with {CALLS}
select call_id, text_present, cast(length(transcript) as bigint) as observed_characters,
       coalesce(length(transcript) > 1000, false) as text_truncated, cast(case when transcript is not null then least(length(transcript), 1000) end as bigint) as kept from spoken
"""


def token_counts(spark, folder):
    return calls_features(spark, folder).select("call_id", "token_count")


TOKEN_COUNTS_SQL = f"""
with {CALLS}
select call_id, cast(case when text_present then len({tokens_sql('transcript')}) else 0 end as bigint) as token_count from spoken
"""


def token_frequencies(spark, folder):
    return calls_features(spark, folder, with_tokens=True).select(F.explode("tokens").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("occurrences")
    )


TOKEN_FREQUENCIES_SQL = f"""
with {CALLS}, w as (select unnest({tokens_sql('transcript')}) as word from spoken where text_present)
select word, count(*) as occurrences from w group by 1
"""


def page_token_counts(spark, folder):
    pages = tb.load(spark, folder, "pages")
    seen = pii.mask_before_tokens(F.concat_ws(" ", "url", "html"))
    return pages.select("page_id", tx.token_count(seen).alias("token_count"))


PAGE_TOKENS_SQL = f"select page_id, cast(len({tokens_sql('t')}) as bigint) as token_count from (select page_id, url || ' ' || html as t from pages)"


def letter_counts(spark, folder):
    return calls_features(spark, folder).select("call_id", "letter_count", "non_ascii_letter_count")


LETTERS_SQL = f"""
with {CALLS}
select call_id, cast(case when text_present then length(regexp_replace(transcript, '[^\\pL]', '', 'g')) else 0 end as bigint) as letter_count,
       cast(case when text_present then length(regexp_replace(transcript, '[^\\pL]|[A-Za-z]', '', 'g')) else 0 end as bigint) as non_ascii_letter_count
from spoken
"""


def pii_counts(spark, folder):
    names = [name for name, _, _ in fixed.PII_PATTERNS]
    return calls_features(spark, folder).select("call_id", *[f"pii_{name}" for name in names])


PII_SQL = f"with {CALLS} select call_id, " + ", ".join(
    f"case when text_present then {pii_sql(name, 'transcript')} else 0 end as pii_{name}" for name, _, _ in fixed.PII_PATTERNS
) + " from spoken"

ORDER_TEXT = (
    "concat('ssn ', lpad(cast(o_custkey % 1000 as string), 3, '0'), '-', lpad(cast(o_orderkey % 100 as string), 2, '0'), '-', "
    "lpad(cast(o_orderkey % 7 * 1111 as string), 4, '0'), ' card 4', lpad(cast(o_orderkey * 7919 as string), 15, '0'), "
    "case when o_orderkey % 3 = 0 then ' born ' when o_orderkey % 3 = 1 then ' DOB: ' else ' date of birth is ' end, "
    "lpad(cast(month(o_orderdate) as string), 2, '0'), '/', lpad(cast(day(o_orderdate) as string), 2, '0'), '/', cast(year(o_orderdate) as string))"
)


def validated_numbers(spark, folder):
    text = F.expr(ORDER_TEXT)
    counts = {name: pii.match_count(text, name, pattern, check) for name, pattern, check in fixed.PII_PATTERNS}
    return tb.load(spark, folder, "orders").select(
        "o_orderkey", *[counts[name].alias(name) for name in ("us_ssn", "payment_card", "date_of_birth")]
    )


VALIDATED_SQL = f"""
with t as (select o_orderkey, {ORDER_TEXT} as t from orders)
select o_orderkey, {', '.join(f"{pii_sql(name, 't')} as {name}" for name in ("us_ssn", "payment_card", "date_of_birth"))} from t
"""

ROLES = {
    "agent": "'agent','advisor','representative','rep','associate'",
    "customer": "'customer','caller','user','client'",
    "system": "'system','ivr','automated message','other'",
}


def speaker_sql(source: str, keys: str) -> str:
    roles = ", ".join(
        f"cast(len(list_filter(labels, lambda x: x in ({names}))) as bigint) as {role}_turns" for role, names in ROLES.items()
    )
    return f"""
select {keys}, text_present, cast(len(labels) as bigint) as total_turns, {roles},
       cast(len(list_filter(bodies[2:], lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13)) = '')) as bigint) as empty_turns
from (select *, case when text_present then list_transform(regexp_extract_all(transcript, '{TAG}', 1), lambda x: lower(x)) else [] end as labels,
             case when text_present then regexp_split_to_array(transcript, '{TAG}') else [] end as bodies from {source})
"""


TURNS = ("total_turns", "agent_turns", "customer_turns", "system_turns", "empty_turns")


def speaker_turns(spark, folder):
    return calls_features(spark, folder).select("call_id", "text_present", *TURNS)


SPEAKER_SQL = f"with {CALLS} {speaker_sql('spoken', 'call_id')}"


def exchange_speaker_turns(spark, folder):
    return text_features(tb.exchanges(spark, folder), "transcript").select("conv_id", "turn", "text_present", *TURNS)


EXCHANGE_SQL = f"with ex as (select *, true as text_present from ({tb.EXCHANGES_SQL})) {speaker_sql('ex', 'conv_id, turn')}"


def lexicon_sql(form: str, text: str) -> str:
    doubled = form.replace(" ", "  ")
    spread = f"regexp_replace(lower({text}), '([^{WORD}])', '\\1\\1', 'g')"
    return f"len(regexp_extract_all({spread}, '(?:^|[^{WORD}]){doubled}(?:$|[^{WORD}])'))"


def lexicon_category_sql(category: str, text: str) -> str:
    return " + ".join(lexicon_sql(form, text) for form in tb.LEXICON[category])


def lexicon_hits(spark, folder):
    return calls_features(spark, folder).select("call_id", *[f"lexicon_{name}" for name in tb.LEXICON])


LEXICON_SQL = f"with {CALLS} select call_id, " + ", ".join(
    f"cast(case when text_present then {lexicon_category_sql(name, 'transcript')} else 0 end as bigint) as lexicon_{name}"
    for name in tb.LEXICON
) + " from spoken"


def english_words(spark, folder):
    """Words seen at least five times in English documents; stored, since they are counted and then joined."""
    english = tb.load(spark, folder, "documents").where(F.col("lang") == "en")
    return materialize(vocabulary.frequent_words(english, "text", 5), "words")


WORDS_SQL = f"""
words as (select w as word from (select unnest(list_filter(list_transform(regexp_extract_all(text, '{TOKEN}'), lambda x: lower(x)), lambda x: length(x) >= 3)) as w
          from documents where lang = 'en') group by 1 having count(*) >= 5)
"""


def unknown_words(spark, folder):
    words = english_words(spark, folder)
    rows = calls_features(spark, folder, with_tokens=True)
    return vocabulary.unknown_word_counts(rows, ["call_id"], "tokens", words, vocabulary.vocabulary_size(words))


UNKNOWN_SQL = f"""
with {CALLS}, {WORDS_SQL},
e as (select call_id, unnest(case when text_present and len({tokens_sql('transcript')}) > 0 then {tokens_sql('transcript')} else [null] end) as token from spoken)
select call_id, count(token) as evaluated_words, count(token) filter (where word is null) as unknown_words
from e left join words on token = word group by 1
"""


def unknown_words_of_repeated_keys(spark, folder):
    """Counts by row under keys that repeat and are sometimes null."""
    words = english_words(spark, folder)
    rows = calls_features(spark, folder, with_tokens=True).withColumn(
        "shared_key", F.when(F.col("call_id") % 5 > 0, F.col("call_id") % 10))
    counted = vocabulary.with_unknown_words(rows, "tokens", words, vocabulary.vocabulary_size(words))
    return counted.select("call_id", "shared_key", "evaluated_words", "unknown_words")


def unknown_words_by_salted_join(spark, folder):
    """The same counts by the join used for vocabularies too large to broadcast."""
    words = english_words(spark, folder)
    rows = calls_features(spark, folder, with_tokens=True)
    size = vocabulary.vocabulary_size(words)
    return vocabulary.unknown_word_counts(rows, ["call_id"], "tokens", words, size, broadcast_words=0, salts=8)


# Words and pairs of unlike words of the documents, tens of thousands of them, as a look-up table of two categories.
LOOKUP_PIECES = r"[\pL\pN_]+"


def lookup_forms(spark, folder):
    characters, portions, cut, told_apart = lookups.word_characters(spark), lookups.portions, lookups.cut, lookups.told_apart

    def words_and_pairs(batches):
        for texts in (texts for batch in batches for texts in portions(batch.column(0))):
            pieces = cut(texts, characters)
            words = np.flatnonzero(pieces.is_word)
            _, single = told_apart([(pieces.code[words], pieces.codes)])
            first, second = words[:-1], words[1:]
            beside = (pieces.row[first] == pieces.row[second]) & (pieces.code[first] != pieces.code[second])
            first, second = first[beside], second[beside]
            _, double = told_apart([(pieces.code[first], pieces.codes), (pieces.code[second], pieces.codes)])
            pairs = pc.binary_join_element_wise(*[pieces.piece.take(pa.array(place[double])) for place in (first, second)], pa.scalar(" ", pa.large_string()))
            forms = pa.concat_arrays([pieces.piece.take(pa.array(words[single])), pairs])
            yield pa.RecordBatch.from_arrays([forms.cast(pa.string())], ["form"])

    lowered = tb.load(spark, folder, "documents").select(F.lower("text"))
    forms = lowered.mapInArrow(words_and_pairs, "form string")
    return forms.select(F.when(F.length("form") % 2 == 0, "even").otherwise("odd").alias("category"), "form")


def large_lookup_hits(spark, folder):
    """Hits of a look-up table with all words and pairs of the documents, in the calls made of these."""
    calls = tb.calls(spark, folder).select("call_id", "transcript")
    return lookups.with_lookup_hits(calls, "transcript", lookup_forms(spark, folder))


LARGE_LOOKUP_SQL = f"""
with c as ({tb.CALLS_SQL}),
d as (select list_filter(regexp_extract_all(lower(text), '{LOOKUP_PIECES}'), lambda x: x <> '') as w from documents),
forms as (select distinct f from (select unnest(w) as f from d union all
  select unnest(list_filter(list_transform(range(1, len(w)), lambda i: case when w[i] <> w[i + 1] then w[i] || ' ' || w[i + 1] end), lambda x: x is not null)) from d)),
p as (select call_id, regexp_extract_all(lower(transcript), '{LOOKUP_PIECES}|[^\\pL\\pN_]+') as p from c),
g as (select call_id, unnest(list_filter(p, lambda x: regexp_matches(x, '^{LOOKUP_PIECES}'))) as s from p
      union all select call_id, unnest(list_transform(list_filter(range(1, len(p) - 1), lambda i: p[i + 1] = ' '), lambda i: p[i] || ' ' || p[i + 2])) from p)
select call_id, count(*) filter (where length(f) % 2 = 0) as lexicon_even, count(*) filter (where length(f) % 2 = 1) as lexicon_odd
from c left join g using (call_id) left join forms on f = s group by call_id
"""


def unknown_words_by_hash(spark, folder):
    """The same counts where neither the vocabulary nor the unknown words may be sent to every task: a join on hashes, salted by frequency."""
    words = english_words(spark, folder)
    # Rows are stored on the way, so only what is asked for goes in.
    rows = calls_features(spark, folder, with_tokens=True).select("call_id", "tokens")
    size = vocabulary.vocabulary_size(words)
    counted = vocabulary.with_unknown_words(rows, "tokens", words, size, broadcast_words=16, tokens_per_salt=200)
    return counted.select("call_id", "evaluated_words", "unknown_words")


def glossary_words(spark, folder):
    return vocabulary.glossary_words(tb.load(spark, folder, "part"), "p_type")


GLOSSARY_SQL = "select distinct unnest(string_split_regex(lower(replace(p_type, '-', ' ')), '\\s+')) as word from part"


def redacted_texts(spark, folder):
    redacted = tx.redact_sample(F.col("text"))
    return tb.load(spark, folder, "documents").select(
        "doc_id", F.length(redacted).cast("bigint").alias("characters"), F.sha2(redacted, 256).alias("digest")
    )


REDACTED_SQL = r"""
with a as (select doc_id, regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[EMAIL_REDACTED]', 'g') as t from documents),
b as (select doc_id, regexp_replace(t, '\b[0-9]{3}-?[0-9]{2}-?[0-9]{4}\b', '[SSN_REDACTED]', 'g') as t from a),
c as (select doc_id, regexp_replace(regexp_replace(t, '(^|[^0-9])(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}($|[^0-9])', '\1[PHONE_REDACTED]\2', 'g'),
        '(^|[^0-9])(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}($|[^0-9])', '\1[PHONE_REDACTED]\2', 'g') as t from b),
d as (select doc_id, regexp_replace(regexp_replace(t, '(^|[^0-9])[0-9]{8,19}($|[^0-9])', '\1[LONG_NUMBER_REDACTED]\2', 'g'),
        '(^|[^0-9])[0-9]{8,19}($|[^0-9])', '\1[LONG_NUMBER_REDACTED]\2', 'g') as t from c),
e as (select doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) as t from d)
select doc_id, cast(length(t) as bigint) as characters, sha256(t) as digest from e
"""


def name_words(spark, folder):
    words = tx.word_tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return tb.load(spark, folder, "part").select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("parts"))


NAME_WORDS_SQL = """
with w as (select unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', p_name, p_type, p_brand)), '[a-z0-9]+'))) as word from part)
select word, count(*) as parts from w group by 1
"""


def row_hashes(spark, folder):
    return tb.load(spark, folder, "events").select(
        "event_id",
        hashing.row_fingerprint("events", F.col("event_id"), tb.SALT).alias("fingerprint"),
        hashing.value_hash(F.col("event_type"), "string").alias("type_hash"),
        hashing.value_hash(F.col("user_id"), "integer").alias("user_hash"),
        hashing.stable_id("ev-", 24, F.col("event_type"), F.col("user_id")).alias("stable_id"),
        hashing.sample_hash("events", F.col("event_id")).alias("sample_hash"),
    )


def _pads() -> tuple[str, str]:
    key = tb.SALT if len(tb.SALT) <= 64 else hashlib.sha256(tb.SALT).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def fingerprint_sql(source: str, key: str) -> str:
    inner, outer = _pads()
    return (
        f"'sha256:' || sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode('{source}:' || {key}))))"
    )


HASHES_SQL = f"""
select event_id, {fingerprint_sql('events', 'event_id')} as fingerprint, substr(sha256(cast(to_json(event_type) as varchar)), 1, 16) as type_hash,
       substr(sha256(cast(to_json(user_id) as varchar)), 1, 16) as user_hash, 'ev-' || substr(sha256(event_type || '|' || user_id), 1, 24) as stable_id,
       sha256('events|' || event_id) as sample_hash from events
"""

QUERIES = {
    "transcript_presence": transcript_presence,
    "token_counts": token_counts,
    "token_frequencies": token_frequencies,
    "page_token_counts": page_token_counts,
    "letter_counts": letter_counts,
    "pii_counts": pii_counts,
    "validated_numbers": validated_numbers,
    "speaker_turns": speaker_turns,
    "exchange_speaker_turns": exchange_speaker_turns,
    "lexicon_hits": lexicon_hits,
    "unknown_words": unknown_words,
    "unknown_words_by_salted_join": unknown_words_by_salted_join,
    "unknown_words_by_hash": unknown_words_by_hash,
    "large_lookup_hits": large_lookup_hits,
    "glossary_words": glossary_words,
    "unknown_words_of_repeated_keys": unknown_words_of_repeated_keys,
    "redacted_texts": redacted_texts,
    "name_words": name_words,
    "row_hashes": row_hashes,
}
ORACLES = {
    "transcript_presence": PRESENCE_SQL,
    "token_counts": TOKEN_COUNTS_SQL,
    "token_frequencies": TOKEN_FREQUENCIES_SQL,
    "page_token_counts": PAGE_TOKENS_SQL,
    "letter_counts": LETTERS_SQL,
    "pii_counts": PII_SQL,
    "validated_numbers": VALIDATED_SQL,
    "speaker_turns": SPEAKER_SQL,
    "exchange_speaker_turns": EXCHANGE_SQL,
    "lexicon_hits": LEXICON_SQL,
    "unknown_words": UNKNOWN_SQL,
    "unknown_words_by_salted_join": UNKNOWN_SQL,
    "unknown_words_by_hash": UNKNOWN_SQL,
    "large_lookup_hits": LARGE_LOOKUP_SQL,
    "glossary_words": GLOSSARY_SQL,
    "unknown_words_of_repeated_keys": f"select call_id, case when call_id % 5 > 0 then call_id % 10 end as shared_key, evaluated_words, unknown_words from ({UNKNOWN_SQL})",
    "redacted_texts": REDACTED_SQL,
    "name_words": NAME_WORDS_SQL,
    "row_hashes": HASHES_SQL,
}

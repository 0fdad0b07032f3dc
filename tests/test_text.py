"""Text functions against plain Python on awkward strings."""

import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F

from parlance import fixed_values as fixed
from parlance.functions import hashing, pii, speakers
from parlance.functions import text as tx
from parlance.operators.features import text_features

STRINGS = [
    "",
    "   \n\t",
    " ",
    "I'm on-line; it's A-B c'd ab abc.",
    "mail me: Foo.Bar+x@Example.com. or www.example.com/path?q=abc or HTTP://x.y/zed end",
    "call +1 (555) 123-4567 or 555.123.4567, not 15551234567890",
    "555-123-4567 555-123-4568 5551234567",
    "card 4111 1111 1111 1111 and 4111111111111112 and 4111-1111-1111-1111 4111111111111111",
    "ssn 123-45-6789 000-12-3456 666-12-3456 900-12-3456 123-00-6789 123-45-0000 1123-45-67890",
    "born 3/4/1987, DOB: 12-31-2001; date of  birth is 02/30/1950 born13/01/1990",
    "Agent: hi Customer: hello\nAgent:\nCustomer: bye",
    "[Agent] - hi\n[ customer ]: yes user-friendly agent:agent: x",
    "rep: a caller: b advisor: c",
    "no tags here, customer said: nothing",
    "Agent: Customer: both empty? ivr: ok",
    "[redacted] <redacted> *** token",
    "naïve café Ünïcode Straße 日本語 тест",
    "٠١٢-٣٤-٥٦٧٨ digits",
    "car member and Car Member, carmember car member's",
    "x" * 50 + "@" + "y" * 20 + ".com",
    "see http://x.com/5551234567/path and a@b.co",
]
LEXICON = {"term": ("car member", "naïve"), "phrase": ("and car", "member and")}


def reference(text):
    """What each feature should be, straight from the definitions."""
    present = bool(text and text.strip())
    if not present:
        return {"present": False}

    def digits(match):
        return "".join(ch for ch in match if ch.isdigit())

    def luhn(number):
        if not 13 <= len(number) <= 19:
            return False
        total = 0
        for position, ch in enumerate(reversed(number)):
            doubled = int(ch) * (2 if position % 2 else 1)
            total += doubled - 9 if doubled > 9 else doubled
        return total % 10 == 0

    def valid(match, validator):
        number = digits(match)
        if validator == "digit_count":
            return len(number) in (10, 11)
        if validator == "luhn":
            return luhn(number)
        if validator == "ssn_structure":
            return number[:3] not in ("000", "666") and number[0] != "9" and number[3:5] != "00" and number[5:] != "0000"
        return True

    counts, masked = {}, list(text)
    for name, pattern, validator in fixed.PII_PATTERNS:
        found = [m for m in re.finditer(pattern, text, re.I) if valid(m.group(0), validator)]
        counts[name] = len(found)
        for match in found:
            masked[match.start():match.end()] = " " * (match.end() - match.start())
    source = re.sub(fixed.URL_PATTERN, " ", "".join(masked), flags=re.I)
    source = re.sub(fixed.EMAIL_LIKE_PATTERN, " ", source)
    for marker in fixed.REDACTION_MARKERS:
        source = source.replace(marker, " ")
    tokens = [t.casefold() for t in re.findall(fixed.TOKEN_PATTERN, source) if len(t) >= 3]
    role_of = {label: role for role, labels in fixed.SPEAKER_LABELS.items() for label in labels}
    longest = "|".join(sorted(role_of, key=len, reverse=True))
    tags = list(re.finditer(rf"(?:^|(?<=\s))(?:\[\s*)?({longest})(?:\s*\])?\s*[:\-]\s*", text, re.I))
    ends = [tag.start() for tag in tags[1:]] + [len(text)]
    roles = [role_of[tag.group(1).casefold()] for tag in tags]
    lexicon = {
        name: sum(len(re.findall(rf"(?<!\w){re.escape(form)}(?!\w)", text, re.I)) for form in forms)
        for name, forms in LEXICON.items()
    }
    return {
        "present": True,
        "pii": counts,
        "tokens": tokens,
        "turns": len(tags),
        "roles": [roles.count(role) for role in ("agent", "customer", "system")],
        "empty": sum(not text[tag.end():end].strip() for tag, end in zip(tags, ends)),
        "letters": sum(ch.isalpha() for ch in text),
        "foreign": sum(ch.isalpha() and not ch.isascii() for ch in text),
        "lexicon": lexicon,
    }


@pytest.fixture(scope="module")
def features(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(STRINGS)], "id int, transcript string")
    featured = text_features(df, "transcript", lexicon=LEXICON, with_tokens=True)
    return {row["id"]: row for row in featured.collect()}


@pytest.mark.parametrize("position", range(len(STRINGS)))
def test_features_match_definitions(features, position):
    row, wanted = features[position], reference(STRINGS[position])
    assert row["text_present"] == wanted["present"]
    if not wanted["present"]:
        assert row["token_count"] == 0 and row["total_turns"] == 0
        return
    assert {name: row[f"pii_{name}"] for name in wanted["pii"]} == wanted["pii"]
    assert row["tokens"] == wanted["tokens"]
    assert row["token_count"] == len(wanted["tokens"])
    assert row["total_turns"] == wanted["turns"]
    assert [row[f"{role}_turns"] for role in ("agent", "customer", "system")] == wanted["roles"]
    assert row["empty_turns"] == wanted["empty"]
    assert row["letter_count"] == wanted["letters"]
    assert row["non_ascii_letter_count"] == wanted["foreign"]
    assert {name: row[f"lexicon_{name}"] for name in LEXICON} == wanted["lexicon"]


def test_token_lengths(spark):
    df = spark.createDataFrame([("a bb ccc dddd e-f g'hh",)], "t string")
    for length in (1, 2, 3, 4):
        found = df.select(tx.tokens(F.col("t"), length).alias("x"), tx.token_count(F.col("t"), length).alias("n")).first()
        wanted = [t for t in re.findall(fixed.TOKEN_PATTERN, "a bb ccc dddd e-f g'hh") if len(t) >= length]
        assert found["x"] == wanted and found["n"] == len(wanted)


def test_null_spellings(spark):
    values = [None, "", "  ", " NULL ", "None", "n/a", "NA", "not available", "nan", "unknown", "0", "nano"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    rule = [row[0] for row in df.select(tx.is_null_like(F.col("t"))).collect()]
    profile = [row[0] for row in df.select(tx.is_null_like(F.col("t"), fixed.PROFILE_NULL_LIKE)).collect()]
    assert rule == [True] * 9 + [False] * 3
    assert profile == [True] * 7 + [False, True] + [False] * 3


def test_redaction_and_truncation(spark):
    text = "write a.b@c.org,\n 123-45-6789 or 123456789 call 555 123 4567 id 1234567890123"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.redact_sample(F.col("t"))).first()[0] == (
        "write [EMAIL_REDACTED], [SSN_REDACTED] or [SSN_REDACTED] call [PHONE_REDACTED] id [LONG_NUMBER_REDACTED]"
    )
    kept, cut = tx.truncate_text(F.col("t"), 5)
    assert tuple(df.select(kept, cut).first()) == ("write", True)


# Digits beyond the first plane before a number, marks, joiners and kinds of numbers beside a word, and the separators of ASCII.
ODD = [
    "\U0001d7d1\U0001d7d7 \U0001d7d1363-690-8060 363-690-8060", "\U0001d7d0131-10-4361 131-10-4361", "\U0001d7d64111111111111111 4111111111111111",
    "555\x1c123\x1d4567 and 555\u00a0123\u20284567", "\u200dborn 01/02/1990\u200d", "e\u0301born 01/02/1990\u0301", "\u00bdborn 01/02/1990 born 01/02/1990\u00bd",
    "\u203fdob 1/2/1990\u203f date\x1fof\x1ebirth is 1/2/1990", "\u0130a@b\u017f.kom \u0130@b.co.\u0130\u0130", "\u00b2a.b@c.org\u00b2 \u200da.b@c.org\u0301 e\u0301a.b@c.org_",
    "\U00010400123-45-6789 \u2167123-45-6789 \u200d123-45-6789\u0301 123456789\u00b2", "\x1c a \x1d\u3000 b \x85", "\U0001d7ce12345678 12345678\U0001d7ce",
]


def test_personal_data_in_odd_scripts(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, t string")
    counts = [pii.match_count(F.col("t"), *pattern).alias(pattern[0]) for pattern in fixed.PII_PATTERNS]
    found = [row.asDict() for row in df.orderBy("id").select(*counts).collect()]
    assert found == [reference(text)["pii"] for text in ODD]


def test_redaction_in_odd_scripts(spark):
    def redacted(text):
        for label, pattern in fixed.SAMPLE_REDACTIONS:
            text = re.sub(pattern, f"[{label}_REDACTED]", text)
        return re.sub(r"\s+", " ", text).strip()

    texts = ODD + STRINGS
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [row[0] for row in df.orderBy("id").select(tx.redact_sample(F.col("t"))).collect()] == [redacted(text) for text in texts]


def test_topics(spark):
    df = spark.createDataFrame([("Pay bill| refund ;; ",), ("|;",), ("Late FEE > card",)], "t string")
    ontology = [(20, "Money", ("pay", "fee")), (10, "Refunds", ("refund",)), (30, "Cards", ("card",))]
    found = df.select(F.transform(tx.split_topics(F.col("t")), lambda part: tx.topic_category(part, ontology))).collect()
    assert [row[0] for row in found] == [["Money", "Refunds"], ["Other"], ["Money", "Cards"]]
    raw = df.select(F.transform(tx.split_topics(F.col("t")), lambda part: tx.topic_category(part, ()))).collect()
    assert raw[0][0] == ["Pay bill", "refund"]


@pytest.mark.parametrize("salt", [b"s", b"k" * 64, b"long" * 40])
def test_hmac(spark, salt):
    df = spark.createDataFrame([("src:1",), ("häß",)], "m string")
    found = [row[0] for row in df.select(hashing.hmac_sha256(F.col("m"), salt)).collect()]
    assert found == [hmac.new(salt, m.encode(), hashlib.sha256).hexdigest() for m in ("src:1", "häß")]


def test_value_hash_is_hash_of_json(spark):
    import json

    values = ['plain', 'quo"te', "tab\tnew\nline", "back\\slash", "ünï"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    found = [row[0] for row in df.select(hashing.value_hash(F.col("v"), "string")).collect()]
    assert found == [hashlib.sha256(json.dumps(v, ensure_ascii=False).encode()).hexdigest()[:16] for v in values]
    numbers = spark.createDataFrame([(7, 6.55)], "i bigint, d double")
    row = numbers.select(hashing.value_hash(F.col("i"), "integer"), hashing.value_hash(F.col("d"), "float")).first()
    assert list(row) == [hashlib.sha256(s.encode()).hexdigest()[:16] for s in ("7", "6.55")]


def test_salt_is_required():
    with pytest.raises(ValueError):
        hashing.hmac_sha256(None, b"")


def test_luhn_on_foreign_digits(spark):
    arabic = "".join(chr(0x660 + int(ch)) for ch in "4111111111111111")
    df = spark.createDataFrame([(arabic,), ("4111111111111111",), ("4111111111111112",)], "t string")
    assert [row[0] for row in df.select(pii.match_count(F.col("t"), *fixed.PII_PATTERNS[2])).collect()] == [1, 1, 0]


def test_other_separators(spark):
    df = spark.createDataFrame([("user-friendly agent: x",)], "t string")
    default = df.select(F.size(speakers.tag_labels(F.col("t")))).first()[0]
    colon = df.select(F.size(speakers.tag_labels(F.col("t"), separators=(":",)))).first()[0]
    assert (default, colon) == (2, 1)

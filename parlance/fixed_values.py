"""Fixed values.

The patterns, word lists, thresholds, weights and labels below decide results
and are therefore stated plainly. Every operator takes them as parameters, so a
deployment passes its own; these are only the defaults.
"""

# ---- text policy ------------------------------------------------------------
TOKEN_PATTERN = r"[A-Za-z]+(?:['-][A-Za-z]+)*"
URL_PATTERN = r"\b(?:https?://|www\.)\S+"
EMAIL_LIKE_PATTERN = r"\b\S+@\S+\b"
REDACTION_MARKERS = ("[redacted]", "<redacted>", "***")
MINIMUM_TOKEN_LENGTH = 3
MINIMUM_EVALUATED_TOKENS = 20
MINIMUM_VOCABULARY_SIZE = 500

# ---- missing-value spellings --------------------------------------------------
# The completeness rule counts "not available" as missing; the profile does not.
RULE_NULL_LIKE = ("", "null", "none", "nan", "n/a", "na", "not available")
PROFILE_NULL_LIKE = ("", "null", "none", "nan", "n/a", "na")

# ---- personal data: category, pattern, validator ------------------------------
PII_PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9.-])", "none"),
    ("phone", r"(?<!\d)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\d)", "digit_count"),
    ("payment_card", r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)", "luhn"),
    ("us_ssn", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", "ssn_structure"),
    (
        "date_of_birth",
        r"\b(?:dob|date\s+of\s+birth|born)\s*(?:is|:|-)?\s*"
        r"(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b",
        "none",
    ),
)

# ---- review-sample redaction, applied in this order ---------------------------
SAMPLE_REDACTIONS = (
    ("EMAIL", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("SSN", r"\b\d{3}-?\d{2}-?\d{4}\b"),
    ("PHONE", r"(?<!\d)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)"),
    ("LONG_NUMBER", r"(?<!\d)\d{8,19}(?!\d)"),
)
SAMPLE_CHARACTERS = 1200
SAMPLES_PER_STRATUM = 4
SAMPLES_IN_TOTAL = 24
SAMPLE_CHARACTER_BUDGET = 40000

# ---- profile text patterns -----------------------------------------------------
PROFILE_PATTERNS = (
    ("email_like", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("phone_like", r"(?<!\d)(?:\+?\d[\d .()-]{7,}\d)(?!\d)"),
    ("speaker_labels", r"(?i)(?:^|\n)\s*(?:agent|customer|caller|representative)\s*:"),
    ("pipe_delimited", r"\|"),
)
PROFILE_QUANTILES = (0.25, 0.5, 0.75, 0.95, 0.99)
PROFILE_DISTINCT_CAP = 50000
PROFILE_TOP_VALUES = 20
PROFILE_SAMPLES = 10

# ---- speaker labels ------------------------------------------------------------
SPEAKER_LABELS = {
    "agent": ("agent", "advisor", "representative", "rep", "associate"),
    "customer": ("customer", "caller", "user", "client"),
    "system": ("system", "ivr", "automated message", "other"),
}
SPEAKER_SEPARATORS = (":", "-")
REQUIRED_SPEAKER_ROLES = ("agent", "customer")

# ---- grouping ------------------------------------------------------------------
UNKNOWN_TIME = "__UNKNOWN_TIME__"
OTHER_TIME = "__OTHER_TIME__"
UNKNOWN_VALUE = "__UNKNOWN__"
OTHER_VALUE = "__OTHER__"
ALL_VALUES = "__ALL__"
ALL_TIMES = "__ALL_TIME__"
MAXIMUM_GROUPS = 5000
MAXIMUM_DIMENSIONS = 3
MAXIMUM_FILTERS = 10
MAXIMUM_FILTER_VALUES = 1000
CATEGORIES_PER_GROUP = 100
RESULT_DECIMALS = 6

# ---- evidence ------------------------------------------------------------------
EVIDENCE_PER_RULE_GROUP = 5
EVIDENCE_IN_TOTAL = 1000
FORBIDDEN_FIELD_NAMES = (
    r"(?i)(?:value|text|transcript|match|email|phone|card|account|customer|member"
    r"|token|password|secret|identifier|raw)"
)

# ---- rule thresholds -------------------------------------------------------------
FILL_RATE_PASS = 0.90
FILL_RATE_WARN = 0.70
DOMINANT_TOPIC_MAXIMUM = 0.8
MINIMUM_DISTINCT_TOPICS = 2
TOPIC_DELIMITERS = "|;,>"
TOPIC_FALLBACK = "Other"
DRIFT_EPSILON = 1e-8
DRIFT_STABLE_BELOW = 0.05
DRIFT_SIGNIFICANT_FROM = 0.15
MAXIMUM_INVALID_SPEAKER_RATE = 0.01
WPM_PASS = (40.0, 250.0)
WPM_WARN = (30.0, 300.0)
MINIMUM_DURATION = 1000.0
MAXIMUM_PII_RECORD_RATE = 0.0
MAXIMUM_LEXICON_RATE = 0.02
MAXIMUM_UNKNOWN_TOKEN_RATE = 0.05

# ---- rule identifiers: measured name -> reporting name ----------------------------
REPORTING_NAMES = {
    "agent_speaker_tag_validation": "speaker_tag_validation",
    "topic_distribution": "topic_drift",
    "speech_per_duration_rate": "transcript_duration_vs_size",
    "fill_rate": "fill_rate",
    "mistranslated_rate": "non_english_mistranscription",
    "pii_detection": "privacy_detection",
    "non_english_spelling": "spelling_validation",
}

# ---- the metric that stands for each rule in a summary ------------------------------
SUMMARY_METRICS = {
    "fill_rate": "fill_rate",
    "topic_distribution": "dominant_topic_share",
    "agent_speaker_tag_validation": "invalid_speaker_tag_rate",
    "non_english_spelling": "unknown_token_rate",
    "mistranslated_rate": "mistranslated_rate",
    "pii_detection": "pii_record_rate",
    "speech_per_duration_rate": "speech_words_per_minute",
}

# ---- score catalogue: rule, metric, weight, formula, bounds, population ---------------
# Bounds run from the worse to the better end for higher_is_better, from the better
# to the worse end for lower_is_better, and from outer-low to outer-high for inside_range.
SCORE_CATALOGUE = (
    ("agent_speaker_tag_validation", "invalid_speaker_tag_rate", 0.15, "lower_is_better_linear", (0.01, 0.1), "overall_preferred"),
    ("topic_distribution", "jensen_shannon_divergence", 0.15, "lower_is_better_linear", (0.05, 0.15), "grouped_required"),
    ("speech_per_duration_rate", "speech_words_per_minute", 0.1, "inside_range_linear", (30.0, 40.0, 250.0, 300.0), "overall_preferred"),
    ("fill_rate", "fill_rate", 0.15, "higher_is_better_linear", (0.7, 0.9), "overall_preferred"),
    ("mistranslated_rate", "mistranslated_rate", 0.1, "lower_is_better_linear", (0.02, 0.1), "overall_preferred"),
    ("pii_detection", "pii_record_rate", 0.2, "lower_is_better_linear", (0.0, 0.02), "overall_preferred"),
    ("non_english_spelling", "unknown_token_rate", 0.15, "lower_is_better_linear", (0.05, 0.2), "overall_preferred"),
)
SCORE_BANDS = (("excellent", 90.0), ("acceptable", 75.0), ("watch", 60.0), ("poor", 40.0), ("critical", 0.0))
MINIMUM_WEIGHT_COVERAGE = 0.7

# ---- assessment confidence -----------------------------------------------------------
CONFIDENCE_WEIGHTS = {
    "rule_coverage": 0.3,
    "metric_coverage": 0.25,
    "evidence_coverage": 0.15,
    "source_provenance": 0.15,
    "external_context_coverage": 0.15,
}
CONFIDENCE_MINIMUM_WEIGHT = 0.75
CONFIDENCE_EVIDENCE_COLLECTIONS = 3
CONFIDENCE_TRUNCATION_PENALTY = 0.1
CONFIDENCE_DECIMALS = 4
CONFIDENCE_MINIMUM_CITATIONS = 1

# ---- profile relationships -------------------------------------------------------------
IDENTIFIER_RATIO = 0.995
CATEGORICAL_RATIO = 0.05
PAIR_COVERAGE = 0.8
RELATIONSHIPS_KEPT = 250
FACTS_KEPT = 200
ROOT_CAUSES_KEPT = 10

# ---- column domains ------------------------------------------------------------------------
DOMAIN_WEIGHTS = {
    "metadata_description": 0.35,
    "column_name": 0.30,
    "observed_pattern": 0.20,
    "logical_data_type": 0.10,
    "related_columns": 0.05,
}
DOMAIN_MINIMUM = 0.55
DOMAIN_HIGH = 0.8
DOMAIN_AMBIGUITY = 0.1
DOMAIN_UNMATCHED = "unknown"

# ---- signals: check, metric, domains, minimum distinct topics, bands (first match wins) ------
SIGNAL_MINIMUM_ROWS = 100
SIGNAL_POLICIES = (
    {
        "policy_id": "fill-rate", "check_name": "fill_rate", "metric": "fill_rate", "domains": ("*",),
        "bands": (("lt", 0.8, None, "critical", "LOW_FILL_RATE"), ("lt", 0.95, None, "high", "LOW_FILL_RATE"),
                  ("lt", 0.99, None, "medium", "LOW_FILL_RATE")),
        "message": "Column %s is filled at %.2f%%, below the expected %.2f%%.",
    },
    {
        "policy_id": "topic-concentration", "check_name": "topic_distribution", "metric": "dominant_topic_share",
        "domains": ("conversation.topic",), "minimum_distinct": 2,
        "bands": (("gt", 0.95, None, "high", "EXTREME_TOPIC_CONCENTRATION"),
                  ("gt", 0.8, None, "medium", "HIGH_TOPIC_CONCENTRATION")),
        "message": "In column %s one topic covers %.2f%% of rows, above the expected %.2f%%.",
    },
    {
        "policy_id": "speaker-tags", "check_name": "agent_speaker_tag_validation", "metric": "invalid_speaker_tag_rate",
        "domains": ("conversation.transcript", "conversation.speaker"),
        "bands": (("gt", 0.1, None, "critical", "INVALID_SPEAKER_TAGS"), ("gt", 0.03, None, "high", "INVALID_SPEAKER_TAGS"),
                  ("gt", 0.01, None, "medium", "INVALID_SPEAKER_TAGS")),
        "message": "Speaker tags in %s are invalid at %.2f%%, above %.2f%%.",
    },
    {
        "policy_id": "unknown-tokens", "check_name": "non_english_spelling", "metric": "non_english_or_unknown_token_rate",
        "domains": ("conversation.transcript",),
        "bands": (("gt", 0.2, None, "high", "HIGH_NON_ENGLISH_TOKEN_RATE"),
                  ("gt", 0.05, None, "medium", "ELEVATED_NON_ENGLISH_TOKEN_RATE")),
        "message": "Unknown words in %s make up %.2f%%, above %.2f%%.",
    },
    {
        "policy_id": "mistranscription", "check_name": "mistranslated_rate", "metric": "suspected_mistranslated_token_rate",
        "domains": ("conversation.transcript",),
        "bands": (("gt", 0.1, None, "high", "HIGH_MISTRANSLATED_RATE"), ("gt", 0.02, None, "medium", "ELEVATED_MISTRANSLATED_RATE")),
        "message": "Suspected mistranscriptions in %s make up %.2f%%, above %.2f%%.",
    },
    {
        "policy_id": "personal-data", "check_name": "pii_detection", "metric": "records_with_pii_rate",
        "domains": ("conversation.transcript", "party.customer"),
        "bands": (("gt", 0.01, None, "critical", "PII_EXPOSURE_DETECTED"), ("gt", 0.001, None, "high", "PII_EXPOSURE_DETECTED"),
                  ("gt", 0.0, None, "medium", "PII_EXPOSURE_DETECTED")),
        "message": "Personal data was found in %s at %.2f%%, above %.2f%%.",
    },
    {
        "policy_id": "speech-rate", "check_name": "speech_per_duration_rate", "metric": "speech_words_per_minute",
        "domains": ("conversation.transcript", "interaction.duration"),
        "bands": (("outside_inclusive", 30.0, 300.0, "high", "IMPLAUSIBLE_SPEECH_RATE"),
                  ("outside_inclusive", 60.0, 220.0, "medium", "UNUSUAL_SPEECH_RATE")),
        "message": "Speech rate over %s is %.2f words per minute, outside the range from %.2f to %.2f.",
        "message_scale": 1.0,
    },
)
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
REQUIRED_CHECKS = (
    "fill_rate", "topic_distribution", "agent_speaker_tag_validation", "non_english_spelling",
    "mistranslated_rate", "pii_detection", "speech_per_duration_rate",
)

# ---- impact conditions: rule, metric, outcomes, dimensions, review -----------------------------
IMPACT_CONDITIONS = (
    ("speaker_tag_validation_degraded", "agent_speaker_tag_validation", "invalid_speaker_tag_rate", ("failed", "warning"),
     ("interaction_analytics_reliability", "model_and_rule_input_quality"), "speaker-attribution-quality-degraded", False),
    ("topic_drift_significant", "topic_distribution", "jensen_shannon_divergence", ("failed", "warning"),
     ("operational_monitoring", "interaction_analytics_reliability"), "topic-distribution-change-observed", False),
    ("duration_size_plausibility_degraded", "speech_per_duration_rate", "speech_words_per_minute", ("failed", "warning"),
     ("data_integrity", "model_and_rule_input_quality"), "transcript-duration-plausibility-degraded", False),
    ("fill_rate_degraded", "fill_rate", "fill_rate", ("failed", "warning"),
     ("data_integrity", "operational_monitoring", "model_and_rule_input_quality"), "structured-data-completeness-degraded", False),
    ("mistranscription_degraded", "mistranslated_rate", "mistranslated_rate", ("failed", "warning"),
     ("interaction_analytics_reliability", "model_and_rule_input_quality"), "transcript-lexicon-quality-degraded", False),
    ("privacy_detection_observed", "pii_detection", "pii_record_rate", ("failed",),
     ("privacy_and_data_handling", "data_integrity"), "privacy-review-required", True),
    ("spelling_validation_degraded", "non_english_spelling", "unknown_token_rate", ("failed", "warning"),
     ("interaction_analytics_reliability", "model_and_rule_input_quality"), "transcript-token-quality-degraded", False),
)

# ---- recommendations: id, condition, priority, review, title --------------------------------------
RECOMMENDATIONS = (
    ("rec-speaker-tag-review", "speaker_tag_validation_degraded", "high", False, "Check how speaker tags are extracted"),
    ("rec-topic-drift-review", "topic_drift_significant", "medium", False, "Confirm the change in topic mix"),
    ("rec-duration-size-calibration", "duration_size_plausibility_degraded", "medium", False, "Check duration units and truncation"),
    ("rec-completeness-remediation", "fill_rate_degraded", "high", False, "Fix the largest completeness gaps"),
    ("rec-transcript-lexicon-review", "mistranscription_degraded", "medium", False, "Review suspected mistranscriptions"),
    ("rec-privacy-controlled-review", "privacy_detection_observed", "critical", True, "Start a controlled privacy review"),
    ("rec-spelling-quality-review", "spelling_validation_degraded", "medium", False, "Review vocabulary coverage"),
)

# Semantic types by domain, as results name them, and those that may be neither filtered by nor grouped by.
SEMANTIC_TYPES = {
    "conversation.transcript": ("raw_transcript", "clean_transcript", "corrected_transcript", "transcript_summary", "utterance_timeline"),
    "conversation.speaker": ("agent_identifier", "agent_name", "agent_group", "agent_supervisor", "speaker_tag"),
    "interaction.identifier": ("interaction_id", "call_id", "workflow_id", "batch_id", "source_id"),
    "party.customer": ("customer_identifier", "membership_number", "customer_state"),
    "interaction.time": ("interaction_date", "interaction_timestamp", "ingestion_timestamp", "source_timestamp", "update_timestamp"),
    "interaction.duration": ("media_duration", "speech_duration", "non_speech_duration", "cross_talk_duration", "segment_count", "transcript_length"),
    "conversation.topic": ("topic_id", "topic_name", "topic_description", "demand_prediction"),
    "conversation.sentiment": ("sentiment_score", "sentiment_minimum", "sentiment_maximum", "sentiment_transition", "sentiment_interval"),
    "product": ("product_code", "product_description"),
    "platform.lineage": ("input_file", "lineage", "access_control", "lifecycle_event", "model_metadata"),
}
FORBIDDEN_SEMANTIC_TYPES = ("transcript", "free_text", "customer_identifier", "interaction_identifier", "pii", "secret")

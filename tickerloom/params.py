"""Run parameters. Operators take these explicitly and read no clock and no global."""

from __future__ import annotations

from dataclasses import dataclass, field


# Default scoring weights, tag boosts, flags and look-backs.
@dataclass(frozen=True)
class ScoreParams:
    w_sentiment: float = 0.4
    w_novelty: float = 0.3
    w_velocity: float = 0.3
    boosts: dict[str, float] = field(
        default_factory=lambda: {"earnings": 0.2, "guidance": 0.1, "mna": 0.25}
    )
    rising_velocity_z: float = 2.0
    fresh_novelty: float = 0.6
    novelty_hours: int = 24
    velocity_days: int = 30
    contributors: int = 2


# Confidence by link method (our choice where none is prescribed).
LINK_CONFIDENCE = {"cashtag": 0.95, "dict": 0.7, "synonym": 0.6}

# Domains of the enumerated columns.
SOURCES = ["gdelt", "sec", "stocktwits", "twitter", "reddit"]
LINK_METHODS = ["cashtag", "dict", "synonym", "ner"]
TIMEFRAMES = ["1d", "1h", "1m"]
# A cashtag starts and ends with a letter and stands alone; a dot or dash after it is punctuation.
CASHTAG_PATTERN = r"(?<![\p{L}\p{Nd}$])\$([A-Z](?:[A-Z.\-]{0,8}[A-Z])?)(?![\p{L}\p{Nd}])"
TICKER_PATTERN = r"\A[A-Z.\-]{1,10}\z"

# Base credibility by source, and the bonus per present attribute.
CREDIBILITY_BASE = {"sec": 90.0, "gdelt": 70.0, "stocktwits": 40.0, "twitter": 35.0, "reddit": 30.0}
CREDIBILITY_OTHER = 50.0
CREDIBILITY_BONUS = {"author": 5.0, "license": 3.0, "https": 2.0}

# Tracking parameters that a canonical URL drops.
UTM_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]

# Filing forms kept by default, and the tag each form implies (ours).
SEC_FORMS = ["8-K", "10-Q", "10-K"]
FORM_TAGS = {"8-K": "guidance", "10-Q": "earnings", "10-K": "earnings"}

# Default keyword rules for event tags (ours).
TAG_RULES = {
    "earnings": r"(?i)\b(earnings|quarterly results|eps)\b",
    "guidance": r"(?i)\b(guidance|outlook|forecast)\b",
    "mna": r"(?i)\b(merger|acquisition|acquires|takeover)\b",
}

# Default sentiment lexicon (ours).
POSITIVE_WORDS = ["beat", "beats", "gain", "gains", "growth", "profit", "record", "rise", "rises", "strong", "up"]
NEGATIVE_WORDS = ["cut", "decline", "down", "fall", "falls", "fraud", "loss", "losses", "miss", "misses", "weak"]

# Frequent function words used to guess a missing language (ours).
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with"],
    "fr": ["le", "la", "les", "des", "et", "que", "dans", "pour", "une", "qui"],
    "de": ["der", "die", "und", "das", "nicht", "ist", "ein", "zu", "den", "mit"],
    "es": ["el", "los", "las", "que", "del", "por", "una", "con", "para", "como"],
}

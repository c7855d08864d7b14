"""Tuning constants of linkage and extraction."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    match_threshold: float = 82.0
    ambiguity_margin: float = 4.0
    candidate_limit: int = 8
    min_trigram_similarity: float = 0.2
    low_confidence_threshold: float = 60.0
    strength_match_bonus: float = 8.0
    strength_mismatch_penalty: float = 25.0
    form_mismatch_penalty: float = 15.0
    source_priority_bonus: float = 2.0
    max_document_bytes: int = 15 * 1024 * 1024
    max_pages: int = 20
    #: parse strengths from the raw text, where normalization would take the decimal point away
    decimal_safe: bool = False
    #: never accept a product whose strength or form differs from the stated one, by any stage
    strict_strength: bool = False


DEFAULTS = Settings()

# Source -> priority, lower first; any other source has OTHER_PRIORITY.
SOURCE_PRIORITY = {"legacy_manual": 0, "abdm": 1, "licensed_india": 1, "rxnorm": 2}
OTHER_PRIORITY = 99
#: Version tag of catalog names of which nobody knows whether they are brands or generics.
UNCLASSIFIED = "unclassified_name"

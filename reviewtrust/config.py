"""Every threshold the operators use, in one frozen settings object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScoreWeights:
    customer_experience: float = 0.25
    review_reliability: float = 0.15
    recurring_complaints: float = 0.15
    external_evidence: float = 0.15
    claim_consistency: float = 0.15
    evidence_confidence: float = 0.15


@dataclass(frozen=True)
class Settings:
    # collection
    review_cap: int = 150
    max_pages: int = 12
    min_reviews: int = 5
    min_text_chars: int = 8
    # near duplicates
    duplicate_similarity: float = 0.55
    top_clusters: int = 8
    cluster_ids_shown: int = 12
    cluster_sample_chars: int = 160
    similar_ids_shown: int = 5
    # submission pacing
    pacing_min_dated: int = 8
    burst_multiplier: float = 2.5
    min_burst: int = 3
    dominant_share: float = 0.6
    min_spread: float = 0.5
    # suspicion
    filter_enabled: bool = True
    filter_threshold: float = 0.5
    weight_duplicate: float = 0.55
    weight_contentless: float = 0.52
    weight_burst: float = 0.30
    weight_unverified: float = 0.12
    # scoring
    weights: ScoreWeights = field(default_factory=ScoreWeights)
    volume_target: int = 12
    confident_min_reviews: int = 12
    strong_min_reviews: int = 35
    divergence_spread: float = 0.7
    # sampling and prompt text
    prompt_max_reviews: int = 60
    prompt_review_chars: int = 700
    evidence_shown: int = 8
    # videos
    video_min_seconds: int = 120
    video_limit: int = 6
    video_relevance: float = 0.45
    # matching
    match_threshold: float = 0.62
    # results and jobs
    ttl_hours: int = 24
    ttl_thin_hours: int = 1
    job_timeout_s: int = 120
    inflight_ttl_s: int = 150
    job_result_ttl_s: int = 300
    job_events_kept: int = 200
    worker_ttl_s: int = 30
    rate_limit: int = 20
    rate_window_s: int = 60


DEFAULTS = Settings()

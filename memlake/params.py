"""Thresholds of the retrieval, curation and outcome operators. Every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """The defaults that results depend on, in the groups in which operators use them."""

    # composite score
    w_similarity: float = 0.50
    w_confidence: float = 0.0
    w_keywords: float = 0.15
    w_recency: float = 0.0
    w_scope: float = 0.05
    half_life_days: float = 30.0
    scope_exempt: tuple[str, ...] = ("person", "preference")
    # retrieval gates
    garbage_gate: float = 0.45
    borderline_similarity: float = 0.35
    borderline_score: float = 0.50
    relative_ratio: float = 0.7
    dominance: float = 0.05
    diversity_jaccard: float = 0.85
    max_entries: int = 5
    # fusion
    rrf_k: int = 60
    rrf_weight: float = 0.20
    fts_similarity: float = 0.35
    global_floor: float = 0.60
    reference_similarity: float = 0.56
    scope_limit: int = 7
    weak_entry: float = 0.4
    thin_entries: int = 3
    thin_similarity: float = 0.45
    # rerank
    rerank_weight: float = 0.6
    rerank_active: int = 12
    rerank_archived: int = 6
    rerank_floor: float = -3.0
    # keyword overlap
    keyword_least: int = 2
    keyword_ratio: float = 0.25
    # curation
    dedup: float = 0.95
    variant: float = 0.8
    negation_floor: float = 0.6
    cluster: float = 0.85
    cluster_least: int = 2
    cluster_most: int = 10
    contradiction: float = 0.70
    contradiction_pairs: int = 2000
    # confidence
    confidence_start: float = 0.7
    confidence_step: float = 0.1
    # engagement
    idf_floor: float = 0.5
    engaged_terms: int = 2
    semantic_threshold: float = 0.55
    semantic_margin: float = 0.05
    # experiments
    arm_least: int = 30
    arm_gap: float = 15.0
    graded_least: int = 40
    grade_gain: float = 0.05
    grade_loss: float = -0.20
    # suppression
    suppress_delivered: int = 10
    suppress_corrections: int = 25
    suppress_scored: int = 3


DEFAULTS = Params()

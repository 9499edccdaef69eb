"""Tunable numbers of retrieval, reading and answering, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    k1: float = 1.2
    b: float = 0.75
    dense_weight: float = 0.6  # home index
    dense_weight_wide: float = 0.75  # encyclopedia index
    fuzzy_weight: float = 0.5
    candidates: int = 64
    per_article: int = 2
    top: int = 8
    prerank: int = 24  # clamped to 8..32
    prerank_coverage: float = 0.15
    prerank_phrase: float = 0.3
    read_top: int = 8
    weight_retrieval: float = 12.0
    weight_coverage: float = 15.0
    weight_vote: float = 0.5
    weight_title: float = 3.0
    weight_phrase: float = 0.0
    accept: float = 0.45
    title_margin: float = -6.0
    df_cap_floor: int = 1000
    df_cap_share: float = 0.05
    history: int = 6
    repetition_penalty: float = 1.08

    @property
    def prerank_clamped(self) -> int:
        return max(8, min(32, self.prerank))


DEFAULT = RetrievalConfig()

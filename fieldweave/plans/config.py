"""Switches of a run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """``benchmark`` records times, ``incremental`` writes the combined results, ``cache`` reads and writes stored results.

    ``batches`` cuts the entries, in order, into parts that run one after the other: each sees what those before it
    learned from the provider's answers.
    """

    benchmark: bool = False
    incremental: bool = True
    cache: bool = True
    batches: int = 1

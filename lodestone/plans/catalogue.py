"""All queries: importing the plan modules registers them."""

from __future__ import annotations

from lodestone.plans import answers, build, chunks, evaluation, languages, models, replay, reporting, retrieval, reviews, search  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

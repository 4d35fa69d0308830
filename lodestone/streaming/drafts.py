"""Answer streams as they arrive: the live draft of each request and its first-token time.

State per request is the growing draft; a reset empties it.  The batch form of the same
result is ``lodestone.operators.events.last_draft``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "request string, drafts long, tokens long, text string, first_token_at double"
STATE = "drafts long, parts array<string>, first_token_at double"


def live_drafts(events: DataFrame, request: str, kind: str, order: str, seconds: str, payload: str, token: str = "token", reset: str = "reset") -> DataFrame:
    """After each micro-batch, the current draft of every request that it touched (update mode)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        drafts, parts, first = state.get if state.exists else (1, [], None)
        parts = list(parts)
        rows = pd.concat(list(batches)).sort_values("o")
        for k, s, p in zip(rows["k"], rows["s"], rows["p"], strict=True):
            if k == reset:
                drafts, parts = drafts + 1, []
            elif k == token:
                parts.append(p)
                first = s if first is None else first
        state.update((drafts, parts, first))
        yield pd.DataFrame({"request": [key[0]], "drafts": [drafts], "tokens": [len(parts)], "text": [" ".join(parts)], "first_token_at": [first]})

    rows = events.select(
        F.col(request).cast("string").alias("request"), F.col(kind).alias("k"), F.col(order).alias("o"), F.col(seconds).cast("double").alias("s"), F.col(payload).cast("string").alias("p")
    )
    return rows.groupBy("request").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def event_rates(events: DataFrame, at: str, kind: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events of each kind in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count("*").alias("n"))

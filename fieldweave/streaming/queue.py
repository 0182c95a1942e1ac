"""The queue of a label as a stream: documents arrive, find their layout or lead a new one.

State per label is its leaders' fingerprints only. A document that comes again (a replay after a failure)
is answered as before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed

_ALL = (1 << 64) - 1
OUT, STATE = "doc_id long, label string, leader long, is_leader boolean", "leaders array<struct<doc_id: long, full: long, left: long, right: long>>"


def _far(a: int, b: int) -> int:
    return ((int(a) ^ int(b)) & _ALL).bit_count()


def assign(label: str, rows: pd.DataFrame, leaders: list[tuple]) -> tuple[pd.DataFrame, list[tuple]]:
    """One batch of a label in order of ``doc_id``, and the leaders after it."""
    out = []
    for r in rows.sort_values("doc_id").itertuples(index=False):
        near = []
        for who, full, left, right in leaders:
            whole, half = _far(r.full, full), min(_far(r.left, left), _far(r.right, right))
            if who == r.doc_id or (whole < fixed.FULL_THRESHOLD and half < fixed.HALF_THRESHOLD):
                near.append((-1 if who == r.doc_id else whole + half, len(near), who))
        if not near:
            leaders.append((r.doc_id, r.full, r.left, r.right))
        out.append((r.doc_id, label, min(near)[2] if near else r.doc_id, not near or min(near)[2] == r.doc_id))
    return pd.DataFrame(out, columns=["doc_id", "label", "leader", "is_leader"]), leaders


def label_queues(stream: DataFrame) -> DataFrame:
    """A stream ``doc_id, label, full, left, right`` to ``doc_id, label, leader, is_leader``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        leaders = [tuple(x) for x in state.get[0]] if state.exists else []
        out, leaders = assign(key[0], pd.concat(list(batches)), leaders)
        state.update((leaders,))
        yield out

    rows = stream.select("doc_id", "label", "full", "left", "right").where(F.col("full").isNotNull())
    return rows.groupBy("label").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and mean of ``value`` per window and group; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))

"""The activity-spike detector on a stream: each finished window of an entity against the one directly before it."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inquest.functions.numbers import severity
from inquest.operators.anomaly import Z

_FOUND = ["entity_id", "window_start", "peak_start", "peak_count", "baseline_mean", "baseline_std", "z_like_score"]
_TYPES = "entity_id string, window_start long, peak_start long, peak_count long, baseline_mean double, baseline_std double, z_like_score double"


def _spike(entity: str, counts: dict[int, int], begin: int, window: int, n: int) -> tuple:
    """A window's busiest bucket, the earliest of equals, against mean and deviation of the window before, empty buckets included."""
    inside = [(c, -b) for b, c in counts.items() if begin <= b < begin + window]
    peak, at = max(inside)
    before = [c for b, c in counts.items() if begin - window <= b < begin]
    mean = sum(before) / n
    std = sqrt(max(0.0, sum(c * c for c in before) / n - mean * mean))
    return entity, begin, -at, peak, mean, std, (peak - mean) / (std + 1)


def activity_spikes(events: DataFrame, window: int = 1440, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """A stream of events (entity_id, event_id, at) -> ACTIVITY_SPIKE findings: entity_id, window_start, peak_start, peak_count, baseline mean and deviation, score, severity.

    Windows of `window` minutes (a multiple of `minutes`, those of the buckets) begin at multiples of it since 1970. A
    window is judged once the watermark has passed its end, with the same numbers that the batch detector gives for it and
    the window before. An event counts once within the watermark. Rows behind the watermark are late: they are dropped, as
    are rows of a window that is already judged. An entity's state is the counts per bucket of its open windows and of
    the last finished one; it goes when a whole window passes without events. Null entities and times are passed over.
    """
    if window % minutes:
        raise ValueError("the window must be a multiple of the bucket")
    span, size = window * 60, minutes * 60

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, numbers, judged = state.get if state.exists else ([], [], 0)
        counts = dict(zip(starts, numbers))
        if not state.hasTimedOut:
            for part in parts:
                seconds = part["seconds"].to_numpy()
                for b, n in zip(*_tally(seconds[seconds >= judged] // size * size)):
                    counts[b] = counts.get(b, 0) + n
        mark = state.getCurrentWatermarkMs() // 1000
        done = mark // span * span
        found = [_spike(key[0], counts, w, span, span // size) for w in sorted({b // span * span for b in counts}) if judged <= w < done]
        judged = max(judged, done)
        counts = {b: n for b, n in counts.items() if b >= judged - span}
        if counts:
            state.update((list(counts), list(counts.values()), judged))
            state.setTimeoutTimestamp((max(min(b // span * span for b in counts) + span, mark // span * span + span)) * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=_FOUND)

    once = events.where("entity_id is not null and at is not null").withWatermark("at", late).dropDuplicatesWithinWatermark(["entity_id", "event_id"])
    keyed = once.select("entity_id", "at", F.unix_seconds("at").alias("seconds")).groupBy("entity_id")
    found = keyed.applyInPandasWithState(step, _TYPES, "starts array<long>, numbers array<long>, judged long", "append", GroupStateTimeout.EventTimeTimeout)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("z_like_score") / Z))
    at = lambda c: F.timestamp_seconds(c).alias(c)
    return found.select("entity_id", at("window_start"), at("peak_start"), "peak_count", "baseline_mean", "baseline_std", score.alias("score"), severity(score).alias("severity")).where("score > 0")


def _tally(values) -> tuple[list[int], list[int]]:
    counted = pd.Series(values).value_counts()
    return [int(b) for b in counted.index], [int(n) for n in counted]

"""The spike detector on a stream: the batch detector's findings on finished windows, late rows, restarts."""

import datetime as dt
import random

import pytest

from inquest.operators import anomaly
from inquest.streaming import activity, spikes

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "entity_id string, event_id long, at timestamp"


def batch(spark, rows, window_start, hours=6):
    """Findings of the batch detector for one window."""
    events = spark.createDataFrame([(i, at, at, e, None) for e, i, at in rows], "event_id long, start_at timestamp, end_at timestamp, source_entity_id string, target_entity_id string")
    span = dt.timedelta(hours=hours)
    found = anomaly.activity_spikes(events, (window_start, window_start + span - anomaly.MICRO), (window_start - span, window_start - anomaly.MICRO), 60)
    return {(r.entity_id, window_start, r.peak_start, r.peak_count, round(r.baseline_mean, 9), round(r.baseline_std, 9), round(r.score, 9), r.severity) for r in found.collect()}


def test_stream_finds_what_the_batch_detector_finds(spark, tmp_path):
    rng = random.Random(6)
    source, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))
    rows = [(rng.choice("aaabc"), k, DAY + dt.timedelta(hours=36 * rng.random() ** 0.7)) for k in range(400)]
    rows += [("burst", 1000 + k, DAY + dt.timedelta(hours=13, minutes=k)) for k in range(20)] + [("gone", 2000, DAY)]
    rows.sort(key=lambda r: r[2])

    def feed(some):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spikes.activity_spikes(activity.read_events(spark, source, SCHEMA), window=360)
        activity.run_available(stream, out, state).awaitTermination()  # each call is a restart from the checkpoint
        return {(r.entity_id, r.window_start, r.peak_start, r.peak_count, round(r.baseline_mean, 9), round(r.baseline_std, 9), round(r.score, 9), r.severity) for r in spark.read.parquet(out).collect()}

    ends = [DAY + dt.timedelta(hours=h) for h in (0, 14, 25, 36)]
    seen = set()
    for low, high in zip(ends, ends[1:]):
        part = [r for r in rows if low <= r[2] < high]
        seen = feed([*part, part[0], (None, 9, low), ("a", 9, None)])
    late = [("late", 5000 + k, DAY + dt.timedelta(hours=1)) for k in range(9)]
    assert feed(late) == seen
    finished = [DAY + dt.timedelta(hours=h) for h in range(0, 30, 6)]
    final = feed([("z", 9999, DAY + dt.timedelta(hours=60))])
    want = set().union(*(batch(spark, rows, w) for w in (*finished, DAY + dt.timedelta(hours=30))))
    assert final == want and seen < final and any(f[0] == "burst" for f in final)


def test_windows_are_whole_buckets(spark):
    with pytest.raises(ValueError):
        spikes.activity_spikes(spark.createDataFrame([], SCHEMA), window=100, minutes=60)

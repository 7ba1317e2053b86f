"""Explainable detectors of unusual activity: leads for an investigator, each with the events that support it.

Counts per bucket are aggregated once. The baseline's mean and deviation over all
of its buckets, empty ones included, come from sums in closed form.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inquest.functions.numbers import numbered, ordered_pair, severity
from inquest.functions.times import bucket
from inquest.operators.temporal import in_window

Span = tuple[dt.datetime, dt.datetime]
#: Thresholds: z-like scores that count as 1, events of a burst, of a new relationship, and of a convergence with its betweenness and activity.
Z, BURST_EVENTS, NOVEL_EVENTS, CONVERGENCE_EVENTS, CONVERGENCE_BETWEENNESS, CONVERGENCE_ACTIVITY, MOST_FINDINGS = 3.0, 3, 1, 2, 0.5, 0.5, 100
MICRO = dt.timedelta(microseconds=1)
FINDING = ["anomaly_type", "entity_id", "source_entity_id", "target_entity_id", "score", "severity", "event_count", "title"]


def baseline_for(target: Span, baseline: Span | None = None) -> Span:
    """The baseline window: by default as long as the target and directly before it; it must end before the target begins."""
    start, stop = target
    low, high = baseline or (start - max(stop - start, dt.timedelta(seconds=1)), start - MICRO)
    if high >= start:
        high = start - MICRO
    if low >= high:
        raise ValueError("the baseline window must have a positive duration before the target window")
    return low, high


def n_buckets(span: Span, minutes: int) -> int:
    """Buckets that a window touches."""
    size = minutes * 60
    at = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds()) // size
    return at(span[1]) - at(span[0]) + 1


def _between(events: DataFrame, span: Span) -> DataFrame:
    return in_window(events, F.lit(span[0]).cast("timestamp"), F.lit(span[1]).cast("timestamp"))


def _starts(span: Span, minutes: int) -> Column:
    at = lambda t: bucket(F.lit(t).cast("timestamp"), minutes)
    return F.col("bucket_start").between(at(span[0]), at(span[1]))


def counts(events: DataFrame, key: list[str], minutes: int) -> DataFrame:
    """Distinct events per key and bucket of their start. events: the key's columns, event_id, start_at."""
    return events.withColumn("bucket_start", bucket(F.col("start_at"), minutes)).groupBy(*key, "bucket_start").agg(F.count_distinct("event_id").alias("n"))


def by_entity(events: DataFrame) -> DataFrame:
    """A row for each end of each event: entity_id, event_id, start_at, end_at (an event of an entity with itself twice)."""
    return events.select("event_id", "start_at", "end_at", F.explode(F.array_compact(F.array("source_entity_id", "target_entity_id"))).alias("entity_id"))


def by_pair(events: DataFrame) -> DataFrame:
    """A row for each event between two entities: src, dst, event_id, start_at, end_at."""
    return events.select("event_id", "start_at", "end_at", *ordered_pair("source_entity_id", "target_entity_id")).where("src <> dst")


def peaks(rows: DataFrame, key: list[str], target: Span, baseline: Span, minutes: int) -> DataFrame:
    """Per key with target events: the peak bucket (the earliest of the largest), the baseline's mean and deviation, z and score.

    Both windows go through the same aggregation, and one more by key.
    """
    t = counts(_between(rows, target), key, minutes).withColumn("is_target", F.lit(True))
    b = counts(_between(rows, baseline), key, minutes).where(_starts(baseline, minutes)).withColumn("is_target", F.lit(False))
    n = float(n_buckets(baseline, minutes))
    base, peak = F.when(~F.col("is_target"), F.col("n")), F.when(F.col("is_target"), F.struct("n", -F.unix_seconds("bucket_start")))
    joined = t.unionByName(b).groupBy(*key).agg(F.max(peak).alias("peak"), F.coalesce(F.sum(base), F.lit(0)).alias("s"), F.coalesce(F.sum(base * base), F.lit(0)).alias("q"))
    mean = F.col("s") / n
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / n - mean * mean))
    found = joined.where("peak IS NOT NULL").select(*key, F.timestamp_seconds(-F.col("peak.col2")).alias("peak_start"), F.col("peak.n").alias("peak_count"), mean.alias("baseline_mean"), deviation.alias("baseline_std"))
    z = (F.col("peak_count") - F.col("baseline_mean")) / (F.col("baseline_std") + 1)
    return found.withColumn("z_like_score", z).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("z_like_score") / Z)))


def activity_spikes(events: DataFrame, target: Span, baseline: Span | None = None, minutes: int = 60) -> DataFrame:
    """ACTIVITY_SPIKE: entities whose busiest target bucket lies above the baseline."""
    found = peaks(by_entity(events), ["entity_id"], target, baseline_for(target, baseline), minutes)
    return found.where("score > 0").withColumn("severity", severity(F.col("score")))


def pair_totals(events: DataFrame, span: Span) -> DataFrame:
    return by_pair(_between(events, span)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def novel_relationships(events: DataFrame, target: Span, baseline: Span | None = None) -> DataFrame:
    """NOVEL_RELATIONSHIP: pairs with events in the target window and none in the baseline."""
    new = pair_totals(events, target).join(pair_totals(events, baseline_for(target, baseline)), ["src", "dst"], "left_anti").where(F.col("n") >= NOVEL_EVENTS)
    score = F.least(F.lit(1.0), F.col("n") / (NOVEL_EVENTS + 1.0))
    return new.select("src", "dst", F.col("n").alias("target_count"), score.alias("score"), severity(score).alias("severity"))


def interaction_bursts(events: DataFrame, target: Span, baseline: Span | None = None, minutes: int = 60) -> DataFrame:
    """INTERACTION_BURST: pairs with a target bucket of at least BURST_EVENTS events above the baseline."""
    found = peaks(by_pair(events), ["src", "dst"], target, baseline_for(target, baseline), minutes)
    return found.where((F.col("score") > 0) & (F.col("peak_count") >= BURST_EVENTS)).withColumn("severity", severity(F.col("score")))


def cross_community(events: DataFrame, members: DataFrame, target: Span, baseline: Span | None = None) -> DataFrame:
    """CROSS_COMMUNITY_ACTIVITY: new pairs between components of the baseline's graph. members: node_id, component (isolated nodes are their own)."""
    new = pair_totals(events, target).join(pair_totals(events, baseline_for(target, baseline)), ["src", "dst"], "left_anti")
    of = lambda end: members.select(F.col("node_id").alias(end), F.col("component").alias(f"{end}_component"))
    apart = new.join(of("src"), "src").join(of("dst"), "dst").where("src_component <> dst_component")
    score = 0.5 + 0.5 * F.col("n") / (F.col("n") + 1.0)
    return apart.select("src", "dst", "src_component", "dst_component", F.col("n").alias("target_count"), score.alias("score"), severity(score).alias("severity"))


def convergence(events: DataFrame, metrics: DataFrame, target: Span, baseline: Span | None = None, minutes: int = 60) -> DataFrame:
    """STRUCTURAL_ACTIVITY_CONVERGENCE: bridges of the network with unusual activity. metrics: node_id, betweenness_centrality."""
    bridges = metrics.where(F.col("betweenness_centrality") >= CONVERGENCE_BETWEENNESS).select(F.col("node_id").alias("entity_id"), "betweenness_centrality")
    own = by_entity(events)
    totals = _between(own, target).groupBy("entity_id").agg(F.count(F.lit(1)).alias("target_event_count")).where(F.col("target_event_count") >= CONVERGENCE_EVENTS)
    spikes = peaks(own, ["entity_id"], target, baseline_for(target, baseline), minutes).where(F.col("score") >= CONVERGENCE_ACTIVITY).select("entity_id", F.col("score").alias("activity_score"))
    score = 0.5 * F.col("betweenness_centrality") + 0.5 * F.col("activity_score")
    return totals.join(spikes, "entity_id").join(bridges, "entity_id").select("*", score.alias("score"), severity(score).alias("severity"))


def as_findings(rows: DataFrame, anomaly_type: str, count: str, title: Column) -> DataFrame:
    """Detector rows in the common form; pairs must be src, dst."""
    has = rows.columns
    one = lambda name, c: (F.col(c) if c in has else F.lit(None)).cast("string").alias(name)
    return rows.select(F.lit(anomaly_type).alias("anomaly_type"), one("entity_id", "entity_id"), one("source_entity_id", "src"), one("target_entity_id", "dst"), F.round("score", 12).alias("score"), severity(F.round("score", 12)).alias("severity"), F.col(count).cast("long").alias("event_count"), title.alias("title"))


def ranked(findings: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """The first findings by score, type, ids and title, numbered ANOM_0001 and on. The cut is a top-k, the numbers run over its rows alone."""
    order = [F.desc("score"), F.asc("anomaly_type"), F.coalesce("entity_id", "source_entity_id", F.lit("")), F.coalesce("target_entity_id", F.lit("")), F.asc("title")]
    top = findings.orderBy(*order).limit(most)
    return top.withColumn("finding_id", numbered("ANOM_", F.row_number().over(Window.orderBy(*order)), 4)).withColumn("status", F.lit("INVESTIGATIVE_LEAD"))

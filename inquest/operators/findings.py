"""The report of all anomaly detectors: findings in words and numbers, ranked, and the events and relationships that support each.

A finding about an entity rests on its events in the busiest bucket, or on all its events of the window for a convergence;
one about a pair on the events of its busiest bucket or of the window, and on every relationship between the two.
Support comes as rows, not as lists: a hub's finding may rest on any number of events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.functions.numbers import numbered, ordered_pair, severity
from inquest.functions.times import bucket
from inquest.operators import anomaly
from inquest.operators.components import components
from inquest.operators.numbering import positions
from inquest.storage import stored

WHOLE_WINDOW = ("NOVEL_RELATIONSHIP", "CROSS_COMMUNITY_ACTIVITY", "STRUCTURAL_ACTIVITY_CONVERGENCE")


def baseline_components(events: DataFrame, ids: DataFrame, baseline: anomaly.Span) -> DataFrame:
    """node_id, component (BASE_COMM_001 and on, by least member): components of the baseline's pairs; entities without a pair are their own."""
    old = anomaly.pair_totals(events, baseline)
    parts = stored(components(old.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("node").alias("node_id"), "component"), "baseline-components")
    alone = ids.select("node_id").distinct().join(parts, "node_id", "left_anti").select("node_id", F.col("node_id").alias("component"))
    every = stored(parts.unionByName(alone), "in-components")
    names = positions(every.select("component").distinct(), "component").select("component", numbered("BASE_COMM_", F.col("position"), 3).alias("name"))
    return every.join(names, "component").select("node_id", F.col("name").alias("component"))


def _form(rows: DataFrame, kind: str, title: Column, explanation: Column, signals: dict[str, Column]) -> DataFrame:
    has = rows.columns
    one = lambda name, c: (F.col(c) if c in has else F.lit(None)).cast("string").alias(name)
    numbers = F.map_from_arrays(F.array(*(F.lit(k) for k in signals)), F.array(*(F.round(v.cast("double"), 12) for v in signals.values())))
    peak = (F.col("peak_start") if "peak_start" in has else F.lit(None)).cast("timestamp").alias("peak_start")
    score, count = F.round("score", 12), next(c for c in ("peak_count", "target_count", "target_event_count") if c in has)
    return rows.select(
        F.lit(kind).alias("anomaly_type"), one("entity_id", "entity_id"), one("source_entity_id", "src"), one("target_entity_id", "dst"), score.alias("score"), severity(score).alias("severity"), title.alias("title"),
        F.col(count).cast("long").alias("event_count"), explanation.alias("explanation"), numbers.alias("signals"), peak,
    )


def _reached(what: str, minutes: int) -> Column:
    return F.format_string(f"{what} %d event(s) in one {minutes}-minute bucket, versus a baseline mean of %.2f.", F.col("peak_count"), F.col("baseline_mean"))


def report(nodes: DataFrame, events: DataFrame, target: anomaly.Span, baseline: anomaly.Span | None = None, minutes: int = 60, metrics: DataFrame | None = None, most: int = anomaly.MOST_FINDINGS) -> DataFrame:
    """The first `most` findings of all detectors: finding_id, anomaly_type, ids, score, severity, title, explanation, signals (numbers by name), peak_start, status.

    nodes: node_id and label of the eligible entities; events: those with an eligible end; metrics: node_id and
    betweenness_centrality, for the convergence detector, which is left out without them. Spikes and convergences are
    those of eligible entities. Order: score, type, ids, title; the cut is a top-k.
    """
    baseline = anomaly.baseline_for(target, baseline)
    labels = stored(nodes.groupBy("node_id").agg(F.min("label").alias("label")), "labels")
    of = lambda rows, key, name: rows.join(labels.select(F.col("node_id").alias(key), F.col("label").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))
    own = lambda rows: rows.join(labels.select(F.col("node_id").alias("entity_id"), "label"), "entity_id")
    spikes = own(anomaly.activity_spikes(events, target, baseline, minutes))
    signals = {"target_peak_events": F.col("peak_count"), "baseline_mean_bucket_events": F.col("baseline_mean"), "baseline_std_bucket_events": F.col("baseline_std"), "z_like_score": F.col("z_like_score")}
    parts = [_form(spikes, "ACTIVITY_SPIKE", F.concat(F.lit("Unusual activity spike for "), "label"), _reached("Activity reached", minutes), signals)]

    new = of(of(anomaly.novel_relationships(events, target, baseline), "src", "src_label"), "dst", "dst_label")
    told = F.format_string("The pair has %d time-stamped interaction event(s) in the target window and no time-stamped interaction events in the baseline window.", F.col("target_count"))
    signals = {"target_interaction_count": F.col("target_count"), "baseline_interaction_count": F.lit(0.0)}
    parts.append(_form(new, "NOVEL_RELATIONSHIP", F.concat(F.lit("New interaction detected: "), "src_label", F.lit(" ↔ "), "dst_label"), told, signals))

    bursts = anomaly.interaction_bursts(events, target, baseline, minutes)
    signals_of_burst = {"target_peak_interactions": F.col("peak_count"), "baseline_mean_bucket_interactions": F.col("baseline_mean"), "baseline_std_bucket_interactions": F.col("baseline_std"), "z_like_score": F.col("z_like_score")}
    parts.append(_form(bursts, "INTERACTION_BURST", F.lit("Unusual interaction burst"), _reached("The relationship produced", minutes), signals_of_burst))

    apart = anomaly.cross_community(events, baseline_components(events, nodes, baseline), target, baseline)
    told = F.concat(F.lit("The target window introduces a new interaction between baseline components "), "src_component", F.lit(" and "), "dst_component", F.lit("."))
    parts.append(_form(apart, "CROSS_COMMUNITY_ACTIVITY", F.lit("New cross-community interaction"), told, signals | {"baseline_components_connected": F.lit(0.0)}))

    if metrics is not None:
        converging = own(anomaly.convergence(events, metrics, target, baseline, minutes))
        told = F.lit("The entity has a strong structural bridge role while its recent activity also deviates materially from the baseline. This is an investigative lead, not a guilt determination.")
        signals = {c: F.col(c) for c in ("betweenness_centrality", "activity_score", "target_event_count")}
        parts.append(_form(converging, "STRUCTURAL_ACTIVITY_CONVERGENCE", F.concat(F.lit("Network-bridge role coincides with unusual activity: "), "label"), told, signals))
    return stored(anomaly.ranked(reduce(DataFrame.unionByName, parts), most), "findings")


def support(findings: DataFrame, events: DataFrame, edges: DataFrame, target: anomaly.Span, minutes: int = 60) -> DataFrame:
    """finding_id, object_type (EVENT or RELATIONSHIP), object_id: what each finding rests on, each once. findings: from `report`, a bounded number, which is broadcast."""
    inside = anomaly._between(events, target).withColumn("bucket_start", bucket(F.col("start_at"), minutes))
    in_time = F.col("anomaly_type").isin(*WHOLE_WINDOW) | (F.col("bucket_start") == F.col("peak_start"))
    ids = F.col("event_id").cast("string").alias("object_id")
    about = F.broadcast(findings.select("finding_id", "anomaly_type", "entity_id", F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst"), "peak_start"))
    ends = inside.select("event_id", "bucket_start", F.explode(F.array_compact(F.array("source_entity_id", "target_entity_id"))).alias("entity_id"))
    of_entity = ends.join(about.drop("src", "dst"), "entity_id").where(in_time).select("finding_id", F.lit("EVENT").alias("object_type"), ids)
    pairs = inside.select("event_id", "bucket_start", *ordered_pair("source_entity_id", "target_entity_id"))
    of_pair = pairs.join(about.drop("entity_id"), ["src", "dst"]).where(in_time).select("finding_id", F.lit("EVENT").alias("object_type"), ids)
    links = edges.select(F.col("edge_id").cast("string").alias("object_id"), *ordered_pair("source_id", "target_id"))
    related = links.join(about.where("anomaly_type <> 'ACTIVITY_SPIKE'"), ["src", "dst"]).select("finding_id", F.lit("RELATIONSHIP").alias("object_type"), "object_id")
    return of_entity.unionByName(of_pair).unionByName(related).distinct()

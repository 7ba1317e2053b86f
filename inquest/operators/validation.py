"""Checks of extracted documents: every rule is a condition on a row, every violation a flag row.

Extractions are rows of document_id, document_type, parties (name, role,
confidence), identifiers (type, value, confidence), dates (label, value,
confidence), amounts (label, value, confidence), raw_text, overall_confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.functions.times import flexible_date

REVIEW, MOST_FLAGS, ESCALATION_MARGIN = 0.85, 2, 0.10


def _has(column: str, field: str, *parts: str) -> Column:
    """Whether any element's field holds one of the parts, inside other words too. (The parts have no signs that a pattern would read.)"""
    return F.coalesce(F.exists(F.col(column), lambda x: F.coalesce(F.lower(x[field]).rlike("|".join(parts)), F.lit(False))), F.lit(False))


def _text(*parts: str) -> Column:
    return F.coalesce(F.lower("raw_text").rlike("|".join(parts)), F.lit(False))


def _date(*labels: str) -> Column:
    hit = F.filter(F.col("dates"), lambda d: F.lower(d["label"]).rlike("|".join(labels)))
    return flexible_date(F.try_element_at(hit, F.lit(1))["value"])


def _witnesses() -> Column:
    seen = F.filter(F.col("parties"), lambda p: F.lower(F.concat_ws(" ", p["role"], p["name"])).contains("panch") | F.coalesce(F.lower(p["role"]).contains("witness"), F.lit(False)))
    return F.coalesce(F.size(seen), F.lit(0))


def rules() -> list[tuple[str, str, str, Column]]:
    """Document type, flag, severity, and the condition under which the document is in order."""
    sections = _has("identifiers", "type", "act", "sec", "ipc", "bns")
    return [
        ("fir_report", "missing_fir_number", "critical", _has("identifiers", "type", "fir") | _has("identifiers", "value", "fir")),
        ("fir_report", "missing_police_station", "high", _has("identifiers", "type", "police station", "ps", "thana")),
        ("fir_report", "missing_acts_and_sections", "high", sections),
        ("fir_report", "chronology_violation", "critical", ~F.coalesce(_date("occurrence") > _date("registration", "reporting", "dispatch"), F.lit(False))),
        ("seizure_memo", "insufficient_panch_witnesses", "critical", _witnesses() >= 2),
        ("seizure_memo", "missing_seal_impression", "medium", _has("identifiers", "type", "seal") | _text("seal")),
        ("arrest_memo", "missing_arrestee_identity", "critical", _has("parties", "role", "arrest", "accused")),
        ("arrest_memo", "missing_grounds_of_arrest", "high", _has("identifiers", "type", "ground") | _text("ground")),
        ("arrest_memo", "missing_family_intimation", "high", _has("parties", "role", "relat", "intimat") | _text("intimat")),
        ("charge_sheet", "missing_chargesheeted_accused", "critical", _has("parties", "role", "accused", "chargesheet")),
        ("charge_sheet", "missing_penal_charges", "critical", sections),
        ("medical_legal", "missing_examining_doctor", "high", _has("parties", "role", "doctor", "medical")),
        ("medical_legal", "missing_injury_classification", "medium", _text("simple", "grievous", "fatal", "dangerous", "blunt", "sharp", "firearm") | _has("identifiers", "type", "injury")),
        ("forensic_report", "missing_digital_hash", "high", _has("identifiers", "type", "hash", "sha", "md5") | F.coalesce(F.col("raw_text").rlike(r"(?i)\b[0-9a-f]{32,64}\b"), F.lit(False))),
    ]


def rule_flags(extractions: DataFrame) -> DataFrame:
    """Violations in one pass over the rows: document_id, flag, severity."""
    flags = [F.when((F.col("document_type") == kind) & ~ok, F.struct(F.lit(flag).alias("flag"), F.lit(level).alias("severity"))) for kind, flag, level, ok in rules()]
    return extractions.select("document_id", F.inline(F.array_compact(F.array(*flags))))


def confidence_flags(extractions: DataFrame, threshold: float = REVIEW) -> DataFrame:
    """Low confidences, overall and of every item: document_id, flag, field."""
    whole = F.when(F.col("overall_confidence") < threshold, F.array(F.struct(F.lit("low_overall_confidence").alias("flag"), F.lit("overall").alias("field")))).otherwise(F.array().cast("array<struct<flag:string,field:string>>"))
    parts = [whole]
    for column, name in (("parties", "name"), ("dates", "label"), ("amounts", "label"), ("identifiers", "type")):
        low = F.filter(F.col(column), lambda x: x["confidence"] < threshold)
        parts.append(_named(low, column, name))
    return extractions.select("document_id", F.inline(F.concat(*parts)))


def _named(low: Column, column: str, name: str) -> Column:
    none = F.array().cast("array<struct<flag:string,field:string>>")
    return F.coalesce(F.transform(low, lambda x: F.struct(F.lit("low_confidence_field").alias("flag"), F.concat(F.lit(f"{column}:"), x[name]).alias("field"))), none)


def escalations(extractions: DataFrame, mismatches: DataFrame | None = None, disagreements: DataFrame | None = None) -> DataFrame:
    """Documents that a second, stronger extraction should read: document_id, n_flags, escalate, reasons.

    A critical flag, an arithmetic mismatch, more than MOST_FLAGS flags of all kinds, or an overall confidence clearly below
    the review threshold. mismatches: document_id of failed sums; disagreements: document_id, a row for each value that two runs read differently.
    """
    no = F.lit(0)
    parts = [(rule_flags(extractions), (F.col("severity") == "critical").cast("int"), no), (confidence_flags(extractions), no, no)]
    parts += [(rows, no, F.lit(wrong)) for rows, wrong in ((mismatches, 1), (disagreements, 0)) if rows is not None]
    every = None
    for rows, critical, wrong in parts:
        one = rows.select("document_id", critical.alias("critical"), wrong.alias("wrong"))
        every = one if every is None else every.unionByName(one)
    counted = every.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_flags"), F.max("critical").alias("critical"), F.max("wrong").alias("wrong"))
    joined = extractions.select("document_id", "overall_confidence").join(counted, "document_id", "left")
    n = F.coalesce("n_flags", F.lit(0))
    reasons = F.array_compact(
        F.array(F.when(F.col("critical") == 1, "critical_flag"), F.when(F.col("wrong") == 1, "arithmetic_mismatch"), F.when(n > MOST_FLAGS, "too_many_flags"), F.when(F.col("overall_confidence") < REVIEW - ESCALATION_MARGIN, "low_confidence"))
    )
    return joined.select("document_id", n.alias("n_flags"), (F.size(reasons) > 0).alias("escalate"), reasons.alias("reasons"))

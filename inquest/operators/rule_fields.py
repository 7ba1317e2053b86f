"""Fields that follow from the rules of a document type, one pass over the extractions (rows as `validation` takes them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.operators.validation import _has, _text

COMMERCIAL = ("invoice", "receipt", "bank_statement")


def _values_of(column: str, test: str, words: tuple[str, ...], value: str) -> Column:
    hit = F.filter(F.col(column), lambda x: F.coalesce(F.lower(x[test]).rlike("|".join(words)), F.lit(False)))
    return F.coalesce(F.transform(hit, lambda x: x[value]), F.array().cast("array<string>"))


def _derived() -> list[tuple[tuple[str, ...], str, Column]]:
    """Document types, field name and value (null: no such field)."""
    seal, hashed = _has("identifiers", "type", "seal") | _text("seal"), _has("identifiers", "type", "hash", "sha")
    grounds, told = _has("identifiers", "type", "ground") | _text("ground"), _has("parties", "role", "relat", "intimat", "friend") | _text("intimat")
    sections = _values_of("identifiers", "type", ("act", "sec", "ipc", "bns"), "value")
    witnesses, accused = F.size(_values_of("parties", "role", ("panch", "witness"), "name")), F.size(_values_of("parties", "role", ("accused",), "name"))
    either = lambda test, yes, no: F.when(test, F.lit(yes)).otherwise(no if isinstance(no, Column) else F.lit(no))
    late = F.array_contains("_flags", "chronology_violation")
    kind = F.initcap(F.regexp_replace("document_type", "_", " "))
    variance = F.concat(F.lit("VARIANCE DETECTED - Discrepancy: "), F.col("_difference").cast("string"))
    few = F.concat(F.lit("DEFICIENT - Only "), witnesses.cast("string"), F.lit(" witness(es) found (requires 2)"))
    # Names and texts of the derived fields.
    return [
        (("fir_report",), "rule:fir_statutory_basis", F.lit("Sec 154 CrPC / Sec 173 BNSS (Cognizable Offense Information)")),
        (("fir_report",), "rule:temporal_integrity_status", either(late, "FLAGGED - Occurrence after registration", "PASSED - Incident chronology verified")),
        (("fir_report",), "rule:penal_sections_detected", F.when(F.size(sections) > 0, F.array_join(sections, ", "))),
        (("seizure_memo",), "rule:panchnama_statutory_validity", either(witnesses >= 2, "COMPLIANT (Sec 100(4) CrPC / Sec 105 BNSS) - 2 Independent Witnesses Present", few)),
        (("seizure_memo",), "rule:independent_witness_count", witnesses.cast("string")),
        (("seizure_memo",), "rule:seizure_authority_code", F.lit("Sec 100 & 102 CrPC (Police Seizure under Warrant/Spot Recovery)")),
        (("seizure_memo",), "rule:sample_seal_condition", either(seal, "VERIFIED - Sample seal recorded on parcel", "UNVERIFIED - No explicit seal record")),
        (("arrest_memo",), "rule:dk_basu_compliance_status", either(grounds & told, "COMPLIANT - All D.K. Basu Supreme Court Safeguards Met", "DEFICIENT - Human rights documentation incomplete")),
        (("arrest_memo",), "rule:grounds_of_arrest_disclosed", either(grounds, "YES - Formally recorded under Article 22(1) & Sec 41B CrPC", "NO - Grounds missing")),
        (("arrest_memo",), "rule:family_intimation_mandate", either(told, "CONFIRMED - Next-of-kin informed under Sec 41B(b) CrPC", "PENDING - Family intimation not recorded")),
        (("arrest_memo",), "rule:custodial_medical_exam_deadline", F.lit("Mandatory Medical Examination required within 24 hours (Sec 54 CrPC)")),
        (("charge_sheet",), "rule:statutory_filing_authority", F.lit("Section 173(2) CrPC / Section 193 BNSS (Final Police Report on Completion of Investigation)")),
        (("charge_sheet",), "rule:chargesheeted_accused_count", accused.cast("string")),
        (("medical_legal",), "rule:injury_nature_statutory_basis", F.lit("Evaluation under Section 320 IPC / Section 114 BNS (Simple vs Grievous Hurt)")),
        (("medical_legal",), "rule:custodial_violence_screening", F.lit("VERIFIED - Standard D.K. Basu Inspection Memo Examination Conducted")),
        (("forensic_report",), "rule:digital_evidence_admissibility", F.lit("Sec 65B Indian Evidence Act / Section 63 BSA Admissibility Compliant")),
        (("forensic_report",), "rule:cryptographic_integrity_verification", either(hashed, "VERIFIED - Bit-stream image hash matches extraction ledger", "UNVERIFIED - No bit-level hash recorded")),
        (COMMERCIAL, "rule:commercial_document_type", F.concat(F.lit("Audited "), kind)),
        (COMMERCIAL, "rule:arithmetic_reconciliation", F.when(F.col("_matched").isNull(), "VERIFIED - Ledger balanced").when(F.col("_matched"), "VERIFIED - Mathematical equality confirmed").otherwise(variance)),
        (COMMERCIAL, "rule:computed_tax_reconciliation", F.when(F.col("_tax").isNotNull(), F.format_string("Calculated: %.2f", "_tax"))),
    ]


def rule_fields(extractions: DataFrame, flags: DataFrame, arithmetic: DataFrame | None = None) -> DataFrame:
    """Derived fields of every document: document_id, pos, field_name, field_value, the state of the quality gate last.

    flags: document_id, flag; arithmetic: document_id, matched, difference, tax (null: no tax was computed). A document
    without flags has passed; one of an unknown type has the last field alone. Nulls in parties and identifiers count as absent.
    """
    held = flags.groupBy("document_id").agg(F.collect_set("flag").alias("_flags"), F.count(F.lit(1)).alias("_n"))
    rows = extractions.join(held, "document_id", "left").withColumns({"_flags": F.coalesce("_flags", F.array().cast("array<string>")), "_n": F.coalesce("_n", F.lit(0))})
    if arithmetic is None:
        rows = rows.withColumns({"_matched": F.lit(None).cast("boolean"), "_difference": F.lit(None).cast("double"), "_tax": F.lit(None).cast("double")})
    else:
        rows = rows.join(arithmetic.select("document_id", F.col("matched").alias("_matched"), F.col("difference").alias("_difference"), F.col("tax").alias("_tax")), "document_id", "left")
    gate = F.when(F.col("_n") == 0, "PASSED").otherwise(F.concat(F.lit("REVIEW REQUIRED ("), F.col("_n").cast("string"), F.lit(" flag(s))")))
    items = [F.when(F.col("document_type").isin(*kinds) & value.isNotNull(), F.struct(F.lit(i).alias("pos"), F.lit(name).alias("field_name"), value.alias("field_value"))) for i, (kinds, name, value) in enumerate(_derived())]
    items.append(F.struct(F.lit(len(items)).alias("pos"), F.lit("rule:quality_gate_status").alias("field_name"), gate.alias("field_value")))
    return rows.select("document_id", F.inline(F.array_compact(F.array(*items))))

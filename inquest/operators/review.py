"""Review of evidence: contradictions, provenance, cross-references and document checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.functions.numbers import numbered
from inquest.operators.numbering import ranks
from inquest.storage import stored

#: Tolerances of arithmetic and dual-run checks.
ARITHMETIC, DUAL_RUN = 0.02, 0.05


def compact(text: Column) -> Column:
    """Text for comparison: lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def comparable(key: Column, value: Column) -> Column:
    """A value as values of its key are compared: by letters and digits alone for case references and identifiers, else by words."""
    by_signs = key.startswith("case_") | key.startswith("identifier:")
    return F.when(by_signs, F.regexp_replace(compact(value), "[^a-z0-9]+", "")).otherwise(compact(value))


# Words that make a field a case reference (one of each group), fields known by their words, first match wins.
REFERENCE = (("fir", "crime", "case / fir", "case/fir", "case no", "case number"), ("number", "no", "ref", "reference"))
FIELDS = {"police station": "police_station", "thana": "police_station", "district": "district", "mlc number": "mlc_number"}
#: Values that a message names; it says how many more there are. The observations have all.
NAMED = 20


def semantic_keys(rows: DataFrame, field: str) -> DataFrame:
    """Names of fields with `key`: what a field is about, whatever it is called. Null for notes, summaries, rules and other fields."""
    raw, label, words = F.col("_raw"), F.col("_label"), F.col("_words")
    rows = rows.withColumn("_raw", compact(F.col(field)))
    rows = rows.withColumn("_label", F.when(F.contains(raw, F.lit(":")), F.ltrim(F.substring(raw, F.locate(":", raw) + 1, F.length(raw)))).otherwise(raw))
    rows = rows.withColumn("_words", F.trim(F.regexp_replace("_label", "[^a-z0-9]+", " ")))
    some = lambda group: F.greatest(*(F.contains(label, F.lit(w)) for w in group))
    apart = F.startswith(label, F.lit("notes")) | F.startswith(label, F.lit("summary")) | F.startswith(label, F.lit("rule"))
    found = F.when(apart, F.lit(None).cast("string")).when(some(REFERENCE[0]) & some(REFERENCE[1]), "case_reference")
    for word, key in FIELDS.items():
        found = found.when(F.contains(label, F.lit(word)), key)
    found = found.when(F.contains(label, F.lit("fsl reference")) & ~F.contains(label, F.lit("crime")), "fsl_reference").when(F.contains(label, F.lit("date")), F.concat(F.lit("date:"), words))
    found = found.when(F.startswith(raw, F.lit("id:")) | F.startswith(raw, F.lit("identifier:")), F.concat(F.lit("identifier:"), words))
    return rows.withColumn("key", found).drop("_raw", "_label", "_words")


def contradictions(observations: DataFrame, *by: str) -> DataFrame:
    """Keys observed with more than one comparable value, within `by` (the case): by, key, n_values, n_observations, severity.

    observations: by, key, value. Empty and null values are ignored. Only a conflict of case references weighs high.
    """
    seen = observations.where(compact(F.col("value")) != "").withColumn("norm", comparable(F.col("key"), F.col("value")))
    found = seen.groupBy(*by, "key").agg(F.count_distinct("norm").alias("n_values"), F.count(F.lit(1)).alias("n_observations"))
    return found.where("n_values > 1").withColumn("severity", F.when(F.col("key") == "case_reference", "high").otherwise("medium"))


def observed(fields: DataFrame) -> DataFrame:
    """Fields of documents (case_id, document_id, filename, ord, pos, field_name, field_value) that may contradict each other: the same with key and value. Keys are made once for each distinct name."""
    keys = stored(semantic_keys(fields.select("field_name").distinct(), "field_name"), "field-keys").where("key is not null")
    return fields.withColumn("value", F.trim("field_value")).where("value <> ''").join(keys, "field_name").select(*fields.columns, "key", "value")


def contradiction_report(seen: DataFrame) -> DataFrame:
    """Observations from `observed` -> case_id, contradiction_id, type, severity, key, message, n_values, n_observations: a row per conflict of a case.

    Ids are numbered in each case by key. The message names the first observed value of each comparable one, up to NAMED.
    """
    found = stored(contradictions(seen, "case_id"), "conflicts")
    firsts = seen.withColumn("norm", comparable(F.col("key"), F.col("value"))).groupBy("case_id", "key", "norm").agg(F.min(F.struct("ord", "pos", "value")).alias("first"))
    placed = ranks(firsts.join(found.select("case_id", "key"), ["case_id", "key"], "left_semi"), ["case_id", "key"], "norm", name="place").where(F.col("place") <= NAMED)
    named = placed.groupBy("case_id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "first"))), lambda x: x["first"]["value"]), ", ").alias("named"))
    more = F.when(F.col("n_values") > NAMED, F.concat(F.lit(" and "), (F.col("n_values") - NAMED).cast("string"), F.lit(" more"))).otherwise("")
    message = F.concat(F.lit("Conflicting values observed for '"), F.replace(F.col("key"), F.lit("_"), F.lit(" ")), F.lit("': "), F.col("named"), more)
    suffix = F.replace(F.replace(F.col("key"), F.lit(":"), F.lit("-")), F.lit(" "), F.lit("-"))
    rows = ranks(found.join(named, ["case_id", "key"]), ["case_id"], "key", name="number")
    kind = F.when(F.col("key") == "case_reference", "IDENTIFIER_MISMATCH").otherwise("FIELD_VALUE_CONFLICT")
    ident = F.concat(F.lit("CONTR-"), suffix, F.lit("-"), numbered("", F.col("number"), 3))
    return rows.select("case_id", ident.alias("contradiction_id"), kind.alias("type"), "severity", "key", message.alias("message"), "n_values", "n_observations")


def contradiction_observations(seen: DataFrame, report: DataFrame) -> DataFrame:
    """The observations of the conflicts in the report, in rows: contradiction_id, place (by file, field and value), and the columns of `seen`."""
    rows = seen.join(report.select("case_id", "key", "contradiction_id"), ["case_id", "key"])
    return ranks(rows, ["case_id", "key"], "filename", "field_name", "value", "ord", "pos", name="place")


def severity_counts(found: DataFrame) -> DataFrame:
    """Contradictions by severity: severity, n."""
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def first_observations(observations: DataFrame, *order: str) -> DataFrame:
    """The first observation, in this order, of each key and comparable value: key, norm, value and the columns of the order."""
    seen = observations.where(compact(F.col("value")) != "").withColumn("norm", comparable(F.col("key"), F.col("value")))
    return seen.groupBy("key", "norm").agg(F.min(F.struct(*order, "value")).alias("_first")).select("key", "norm", "_first.*")


def provenance_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """Items of provenance by object type: one count over the union."""
    every = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("object_type"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("object_type").agg(F.count(F.lit(1)).alias("n_items"))


def cross_references(rows: DataFrame, value: str, document: str) -> DataFrame:
    """Identifier values with the number of distinct documents that hold them, those in two or more."""
    return rows.groupBy(value).agg(F.count_distinct(document).alias("n_documents")).where("n_documents > 1")


def ledger(items: DataFrame, case: str) -> DataFrame:
    """Money per case: the total of positive amounts, their number, and the last currency that is not empty. items: amount, currency, ord."""
    money = items.where("amount > 0").groupBy(case)
    return money.agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n_items"), F.max_by("currency", F.when(F.col("currency") != "", F.col("ord"))).alias("currency"))


def arithmetic(amounts: DataFrame, document: str) -> DataFrame:
    """Stated totals against their parts: document, computed, stated, difference, matched.

    amounts: class (subtotal, tax, line, total), value. Subtotals and taxes count if there are subtotals, else two or more lines.
    """
    total = lambda c: F.sum(F.when(F.col("class") == c, F.col("value")))
    number = lambda c: F.sum(F.when(F.col("class") == c, 1).otherwise(0))
    sums = amounts.groupBy(document).agg(total("subtotal").alias("s"), total("tax").alias("t"), total("line").alias("l"), number("line").alias("n"), F.max(F.when(F.col("class") == "total", F.col("value"))).alias("stated"))
    computed = F.when(F.col("s").isNotNull(), F.col("s") + F.coalesce("t", F.lit(0.0))).when(F.col("n") >= 2, F.col("l") + F.coalesce("t", F.lit(0.0)))
    checked = sums.select(document, computed.alias("computed"), "stated").where("computed IS NOT NULL AND stated IS NOT NULL")
    difference = F.abs(F.col("computed") - F.col("stated"))
    return checked.withColumn("difference", difference).withColumn("matched", difference <= ARITHMETIC)


def dual_run(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Values that two extraction runs read differently, matched by position: keys, first, second. Both: keys, value."""
    both = primary.select(*keys, compact(F.col("value")).alias("first")).join(secondary.select(*keys, compact(F.col("value")).alias("second")), keys)
    return both.where(~F.col("first").eqNullSafe(F.col("second")))


def dual_run_amounts(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Amounts that two runs read more than DUAL_RUN apart: keys, difference. Both: keys, value."""
    both = primary.select(*keys, F.col("value").alias("a")).join(secondary.select(*keys, F.col("value").alias("b")), keys)
    return both.select(*keys, F.abs(F.col("a") - F.col("b")).alias("difference")).where(F.col("difference") > DUAL_RUN)


def out_of_order(dates: DataFrame, case: str, first: str, then: str) -> DataFrame:
    """Cases whose earliest date of the later kind lies before that of the earlier kind: a temporal contradiction. dates: kind, at."""
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    found = dates.groupBy(case).agg(at(first).alias("first_at"), at(then).alias("then_at"))
    return found.where("then_at < first_at").withColumn("flag", F.lit("TEMPORAL_CONTRADICTION"))


def page(rows: DataFrame, text: str, columns: list[str], order: list, number: int, size: int = 15) -> DataFrame:
    """A page (from 1) of the rows in which any of the columns holds the text, whatever its case."""
    hit = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))).contains(text.lower())
    return rows.where(hit).orderBy(*order).offset((number - 1) * size).limit(size)

"""Structured extractions from recorded model outputs: JSON read by schema, in whatever shape its sections come.

A text becomes a VARIANT; each section is an array or an object of items, an item an object or a plain value. Values are
read by type, with defaults and aliases, and items that don't fit become issues. Everything is computed within a row: no
shuffle. Only texts that are not JSON as they stand go to Python to be recovered, and texts are mined for phrases where
a section stays empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.functions.mining import kind_of_text, mined
from inquest.functions.numbers import money
from inquest.functions.recovery import recovered_json

# Kinds of documents, and words that stand for them, first match wins.
KINDS = ("receipt", "invoice", "fir_report", "seizure_memo", "arrest_memo", "charge_sheet", "medical_legal", "forensic_report", "case_diary", "contract", "bank_statement", "id_document", "other")
WORDS = {
    "fir_report": ("fir", "first information", "police report", "thana", "form 27"),
    "seizure_memo": ("seizure", "panch", "fard", "mahazar"),
    "arrest_memo": ("arrest", "basu", "custody"),
    "charge_sheet": ("charge", "challan", "173", "193"),
    "medical_legal": ("medic", "post-mortem", "pmr", "autopsy", "mlc"),
    "forensic_report": ("forensic", "fsl", "cyber", "65b", "63 bsa"),
    "invoice": ("invoice", "receipt", "bill"),
    "contract": ("contract", "agreement", "deed"),
    "bank_statement": ("bank", "statement"),
}
# Defaults, and the length that summaries are cut to.
SURE, CURRENCY, NOBODY, SUMMARY, MINED_SUMMARY, MINED_SURE, MINED_NOTE = 0.9, "INR", "Unknown Party", 1500, 2000, 0.80, "Extracted via forensic heuristic recovery engine"
UNSET = ("other", "official letter")
SECTIONS = ("parties", "dates", "amounts", "identifiers")
BOX = "struct<x:double,y:double,w:double,h:double>"
ITEMS = {
    "parties": f"array<struct<name:string,role:string,confidence:double,bounding_box:{BOX}>>",
    "dates": f"array<struct<label:string,value:string,confidence:double,bounding_box:{BOX}>>",
    "amounts": f"array<struct<label:string,value:double,currency:string,confidence:double,bounding_box:{BOX}>>",
    "identifiers": f"array<struct<type:string,value:string,confidence:double,bounding_box:{BOX}>>",
}


def document_kind(name: Column) -> Column:
    """A document's kind by its stated name: one of KINDS, else by the WORDS in it, else the name; `other` without one."""
    lower = F.lower(F.trim(name))
    found = F.when(lower == "", "other").otherwise(lower)
    for kind, words in reversed(WORDS.items()):
        any_of = F.lit(False)
        for w in words:
            any_of = any_of | F.contains(lower, F.lit(w))
        found = F.when(any_of, kind).otherwise(found)
    return F.coalesce(F.when(lower.isin(*KINDS), lower).otherwise(found), F.lit("other"))


# Values of a VARIANT by type. A value and the name of its type are kept together, so that the type is looked up once.


def _typed(v: Column) -> Column:
    """Struct (v, kind): a value and the name of its type, null where the value is absent."""
    return F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind"))


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _is(x: Column, kinds: str) -> Column:
    """Whether a typed value is of one of the types, named by their first letters; false where it is absent."""
    return F.coalesce(x["kind"].rlike(f"^(?:{kinds})"), F.lit(False))


_TEXT, _NUMBER, _BOOLEAN, _OBJECT, _ARRAY, _NULL = "STRING", "BIGINT|DECIMAL|DOUBLE|FLOAT", "BOOLEAN", "OBJECT", "ARRAY", "VOID"


def _as(x: Column, kind: str) -> Column:
    return F.try_variant_get(x["v"], "$", kind)


def _shown(x: Column) -> Column:
    """A value as text: strings as they are, numbers and structures as JSON, and the words None, True and False."""
    return F.when(_is(x, _NULL), "None").when(_is(x, _BOOLEAN), F.initcap(_as(x, "string"))).when(_is(x, f"{_OBJECT}|{_ARRAY}"), F.to_json(x["v"])).otherwise(_as(x, "string"))


def _said(x: Column) -> Column:
    """A text or number as text, null if it is empty or something else."""
    return F.when(_is(x, f"{_TEXT}|{_NUMBER}"), F.nullif(_as(x, "string"), F.lit("")))


def _number(x: Column) -> Column:
    """Numbers, and what is left of texts without signs and letters; 0 where nothing is."""
    return F.when(_is(x, f"{_NUMBER}|{_BOOLEAN}"), _as(x, "double")).when(_is(x, _TEXT), F.coalesce(money(_as(x, "string")), F.lit(0.0))).otherwise(0.0)


def _share(x: Column) -> Column:
    """A confidence: the default where none is stated, null where what is stated is no number in [0, 1]."""
    number = F.when(_is(x, f"{_NUMBER}|{_TEXT}"), _as(x, "string").try_cast("double"))
    return F.when(x["v"].isNull(), SURE).otherwise(F.when(number.between(0, 1), number))


# What an item of each section may say, with the aliases of its first field in their order.
_KEYS = {"parties": ("name", "value", "party", "role"), "dates": ("label", "type", "value"), "amounts": ("label", "type", "value", "currency"), "identifiers": ("type", "label", "key", "value")}


def _entries(part: Column, text: Column, section: str) -> Column:
    """A typed section as an array of (key, value typed), empty where it is neither array nor object. Fields of an object come in the order of the text."""
    entry = lambda key, v: F.struct(key.alias("key"), _typed(v).alias("x"))
    listed = F.transform(_as(part, "array<variant>"), lambda v: entry(F.lit(None).cast("string"), v))
    keys = F.json_object_keys(F.get_json_object(text, f"$.{section}"))
    named = F.transform(F.array_distinct(keys), lambda k: entry(k, F.element_at(_as(part, "map<string,variant>"), k)))
    return F.coalesce(F.when(_is(part, _ARRAY), listed).when(_is(part, _OBJECT), named), F.array())


def _details(entry: Column, section: str) -> Column:
    """An entry with the values of its keys, typed."""
    v = entry["x"]["v"]
    at = [_typed(_at(v, k)).alias(k) for k in (*_KEYS[section], "confidence", "bounding_box")]
    sides = [F.try_variant_get(v, f"$.bounding_box.{k}", "double").alias(k) for k in "xywh"]
    given = [_at(v, f"bounding_box.{k}").isNotNull().alias(k) for k in "xywh"]
    return F.struct(entry["key"].alias("key"), entry["x"].alias("x"), F.struct(*at).alias("at"), F.struct(*sides).alias("sides"), F.struct(*given).alias("given"))


def _made(e: Column, section: str) -> Column:
    """An entry as struct (value, issue): the item and what is wrong with it. Both are null for plain values that are no item."""
    key, x, at = e["key"], e["x"], e["at"]
    whole, by_key = _is(x, _OBJECT), e["key"].isNotNull()
    if section == "parties":
        name = F.when(by_key, _shown(x)).when(whole, F.coalesce(_said(at["name"]), _said(at["value"]), _said(at["party"]), F.lit(NOBODY))).otherwise(_as(x, "string"))
        role = F.when(by_key, key).when(whole, F.coalesce(_said(at["role"]), F.lit("party"))).otherwise("party")
        read, kept, fields = ~by_key & whole, by_key | whole | _is(x, _TEXT), [name.alias("name"), role.alias("role")]
    elif section == "amounts":
        read, kept = ~by_key & whole, by_key | whole | _is(x, f"{_TEXT}|{_BOOLEAN}|{_NUMBER}")
        label = F.coalesce(key, F.when(whole, F.coalesce(_said(at["label"]), _said(at["type"]))), F.lit("amount"))
        currency = F.when(read & at["currency"]["v"].isNotNull(), F.when(_is(at["currency"], _TEXT), _as(at["currency"], "string"))).otherwise(CURRENCY)
        fields = [label.alias("label"), F.when(read, _number(at["value"])).otherwise(_number(x)).alias("value"), currency.alias("currency")]
    else:
        first, default = ("label", "date") if section == "dates" else ("type", "identifier")
        read, kept = whole, whole | _is(x, _TEXT) | (by_key & ~_is(x, _NULL))
        label = F.coalesce(key, F.when(whole, F.coalesce(*(_said(at[k]) for k in _KEYS[section] if k != "value"))), F.lit(default))
        fields = [label.alias(first), F.when(whole, F.coalesce(_shown(at["value"]), F.lit(""))).otherwise(_shown(x)).alias("value")]
    box = at["bounding_box"]
    sides = F.struct(*(F.coalesce(e["sides"][k], F.lit(0.0)).alias(k) for k in "xywh"))
    misfit = F.lit(False)
    for k in "xywh":
        misfit = misfit | (e["given"][k] & e["sides"][k].isNull())
    bad_box = box["v"].isNotNull() & ~_is(box, _NULL) & (~_is(box, _OBJECT) | misfit)
    issue = F.when(read & _share(at["confidence"]).isNull(), "BAD_CONFIDENCE").when(read & bad_box, "BAD_BOUNDING_BOX")
    confidence = F.when(read, _share(at["confidence"])).otherwise(SURE)
    item = F.struct(*fields, confidence.alias("confidence"), F.when(read & _is(box, _OBJECT), sides).alias("bounding_box"))
    kind = ITEMS[section].removeprefix("array<").removesuffix(">")
    return F.struct(F.when(kept & issue.isNull(), item).cast(kind).alias("value"), F.when(kept, issue).alias("issue"))


def _read(part: Column, text: Column, section: str) -> Column:
    """All entries of a section as structs (value, issue)."""
    return F.transform(F.transform(_entries(part, text, section), lambda e: _details(e, section)), lambda e: _made(e, section))


def _as_items(found: Column, section: str) -> Column:
    """Mined items in the form of the section's."""
    names = {"parties": ("name", "role"), "dates": ("label", "value"), "amounts": ("label", "value", "currency"), "identifiers": ("type", "value")}[section]
    return F.transform(found, lambda x: F.struct(*(x[f].alias(f) for f in (*names, "confidence")), F.lit(None).cast(BOX).alias("bounding_box"))).cast(ITEMS[section])


def _issue(section: Column, position: Column, code: Column) -> Column:
    return F.struct(section.alias("section"), position.cast("int").alias("position"), code.alias("code"))


def _issues_of(section: str) -> Column:
    """The issues of a section's entries, with their positions from 1."""
    return F.filter(F.transform(f"_{section}", lambda x, i: _issue(F.lit(section), i + 1, x["issue"])), lambda x: x["code"].isNotNull())


def parsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `v`, the outer JSON object of the text as VARIANT, and `_json`, its text; null where there is none.

    Fences and what surrounds the object are left out. Texts that don't parse as they stand are recovered: trailing
    commas go, and a cut-off end is closed behind the last complete value.
    """
    fenced = F.nullif(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)(?:```|\z)", 1), F.lit(""))
    inner = F.coalesce(fenced, F.col(text))
    begin, end = F.locate("{", inner), F.length(inner) - F.locate("}", F.reverse(inner)) + 1
    direct = F.when((begin > 0) & F.contains(inner, F.lit("}")), F.substring(inner, begin, end - begin + 1))
    rows = docs.withColumn("_inner", inner).withColumn("_direct", direct).withColumn("v", F.try_parse_json("_direct"))
    again = rows.withColumn("_again", recovered_json(F.when(F.col("v").isNull(), F.col("_inner"))))
    whole = again.withColumn("_json", F.when(F.col("v").isNotNull(), F.col("_direct")).otherwise(F.col("_again"))).withColumn("v", F.coalesce("v", F.try_parse_json("_again")))
    return whole.withColumn("v", F.when(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.col("v"))).drop("_inner", "_direct", "_again")


def extracted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of `docs` with its extraction in place of the text: document_type, the four sections as arrays of structs, raw_text, notes_on_legibility, overall_confidence, and `issues` (section, position, code).

    A document whose text holds no object, or whose sections or header have values of the wrong type, is mined for
    phrases as a whole; in others each empty section is, and a missing summary and kind. Items with a confidence outside
    [0, 1] or a broken bounding box are left out and named in `issues`. Null texts give an empty extraction with the
    issue NOT_JSON; repeated rows stay, long texts are read whole, an empty table gives an empty result.
    """
    made = ("document_type", *SECTIONS, "raw_text", "notes_on_legibility", "overall_confidence", "issues")
    kept = [c for c in docs.columns if c != text and c not in made]
    rows = parsed(docs.select(*kept, F.coalesce(text, F.lit("")).alias("_text")), "_text")
    v, header = F.col("v"), ("document_type", "overall_confidence", "raw_text", "notes_on_legibility")
    rows = rows.select(*kept, "_text", "_json", v.isNull().alias("_none"), *(_typed(_at(v, k)).alias(f"_v_{k}") for k in (*SECTIONS, *header)))
    of = {k: F.col(f"_v_{k}") for k in (*SECTIONS, *header)}
    sure = F.when(_is(of["overall_confidence"], f"{_NUMBER}|{_TEXT}"), _as(of["overall_confidence"], "string").try_cast("double"))
    given = {k: x["v"].isNotNull() for k, x in of.items()}
    wrong = [F.when(given[s] & ~_is(of[s], f"{_ARRAY}|{_OBJECT}"), F.lit(s)) for s in SECTIONS]
    wrong += [F.when(given["overall_confidence"] & ~F.coalesce(sure.between(0, 1), F.lit(False)), F.lit("overall_confidence"))]
    wrong += [F.when(given[k] & ~_is(of[k], _TEXT), F.lit(k)) for k in ("raw_text", "notes_on_legibility")]
    texts = {k: F.when(_is(of[k], _TEXT), _as(of[k], "string")).alias(f"_{k}") for k in ("document_type", "raw_text", "notes_on_legibility")}
    entries = [_read(of[s], F.col("_json"), s).alias(f"_{s}") for s in SECTIONS]
    rows = rows.select(*kept, "_text", "_none", F.array_compact(F.array(*wrong)).alias("_wrong"), sure.alias("_sure"), *texts.values(), *entries)
    rows = rows.withColumn("_whole", ~F.col("_none") & (F.size("_wrong") == 0))
    whole, text_ = F.col("_whole"), F.col("_text")
    filled = {s: F.exists(F.col(f"_{s}"), lambda x: x["value"].isNotNull()) for s in SECTIONS}
    # Texts that have something in each section do not go to Python.
    rows = rows.withColumn("_mined", mined(F.when(~(whole & reduce(lambda a, b: a & b, filled.values())), text_)))

    def chosen(s: str) -> Column:
        own = F.transform(F.filter(F.col(f"_{s}"), lambda x: x["value"].isNotNull()), lambda x: x["value"])
        return F.when(whole & filled[s], own).otherwise(_as_items(F.col("_mined")[s], s)).alias(s)

    def is_json(t: Column) -> Column:
        return F.startswith(t, F.lit("{")) | F.contains(t, F.lit('"document_type"'))

    trimmed = F.trim(text_)
    inside = F.regexp_extract(trimmed, r'"raw_text"\s*:\s*"([^"]+)"', 1)
    mined_summary = F.substring(F.when(is_json(trimmed), inside).otherwise(trimmed), 1, MINED_SUMMARY)
    said = F.trim(F.coalesce("_raw_text", F.lit("")))
    own_summary = F.when(is_json(said), "").otherwise(F.substring(said, 1, SUMMARY))
    summary = F.when(whole & ((F.length(F.trim(own_summary)) >= 10) | (mined_summary == "")), own_summary).otherwise(mined_summary)
    own_kind, by_text = document_kind(F.col("_document_type")), kind_of_text(text_)
    rows = rows.withColumn("_own_kind", own_kind).withColumn("_by_text", by_text)
    kind = F.when(whole & ~(F.col("_own_kind").isin(*UNSET) & (F.col("_by_text") != "other")), F.col("_own_kind")).otherwise(F.col("_by_text"))
    notes = F.when(whole, F.coalesce("_notes_on_legibility", F.lit(""))).otherwise(MINED_NOTE)
    sure = F.when(whole, F.coalesce("_sure", F.lit(SURE))).otherwise(MINED_SURE)
    no_place = F.lit(None).cast("int")
    whole_text = F.array(_issue(F.lit("document"), no_place, F.lit("NOT_JSON")))
    of_items = F.concat(*(_issues_of(s) for s in SECTIONS))
    found = F.when(F.col("_none"), whole_text).when(whole, of_items).otherwise(F.transform("_wrong", lambda s: _issue(s, no_place, F.lit("WRONG_TYPE"))))
    return rows.select(
        *kept, kind.alias("document_type"), *(chosen(s) for s in SECTIONS), summary.alias("raw_text"), notes.alias("notes_on_legibility"), sure.alias("overall_confidence"), found.alias("issues")
    )


def fields(extractions: DataFrame, *keys: str) -> DataFrame:
    """Extractions as tall rows: the keys, pos, field_name, field_value, confidence, bounding_box.

    Parties come first and carry their number, then dates, amounts with two decimals and their currency, identifiers,
    the summary if it has more than five characters and the notes if they have more than three.
    """
    row = lambda name, value, sure, box: F.struct(name.alias("field_name"), value.alias("field_value"), sure.alias("confidence"), box.alias("bounding_box"))
    no_box = F.lit(None).cast(BOX)
    label = lambda x: F.when(F.length(x["currency"]) > 0, F.concat(F.lit("amount:"), x["label"], F.lit(" ("), x["currency"], F.lit(")"))).otherwise(F.concat(F.lit("amount:"), x["label"]))
    summary, notes = F.trim("raw_text"), F.trim("notes_on_legibility")
    parts = [
        F.transform("parties", lambda x, i: row(F.concat(F.lit("party:"), x["role"], F.lit("_"), (i + 1).cast("string")), x["name"], x["confidence"], x["bounding_box"])),
        F.transform("dates", lambda x: row(F.concat(F.lit("date:"), x["label"]), x["value"], x["confidence"], x["bounding_box"])),
        F.transform("amounts", lambda x: row(label(x), F.format_string("%.2f", x["value"]), x["confidence"], x["bounding_box"])),
        F.transform("identifiers", lambda x: row(F.concat(F.lit("id:"), x["type"]), x["value"], x["confidence"], x["bounding_box"])),
        F.when(F.length(summary) > 5, F.array(row(F.lit("summary:incident_description"), summary, F.col("overall_confidence"), no_box))).otherwise(F.array()),
        F.when(F.length(notes) > 3, F.array(row(F.lit("notes:legibility_assessment"), notes, F.lit(1.0), no_box))).otherwise(F.array()),
    ]
    # The outer form keeps Spark from looking at the whole expression once more, for rows without fields.
    every = extractions.select(*keys, F.posexplode_outer(F.concat(*parts)).alias("pos", "field"))
    return every.where("pos is not null").select(*keys, "pos", "field.*")


def issues(extractions: DataFrame, *keys: str) -> DataFrame:
    """What was wrong with the texts: the keys, section, position, code."""
    return extractions.select(*keys, F.inline_outer("issues")).where("code is not null")

"""Text mining: names, identifiers, dates and amounts that texts state in set phrases.

All phrases are looked for in one pass: a pattern of their first words finds the places where one may begin, and there
only the phrases with that first letter are tried. Each phrase is matched as if it were searched for alone: from left to
right, without overlaps with itself.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

# How a text names a person in a role.
PARTIES = {
    "complainant": [
        r"(?:complainant|informant)\s*(?:name)?[:\s\-]+([A-Za-z\s.]{3,35})",
        r"(?:inform\s+you\s+that\s+I|beg\s+to\s+state\s+that\s+I|that\s+I|I\b)[,\s]+([A-Z][a-zA-Z\s.]{2,30}?)(?=[,\s]+(?:residing|aged|s/o|d/o|w/o|a\s+resident|\n))",
    ],
    "accused": [r"(?:accused|suspect)\s*(?:name)?[:\s\-]+([A-Za-z0-9\s.,]{3,40})"],
    "panch_witness": [r"(?:panch\s*witness|panch\s*no\.?\s*\d?|witness)\s*[:\s\-]+([A-Za-z\s.]{3,35})"],
    "arrestee": [r"(?:arrestee|person\s*arrested)\s*[:\s\-]+([A-Za-z\s.]{3,35})"],
    "arresting_officer": [r"(?:arresting\s*officer)\s*[:\s\-]+([A-Za-z\s.]{3,35})"],
    "intimated_person": [r"(?:relative|intimated\s*person)\s*[:\s\-]+([A-Za-z\s.]{3,35})"],
    "examining_doctor": [r"(?:examining\s*doctor|medical\s*officer)\s*[:\s\-]+([A-Za-z\s.]{3,35})"],
    "hospital": [r"(?:hospital|institution)\s*[:\s\-]+([A-Za-z\s.]{3,35})"],
    "victim": [r"(?:victim|deceased|injured)\s*(?:name)?[:\s\-]+([A-Za-z\s.]{3,35})"],
    "investigating_officer": [r"(?:investigating\s*officer|io|sho)\s*(?:name)?[:\s\-]+([A-Za-z\s.]{3,35})"],
    "vendor": [r"(?:seller|vendor)\s*(?:name)?[:\s\-]+([A-Za-z0-9\s.,&]{3,40})"],
    "buyer": [r"(?:buyer|customer|bill to)\s*(?:name)?[:\s\-]+([A-Za-z0-9\s.,&]{3,40})"],
}
# How a text states an identifier.
IDENTIFIERS = {
    "FIR Number": r"fir\s*(?:no|number|#)?[:\s.]+([0-9]+(?:\/[0-9]+)?)",
    "Police Station": r"(?:police\s*station|p\.?s\.?|thana)[:\s.]+([A-Za-z\s]{3,30})",
    "Bank Account Number": r"(?:saving\s*account\s*no\.?|account\s*no\.?|a/c\s*no\.?)[:\s.]+([0-9\s]{6,20})",
    "District": r"(?:district|dist)[:\s.]+([A-Za-z\s]{3,25})",
    "Act & Section": r"(?:u/s|sec(?:tion)?|ipc)[:\s.]+([A-Za-z0-9,\s\/]+(?:ipc|act|crpc|bns)?)",
    "FSL Reference No": r"(?:fsl\s*(?:ref|case|report)?\s*no)[:\s.]+([A-Za-z0-9\/\-_]+)",
    "Medico-Legal Record No": r"(?:mlc\s*(?:no|number)|pmr\s*no)[:\s.]+([A-Za-z0-9\/\-_]+)",
    "SHA-256 Hash": r"(?:sha-?256|hash)[:\s.]+([A-Fa-f0-9]{64})",
    "Serial / IMEI Number": r"(?:serial|imei)[:\s.]+([A-Za-z0-9\/\-_]+)",
    "Grounds of Arrest": r"(?:grounds\s*of\s*arrest)[:\s.]+([A-Za-z0-9\s,.\-_]{5,60})",
    "Seal Status": r"(?:seal\s*(?:status|mark|impression))[:\s.]+([A-Za-z0-9\s]{3,30})",
    "GD Entry No": r"(?:g\.?d\.?\s*entry|gd\s*no)[:\s.]+([A-Za-z0-9\/\-_]+)",
    "Invoice Number": r"(?:invoice\s*(?:no|number|#))[:\s.]+([A-Za-z0-9\/\-_]+)",
}
# Pieces of JSON in text, dates, amounts.
FRAGMENTS = {
    "party": r'\{\s*"name"\s*:\s*"([^"]+)"\s*,\s*"role"\s*:\s*"([^"]+)"',
    "identifier": r'\{\s*"type"\s*:\s*"([^"]+)"\s*,\s*"value"\s*:\s*"([^"]+)"',
    "date": r'\{\s*"label"\s*:\s*"([^"]+)"\s*,\s*"value"\s*:\s*"([^"]+)"',
}
DATE = r"\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2})\b"
AMOUNT = r"(?:rs\.?|inr|₹|\$)\s*([\d,]+(?:\.\d{2})?)"
# Names with these words are headings; dates listed; what surrounds a value; confidences; the amount's label.
NO_NAMES, MOST_DATES, AROUND, SURE, FROM_JSON, STATED = ("police", "station", "report", "subject"), 5, ".,;:\"'", 0.85, 0.9, "Property Value / Stated Amount"
# Words that tell the kind of a document from its text, first match wins.
KINDS = {
    "fir_report": ("first information report", "fir", "b.p. form", "police station", "thana"),
    "seizure_memo": ("seizure memo", "panchnama", "fard-e-zabti", "mahazar", "seizure list", "sec 27"),
    "arrest_memo": ("arrest memo", "inspection memo", "d.k. basu", "arrested person"),
    "charge_sheet": ("charge sheet", "chargesheet", "challan", "final report under sec 173", "iif-5"),
    "medical_legal": ("medico-legal", "injury report", "post-mortem", "pmr", "autopsy", "mlc"),
    "forensic_report": ("forensic", "fsl", "ballistic", "toxicology", "65b certificate", "cyber report"),
    "invoice": ("invoice", "bill", "tax invoice", "receipt"),
    "contract": ("contract", "agreement", "mou", "deed"),
    "bank_statement": ("bank", "statement", "passbook"),
}
#: First words of the phrases, and first letters of those that begin otherwise.
_HEADS = (
    "complainant informant inform beg that i accused suspect panch witness arrestee person arresting relative intimated examining medical hospital institution victim deceased injured investigating sho "
    "seller vendor buyer customer bill fir police p.s ps thana saving account a/c dist u/s sec ipc fsl mlc pmr sha hash serial imei grounds seal g.d gd invoice rs inr ₹ $ {"
).split()
_START = re.compile("|".join([*(re.escape(h) for h in sorted(_HEADS, key=len, reverse=True)), r"(?<!\w)\d"]), re.I)


def _first_letters(pattern: str) -> set[str]:
    """The letters that the first words of a phrase begin with."""
    group = re.match(r"\(\?:((?:[^()]|\([^()]*\))*)\)", pattern)
    words = group[1] if group else pattern[0]
    return {w[0].lower() for w in re.sub(r"\([^()]*\)", "", words).split("|")}


def _phrases() -> dict[str, list[tuple[tuple, re.Pattern]]]:
    """All phrases by the letter that they begin with (0 for a digit), each with its place: section, number, label."""
    named = [("party", role, p) for role, several in PARTIES.items() for p in several] + [("identifier", label, p) for label, p in IDENTIFIERS.items()]
    all_ = [((section, i, label), re.compile(p, re.I), _first_letters(p)) for i, (section, label, p) in enumerate(named)]
    all_ += [((f"{kind} fragment", 0, None), re.compile(p, re.I), {"{"}) for kind, p in FRAGMENTS.items()]
    all_ += [(("date", 0, None), re.compile(DATE), {"0"}), (("amount", 0, None), re.compile(AMOUNT, re.I), set("ri₹$"))]
    out = defaultdict(list)
    for place, phrase, letters in all_:
        for letter in letters:
            out[letter].append((place, phrase))
    return out


_BY_LETTER = _phrases()


def _pieces(text: str) -> dict[tuple, list]:
    """Groups of the matches of each phrase, from left to right."""
    found, after = defaultdict(list), {}
    m = _START.search(text)
    while m:
        at = m.start()
        first = text[at].lower()
        for place, phrase in _BY_LETTER.get("0" if first.isdigit() else {"ı": "i", "i̇": "i", "ſ": "s"}.get(first, first), ()):
            if after.get(place, 0) <= at and (hit := phrase.match(text, at)):
                found[place].append(hit.groups())
                after[place] = hit.end()
        m = _START.search(text, at + 1)
    return found


def mine(text: str) -> dict[str, list]:
    """Items of a text by section: parties (name, role), identifiers (type, value), dates (label, value), amounts (label, value, currency), with confidences.

    A name or value counts once, as first found in the order of the phrases; pieces of JSON follow. The first MOST_DATES dates count.
    """
    found = _pieces(text)
    out: dict[str, list] = {"parties": [], "dates": [], "amounts": [], "identifiers": []}
    names, values = set(), set()
    for place in sorted(p for p in found if p[0] in ("party", "identifier")):
        for (value,) in found[place]:
            value = value.strip().strip(AROUND)
            seen, shortest, section = (names, 3, "parties") if place[0] == "party" else (values, 2, "identifiers")
            if len(value) >= shortest and value.lower() not in seen and not (section == "parties" and any(w in value.lower() for w in NO_NAMES)):
                seen.add(value.lower())
                out[section].append((value, place[2], SURE) if section == "parties" else (place[2], value, SURE))
    for kind, seen, section in (("party", names, "parties"), ("identifier", values, "identifiers")):
        for groups in found.get((f"{kind} fragment", 0, None), ()):
            first, second = (g.strip() for g in groups)
            value = first if kind == "party" else second
            if len(value) >= 2 and value.lower() not in seen:
                seen.add(value.lower())
                out[section].append((first, second, FROM_JSON))
    out["dates"] = [(a.strip(), b.strip(), FROM_JSON) for a, b in found.get(("date fragment", 0, None), ())]
    out["dates"] += [(f"Date_{i}", d, SURE) for i, (d,) in enumerate(found.get(("date", 0, None), ())[:MOST_DATES], 1)]
    lower = text.lower()
    currency = "INR" if any(c in lower for c in ("rs", "₹", "inr")) else "USD"
    for (number,) in found.get(("amount", 0, None), ()):
        if digits := number.replace(",", ""):
            out["amounts"].append((STATED, float(digits), currency, SURE))
    return out


_OF = {"parties": ("name", "role"), "dates": ("label", "value"), "identifiers": ("type", "value")}
_TYPE = pa.struct(
    [(s, pa.list_(pa.struct([(a, pa.string()), (b, pa.string()), ("confidence", pa.float64())]))) for s, (a, b) in _OF.items()]
    + [("amounts", pa.list_(pa.struct([("label", pa.string()), ("value", pa.float64()), ("currency", pa.string()), ("confidence", pa.float64())])))]
)


@F.arrow_udf(from_arrow_type(_TYPE))
def mined(text: pa.Array) -> pa.Array:
    """`mine` over a column; null for null."""
    names = {s: (*n, "confidence") for s, n in _OF.items()} | {"amounts": ("label", "value", "currency", "confidence")}
    rows = [None if t is None else {s: [dict(zip(names[s], item)) for item in items] for s, items in mine(t).items()} for t in text.to_pylist()]
    return pa.array(rows, _TYPE)


def kind_of_text(text: Column) -> Column:
    """The kind of a document by the words of its text."""
    lower, found = F.lower(text), F.lit("other")
    for kind, words in reversed(KINDS.items()):
        any_of = F.lit(False)
        for w in words:
            any_of = any_of | F.contains(lower, F.lit(w))
        found = F.when(any_of, kind).otherwise(found)
    return found

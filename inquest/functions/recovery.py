"""Recovery of JSON from model output: fences, text around it, trailing commas, cut-off ends."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_CLOSE = {"{": "}", "[": "]"}


def _closed(out: list[str], bracket: str) -> None:
    """Adds a closing bracket, without the comma that may stand before it. Strings end in a quote: their text is not touched."""
    last = len(out)
    while last and out[last - 1].isspace():
        last -= 1
    if last and out[last - 1] == ",":
        del out[last - 1 :]
    out.append(bracket)


def recovered(text: str | None) -> str | None:
    """The outer JSON object of a text in canonical form, None if there is none. An open end is closed at the last complete value.

    Commas before a closing bracket go, those inside strings stay. Where a start of the text can't be read up to some place,
    no longer start can, so later ends are passed over.
    """
    if not text or "{" not in text:
        return None
    out, open_, quoted, skip, cuts = [], [], False, False, []
    for c in text[text.index("{") :]:
        if quoted:
            quoted = skip or c != '"'
            skip = not skip and c == "\\"
        elif c == '"':
            quoted = True
        elif c in _CLOSE:
            open_.append(_CLOSE[c])
        elif open_ and c == open_[-1]:
            open_.pop()
            _closed(out, c)
            cuts.append((len(out), list(open_)))
            if not open_:
                break
            continue
        elif c == ",":
            cuts.append((len(out), list(open_)))
        out.append(c)
    cuts.append((len(out), list(open_)))
    whole, readable = "".join(out), len(out)
    for end, rest in reversed(cuts):
        if end > readable:
            continue
        start = whole[:end] + '"' if end == len(whole) and quoted else whole[:end].rstrip().removesuffix(",")
        try:
            return json.dumps(json.loads(start + "".join(reversed(rest))), sort_keys=True, ensure_ascii=False)
        except json.JSONDecodeError as e:
            readable = min(readable, e.pos)
    return None


@F.pandas_udf(StringType())
def recovered_json(text: pd.Series) -> pd.Series:
    """`recovered` over a column."""
    return text.map(recovered)

"""Personal data by bootstrapped contextual extraction, in built-in functions only.

Seeds are the e-mail addresses, IP addresses, card and phone numbers that fixed
patterns find, and values behind a sign that have the shape of a digest or key. The
words and the sign before an identifier-like value ("phone:", "member id #",
"token =") are its lexical patterns. Patterns and values form a graph, built
from all documents; scores go back and forth along it: a pattern is worth the
mean confidence of its values, a value the chance that one of its patterns is
right. Patterns of high worth and enough support mark the values behind them
that no seed pattern knows.

Regular expressions work on whole texts inside the row. Positions come from
marks that a replacement sets around each match: the text is split at the marks
and the lengths of the parts are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import if_small, stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: The kinds of all spans: those of the base patterns, and what only stands behind learned patterns.
NAMES = (*KINDS, "secret")
#: Rounds of scoring; the worth and the number of trusted values from which a pattern is used; the shortest unseen value.
ROUNDS, WORTH, SUPPORT, SHORTEST = 3, 0.6, 3.0, 5

# The fixed patterns, written so that a failed try at one place rules out the rest of its run (possessive, with look-behind): time stays linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Behind a sign: groups of digits with single spaces between them, or a run of the characters of names and keys. What is looked for ahead ends at the next sign.
CUE = r"""[:=#][ \t]{0,4}+["'<]?+(?=[^\s:=#]*[0-9@])(?:[+(]{0,2}+[0-9][0-9()./+-]*+(?: [0-9(][0-9()./+-]*+)*+(?![A-Za-z0-9@_%])|[+A-Za-z0-9][A-Za-z0-9._%+@/-]*+)"""
SECRET = "^(?=.*[0-9].*[0-9].*[0-9])(?=.*[a-f].*[a-f].*[a-f])[0-9a-f]{32,128}$"

OPEN, SHUT, OTHER = "\x01", "\x02", "\x03"
SPAN = "array<struct<start:int,stop:int,value:string>>"


def _spans(text: Column, pattern: str) -> Column:
    """Matches in order as structs of start, stop (code points) and value."""
    clean = F.translate(text, OPEN + SHUT, OTHER + OTHER)  # neither sign is in a pattern's alphabet
    parts = F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{OPEN}$0{SHUT}")), OPEN)
    first = F.struct(F.length(parts[0]).alias("at"), F.array().cast(SPAN).alias("found"))

    def add(made: Column, part: Column) -> Column:
        value = F.substring_index(part, SHUT, 1)
        one = F.struct(made["at"].alias("start"), (made["at"] + F.length(value)).alias("stop"), value.alias("value"))
        return F.struct((made["at"] + F.length(part) - 1).alias("at"), F.concat(made["found"], F.array(one)).alias("found"))

    return F.aggregate(F.slice(parts, 2, F.size(parts)), first, add, lambda made: made["found"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn check: every second one from the right doubled, the digit sum a multiple of ten."""
    figures = F.split(F.reverse(_digits(value)), "")
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    worth = F.transform(F.filter(figures, lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, twice(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def _is_ip(value: Column) -> Column:
    """Whether all four parts are at most 255, however many zeros lead."""
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))


def base_spans(text: Column) -> Column:
    """The seeds in a text: an array of structs of kind (a number, as in KINDS), start, stop and value, by kind and start."""
    none = F.array().cast(SPAN)
    count = lambda s: F.length(_digits(s["value"]))
    email = F.when(F.instr(text, "@") > 0, _spans(text, EMAIL)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), F.filter(_spans(text, IP), lambda s: _is_ip(s["value"]))).otherwise(none)
    card = F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), F.filter(_spans(text, CARD), lambda s: _luhn(s["value"]))).otherwise(none)
    phone = F.when(F.instr(text, "+") > 0, F.filter(_spans(text, PHONE), lambda s: count(s).between(8, 15))).otherwise(none)

    def of_kind(k: int, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))

    return F.concat(*(of_kind(k, found) for k, found in enumerate((email, ip, card, phone))))


def cues(text: Column) -> Column:
    """Identifier-like values behind a word and a sign: an array of structs of start, stop, value, word, two words (with the sign)."""
    parts = F.filter(_spans(text, CUE), lambda s: s["stop"] > 0)

    def one(s: Column) -> Column:
        value = F.regexp_extract(s["value"], r"""^[:=#][ \t]*["'<]?(.*?)[().\-]*$""", 1)
        begin = s["start"] + F.length(F.regexp_extract(s["value"], r"""^[:=#][ \t]*["'<]?""", 0))
        sign = F.substring(s["value"], 1, 1)
        before = F.lower(F.substring(text, F.greatest(s["start"] - 63, F.lit(1)), F.least(s["start"], F.lit(64))))
        word, two = F.regexp_extract(before, r"(\p{L}+)[ \t]*$", 1), F.regexp_extract(before, r"(\p{L}+[ \t]+\p{L}+)[ \t]*$", 1)
        return F.struct(
            begin.alias("start"), (begin + F.length(value)).alias("stop"), value.alias("value"),
            F.when(word != "", F.concat(word, sign)).alias("word"), F.when(two != "", F.concat(F.regexp_replace(two, r"[ \t]+", " "), sign)).alias("two"),
        )

    found = F.filter(F.transform(parts, one), lambda s: s["word"].isNotNull())
    empty = F.array().cast("array<struct<start:int,stop:int,value:string,word:string,two:string>>")
    return F.when(text.rlike(r"\p{L}[ \t]*[:=#]"), found).otherwise(empty)


def _edges(found: DataFrame) -> DataFrame:
    """A row for each cue and pattern: row, start, stop, value, pattern, and the kind of the seed that it is or meets (null: none)."""
    one = found.select("row", "base", F.explode("cues").alias("c"))
    meets = F.filter("base", lambda b: (b["start"] < F.col("c.stop")) & (b["stop"] > F.col("c.start")))
    rows = one.select("row", "c.start", "c.stop", "c.value", "c.word", "c.two", meets.alias("meets"))
    met = F.size("meets") > 0
    secret = F.when(F.col("value").rlike(SECRET), len(KINDS))
    known = rows.select(
        "row", "start", "stop", F.when(met, F.col("meets")[0]["value"]).otherwise(F.col("value")).alias("value"),
        F.when(met, F.col("meets")[0]["kind"]).otherwise(secret).alias("kind"), F.explode(F.array_compact(F.array("word", "two"))).alias("pattern"),
    )
    return known.where(F.col("kind").isNotNull() | (F.length("value") >= SHORTEST))


def learn(edges: DataFrame) -> DataFrame:
    """Patterns of high worth: pattern, kind. edges: pattern, value, kind (null for values that no seed pattern knows).

    Values and patterns are distinct in the graph, however often copies of a document repeat them. Confidence starts at
    1 for seeds and 0 for other values; ROUNDS times, a pattern's worth is the mean confidence of its values, and a value
    that is no seed is as confident as the chance that one of its accepted patterns holds.
    """
    graph = stored(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pattern-graph")
    scored = graph.withColumn("trust", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0))
    for turn in range(ROUNDS):
        of_kind = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)) for k in range(len(NAMES))]
        most = F.greatest(*of_kind)
        kind = F.coalesce(*(F.when(n == most, k) for k, n in enumerate(of_kind)))
        judged = scored.groupBy("pattern").agg(F.avg("trust").alias("worth"), F.sum("trust").alias("support"), kind.alias("as_kind"))
        good = stored(judged.where((F.col("worth") >= WORTH) & (F.col("support") >= SUPPORT)), "patterns")
        if turn == ROUNDS - 1 or good.isEmpty():
            break
        by = good.select(F.col("pattern").alias("by"), "worth")
        held = graph.where("kind IS NULL").join(by, F.col("pattern") == F.col("by"))
        trust = held.groupBy("value").agg((1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("worth"), F.lit(1e-6)))))).alias("trust"))
        new = stored(trust, "trust").withColumnRenamed("value", "of")
        joined = graph.join(new, F.col("value") == F.col("of"), "left")
        scored = joined.select("pattern", "value", "kind", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("trust", F.lit(0.0))).alias("trust"))
    return good.select("pattern", F.col("as_kind").alias("kind"))


def _found(docs: DataFrame, text: str, *kept: Column) -> DataFrame:
    """The columns `kept`, row (a number), base (seed spans) and cues of each row: each text is matched once."""
    whole = text_of(text)
    return stored(docs.select(*kept, F.monotonically_increasing_id().alias("row"), base_spans(whole).alias("base"), cues(whole).alias("cues")), "spans")


def _with_added(found: DataFrame) -> DataFrame:
    """`found` with added: the spans that learned patterns find and no seed pattern."""
    none = F.array().cast("array<struct<kind:int,start:int,stop:int,value:string>>")
    edges = stored(_edges(found), "cues")
    good = learn(edges)
    if good.isEmpty():
        return found.withColumn("added", none)
    unseen = edges.where(F.col("kind").isNull() | (F.col("kind") == len(KINDS))).drop("kind")
    hits = unseen.join(good.withColumnRenamed("pattern", "by"), F.col("pattern") == F.col("by"))
    once = hits.groupBy("row", "start", "stop", "value").agg(F.min("kind").alias("kind"))
    added = stored(once.groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop", "value"))).alias("added")), "added")
    joined = found.join(if_small(added), F.col("row") == F.col("of"), "left").drop("of")
    return joined.withColumn("added", F.coalesce("added", none))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base (seed spans), added (spans that learned patterns found). Spans: structs of kind (a number, as in NAMES), start, stop, value.

    Null and empty texts have no spans, an empty table no rows. Rows with equal doc_id and text get equal spans, each row
    its own. Texts of any length are read whole, once, and do not cross the network. Other columns take no part.
    """
    return _with_added(_found(docs, text, F.col(doc_id).alias("doc_id"))).select("doc_id", "base", "added")


def _told(spans: Column) -> Column:
    """Spans as kind:start:end, joined with commas."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of its seeds, spans (all of them as text) and their number n_spans."""
    found = detect(docs)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    everything = F.array_sort(F.concat("base", "added"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
        _told(everything).alias("spans"), F.size(everything).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with every span in `text` replaced by its kind in brackets, overlapping spans by the first one's.

    Rows without spans stay as they are (null and empty texts too), repeated rows each for itself, and other columns
    whatever their names. An empty table gives an empty one. Each text is matched once, and stored with its spans.
    """
    found = _with_added(_found(docs, text, F.struct("*").alias("doc")))
    spans = F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in NAMES))
    whole = F.col("doc")[text]

    def cut(made: Column, s: Column) -> Column:
        gap = F.concat(made["out"], F.substring(whole, made["at"] + 1, s["start"] - made["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(made["at"], s["stop"]).alias("at"), F.when(s["start"] >= made["at"], gap).otherwise(made["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.array_sort(spans), start, cut, lambda made: F.concat(made["out"], F.substring(whole, made["at"] + 1, F.length(whole))))
    new = F.when(F.size("base") + F.size("added") > 0, done).otherwise(whole)
    return found.select(*((new if name == text else F.col("doc")[name]).alias(name) for name in docs.columns))

"""Groups of spelling variants: words one edit apart, each variant pointing at its much more frequent neighbour.

Of two words one edit apart, one half is intact. In a dictionary sorted forwards, words that share their first half are
a range; in one sorted by reversed words, those that share their second half are. Ranges are keys here: a sort-merge
join scans them. A range of many words is subdivided: what its words do not share yet is halved again, and again one
half is intact, so that a word goes to two smaller ranges and no pair is lost. It ends where one code point is left,
and there all words of a range are near each other. Only ranges that are large are divided. Pairs are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import if_small, stored, text_of

#: Code points and occurrences of a word at least.
LENGTH, TIMES = 5, 3
#: Words of a range above which it is subdivided.
MOST_WORDS = 48
#: A form occurs this many times as often as its variant at least.
RATIO = 2
#: One run of `SPOILT` loses a code point: planted misspellings.
SPOILT = 97
_RUN = "[A-Za-z\\u00C0-\\u00FF]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dictionary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents -> (word, n): all words of at least LENGTH code points that occur at least TIMES times, counted before the shuffle.

    Runs of letters, A-Z lower-cased; a run whose crc32 behind the id is divisible by SPOILT loses one code point.
    Shorter runs cannot give a word and are passed over by the pattern.
    """
    runs = docs.select(text_of(key).alias("key"), F.explode(F.regexp_extract_all(text_of(text), F.lit(f"{_RUN}{{{LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select(F.translate("run", _UPPER, _LOWER).alias("run"), "key")
    h = F.crc32(F.concat_ws(":", "key", "run"))
    runs = runs.select("run", h.alias("h"), (h % F.length("run")).cast("int").alias("at"))
    shorter = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % SPOILT == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TIMES)


def _left(word: str, n: str) -> Column:
    return F.expr(f"substring({word}, 1, {n})")


def _entries(words: DataFrame) -> DataFrame:
    """Each word as it may meet others: by one replaced code point those of its length, by one inserted those one longer or shorter.

    `kind`, `size` (code points of the shorter word) and what is shared already: the first `s` and the last `t` code
    points. `below`: the words of a pair share fewer than so many first code points, else the pair is in another range.
    """
    n = F.length("word")
    kinds = [("replaced", n, False), ("inserted", n, False), ("inserted", n - 1, True)]
    each = F.array(*(F.struct(F.lit(k).alias("kind"), size.alias("size"), F.lit(longer).alias("longer")) for k, size, longer in kinds))
    return words.select("word", "n", F.inline(each)).select("*", F.lit(0).alias("s"), F.lit(0).alias("t"), F.lit(None).cast("int").alias("below"))


def _halved(rows: DataFrame) -> DataFrame:
    """Every row twice: with the first and with the second half of what was not shared yet. `key` names the range."""
    rest = F.col("size") - F.col("s") - F.col("t")
    inserted = F.col("kind") == "inserted"
    half = F.when(inserted, F.ceil(rest / 2)).otherwise(F.floor(rest / 2)).cast("int")
    first = F.struct((F.col("s") + half).alias("s"), F.col("t").alias("t"), F.col("below").alias("below"))
    second = F.struct(F.col("s").alias("s"), (F.col("t") + rest - half + inserted.cast("int")).alias("t"), F.when(inserted, F.col("s") + half).alias("below"))
    out = rows.select("word", "n", "kind", "size", "longer", F.inline(F.array(first, second)))
    shared = F.concat_ws("\u0001", "kind", "size", "s", _left("word", "s"), F.expr("right(word, t)"))
    return out.withColumn("key", shared)


def _divisible(rows: DataFrame) -> DataFrame:
    """Ranges of too many words, of those that can be halved again."""
    rest = F.col("size") - F.col("s") - F.col("t")
    return rows.where(rest > F.when(F.col("kind") == "inserted", 0).otherwise(1)).groupBy("key").agg(F.count(F.lit(1)).alias("_words")).where(F.col("_words") > MOST_WORDS).select("key")


def near_pairs(words: DataFrame) -> DataFrame:
    """Distinct words (word, n) -> (a, a_n, b, b_n): each pair exactly one edit apart, once."""
    rows, ranges = stored(_halved(_entries(words)), "ranges"), None
    while True:
        large = stored(_divisible(rows), "large-ranges")
        if large.isEmpty():
            break
        fine = rows.join(if_small(large), "key", "left_anti")
        ranges = fine if ranges is None else ranges.unionByName(fine)
        rows = stored(_halved(rows.join(if_small(large), "key", "left_semi")), "ranges")
    ranges = rows if ranges is None else ranges.unionByName(rows)
    a = ranges.where("not longer").select("key", "kind", "below", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = ranges.where("longer or kind = 'replaced'").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    apart = (F.col("below").isNull() | (_left("a", "below") != _left("b", "below"))) & (F.levenshtein("a", "b", 1) == 1)
    met = a.join(b, "key").where(((F.col("kind") == "inserted") | (F.col("a") < F.col("b"))) & apart)
    return met.select("a", "a_n", "b", "b_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last. Each round doubles the steps; counts at least double with a step, so rounds are few."""
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = state.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved"))
        moved = stored(moved, "roots", (state,))
        state = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return state


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents -> word, n, n_near, form, form_n, root, a row per word of the dictionary.

    `form` is the near word with the most occurrences (ties: the smallest in code-point order), if it has RATIO times
    as many; `root` is where forms lead in the end, the word itself without one. Null and empty texts have no words; a
    null id counts as the empty id; long texts are read whole; repeated rows count again. An empty table gives an empty
    result. Further columns of the documents are not read, so their names cannot clash.
    """
    words = stored(dictionary(docs, key, text), "dictionary")
    ways = F.array(*(F.struct(F.col(x).alias("word"), F.col(f"{y}_n").alias("other_n"), F.col(y).alias("other")) for x, y in ("ab", "ba")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_pairs(words).select(F.inline(ways)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    often = -F.col("best")["less"] >= RATIO * F.col("n")
    met = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best")["form"]).alias("form"), F.when(often, -F.col("best")["less"]).alias("form_n")
    )
    met = stored(met, "forms")
    return met.join(_roots(met.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))

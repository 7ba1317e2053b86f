"""Set pairs and nested values against plain definitions."""

import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from inquest.operators import leaves, similar


@pytest.mark.parametrize("measure, least, shared, long", [("jaccard", 0.5, 1, 64), ("dice", 0.68, 2, 64), ("dice", 0.68, 2, 7), ("jaccard", 1.0, 2, 64)])
def test_pairs_are_those_of_all_comparisons(spark, monkeypatch, measure, least, shared, long):
    monkeypatch.setattr(similar, "LONG", long)
    rng = random.Random(len(measure) + long)
    sets = {f"s{k:03d}": (rng.choice("xyyy"), [w for w in "abcdefghijklm" if rng.random() < rng.choice((0.2, 0.5, 0.9))]) for k in range(150)}
    sets |= {"e1": ("x", []), "e2": ("x", []), "d1": ("y", ["a", "a", "b"]), "d2": ("y", ["a", "b"])}
    want = set()
    for (a, (x, s)), (b, (y, t)) in combinations(sorted(sets.items()), 2):
        s, t = set(s), set(t)
        common = len(s & t)
        like = (2 * common / (len(s) + len(t)) if measure == "dice" else common / len(s | t)) if s and t and x == y else 0
        if like >= least - 1e-12 and like:
            want.add((a, b) if (len(s), a) < (len(t), b) else (b, a))
    got = [(r.left_id, r.right_id) for r in similar.set_pairs(spark.createDataFrame([(k, *v) for k, v in sets.items()], "id string, block string, items array<string>"), least, measure, shared).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_letters_count_repeats(spark):
    rows = similar.letters(spark.createDataFrame([("1", "b", "abba"), ("2", "b", "a b"), ("3", "b", "")], "id string, block string, name string")).collect()
    assert {r.id: sorted(r["items"]) for r in rows} == {"1": ["a1", "a2", "b1", "b2"], "2": [" 1", "a1", "b1"]}


def test_leaves_match_the_recursive_definition(spark):
    def plain(value):
        if value is None:
            return set()
        if isinstance(value, (dict, list)):
            return {x for item in (value.values() if isinstance(value, dict) else value) for x in plain(item)}
        return {str(value).strip()} - {""}

    rng = random.Random(3)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.35:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        if depth and kind < 0.65:
            return {rng.choice("abc"): value(depth - 1) for _ in range(rng.randint(0, 3))}
        return rng.choice([None, True, False, 7, -2, 1.5, " x ", "", "[no json", "é", "[1]"])

    rows = [(k, json.dumps(v), v) for k, v in enumerate([*({"v": value(6)} for _ in range(80)), [[[[[[[["deep"]]]]]]]], [], {}])]
    texts = [(200, "plain", {"plain"}), (201, "0123", {"0123"}), (202, "[broken", {"[broken"}), (203, None, set()), (204, "  ", set()), (205, "1e5", {"1e5"})]
    df = spark.createDataFrame([r[:2] for r in rows] + [t[:2] for t in texts], "id int, value string")
    got = {}
    for r in leaves.leaves(df, "value", "id").collect():
        assert r.value not in got.setdefault(r.id, set())
        got[r.id].add(r.value)
    assert got == {k: v for k, v in [*((k, plain(v)) for k, _, v in rows), *((t[0], t[2]) for t in texts)] if v}
    forms = spark.createDataFrame([('{"b": 1, "a": [2]}',), ('{"a":[2],"b":1}',), ("x",)], "v string").select(leaves.canonical(F.col("v")).alias("c")).distinct()
    assert forms.count() == 2

"""Verdicts about URLs, ranked search and spelling variants, each held against a plain definition."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from inquest.llm import queries, ranking, spelling, url_rules
from inquest.storage import table
from tests.conftest import SMALL
from tests.llm import brute

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Verdicts about URLs


def split_url(url):
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match("[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = []
    for verdict, rule in url_rules.RULES:
        at, slash, rest = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith(slash + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def plain_verdicts(pages, links):
    """page_id -> (host, path, rule, verdict); links are pairs of addresses."""
    component = brute.roots({n for e in links for n in e}, links)
    blocked = {component[n] for n in component if plain_rule(*split_url("://" + n))[1] == "block"}
    out = {}
    for i, url in pages:
        host, path = split_url(url)
        rule, verdict = plain_rule(host, path)
        node = host + re.match("[^#]*", (url or "").partition("://")[2][len(host) :])[0]
        out[i] = (host, path, rule, verdict or ("block" if component.get(node) in blocked else "allow"))
    return out


def canonical(url):
    return f'<html><head><link href="{url}" rel="canonical"></head><body>x</body></html>'


def test_block_decisions_reach_aliases(spark):
    pages = [
        (1, "http://a.net/1", canonical("https://b.net/1")), (2, "https://B.net/1#top", '<meta content="0; url=http://x.example.org/es/7" http-equiv="Refresh">'),
        (3, "http://x.example.org/es/7", "no links"), (4, "http://example.org/y", canonical("http://x.example.org/es/7")), (5, "http://a.net/2?q=1", canonical("/other")),
        (6, "http://a.net/other", "<!-- " + canonical("http://x.com/de/1") + " --><p>x"), (7, None, canonical("http://x.com/de/1")), (8, "no scheme/com/de/", None), (9, "ftp://com/de/", ""),
        (10, "http://example.org", ""), (11, "http://example.organ/es/", ""), (12, "http://u.example.org/en/123?x#y", ""), (13, "http://q.net", "<script>" + canonical("http://x.com/de/1") + "</script>"),
        (14, "http://com/fr/", canonical("http://com/de/")), (15, "http://z.net/", '<base href="http://com/de/"><link rel="Canonical" href=x>'), (16, "http://[bad/", canonical("http://[worse")),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string").repartition(3)
    got, joined = ({r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, rules).collect()} for rules in (url_rules.RULES, spark.createDataFrame(url_rules.RULES, "verdict string, rule string")))
    assert got == joined
    links = [("a.net/1", "b.net/1"), ("b.net/1", "x.example.org/es/7"), ("example.org/y", "x.example.org/es/7"), ("a.net/2?q=1", "a.net/other"), ("com/fr/", "com/de/"), ("z.net/", "com/de/x")]
    assert got == plain_verdicts([p[:2] for p in pages], links)
    assert [got[k][3] for k in (1, 2, 3, 4, 5, 7, 9, 14, 15)] == ["block", "block", "block", "allow", "allow", "allow", "block", "allow", "block"]


def test_many_rules_are_joined(spark):
    rng = random.Random(7)
    part = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    rules = list({(rng.choice(["allow", "block"]), ".".join(part() for _ in range(rng.randint(1, 2))) + "/" + rng.choice(["", part(), part() + "/"])) for _ in range(150)}) + [("block", "ab"), ("allow", "a/"), ("block", "a/")]
    pages = [(i, f"http://{'.'.join(part() for _ in range(rng.randint(1, 3)))}{rng.choice(['', '/', '/' + part(), '/' + part() + '/' + part()])}") for i in range(300)] + [(1000, None), (1001, "a/")]
    got = url_rules.judge(spark.createDataFrame([(*p, None) for p in pages], "page_id long, url string, html string"), spark.createDataFrame(rules, "verdict string, rule string")).collect()
    for r in got:
        host, path = split_url(dict(pages)[r.page_id])
        fits = []
        for verdict, rule in rules:
            at, slash, rest = rule.partition("/")
            if host and (host == at or host.endswith("." + at)) and path.startswith(slash + rest):
                fits.append((len(rule), verdict == "allow", rule, verdict))
        want = max(fits)[2:] if fits else (None, "allow")
        assert (r.rule, r.verdict) == want
    assert len(got) == 302 and sum(r.rule is not None for r in got) > 60


def test_redirects_from_elsewhere_and_chains(spark):
    pages = [(i, f"http://h{i}.net/") for i in range(40)] + [(99, "http://t.com/de/x")] * 2
    edges = [(f"http://h{i}.net/", f"https://h{i + 1}.net/") for i in range(0, 30)] + [("http://h30.net/#a", "http://t.com/de/x"), (None, "http://h35.net/"), ("", "x")]
    got = url_rules.judge(spark.createDataFrame([(*p, None) for p in pages], "page_id long, url string, html string"), redirects=spark.createDataFrame(edges, "source string, target string")).collect()
    assert len(got) == 42 and {r.page_id for r in got if r.verdict == "block"} == {*range(31), 99}
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Ranked search


def plain_ranks(docs, items, k=20):
    words = [(d, Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER)))) for d, t in docs]
    lengths = [c.total() for _, c in words]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(w for _, c in words for w in c)
    out = []
    for item, text in items:
        asked = Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER)))
        scores = []
        for (d, c), n in zip(words, lengths):
            s = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * (75 + 25 * n * n_docs // n_terms)))
                for w, times in asked.items()
                if c[w]
            )
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def zipf_text(rng, n, words=400):
    return " ".join(rng.choice(("w", "W", "é")) + str(int(words ** rng.random())) for _ in range(n))


@pytest.mark.parametrize("most_terms, cells, k", [(200_000, 2_000_000, 20), (60, 40, 3)])
def test_ranks_match_brute_force(spark, monkeypatch, most_terms, cells, k):
    monkeypatch.setattr(ranking, "MOST_TERMS", most_terms)
    monkeypatch.setattr(ranking, "CELLS", cells)
    rng = random.Random(4)
    docs = [(i, zipf_text(rng, rng.choice((0, 3, 30, 200)))) for i in range(300)]
    docs += [(i + 1000, docs[7][1]) for i in range(30)] + [(5, None), (5, docs[7][1]), (2000, "."), (2001, "Ünique\x00word"), (2002, "x " * 30_000 + docs[9][1])]
    items = [(i, zipf_text(rng, rng.choice((1, 5, 40)))) for i in range(25)] + [(50, None), (51, ""), (52, docs[7][1]), (53, "nowhere"), (54, "ünique Word w1 w1 w1"), (55, "Ünique")]
    got = ranking.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(*i, "x") for i in items], "item_id int, text string, doc_id string"), k)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_ranks(docs, items, k)


def test_ranks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert ranking.rank(docs.limit(0), items).count() == 0 and ranking.rank(docs, items.limit(0)).count() == 0
    assert ranking.rank(docs, items).schema.simpleString() == ranking.rank(docs, items.limit(0)).schema.simpleString()
    again = ranking.rank(docs.withColumn("doc_id", docs.doc_id * 0).unionByName(docs), items.unionByName(items)).collect()
    assert sorted((r.item_id, r.rank, r.doc_id) for r in again) == [("i", 1, 0), ("i", 1, 0), ("i", 2, 1), ("i", 2, 1)]


def test_bounds_drop_terms_that_cannot_decide():
    class Item:
        def __init__(self, item_id, terms, times):
            self.item_id, self.terms, self.times = item_id, terms, times

    block = ranking.Block([Item(1, ["rare", "common", "also"], [1, 2, 1]), Item(2, ["common"], [1])])
    at = {t: k for k, t in enumerate(block.terms)}
    first, kth = ([0] * 3, [0] * 3)
    for name, a, b in (("rare", 100, 50), ("common", 10, 9), ("also", 29, 1)):
        first[at[name]], kth[at[name]] = a, b
    block.raise_bound(np.array(first), np.array(kth))
    block.prune()
    assert block.bound.tolist() == [50, 9] and block.rest.tolist() == [49, 0]
    assert block.needed.tolist() == [True, False, False, True]


# Spelling variants


def plain_variants(docs):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near_of = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in near_of.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (n, len(near_of[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items()}


def found_variants(df):
    rows = spelling.variants(df).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


@pytest.mark.parametrize("most_words", [48, 1])
def test_variants_match_brute_force(spark, monkeypatch, most_words):
    monkeypatch.setattr(spelling, "MOST_WORDS", most_words)
    rng = random.Random(8)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "ababab", "x" * 40, "x" * 41, "÷×ÿaaa"]
    docs = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = list(stems[int(len(stems) ** rng.random()) - 1])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["a", "b", "", "é"])
            words.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        docs.append((i, " ".join(words)))
    docs += [(None, "aaaaa " * 5), (7, None), (8, ""), (9, "abc-abcde_abcde" * 200), (9, "aaaaa " * 30_000)]
    want = plain_variants(docs)
    assert any(v[2] and v[4] != v[2] for v in want.values()) and len(want) > 100
    assert found_variants(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string").repartition(3)) == want


def test_variants_of_the_documents(spark):
    docs = table(spark, SMALL, "documents")
    assert found_variants(docs) == plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert spelling.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_urls", "op12_ranking"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SMALL).select(*(c[0] for c in cursor.description))
    want = cursor.fetchall()
    assert want and sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)

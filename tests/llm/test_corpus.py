"""Operators that look at many rows: mixing, passages, links, pages, archives, and the pipeline."""

import hashlib
import random
import struct

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from inquest.llm import byte_bpe, embeddings, jaccard, mixing, passages, quality, style_tree, warc
from inquest.storage import table
from tests.conftest import SMALL
from tests.llm import brute


def test_mixing(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "big" if i < 800 else ("small" if i < 990 else None)) for i in range(1000)], "doc_id long, text string, source string")
    rows = mixing.replicate(docs.withColumn("copy", F.lit("clash"))).collect()
    share = {s: sum(r.source == s for r in rows) / len(rows) for s in ("big", "small", None)}
    assert all(abs(v - 1 / 3) < 0.06 for v in share.values()) and abs(len(rows) - 1000) < 120
    copies = {}
    for r in rows:
        copies.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(c) == list(range(len(c))) for c in copies.values())
    assert mixing.replicate(docs.limit(0)).count() == 0
    only = mixing.replicate(docs, {"small": 1.0}).select("source").distinct().collect()
    assert [r.source for r in only] == ["small"]


def test_mixing_of_a_tiny_source(spark):
    docs = spark.createDataFrame([(i, "a") for i in range(400)] + [(1000, "b")], "doc_id long, source string")
    n = mixing.replicate(docs).where("source = 'b'").count()
    assert 130 < n < 275  # mean 200.5, a sum of several draws


def _words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randint(0, 9999)) for _ in range(n)]


def test_passages(spark):
    rng = random.Random(2)
    exact, fuzzy = _words(rng, 60), _words(rng, 120)
    docs, has = [], {}
    for k in range(60):
        words = _words(rng, rng.randint(30, 150))
        if k % 6 == 0:
            words[10:10] = exact
        if k % 7 == 0:
            copy = list(fuzzy)
            copy[rng.randrange(20, 100)] = "edited"
            words += copy
        has[k] = (k % 6 == 0) + (k % 7 == 0)
        docs.append((k, " ".join(words)))
    docs += [(900, None), (None, " ".join(exact)), (901, "short text")]
    rows = passages.repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in rows} == {k for k, n in has.items() if n}
    texts = dict(docs)
    for r in rows:
        mine = texts[r.doc_id].split()[r.begin_word : r.end_word]
        other = texts[r.other_id].split()[r.other_begin_word : r.other_end_word]
        assert len(mine) >= 50 and len(set(mine) & set(other)) >= 0.8 * len(set(mine))
    assert all(any(r.doc_id == k and r.begin_word <= 10 and r.end_word >= 70 for r in rows) for k in range(0, 60, 6))
    assert passages.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chains_take_the_best_order():
    found = np.array([[0, 100, 20], [30, 10, 8], [40, 140, 20], [90, 190, 30]])
    assert passages.chains(found)[0].tolist() == [0, 2, 3]


def _near_docs(rng, n):
    base = [_words(rng, rng.choice([1, 3, 4, 5, 6, 9, 10, 20, 60, 150])) for _ in range(25)]
    docs = []
    for k in range(n):
        words = list(rng.choice(base) if k % 3 else max(base, key=len))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"zz{rng.randint(0, 300)}"
        docs.append((k * 3 + 1, " ".join(words).upper() if k % 5 == 0 else "\n ".join(words)))
    return docs


def test_jaccard_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # so that blocks, pivots and what they leave are all used
    docs = _near_docs(random.Random(5), 500) + [(100_001, None), (100_002, ""), (100_003, " \t")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame).collect()}
    assert got == brute.near_groups(docs)


def test_sampled_elements_keep_every_link():
    """Of two sets at the threshold, neither misses what it needs among the elements that both sample."""
    rng = np.random.default_rng(4)
    none = np.zeros(0, np.uint64)
    for n in (4, 5, 9, 10, 45, 79, 80, 81, 90, 101, 125, 333, 1000):
        for _ in range(40):
            both = rng.integers(0, 2**64, n, dtype=np.uint64)
            differ = n // 4  # 0.8 exactly where n is a multiple of 4
            cut = int(rng.integers(0, differ + 1))
            extra = rng.integers(0, 2**64, differ, dtype=np.uint64)
            a, b = np.unique(np.concatenate([both, extra[:cut]])), np.unique(np.concatenate([both, extra[cut:]]))
            if jaccard.links(n, len(a), len(b)):
                often = np.sort(rng.choice(both, n // 3, replace=False))
                for frequent in (none, often):
                    (x, own, need), (y, _, _) = jaccard.sampled(a, frequent), jaccard.sampled(b, frequent)
                    assert np.isin(x[own], y).sum() >= need


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 16))
    x[100:160] = x[0] + 0.25 * rng.normal(size=(60, 16))
    x[160:170] = x[1]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None, 1.0]), (504, [1.0, 2.0]), (505, []), (None, rows[3][1])]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    linked = (y @ y.T >= 0.9) & ~np.eye(400, dtype=bool)
    component = brute.roots(range(400), zip(*np.nonzero(linked)))
    found = sum(got[i].n_links for i in range(400))
    assert found >= 0.99 * linked.sum() and all(got[i].n_links <= linked[i].sum() for i in range(400))
    assert sum(got[i].component_id == component[i] for i in range(400)) >= 398
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(500, 506))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("most_cells", [2048, 16])
def test_recall_over_many_cells(spark, monkeypatch, most_cells):
    """Pairs of cosine 0.90 to 0.92 among random vectors, over 200 cells of one level and over cells in cells."""
    monkeypatch.setattr(embeddings, "CELL", 20)
    monkeypatch.setattr(embeddings, "MOST_CELLS", most_cells)
    rng, n, m = np.random.default_rng(3), 4000, 600
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(rng.normal(size=(n, 64)))
    c, side = rng.uniform(0.901, 0.92, m)[:, None], rng.normal(size=(m, 64))
    side = unit(side - (side * x[:m]).sum(1)[:, None] * x[:m])
    every = np.concatenate([x, c * x[:m] + np.sqrt(1 - c * c) * side])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    assert len(embeddings.fit_cells(frame)[64].first) * (len(embeddings.fit_cells(frame)[64].second) if most_cells == 16 else 1) >= 200
    rows = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    found = sum(rows[n + i].n_links == 1 and rows[n + i].component_id == i for i in range(m))
    assert found >= 0.95 * m and sum(r.n_links for r in rows.values()) == 2 * found


def test_vectors_of_repeated_ids_and_other_columns(spark):
    one, near, far = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, one, 3, 1), (1, far, 3, 2), (2, near, 4, 3), (3, far, 5, 4), (None, one, 6, 5)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep long, cell int")).collect()
    want = [(1, 2), (1, 1), (2, 2), (3, 1), (None, None)]
    assert sorted((str(r.vec_id), str(r.component_id)) for r in got) == sorted((str(i), "None" if i is None else "1") for i, _ in want)


PAGE = '<html><body><nav><a>Menu</a></nav><header>Site</header><div class="ad">Buy {i}</div><div class="x7">Follow us</div><article><h1>Title {i}</h1><p>One&nbsp;&amp; <b>two</b> {i}<br>three<p>Four<form>sign</form><aside>side</aside></article><div id="comments"><p>me too</p></div><footer>end</footer><script>var a = "</p>";</script></body></html>'


def test_main_text(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.format(i=i)) for i in range(8)] + [(100, None, None), (101, "x", ""), (102, "http://o.example", "plain & simple\n text"), (102, "http://o.example", "plain & simple\n text")]
    rows = style_tree.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == len(pages)
    texts = {r.page_id: r.text for r in rows}
    assert texts[3] == "Title 3\nOne & two 3 three\nFour"
    assert texts[100] == texts[101] == "" and texts[102] == "plain & simple text"


def test_template_branches_go_without_an_article(spark):
    page = "<html><body><div class='a'>Follow us daily</div><div class='b'>Story {i} tells of {i}</div></body></html>"
    pages = [(i, f"http://t.example/{i}", page.format(i=i)) for i in range(9)] + [(50, "http://u.example/1", page.format(i=50))]
    texts = {r.page_id: r.text for r in style_tree.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert texts[4] == "Story 4 tells of 4" and texts[50].startswith("Follow us daily")


def test_unclosed_markup_is_read_to_the_end():
    for page in ("<p>a<b", "<p title='x>a", "<!-- open", "<script>x", "<" * 2000, "<p>a</div></p></p>b", "<a b=\"" * 500):
        style_tree.main_text(page, set(), False)


def test_warc_round_trip(spark):
    big = "<p>" + "long enough to be a revisit " * 10
    pages = [(5, "http://a/1", big), (3, "http://a/2", big), (7, "http://a/3\r\nX: y", big), (8, None, "tiny"), (9, "u", "tiny"), (10, "u", None), (None, "u", big), (3, "http://a/2", big)]
    rows = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    again = lambda i, t: len(t or "") >= 100 and i != 3
    want = sorted((str(i), len(t or ""), digest(t), "revisit" if again(i, t) else "response", 3 if again(i, t) else None) for i, _, t in pages)
    assert got == want
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_are_checked():
    payload = b"x" * 300
    data = warc.record(1, "http://a", payload, hashlib.sha256(payload).hexdigest(), None, False, "2024-01-01T00:00:00Z")
    dictionary = zstandard.train_dictionary(1024, [bytes([i % 7, i % 5]) * 40 + data for i in range(200)]).as_bytes()
    archive = warc.archive_head(dictionary) + b"".join(warc.compressor(dictionary).compress(data) for _ in range(3))
    assert struct.unpack("<I", archive[:4])[0] == warc.SKIPPABLE
    assert [warc.parse(f)["payload"] for f in warc.frames(archive)] == [payload] * 3
    for bad in (archive[:-5], archive + b"junk", archive[:6]):
        with pytest.raises((warc.ArchiveError, zstandard.ZstdError, struct.error)):
            list(warc.frames(bad))
    for bad in (data.replace(b"xxx", b"xxy", 1), data + b" ", data.replace(b"Content-Length: ", b"Content-Length: 9")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(bad)


@pytest.mark.parametrize("name", ["op1_mixing", "op6_warc"])
def test_sql(spark, name):
    from inquest.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = queries.queries()[name](spark, SMALL).select(columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_pipeline(spark):
    """Each stage on the output of the one before, against plain definitions."""
    docs = table(spark, SMALL, "documents")
    held = docs.collect()
    model = quality.fit(docs, table(spark, SMALL, "labels"))
    kept = {r.doc_id: r for r, s in zip(held, model.scores([r.text for r in held])) if s >= quality.THRESHOLD}
    groups = brute.near_groups([(r.doc_id, r.text) for r in kept.values()])
    first = {i for i, (_, c) in groups.items() if i == c}
    out = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    assert {r.doc_id for r in out.collect()} == set(kept)
    out = corpus_pipeline.STAGES[1][1](spark, out, SMALL)
    assert {r.doc_id for r in out.collect()} == first and out.columns == docs.columns
    out = corpus_pipeline.STAGES[2][1](spark, out, SMALL)
    clean = {r.doc_id: r.text for r in out.collect()}
    assert set(clean) == first and not any(brute.spans(t) for t in clean.values())
    result = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in result} <= first
    for r in result:
        decoded = b"".join(byte_bpe.tokens(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"))[i] for i in np.frombuffer(r.ids, "<u4"))
        assert decoded.decode() == clean[r.doc_id] and r.decoded_sha256 == hashlib.sha256(decoded).hexdigest()

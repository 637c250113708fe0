"""The pruned similarity join against brute force, with copies, a hot kind and missing kinds."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from meritlens.functions.terms import ENGLISH_STOP
from meritlens.operators import latent as L
from meritlens.operators import retrieval as R
from meritlens.operators.tfidf import VocabularyConfig

SCHEMA = "parent_asin string, title string, store string, main_category string, listing_kind string, price double, average_rating double, review_count bigint, product_document string"


def rows(docs):
    return [(i, i, "s", "c", kind, price, 4.0, 1, text) for i, kind, price, text in docs]


def grams(text):
    words = [w for w in re.findall(r"\w{2,}", text.lower()) if w not in ENGLISH_STOP]
    out = [f"w:{w}" for w in words] + [f"w:{a} {b}" for a, b in zip(words, words[1:])]
    for w in text.lower().split():
        w = f" {w} "
        out += [f"c:{w[i:i + n]}" for n in (3, 4, 5) if len(w) >= n for i in range(len(w) - n + 1)]
    return Counter(out)


def brute(queries, catalog, k, floor, min_df):
    peers = [c for c in catalog if c[2] is not None]
    tfs = [grams(c[3]) for c in peers]
    df = Counter(t for tf in tfs for t in tf)
    idf = {t: math.log((1 + len(peers)) / (1 + n)) + 1 for t, n in df.items() if n >= min_df}

    def vec(tf):
        w = {t: n * idf[t] for t, n in tf.items() if t in idf}
        norms = {v: math.sqrt(sum(x * x for t, x in w.items() if t[0] == v)) for v in "wc"}
        views = math.sqrt(sum(n > 0 for n in norms.values()))
        return {t: x / norms[t[0]] / views for t, x in w.items()}

    vecs = [vec(tf) for tf in tfs]
    kinds = Counter(c[1] for c in peers)
    out = []
    for q in queries:
        scope = q[1] if q[1] != "other" and kinds[q[1]] >= 2 else ""
        mine = vec(grams(q[3]))
        sims = [
            (-round(sum(w * v.get(t, 0) for t, w in mine.items()), 8), c[0])
            for c, v in zip(peers, vecs) if c[0] != q[0] and (not scope or c[1] == scope)
        ]
        out += [(q[0], c, -s) for s, c in sorted(x for x in sims if -x[0] >= floor)[:k]]
    return sorted(out)


@pytest.mark.parametrize("floor,k", [(0.12, 3), (0.4, 2)])
def test_matches_brute_force(spark, floor, k):
    words = "red blue cable charger pro mini earbuds case wireless usb fast slim".split()
    docs = [
        (f"p{i:03d}", ("device", "cable", "device", "other")[i % 4], None if i % 9 == 0 else 10.0 + i,
         f"item {words[i % 12]} {words[(i * 5) % 12]} {words[(i * 7 + 1) % 12]} {i % 3}")
        for i in range(60)
    ]
    docs += [(f"z{i:03d}", "device", 9.0, "item red blue pro") for i in range(30)]
    queries = docs[::5] + [("new", "tips", 5.0, "red pro cable")]
    cfg = R.RetrievalConfig(k, 2, floor, None, VocabularyConfig(min_df=2, postings_per_task=7))
    index = R.RetrievalIndex.fit(spark.createDataFrame(rows(docs), SCHEMA), cfg)
    found = R.neighbours(spark.createDataFrame(rows(queries), SCHEMA), index)
    got = sorted((r["query_id"], r["parent_asin"], r["similarity"]) for r in found.collect())
    want = brute(queries, docs, k, floor, 2)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-8)


def test_many_copies_end_the_expansion(spark):
    docs = [(f"p{i:03d}", "device", 10.0, f"red blue cable {'pro ' * (i % 7)}") for i in range(140)]
    docs += [(f"z{i}", "device", 9.0, text) for i, text in enumerate(["red blue", "blue cable", "cable red", "red pro cable"])]
    cfg = R.RetrievalConfig(3, 2, 0.05, None, VocabularyConfig(min_df=1))
    index = R.RetrievalIndex.fit(spark.createDataFrame(rows(docs), SCHEMA), cfg)
    ask = [("p000", "device", 10.0, docs[0][3]), ("p003", "device", 10.0, docs[3][3]), ("z0", "device", 9.0, "red blue"), ("z9", "device", 9.0, "blue cable")]
    found = R.neighbours(spark.createDataFrame(rows(ask), SCHEMA), index).collect()
    got = sorted((r["query_id"], r["parent_asin"], r["similarity"]) for r in found)
    want = brute(ask, docs, 3, 0.05, 1)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-8)


def test_disallowed_kind_finds_nothing_and_index_round_trips(spark, tmp_path):
    docs = [("D1", "device", 189.0, "apple airpods pro wireless earbuds"), ("D2", "device", 79.0, "wireless earbuds bluetooth"), ("C1", "case", 9.0, "earbuds case")]
    cfg = R.RetrievalConfig(2, 4, 0.05, ("device",), VocabularyConfig(min_df=1))
    index = R.RetrievalIndex.fit(spark.createDataFrame(rows(docs), SCHEMA), cfg)
    index.save(str(tmp_path / "index"))
    loaded = R.RetrievalIndex.load(spark, str(tmp_path / "index"), cfg)
    ask = spark.createDataFrame(rows([("Q1", "device", 100.0, "airpods wireless earbuds"), ("Q2", "case", 10.0, "earbuds case")]), SCHEMA)
    found = R.neighbours(ask, loaded)
    assert {(r["query_id"], r["parent_asin"]) for r in found.collect()} == {("Q1", "D1"), ("Q1", "D2")}
    context = {r["parent_asin"]: r for r in R.market_context(ask, found).collect()}
    assert context["Q2"]["neighbor_count"] == 0 and context["Q2"]["peer_price"] is None and context["Q2"]["retrieval_listing_kind"] == ""


def test_dense_blocks_do_not_change_results(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    one = sorted(tuple(r) for r in L.dense_neighbours(e, e, 3, 10_000).collect())
    many = sorted(tuple(r) for r in L.dense_neighbours(e, e, 3, 64).collect())
    assert one == many


def test_pairs_are_never_rows_and_blocks_do_not_change_results(spark):
    docs = [(f"p{i:03d}", "device", 10.0, f"red cable {i % 13} {'pro' * (i % 3)} x{i % 40}") for i in range(120)]
    ask = spark.createDataFrame(rows(docs[::7]), SCHEMA)
    found = []
    for size in (20_000, 12):
        cfg = R.RetrievalConfig(3, 2, 0.05, None, VocabularyConfig(min_df=1, postings_per_task=size))
        got = R.neighbours(ask, R.RetrievalIndex.fit(spark.createDataFrame(rows(docs), SCHEMA), cfg))
        found.append(sorted((r["query_id"], r["rank"], r["parent_asin"], r["similarity"]) for r in got.collect()))
    assert found[0] == found[1] and len(found[0]) == 3 * len(docs[::7])
    vec = "array<struct<t:int,w:double,idf:double>>"
    one = [(i, 1, [(1, 1.0, 1.0)], f"p{i}") for i in range(50)]
    q = spark.createDataFrame([r[:3] for r in one], f"q_id long, scope_id int, vec {vec}")
    c = spark.createDataFrame(one, f"c_id long, scope_id int, vec {vec}, first_id string")
    best = R.similar_documents(q, c, R.RetrievalConfig(1, 1))
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert best.count() == 50 * 2 and "explode(vec" not in plan and "explode(head" not in plan


def test_dense_tasks_take_many_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows_ = [(i % 590, [float(x) for x in v]) for i, v in enumerate(rng.integers(-1, 2, (600, 3)) / 2)]  # ties and repeated ids
    e = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").coalesce(1)
    want = []
    for q, a in rows_:
        want += [(q, c, round(sum(x * y for x, y in zip(a, b)), 8)) for c, b in rows_ if c != q]
    by = {}
    for q, c, s in want:
        by.setdefault(q, []).append((-s, c))
    want = sorted((q, c, -s) for q, found in by.items() for s, c in sorted(found)[:4])
    found = L.dense_neighbours(e, e, 4, 16)
    assert sorted((r["query_id"], r["vec_id"], r["similarity"] + 0.0) for r in found.collect()) == [(q, c, s + 0.0) for q, c, s in want]
    # A side of 600 rows is copied once for each of the other side's 8 blocks, not for each of 38 products.
    assert "sequence(0, 7" in (plan := found._jdf.queryExecution().analyzed().toString()) and "sequence(0, 37" not in plan
    monkeypatch.setattr(L, "TASK_ROWS", 50)
    again = L.dense_neighbours(e, e, 4, 16)
    assert sorted((r["query_id"], r["vec_id"], r["similarity"] + 0.0) for r in again.collect()) == [(q, c, s + 0.0) for q, c, s in want]

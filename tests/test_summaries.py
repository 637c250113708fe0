"""Split modes, summaries, kept models, the label log and pieces of orders against plain versions."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meritlens.functions import terms
from meritlens.functions.numbers import hash_unit
from meritlens.operators import evaluate as E
from meritlens.operators import listings as L
from meritlens.operators import ordering as O
from meritlens.operators import sampling as S
from meritlens.operators import textmodels as M
from meritlens.operators import trust as T
from meritlens.sources import writers


def unit(seed, key):
    return int.from_bytes(hashlib.sha256(f"{seed}:{key}".encode()).digest()[:8], "big") / 2**64


def test_split_of_texts_fills_the_quota_by_rows(spark):
    rows = [(i, i % 2, f"text {i % 2} {0 if i < 90 else i // 3}") for i in range(200)] + [(900, 1, " "), (901, None, "x"), (902, 0, None)]
    df = spark.createDataFrame(rows, "id int, y int, text string")
    got = S.split_rows(df, "y", "text", "id", 0.25, 7).collect()
    assert {r.split_mode for r in got} == {S.GROUPED} and sorted(r.id for r in got) == list(range(200))
    sides, sizes = defaultdict(set), Counter()
    for r in got:
        sides[r.text_key].add(r.split)
        sizes[r.y, r.text_key] += 1
    assert all(len(s) == 1 for s in sides.values())
    for y in (0, 1):
        upto = 0
        for k in sorted((k for (l, k) in sizes if l == y), key=lambda k: (unit(7, k), k)):
            upto += sizes[y, k]
            assert sides[k] == {"test" if upto <= 25 or upto == sizes[y, k] else "train"}


@pytest.mark.parametrize("case", ["one_label", "no_keys", "one_text"])
def test_split_falls_back_to_rows(spark, case):
    rows = [(i, 0 if case == "one_label" else i % 2, " " if case == "no_keys" and i % 2 else "same" if case == "one_text" else f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, y int, text string")
    got = S.split_rows(df, "y", "text", "id").collect()
    assert {r.split_mode for r in got} == {S.FALLBACK} and len(got) == 40
    assert Counter(r.split for r in got) == {"test": 10, "train": 30}
    assert {r.split_mode for r in S.split_rows(df, "y", "text", "id", text_disjoint=False).collect()} == {S.BY_ROW}


def test_rejections_fold_both_sources(spark):
    ranked = spark.createDataFrame(
        [("a", k, f"p{k}", 0.5, "weak_identity_match" if k % 3 else "accessory_mismatch") for k in range(1, 14)] + [("b", 1, "p1", 0.9, None), ("c", 1, "p1", 0.9, None)],
        "query_id string, rank int, parent_asin string, match_score double, rejection_reason string",
    )
    context = spark.createDataFrame([("a", "implausibly_low_peer_price"), ("b", "usable"), ("c", "insufficient_peer_neighbors")], "query_id string, retrieval_status string")
    got = {r.query_id: r for r in L.rejections(ranked, context).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"].rejection_summary == {"weak_identity_match": 9, "accessory_mismatch": 4, "implausibly_low_peer_price": 1}
    assert [x.parent_asin for x in got["a"].first_rejected] == [f"p{k}" for k in range(1, 11)]
    assert got["c"].rejection_summary == {"insufficient_peer_neighbors": 1} and got["c"].first_rejected is None


def test_failures_know_what_came_later(spark, tmp_path):
    path = str(tmp_path / "log")
    absent = writers.read_labels(spark, path)
    assert {"record_id", "claim_trust_score", "error", "ingest_seq"} <= set(absent.columns) and absent.count() == 0
    scores = [F.lit(0.5).alias(c) for c in (*terms.TRUST_SCORES, "overall_confidence")]

    def batch(good, bad):
        rows = spark.createDataFrame([(i, None) for i in good] + [(i, "down") for i in bad], "record_id string, error string").coalesce(1)
        return T.with_label_buckets(rows.select("record_id", "error", *scores))

    writers.append_labels(batch(["a"], ["b", "c"]), path, 1)
    writers.append_labels(batch(["b"], ["a", "d"]), path, 2)
    log = spark.read.parquet(path)
    got = [(r.record_id, r.ingest_seq, r.superseded) for r in T.failed_annotations(log, 3).collect()]
    assert got == [("d", 2, False), ("a", 2, False), ("c", 1, False)]
    assert [(r.record_id, r.superseded) for r in T.failed_annotations(log, 9).collect()] == [("d", False), ("a", False), ("c", False), ("b", True)]


def test_models_kept_as_a_table_score_alike(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(str(i), int(rng.integers(0, 2)), *map(float, rng.random(len(terms.TRUST_SCORES)))) for i in range(300)]
    df = T.with_graph_buckets(spark.createDataFrame(rows, ["record_id", "label_truth", *terms.TRUST_SCORES]))
    weights, intercept = M.fit_trust_head(df)
    assert all(abs(r.gradient) < 1e-6 for r in M.head_gradient(df, weights, intercept).collect())
    graph = T.fit_graph(df)
    T.model_table(graph, terms.TRUST_SCORES, weights, intercept).write.parquet(str(tmp_path / "m"))
    kept = T.apply_models(df, spark.read.parquet(str(tmp_path / "m")))
    want = T.trust_scores(df, graph, weights, intercept)
    columns = ["phase_b_truth_likelihood_graph", "phase_b_truth_likelihood_logistic", "graph_uncertainty_entropy"]
    a, b = (np.array([r[1:] for r in sorted(x.select("record_id", *columns).collect())]) for x in (kept, want))
    assert np.allclose(a, b)


def test_domain_metrics_without_a_class(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.2), ("a", 1, 0.4), ("b", 1, 0.7), ("b", 1, 0.1)]
    got = {r.domain: r for r in E.domain_metrics(spark.createDataFrame(rows, "domain string, y int, p double"), "y", "p", ["domain"]).collect()}
    assert got["a"].auc == 1.0 and got["a"].f1 == pytest.approx(2 / 3) and got["a"].accuracy == pytest.approx(2 / 3)
    assert got["b"].auc is None and got["b"].log_loss is None and got["b"].brier == pytest.approx((0.09 + 0.81) / 2)


def test_pieces_bound_the_rows_of_a_task(spark):
    """Half of the rows share one score: ties are cut by the key behind it."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 0.5).otherwise(hash_unit(3, F.col("id"))).alias("s"))
    cut = O.with_piece(df, "s", "id", piece_rows=1000)
    sizes = [r["count"] for r in cut.groupBy("_piece").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 3000 and len(sizes) >= 10
    rows = O.running_totals(cut, [F.col("s"), F.col("id")], {"r": F.lit(1)}).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.r)] == [r.id for r in sorted(rows, key=lambda r: (r.s, r.id))]
    values = [r.s for r in rows]
    got = O.exact_quantiles(df, "s", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, piece_rows=500).first()
    assert (got.p10, got.p50, got.p90) == pytest.approx(tuple(np.quantile(values, [0.1, 0.5, 0.9])))

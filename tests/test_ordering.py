"""Order statistics, splits and metrics against plain numpy, with skewed groups."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meritlens.functions.numbers import hash_unit
from meritlens.operators import evaluate as E
from meritlens.operators import ordering as O
from meritlens.operators import sampling as S


def test_hash_unit_matches_definition(spark):
    df = spark.createDataFrame([("A1",), ("x y",)], "k string")
    got = [r[0] for r in df.select(hash_unit(42, F.col("k"))).collect()]
    want = [int.from_bytes(hashlib.sha256(f"42:{k}".encode()).digest()[:8], "big") / 2**64 for k in ("A1", "x y")]
    assert got == want


def test_exact_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    values = {"hot": np.round(rng.exponential(3, 3000), 2), "small": np.array([5.0]), "flat": np.full(500, 2.5)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r["g"]: (r["a"], r["b"]) for r in O.exact_quantiles(df, "v", {"a": 0.1, "b": 0.75}, ["g"]).collect()}
    for g, vs in values.items():
        assert out[g] == pytest.approx((np.quantile(vs, 0.1), np.quantile(vs, 0.75)))


def test_hash_ranked_is_a_permutation(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, "big").otherwise("small")).withColumn("u", hash_unit(1, F.col("id")))
    rows = O.hash_ranked(df, "u", "id", ["g"], "r", total="n").collect()
    big = sorted((r["u"], r["id"], r["r"]) for r in rows if r["g"] == "big")
    assert [r for _, _, r in big] == list(range(1, 4001))
    assert {r["n"] for r in rows} == {4000, 1000}


@pytest.mark.parametrize("parts", [1, 50])
def test_quota_split_is_exact_and_partition_free(spark, parts):
    df = spark.range(10).withColumn("label", (F.col("id") >= 6).cast("int")).repartition(parts)
    plan = S.quota_plan(S.label_counts(df, "label"), 0.25, 0.25)
    got = S.quota_assignment(df, "label", "id", plan)
    counts = {(r["label"], r["split"]): r["count"] for r in got.groupBy("label", "split").count().collect()}
    assert counts == {(l, s): n for l in (0, 1) for s, n in (("train", 2), ("val", 1), ("test", 1))}
    first = sorted(tuple(r) for r in got.select("id", "split").collect())
    again = sorted(tuple(r) for r in S.quota_assignment(df.repartition(3), "label", "id", plan).select("id", "split").collect())
    assert first == again


def test_infeasible_plan_fails(spark):
    df = spark.createDataFrame([(0, 5)], "label int, available bigint")
    with pytest.raises(Exception, match="at least two labels"):
        S.quota_plan(df, 0.1, 0.1).collect()


def test_auc_ap_and_sweep_by_brute_force(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    row = E.auc_ap(df, "y", "p").first()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    ap = sum((np.sum(pos == t) / len(pos)) * np.sum(pos >= t) / np.sum(p >= t) for t in np.unique(p))
    assert (row["roc_auc"], row["average_precision"]) == pytest.approx((auc, ap))

    def f1(t):
        tp, fp, fn, tn = [np.sum(c) for c in ((y == 1) & (p >= t), (y == 0) & (p >= t), (y == 1) & (p < t), (y == 0) & (p < t))]
        return (2 * tp / (2 * tp + fp + fn) + (2 * tn / (2 * tn + fp + fn) if 2 * tn + fp + fn else 0)) / 2

    best = max(np.unique(p), key=lambda t: (round(f1(t), 12), -abs(t - 0.5), t))
    assert E.threshold_sweep(df, "y", "p").first()["best_threshold"] == pytest.approx(best)


def test_one_class_has_no_auc(spark):
    row = E.auc_ap(spark.createDataFrame([(1, 0.2), (1, 0.3)], "y int, p double"), "y", "p").first()
    assert row["roc_auc"] is None and row["average_precision"] is None

"""End-to-end jobs on small inputs, and the streaming variants against batch."""

import pytest
from pyspark.sql import functions as F

from meritlens.operators import retrieval as R
from meritlens.operators import trust as T
from meritlens.operators.tfidf import VocabularyConfig
from meritlens.plans import offline_value, pair_comparison, review_training, trust_labels
from meritlens.operators.textmodels import TextFeatureConfig, LENGTHS
from meritlens.streaming.incremental import streaming_review_signals
from meritlens.operators.catalog import review_signals
from meritlens.workload import listing_queries, views

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark):
    rows = offline_value.prepare_catalog(views.meta(spark, SMALL), views.reviews(spark, SMALL))
    return R.RetrievalIndex.fit(rows.where("split = 'train'"))


def test_offline_value(spark, index):
    rows = offline_value.prepare_catalog(views.meta(spark, SMALL), views.reviews(spark, SMALL))
    out = offline_value.combined_predictions(rows.where("split = 'test'"), index).collect()
    assert len(out) == rows.where("split = 'test'").count() and len(out[0]) == 28
    p = [r["combined_good_value_probability"] for r in out]
    assert p == sorted(p, reverse=True)


def test_pair_comparison(spark, index):
    listings = listing_queries.listings(spark, SMALL).where("k < 40")
    small = R.RetrievalConfig(20, 4, 0.02)
    valued = pair_comparison.valued_listings(listings, index, retrieval=small)
    assert valued.count() == 40
    # A shared family key neither loses nor multiplies listings: all find what they find with keys of their own.
    status = lambda v: sorted(map(tuple, v.select("query_id", "retrieval_status", F.round("retrieved_peer_price", 6)).collect()))
    found = [
        status(pair_comparison.valued_listings(listings.withColumn("product_family_key", key), index, retrieval=small))
        for key in (F.concat(F.lit("own "), "query_id"), F.lit("one family"))
    ]
    assert found[0] == found[1]
    assert valued.where("retrieval_status = 'no_neighbors'").count() < 20
    pairs = spark.createDataFrame([(1, "1", "2"), (2, "3", "4")], "pair_id int, id_a string, id_b string")
    rows = pair_comparison.explained_pairs(pairs, valued).collect()
    assert len(rows) == 2 and all(len(r["explanation"]["paragraphs"]) == 4 and r["explanation"]["paragraphs"][2] for r in rows)


def test_review_training(spark):
    good, bad = "very useful detailed review with measurements", "bad junk"
    rows = [(i, (good if i % 2 else bad) + f" w{i % 7}", "t", "3" if i % 2 else "0") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, helpful_votes string").withColumns(
        {"rating": F.lit("4"), "verified_purchase": F.lit("true")}
    )
    splits = review_training.prepared_splits(df, "doc_id", 1, 0.2, 0.2)
    out = review_training.train_helpfulness(
        splits, "doc_id", TextFeatureConfig(VocabularyConfig(min_df=1, stop_words=()), LENGTHS)
    )
    assert out["candidates"].count() == 3
    assert out["test_metrics"].first()["macro_f1"] > 0.95


def test_trust_labels(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "id int, text string")
    path = str(tmp_path / "log")

    def broken(texts):
        raise RuntimeError("down")

    def works(texts):
        return ['{"claim_trust_score": 0.9, "signal_trust_score": 0.8, "heuristic_pressure_score": 0.1}'] * len(texts)

    assert trust_labels.annotate_and_log(frame, path, 1, broken, "id", "text", "x").count() == 0
    assert trust_labels.annotate_and_log(frame, path, 2, works, "id", "text", "x", max_calls=4).count() == 4
    done = trust_labels.annotate_and_log(frame, path, 3, works, "id", "text", "x")
    assert done.count() == 6
    assert done.select("competence_score").first()[0] == pytest.approx(0.84)
    assert T.pending_rows(frame, done.select(F.col("id").cast("string").alias("record_id")), "id", "text").count() == 0


def test_stream_ends_like_batch(spark, tmp_path):
    reviews = views.reviews(spark, SMALL)
    reviews.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reviews.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming_review_signals(stream).writeStream.outputMode("complete").format("memory").queryName("sig").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("sig").collect())) == sorted(map(tuple, review_signals(reviews).collect()))

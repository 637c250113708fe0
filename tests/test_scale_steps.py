"""Steps that have to spread, keep or merge their rows to scale."""

from __future__ import annotations

from pyspark.mllib.linalg.distributed import RowMatrix

from meritlens.operators import latent as L
from meritlens.workload import listing_queries, views

SMALL = "/root/testdata/sf0.001"


def test_listings_are_dealt_over_all_tasks(spark):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = listing_queries.listings(spark, SMALL)
    assert rows.rdd.getNumPartitions() == tasks > 1
    assert rows.count() == views.table(spark, SMALL, "part").count()


def test_rows_are_kept_while_singular_vectors_are_sought(spark, monkeypatch):
    kept, plain = [], RowMatrix.computeSVD

    def seen(self, *args, **options):
        kept.append(self._java_matrix_wrapper._java_model.rows().getStorageLevel().useMemory())
        return plain(self, *args, **options)

    monkeypatch.setattr(RowMatrix, "computeSVD", seen)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    texts = [f"red w{i % 5} w{i % 7} blue w{i % 3} tea" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    L.LatentText.fit(docs, L.LatentConfig(max_features=50, latent_dim=3))
    assert kept == [True]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before

"""Text features of a document are made in its row; rows that repeat an id are one document."""

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from meritlens.operators import textmodels as M
from meritlens.operators.latent import LatentConfig, LatentText
from meritlens.operators.tfidf import VocabularyConfig, split_repeats, term_counts, vocabulary
from meritlens.session import materialise

CFG = VocabularyConfig(min_df=1, stop_words=())
ROWS = [(1, "red ring red ring bolt"), (2, "Red bolt"), (3, ""), (4, None), (5, "?? !"), (6, "unknown words only")]
REPEATS = [(7, "ring bolt"), (7, "bolt bolt red"), (8, "ring"), (8, "ring"), (None, "red ring"), (None, "red bolt")]


def _vocab(docs):
    rows = docs.where("doc_id < 3").withColumn("copies", F.lit(1))
    return materialise(vocabulary(term_counts(rows, CFG, ("w",)), rows, CFG, ("w",)))


def _plain(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id, [(e.i, round(e.v, 12)) for e in r.e or []]) for r in rows)


def test_entries_equal_those_of_joined_counts(spark):
    docs = materialise(spark.createDataFrame(ROWS + REPEATS, "doc_id long, text string"))
    vocab = _vocab(docs)
    grams = docs.withColumn("copies", F.lit(1)).select("doc_id", "copies", F.explode(F.transform(M.word_ngrams(F.col("text")), lambda g: F.concat(F.lit("w:"), g))).alias("term"))
    want = M.sparse_rows(grams.groupBy("doc_id", "copies", "term").agg(F.count("*").alias("tf")), vocab)
    assert _plain(M.document_entries(docs, CFG, vocab).collect()) == _plain(want.collect())
    assert _plain(M.with_entries(docs, CFG, vocab).collect()) == _plain(docs.join(want, "doc_id", "left").collect())


def test_counts_of_repeated_ids_are_one_document(spark):
    docs = spark.createDataFrame(ROWS + REPEATS, "doc_id long, text string").withColumn("copies", F.lit(1))
    single, several = split_repeats(docs, "doc_id")
    assert sorted(r.doc_id for r in single.collect()) == [1, 2, 3, 4, 5, 6] and several.count() == 6
    got = {(r.doc_id, r.term): r.tf for r in term_counts(docs, CFG, ("w",)).collect()}
    assert got[7, "w:bolt"] == 3 and got[8, "w:ring"] == 2 and got[None, "w:red"] == 2 and got[1, "w:red ring"] == 2


def test_terms_of_documents_are_not_shuffled(spark):
    docs = materialise(spark.createDataFrame(ROWS, "doc_id long, text string"))
    model = M.TextFeatures(_vocab(docs), 5, {}, M.TextFeatureConfig(CFG))
    plain = LatentText.fit(docs, LatentConfig(min_df=1, latent_dim=2))
    for rows in (model.transform(docs), plain.transform(docs)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == len(ROWS)


def test_entries_of_sparse_dense_and_missing_vectors(spark):
    rows = [(1, Vectors.sparse(9, [1, 8], [0.5, 0.0])), (2, Vectors.dense([0.0, 2.0, -1.0])), (3, None), (4, Vectors.sparse(9, [], []))]
    got = {r.id: r.e and [(x.i, x.v) for x in r.e] for r in spark.createDataFrame(rows, ["id", "f"]).select("id", M.vector_entries("f").alias("e")).collect()}
    assert got == {1: [(1, 0.5)], 2: [(1, 2.0), (2, -1.0)], 3: None, 4: []}

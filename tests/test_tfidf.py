"""Term counts and vocabularies: what they shuffle and how often they read."""

from meritlens.operators.tfidf import VocabularyConfig, term_counts, vocabulary

TEXTS = ["red red cable", "Cable red", "", None, "blue", "x", "red blue red blue red"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unique_keys_are_counted_row_by_row(spark):
    docs = spark.createDataFrame([(i, t, 1 + i % 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, copies int")
    cfg = VocabularyConfig(stop_words=("blue",))
    for views in (("w",), ("c",), ("w", "c")):
        counts = term_counts(docs, cfg, views, unique=True)
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, term_counts(docs, cfg, views).collect()))
        assert "Exchange" not in plan(counts)


def test_a_view_that_is_not_there_is_not_read(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, copies int")
    cfg = VocabularyConfig(min_df=1)
    counts = term_counts(docs, cfg, ("w",), unique=True)
    words = vocabulary(counts, docs, cfg, ("w",))
    assert plan(words).count("explode") + plan(words).count("inline") < plan(vocabulary(counts, docs, cfg)).count("inline")
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, vocabulary(counts, docs, cfg).collect()))

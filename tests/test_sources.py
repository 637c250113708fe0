"""Readers over real files with malformed records, and text features that are saved and loaded."""

import math
from collections import Counter

import pytest
from pyspark.ml.linalg import Vectors

from meritlens.operators import textmodels as M
from meritlens.operators.tfidf import VocabularyConfig
from meritlens.sources import readers as S
from meritlens.workload.source_queries import prepared_review_source


def test_json_lines_set_malformed_lines_apart(spark, tmp_path):
    lines = ['{"a": 1, "b": "x"}', "", "   ", '{"a": "one"}', '{"a": 2', "[3]", "null", "4", '{"b": "only"}', "{}"]
    (tmp_path / "rows.json").write_text("\n".join(lines))
    rows, rejects = S.read_json_lines(spark, str(tmp_path), "a int, b string")
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted([(1, "x"), (None, "only"), (None, None)], key=repr)
    found = rejects.collect()
    assert sorted(r.record for r in found) == sorted(['{"a": "one"}', '{"a": 2', "[3]", "null", "4"])
    assert all(r.file.endswith("rows.json") for r in found)


def test_json_lines_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "rows.json").write_text("")
    rows, rejects = S.read_json_lines(spark, str(tmp_path), "a int")
    assert rows.count() == rejects.count() == 0 and rows.columns == ["a"]


def test_a_malformed_line_fails_the_strict_reader(spark, tmp_path):
    (tmp_path / "rows.json").write_text('{"helpful_votes": "3"}\n{"helpful_votes": ')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        S.read_prepared_reviews(spark, str(tmp_path), 2).collect()
    rows, rejects = S.read_prepared_reviews_with_rejects(spark, str(tmp_path), 2)
    assert rows.first()["label"] == 1 and rejects.count() == 1


@pytest.mark.parametrize("header", [True, False])
def test_csv_sets_records_of_other_widths_apart(spark, tmp_path, header):
    text = ("key,a name\n" if header else "") + '1,"x, ""y"""\n2\n3,z,more\n4,\n'
    (tmp_path / "rows.csv").write_text(text)
    rows, rejects = S.read_csv_rows(spark, str(tmp_path), ["key", "a name"], header=header)
    assert sorted(map(tuple, rows.collect()), key=repr) == [("1", 'x, "y"'), ("4", None)]
    assert sorted(r.record for r in rejects.collect()) == ["2", "3,z,more"]
    assert rejects.count() == 2 and rows.count() == 2


def test_csv_with_another_header_fails(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("key,other\n1,x\n")
    rows, _ = S.read_csv_rows(spark, str(tmp_path), ["key", "name"])
    with pytest.raises(Exception, match="header"):
        rows.collect()


def test_products_need_their_columns(spark, tmp_path):
    (tmp_path / "rows.csv").write_text('PRODUCT_ID,TITLE,BULLET_POINTS,DESCRIPTION\n1,"two\nlines",,\n2,,,\n')
    assert [tuple(r) for r in S.read_products(spark, str(tmp_path), 10).select("record_id", "text").collect()] == [("1", "Title: two lines")]
    (tmp_path / "rows.csv").write_text("PRODUCT_ID,TITLE\n1,x\n")
    with pytest.raises(ValueError, match="BULLET_POINTS"):
        S.read_products(spark, str(tmp_path), 10)


@pytest.mark.parametrize(
    "name, text",
    [
        ("t.csv", 'id,Body,TARGET\n1,"a, b",Fake\n2,c,REAL\n3,d,unsure\n'), ("t.tsv", "id\tBody\tTARGET\n1\ta, b\tFake\n2\tc\tREAL\n3\td\tunsure\n"),
        ("t.jsonl", '{"id":"1","Body":"a, b","TARGET":"Fake"}\n{"id":"2","Body":"c","TARGET":"REAL"}\n{"id":"3","Body":"d","TARGET":"unsure"}\n'),
        ("t.json", '[{"id":"1","Body":"a, b","TARGET":"Fake"},\n{"id":"2","Body":"c","TARGET":"REAL"},{"id":"3","Body":"d","TARGET":"unsure"}]'),
    ],
)
def test_truth_labels_from_each_format(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    got = S.read_truth_labelled(spark, str(tmp_path / name), "id").select("id", "text", "label_truth").collect()
    assert sorted(map(tuple, got)) == [("1", "a, b", 0), ("2", "c", 1)]


def test_truth_labels_of_an_unknown_format(spark):
    with pytest.raises(ValueError, match="unsupported"):
        S.read_truth_labelled(spark, "t.xml", "id")


def test_prepared_reviews_lose_no_line(spark):
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey % 40 <> 2").count()
    assert prepared_review_source(spark, sf).count() == lines


CFG = M.TextFeatureConfig(VocabularyConfig(min_df=2, max_df=0.9, word_max_features=6, stop_words=()), ("size",))
TEXTS = ["red red blue", "blue green blue", "red green", None, "", "other words only", "red blue green green green"]


def entries(features, docs):
    return {r.doc_id: {e.i: e.v for e in r.e} for r in features.transform(docs).select("doc_id", M.vector_entries().alias("e")).collect()}


def test_text_features_equal_a_plain_version_and_survive_saving(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, float(i - 3)) for i, t in enumerate(TEXTS)], "doc_id long, text string, size double")
    fitted = M.TextFeatures.fit(docs, CFG)

    grams = [(w := (t or "").split()) + [f"{a} {b}" for a, b in zip(w, w[1:])] for t in TEXTS]
    df, total = Counter(g for d in grams for g in set(d)), Counter(g for d in grams for g in d)
    kept = sorted(sorted((g for g in df if 2 <= df[g] <= 0.9 * len(TEXTS)), key=lambda g: (-total[g], g))[:6])
    want = {}
    for i, d in enumerate(grams):
        w = {kept.index(g): (1 + math.log(c)) * (math.log((1 + len(TEXTS)) / (1 + df[g])) + 1) for g, c in Counter(d).items() if g in kept}
        norm = math.sqrt(sum(v * v for v in w.values()))
        want[i] = {k: pytest.approx(v / norm) for k, v in w.items()} | ({len(kept): pytest.approx((i - 3) / 3)} if i != 3 else {})
    assert entries(fitted, docs) == want

    fitted.save(str(tmp_path / "model"))
    again = M.TextFeatures.load(spark, str(tmp_path / "model"))
    assert again.cfg == CFG and entries(again, docs) == want
    assert entries(again, docs.limit(0)) == {}


def test_vectors_need_no_write(spark):
    rows = spark.createDataFrame([(1, [(0, 1.5), (3, 2.0)]), (2, []), (3, None)], "id int, e array<struct<i:int,v:double>>")
    got = M.with_vectors(rows, "e", 5)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, Vectors.sparse(5, [0, 3], [1.5, 2.0])), (2, Vectors.sparse(5, [], [])), (3, Vectors.sparse(5, [], []))]
    assert [len(r.e) for r in got.orderBy("id").select(M.vector_entries().alias("e")).collect()] == [2, 0, 0]

"""Text classifiers on Spark ML: features, candidate models, selection and inference."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.text import text_or_blank, word_ngrams
from ..session import materialise
from .evaluate import auc_ap, binary_metrics, calibration, probability_metrics, rank_models, threshold_sweep
from .sampling import stratified_split
from .tfidf import VocabularyConfig, split_repeats, term_counts, word_vocabulary
from .trust import fit_graph, graph_probability, with_graph_buckets

LENGTHS = ("review_len_words", "title_len_chars", "text_len_chars")


@dataclass(frozen=True)
class TextFeatureConfig:
    vocabulary: VocabularyConfig = field(
        default_factory=lambda: VocabularyConfig(word_max_features=50_000, min_df=5, max_df=0.95, stop_words=())
    )
    numeric: tuple[str, ...] = ()


def sparse_rows(counts: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """Unit-length sublinear TF-IDF per document as sorted (index, value) entries."""
    w = (1.0 + F.log("tf")) * F.col("idf")
    rows = (
        counts.join(F.broadcast(vocab), "term")
        .groupBy(key)
        .agg(
            F.array_sort(F.collect_list(F.struct((F.col("term_id") - 1).alias("i"), w.alias("v")))).alias("e"),
            F.sqrt(F.sum(w * w)).alias("norm"),
        )
    )
    return rows.select(
        key, F.transform("e", lambda x: F.struct(x["i"].alias("i"), (x["v"] / F.col("norm")).alias("v"))).alias("e")
    )


def _list_tools() -> tuple[Callable, Callable, Callable]:
    """Sizes of lists (null: 0), list ends from sizes, and (i, v) structs; made here so that they go to the tasks with their users."""

    def sizes(lists: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def ends(sizes: np.ndarray) -> pa.Array:
        return pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))

    def pairs(i: np.ndarray, v: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(i.astype(np.int32)), pa.array(v.astype(np.float64))], ["i", "v"])

    return sizes, ends, pairs


def term_entries(words: Column, vocab: DataFrame) -> Column:
    """The entries of ``sparse_rows`` from the words of a row, repeats included, and their pairs.

    The vocabulary, of bounded size, goes to all tasks; pairs are met as numbers of their words.
    """
    known = vocab.select(F.regexp_replace("term", "^w:", "").alias("term"), "term_id", "idf").orderBy("term_id").toArrow().combine_chunks()
    number, idf = (known.column(c).to_numpy() for c in ("term_id", "idf"))
    parts = [t.split(" ") for t in known.column("term").to_pylist()]
    listed = {w: n for n, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
    alone = np.full(len(listed) + 1, -1)  # the last place is that of unknown words
    pairs = []
    for place, p in enumerate(parts):
        if len(p) == 1:
            alone[listed[p[0]]] = place
        else:
            pairs.append((listed[p[0]] * len(listed) + listed[p[1]], place))
    pairs = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    shared = vocab.sparkSession.sparkContext.broadcast((pa.array(list(listed), pa.string()), alone, pairs[:, 0].copy(), pairs[:, 1].copy(), number - 1, idf))

    sizes_of, ends, structs = _list_tools()

    @F.arrow_udf("array<struct<i:int,v:double>>")
    def entries(rows: pa.Array) -> pa.Array:
        listed, alone, pairs, pair_place, number, idf = shared.value
        n, size = len(rows), max(len(idf), 1)
        word = pc.fill_null(pc.index_in(rows.flatten().cast(pa.string()), value_set=listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row, place = np.repeat(np.arange(n), sizes_of(rows)), alone[word]
        key = np.where((row[1:] == row[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0), word[:-1] * len(listed) + word[1:], -1)
        met = np.flatnonzero(key >= 0)
        at = np.searchsorted(pairs, key[met])
        hit = np.append(pairs, -1)[at] == key[met]
        row, place = np.append(row[place >= 0], row[met[hit]]), np.append(place[place >= 0], pair_place[at[hit]])
        found, tf = np.unique(row * size + place, return_counts=True)
        row, place = found // size, found % size
        w = (1.0 + np.log(tf)) * idf[place]
        norm = np.sqrt(np.bincount(row, w * w, minlength=n))
        return pa.ListArray.from_arrays(ends(np.bincount(row, minlength=n)), structs(number[place], w / norm[row]))

    return entries(words)


def document_entries(docs: DataFrame, cfg: VocabularyConfig, vocab: DataFrame) -> DataFrame:
    """(doc_id, e) of each document with a known term, as ``sparse_rows`` has them of the counts; rows that repeat a doc_id are one."""
    single, several = split_repeats(docs, "doc_id")
    out = single.select("doc_id", _word_entries(cfg, vocab).alias("e")).where("size(e) > 0")
    return out if several is None else out.unionByName(_merged_entries(several, cfg, vocab))


def with_entries(docs: DataFrame, cfg: VocabularyConfig, vocab: DataFrame) -> DataFrame:
    """Add the document's entries ``e`` to each row; a row without doc_id or known term has null or none.

    Rows that repeat a doc_id have the entries of all their texts; other rows get theirs in place, so no term is shuffled.
    """
    single, several = split_repeats(docs, "doc_id")
    out = single.withColumn("e", F.when(F.col("doc_id").isNotNull(), _word_entries(cfg, vocab)))
    if several is None:
        return out
    return out.unionByName(several.join(_merged_entries(several, cfg, vocab), "doc_id", "left").select(*out.columns))


def fitted_entries(docs: DataFrame, cfg: VocabularyConfig, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, e) of each row, as ``with_entries`` has it, and of each document, as ``document_entries`` has it; texts are read once."""
    single, several = split_repeats(docs, "doc_id")
    own = materialise(single.select("doc_id", _word_entries(cfg, vocab).alias("e")))
    each, found = own.withColumn("e", F.when(F.col("doc_id").isNotNull(), F.col("e"))), own.where("size(e) > 0")
    if several is None:
        return each, found
    merged = materialise(_merged_entries(several, cfg, vocab))
    return each.unionByName(several.select("doc_id").join(merged, "doc_id", "left")), found.unionByName(merged)


def _word_entries(cfg: VocabularyConfig, vocab: DataFrame) -> Column:
    return term_entries(word_ngrams(F.col("text"), cfg.stop_words, 1), vocab)


def _merged_entries(docs: DataFrame, cfg: VocabularyConfig, vocab: DataFrame) -> DataFrame:
    return sparse_rows(term_counts(docs.withColumn("copies", F.lit(1)), cfg, ("w",)), vocab)


def with_vectors(df: DataFrame, entries: str, size: int, into: str = "features") -> DataFrame:
    """Turn sorted (i, v) entries into an ML sparse vector column, batch by batch and without a write.

    A frame that a fit reads many times is worth materialising by its caller. Null entries give a vector of zeros.
    """

    sizes_of, ends, pairs = _list_tools()

    @F.arrow_udf(VectorUDT())
    def vector(rows: pa.Array) -> pa.Array:
        n, at, e = len(rows), ends(sizes_of(rows)), rows.flatten()
        i, v = e.field("i").cast(pa.int32()), e.field("v").cast(pa.float64())
        lists = [pa.ListArray.from_arrays(at, i), pa.ListArray.from_arrays(at, v)]
        return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], ["type", "size", "indices", "values"])

    return df.withColumn(into, vector(entries)).drop(entries)


def vector_entries(column: str = "features") -> Column:
    """Entries of a sparse or dense ML vector that are not zero: array of (i, v), by i."""

    sizes_of, ends, pairs = _list_tools()

    @F.arrow_udf("array<struct<i:int,v:double>>")
    def entries(rows: pa.Array) -> pa.Array:
        values, sizes = rows.field("values"), sizes_of(rows.field("values"))
        v = values.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(rows)), sizes)
        i = np.arange(len(v)) - (np.cumsum(sizes) - sizes)[row]  # places, as in dense vectors
        sparse = pc.equal(rows.field("type"), 0).to_numpy(zero_copy_only=False).astype(bool)[row]
        i[sparse] = rows.field("indices").flatten().to_numpy(zero_copy_only=False)
        kept = v != 0
        at = ends(np.bincount(row[kept], minlength=len(rows)))
        return pa.ListArray.from_arrays(at, pairs(i[kept], v[kept]), mask=rows.is_null())

    return entries(column)


@dataclass(frozen=True)
class TextFeatures:
    """Fitted vocabulary and numeric scales."""

    vocab: DataFrame
    size: int
    scales: dict[str, float]
    cfg: TextFeatureConfig

    @staticmethod
    def fit(docs: DataFrame, cfg: TextFeatureConfig = TextFeatureConfig()) -> "TextFeatures":
        """docs: doc_id, text and the numeric columns."""
        rows = docs.withColumn("copies", F.lit(1))
        vocab = materialise(word_vocabulary(rows, cfg.vocabulary))
        size = vocab.count()
        top = docs.agg(*[F.max(F.abs(c)).alias(c) for c in cfg.numeric]).first() if cfg.numeric else {}
        return TextFeatures(vocab, size, {c: float(top[c] or 1.0) or 1.0 for c in cfg.numeric}, cfg)

    def save(self, path: str) -> None:
        """Write vocabulary and settings below ``path``; what lies there already fails the write."""
        settings = json.dumps({"size": self.size, "scales": self.scales, "cfg": asdict(self.cfg)})
        self.vocab.write.parquet(f"{path}/vocabulary")
        self.vocab.sparkSession.createDataFrame([(settings,)], "settings string").write.parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TextFeatures":
        """Features as saved."""
        kept = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
        words = kept["cfg"]["vocabulary"]
        cfg = TextFeatureConfig(VocabularyConfig(**words | {"stop_words": tuple(words["stop_words"])}), tuple(kept["cfg"]["numeric"]))
        return TextFeatures(spark.read.parquet(f"{path}/vocabulary"), kept["size"], kept["scales"], cfg)

    def transform(self, docs: DataFrame) -> DataFrame:
        """Add the column ``features``; documents without a known term keep their numeric entries only."""
        empty = F.array().cast("array<struct<i:int,v:double>>")
        rows = with_entries(docs, self.cfg.vocabulary, self.vocab).withColumn("e", F.coalesce("e", empty))
        extra = [
            F.struct(F.lit(self.size + n).alias("i"), (F.col(c).cast("double") / self.scales[c]).alias("v"))
            for n, c in enumerate(self.cfg.numeric)
        ]
        if extra:
            rows = rows.withColumn("e", F.concat("e", F.filter(F.array(*extra), lambda x: x["v"] != 0)))
        return with_vectors(rows, "e", self.size + len(extra))


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Row weight n / (classes * class size); two rows of class sizes are broadcast."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_c"))
    n = F.sum("_c").over(Window.partitionBy(F.lit(0)))
    classes = F.count("*").over(Window.partitionBy(F.lit(0)))
    return rows.join(F.broadcast(sizes.select(label, (n / (classes * F.col("_c"))).alias("weight"))), label)


def fit_candidates(train: DataFrame, label: str = "label", balanced: bool = True, max_iter: int = 100) -> dict:
    """Logistic regression (L2, C = 1), multinomial and complement naive Bayes."""
    rows = balanced_weights(train, label) if balanced else train.withColumn("weight", F.lit(1.0))
    n = rows.count()
    shared = {"featuresCol": "features", "labelCol": label}
    return {
        "logistic_regression": LogisticRegression(
            regParam=1.0 / n, standardization=False, maxIter=max_iter, weightCol="weight", **shared
        ).fit(rows),
        "multinomial_nb": NaiveBayes(modelType="multinomial", **shared).fit(rows),
        "complement_nb": NaiveBayes(modelType="complement", **shared).fit(rows),
    }


def predictions(models: dict, rows: DataFrame, label: str = "label") -> DataFrame:
    """(doc_id, label, model, p) of every candidate."""
    parts = [
        m.transform(rows).select(
            "doc_id", F.col(label).alias("label"), F.lit(name).alias("model"), vector_to_array("probability")[1].alias("p")
        )
        for name, m in models.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compare_candidates(scored: DataFrame, tune: bool = True) -> DataFrame:
    """Metrics per model at its best threshold (or 0.5)."""
    if tune:
        best = threshold_sweep(scored, "label", "p", ["model"]).select("model", F.col("best_threshold").alias("_t"))
        at = scored.join(F.broadcast(best), "model")
        metrics = binary_metrics(at, "label", "p", F.col("_t"), ["model"])
    else:
        metrics = binary_metrics(scored, "label", "p", 0.5, ["model"])
    return metrics.join(auc_ap(scored, "label", "p", ["model"]), "model")


def select_candidate(metrics: DataFrame, sentiment: bool = False) -> DataFrame:
    last = "accuracy" if sentiment else "balanced_accuracy"
    return rank_models(metrics, ["macro_f1", "average_precision", "roc_auc", last])


def helpful_predictions(model, rows: DataFrame, threshold: float) -> DataFrame:
    p = vector_to_array("probability")[1]
    return model.transform(rows).select(
        "doc_id", p.alias("usefulness_probability"), (p >= threshold).cast("int").alias("helpful_label")
    )


def sentiment_predictions(model, rows: DataFrame) -> DataFrame:
    p = vector_to_array("probability")
    label = (p[1] > p[0]).cast("int")
    return model.transform(rows).select(
        "doc_id", p[0].alias("negative_probability"), p[1].alias("positive_probability"), label.alias("label"),
        F.when(label == 1, "positive").otherwise("negative").alias("label_text"),
    )


def polarity_label_text(rows: DataFrame) -> DataFrame:
    given = F.nullif(text_or_blank(F.col("label_text")), F.lit(""))
    return rows.withColumn(
        "label_text", F.coalesce(given, F.when(F.col("label") == 1, "positive").when(F.col("label") == 0, "negative"))
    )


def scores_vector(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)


@dataclass(frozen=True)
class TrustModels:
    graph: DataFrame
    logistic: object
    predictions: DataFrame
    metrics: DataFrame
    calibration_graph: DataFrame


def train_trust(
    labelled: DataFrame,
    extra_scores: Sequence[str] = (),
    extra_buckets: Sequence[str] = (),
    test_size: float = 0.25,
    seed: int = 42,
    clip: float = 0.0,
) -> TrustModels:
    """Stratified split, graph and logistic fit, held-out probabilities and metrics."""
    split = materialise(stratified_split(with_graph_buckets(labelled), "label_truth", "record_id", test_size, seed))
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    buckets = (*terms.GRAPH_BUCKETS, *extra_buckets)
    columns = (*terms.TRUST_SCORES, *extra_scores)
    graph = materialise(fit_graph(train, "label_truth", buckets))
    logistic = LogisticRegression(labelCol="label_truth", regParam=1.0 / train.count(), standardization=False).fit(
        scores_vector(train, columns)
    )
    scored = logistic.transform(scores_vector(graph_probability(test, graph, buckets), columns)).select(
        "record_id", F.col("label_truth").alias("y"), "p_graph", vector_to_array("probability")[1].alias("p_logistic")
    )
    scored = materialise(scored)
    long = scored.unpivot(["record_id", "y"], ["p_graph", "p_logistic"], "model", "p")
    return TrustModels(
        graph, logistic, scored, probability_metrics(long, "y", "p", ["model"], clip), calibration(scored, "y", "p_graph")
    )


def fit_trust_head(rows: DataFrame, label: str = "label_truth", columns: Sequence[str] = terms.TRUST_SCORES) -> tuple[list[float], float]:
    """Coefficients and intercept of the logistic head (L2, C = 1)."""
    model = LogisticRegression(labelCol=label, regParam=1.0 / rows.count(), standardization=False, maxIter=500, tol=1e-10).fit(scores_vector(rows, columns))
    return model.coefficients.tolist(), float(model.intercept)


def head_gradient(rows: DataFrame, coefficients: Sequence[float], intercept: float, label: str = "label_truth", columns: Sequence[str] = terms.TRUST_SCORES) -> DataFrame:
    """(term, gradient) of the penalised mean log loss at a fitted head; all are zero at the optimum."""
    z = F.lit(float(intercept))
    for name, w in zip(columns, coefficients, strict=True):
        z = z + F.lit(float(w)) * F.col(name)
    error = 1.0 / (1.0 + F.exp(-z)) - F.col(label)
    sums = rows.agg(
        F.avg(error).alias("intercept"),
        *[(F.avg(error * F.col(c)) + F.lit(float(w)) / F.count("*")).alias(c) for c, w in zip(columns, coefficients, strict=True)],
    )
    return sums.unpivot([], list(sums.columns), "term", "gradient")

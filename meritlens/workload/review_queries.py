"""Review, sampling, evaluation, fusion and trust queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms
from ..functions.numbers import three_way
from ..operators import evaluate as E
from ..operators import fusion as U
from ..operators import reviews as W
from ..operators import sampling as S
from ..operators import trust as T
from ..operators.ordering import exact_quantiles
from . import views
from .catalog_queries import SPACE_SQL, r6
from .views import rounded, sql

FACTORS = terms.TRUST_SCORES
PRIMES = (37, 53, 71, 89, 101, 131, 151)
# The published coefficients and intercept of the logistic trust head.
LOGISTIC = (
    0.3040340846352303, -0.28018581294285694, 0.6789268145323678, -0.4333922121215761, -0.2696802432101134, 0.2301097275848697,
    0.6250801146127885,
)
INTERCEPT = -0.2308537825126966


def review_rows(spark, sf):
    d = views.table(spark, sf, "documents")
    k = F.col("doc_id")
    return d.select(
        "doc_id",
        F.col("source").alias("parent_asin"),
        F.concat(F.lit("  Review "), F.col("lang"), F.lit(" \n by "), F.col("source")).alias("title"),
        "text",
        F.when(k % 9 == 0, "n/a").when(k % 10 == 0, "nan").otherwise((1 + k % 5).cast("string")).alias("rating"),
        F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "0").when(k % 4 == 2, "maybe").alias("verified_purchase"),
        F.when(k % 8 != 0, ((k * 7) % 6).cast("string")).alias("helpful_votes"),
    )


def label_log(spark, sf):
    """Two annotation passes over the documents with invalid records in both."""
    d = views.table(spark, sf, "documents").select("doc_id")
    k = F.col("doc_id")
    passes = []
    for shift, rows in ((0, d), (500, d.where(k % 7 == 0))):
        bad = (k % 13 == 0) if shift == 0 else (k % 77 == 0)
        scores = [F.when(~bad, ((k * p + shift) % 1000) / 999.0).alias(f) for f, p in zip(FACTORS, PRIMES)]
        passes.append(
            rows.select(
                k.cast("string").alias("record_id"),
                F.lit("product").alias("domain"),
                (k + (10**12 if shift else 0)).alias("ingest_seq"),
                *scores,
                F.when(~bad, (k % 10) / 10.0).alias("overall_confidence"),
                F.when(bad, "timeout").alias("error"),
            )
        )
    return T.with_label_buckets(passes[0].unionByName(passes[1]))


def valid_label_rows(spark, sf):
    return T.latest_labels(label_log(spark, sf))


def truth(spark, sf):
    return views.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("quality").alias("label_truth")
    )


def labelled(spark, sf):
    """Valid labels with a truth label."""
    return valid_label_rows(spark, sf).join(truth(spark, sf), "record_id")


def scores(spark, sf):
    l = views.table(spark, sf, "labels")
    return l.select("doc_id", F.col("quality").alias("y"), "toxic", (((F.col("doc_id") * 37) % 101) / 100.0).alias("p"))


def labelled_texts(spark, sf):
    d, l = views.table(spark, sf, "documents"), views.table(spark, sf, "labels")
    return d.join(l, "doc_id").select("doc_id", "text", "lang", "source", F.col("quality").alias("label_truth"), "toxic")


# ------------------------------------------------------------------ queries


def review_prep(spark, sf):
    out = W.prepare_reviews(review_rows(spark, sf), positive_threshold=3, drop_middle=True, min_review_words=5)
    return out.select("doc_id", "rating", "verified_purchase", "helpful_votes", "label", "review_len_words")


def review_features(spark, sf):
    out = W.review_features(review_rows(spark, sf))
    return out.select(
        "doc_id", "combined_text", "rating", "verified_purchase", "review_len_words", "title_len_chars", "text_len_chars"
    )


def sentiment_clean(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", W.sentiment_text(F.col("text")).alias("text"))


def relabel(spark, sf):
    rows = review_rows(spark, sf).withColumns({"helpful_vote": F.lit(None).cast("string"), "label": (F.col("doc_id") % 2).cast("int")})
    return W.relabel(rows, 3).select("doc_id", "label")


def review_validation(spark, sf):
    rows = review_rows(spark, sf).withColumn(
        "text", F.when(F.col("doc_id") % 11 == 0, " \n ").otherwise(F.col("text"))
    )
    out = W.validated_reviews(rows)
    return out.select("doc_id", "rating_value", "verified_flag", "reject_reason", F.length("text").alias("n"))


def _quality_counts(spark, sf):
    return S.label_counts(views.table(spark, sf, "labels"), "quality")


def quota_plan(spark, sf):
    return S.quota_plan(_quality_counts(spark, sf), 0.15, 0.2).unionByName(
        S.quota_plan(_quality_counts(spark, sf), 0.1, 0.1, balance=False)
    )


def quota_assignment(spark, sf):
    l = views.table(spark, sf, "labels")
    out = S.quota_assignment(l, "quality", "doc_id", S.quota_plan(_quality_counts(spark, sf), 0.15, 0.2))
    return out.select("doc_id", "quality", "split")


def stratified_split(spark, sf):
    return S.stratified_split(labelled_texts(spark, sf).drop("text"), "label_truth", "doc_id").select("doc_id", "label_truth", "split")


def balanced_sample(spark, sf):
    return S.balanced_sample(views.table(spark, sf, "labels"), "quality", "doc_id", 100).select("doc_id", "quality")


def disjoint_split(spark, sf):
    out = S.disjoint_split(labelled_texts(spark, sf), "label_truth", "text")
    return out.select("doc_id", "text_key", "label_truth", "split")


def disjoint_overlap(spark, sf):
    return S.key_overlap(S.disjoint_split(labelled_texts(spark, sf), "label_truth", "text"))


def uniform_sample(spark, sf):
    return S.uniform_sample(views.table(spark, sf, "documents"), "doc_id", 0.1).select("doc_id")


def duplicate_sample(spark, sf):
    return S.duplicate_sample(views.table(spark, sf, "documents"), "doc_id", "text", 0.1).select("doc_id")


def binary_metrics(spark, sf):
    return rounded(E.binary_metrics(scores(spark, sf), "y", "p", 0.5))


def auc_ap(spark, sf):
    return rounded(E.auc_ap(scores(spark, sf), "y", "p"))


def threshold_sweep(spark, sf):
    return rounded(E.threshold_sweep(scores(spark, sf), "y", "p"))


def _models(spark, sf):
    s = scores(spark, sf)
    return s.select(
        "y",
        F.explode(
            F.array(
                F.struct(F.lit("first").alias("model"), F.col("p").alias("p")),
                F.struct(F.lit("second").alias("model"), (((F.col("doc_id") * 59) % 97) / 96.0).alias("p")),
                F.struct(F.lit("third").alias("model"), F.lit(0.5).alias("p")),
            )
        ).alias("m"),
    ).select("y", "m.*")


def model_ranking(spark, sf):
    m = _models(spark, sf)
    both = E.binary_metrics(m, "y", "p", 0.5, ["model"]).join(E.auc_ap(m, "y", "p", ["model"]), "model")
    return E.rank_models(both, ["macro_f1", "average_precision", "roc_auc", "balanced_accuracy"]).select(
        "model", F.round("macro_f1", 6).alias("macro_f1")
    )


def brier_logloss(spark, sf):
    return rounded(E.probability_metrics(_models(spark, sf), "y", "p", ["model"]))


def metric_deltas(spark, sf):
    m = E.probability_metrics(_models(spark, sf), "y", "p", ["model"])
    return rounded(E.metric_deltas(m, "model", "first", ["auc", "brier", "log_loss"]))


def calibration(spark, sf):
    return rounded(E.calibration(scores(spark, sf), "y", "p"))


def _long_scores(spark, sf):
    return E.unpivoted(valid_label_rows(spark, sf), ["record_id"], FACTORS)


def score_distributions(spark, sf):
    long = E.unpivoted(labelled(spark, sf), ["label_truth"], FACTORS)
    return rounded(E.five_numbers(long, "score", ["factor", "label_truth"]))


def score_histograms(spark, sf):
    return E.histogram(_long_scores(spark, sf), "score", "factor", 20)


def factor_extremes(spark, sf):
    return rounded(E.factor_extremes(_long_scores(spark, sf), "record_id"))


def representatives(spark, sf):
    out = E.representatives(valid_label_rows(spark, sf), "integrity_score", "record_id")
    return rounded(out.select("position", "record_id", "integrity_score"))


def length_medians(spark, sf):
    rows = W.length_columns(labelled_texts(spark, sf).withColumn("split", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test")))
    keys = ["split", "label_truth"]
    a = exact_quantiles(rows, "word_len", {"word_len": 0.5}, keys)
    return a.join(exact_quantiles(rows, "char_len", {"char_len": 0.5}, keys), keys)


def label_balance(spark, sf):
    return W.label_balance(labelled_texts(spark, sf), ["lang"], "label_truth")


def first_examples(spark, sf):
    return W.first_examples(labelled_texts(spark, sf), "label_truth", "doc_id", 3).select("label_truth", "doc_id", "rank", "text")


def feedback_texts(spark, sf):
    c = views.table(spark, sf, "conversations")
    entries = c.select(
        F.col("conv_id").alias("seller_id"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", "BUYER").when(F.col("role") == "assistant", "SELLER").alias("provider_role"),
        F.col("text").alias("comment_text"),
        ((F.col("conv_id") + F.col("turn")) % 9 == 0).alias("removed"),
    )
    return W.feedback_texts(entries).select("seller_id", F.array_join("seller_feedback_texts", " || ").alias("texts"))


def scored_reviews(spark, sf):
    d = views.table(spark, sf, "documents")
    k = F.col("doc_id")
    rows = d.select(
        "doc_id", F.col("source").alias("product_id"),
        (((k * 37) % 111) / 100.0 - 0.05).alias("usefulness_probability"),
        F.when(k % 19 == 0, 0.0).otherwise(((k * 53) % 100) / 99.0).alias("positive_probability"),
        F.when(k % 19 == 0, 0.0).otherwise(((k * 71) % 100) / 99.0).alias("negative_probability"),
        F.when(k % 6 != 0, ((k * 89) % 100) / 99.0).alias("deception_probability"),
    )
    return U.review_fusion(rows)


def review_fusion(spark, sf):
    return rounded(scored_reviews(spark, sf))


def product_review_score(spark, sf):
    out = U.value_signals(U.review_set_scores(scored_reviews(spark, sf), ["product_id"]))
    return rounded(out)


def score_buckets(spark, sf):
    rows = label_log(spark, sf).where("error IS NULL")
    return T.with_graph_buckets(rows).select("record_id", "ingest_seq", *terms.GRAPH_BUCKETS)


def valid_labels(spark, sf):
    return rounded(valid_label_rows(spark, sf).select("record_id", "ingest_seq", *FACTORS, *terms.LABEL_BUCKETS))


def valid_labels_last_then_valid(spark, sf):
    return T.latest_labels(label_log(spark, sf), last_then_valid=True).select("record_id", "ingest_seq")


def labelled_rows(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    out = T.labelled_rows(d, valid_label_rows(spark, sf), "doc_id")
    return rounded(out.select("doc_id", "lang", "n_chars", "claim_trust_score", "claim_trust_bucket"))


def pending_labels(spark, sf):
    d = views.table(spark, sf, "documents")
    return T.pending_rows(d, valid_label_rows(spark, sf), "doc_id", "text").select("doc_id", "lang")


def duplicate_check(spark, sf):
    first = T.latest_labels(label_log(spark, sf).where("ingest_seq < 1000000000000"))
    second = T.latest_labels(label_log(spark, sf).where("ingest_seq >= 1000000000000"))
    out = T.duplicate_check(first, second)
    return rounded(out.select("record_id", *[c for c in out.columns if c.startswith("dup_abs_diff")]))


def backfill_truth(spark, sf):
    d = views.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("record_id"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(1)).alias("label_truth"),
    )
    return T.backfilled(d, truth(spark, sf), "record_id", "label_truth")


def _trained(spark, sf):
    rows = T.with_graph_buckets(labelled(spark, sf))
    return rows, T.fit_graph(rows)


def nb_graph_cpd(spark, sf):
    return rounded(_trained(spark, sf)[1])


def _trust_results(spark, sf):
    _, model = _trained(spark, sf)
    rows = valid_label_rows(spark, sf).withColumn("input_seq", F.col("record_id").cast("bigint"))
    return T.trust_scores(rows, model, LOGISTIC, INTERCEPT)


TRUST_OUT = (
    "phase_b_truth_likelihood_graph", "phase_b_truth_likelihood_logistic", "trust_risk_index_graph",
    "trust_risk_index_logistic", "graph_uncertainty_entropy",
)


def nb_graph_predict(spark, sf):
    return rounded(_trust_results(spark, sf).select("record_id", *TRUST_OUT))


def _with_status(spark, sf):
    seq = F.col("input_seq")
    return _trust_results(spark, sf).select(
        "record_id", "input_seq",
        F.when(seq % 17 == 0, "unavailable").when(seq % 5 == 0, "error").otherwise("ok").alias("status"),
        "phase_b_truth_likelihood_graph",
        F.when(seq % 3 != 0, F.col("phase_b_truth_likelihood_logistic")).alias("phase_b_truth_likelihood_logistic"),
        F.when(seq % 2 == 0, F.col("trust_risk_index_graph")).alias("trust_risk_index_graph"),
        F.lit(None).cast("double").alias("trust_risk_index_logistic"),
        "graph_uncertainty_entropy",
    )


def trust_normalised(spark, sf):
    return rounded(T.normalised_trust(_with_status(spark, sf)).drop("phase_b_truth_likelihood_graph", "phase_b_truth_likelihood_logistic", "trust_risk_index_graph", "trust_risk_index_logistic"))


def trust_summary(spark, sf):
    rows = _trust_results(spark, sf).withColumns(
        {"status": F.when(F.col("input_seq") % 5 == 0, "error").otherwise("ok"),
         "trust_risk_index_graph": F.round("trust_risk_index_graph", 9),
         "graph_uncertainty_entropy": F.round("graph_uncertainty_entropy", 9)}
    )
    return rounded(T.trust_summary(rows))


def top_risk(spark, sf):
    rows = _trust_results(spark, sf).withColumn("risk", F.round("trust_risk_index_graph", 9))
    return rounded(E.top_rows(rows.select("record_id", "risk"), "risk", "record_id", 15))


def closest_mistakes(spark, sf):
    return rounded(E.closest_mistakes(scores(spark, sf), "y", "p", "doc_id", 20).select("doc_id", "y", "p", "margin"))


def _annotations(spark, sf):
    d = views.table(spark, sf, "documents")
    k = F.col("doc_id")

    def score(p):
        return F.format_string("%.3f", ((k * p) % 1200) / 1000.0)

    good = F.concat(
        F.lit('Sure, here it is: {"Claim_Trust": '), score(37), F.lit(', "signal_trust_score": "'), score(53),
        F.lit('", "PRESSURE_SCORE": '), score(71), F.lit(', "integrity": '), score(89),
        F.lit(', "rationale_claim": " fine "} Done.'),
    )
    raw = (
        F.when(k % 11 == 0, "no object here")
        .when(k % 11 == 1, F.concat(F.lit('{"claim_trust_score": '), score(37), F.lit("}")))
        .when(k % 11 == 2, F.concat(F.lit('{"claim_score": 0.5, "signal_trust": 0.5, "pressure_score": 0.1, "competence": "high", "confidence": '), score(31), F.lit("}")))
        .otherwise(good)
    )
    return d.select(k.cast("string").alias("record_id"), raw.alias("raw"))


def annotation_parse(spark, sf):
    out = T.parse_annotations(_annotations(spark, sf))
    return rounded(out.drop("raw", "rationale_signal", "rationale_pressure"))


def _raw_products(spark, sf):
    d = views.table(spark, sf, "documents")
    k = F.col("doc_id")
    return d.select(
        k.alias("input_seq"),
        F.when(k % 5 < 3, F.col("source")).alias("TITLE"),
        F.when(k % 7 == 0, F.col("text")).alias("bullet_points"),
        F.lit("  ").alias("description"),
        F.when(k % 3 != 0, F.col("lang")).alias("content"),
        F.when(k % 4 == 0, F.col("source")).alias("PRODUCT_ID"),
        F.when(k % 10 == 0, "same").alias("record_id"),
    )


def product_inputs(spark, sf):
    return T.product_inputs(_raw_products(spark, sf)).select("record_id", "status", "input_seq", "product_id", "title", "text")


def assembled_results(spark, sf):
    rows = _with_status(spark, sf)
    ok, bad = rows.where("status = 'ok'"), rows.where("status <> 'ok'").select("record_id", "input_seq", "status")
    return rounded(T.assembled_results(ok, bad).select("record_id", "status", "phase_b_truth_likelihood_graph"))


def listing_text(spark, sf):
    d = views.table(spark, sf, "documents")
    return d.select(
        "doc_id",
        T.product_text(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.lit(" ")).alias("product"),
        T.news_text(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("lang"), F.lit(None).cast("string"), F.col("text")).alias("news"),
    )


def catalog_browse(spark, sf):
    p = views.table(spark, sf, "part")
    rows = p.select(
        F.concat(F.lit("r"), F.col("p_partkey")).alias("record_id"), F.col("p_partkey").alias("PRODUCT_ID"), F.col("p_name").alias("TITLE"),
        F.col("p_type").alias("BULLET_POINTS"), F.col("p_brand").alias("DESCRIPTION"), "p_retailprice",
        three_way((F.col("p_partkey") % 10) / 9.0).alias("claim_trust_bucket"),
    )
    return T.browse(rows, " RED ", "high", "p_retailprice", False).select("record_id", "TITLE", "p_retailprice")


QUERIES = {
    f.__name__: f
    for f in (
        review_prep, review_features, sentiment_clean, relabel, review_validation, quota_plan, quota_assignment,
        stratified_split, balanced_sample, disjoint_split, disjoint_overlap, uniform_sample, duplicate_sample,
        binary_metrics, auc_ap, threshold_sweep, model_ranking, brier_logloss, metric_deltas, calibration,
        score_distributions, score_histograms, factor_extremes, representatives, length_medians, label_balance,
        first_examples, feedback_texts, review_fusion, product_review_score, score_buckets, valid_labels,
        valid_labels_last_then_valid, labelled_rows, pending_labels, duplicate_check, backfill_truth, nb_graph_cpd,
        nb_graph_predict, trust_normalised, trust_summary, top_risk, closest_mistakes, annotation_parse,
        product_inputs, assembled_results, listing_text, catalog_browse,
    )
}

# --------------------------------------------------------------- SQL checks


def clean_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE_SQL}+', ' ', 'g'))"


def words_sql(x: str) -> str:
    return f"CASE WHEN {clean_sql(x)} = '' THEN 0 ELSE len(string_split({clean_sql(x)}, ' ')) END"


def unit_sql(key: str, seed: int = 42) -> str:
    return f"(CAST(CAST('0x' || substr(sha256('{seed}:' || CAST({key} AS VARCHAR)), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0)"


def three_sql(x: str) -> str:
    return f"CASE WHEN {x} < 1.0 / 3.0 THEN 'low' WHEN {x} < 2.0 / 3.0 THEN 'medium' WHEN {x} IS NOT NULL THEN 'high' END"


V = views.SQL
V["review_rows"] = (
    (),
    """SELECT doc_id, source AS parent_asin, '  Review ' || lang || chr(32) || chr(10) || ' by ' || source AS title, text,
  CASE WHEN doc_id % 9 = 0 OR doc_id % 10 = 0 THEN NULL ELSE CAST(1 + doc_id % 5 AS DOUBLE) END AS rating,
  CASE doc_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' WHEN 2 THEN 'maybe' END AS flag,
  CASE WHEN doc_id % 8 <> 0 THEN (doc_id * 7) % 6 END AS votes FROM documents""",
)


def _pass_sql(shift: int, where: str, bad: str, seq: str) -> str:
    cols = ", ".join(f"CASE WHEN NOT ({bad}) THEN ((doc_id * {p} + {shift}) % 1000) / 999.0 END AS {f}" for f, p in zip(FACTORS, PRIMES))
    return (
        f"SELECT CAST(doc_id AS VARCHAR) AS record_id, {seq} AS ingest_seq, {cols}, "
        f"CASE WHEN NOT ({bad}) THEN (doc_id % 10) / 10.0 END AS overall_confidence, CASE WHEN {bad} THEN 'timeout' END AS error FROM documents {where}"
    )


V["log_rows"] = (
    (),
    "SELECT *, " + ", ".join(f"{three_sql(f)} AS {b}" for f, b in T.LABEL_BUCKET_OF.items())
    + f" FROM ({_pass_sql(0, '', 'doc_id % 13 = 0', 'doc_id')} UNION ALL "
    + _pass_sql(500, "WHERE doc_id % 7 = 0", "doc_id % 77 = 0", "doc_id + 1000000000000") + ") u",
)
V["latest"] = (
    ("log_rows",),
    "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingest_seq DESC) AS r FROM log_rows WHERE error IS NULL) q WHERE r = 1",
)
V["truth"] = ((), "SELECT CAST(doc_id AS VARCHAR) AS record_id, quality AS label_truth FROM labels")
V["latest_truth"] = (("latest", "truth"), "SELECT * FROM latest JOIN truth USING (record_id)")
V["scores"] = ((), "SELECT doc_id, quality AS y, ((doc_id * 37) % 101) / 100.0 AS p FROM labels")
V["texts"] = ((), "SELECT d.doc_id, text, lang, source, quality AS label_truth FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
V["models"] = (
    (),
    """SELECT quality AS y, 'first' AS model, ((doc_id * 37) % 101) / 100.0 AS p FROM labels UNION ALL
SELECT quality, 'second', ((doc_id * 59) % 97) / 96.0 FROM labels UNION ALL SELECT quality, 'third', 0.5 FROM labels""",
)
V["long_scores"] = (("latest",), " UNION ALL ".join(f"SELECT record_id, '{f}' AS factor, {f} AS score FROM latest" for f in FACTORS))


def plan_sql(counts: str, planned: str, val: float, test: float) -> str:
    rel = val / (1 - test) if val else 0.0
    def alloc(src, c, share, out):
        return (
            f"SELECT *, CAST(floor({c} * {share!r}) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round({c} * {share!r} - floor({c} * {share!r}), 12) DESC, {c} DESC, label) "
            f"<= round_even(sum({c}) OVER () * {share!r}, 0) - sum(floor({c} * {share!r})) OVER () THEN 1 ELSE 0 END AS {out} FROM {src}"
        )
    a = alloc(f"(SELECT *, {planned} AS planned FROM {counts}) p0", "planned", test, "test_rows")
    b = alloc(f"(SELECT *, planned - test_rows AS rest FROM ({a}) p1) p2", "rest", rel, "val_rows")
    return f"SELECT label, available, planned, test_rows, val_rows, rest - val_rows AS train_rows FROM ({b}) p3"


def assign_sql(rows: str, label: str, key: str, plan: str) -> str:
    return (
        f"SELECT * FROM (SELECT x.*, CASE WHEN rk <= test_rows THEN 'test' WHEN rk <= test_rows + val_rows THEN 'val' WHEN rk <= planned THEN 'train' END AS split "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {unit_sql(key)}, {key}) AS rk FROM {rows}) x JOIN ({plan}) pl ON pl.label = x.{label}) y WHERE split IS NOT NULL"
    )


_qc = "(SELECT quality AS label, count(*) AS available FROM labels GROUP BY 1) c"
_min = "min(available) OVER ()"
_lt = "(SELECT label_truth AS label, count(*) AS available FROM texts GROUP BY 1) c"
_keys_cte = """keyed AS (SELECT *, sha1(lower({t}) || '|' || label_truth) AS text_key FROM texts),
keys AS (SELECT text_key, min(label_truth) AS label_truth FROM keyed GROUP BY 1)""".format(t=clean_sql("text"))
_kt = "(SELECT label_truth AS label, count(*) AS available FROM keys GROUP BY 1) c"
_disjoint = f"WITH {_keys_cte}, assigned AS ({assign_sql('keys', 'label_truth', 'text_key', plan_sql(_kt, 'available', 0, 0.25))}) "

_conf = """tp, fp, fn, tn, n AS rows, ll AS log_loss, CAST(0.5 AS DOUBLE) AS threshold, (tp + fn) / n AS label_positive_rate, (tp + fp) / n AS predicted_positive_rate,
  (tp + tn) / n AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0) AS precision_positive, tp / (tp + fn) AS recall_positive, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_positive,
  coalesce(tn / nullif(tn + fn, 0), 0) AS precision_negative, tn / (tn + fp) AS recall_negative, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f1_negative,
  (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS macro_f1, tp + fn AS positive_support"""


def confusion_sql(src: str, by: str = "") -> str:
    g, gb = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {g}{_conf} FROM (SELECT {g}count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
  count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) AS n,
  avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END) AS ll FROM {src}{gb}) c"""


def auc_sql(src: str, by: str = "") -> str:
    g, part, gb = (f"{by}, ", f"PARTITION BY {by}", f" GROUP BY {by}") if by else ("", "", "")
    return f"""SELECT {g}(sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - np * (np + 1) / 2) / (np * nn) AS roc_auc FROM (
  SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER (PARTITION BY {g}p) - 1) / 2.0 AS rk,
    sum(y) OVER ({part}) AS np, sum(1 - y) OVER ({part}) AS nn FROM {src}) z GROUP BY {g}np, nn"""


def ap_sql(src: str, by: str = "") -> str:
    g, part, gb = (f"{by}, ", f"PARTITION BY {by} ", f" GROUP BY {by}") if by else ("", "", "")
    return f"""SELECT {g}sum(pos / tot * tp / (tp + fp)) AS average_precision FROM (
  SELECT *, sum(pos) OVER ({part}ORDER BY p DESC) AS tp, sum(neg) OVER ({part}ORDER BY p DESC) AS fp, sum(pos) OVER ({part}) AS tot
  FROM (SELECT {g}p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {src} GROUP BY {g}p) s) t{gb}"""


_prob = f"""SELECT b.model, brier, log_loss, roc_auc AS auc FROM (SELECT model, avg(power(q - y, 2)) AS brier, avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END) AS log_loss
  FROM (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM models) m GROUP BY model) b JOIN ({auc_sql('(SELECT model, y, least(greatest(p, 1e-6), 1 - 1e-6) AS p FROM models) mm', 'model')}) a ON a.model = b.model"""

V["graph_rows"] = (("latest_truth",), "SELECT *, " + ", ".join(f"{three_sql(f)} AS g_{b}" for f, b in T.GRAPH_BUCKET_OF.items()) + " FROM latest_truth")
V["cpd"] = (
    ("graph_rows",),
    "SELECT '' AS bucket_column, c.class, '' AS bucket, (count(g.record_id) + 1.0) / ((SELECT count(*) FROM graph_rows) + 2) AS prob FROM (VALUES (0), (1)) c(class) LEFT JOIN graph_rows g ON g.label_truth = c.class GROUP BY c.class UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{b}', c.class, l.lv, (count(g.record_id) FILTER (g.g_{b} = l.lv) + 1.0) / (count(g.record_id) + 3) FROM (VALUES (0), (1)) c(class) CROSS JOIN (VALUES ('low'), ('medium'), ('high')) l(lv) LEFT JOIN graph_rows g ON g.label_truth = c.class GROUP BY c.class, l.lv"
        for b in terms.GRAPH_BUCKETS
    ),
)
V["trust_rows"] = (
    ("latest", "cpd"),
    "SELECT *, 1 - pg AS trust_risk_index_graph, 1 - pl AS trust_risk_index_logistic, -(q * log2(q) + (1 - q) * log2(1 - q)) AS graph_uncertainty_entropy FROM ("
    "SELECT *, least(greatest(pg, 1e-9), 1 - 1e-9) AS q FROM (SELECT l.*, CAST(l.record_id AS BIGINT) AS input_seq, exp(s1) / (exp(s0) + exp(s1)) AS pg, 1 / (1 + exp(-("
    + " + ".join([str(INTERCEPT), *[f"({w}) * {f}" for w, f in zip(LOGISTIC, FACTORS)]])
    + "))) AS pl FROM latest l JOIN (SELECT record_id, sum(ln(prob)) FILTER (class = 0) AS s0, sum(ln(prob)) FILTER (class = 1) AS s1 FROM ("
    + "SELECT record_id, class, prob FROM latest, cpd WHERE bucket_column = '' UNION ALL "
    + " UNION ALL ".join(f"SELECT record_id, class, prob FROM latest JOIN cpd ON bucket_column = '{b}' AND bucket = {three_sql(f)}" for f, b in T.GRAPH_BUCKET_OF.items())
    + ") u GROUP BY record_id) s USING (record_id)) a) b",
)
V["status_rows"] = (
    ("trust_rows",),
    """SELECT record_id, input_seq, CASE WHEN input_seq % 17 = 0 THEN 'unavailable' WHEN input_seq % 5 = 0 THEN 'error' ELSE 'ok' END AS status,
  pg, CASE WHEN input_seq % 3 <> 0 THEN pl END AS pl, trust_risk_index_graph AS dg, graph_uncertainty_entropy AS ent FROM trust_rows""",
)
_ann = ["CAST(((doc_id * {}) % 1200) / 1000.0 AS DOUBLE)".format(p) for p in (37, 53, 71, 89)]
_clampq = lambda x: f"least(1.0, greatest(0.0, {x}))"
_json = lambda x: f"CASE WHEN {x} IS NULL THEN 'null' ELSE to_json({x}) END"

ORACLES = {
    "review_prep": sql(
        ["review_rows"],
        f"""SELECT doc_id, rating, coalesce(flag IN ('Yes', 'maybe'), FALSE) AS verified_purchase, coalesce(votes, 0) AS helpful_votes,
CASE WHEN coalesce(votes, 0) >= 3 THEN 1 ELSE 0 END AS label, CAST({words_sql('text')} AS INT) AS review_len_words FROM review_rows
WHERE coalesce(votes, 0) NOT IN (1, 2) AND {words_sql('text')} >= 5""",
    ),
    "review_features": sql(
        ["review_rows"],
        f"""SELECT doc_id, trim({clean_sql('title')} || ' ' || {clean_sql('text')}) AS combined_text, coalesce(rating, 0.0) AS rating,
coalesce(flag IN ('Yes', 'maybe'), FALSE) AS verified_purchase, CAST({words_sql('text')} AS DOUBLE) AS review_len_words,
CAST(length({clean_sql('title')}) AS DOUBLE) AS title_len_chars, CAST(length({clean_sql('text')}) AS DOUBLE) AS text_len_chars FROM review_rows""",
    ),
    "sentiment_clean": f"SELECT doc_id, lower({clean_sql('text')}) AS text FROM documents",
    "relabel": sql(["review_rows"], "SELECT doc_id, CASE WHEN votes IS NOT NULL THEN CAST(votes >= 3 AS INT) ELSE CAST(doc_id % 2 AS INT) END AS label FROM review_rows"),
    "review_validation": sql(
        ["review_rows"],
        f"""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN CAST('nan' AS DOUBLE) ELSE rating END AS rating_value,
CASE WHEN flag IS NULL OR flag = '0' THEN FALSE WHEN flag = 'Yes' THEN TRUE END AS verified_flag,
CASE WHEN doc_id % 11 = 0 OR t = '' THEN 'empty_text' WHEN doc_id % 9 = 0 THEN 'rating_not_numeric' WHEN flag = 'maybe' THEN 'flag_not_boolean' END AS reject_reason,
CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE length(t) END AS INT) AS n FROM (SELECT *, regexp_replace(text, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') AS t FROM review_rows) r""",
    ),
    "quota_plan": f"{plan_sql(_qc, _min, 0.15, 0.2)} UNION ALL {plan_sql(_qc, 'available', 0.1, 0.1)}",
    "quota_assignment": f"SELECT doc_id, quality, split FROM ({assign_sql('labels', 'quality', 'doc_id', plan_sql(_qc, _min, 0.15, 0.2))}) a",
    "stratified_split": sql(["texts"], f"SELECT doc_id, label_truth, split FROM ({assign_sql('texts', 'label_truth', 'doc_id', plan_sql(_lt, 'available', 0, 0.25))}) a"),
    "balanced_sample": f"SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {unit_sql('doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM labels) q WHERE r <= 50 OR n <= 100",
    "disjoint_split": sql(["texts"], _disjoint + "SELECT doc_id, text_key, k.label_truth, split FROM keyed k JOIN (SELECT text_key, split FROM assigned) a USING (text_key)"),
    "disjoint_overlap": sql(["texts"], _disjoint + "SELECT count(*) FILTER (split = 'train') AS train_unique_text_keys, count(*) FILTER (split = 'test') AS test_unique_text_keys, count(*) - count(DISTINCT text_key) AS text_key_overlap FROM assigned"),
    "uniform_sample": f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {unit_sql('doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents) q WHERE r <= greatest(1, floor(n * 0.1))",
    "duplicate_sample": f"SELECT doc_id FROM (SELECT DISTINCT doc_id, text FROM documents) d WHERE {unit_sql('doc_id')} < 0.1",
    "binary_metrics": sql(["scores"], "SELECT tp, fp, fn, tn, rows, positive_support, threshold, " + r6("log_loss", "label_positive_rate", "predicted_positive_rate", "accuracy", "balanced_accuracy", "precision_positive", "recall_positive", "f1_positive", "precision_negative", "recall_negative", "f1_negative", "macro_f1") + f" FROM ({confusion_sql('scores')}) m"),
    "auc_ap": sql(["scores"], f"SELECT round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM ({auc_sql('scores')}) a, ({ap_sql('scores')}) b"),
    "threshold_sweep": sql(
        ["scores"],
        """SELECT t AS best_threshold, round(f1, 6) AS best_metric_value, n AS candidate_thresholds FROM (
SELECT t, round((2 * tp / (2 * tp + fp + fn) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 12) AS f1, count(*) OVER () AS n FROM (
  SELECT c.p AS t, count(*) FILTER (y = 1 AND s.p >= c.p) AS tp, count(*) FILTER (y = 0 AND s.p >= c.p) AS fp,
    count(*) FILTER (y = 1 AND s.p < c.p) AS fn, count(*) FILTER (y = 0 AND s.p < c.p) AS tn
  FROM (SELECT DISTINCT p FROM scores) c, scores s GROUP BY c.p) z) y ORDER BY f1 DESC, round(abs(t - 0.5), 12), t DESC LIMIT 1""",
    ),
    "model_ranking": sql(["models"], f"SELECT model, round(macro_f1, 6) AS macro_f1 FROM (SELECT m.*, roc_auc, average_precision FROM ({confusion_sql('models', 'model')}) m JOIN ({auc_sql('models', 'model')}) a USING (model) JOIN ({ap_sql('models', 'model')}) b USING (model)) x ORDER BY macro_f1 DESC, average_precision DESC NULLS LAST, roc_auc DESC NULLS LAST, balanced_accuracy DESC, model LIMIT 1"),
    "brier_logloss": sql(["models"], f"SELECT model, {r6('brier', 'log_loss', 'auc')} FROM ({_prob}) x"),
    "metric_deltas": sql(["models"], f"WITH pm AS ({_prob}) SELECT a.model, round(a.auc - b.auc, 6) AS auc_delta, round(a.brier - b.brier, 6) AS brier_delta, round(a.log_loss - b.log_loss, 6) AS log_loss_delta FROM pm a, pm b WHERE b.model = 'first'"),
    "calibration": sql(
        ["scores"],
        "WITH e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM scores) SELECT bin, round(avg(p), 6) AS pred_bin_mean, round(avg(y), 6) AS true_rate, count(*) AS rows FROM (SELECT y, p, CAST(len(list_filter(edges, lambda v: v < p)) AS INT) AS bin FROM scores, e) b GROUP BY bin",
    ),
    "score_distributions": sql(
        ["latest_truth"],
        "SELECT factor, label_truth, round(min(s), 6) AS min, round(quantile_cont(s, 0.25), 6) AS q1, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.75), 6) AS q3, round(max(s), 6) AS max FROM ("
        + " UNION ALL ".join(f"SELECT label_truth, '{f}' AS factor, {f} AS s FROM latest_truth" for f in FACTORS) + ") u GROUP BY ALL",
    ),
    "score_histograms": sql(["long_scores"], "SELECT factor, bin, count(*) AS rows FROM (SELECT factor, CAST(least(coalesce(floor((score - lo) / nullif(hi - lo, 0) * 20), 0), 19) AS INT) AS bin FROM (SELECT *, min(score) OVER (PARTITION BY factor) AS lo, max(score) OVER (PARTITION BY factor) AS hi FROM long_scores) w) b GROUP BY ALL"),
    "factor_extremes": sql(
        ["long_scores"],
        """SELECT factor, extreme, record_id, round(score, 6) AS selected_score FROM (
SELECT *, 'high' AS extreme, row_number() OVER (PARTITION BY factor ORDER BY score DESC, record_id) AS r FROM long_scores UNION ALL
SELECT *, 'low', row_number() OVER (PARTITION BY factor ORDER BY score, record_id) FROM long_scores) q WHERE r = 1""",
    ),
    "representatives": sql(["latest"], """SELECT position, record_id, round(integrity_score, 6) AS integrity_score FROM (
SELECT *, row_number() OVER (ORDER BY integrity_score, record_id) - 1 AS i, count(*) OVER () AS n FROM latest) q
JOIN (VALUES ('low'), ('median'), ('high')) v(position) ON i = CASE position WHEN 'low' THEN 0 WHEN 'median' THEN n // 2 ELSE n - 1 END"""),
    "length_medians": sql(["texts"], f"SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, label_truth, quantile_cont(CAST({words_sql('text')} AS DOUBLE), 0.5) AS word_len, quantile_cont(CAST(length(text) AS DOUBLE), 0.5) AS char_len FROM texts GROUP BY 1, 2"),
    "label_balance": sql(["texts"], "SELECT lang, count(*) AS rows, round(avg(CASE WHEN label_truth = 1 THEN 1.0 ELSE 0.0 END) * 100, 2) AS positive_pct, round(avg(CASE WHEN label_truth = 0 THEN 1.0 ELSE 0.0 END) * 100, 2) AS negative_pct FROM texts GROUP BY lang"),
    "first_examples": sql(["texts"], "SELECT label_truth, doc_id, CAST(r AS INT) AS rank, text FROM (SELECT *, row_number() OVER (PARTITION BY label_truth ORDER BY doc_id) AS r FROM texts) q WHERE r <= 3"),
    "feedback_texts": "SELECT conv_id AS seller_id, string_agg(text, ' || ' ORDER BY turn) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role <> 'assistant' AND (conv_id + turn) % 9 <> 0 AND text <> '') q WHERE r <= 10 GROUP BY conv_id",
}

V["fused"] = (
    (),
    """SELECT *, g * w AS informative_gate, abs(pol) AS strength FROM (SELECT *, 1 / (1 + exp(-8 * (u - 0.5))) AS g, coalesce(1 - d, 1.0) AS w, pp - np AS pol FROM (
  SELECT doc_id, product_id, least(1.0, greatest(0.0, u0)) AS u, d, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.5 END AS pp, CASE WHEN a + b > 0 THEN b / (a + b) ELSE 0.5 END AS np FROM (
    SELECT doc_id, source AS product_id, ((doc_id * 37) % 111) / 100.0 - 0.05 AS u0, CASE WHEN doc_id % 19 = 0 THEN 0.0 ELSE ((doc_id * 53) % 100) / 99.0 END AS a,
      CASE WHEN doc_id % 19 = 0 THEN 0.0 ELSE ((doc_id * 71) % 100) / 99.0 END AS b, CASE WHEN doc_id % 6 <> 0 THEN ((doc_id * 89) % 100) / 99.0 END AS d FROM documents) r) s) t""",
)
ORACLES.update(
    {
        "review_fusion": sql(
            ["fused"],
            """SELECT doc_id, product_id, round(u, 6) AS usefulness_probability, round(pp, 6) AS positive_probability, round(np, 6) AS negative_probability, round(d, 6) AS deception_probability,
  round(g, 6) AS helpfulness_gate, round(w, 6) AS deception_weight, round(pol, 6) AS sentiment_polarity, round(informative_gate, 6) AS informative_gate, round(strength, 6) AS sentiment_strength,
  round(informative_gate * pol, 6) AS signed_ewom_score, round(informative_gate * strength, 6) AS magnitude_ewom_score, round(50 * (informative_gate * pol + 1), 6) AS ewom_score_0_to_100,
  round(100 * informative_gate * strength, 6) AS ewom_magnitude_0_to_100 FROM fused""",
        ),
        "product_review_score": sql(
            ["fused"],
            """SELECT product_id, n AS review_count, round(wsum, 6) AS informative_review_weight, round(mu, 6) AS mean_usefulness_probability, round(mg, 6) AS mean_helpfulness_gate,
  round(md, 6) AS mean_deception_probability, round(mw, 6) AS mean_deception_weight, round(wsum / n, 6) AS mean_informative_gate, round(a, 6) AS weighted_positive_probability,
  round(b, 6) AS weighted_negative_probability, round(c, 6) AS weighted_sentiment_polarity, round(e, 6) AS weighted_sentiment_strength, round(gate, 6) AS review_set_gate,
  round(gate * c, 6) AS final_signed_ewom_score, round(gate * e, 6) AS final_magnitude_ewom_score, round(50 * (gate * c + 1), 6) AS final_ewom_score_0_to_100, round(100 * gate * e, 6) AS final_ewom_magnitude_0_to_100,
  round(1 - md, 6) AS trust_probability, round(50 * (gate * c + 1), 6) AS ewom_score_0_to_100, round(100 * gate * e, 6) AS ewom_magnitude_0_to_100
FROM (SELECT product_id, count(*) AS n, sum(informative_gate) AS wsum, avg(u) AS mu, avg(g) AS mg, avg(d) AS md, avg(w) AS mw, sum(informative_gate * pp) / sum(informative_gate) AS a,
  sum(informative_gate * np) / sum(informative_gate) AS b, sum(informative_gate * pol) / sum(informative_gate) AS c, sum(informative_gate * strength) / sum(informative_gate) AS e,
  1 - exp(-sum(informative_gate) / 3) AS gate FROM fused GROUP BY product_id) q""",
        ),
        "score_buckets": sql(["log_rows"], "SELECT record_id, ingest_seq, " + ", ".join(f"{three_sql(f)} AS {b}" for f, b in T.GRAPH_BUCKET_OF.items()) + " FROM log_rows WHERE error IS NULL"),
        "valid_labels": sql(["latest"], f"SELECT record_id, ingest_seq, {r6(*FACTORS)}, {', '.join(terms.LABEL_BUCKETS)} FROM latest"),
        "valid_labels_last_then_valid": sql(["log_rows"], "SELECT record_id, ingest_seq FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingest_seq DESC) AS r FROM log_rows) q WHERE r = 1 AND error IS NULL"),
        "labelled_rows": sql(["latest"], "SELECT doc_id, lang, n_chars, round(claim_trust_score, 6) AS claim_trust_score, claim_trust_bucket FROM documents d JOIN latest l ON l.record_id = CAST(d.doc_id AS VARCHAR)"),
        "pending_labels": sql(["latest"], f"SELECT doc_id, lang FROM documents WHERE {clean_sql('text')} <> '' AND CAST(doc_id AS VARCHAR) NOT IN (SELECT record_id FROM latest)"),
        "duplicate_check": sql(
            ["log_rows"],
            "SELECT record_id, " + ", ".join(f"round(d{i}, 6) AS dup_abs_diff_{n}" for i, n in enumerate(("claim", "signal", "pressure", "competence", "benevolence", "integrity", "predictability")))
            + ", round((" + " + ".join(f"d{i}" for i in range(7)) + ") / 7, 6) AS dup_abs_diff_mean FROM (SELECT a.record_id, "
            + ", ".join(f"abs(a.{f} - b.{f}) AS d{i}" for i, f in enumerate(FACTORS))
            + " FROM log_rows a JOIN log_rows b USING (record_id) WHERE a.ingest_seq < 1000000000000 AND b.ingest_seq >= 1000000000000 AND a.error IS NULL AND b.error IS NULL) q",
        ),
        "backfill_truth": sql(["truth"], "SELECT CAST(d.doc_id AS VARCHAR) AS record_id, CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE t.label_truth END AS label_truth FROM documents d LEFT JOIN truth t ON t.record_id = CAST(d.doc_id AS VARCHAR)"),
        "nb_graph_cpd": sql(["cpd"], "SELECT bucket_column, class, bucket, round(prob, 6) AS prob FROM cpd"),
        "nb_graph_predict": sql(["trust_rows"], "SELECT record_id, round(pg, 6) AS phase_b_truth_likelihood_graph, round(pl, 6) AS phase_b_truth_likelihood_logistic, " + r6("trust_risk_index_graph", "trust_risk_index_logistic", "graph_uncertainty_entropy") + " FROM trust_rows"),
        "trust_normalised": sql(
            ["status_rows"],
            """SELECT record_id, input_seq, status, round(a, 6) AS trust_probability_graph, round(b, 6) AS trust_probability_logistic, round(1 - a, 6) AS deception_probability_graph, round(1 - b, 6) AS deception_probability_logistic,
  round(coalesce(b, a), 6) AS trust_probability, round(1 - coalesce(b, a), 6) AS deception_probability, 1 - coalesce(b, a) >= 0.5 AS is_deceptive,
  CASE WHEN b IS NOT NULL THEN 'logistic' WHEN a IS NOT NULL THEN 'graph' END AS score_head, round(e, 6) AS graph_uncertainty_entropy
FROM (SELECT *, CASE WHEN status = 'ok' THEN pg END AS a, CASE WHEN status = 'ok' THEN pl END AS b, CASE WHEN status = 'ok' THEN ent END AS e FROM status_rows) q""",
        ),
        "trust_summary": sql(
            ["trust_rows"],
            """WITH t AS (SELECT *, round(trust_risk_index_graph, 9) AS rk, round(graph_uncertainty_entropy, 9) AS en, input_seq % 5 <> 0 AS good FROM trust_rows)
SELECT count(*) AS total_products, count(*) FILTER (good) AS successful_products, count(*) FILTER (NOT good) AS failed_products, round(avg(pg) FILTER (good), 6) AS average_phase_b_truth_likelihood_graph,
  round(avg(rk) FILTER (good), 6) AS average_trust_risk_index_graph, (SELECT record_id FROM t WHERE good ORDER BY rk DESC, input_seq LIMIT 1) AS highest_graph_risk_record_id,
  (SELECT record_id FROM t WHERE good ORDER BY en DESC, input_seq LIMIT 1) AS highest_entropy_record_id FROM t""",
        ),
        "top_risk": sql(["trust_rows"], "SELECT record_id, round(rk, 6) AS risk FROM (SELECT record_id, round(trust_risk_index_graph, 9) AS rk FROM trust_rows) t ORDER BY rk DESC, record_id LIMIT 15"),
        "closest_mistakes": sql(["scores"], "SELECT doc_id, y, round(p, 6) AS p, round(abs(p - 0.5), 6) AS margin FROM scores WHERE CAST(p >= 0.5 AS INT) <> y ORDER BY abs(p - 0.5), doc_id LIMIT 20"),
        "assembled_results": sql(["status_rows"], "SELECT record_id, status, CASE WHEN status = 'ok' THEN round(pg, 6) END AS phase_b_truth_likelihood_graph FROM status_rows"),
        "listing_text": f"""SELECT doc_id, 'Title: ' || {clean_sql('source')} || CASE WHEN doc_id % 2 = 0 AND {clean_sql('text')} <> '' THEN chr(10) || 'Bullet Points: ' || {clean_sql('text')} ELSE '' END AS product,
CASE WHEN doc_id % 2 = 0 THEN 'Title: ' || lang ELSE 'Statement: ' || lang END AS news FROM documents""",
        "catalog_browse": f"SELECT 'r' || p_partkey AS record_id, p_name AS TITLE, p_retailprice FROM part WHERE contains(lower('r' || p_partkey || ' ' || p_partkey || ' ' || p_name || ' ' || p_type || ' ' || p_brand), 'red') AND {three_sql('(p_partkey % 10) / 9.0')} = 'high'",
        "product_inputs": f"""WITH src AS (SELECT doc_id AS input_seq, CASE WHEN doc_id % 5 < 3 THEN nullif({clean_sql('source')}, '') END AS title, CASE WHEN doc_id % 7 = 0 THEN nullif({clean_sql('text')}, '') END AS bullets,
  CASE WHEN doc_id % 3 <> 0 THEN nullif({clean_sql('lang')}, '') END AS content, CASE WHEN doc_id % 4 = 0 THEN source END AS product_id, CASE WHEN doc_id % 10 = 0 THEN 'same' END AS given FROM documents),
built AS (SELECT *, coalesce(nullif(concat_ws(chr(10), 'Title: ' || title, 'Bullet Points: ' || bullets), ''), content) AS text FROM src),
ids AS (SELECT *, CASE WHEN text IS NULL THEN 'invalid_product_' || input_seq ELSE coalesce(given, product_id,
  'product_' || substr(sha256('{{"bullet_points": ' || {_json('bullets')} || ', "description": null, "text": ' || {_json('text')} || ', "title": ' || {_json('title')} || '}}'), 1, 16)) END AS base,
  CASE WHEN text IS NULL THEN 'error' ELSE 'ok' END AS status FROM built)
SELECT CASE WHEN r > 1 THEN base || '__' || r ELSE base END AS record_id, status, input_seq, product_id, title, text FROM (
  SELECT *, row_number() OVER (PARTITION BY base, status ORDER BY input_seq) AS r FROM ids) q""",
    }
)


def annotation_sql() -> str:
    c, s, p, i = (f"round({x}, 3)" for x in _ann)
    cols = {
        "claim_trust_score": _clampq(c), "signal_trust_score": _clampq(s), "heuristic_pressure_score": _clampq(p),
        "competence_score": f"0.6 * {_clampq(s)} + 0.4 * {_clampq(c)}",
        "benevolence_score": f"0.5 * {_clampq(c)} + 0.5 * (1 - {_clampq(p)})",
        "integrity_score": _clampq(i), "predictability_score": f"0.5 * {_clampq(c)} + 0.5 * {_clampq(s)}",
        "overall_confidence": "CAST(0.5 AS DOUBLE)",
    }
    ok = "doc_id % 11 > 2"
    inner = ", ".join(f"CASE WHEN {ok} THEN {x} END AS {n}" for n, x in cols.items())
    buckets = ", ".join(f"{three_sql(f)} AS {b}" for f, b in T.LABEL_BUCKET_OF.items())
    return f"""SELECT record_id, error, rationale_claim, {r6(*cols)}, {buckets} FROM (SELECT CAST(doc_id AS VARCHAR) AS record_id,
CASE doc_id % 11 WHEN 0 THEN 'no_json_object' WHEN 1 THEN 'missing_core_score' WHEN 2 THEN 'unreadable_score' END AS error,
CASE WHEN {ok} THEN 'fine' END AS rationale_claim, {inner} FROM documents) q"""


ORACLES["annotation_parse"] = annotation_sql()

"""Split modes, run summaries, rejections, models kept for another domain, and views of the label log."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import terms
from ..operators import catalog as C
from ..operators import evaluate as E
from ..operators import listings as L
from ..operators import reviews as W
from ..operators import sampling as S
from ..operators import textmodels as M
from ..operators import trust as T
from ..operators import value as V
from ..session import materialise
from . import catalog_queries, listing_queries, review_queries, views
from .views import rounded, sql

#: Documents of this language are the domain that models are fitted on; the others are applied to.
HOME = "en"


def _cases(spark, sf):
    """Inputs for the split: as it is, one label only, and a label whose texts are all blank."""
    rows = review_queries.labelled_texts(spark, sf).select("doc_id", "text", "label_truth")
    yield "normal", rows, True
    yield "by_row", rows, False
    yield "one_label", rows.withColumn("label_truth", F.lit(1)), True
    yield "no_keys", rows.withColumn("text", F.when(F.col("label_truth") == 1, F.col("text")).otherwise(" \n")), True


def _split_cases(spark, sf):
    out = None
    for name, rows, disjoint in _cases(spark, sf):
        split = S.split_rows(rows, "label_truth", "text", "doc_id", text_disjoint=disjoint)
        split = split.select(F.lit(name).alias("case_name"), "doc_id", "label_truth", "text_key", "split", "split_mode")
        out = split if out is None else out.unionByName(split)
    return out


def split_modes(spark, sf):
    return _split_cases(spark, sf)


def split_mode_summary(spark, sf):
    """Mode, rows of each side and texts on both sides, by case."""
    rows = materialise(_split_cases(spark, sf))
    train, test = F.col("split") == "train", F.col("split") == "test"
    sizes = rows.groupBy("case_name").agg(F.max("split_mode").alias("split_mode"), F.count_if(train).alias("train_rows"), F.count_if(test).alias("test_rows"))
    keys = rows.where("text_key IS NOT NULL").groupBy("case_name", "text_key").agg(F.max(train.cast("int")).alias("a"), F.max(test.cast("int")).alias("b"))
    return sizes.join(keys.groupBy("case_name").agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("text_key_overlap")), "case_name")


def prepared_summary(spark, sf):
    return rounded(C.prepared_summary(catalog_queries.split_products(spark, sf)))


def split_label_summary(spark, sf):
    rows = review_queries.quota_assignment(spark, sf)
    return rounded(S.label_summary(rows, "quality"))


def scan_summary(spark, sf):
    """Rows seen, eligible and skipped before a review split, with the share of label 1."""
    raw = review_queries.review_rows(spark, sf)
    ready = W.prepare_reviews(raw, positive_threshold=3, drop_middle=True, min_review_words=5)
    seen = raw.agg(F.count("*").alias("raw_rows_seen"), F.lit(1).alias("_one"))
    kept = ready.agg(F.count("*").alias("eligible_rows"), F.avg(F.col("label").cast("double")).alias("positive_rate"), F.lit(1).alias("_one"))
    return rounded(seen.join(kept, "_one").drop("_one").withColumn("skipped_rows", F.col("raw_rows_seen") - F.col("eligible_rows")))


def _map_text(column):
    """A map of counts as text, its keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")


def combined_summary(spark, sf):
    out = V.combined_summary(catalog_queries.combined_value(spark, sf))
    return rounded(out.withColumn("prediction_counts", _map_text("prediction_counts")))


def rejection_stream(spark, sf):
    """All rejections of a listing: its neighbours' and its peer price's."""
    out = L.rejections(listing_queries._ranked(spark, sf), listing_queries._context(spark, sf))
    shown = F.transform("first_rejected", lambda r: F.concat(r["parent_asin"], F.lit("="), r["rejection_reason"]))
    return out.select("query_id", _map_text("rejection_summary").alias("rejection_summary"), "rejected", F.array_join(shown, ",").alias("first_rejected"))


# ------------------------------------------------------- models in another domain


def _domains(spark, sf):
    d = views.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.coalesce("lang", F.lit("none")).alias("domain"))
    return review_queries.labelled(spark, sf).drop("domain").join(d, "record_id")


def _models(spark, sf):
    """The graph and the head fitted on the home domain, written and read again as one table."""
    home = materialise(T.with_graph_buckets(_domains(spark, sf).where(F.col("domain") == HOME)))
    weights, intercept = M.fit_trust_head(home)
    return home, weights, intercept, materialise(T.model_table(T.fit_graph(home), terms.TRUST_SCORES, weights, intercept))


def _applied(spark, sf):
    models = _models(spark, sf)[-1]
    scored = T.apply_models(_domains(spark, sf).where(F.col("domain") != HOME), models)
    return scored.withColumn("phase_b_truth_likelihood_graph", F.round("phase_b_truth_likelihood_graph", 9))


def cross_domain_graph(spark, sf):
    return rounded(_applied(spark, sf).select("record_id", "domain", "phase_b_truth_likelihood_graph", "trust_risk_index_graph", "graph_uncertainty_entropy"))


def cross_domain_metrics(spark, sf):
    """Graph metrics by domain; ``cross_domain_both`` has those of the head as well."""
    return rounded(E.domain_metrics(_applied(spark, sf), "label_truth", "phase_b_truth_likelihood_graph", ["domain"]))


def cross_domain_calibration(spark, sf):
    return rounded(E.calibration_by(_applied(spark, sf), "label_truth", "phase_b_truth_likelihood_graph", ["domain"]))


def cross_domain_both(spark, sf):
    scored = _applied(spark, sf).withColumnsRenamed({"phase_b_truth_likelihood_graph": "graph", "phase_b_truth_likelihood_logistic": "logistic"})
    long = scored.select("record_id", "domain", "label_truth", "graph", "logistic").unpivot(["record_id", "domain", "label_truth"], ["graph", "logistic"], "model", "p")
    return rounded(E.domain_metrics(materialise(long), "label_truth", "p", ["domain", "model"]))


def trust_head_optimum(spark, sf):
    """The fitted head's gradient vanishes in every term."""
    home, weights, intercept, _ = _models(spark, sf)
    gradient = M.head_gradient(home, weights, intercept)
    return gradient.select("term", (F.abs("gradient") < 1e-6).alias("at_optimum"))


# ------------------------------------------------------------------ the label log


def last_failed(spark, sf):
    return T.failed_annotations(review_queries.label_log(spark, sf), 25)


def most_uncertain(spark, sf):
    out = T.most_uncertain(review_queries._trust_results(spark, sf), 15)
    return rounded(out.select("record_id", "graph_uncertainty_entropy", "trust_risk_index_graph"))


QUERIES = {
    f.__name__: f
    for f in (
        split_modes, split_mode_summary, prepared_summary, split_label_summary, scan_summary, combined_summary, rejection_stream,
        cross_domain_graph, cross_domain_metrics, cross_domain_calibration, cross_domain_both, trust_head_optimum, last_failed,
        most_uncertain,
    )
}

# --------------------------------------------------------------- SQL checks


def _case_sql(name: str, label: str, text: str, mode: str) -> str:
    """A case of ``split_modes``; the mode is known by how the case is made."""
    texts = f"(SELECT doc_id, {text} AS text, {label} AS label_truth FROM texts)"
    key = f"sha1(lower({review_queries.clean_sql('text')}) || '|' || label_truth)"
    keyed = f"(SELECT *, CASE WHEN {review_queries.clean_sql('text')} <> '' THEN {key} END AS text_key FROM {texts} t)"
    if mode == S.GROUPED:
        keys = f"(SELECT text_key, min(label_truth) AS label, count(*) AS n FROM {keyed} k WHERE text_key IS NOT NULL GROUP BY 1)"
        quota = review_queries.plan_sql(f"(SELECT label, CAST(sum(n) AS BIGINT) AS available FROM {keys} g GROUP BY 1) c", "available", 0, 0.25)
        sides = f"""(SELECT text_key, CASE WHEN test_rows > 0 AND (upto <= test_rows OR upto = n) THEN 'test' ELSE 'train' END AS split FROM (
          SELECT *, sum(n) OVER (PARTITION BY label ORDER BY {review_queries.unit_sql('text_key')}, text_key) AS upto FROM {keys} g) r JOIN ({quota}) q USING (label))"""
        split = f"SELECT doc_id, label_truth, text_key, split FROM {keyed} k JOIN {sides} s USING (text_key)"
    else:
        plan = review_queries.plan_sql(f"(SELECT label_truth AS label, count(*) AS available FROM {texts} t GROUP BY 1) c", "available", 0, 0.25)
        split = f"SELECT doc_id, label_truth, text_key, split FROM ({review_queries.assign_sql(keyed, 'label_truth', 'doc_id', plan).replace(f'FROM {keyed}) x', f'FROM {keyed} kk) x')}) a"
    return f"SELECT '{name}' AS case_name, doc_id, label_truth, text_key, split, '{mode}' AS split_mode FROM ({split}) z"


_CASES = " UNION ALL ".join(
    _case_sql(*c)
    for c in (
        ("normal", "label_truth", "text", S.GROUPED), ("by_row", "label_truth", "text", S.BY_ROW), ("one_label", "1", "text", S.FALLBACK),
        ("no_keys", "label_truth", "CASE WHEN label_truth = 1 THEN text ELSE chr(32) || chr(10) END", S.FALLBACK),
    )
)
_LEVELS = "CASE WHEN GROUPING({a}) = 0 AND GROUPING({b}) = 0 THEN '{ab}' WHEN GROUPING({a}) = 0 THEN '{a_}' WHEN GROUPING({b}) = 0 THEN '{b_}' ELSE 'all' END AS level"
_DOMAIN_ROWS = "SELECT l.*, coalesce(d.lang, 'none') AS domain FROM latest_truth l JOIN documents d ON CAST(d.doc_id AS VARCHAR) = l.record_id"
views.SQL["dom_rows"] = (("latest_truth",), _DOMAIN_ROWS)
views.SQL["dom_train"] = (("dom_rows",), views.SQL["graph_rows"][1].replace("FROM latest_truth", "FROM dom_rows") + f" WHERE domain = '{HOME}'")
views.SQL["dom_cpd"] = (("dom_train",), re.sub(r"\bgraph_rows\b", "dom_train", views.SQL["cpd"][1]))
views.SQL["dom_away"] = (("dom_rows",), f"SELECT * FROM dom_rows WHERE domain <> '{HOME}'")
views.SQL["dom_scored"] = (("dom_away", "dom_cpd"), re.sub(r"\bcpd\b", "dom_cpd", re.sub(r"\blatest\b", "dom_away", views.SQL["trust_rows"][1])))
views.SQL["dom_src"] = (("dom_scored",), "SELECT record_id, domain, label_truth AS y, round(pg, 9) AS p FROM dom_scored")


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


ORACLES = {
    "split_modes": sql(["texts"], _CASES),
    "split_mode_summary": sql(
        ["texts"],
        f"""WITH rows AS MATERIALIZED ({_CASES}), k AS (SELECT case_name, text_key FROM rows WHERE text_key IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) = 2)
SELECT case_name, max(split_mode) AS split_mode, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows,
  (SELECT count(*) FROM k WHERE k.case_name = rows.case_name) AS text_key_overlap FROM rows GROUP BY case_name""",
    ),
    "prepared_summary": sql(
        ["split_products"],
        "SELECT split, listing_kind, " + _LEVELS.format(a="split", b="listing_kind", ab="split_kind", a_="split", b_="kind")
        + """, count(*) AS rows, count(price) AS rows_with_price, count(*) FILTER (review_count > 0) AS rows_with_reviews, round(count(price) / count(*), 6) AS priced_rate,
round(count(*) FILTER (review_count > 0) / count(*), 6) AS reviewed_rate FROM split_products GROUP BY GROUPING SETS ((split, listing_kind), (split), (listing_kind), ())""",
    ),
    "split_label_summary": "SELECT split, quality AS label, " + _LEVELS.format(a="split", b="quality", ab="split_label", a_="split", b_="label")
    + f", count(*) AS rows, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS positive_rate FROM ({review_queries.ORACLES['quota_assignment']}) a"
    + " GROUP BY GROUPING SETS ((split, quality), (split), (quality), ())",
    "scan_summary": f"""SELECT raw_rows_seen, eligible_rows, raw_rows_seen - eligible_rows AS skipped_rows, round(positive_rate, 6) AS positive_rate FROM
(SELECT count(*) AS raw_rows_seen FROM documents) d, (SELECT count(*) AS eligible_rows, avg(label) AS positive_rate FROM ({review_queries.ORACLES['review_prep']}) r) e""",
    "combined_summary": f"""WITH c AS MATERIALIZED ({catalog_queries.ORACLES['combined_value']})
SELECT count(*) AS rows_scored, (SELECT string_agg(combined_prediction || ':' || n, ',' ORDER BY combined_prediction) FROM (SELECT combined_prediction, count(*) AS n FROM c GROUP BY 1) k) AS prediction_counts,
  {", ".join(f"round(quantile_cont(combined_good_value_probability, {q}), 6) AS {n}" for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))} FROM c""",
    "rejection_stream": sql(
        ["rerank", "lcontext"],
        f"""WITH reasons AS (SELECT query_id, reason FROM rerank WHERE reason IS NOT NULL UNION ALL SELECT query_id, status FROM lcontext WHERE status IN {L.PRICE_REASONS!r}),
counted AS (SELECT query_id, reason, count(*) AS n FROM reasons GROUP BY ALL),
gone AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM rerank WHERE reason IS NOT NULL),
first AS (SELECT query_id, string_agg(parent_asin || '=' || reason, ',' ORDER BY r) AS first_rejected FROM gone WHERE r <= 10 GROUP BY 1)
SELECT query_id, rejection_summary, rejected, first_rejected FROM (SELECT query_id, string_agg(reason || ':' || n, ',' ORDER BY reason) AS rejection_summary, CAST(sum(n) AS BIGINT) AS rejected FROM counted GROUP BY 1) s
LEFT JOIN first USING (query_id)""",
    ),
    "cross_domain_graph": sql(["dom_scored"], f"SELECT record_id, domain, {r6('phase_b_truth_likelihood_graph', 'trust_risk_index_graph', 'graph_uncertainty_entropy')} FROM (SELECT *, round(pg, 9) AS phase_b_truth_likelihood_graph FROM dom_scored) s"),
    "cross_domain_metrics": sql(
        ["dom_src"],
        f"""SELECT domain, rows, CASE WHEN two THEN round(roc_auc, 6) END AS auc, CASE WHEN two THEN round(log_loss, 6) END AS log_loss, round(brier, 6) AS brier, round(accuracy, 6) AS accuracy, round(f1_positive, 6) AS f1
FROM (SELECT *, positive_support > 0 AND positive_support < rows AS two FROM ({review_queries.confusion_sql('dom_src', 'domain')}) m JOIN ({review_queries.auc_sql('dom_src', 'domain')}) a USING (domain)
JOIN (SELECT domain, avg((p - y) * (p - y)) AS brier FROM dom_src GROUP BY 1) b USING (domain)) z""",
    ),
    "cross_domain_calibration": sql(
        ["dom_src"],
        """WITH e AS (SELECT domain, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM dom_src GROUP BY 1)
SELECT domain, bin, round(avg(p), 6) AS pred_bin_mean, round(avg(y), 6) AS true_rate, count(*) AS rows FROM (SELECT domain, y, p, CAST(len(list_filter(edges, lambda v: v < p)) AS INT) AS bin FROM dom_src JOIN e USING (domain)) b GROUP BY domain, bin""",
    ),
    "trust_head_optimum": "SELECT unnest([" + ", ".join(f"'{t}'" for t in ("intercept", *terms.TRUST_SCORES)) + "]) AS term, TRUE AS at_optimum",
    "last_failed": sql(
        ["log_rows"],
        """SELECT f.record_id, f.ingest_seq, f.error, EXISTS (SELECT 1 FROM log_rows v WHERE v.record_id = f.record_id AND v.error IS NULL AND v.ingest_seq > f.ingest_seq) AS superseded
FROM (SELECT * FROM log_rows WHERE error IS NOT NULL ORDER BY ingest_seq DESC, record_id LIMIT 25) f""",
    ),
    "most_uncertain": sql(["trust_rows"], f"SELECT record_id, {r6('graph_uncertainty_entropy', 'trust_risk_index_graph')} FROM trust_rows ORDER BY round(trust_rows.graph_uncertainty_entropy, 9) DESC, record_id LIMIT 15"),
}

"""Catalog preparation and market-context queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets, terms
from ..operators import catalog as C
from ..operators import retrieval as R
from ..operators import tfidf as T
from ..operators import value as V
from ..operators.ordering import exact_quantiles
from ..session import materialise
from . import views
from .views import rounded, sql


def products(spark: SparkSession, sf: str) -> DataFrame:
    return C.product_records(views.meta(spark, sf), C.review_signals(views.reviews(spark, sf)))


def split_products(spark: SparkSession, sf: str) -> DataFrame:
    return products(spark, sf).withColumn("split", C.hash_split(F.col("parent_asin")))


def _parts(spark: SparkSession, sf: str):
    """Test rows and priced train rows of the prepared catalog, which is written once."""
    rows = materialise(split_products(spark, sf).drop("categories"))
    return rows.where(F.col("split") == "test"), C.priced_catalog(rows.where(F.col("split") == "train"))


def _matched(spark: SparkSession, sf: str):
    """Test rows with their peers and market context, and the mean rating of the train rows."""
    test, train = _parts(spark, sf)
    index = R.RetrievalIndex.fit(train)
    found = R.neighbours(test, index)
    return test, found, R.market_context(test, found), index.rating_mean


def review_signals(spark, sf):
    return rounded(C.review_signals(views.reviews(spark, sf)))


def product_proxy_signals(spark, sf):
    return rounded(products(spark, sf).drop("categories", "product_document"))


def product_documents(spark, sf):
    return views.meta(spark, sf).select("parent_asin", C.product_document().alias("product_document"))


def listing_kind(spark, sf):
    return C.with_meta_listing_kind(views.meta(spark, sf), "kind").select("parent_asin", "kind")


def hash_split(spark, sf):
    return views.meta(spark, sf).select("parent_asin", C.hash_split(F.col("parent_asin")).alias("split"))


def split_summary(spark, sf):
    return C.split_summary(split_products(spark, sf))


def normalised_catalog(spark, sf):
    raw = views.meta(spark, sf).select(
        F.concat(F.lit(" "), F.col("parent_asin")).alias("parent_asin"),
        "title", "store", "main_category",
        F.when(F.col("listing_kind") == "other", "Gadget").otherwise(F.upper("listing_kind")).alias("listing_kind"),
        F.coalesce("price", F.lit("n/a")).alias("price"),
        F.when(F.col("average_rating").isNull(), "nan").otherwise(F.col("average_rating").cast("string")).alias("average_rating"),
        F.when(F.col("rating_number") % 2 == 0, F.col("rating_number").cast("string")).alias("review_count"),
        "product_document",
    )
    out = C.normalise_catalog(raw)
    return rounded(out.select("parent_asin", "title", "product_document", "listing_kind", "price", "average_rating", "review_count"))


def priced_catalog(spark, sf):
    kept = C.priced_catalog(products(spark, sf), "device, cable, Other, unknown")
    return kept.select("parent_asin", "listing_kind", "price")


def global_rating_mean(spark, sf):
    _, train = _parts(spark, sf)
    return rounded(C.global_rating_mean(train))


def term_stats(spark, sf):
    docs = T.numbered(T.distinct_documents(views.table(spark, sf, "documents"), "text"), "doc_id")
    cfg = T.VocabularyConfig(min_df=2, max_df=0.95, word_max_features=40_000)
    vocab = T.vocabulary(T.term_counts(docs, cfg, ("w",), unique=True), docs, cfg, ("w",))
    return vocab.select(F.substr("term", F.lit(3)).alias("term"), "df", F.round("idf", 6).alias("idf"))


def tfidf_vectors(spark, sf):
    _, train = _parts(spark, sf)
    docs = T.numbered(T.distinct_documents(train, "product_document"), "doc_id")
    counts = materialise(T.term_counts(docs, T.VocabularyConfig(), unique=True))
    vocab = materialise(T.vocabulary(counts, docs, T.VocabularyConfig()))
    return (
        T.vectors(counts, vocab)
        .join(docs.select("doc_id", "text"), "doc_id")
        .select("text", F.explode("vec").alias("x"))
        .join(F.broadcast(vocab.select("term_id", "term")), F.col("x.t") == F.col("term_id"))
        .select("text", "term", F.round("x.w", 6).alias("weight"))
    )


def topk_similar(spark, sf):
    _, found, _, _ = _matched(spark, sf)
    return rounded(found.select("query_id", "rank", "parent_asin", "price", "similarity", "retrieval_listing_kind"))


def peer_price(spark, sf):
    return rounded(
        _matched(spark, sf)[2].select(
            "parent_asin", "peer_price", "neighbor_count", "average_neighbor_similarity", "retrieval_listing_kind"
        )
    )


def _worth(spark, sf):
    _, _, context, mean = _matched(spark, sf)
    return V.worth_buying(context, mean)


WORTH_COLUMNS = (
    "parent_asin", "title", "price", "average_rating", "rating_number", "review_count",
    "listing_kind", "peer_price", "price_gap_vs_peer", "neighbor_count",
    "average_neighbor_similarity", "retrieval_listing_kind", "price_alignment_score",
    "bayesian_rating_score", "review_quality_score", "confidence_score", "worth_buying_score",
    "verdict",
)


def worth_buying(spark, sf):
    scored = V.ordered_scores(_worth(spark, sf), "worth_buying_score", "confidence_score")
    return rounded(scored.select(*WORTH_COLUMNS))


def score_quantiles(spark, sf):
    worth = _worth(spark, sf).select("verdict", "worth_buying_score")
    quantiles = exact_quantiles(worth, "worth_buying_score", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    counts = worth.agg(
        F.count("*").alias("rows_scored"),
        *[
            F.count_if(F.col("verdict") == v).alias(f"{v}_rows")
            for v in ("worth_buying", "consider", "skip", "insufficient_evidence")
        ],
    )
    one = F.lit(1).alias("_one")
    return rounded(counts.select("*", one).join(quantiles.select("*", one), "_one").drop("_one"))


def combined_value(spark, sf):
    test, _, context, mean = _matched(spark, sf)
    worth = V.worth_buying(context, mean)
    out = V.combined_value(test, worth)
    return rounded(V.ordered_scores(out, "combined_good_value_probability", "retrieval_confidence_score"))


def _value_inputs(spark, sf):
    p = products(spark, sf)
    k = F.col("parent_asin").cast("int")
    return p.select(
        "parent_asin", "trust_probability", "ewom_score_0_to_100", "ewom_magnitude_0_to_100",
        "average_rating", F.coalesce("rating_number", F.col("review_count").cast("double")).alias("rating_count"),
        "verified_purchase_rate", "price",
        F.when(k % 7 != 0, 600.0 + (k * 37) % 700).alias("peer_price"),
        F.when(k % 4 != 0, ((k % 5) * 6.0)).alias("warranty_months"),
        F.when(k % 3 != 0, ((k % 6) * 7.0)).alias("return_window_days"),
    )


def value_evidence(spark, sf):
    out = V.value_evidence(_value_inputs(spark, sf), "fair")
    return rounded(out.select("parent_asin", *V.EVIDENCE, "price_gap_vs_peer", "relative_price_bucket_source"))


POSTERIOR_COLUMNS = tuple(
    f"{n}_{s}"
    for n in ("trustworthiness", "review_evidence", "product_quality", "service_support")
    for s in ("low", "medium", "high", "state")
)


def good_value_posterior(spark, sf):
    out = V.good_value_posterior(V.value_evidence(_value_inputs(spark, sf)))
    return rounded(out.select("parent_asin", "good_value_probability", *POSTERIOR_COLUMNS))


QUERIES = {
    f.__name__: f
    for f in (
        review_signals, product_proxy_signals, product_documents, listing_kind, hash_split,
        split_summary, normalised_catalog, priced_catalog, global_rating_mean, term_stats,
        tfidf_vectors, topk_similar, peer_price, worth_buying, score_quantiles, combined_value,
        value_evidence, good_value_posterior,
    )
}

# ---------------------------------------------------------------- SQL checks


def key_sql(expr: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({expr}, '')), '[^a-z0-9]+', ' ', 'g'))"


def any_sql(text: str, phrases) -> str:
    return "(" + (" OR ".join(f"contains({text}, '{p}')" for p in phrases) or "FALSE") + ")"


def kind_match_sql(text: str, kind: str) -> str:
    hit = any_sql(text, terms.KIND_PHRASES[kind])
    if kind == "charger":
        rest = any_sql(text, [p for p in terms.KIND_PHRASES[kind] if p != "charger"])
        return f"({hit} AND NOT (contains({text}, 'charging case') AND NOT {rest}))"
    if kind == "case":
        return f"({hit} OR contains({text}, 'charging case'))"
    return hit


def kind_sql(title: str, category: str, combined: str) -> str:
    """Kind from three already normalised text expressions."""
    others = " OR ".join(kind_match_sql(title, k) for k in terms.KIND_RULE_ORDER)
    rules = "".join(
        f" WHEN {any_sql(category, terms.KIND_CATEGORY_HINTS.get(k, ()))} OR {kind_match_sql(combined, k)} THEN '{k}'"
        for k in (*terms.KIND_RULE_ORDER, "device")
    )
    return (
        f"CASE WHEN NOT contains(' ' || {title} || ' ', ' for ') AND {kind_match_sql(title, 'device')} "
        f"AND NOT ({others}) THEN 'device'{rules} ELSE 'other' END"
    )


def steps_sql(x: str, edges, states, op: str = "<") -> str:
    whens = " ".join(f"WHEN {x} {op} {e} THEN '{s}'" for e, s in zip(edges, states))
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE '{states[-1]}' END"


def price_bucket_sql(gap: str) -> str:
    return (
        f"CASE WHEN {gap} > 0.40 THEN 'extreme_cheaper' WHEN {gap} > 0.20 THEN 'much_cheaper' WHEN {gap} > 0.05 THEN 'cheaper' "
        f"WHEN {gap} >= -0.05 THEN 'fair' WHEN {gap} >= -0.20 THEN 'pricier' WHEN {gap} >= -0.40 THEN 'much_pricier' "
        f"WHEN {gap} IS NOT NULL THEN 'extreme_pricier' END"
    )


def evidence_sql(source: str, default: str = "NULL") -> str:
    """Select: every column of the source plus the evidence buckets."""
    gap = "CASE WHEN peer_price > 0 THEN (peer_price - price) / peer_price END"
    b = buckets
    return f"""SELECT *, {steps_sql('trust_probability', (0.2, 0.4, 0.6, 0.82), b.TRUST_STATES)} AS trust_signal,
  {steps_sql('ewom_score_0_to_100', (20, 40, 60, 80), b.POLARITY_STATES)} AS review_polarity,
  {steps_sql('ewom_magnitude_0_to_100', (25, 60), b.STRENGTH_STATES)} AS review_strength,
  {steps_sql('average_rating', (3.6, 4.3), b.THREE)} AS rating_signal,
  {steps_sql('rating_count', (20, 200), b.THREE)} AS review_volume,
  {steps_sql('verified_purchase_rate', (0.5, 0.8), b.THREE)} AS verified_signal,
  coalesce({price_bucket_sql('gap')}, {default}) AS relative_price_bucket,
  CASE WHEN gap IS NOT NULL THEN 'peer_price' WHEN {default} IS NOT NULL THEN 'default' END AS relative_price_bucket_source,
  gap AS price_gap_vs_peer,
  {steps_sql('warranty_months', (0, 12), b.THREE, '<=')} AS warranty_signal,
  {steps_sql('return_window_days', (7, 30), b.THREE, '<=')} AS return_signal
FROM (SELECT *, {gap} AS gap FROM {source}) g"""


def _values_sql(states, *columns) -> str:
    rows = ", ".join(
        "(" + ", ".join([f"'{s}'", *[repr(float(c[i])) for c in columns]]) + ")" for i, s in enumerate(states)
    )
    return f"(VALUES {rows})"


def _marginal_sql(node: str, states, prior, weight) -> str:
    """State probabilities per evidence value: (ev, st, p, x)."""
    return f"""SELECT e.ev, s.st, CASE WHEN e.ev = '-' THEN s.prior WHEN e.ev = s.st THEN 1.0 ELSE 0.0 END AS p, s.x
FROM {_values_sql(states, prior, weight)} s(st, prior, x),
  (SELECT unnest({views.quoted(list(states) + ['-'])}) AS ev) e"""


def _kernel_sql(x: str) -> str:
    at = f"least(2.0, greatest(0.0, 2 * ({x})))"
    return f"exp(-1.4 * power({at} - k.i, 2)) / (exp(-1.4 * power({at}, 2)) + exp(-1.4 * power({at} - 1, 2)) + exp(-1.4 * power({at} - 2, 2)))"


def posterior_ctes() -> str:
    """CTEs of the network: n_trust, n_review, n_quality, n_service, n_value by evidence state."""
    five, half = (0, 0.25, 0.5, 0.75, 1), (0, 0.5, 1)
    p, b = terms.PRIORS, buckets
    nodes = {
        "e_trust": (b.TRUST_STATES, p["trust"], five), "e_pol": (b.POLARITY_STATES, p["polarity"], five),
        "e_str": (b.STRENGTH_STATES, p["strength"], half), "e_vol": (b.THREE, p["volume"], half),
        "e_rat": (b.THREE, p["rating"], half), "e_ver": (b.THREE, p["verified"], half),
        "e_price": (b.PRICE_STATES, p["price"], terms.PRICE_LEVELS),
        "e_war": (b.THREE, p["warranty"], half), "e_ret": (b.THREE, p["returns"], half),
    }
    ctes = [f"{n} AS MATERIALIZED ({_marginal_sql(n, *v)})" for n, v in nodes.items()]
    ctes.append("k AS (SELECT unnest([0, 1, 2]) AS i)")
    ctes.append(f"n_trust AS MATERIALIZED (SELECT a.ev, k.i, sum(a.p * {_kernel_sql('a.x')}) AS p FROM e_trust a, k GROUP BY ALL)")
    ctes.append(
        f"n_review AS MATERIALIZED (SELECT a.ev AS ev1, b.ev AS ev2, c.ev AS ev3, k.i, sum(a.p * b.p * c.p * {_kernel_sql('0.8 * a.x + 0.12 * b.x + 0.08 * c.x')}) AS p "
        "FROM e_pol a, e_str b, e_vol c, k GROUP BY ALL)"
    )
    ctes.append(
        f"n_service AS MATERIALIZED (SELECT a.ev AS ev1, b.ev AS ev2, k.i, sum(a.p * b.p * {_kernel_sql('0.55 * a.x + 0.45 * b.x')}) AS p FROM e_war a, e_ret b, k GROUP BY ALL)"
    )
    quality = f"{terms.QUALITY_WEIGHTS['trust']} * t.i / 2 + {terms.QUALITY_WEIGHTS['review']} * r.i / 2 + 0.12 * a.x + {terms.QUALITY_WEIGHTS['verified']} * b.x"
    ctes.append(
        f"c_quality AS MATERIALIZED (SELECT t.i AS t, r.i AS r, a.ev AS ev1, b.ev AS ev2, k.i, sum(a.p * b.p * {_kernel_sql(quality)}) AS p "
        "FROM k t, k r, e_rat a, e_ver b, k GROUP BY ALL)"
    )
    ctes.append(
        "c_value AS MATERIALIZED (SELECT q.i AS q, a.ev AS ev1, s.i AS s, sum(a.p / (1 + exp(-5 * (0.6 * q.i / 2 + 0.35 * a.x + 0.05 * s.i / 2 - 0.5)))) AS p "
        "FROM k q, k s, e_price a GROUP BY ALL)"
    )
    return ",\n".join(ctes)


def posterior_sql(source: str, key: str, prefix: str = "") -> str:
    """CTE texts: {prefix}post(key, good_value_probability, component columns) for an evidence table."""
    ev = {c: f"coalesce(e.{c}, '-')" for c in V.EVIDENCE}
    states = "CASE WHEN {0}0 >= {0}1 AND {0}0 >= {0}2 THEN 'low' WHEN {0}1 >= {0}2 THEN 'medium' ELSE 'high' END"
    return f"""{prefix}pt AS MATERIALIZED (SELECT e.{key} AS id, n.i, n.p FROM {source} e JOIN n_trust n ON n.ev = {ev['trust_signal']}),
{prefix}pr AS MATERIALIZED (SELECT e.{key} AS id, n.i, n.p FROM {source} e JOIN n_review n ON n.ev1 = {ev['review_polarity']} AND n.ev2 = {ev['review_strength']} AND n.ev3 = {ev['review_volume']}),
{prefix}ps AS MATERIALIZED (SELECT e.{key} AS id, n.i, n.p FROM {source} e JOIN n_service n ON n.ev1 = {ev['warranty_signal']} AND n.ev2 = {ev['return_signal']}),
{prefix}pq AS MATERIALIZED (SELECT e.{key} AS id, c.i, sum(t.p * r.p * c.p) AS p FROM {source} e JOIN {prefix}pt t ON t.id = e.{key} JOIN {prefix}pr r ON r.id = e.{key}
  JOIN c_quality c ON c.t = t.i AND c.r = r.i AND c.ev1 = {ev['rating_signal']} AND c.ev2 = {ev['verified_signal']} GROUP BY ALL),
{prefix}pg AS MATERIALIZED (SELECT e.{key} AS id, sum(q.p * s.p * c.p) AS g FROM {source} e JOIN {prefix}pq q ON q.id = e.{key} JOIN {prefix}ps s ON s.id = e.{key}
  JOIN c_value c ON c.q = q.i AND c.s = s.i AND c.ev1 = {ev['relative_price_bucket']} GROUP BY ALL),
{prefix}wide AS MATERIALIZED (SELECT id, """ + ", ".join(
        f"max(CASE WHEN n = '{n}' AND i = {i} THEN p END) AS {n}{i}" for n in "trqs" for i in range(3)
    ) + f""" FROM (SELECT 't' AS n, * FROM {prefix}pt UNION ALL SELECT 'r', * FROM {prefix}pr UNION ALL SELECT 'q', * FROM {prefix}pq UNION ALL SELECT 's', * FROM {prefix}ps) u GROUP BY id),
{prefix}post AS MATERIALIZED (SELECT w.id AS {key}, g.g AS good_value_probability, """ + ", ".join(
        f"{v}{i} AS {n}_{s}"
        for v, n in (("t", "trustworthiness"), ("r", "review_evidence"), ("q", "product_quality"), ("s", "service_support"))
        for i, s in enumerate(("low", "medium", "high"))
    ) + ", " + ", ".join(
        states.format(v) + f" AS {n}_state"
        for v, n in (("t", "trustworthiness"), ("r", "review_evidence"), ("q", "product_quality"), ("s", "service_support"))
    ) + f" FROM {prefix}wide w JOIN {prefix}pg g USING (id))"


def grams_sql(text: str) -> str:
    """List of prefixed word and character n-grams of a lower-cased text expression."""
    stop = views.quoted(terms.ENGLISH_STOP)
    words = f"list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({stop}, w))"
    pieces = f"list_filter(string_split(trim(regexp_replace({text}, '{SPACE_SQL}+', ' ', 'g')), ' '), lambda w: w <> '')"
    chars = " || ".join(
        f"flatten(list_transform(list_filter({pieces}, lambda w: length(w) + 2 >= {n}), lambda w: list_transform(range(1, length(w) + 2 - {n} + 2), lambda i: 'c:' || substr(' ' || w || ' ', i, {n}))))"
        for n in (3, 4, 5)
    )
    return (
        f"list_transform({words}, lambda w: 'w:' || w) || "
        f"list_transform(list_zip({words}[1:-2], {words}[2:]), lambda z: 'w:' || z[1] || ' ' || z[2]) || {chars}"
    )


SPACE_SQL = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"

views.SQL["peers"] = (("split_products",), "SELECT * FROM split_products WHERE split = 'train' AND price IS NOT NULL")
views.SQL["asks"] = (("split_products",), "SELECT * FROM split_products WHERE split = 'test'")


def tf_sql(source: str, key: str, text: str) -> str:
    return (
        f"SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({grams_sql('t')}) AS term "
        f"FROM (SELECT {key}, lower({text}) AS t FROM {source}) x) y GROUP BY ALL"
    )


views.SQL["peer_tf"] = (("peers",), tf_sql("peers", "parent_asin", "product_document"))
views.SQL["vocab"] = (
    ("peer_tf", "peers"),
    """SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (
  SELECT term, df, n, row_number() OVER (PARTITION BY substr(term, 1, 1) ORDER BY total DESC, term) AS r
  FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM peer_tf GROUP BY term) s, (SELECT count(*) AS n FROM peers) c
  WHERE df >= 2) v WHERE r <= CASE WHEN substr(term, 1, 1) = 'w' THEN 40000 ELSE 30000 END""",
)


def vec_sql(tf: str, key: str) -> str:
    return f"""SELECT {key}, term, w / norm / sqrt(count(DISTINCT substr(term, 1, 1)) OVER (PARTITION BY {key})) AS w FROM (
  SELECT {key}, t.term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {key}, substr(t.term, 1, 1))) AS norm
  FROM {tf} t JOIN vocab v ON v.term = t.term) z"""


views.SQL["peer_vec"] = (("peer_tf", "vocab"), vec_sql("peer_tf", "parent_asin"))
views.SQL["ask_tf"] = (("asks",), tf_sql("asks", "parent_asin", "product_document"))
views.SQL["ask_vec"] = (("ask_tf", "vocab"), vec_sql("ask_tf", "parent_asin"))


def found_sql(asks: str, ask_vec: str, k: int, floor: float) -> str:
    """Brute-force top k over every pair that shares a term."""
    return f"""SELECT query_id, CAST(r AS INT) AS rank, parent_asin, price, similarity, scope AS retrieval_listing_kind, title, store, main_category FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, parent_asin) AS r FROM (
    SELECT a.parent_asin AS query_id, a.scope, p.parent_asin, p.price, p.title, p.store, p.main_category,
      round(least(sum(x.w * y.w), 1.0), 8) AS similarity
    FROM (SELECT *, CASE WHEN listing_kind IN (SELECT listing_kind FROM peers WHERE listing_kind <> 'other' GROUP BY 1 HAVING count(*) >= 2)
        THEN listing_kind ELSE '' END AS scope FROM {asks}) a
      JOIN {ask_vec} x ON x.parent_asin = a.parent_asin
      JOIN peer_vec y ON y.term = x.term
      JOIN peers p ON p.parent_asin = y.parent_asin AND (a.scope = '' OR p.listing_kind = a.scope)
    WHERE a.parent_asin <> p.parent_asin
    GROUP BY ALL) s WHERE similarity >= {floor}) q WHERE r <= {k}"""


views.SQL["found"] = (("asks", "ask_vec", "peers", "peer_vec"), found_sql("asks", "ask_vec", 20, 0.12))
views.SQL["context"] = (
    ("asks", "found"),
    """SELECT a.*, f.peer_price, coalesce(f.n, 0) AS neighbor_count, coalesce(f.s, 0) AS average_neighbor_similarity,
  coalesce(f.scope, '') AS retrieval_listing_kind
FROM asks a LEFT JOIN (SELECT query_id, sum(price * similarity) / sum(similarity) AS peer_price, count(*) AS n, avg(similarity) AS s,
  max(retrieval_listing_kind) AS scope FROM found GROUP BY 1) f ON f.query_id = a.parent_asin""",
)
views.SQL["worth"] = (
    ("context", "peers"),
    """SELECT *, CASE WHEN confidence_score < 0.35 THEN 'insufficient_evidence' WHEN worth_buying_score >= 0.62 THEN 'worth_buying'
  WHEN worth_buying_score >= 0.48 THEN 'consider' ELSE 'skip' END AS verdict
FROM (SELECT *, least(1.0, greatest(0.0, 0.45 * price_alignment_score + 0.4 * (0.55 * bayesian_rating_score + 0.45 * review_quality_score)
    + 0.15 * confidence_score - CASE WHEN average_rating < 3.6 THEN (3.6 - average_rating) * 0.22 ELSE 0 END)) AS worth_buying_score
  FROM (SELECT c.*, gap AS price_gap_vs_peer,
      CASE WHEN gap IS NULL THEN 0.5 ELSE 0.5 * (1 + tanh(gap / 0.2)) END AS price_alignment_score,
      least(1.0, greatest(0.0, CASE WHEN average_rating IS NULL THEN m / 5 ELSE (20 * m + rating_number * average_rating) / (20 + rating_number) / 5 END)) AS bayesian_rating_score,
      0.45 * least(1.0, greatest(0.0, coalesce(avg_review_rating, average_rating, m) / 5)) + 0.25 * coalesce(verified_purchase_rate, 0.5)
        + 0.15 * (1 - exp(-helpful_vote_total / 5.0)) + 0.15 * (1 - exp(-review_count / 50.0)) AS review_quality_score,
      0.45 * least(1.0, neighbor_count / 20.0) + 0.35 * average_neighbor_similarity + 0.2 * (1 - exp(-review_count / 50.0)) AS confidence_score
    FROM (SELECT *, CASE WHEN peer_price > 0 THEN (peer_price - price) / peer_price END AS gap FROM context) c,
      (SELECT coalesce(avg(average_rating), 3.8) AS m FROM peers) g) a) b""",
)
views.SQL["value_inputs"] = (
    ("products",),
    """SELECT parent_asin, trust_probability, ewom_score_0_to_100, ewom_magnitude_0_to_100, average_rating,
  coalesce(rating_number, review_count) AS rating_count, verified_purchase_rate, price,
  CASE WHEN k % 7 <> 0 THEN 600.0 + (k * 37) % 700 END AS peer_price,
  CASE WHEN k % 4 <> 0 THEN (k % 5) * 6.0 END AS warranty_months,
  CASE WHEN k % 3 <> 0 THEN (k % 6) * 7.0 END AS return_window_days
FROM (SELECT *, CAST(parent_asin AS INT) AS k FROM products) p""",
)


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_document = (
    "trim(concat_ws(' ', nullif(title, ''), nullif(store, ''), nullif(main_category, ''), {lists}, "
    "'Brand ' || detail_brand || ' Size ' || detail_size))"
)
_lists = ", ".join(
    f"nullif(array_to_string(list_filter(list_transform({c}, lambda v: trim(v)), lambda v: v <> ''), ' '), '')"
    for c in ("categories", "features", "description")
)
_meta_text = (
    "concat_ws(' ', nullif(title, ''), nullif(main_category, ''), array_to_string(categories, ' '), array_to_string(features, ' '), "
    "array_to_string(description, ' '), 'Brand ' || detail_brand || ' Size ' || detail_size)"
)

ORACLES = {
    "review_signals": sql(["signals"], "SELECT parent_asin, review_count, verified_count, CAST(helpful_vote_total AS DOUBLE) AS helpful_vote_total, rating_sum FROM signals"),
    "product_proxy_signals": sql(
        ["products"],
        "SELECT parent_asin, title, store, main_category, listing_kind, rating_number, review_count, CAST(helpful_vote_total AS BIGINT) AS helpful_vote_total, "
        + r6("price", "average_rating", "verified_purchase_rate", "helpful_vote_avg", "avg_review_rating", "trust_probability", "ewom_score_0_to_100", "ewom_magnitude_0_to_100")
        + " FROM products",
    ),
    "product_documents": sql(["meta"], f"SELECT parent_asin, {_document.format(lists=_lists)} AS product_document FROM meta"),
    "listing_kind": sql(
        ["meta"],
        f"""SELECT parent_asin, {kind_sql('a', 'b', 'c')} AS kind FROM (
SELECT parent_asin, {key_sql('title')} AS a, {key_sql("array_to_string(categories, ' ')")} AS b, {key_sql(_meta_text)} AS c FROM meta) t""",
    ),
    "hash_split": sql(["split_products"], "SELECT parent_asin, split FROM split_products"),
    "split_summary": sql(
        ["split_products"],
        """SELECT coalesce(split, 'all') AS split, count(*) AS rows, count(price) AS rows_with_price,
count(*) FILTER (review_count > 0) AS rows_with_reviews FROM split_products GROUP BY ROLLUP (split)""",
    ),
    "normalised_catalog": sql(
        ["meta"],
        f"""SELECT parent_asin, title, product_document, CASE WHEN listing_kind = 'other' THEN {kind_sql('a', "''", 'c')} ELSE listing_kind END AS listing_kind,
round(price, 6) AS price, round(average_rating, 6) AS average_rating,
CAST(CASE WHEN rating_number % 2 = 0 THEN rating_number ELSE 0 END AS BIGINT) AS review_count
FROM (SELECT *, {key_sql('title')} AS a, {key_sql("title || ' ' || main_category || ' ' || product_document")} AS c FROM meta) m""",
    ),
    "priced_catalog": sql(["products"], "SELECT parent_asin, listing_kind, price FROM products WHERE price IS NOT NULL AND listing_kind IN ('device', 'cable')"),
    "global_rating_mean": sql(["peers"], "SELECT round(coalesce(avg(average_rating), 3.8), 6) AS global_rating_mean FROM peers"),
    "term_stats": f"""WITH toks AS (SELECT doc_id, unnest(list_transform(w, lambda x: x) || list_transform(list_zip(w[1:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) AS term
  FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({views.quoted(terms.ENGLISH_STOP)}, x)) AS w FROM documents) d),
stats AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM toks GROUP BY term)
SELECT term, df, round(ln((1.0 + n) / (1.0 + df)) + 1.0, 6) AS idf FROM stats, (SELECT count(*) AS n FROM documents) c
WHERE df >= 2 AND df <= 0.95 * n ORDER BY total DESC, term LIMIT 40000""",
    "tfidf_vectors": sql(["peer_vec", "peers"], "SELECT DISTINCT lower(p.product_document) AS text, term, round(w, 6) AS weight FROM peer_vec v JOIN peers p USING (parent_asin)"),
    "topk_similar": sql(["found"], "SELECT query_id, rank, parent_asin, round(price, 6) AS price, similarity, retrieval_listing_kind FROM found"),
    "peer_price": sql(["context"], "SELECT parent_asin, neighbor_count, retrieval_listing_kind, " + r6("peer_price", "average_neighbor_similarity") + " FROM context"),
    "worth_buying": sql(
        ["worth"],
        "SELECT parent_asin, title, listing_kind, retrieval_listing_kind, verdict, review_count, neighbor_count, "
        + r6("price", "average_rating", "rating_number", "peer_price", "price_gap_vs_peer", "average_neighbor_similarity", "price_alignment_score", "bayesian_rating_score", "review_quality_score", "confidence_score", "worth_buying_score")
        + " FROM worth",
    ),
    "score_quantiles": sql(
        ["worth"],
        "SELECT count(*) AS rows_scored, "
        + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}_rows" for v in ("worth_buying", "consider", "skip", "insufficient_evidence"))
        + ", " + ", ".join(f"round(quantile_cont(worth_buying_score, {q}), 6) AS {n}" for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))
        + " FROM worth",
    ),
    "combined_value": sql(
        ["worth"],
        f"""WITH {posterior_ctes()},
inputs AS (SELECT *, coalesce(rating_number, review_count) AS rating_count, CAST(NULL AS DOUBLE) AS warranty_months, CAST(NULL AS DOUBLE) AS return_window_days
  FROM (SELECT * EXCLUDE (price_gap_vs_peer, gap) FROM worth) w),
ev AS MATERIALIZED ({evidence_sql('inputs')}),
{posterior_sql('ev', 'parent_asin')}
SELECT parent_asin, title, review_count, verdict AS retrieval_verdict,
  {r6('price', 'peer_price', 'price_gap_vs_peer', 'average_rating', 'rating_number', 'verified_purchase_rate', 'trust_probability', 'ewom_score_0_to_100', 'ewom_magnitude_0_to_100')},
  round(confidence_score, 6) AS retrieval_confidence_score, round(worth_buying_score, 6) AS retrieval_worth_buying_score,
  round(good_value_probability, 6) AS combined_good_value_probability,
  CASE WHEN confidence_score < 0.35 THEN 'insufficient_evidence' WHEN good_value_probability >= 0.5 THEN 'good_value' ELSE 'not_good_value' END AS combined_prediction,
  trust_signal AS bayesian_evidence_trust_signal, review_polarity AS bayesian_evidence_review_polarity, review_strength AS bayesian_evidence_review_strength,
  rating_signal AS bayesian_evidence_rating_signal, review_volume AS bayesian_evidence_review_volume, verified_signal AS bayesian_evidence_verified_signal,
  relative_price_bucket AS bayesian_evidence_relative_price_bucket, trustworthiness_state AS bayesian_component_trustworthiness,
  review_evidence_state AS bayesian_component_review_evidence, product_quality_state AS bayesian_component_product_quality,
  service_support_state AS bayesian_component_service_support
FROM ev JOIN post USING (parent_asin)""",
    ),
    "value_evidence": sql(
        ["value_inputs"],
        f"WITH ev AS ({evidence_sql('value_inputs', chr(39) + 'fair' + chr(39))}) SELECT parent_asin, " + ", ".join(V.EVIDENCE)
        + ", relative_price_bucket_source, round(price_gap_vs_peer, 6) AS price_gap_vs_peer FROM ev",
    ),
    "good_value_posterior": sql(
        ["value_inputs"],
        f"WITH {posterior_ctes()}, ev AS MATERIALIZED ({evidence_sql('value_inputs')}), {posterior_sql('ev', 'parent_asin')} SELECT parent_asin, "
        + r6("good_value_probability", *[c for c in POSTERIOR_COLUMNS if not c.endswith("state")])
        + ", " + ", ".join(c for c in POSTERIOR_COLUMNS if c.endswith("state")) + " FROM post",
    ),
}

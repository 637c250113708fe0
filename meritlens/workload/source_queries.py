"""Source, sink and profile queries over files that Spark writes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms
from ..operators import profile as P
from ..operators import retrieval as R
from ..operators import value as V
from ..operators.catalog import hash_split
from ..session import ensure_checkpoint_dir
from ..sources import readers as S
from ..sources import writers as K
from . import views
from .catalog_queries import _matched, key_sql, kind_sql, products
from .review_queries import clean_sql, label_log, unit_sql
from .views import rounded, sql


def _folder(spark, name):
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def review_source(spark, sf):
    li = views.table(spark, sf, "lineitem")
    path = _folder(spark, "reviews")
    k = F.col("l_orderkey")
    li.select(
        F.col("l_partkey").cast("string").alias("parent_asin"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("user_id"),
        F.when(k % 3 == 0, F.col("l_quantity").cast("int")).alias("helpful_votes"),
        F.when(k % 3 == 1, F.col("l_quantity").cast("string")).alias("helpful_vote"),
        F.when(k % 2 == 0, F.unix_timestamp("l_shipdate")).alias("timestamp"),
        F.when(k % 2 == 1, F.unix_timestamp("l_shipdate") + 1).alias("sort_timestamp"),
    ).write.option("compression", "gzip").json(path)
    return S.read_reviews(spark, path).select("parent_asin", "user_id", "helpful_votes", "timestamp")


def split_roundtrip(spark, sf):
    rows = products(spark, sf).withColumn("split", hash_split(F.col("parent_asin")))
    path = _folder(spark, "splits")
    K.write_splits(rows, path)
    back = S.read_prepared_catalog(spark, f"{path}/split=test")
    return rounded(back.select("parent_asin", "title", "listing_kind", "price", "review_count", "trust_probability"))


def score_roundtrip(spark, sf):
    _, _, context, mean = _matched(spark, sf)
    path = _folder(spark, "scores")
    K.write_scores(V.worth_buying(context, mean).select("parent_asin", "verdict"), path)
    return S.read_csv(spark, path)


def label_log_roundtrip(spark, sf):
    path = _folder(spark, "labels")
    log = label_log(spark, sf)
    K.append_labels(log.where("ingest_seq < 1000000000000"), path, 1)
    K.append_labels(log.where("ingest_seq >= 1000000000000"), path, 2)
    return K.read_labels(spark, path).select("record_id", "ingest_seq")


def labelled_source(spark, sf):
    d = views.table(spark, sf, "documents")
    path = _folder(spark, "csv")
    k = F.col("doc_id")
    d.select(
        "doc_id", F.when(k % 6 != 0, F.col("text")).otherwise(" ").alias("text_"),
        F.when(k % 3 == 0, " or ").when(k % 3 == 1, "CG").otherwise("??").alias("label"),
    ).write.option("header", True).option("escape", '"').csv(path)
    out = S.labelled_reviews(S.read_csv(spark, path, multi_line=True))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "label_truth", F.length("text").alias("n"))


def truth_source(spark, sf):
    d = views.table(spark, sf, "documents")
    word = F.element_at(F.array(*[F.lit(w) for w in (*terms.TRUTH_WORDS, "half-true")]), (F.col("doc_id") % 10 + 1).cast("int"))
    raw = d.select("doc_id", F.col("text").alias("Content"), F.upper(word).alias("Truth"))
    return S.truth_labelled(raw, "doc_id").select("doc_id", "label_truth")


def prepared_review_source(spark, sf):
    """Prepared reviews of a file with cut lines, other JSON values, blank lines, wrong types and rows without any label."""
    li = views.table(spark, sf, "lineitem")
    path = _folder(spark, "prepared")
    m, part = F.col("l_orderkey") % 40, F.col("l_linenumber") % 3
    user = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    votes = F.col("l_quantity").cast("int").cast("string")
    whole = F.to_json(
        F.struct(
            user.alias("user_id"), F.when(part == 0, votes).alias("helpful_votes"), F.when(part == 1, votes).alias("helpful_vote"),
            F.when(m != 5, F.col("l_linenumber") % 2).alias("label"),
        )
    )
    li.select(
        F.when(m == 0, F.concat(F.lit('{"user_id":"'), user)).when(m == 1, F.concat(F.lit('["'), user, F.lit('"]'))).when(m == 2, F.lit(" "))
        .when(m == 3, F.concat(F.lit('{"user_id":"'), user, F.lit('","label":"many"}'))).otherwise(whole).alias("value")
    ).write.text(path)
    rows, rejects = S.read_prepared_reviews_with_rejects(spark, path, 25)
    return rows.select("user_id", "helpful_votes", "label").unionByName(rejects.select("record"), allowMissingColumns=True)


def truth_file_source(spark, sf):
    """Labelled texts through each of the four file formats."""
    d = views.table(spark, sf, "documents")
    path, k = _folder(spark, "truth"), F.col("doc_id")
    word = F.element_at(F.array(*[F.lit(w) for w in (*terms.TRUTH_WORDS, "half-true")]), (k % 10 + 1).cast("int"))
    raw = d.select("doc_id", F.col("text").alias("Content"), F.upper(word).alias("Truth"))
    for part, (kind, sep) in enumerate((("csv", ","), ("tsv", "\t"))):
        raw.where(k % 4 == part).write.csv(
            f"{path}.{kind}", sep=sep, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    raw.where(k % 4 == 2).write.json(f"{path}.jsonl")
    # One array of rows per file.
    arrays = raw.where(k % 4 == 3).groupBy(F.floor(k / 2000)).agg(F.to_json(F.collect_list(F.struct("doc_id", "Content", "Truth"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}.json")
    out = None
    for kind in ("csv", "tsv", "jsonl", "json"):
        part = S.read_truth_labelled(spark, f"{path}.{kind}", "doc_id").select(
            k.cast("bigint").alias("doc_id"), "label_truth", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.lit(kind).alias("format")
        )
        out = part if out is None else out.unionByName(part)
    return out


def product_file_source(spark, sf):
    """Products from a header CSV with line breaks inside fields."""
    path, k = _folder(spark, "products"), F.col("p_partkey")
    views.table(spark, sf, "part").select(
        k.alias("PRODUCT_ID"), F.when(k % 4 != 0, F.col("p_name")).alias("TITLE"),
        F.when(k % 3 == 0, F.concat("p_type", F.lit('\n"'), "p_brand", F.lit('"'))).alias("BULLET_POINTS"), F.lit(None).cast("string").alias("DESCRIPTION"),
    ).write.csv(path, header=True, escape='"')
    return S.read_products(spark, path, 1 << 40).select("record_id", "text")


def csv_source_rejects(spark, sf):
    """Records of a CSV without header, those with too few or too many fields apart."""
    path, k = _folder(spark, "customers"), F.col("c_custkey")
    views.table(spark, sf, "customer").select(
        F.when(k % 25 == 0, F.concat_ws(",", "c_custkey", "c_nationkey"))
        .when(k % 25 == 1, F.concat_ws(",", "c_custkey", "c_nationkey", "c_name", F.lit("more")))
        .otherwise(F.concat_ws(",", "c_custkey", "c_nationkey", F.concat(F.lit('"'), "c_name", F.lit(', ""quoted"""')))).alias("value")
    ).write.text(path)
    rows, rejects = S.read_csv_rows(spark, path, ["key", "nation key", "name"], header=False)
    kept = rows.select(F.col("key").cast("bigint").alias("key"), F.col("nation key").cast("int").alias("nation_key"), "name")
    return kept.unionByName(rejects.select("record"), allowMissingColumns=True)


def label_collapse(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 6).alias("label"))
    parts = {n: d.where(F.col("doc_id") % 3 == i) for i, n in enumerate(("train", "validation", "test"))}
    return S.collapsed_labels(parts).select("doc_id", "split", "label_truth")


def product_source(spark, sf):
    p = views.table(spark, sf, "part")
    raw = p.select(
        F.col("p_partkey").alias("PRODUCT_ID"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("TITLE"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("BULLET_POINTS"), F.lit(None).cast("string").alias("DESCRIPTION"),
    )
    return S.product_rows(raw, 500).select("record_id", "text")


def polarity_source(spark, sf):
    d = views.table(spark, sf, "documents")
    k = F.col("doc_id")
    raw = d.select("doc_id", "text", (k % 2).alias("label"), F.when(k % 3 == 0, "given").alias("label_text"))
    return S.polarity_rows(raw, "doc_id", 300).select("doc_id", "label", "label_text")


def seller_cases(spark, sf):
    c = views.table(spark, sf, "conversations")
    path = _folder(spark, "cases")
    cases = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    cases.select(
        F.lit("seller_feedback_texts").alias("field_name"),
        F.array(
            F.struct(
                F.col("conv_id").cast("string").alias("case_id"),
                F.concat(F.lit("s"), F.col("conv_id")).alias("seller_id"),
                F.when(F.col("conv_id") % 5 != 0, F.transform("t", lambda x: x["text"])).alias("seller_feedback_texts"),
            )
        ).alias("cases"),
    ).write.json(path)
    texts, empty = S.read_seller_cases(spark, path, multi_line=False)
    return texts.unionByName(empty, allowMissingColumns=True)


def column_profile(spark, sf):
    out = P.column_profile(views.table(spark, sf, "events"))
    return out.select(
        "column", "dtype", "non_null_count", "null_count", "null_pct", "unique_count", "sample_values",
        *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")],
    )


def _terms(spark, sf, n):
    d = views.table(spark, sf, "documents")
    return P.top_terms(d.select((F.col("doc_id") % 2).alias("label"), "text"), "label", "text", n)


def top_terms(spark, sf):
    return _terms(spark, sf, 1).select("label", "term", "count", "rank")


def top_bigrams(spark, sf):
    return _terms(spark, sf, 2).select("label", "term", "count", "rank")


def embedding_document(spark, sf):
    d = views.table(spark, sf, "documents")
    return d.select(
        "doc_id",
        R.embedding_document(F.concat(F.lit(" ["), F.col("source"), F.lit("] ")), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("text"))).alias("document_text"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        review_source, split_roundtrip, score_roundtrip, label_log_roundtrip, labelled_source, truth_source, label_collapse,
        prepared_review_source, truth_file_source, product_file_source, csv_source_rejects,
        product_source, polarity_source, seller_cases, column_profile, top_terms, top_bigrams, embedding_document,
    )
}


def _terms_sql(n: int) -> str:
    stop = views.quoted(terms.ENGLISH_STOP)
    w = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({stop}, x))"
    gram = "w" if n == 1 else "list_transform(list_zip(w[1:-2], w[2:]), lambda z: z[1] || ' ' || z[2])"
    return f"""SELECT label, term, count, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY count DESC, term) AS r FROM (
SELECT label, term, count(*) AS count, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, doc_id % 2 AS label, unnest({gram}) AS term FROM (SELECT doc_id, {w} AS w FROM documents) a) b GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5) c) d WHERE r <= 15"""


def _whole_profile_sql() -> str:
    cols = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}
    parts = []
    for c, t in cols.items():
        num = (
            f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
            + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {q}), 4) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75))
            + f", round(CAST(max({c}) AS DOUBLE), 4) AS max"
            if t in ("bigint", "double")
            else ", ".join(f"CAST(NULL AS DOUBLE) AS {x}" for x in ("mean", "std", "min", "p25", "p50", "p75", "max"))
        )
        sample = f"(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM events WHERE {c} IS NOT NULL ORDER BY v LIMIT 3) s)"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct, "
            f"count(DISTINCT {c}) AS unique_count, {sample} AS sample_values, {num} FROM events"
        )
    return " UNION ALL ".join(parts)


_words = [*terms.TRUTH_WORDS, "half-true"]
ORACLES = {
    "review_source": """SELECT CAST(l_partkey AS VARCHAR) AS parent_asin, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS user_id,
CASE WHEN l_orderkey % 3 < 2 THEN CAST(trunc(l_quantity) AS BIGINT) ELSE 0 END AS helpful_votes, CAST(epoch(l_shipdate) AS BIGINT) + l_orderkey % 2 AS timestamp FROM lineitem""",
    "split_roundtrip": sql(
        ["split_products"],
        f"""SELECT parent_asin, title, CASE WHEN listing_kind = 'other' THEN {kind_sql('a', 'b', 'c')} ELSE listing_kind END AS listing_kind, round(price, 6) AS price, review_count,
round(trust_probability, 6) AS trust_probability FROM (SELECT *, {key_sql('title')} AS a, {key_sql("array_to_string(categories, ' ')")} AS b,
  {key_sql("concat_ws(' ', title, main_category, array_to_string(categories, ' '), product_document)")} AS c FROM split_products WHERE split = 'test') p""",
    ),
    "score_roundtrip": sql(["worth"], "SELECT parent_asin, verdict FROM worth"),
    "label_log_roundtrip": sql(["latest"], "SELECT record_id, ingest_seq FROM latest"),
    "labelled_source": f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1 ELSE 0 END AS label_truth, CAST(length({clean_sql('text')}) AS INT) AS n FROM documents WHERE doc_id % 3 < 2 AND doc_id % 6 <> 0 AND {clean_sql('text')} <> ''",
    "truth_source": f"SELECT doc_id, CAST(CASE WHEN doc_id % 10 < 4 THEN 1 ELSE 0 END AS INT) AS label_truth FROM documents WHERE doc_id % 10 < {len(terms.TRUTH_WORDS)}",
    "prepared_review_source": """WITH r AS (SELECT l_orderkey % 40 AS m, l_linenumber, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
  CASE WHEN l_linenumber % 3 < 2 THEN CAST(trunc(l_quantity) AS BIGINT) END AS votes FROM lineitem), s AS (SELECT *, m IN (0, 1, 3) OR (m = 5 AND votes IS NULL) AS bad FROM r WHERE m <> 2)
SELECT CASE WHEN NOT bad THEN id END AS user_id, CASE WHEN NOT bad THEN votes END AS helpful_votes,
  CASE WHEN NOT bad THEN coalesce(CAST(votes >= 25 AS INT), CAST(l_linenumber % 2 AS INT)) END AS label,
  CASE WHEN bad THEN CASE m WHEN 0 THEN '{"user_id":"' || id WHEN 1 THEN '["' || id || '"]' WHEN 3 THEN '{"user_id":"' || id || '","label":"many"}' ELSE '{"user_id":"' || id || '"}' END END AS record FROM s""",
    "truth_file_source": f"SELECT doc_id, CAST(CASE WHEN doc_id % 10 < 4 THEN 1 ELSE 0 END AS INT) AS label_truth, CAST(coalesce(length(text), 0) AS INT) AS n, ['csv', 'tsv', 'jsonl', 'json'][doc_id % 4 + 1] AS format FROM documents WHERE doc_id % 10 < {len(terms.TRUTH_WORDS)}",
    "product_file_source": f"""SELECT CAST(p_partkey AS VARCHAR) AS record_id, concat_ws(chr(10), CASE WHEN p_partkey % 4 <> 0 THEN 'Title: ' || p_name END,
CASE WHEN p_partkey % 3 = 0 THEN 'Bullet Points: ' || {clean_sql("p_type || ' ' || chr(34) || p_brand || chr(34)")} END) AS text FROM part WHERE p_partkey % 4 <> 0 OR p_partkey % 3 = 0""",
    "csv_source_rejects": """SELECT CASE WHEN c_custkey % 25 > 1 THEN c_custkey END AS key, CASE WHEN c_custkey % 25 > 1 THEN CAST(c_nationkey AS INT) END AS nation_key,
CASE WHEN c_custkey % 25 > 1 THEN c_name || ', "quoted"' END AS name,
CASE c_custkey % 25 WHEN 0 THEN c_custkey || ',' || c_nationkey WHEN 1 THEN c_custkey || ',' || c_nationkey || ',' || c_name || ',more' END AS record FROM customer""",
    "label_collapse": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, CAST(CASE WHEN doc_id % 6 < 3 THEN 0 ELSE 1 END AS INT) AS label_truth FROM documents WHERE doc_id % 6 <> 3",
    "product_source": f"""SELECT CAST(p_partkey AS VARCHAR) AS record_id, concat_ws(chr(10), CASE WHEN p_partkey % 4 <> 0 THEN 'Title: ' || p_name END, CASE WHEN p_partkey % 3 = 0 THEN 'Bullet Points: ' || p_type END) AS text
FROM (SELECT *, row_number() OVER (ORDER BY {unit_sql('p_partkey')}, p_partkey) AS r FROM part) p WHERE r <= 500 AND (p_partkey % 4 <> 0 OR p_partkey % 3 = 0)""",
    "polarity_source": f"SELECT doc_id, doc_id % 2 AS label, CASE WHEN doc_id % 3 = 0 THEN 'given' WHEN doc_id % 2 = 1 THEN 'positive' ELSE 'negative' END AS label_text FROM (SELECT *, row_number() OVER (ORDER BY {unit_sql('doc_id')}, doc_id) AS r FROM documents) d WHERE r <= 300",
    "seller_cases": """SELECT CAST(conv_id AS VARCHAR) AS case_id, 's' || conv_id AS seller_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS seq, text FROM conversations WHERE conv_id % 5 <> 0
UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 's' || conv_id, NULL, NULL FROM conversations WHERE conv_id % 5 = 0""",
    "column_profile": _whole_profile_sql(),
    "top_terms": _terms_sql(1),
    "top_bigrams": _terms_sql(2),
    "embedding_document": f"SELECT doc_id, 'Title: ' || {clean_sql('source')} || ' | Bullet Points: ' || {clean_sql('lang')} || ' | Description: ' || CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace({clean_sql('text')}, '^\\[(.*)\\]$', '\\1')) ELSE '' END AS document_text FROM documents",
}

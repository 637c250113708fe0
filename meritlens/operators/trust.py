"""Trust labels: parsing annotations, the label log, the naive-Bayes graph and its scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.numbers import clamp, entropy_bits, finite, sigmoid, three_way
from ..functions.text import clean, labelled, null_if_blank
from .ordering import running_totals, with_piece

LEVELS = ("low", "medium", "high")
LABEL_BUCKET_OF = dict(zip(terms.TRUST_SCORES, terms.LABEL_BUCKETS))
GRAPH_BUCKET_OF = dict(zip(terms.TRUST_SCORES, terms.GRAPH_BUCKETS))


def product_text(title: Column, bullets: Column, description: Column) -> Column:
    return F.concat_ws(
        "\n",
        labelled("Title: ", clean(title)),
        labelled("Bullet Points: ", clean(bullets)),
        labelled("Description: ", clean(description)),
    )


def news_text(title: Column, statement: Column, body: Column, text: Column) -> Column:
    t, s, b = clean(title), clean(statement), clean(body)
    joined = F.concat_ws(
        "\n",
        labelled("Title: ", t),
        F.when((s != "") & (s != t), F.concat(F.lit("Statement: "), s)),
        labelled("Body: ", b),
    )
    return F.when(joined != "", joined).otherwise(clean(text))


def with_label_buckets(df: DataFrame) -> DataFrame:
    return df.withColumns({b: three_way(F.col(s)) for s, b in LABEL_BUCKET_OF.items()})


def with_graph_buckets(df: DataFrame) -> DataFrame:
    return df.withColumns({b: three_way(F.col(s)) for s, b in GRAPH_BUCKET_OF.items()})


def parse_annotations(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Scores, buckets and rationales from free annotation text that contains one JSON object.

    Keys are matched without case and by alias; missing secondary scores are derived from the
    core ones. A row without a usable object or core score gets ``error`` instead.
    """
    body = F.regexp_extract(F.col(raw), r"(?s)\{.*\}", 0)
    step = df.withColumn("_m", F.from_json(F.nullif(body, F.lit("")), "map<string,string>"))
    step = step.withColumn("_e", F.map_entries("_m"))

    def pick(names: Sequence[str]) -> Column:
        options = []
        for name in names:
            options.append(F.try_element_at(F.col("_m"), F.lit(name)))
            same = F.filter("_e", lambda e: F.lower(F.trim(e["key"])) == F.lit(name))
            options.append(F.try_element_at(same, F.lit(-1))["value"])
        return F.coalesce(*options)

    raws = {name: pick(aliases) for name, aliases in terms.SCORE_ALIASES.items()}
    step = step.withColumns({f"_t_{n}": c for n, c in raws.items()})
    numbers = {n: clamp(finite(F.col(f"_t_{n}"))) for n in raws}
    unreadable = F.lit(False)
    for n in raws:
        unreadable = unreadable | (F.col(f"_t_{n}").isNotNull() & finite(F.col(f"_t_{n}")).isNull())
    core = terms.TRUST_SCORES[:3]
    missing = F.lit(False)
    for n in core:
        missing = missing | F.col(f"_t_{n}").isNull()
    error = (
        F.when(F.col("_m").isNull(), "no_json_object")
        .when(missing, "missing_core_score")
        .when(unreadable, "unreadable_score")
    )
    step = step.withColumn("error", error).withColumns({f"_v_{n}": c for n, c in numbers.items()})
    v = {n: F.col(f"_v_{n}") for n in numbers}
    claim, signal, pressure = (v[n] for n in core)
    derived = {
        "competence_score": 0.6 * signal + 0.4 * claim,
        "benevolence_score": 0.5 * claim + 0.5 * (1.0 - pressure),
        "integrity_score": claim,
        "predictability_score": 0.5 * claim + 0.5 * signal,
        "overall_confidence": F.lit(0.5),
    }
    ok = F.col("error").isNull()
    scores = {n: F.when(ok, F.coalesce(v[n], derived[n]) if n in derived else v[n]) for n in numbers}
    notes = {
        n: F.when(ok, F.trim(F.coalesce(pick((n,)), F.lit(""))))
        for n in ("rationale_claim", "rationale_signal", "rationale_pressure")
    }
    out = with_label_buckets(step.withColumns(scores).withColumns(notes))
    return out.drop("_m", "_e", *[f"_t_{n}" for n in raws], *[f"_v_{n}" for n in numbers])


def is_valid_label() -> Column:
    """No error and every required score and bucket present."""
    valid = F.col("error").isNull()
    for name in (*terms.TRUST_SCORES, "overall_confidence", *terms.LABEL_BUCKETS):
        valid = valid & F.col(name).isNotNull()
    return valid


def latest_labels(log: DataFrame, last_then_valid: bool = False) -> DataFrame:
    """One valid record per id from an append-only log.

    By default invalid records are ignored and the last valid one wins; with
    ``last_then_valid`` a later error hides an earlier valid record.
    """
    source = log if last_then_valid else log.where(is_valid_label())
    order = F.struct("ingest_seq", F.coalesce("ingest_place", F.lit(0))) if "ingest_place" in log.columns else F.col("ingest_seq")
    last = source.groupBy("record_id").agg(
        F.max_by(F.struct(*[c for c in log.columns if c not in ("record_id", "ingest_place")]), order).alias("r")
    )
    rows = last.select("record_id", "r.*")
    return rows.where(is_valid_label()) if last_then_valid else rows


def labelled_rows(frame: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return frame.join(labels, frame[key].cast("string") == labels["record_id"], "inner").drop(labels["record_id"])


def pending_rows(frame: DataFrame, labels: DataFrame, key: str, text: str, max_calls: int | None = None) -> DataFrame:
    """Rows with text and no valid label yet, in id order where a call budget is given."""
    done = labels.select(F.col("record_id").alias("_id"))
    left = frame.where(clean(F.col(text)) != "").join(done, frame[key].cast("string") == done["_id"], "left_anti")
    return left if max_calls is None else left.orderBy(key).limit(max_calls)


def duplicate_check(labels: DataFrame, second: DataFrame, key: str = "record_id") -> DataFrame:
    """Absolute score differences between two annotation passes, and their mean."""
    again = second.select(key, *[F.col(s).alias(f"dup_{s}") for s in terms.TRUST_SCORES])
    joined = labels.join(again, key, "inner")
    short = dict(zip(terms.TRUST_SCORES, ("claim", "signal", "pressure", "competence", "benevolence", "integrity", "predictability")))
    out = joined.withColumns(
        {f"dup_abs_diff_{n}": F.abs(F.col(s) - F.col(f"dup_{s}")) for s, n in short.items()}
    )
    total = sum((F.col(f"dup_abs_diff_{n}") for n in list(short.values())[1:]), F.col("dup_abs_diff_claim"))
    return out.withColumn("dup_abs_diff_mean", total / len(short))


def backfilled(frame: DataFrame, truth: DataFrame, key: str, column: str) -> DataFrame:
    """Fill a column from a truth table where the frame has no value."""
    side = truth.select(key, F.col(column).alias("_truth"))
    return frame.join(side, key, "left").withColumn(column, F.coalesce(F.col(column), F.col("_truth"))).drop("_truth")


def fit_graph(
    train: DataFrame, label: str = "label_truth", bucket_columns: Sequence[str] = terms.GRAPH_BUCKETS, alpha: float = 1.0
) -> DataFrame:
    """Smoothed class priors and bucket probabilities as (bucket_column, class, bucket, prob).

    One pass with conditional counts; priors have bucket_column '' and bucket ''.
    """
    y = F.col(label)
    cells = [(c, k, b) for c in bucket_columns for k in (0, 1) for b in LEVELS]
    counts = train.agg(
        *[F.count_if(y == k).alias(f"n{k}") for k in (0, 1)],
        *[F.count_if((y == k) & (F.col(c) == b)).alias(f"{c}|{k}|{b}") for c, k, b in cells],
    )
    total = F.col("n0") + F.col("n1")
    rows = [
        F.struct(
            F.lit("").alias("bucket_column"), F.lit(k).alias("class"), F.lit("").alias("bucket"),
            ((F.col(f"n{k}") + alpha) / (total + 2 * alpha)).alias("prob"),
        )
        for k in (0, 1)
    ] + [
        F.struct(
            F.lit(c).alias("bucket_column"), F.lit(k).alias("class"), F.lit(b).alias("bucket"),
            ((F.col(f"`{c}|{k}|{b}`") + alpha) / (F.col(f"n{k}") + alpha * len(LEVELS))).alias("prob"),
        )
        for c, k, b in cells
    ]
    return counts.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def graph_probability(
    df: DataFrame, model: DataFrame, bucket_columns: Sequence[str] = terms.GRAPH_BUCKETS, into: str = "p_graph"
) -> DataFrame:
    """P(class 1) from the graph: the log odds of prior and buckets, summed.

    The model has 3 entries per bucket column plus the prior and is read as one map.
    """
    odds = model.groupBy("bucket_column", "bucket").agg(
        (F.log(F.max(F.when(F.col("class") == 1, F.col("prob")))) - F.log(F.max(F.when(F.col("class") == 0, F.col("prob"))))).alias("odds")
    )
    table = odds.agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "bucket_column", "bucket"), "odds")))
    ).scalar()
    keyed = df.withColumn("_odds", table)
    logit = F.try_element_at(F.col("_odds"), F.lit("|"))
    for c in bucket_columns:
        logit = logit + F.try_element_at(F.col("_odds"), F.concat(F.lit(f"{c}|"), F.col(c)))
    return keyed.withColumn(into, sigmoid(logit)).drop("_odds")


def logistic_probability(features: Sequence[str], coefficients: Sequence[float], intercept: float) -> Column:
    z = F.lit(float(intercept))
    for name, w in zip(features, coefficients):
        z = z + F.lit(float(w)) * F.col(name)
    return 1.0 / (1.0 + F.exp(-z))


def trust_scores(df: DataFrame, model: DataFrame, coefficients: Sequence[float], intercept: float) -> DataFrame:
    """Graph and logistic truth likelihood, risks and the graph's entropy."""
    prepared = graph_probability(with_graph_buckets(df), model, into="phase_b_truth_likelihood_graph")
    out = prepared.withColumn(
        "phase_b_truth_likelihood_logistic", logistic_probability(terms.TRUST_SCORES, coefficients, intercept)
    )
    return out.withColumns(
        {
            "trust_risk_index_graph": 1.0 - F.col("phase_b_truth_likelihood_graph"),
            "trust_risk_index_logistic": 1.0 - F.col("phase_b_truth_likelihood_logistic"),
            "graph_uncertainty_entropy": entropy_bits(F.col("phase_b_truth_likelihood_graph")),
        }
    )


def trust_summary(results: DataFrame) -> DataFrame:
    """Totals, averages and the ids of highest risk and entropy (first in input order on ties)."""
    ok = F.col("status") == "ok"
    risk, entropy = F.col("trust_risk_index_graph"), F.col("graph_uncertainty_entropy")
    first = -F.col("input_seq")
    return results.agg(
        F.count("*").alias("total_products"),
        F.count_if(ok).alias("successful_products"),
        F.count_if(~ok).alias("failed_products"),
        F.avg(F.when(ok, F.col("phase_b_truth_likelihood_graph"))).alias("average_phase_b_truth_likelihood_graph"),
        F.avg(F.when(ok, risk)).alias("average_trust_risk_index_graph"),
        F.max_by("record_id", F.when(ok, F.struct(risk, first))).alias("highest_graph_risk_record_id"),
        F.max_by("record_id", F.when(ok, F.struct(entropy, first))).alias("highest_entropy_record_id"),
    )


def normalised_trust(results: DataFrame) -> DataFrame:
    """Consumer-facing trust per row: logistic head first, graph head as fallback."""
    ok = F.col("status") == "ok"

    def unit(name: str) -> Column:
        return F.when(ok, clamp(finite(F.col(name))))

    step = results.withColumns(
        {
            "_tg": unit("phase_b_truth_likelihood_graph"), "_tl": unit("phase_b_truth_likelihood_logistic"),
            "_dg": unit("trust_risk_index_graph"), "_dl": unit("trust_risk_index_logistic"),
        }
    )
    step = step.withColumns(
        {
            "trust_probability_graph": F.coalesce("_tg", clamp(1.0 - F.col("_dg"))),
            "trust_probability_logistic": F.coalesce("_tl", clamp(1.0 - F.col("_dl"))),
            "deception_probability_graph": F.coalesce("_dg", clamp(1.0 - F.col("_tg"))),
            "deception_probability_logistic": F.coalesce("_dl", clamp(1.0 - F.col("_tl"))),
        }
    ).drop("_tg", "_tl", "_dg", "_dl")
    step = step.withColumns(
        {
            "trust_probability": F.coalesce("trust_probability_logistic", "trust_probability_graph"),
            "deception_probability": F.coalesce("deception_probability_logistic", "deception_probability_graph"),
        }
    )
    return step.withColumns(
        {
            "is_deceptive": F.col("deception_probability") >= 0.5,
            "score_head": F.when(F.col("trust_probability_logistic").isNotNull(), "logistic").when(
                F.col("trust_probability_graph").isNotNull(), "graph"
            ),
            "graph_uncertainty_entropy": unit("graph_uncertainty_entropy"),
            "status": F.when(F.col("status").isin("ok", "unavailable"), F.col("status")).otherwise("error"),
        }
    )


def review_deception(results: DataFrame) -> DataFrame:
    """Review branch: the graph head is the primary score."""
    step = normalised_trust(results)
    deception = F.coalesce("deception_probability_graph", "deception_probability_logistic")
    return step.withColumn("deception_probability", deception).withColumns(
        {
            "trust_probability": clamp(1.0 - F.col("deception_probability")),
            "is_deceptive": F.col("deception_probability") >= 0.5,
        }
    )


def _json_string(c: Column) -> Column:
    quoted = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def product_inputs(rows: DataFrame, seq: str = "input_seq") -> DataFrame:
    """Products for trust scoring: aliases resolved, text built, ids made unique.

    A row without any text becomes an error row ``invalid_product_<seq>``.
    """
    def first_of(*names: str) -> Column:
        present = [null_if_blank(F.col(f"`{n}`").cast("string")) for n in names if n in rows.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    step = rows.select(
        F.col(seq).alias("input_seq"),
        first_of("title", "TITLE").alias("title"),
        first_of("bullet_points", "BULLET_POINTS").alias("bullet_points"),
        first_of("description", "DESCRIPTION").alias("description"),
        first_of("text", "raw_text", "content").alias("_text"),
        first_of("product_id", "PRODUCT_ID", "id").alias("product_id"),
        first_of("product_type_id", "PRODUCT_TYPE_ID").alias("product_type_id"),
        first_of("record_id").alias("_given"),
    )
    built = product_text(F.col("title"), F.col("bullet_points"), F.col("description"))
    step = step.withColumn("text", F.coalesce(F.nullif(built, F.lit("")), F.col("_text")))
    digest = F.sha2(
        F.concat(
            F.lit('{"bullet_points": '), _json_string(F.col("bullet_points")),
            F.lit(', "description": '), _json_string(F.col("description")),
            F.lit(', "text": '), _json_string(F.col("text")),
            F.lit(', "title": '), _json_string(F.col("title")), F.lit("}"),
        ),
        256,
    )
    bad = F.col("text").isNull()
    step = step.withColumn(
        "_base",
        F.when(bad, F.concat(F.lit("invalid_product_"), F.col("input_seq"))).otherwise(
            F.coalesce(F.col("_given"), F.col("product_id"), F.concat(F.lit("product_"), F.substr(digest, F.lit(1), F.lit(16))))
        ),
    ).withColumn("status", F.when(bad, "error").otherwise("ok"))
    # The n-th repeat of an id (in input order) is numbered without gathering an id in one task.
    numbered = running_totals(
        with_piece(step, "input_seq"), [F.col("input_seq")], {"_nth": F.lit(1).cast("bigint")}, ["_base", "status"]
    )
    return numbered.select(
        F.when(F.col("_nth") > 1, F.concat("_base", F.lit("__"), F.col("_nth"))).otherwise(F.col("_base")).alias("record_id"),
        "status", "input_seq", "product_id", "product_type_id", "title", "bullet_points", "description", "text",
        F.when(bad, "a product needs text or a title, bullet points or a description").alias("error"),
    )


def annotate(
    pending: DataFrame,
    annotator: Callable[[Sequence[str]], Sequence[str]],
    key: str,
    text: str,
    max_text_chars: int | None = None,
    batch: int = 64,
) -> DataFrame:
    """Apply a user-supplied annotator to pending texts; failures become error rows.

    The annotator maps a batch of texts to as many raw annotation texts and runs inside the tasks.
    Where a batch fails or answers with another number of texts, its texts are tried one by one, so
    one bad text fails alone. Texts are handed over whole unless ``max_text_chars`` states the
    annotator's own input limit.
    """
    def asked(texts: list[str]) -> list[str]:
        answers = list(annotator(texts))
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers for {len(texts)} texts")
        return answers

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return asked([text])[0], None
        except Exception as exc:  # noqa: BLE001 - a failed call is data, not a job failure
            return None, str(exc)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                texts = part["t"].tolist()
                try:
                    results = [(raw, None) for raw in asked(texts)]
                except Exception:  # noqa: BLE001 - which text failed is found one by one
                    results = [one(t) for t in texts]
                raw, failed = zip(*results, strict=True)
                yield pd.DataFrame({"record_id": part["k"], "raw": raw, "call_error": failed}, dtype=object)

    sent = pending.select(
        F.col(key).cast("string").alias("k"),
        (clean(F.col(text)) if max_text_chars is None else F.substr(clean(F.col(text)), F.lit(1), F.lit(max_text_chars))).alias("t"),
    )
    answers = sent.mapInPandas(run, "record_id string, raw string, call_error string")
    parsed = parse_annotations(answers)
    return parsed.withColumn("error", F.coalesce("call_error", "error")).drop("raw", "call_error")


def assembled_results(scored: DataFrame, errors: DataFrame) -> DataFrame:
    """Scored and error rows together in input order."""
    return scored.unionByName(errors, allowMissingColumns=True).orderBy("input_seq")


def browse(rows: DataFrame, query: str, bucket: str = "all", sort: str = "record_id", ascending: bool = True) -> DataFrame:
    """Substring search over the shown columns, bucket filter, numbers before text order."""
    shown = ("record_id", "PRODUCT_ID", "TITLE", "BULLET_POINTS", "DESCRIPTION")
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in shown]))
    out = rows
    q = query.strip().lower()
    if q:
        out = out.where(hay.contains(q))
    if bucket != "all":
        out = out.where(F.lower("claim_trust_bucket") == bucket)
    number, text = F.col(sort).try_cast("double"), F.coalesce(F.col(sort).cast("string"), F.lit(""))
    keys = (number, text) if ascending else (number.desc(), text.desc())
    return out.orderBy(*keys, "record_id")


def model_table(graph: DataFrame, features: Sequence[str], coefficients: Sequence[float], intercept: float) -> DataFrame:
    """Fitted graph and logistic head as one table (part, term, class, bucket, value), to be kept and applied elsewhere."""
    head = [("logistic", name, None, None, float(w)) for name, w in zip(features, coefficients, strict=True)]
    head.append(("logistic", "", None, None, float(intercept)))
    graph = graph.select(F.lit("graph").alias("part"), F.col("bucket_column").alias("term"), F.col("class").cast("int").alias("class"), "bucket", F.col("prob").alias("value"))
    return graph.unionByName(graph.sparkSession.createDataFrame(head, "part string, term string, class int, bucket string, value double"))


def apply_models(rows: DataFrame, models: DataFrame, bucket_columns: Sequence[str] = terms.GRAPH_BUCKETS) -> DataFrame:
    """Score rows of any domain with kept models: truth likelihoods of both heads, risks, entropy.

    The table has some dozen rows; its logistic part is read as one map inside the plan.
    """
    graph = models.where("part = 'graph'").select(F.col("term").alias("bucket_column"), "class", "bucket", F.col("value").alias("prob"))
    weights = models.where("part = 'logistic'").agg(F.map_from_entries(F.collect_list(F.struct("term", "value")))).scalar()
    scored = graph_probability(with_graph_buckets(rows), graph, bucket_columns, "phase_b_truth_likelihood_graph").withColumn("_w", weights)
    z = F.try_element_at("_w", F.lit(""))
    for name in terms.TRUST_SCORES:
        z = z + F.try_element_at("_w", F.lit(name)) * F.col(name)
    scored = scored.withColumn("phase_b_truth_likelihood_logistic", sigmoid(z)).drop("_w")
    return scored.withColumns(
        {
            "trust_risk_index_graph": 1.0 - F.col("phase_b_truth_likelihood_graph"),
            "trust_risk_index_logistic": 1.0 - F.col("phase_b_truth_likelihood_logistic"),
            "graph_uncertainty_entropy": entropy_bits(F.col("phase_b_truth_likelihood_graph")),
        }
    )


def failed_annotations(log: DataFrame, n: int = 5) -> DataFrame:
    """The last n failed records of a label log, the latest first, and whether a valid record of the same id came later.

    The log is read backwards by (batch, place in the batch); only ids that failed are looked up among the valid ones.
    """
    place = F.coalesce("ingest_place", F.lit(0)) if "ingest_place" in log.columns else F.lit(0).cast("bigint")
    rows = log.withColumn("_at", F.struct(F.col("ingest_seq"), place.alias("ingest_place")))
    last = rows.where(F.col("error").isNotNull()).orderBy(F.desc("_at"), "record_id").limit(n)
    valid = rows.where(is_valid_label()).join(F.broadcast(last.select("record_id").distinct()), "record_id", "left_semi")
    later = valid.groupBy("record_id").agg(F.max("_at").alias("_valid"))
    return last.join(later, "record_id", "left").select(
        "record_id", F.col("_at.ingest_seq").alias("ingest_seq"), "error", F.coalesce(F.col("_valid") > F.col("_at"), F.lit(False)).alias("superseded")
    )


def most_uncertain(scored: DataFrame, n: int = 15) -> DataFrame:
    """Rows whose graph is the least sure, by entropy; equal ones by id."""
    entropy = F.round("graph_uncertainty_entropy", 9)
    return scored.orderBy(F.desc_nulls_last(entropy), "record_id").limit(n)

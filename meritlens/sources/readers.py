"""Readers for reviews, catalogs, labelled texts, products and seller cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.numbers import to_int
from ..functions.text import clean, text_or_blank
from ..operators.catalog import normalise_catalog
from ..operators.reviews import relabel, seller_case_texts
from ..operators.sampling import balanced_sample, sample_rows
from ..operators.textmodels import polarity_label_text
from ..operators.trust import product_text
from .schemas import PREPARED_PRODUCT, PREPARED_REVIEW, RAW_REVIEW, SELLER_CASES, ddl, require_columns, resolve_column


def read_json(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """JSON lines (plain or gzip), or one document per file; a malformed line fails the read instead of turning into nulls."""
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_lines(spark: SparkSession, path: str | Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that are no object of the schema: (file, record).

    Blank lines are neither. Both frames read the files when they are used.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_record"}
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, _record string", options))
    broken = F.col("row._record").isNotNull() | ~F.ltrim("value").startswith("{")
    return (
        parsed.where(~broken).select("row.*").drop("_record"),
        parsed.where(broken).select("file", F.col("value").alias("record")),
    )


def read_csv_rows(
    spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",", header: bool = True, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV as strings in ``columns`` (all fields, in order), and the records with another number of fields:
    (file, record). A header with other names fails the read.
    """
    schema = ", ".join(f"`{c}` string" for c in (*columns, "_record"))
    rows = spark.read.csv(
        path, schema=schema, sep=sep, header=header, multiLine=multi_line, quote='"', escape='"', mode="PERMISSIVE",
        columnNameOfCorruptRecord="_record", enforceSchema=False,
    )
    # The reader prunes what is not asked for and would then count fewer fields as well: all columns stay in the plan.
    seen = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.to_json(F.struct(*columns)).alias("_all"))
    broken = F.col("_record").isNotNull() & F.col("_all").isNotNull()
    return (
        seen.where(~broken).select(*columns),
        seen.where(broken).select(F.col("_file").alias("file"), F.rtrim("_record").alias("record")),
    )


def read_reviews(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Raw review lines (plain or gzip); blank lines are skipped by the reader."""
    return with_review_fallbacks(read_json(spark, path, ddl(RAW_REVIEW)))


def with_review_fallbacks(rows: DataFrame) -> DataFrame:
    """Votes and time from whichever of their two columns is filled."""
    return rows.withColumns(
        {
            "helpful_votes": F.coalesce(to_int(F.col("helpful_votes")), to_int(F.col("helpful_vote")), F.lit(0)),
            "timestamp": F.coalesce("timestamp", "sort_timestamp"),
        }
    ).drop("helpful_vote", "sort_timestamp")


def read_prepared_reviews(spark: SparkSession, path: str, positive_threshold: int) -> DataFrame:
    """Prepared reviews with labels from their votes; a malformed line fails the read."""
    return relabel(read_json(spark, path, ddl(PREPARED_REVIEW)), positive_threshold)


def read_prepared_reviews_with_rejects(spark: SparkSession, path: str, positive_threshold: int) -> tuple[DataFrame, DataFrame]:
    """The same, with malformed lines and reviews that have neither votes nor a label set apart: (file, record)."""
    rows, rejects = read_json_lines(spark, path, ddl(PREPARED_REVIEW))
    votes = F.coalesce(to_int(F.col("helpful_votes")), to_int(F.col("helpful_vote")))
    known = votes.isNotNull() | F.col("label").isNotNull()
    unlabelled = rows.where(~known).select(F.lit(None).cast("string").alias("file"), F.to_json(F.struct("*")).alias("record"))
    return relabel(rows.where(known), positive_threshold), rejects.unionByName(unlabelled)


def read_prepared_catalog(spark: SparkSession, path: str) -> DataFrame:
    return normalise_catalog(read_json(spark, path, ddl(PREPARED_PRODUCT)))


def read_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """Header CSV with doubled quotes. ``multi_line`` allows quoted line breaks, at the price of one task per file."""
    return spark.read.csv(path, sep=sep, header=True, multiLine=multi_line, quote='"', escape='"')


def labelled_reviews(raw: DataFrame, target_rows: int = 0, key: str | None = None, seed: int = 42) -> DataFrame:
    """Original (1) and generated (0) reviews from columns text_ and label; others are dropped."""
    require_columns(raw, ["text_", "label"])
    kind = F.upper(F.trim("label"))
    rows = raw.withColumns(
        {"text": clean(F.col("text_")), "label_truth": F.when(kind == "OR", 1).when(kind == "CG", 0)}
    ).where(F.col("label_truth").isNotNull() & (F.col("text") != ""))
    return balanced_sample(rows, "label_truth", key or "text", target_rows, seed).drop("text_")


def truth_labelled(raw: DataFrame, key: str, target_rows: int = 0, seed: int = 42) -> DataFrame:
    """Text and truth label from a table whose column names and label words vary."""
    text = resolve_column(raw, ["text", "content", "body", "statement", "article"])
    label = resolve_column(raw, ["label", "truth", "is_fake", "target", "class"])
    if dict(raw.dtypes)[label] == "string":
        word = F.lower(F.trim(F.col(label)))
        truth = F.coalesce(*[F.when(word == w, F.lit(v)) for w, v in terms.TRUTH_WORDS.items()])
    else:
        truth = F.when(F.col(label) >= 1, 1).when(F.col(label) == 0, 0)
    rows = raw.select(F.col(key), F.col(text).cast("string").alias("text"), truth.alias("label_truth"))
    return balanced_sample(rows.where(F.col("label_truth").isNotNull()), "label_truth", key, target_rows, seed)


def read_truth_labelled(spark: SparkSession, path: str, key: str, target_rows: int = 0, seed: int = 42) -> DataFrame:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        raw = read_csv(spark, path, "\t" if suffix == "tsv" else ",", multi_line=True)
    elif suffix in ("json", "jsonl"):
        raw = read_json(spark, path, multi_line=suffix == "json")
    else:
        raise ValueError(f"unsupported extension: {suffix}")
    return truth_labelled(raw, key, target_rows, seed)


def collapsed_labels(splits: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Union of tagged splits with six truth levels collapsed to two; the middle level is dropped."""
    out = None
    for name, df in splits.items():
        part = df.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    level = F.col(label)
    truth = F.when(level.isin(0, 1, 2), 0).when(level.isin(4, 5), 1)
    return out.withColumn("label_truth", truth).where(F.col("label_truth").isNotNull())


def product_rows(raw: DataFrame, target_rows: int, seed: int = 42) -> DataFrame:
    """Sampled products with their text; rows without text are dropped."""
    require_columns(raw, ["PRODUCT_ID", "TITLE", "BULLET_POINTS", "DESCRIPTION"])
    sampled = sample_rows(raw, "PRODUCT_ID", target_rows, seed)
    return (
        sampled.withColumn("record_id", F.col("PRODUCT_ID").cast("string"))
        .withColumn("text", product_text(F.col("TITLE"), F.col("BULLET_POINTS"), F.col("DESCRIPTION")))
        .where(F.col("text") != "")
    )


def read_products(spark: SparkSession, path: str, target_rows: int, seed: int = 42) -> DataFrame:
    """Products of a header CSV whose fields may hold line breaks; the required columns are checked on its header."""
    return product_rows(read_csv(spark, path, multi_line=True), target_rows, seed)


def polarity_rows(raw: DataFrame, key: str, max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Texts with a 0/1 label and its name, optionally a seeded sample."""
    rows = polarity_label_text(require_columns(raw, ["text", "label"]) if "label_text" in raw.columns else
                               require_columns(raw, ["text", "label"]).withColumn("label_text", F.lit(None).cast("string")))
    return rows if max_rows is None else sample_rows(rows, key, max_rows, seed)


def read_seller_cases(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Texts per case, and the cases without any; one document per file, or JSON lines."""
    return seller_case_texts(read_json(spark, path, ddl(SELLER_CASES), multi_line))


def embedding_texts(raw: DataFrame, title: str, bullets: str, description: str) -> DataFrame:
    from ..operators.retrieval import embedding_document

    return raw.withColumn(
        "document_text",
        embedding_document(*[text_or_blank(F.col(resolve_column(raw, [c]))) for c in (title, bullets, description)]),
    )

"""Split, score and label-log sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..operators.catalog import split_summary
from ..operators.trust import latest_labels

SPLITS = ("train", "val", "test")
#: Columns of a label log.
LABEL_LOG = ", ".join(
    ["record_id string", "domain string", *(f"{c} double" for c in (*terms.TRUST_SCORES, "overall_confidence")), "rationale_claim string",
     "rationale_signal string", "rationale_pressure string", "error string", *(f"{b} string" for b in terms.LABEL_BUCKETS),
     "ingest_seq bigint", "ingest_place bigint"]
)


def write_splits(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """One folder per split; earlier output is replaced."""
    rows.write.mode("overwrite").partitionBy("split").format(fmt).save(path)


def write_split_summary(rows: DataFrame, path: str) -> None:
    split_summary(rows).coalesce(1).write.mode("overwrite").json(path)


def write_scores(rows: DataFrame, path: str) -> None:
    """Scored table as CSV with a header on every part."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_catalog(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_labels(rows: DataFrame, path: str, batch_seq: int) -> None:
    """Append label records; a later batch outranks an earlier one, and in a batch a later row an earlier one.

    Records keep a caller's ingest_seq; otherwise it is the batch number. ingest_place numbers the
    rows of a batch in their order and is fixed once written.
    """
    out = rows if "ingest_seq" in rows.columns else rows.withColumn("ingest_seq", F.lit(batch_seq).cast("bigint"))
    out = out.withColumn("ingest_place", F.monotonically_increasing_id())
    out.write.mode("append").parquet(path)


def read_labels(spark: SparkSession, path: str, last_then_valid: bool = False) -> DataFrame:
    """Latest label per id; a log that does not exist yet has none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LABEL_LOG).drop("ingest_place")
    return latest_labels(spark.read.option("mergeSchema", True).parquet(path), last_then_valid)

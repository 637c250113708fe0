"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlens.llm.common import SPACES, bit_table, group_apart, materialise, maybe_member

#: Characters of the normalised text in the prefix hash.
PREFIX = 64


def normalised(text: Column) -> Column:
    """Text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACES}+", "")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest_all: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest.

    Equal are texts identical without white space. Of a group the row with the most code points in
    its original text stays, then the smallest id. Rows whose normalised length is unique are
    settled first, then rows whose prefix hash is unique within their length; a second scan hashes
    in full (SHA-256) only texts of (length, prefix) groups that survive. It knows them by a bit
    table of fixed size, so no text is shuffled; what the table lets through by chance is settled
    by the full hash. ``digest`` is null for texts settled before, unless ``digest_all``.

    Null text is the empty text, and all empty texts are one group. Repeated rows (same id, same
    text) are members of a group like any others: each keeps its row, and ``kept`` is true for all
    rows with the id that stays. A null id is smaller than any other. Extra columns are ignored; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = rows.select("id", F.length(F.coalesce("t", F.lit(""))).alias("points"), normalised(F.col("t")).alias("n"))
    rows = rows.withColumns({"len": F.octet_length("n"), "prefix": F.xxhash64(F.substring("n", 1, prefix))})

    sizes = materialise(rows.groupBy("len", "prefix").agg(F.count("*").alias("c")))
    by_length = group_apart(sizes, ["len"], F.sum("c").alias("all")).where("all > 1")
    by_prefix = sizes.join(by_length, "len", "left_semi").where("c > 1")
    bits = materialise(bit_table(by_prefix, F.xxhash64("len", "prefix")))

    read = maybe_member(rows, F.xxhash64("len", "prefix"), bits, "open")
    hashed = F.sha2("n", 256) if digest_all else F.when(F.col("open"), F.sha2("n", 256))
    full = materialise(read.select("id", "points", "len", hashed.alias("digest"), "open"))
    groups = group_apart(
        full.where("open"), ["len", "digest"], F.min(F.struct((-F.col("points")).alias("p"), "id")).alias("first"), F.count("*").alias("c")
    ).where("c > 1")
    found = full.join(groups, ["len", "digest"], "left")
    found = found.withColumn("keep_id", F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("first.id")))
    return found.select(
        "id", "keep_id", F.coalesce("c", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def op3_exact_dedup(docs: DataFrame) -> DataFrame:
    found = exact_duplicates(docs, digest_all=True)
    return found.withColumnsRenamed({"id": "doc_id", "digest": "text_sha256"})


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, struct_pack(p := -points, d := doc_id)) AS keep_id
  FROM t GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

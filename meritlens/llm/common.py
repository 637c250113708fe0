"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meritlens.session import ensure_checkpoint_dir, materialise

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "[\\x20\\x09-\\x0D]"
WORDS = "[^\\x20\\x09-\\x0D]+"

#: Bits of a membership table (2**25 bits are 1,024 rows of 4 KB, so 4 MB whatever the input).
FILTER_BITS = 25
_ROW_BITS = 15
#: Rows and bytes of an Arrow batch of documents.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}
#: About so many rows are ordered by one task.
PIECE_ROWS = 50_000

__all__ = [
    "FILTER_BITS", "SPACES", "WORDS", "bit_table", "components", "drop_folder", "fresh", "frugal", "give_back", "group_apart", "held_out", "logistic", "materialise",
    "maybe_member", "new_folder", "numbered", "table", "text_batches",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new place below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table of this run that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that begin with the stems and that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def give_back() -> None:
    """Return freed memory of this Python process to the machine: the allocators keep what a peak took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives free memory back at its end: Python workers stay for later stages."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return ended


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, for tasks that read its texts in Python: Arrow batches are kept small, as a row is a whole document.

    Spark's default of 10,000 rows a batch makes tasks hold tens of MB of text on both sides of the
    pipe. Limits that the session's owner has set stay.
    """
    conf = df.sparkSession.conf
    for key, value in ARROW_LIMITS.items():
        if conf.get(key, None) is None:
            conf.set(key, value)
    return df


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text has remainder 1 by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def group_apart(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Group by keys wrapped in a struct.

    The result is not known to be partitioned by the keys, so a join on them gets an exchange on
    both sides, which adaptive execution can split where one key is hot.
    """
    grouped = df.groupBy(F.struct(*keys).alias("_k")).agg(*aggregates)
    return grouped.select(*(F.col(f"_k.{k}").alias(k) for k in keys), *(c for c in grouped.columns if c != "_k"))


def bit_table(keys: DataFrame, hashed: Column) -> DataFrame:
    """A fixed-size bit table of hashed keys: at most 2**10 rows of 512 numbers (4 KB), so it may be broadcast."""
    place = hashed.bitwiseAND((1 << FILTER_BITS) - 1)
    bits = (
        keys.select(F.shiftright(place, _ROW_BITS).alias("_row"), place.bitwiseAND((1 << _ROW_BITS) - 1).alias("_bit"))
        .groupBy("_row")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )
    # Numbers are read in place, where a binary value would be copied as a whole for each test.
    words = f"transform(sequence(0, {(1 << _ROW_BITS) // 64 - 1}), i -> CAST(conv(hex(substring(_bits, i * 8 + 1, 8)), 16, -10) AS BIGINT))"
    return bits.select("_row", F.expr(words).alias("_bits"))


def maybe_member(df: DataFrame, hashed: Column, bits: DataFrame, flag: str) -> DataFrame:
    """Add ``flag``: false only for rows whose hash is certainly not in the table. Columns of any name stay, but for ``flag``."""
    place, row, own = fresh(df, "_place", "_row", "_bits")
    marked = df.withColumn(place, hashed.bitwiseAND((1 << FILTER_BITS) - 1)).withColumn(row, F.shiftright(place, _ROW_BITS))
    # The first byte of a number is its highest one, the first bit of a byte its lowest one.
    at = f"CAST({place} & {(1 << _ROW_BITS) - 1} AS INT)"
    test = F.expr(f"{own} IS NOT NULL AND getbit(get({own}, shiftright({at}, 6)), (7 - shiftright({at} & 63, 3)) * 8 + ({at} & 7)) = 1")
    return marked.join(F.broadcast(bits.toDF(row, own)), row, "left").withColumn(flag, test).drop(row, place, own)


def numbered(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``_at``, the place of a row among the rows of its keys from 0, and ``_n``, their number.

    For each entry of ``sums`` (new column: number column) the sum over the rows up to this one is added. Rows
    are cut into pieces by range, a key with many rows into several; pieces are summed, and rows are ordered
    inside a piece only. Rows equal in keys and order stand in any order, next to each other.
    """
    sums = sums or {}
    stored = materialise(df)
    pieces = max(1, -(-stored.count() // piece_rows))
    ranged = stored.repartitionByRange(pieces, *keys, *order).sortWithinPartitions(*keys, *order)
    ranged = materialise(ranged.select("*", F.spark_partition_id().alias("_piece"), F.monotonically_increasing_id().alias("_seq")))
    per = ranged.groupBy(*keys, "_piece").agg(
        F.count("*").alias("_rows"), F.min("_seq").alias("_first"), *(F.sum(c).alias(f"_sum_{k}") for k, c in sums.items())
    )
    whole = Window.partitionBy(*keys)
    so_far = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    starts = per.select(
        *(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_piece").alias("_at_piece"), (before("_rows") - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("_n"),
        *(before(f"_sum_{k}").alias(f"_before_{k}") for k in sums),
    )
    out = ranged.join(starts, [F.col("_piece") == F.col("_at_piece"), *(F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys)])
    out = out.select(*ranged.columns, (F.col("_seq") + F.col("_shift")).alias("_at"), "_n", *(f"_before_{k}" for k in sums))
    if sums:
        within = Window.partitionBy(*keys, "_piece").orderBy("_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.select("*", *((F.sum(c).over(within) + F.col(f"_before_{k}")).alias(k) for k, c in sums.items()))
    return out.drop("_piece", "_seq", *(f"_before_{k}" for k in sums))


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components: (node, component) for every node of an edge, component = its smallest node.

    Alternates large-star and small-star steps until the edges stand still; each step is a grouped
    minimum with map-side combine and a join whose hot keys adaptive execution can split. Every
    round is written to the shared folder and the one before it is removed. Edges may repeat, run
    both ways or join a node with itself; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    lone = edges.where(F.col(left) == F.col(right)).select(F.col(left).alias("node"), F.col(left).alias("component"))
    state = edges.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    ).distinct()
    path, mark = None, None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = group_apart(both, ["u"], F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = group_apart(large, ["u"], F.min("v").alias("m"))
        near = large.join(lowest, "u")
        small = near.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()
        new_path = new_folder(spark, "links")
        small.write.parquet(new_path)
        state = spark.read.schema(small.schema).parquet(new_path)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if path:
            drop_folder(spark, path)
        path = new_path
        if tuple(now) == mark or now[0] == 0:
            break
        mark = tuple(now)
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(state.select(F.col("v").alias("node"), F.col("v").alias("component"))).union(lone).groupBy("node").agg(
        F.min("component").alias("component")
    )


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    b, weight = np.zeros(x.shape[1]), weight / weight.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        pull = x.T @ (weight * (y - p)) - 0.1 * b
        b += np.clip(np.linalg.solve((x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(x.shape[1]), pull), -2, 2)
    return b

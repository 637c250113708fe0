"""Shards by jump consistent hashing of stable keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritlens.llm.common import materialise

SHARDS = 40
#: About so many rows are numbered by one task.
PIECE_ROWS = 4096
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, *counts: int) -> list[np.ndarray]:
    """Shard of each 64-bit key for every count of shards, by jump consistent hashing.

    A key jumps from shard to shard as the count grows; its shard is the last place before the jump
    that leaves the count, so one walk serves all counts and one more shard takes keys only to itself.
    """
    state = keys.astype(np.uint64)
    out = [np.zeros(len(state), np.int64) for _ in counts]
    at = np.arange(len(state))
    place = np.zeros(len(state), np.int64)
    while len(at):
        for shard, count in zip(out, counts, strict=True):
            inside = place < count
            shard[at[inside]] = place[inside]
        state = state * _STEP + np.uint64(1)
        place = ((place + 1) * (2.0**31 / ((state >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        go_on = place < max(counts)
        at, state, place = at[go_on], state[go_on], place[go_on]
    return out


def shard_key(*columns: Column) -> Column:
    """60 bits of the SHA-256 of the key columns as text; a null is told from an empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 15), 16, 10).cast("long")


def assign_shards(df: DataFrame, key: list[str], shards: int = SHARDS) -> DataFrame:
    """Add ``shard_hash``, ``shard`` and ``grown_shard`` (the shard if there were one more).

    Only the key columns and the count of shards decide. Rows with equal keys share a shard, nulls
    are keys like any other, extra columns stay. Rows that repeat go to one shard; an empty table
    stays empty. No shuffle.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("shard int, grown_shard int")
    def places(h: pd.Series) -> pd.DataFrame:
        now, grown = jump(h.to_numpy(), shards, shards + 1)
        return pd.DataFrame({"shard": now.astype(np.int32), "grown_shard": grown.astype(np.int32)})

    hashed = df.withColumn("shard_hash", shard_key(*(F.col(c) for c in key)))
    return hashed.withColumn("_p", places("shard_hash")).select("*", "_p.shard", "_p.grown_shard").drop("_p")


def number_slots(df: DataFrame, ties: list[str], shards: int = SHARDS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``slot``: rows of a shard numbered from 0 without gaps, in the order of key hash and ``ties``.

    A shard is cut into pieces by the hash of the key and of the ties (so equal keys are spread as
    well); pieces are counted, their starts summed, and rows are ordered inside a piece only.
    Rows equal in all of these are numbered in any order.
    """
    spread = F.xxhash64("shard_hash", *ties)
    stored = materialise(df.withColumn("_spread", spread))
    pieces = max(16, -(-stored.count() // (shards * piece_rows)))
    cut = stored.withColumn("_piece", F.pmod("_spread", F.lit(pieces)))
    counts = cut.groupBy("shard", "_piece").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = counts.select("shard", "_piece", (before - F.col("_n")).alias("_start"))
    order = Window.partitionBy("shard", "_piece").orderBy("shard_hash", "_spread", *ties)
    numbered = cut.withColumn("_r", F.row_number().over(order)).join(starts, ["shard", "_piece"])
    return numbered.withColumn("slot", F.col("_start") + F.col("_r") - 1).drop("_spread", "_piece", "_r", "_start")


def write_shards(df: DataFrame, path: str) -> None:
    """Write rows with ``shard`` as one folder per shard."""
    df.write.partitionBy("shard").parquet(path)


def op8_sharding(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Slots and shards of documents; null text has no bytes and the checksum of the empty text."""
    text = F.coalesce("text", F.lit(""))
    light = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law")
    )
    numbered = number_slots(assign_shards(light, ["doc_id"], shards), ["doc_id", "text_crc32", "size"], shards)
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")

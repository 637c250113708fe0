"""Mixtures of sources: Sainte-Laguë apportionment of equal blocks, then a seeded choice of blocks."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meritlens.llm.common import WORDS, fresh, group_apart, materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Rows of a source in one shard, about.
SHARD_ROWS = 1024
#: A block has at most so many words, and the smallest target at least BLOCKS blocks.
BLOCK_WORDS, BLOCKS = 1024, 1000
SEED = 17
_WORD = re.compile(WORDS)


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1), no party above ``most``; ties go to the first.

    Starts from the rounded divisor and moves single seats by a heap, so the work does not grow with
    the number of seats.
    """
    votes = np.asarray(votes, np.float64)
    most = np.where(votes > 0, most, 0).astype(np.int64)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    low, high = 0.0, 2.0 * votes.max() + 1.0  # divisors: at low everyone is full, at high nobody has a seat
    at = lambda d: np.minimum(np.floor(np.minimum(votes / d, 2.0**62) + 0.5), most).astype(np.int64)
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if at(middle).sum() > seats:
            low = middle
        else:
            high = middle
    got = at(high)
    heap = [(-votes[i] / (2 * int(got[i]) + 1), i) for i in range(len(votes)) if got[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * int(got[i]) + 1), i))
    return got


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Targets of sources (source, rows, source_size): weights repeat by the order of names, null last.

    All share ``share`` of the total by weight; a target stops at ``repeats`` times the source's size
    and its excess is reshared by weight until none is above. One row per source, so the ordered
    windows here run over the list of sources, not over rows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int")))
    ranked = ranked.withColumn("stop", (F.lit(repeats) * F.col("source_size")).cast("double"))
    # Sources fill up in the order of stop / weight: from the first that does not, all share the rest by weight.
    full = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    ranked = ranked.withColumns({
        "total": F.lit(share) * F.sum("source_size").over(everything),
        "all_w": F.sum("w").over(everything),
        "stops": F.coalesce(F.sum("stop").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "ws": F.coalesce(F.sum("w").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
    })
    level = (F.col("total") - F.col("stops")) / (F.col("all_w") - F.col("ws"))
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") < F.col("stop"))
    ranked = ranked.withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    target = F.when(F.col("final").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("final") * F.col("w")))
    return ranked.select("source", "rows", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``taken`` is how many of its words the mixture takes, repeats counted: whole rounds of the shard
    first, then a seeded run of blocks, so a row is taken whole or not, but for the rows at a run's ends. Blocks of
    a source's shard have equal words, within one; the blocks of all targets are apportioned to
    sources and then to shards by highest quotients. A row is never taken above ``repeats`` times.

    Null text has no words, as has white space; such rows take nothing. A null source is a source,
    the last one. Repeated rows are rows of their own, ordered by seeded hash, id and size. Extra
    columns are ignored. An empty table gives no rows.
    """
    light = materialise(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    )
    sizes = light.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, repeats))
    smallest, total = targets.where("target > 0").agg(F.min("target"), F.sum("target")).first()
    block = max(1, min(BLOCK_WORDS, int((smallest or 0) // BLOCKS)))
    seats = round((total or 0) / block)

    dealt = light.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    hashed = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "size")
    dealt = dealt.withColumn("_h", hashed).withColumn("_shard", F.pmod(F.col("_h"), F.ceil(F.col("rows") / shard_rows)))
    within = Window.partitionBy("source", "_shard").orderBy(F.xxhash64("_h", F.lit(seed)), "doc_id", "size")
    dealt = materialise(dealt.withColumn("_end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))))

    shards = group_apart(dealt, ["source", "_shard"], F.sum("size").alias("words"), F.first("target").alias("target"))
    shards = shards.withColumn("blocks", F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block))).otherwise(0).cast("long"))
    shards = materialise(shards)
    by_source = shards.groupBy("source").agg(F.sum("blocks").alias("blocks"), F.first("target").alias("target"))

    def to_sources(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last", ignore_index=True)
        pdf["quota"] = sainte_lague(pdf["target"].to_numpy(), seats, repeats * pdf["blocks"].to_numpy())
        return pdf[["source", "quota"]]

    def to_shards(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_shard", ignore_index=True)
        pdf["quota"] = sainte_lague(pdf["words"].to_numpy(), int(pdf["quota"].iloc[0]), repeats * pdf["blocks"].to_numpy())
        return pdf

    quotas = by_source.groupBy(F.lit(True).alias("_all")).applyInPandas(to_sources, "source string, quota long").withColumnRenamed("source", "_s")
    shard_quotas = (
        shards.join(quotas, F.col("source").eqNullSafe(F.col("_s")))
        .select("source", "_shard", "words", "blocks", "quota")
        .groupBy("source")
        .applyInPandas(to_shards, "source string, _shard long, words long, blocks long, quota long")
        .select(F.col("source").alias("_s"), F.col("_shard").alias("_k"), "words", "blocks", "quota")
    )
    joined = dealt.join(shard_quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_k")))
    run = F.expr("(quota % greatest(blocks, 1)) * words DIV greatest(blocks, 1)")  # the words of the seeded run of blocks
    part = F.greatest(F.lit(0), F.least(F.col("_end"), run) - (F.col("_end") - F.col("size")))
    taken = F.when(F.col("size") == 0, 0).otherwise(F.expr("quota DIV greatest(blocks, 1)") * F.col("size") + part)
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixture as rows of ``docs``: a row for each whole time a document is taken, and one for a part, cut after its words.

    Rows that repeat an id, a source and a size share what is taken of them evenly, rounded down.
    """
    key, words, times, part, k = fresh(docs, "_key", "_taken", "_times", "_part", "_k")
    taken = mix(docs, **options).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.expr("sum(taken) DIV count(*)").alias(words))
    taken = taken.select(F.struct("doc_id", "source", "size").alias(key), words)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, words: pd.Series) -> pd.Series:
        """The text up to the end of a word."""
        out = []
        for text, n in zip(texts, words, strict=True):
            if text is not None:
                for k, m in enumerate(_WORD.finditer(text), 1):
                    if k == n:
                        text = text[: m.end()]
                        break
            out.append(text)
        return pd.Series(out, dtype=object)

    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    keyed = docs.withColumn(key, F.struct("doc_id", "source", size.alias("size"))).join(taken, key).where(f"{words} > 0")
    keyed = keyed.withColumns({times: F.expr(f"{words} DIV {key}.size"), part: F.expr(f"{words} % {key}.size")})
    rows = keyed.withColumn(k, F.explode(F.expr(f"sequence(1, CAST({times} + sign({part}) AS INT))"))).where(f"{k} >= 1")
    last = F.col(k) > F.col(times)
    text = F.when(last, cut(F.when(last, F.col("text")), F.col(part))).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*docs.columns)


def op7_source_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")

"""Deterministic splits and samples with exact sizes.

Random choice is the rank of sha256(seed:key) inside a class. Ranks come from hash pieces, so
a class that holds most of the rows is still spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import hash_unit
from ..functions.text import clean
from ..session import materialise
from .ordering import hash_ranked, running_totals, with_hash_piece


def _allocated(counts: DataFrame, count: str, share: float, into: str) -> DataFrame:
    """Largest-remainder allocation of round(total * share) rows over the labels."""
    everything = Window.partitionBy(F.lit(0))
    exact = F.col(count) * F.lit(share)
    extra = F.bround(F.sum(count).over(everything) * F.lit(share)) - F.sum(F.floor(exact)).over(everything)
    place = F.row_number().over(
        everything.orderBy(F.desc(F.round(exact - F.floor(exact), 12)), F.desc(count), F.asc("label"))
    )
    return counts.withColumn(into, (F.floor(exact) + (place <= extra).cast("int")).cast("bigint"))


def quota_plan(
    label_counts: DataFrame,
    validation_size: float = 0.1,
    test_size: float = 0.1,
    balance: bool = True,
    balanced_total: int | None = None,
) -> DataFrame:
    """Rows per label and split. Input: (label, available), one row per label.

    Fails where a label is too small or no training row would be left.
    """
    labels = Window.partitionBy(F.lit(0))
    plan = label_counts.withColumn("_labels", F.count("*").over(labels))
    if not balance:
        target = F.col("available")
    elif balanced_total is None:
        target = F.min("available").over(labels)
    else:
        target = F.lit(balanced_total) / F.col("_labels")
    plan = plan.withColumn("planned", target.cast("bigint"))
    problem = (
        F.when(F.col("_labels") < 2, "splitting needs at least two labels")
        .when(F.lit(balanced_total or 0) % F.col("_labels") != 0, "total not divisible by labels")
        .when(F.col("planned") > F.col("available"), "not enough rows for a label")
        .when(F.col("planned") <= 0, "balanced target leaves no rows")
    )
    plan = _allocated(plan, "planned", test_size, "test_rows")
    plan = plan.withColumn("_left", F.col("planned") - F.col("test_rows"))
    plan = _allocated(plan, "_left", validation_size / (1.0 - test_size) if validation_size else 0.0, "val_rows")
    plan = plan.withColumn("train_rows", F.col("_left") - F.col("val_rows"))
    problem = F.coalesce(problem, F.when(F.col("train_rows") <= 0, "no training rows left for a label"))
    checked = F.when(problem.isNotNull(), F.raise_error(problem).cast("bigint")).otherwise(F.col("planned"))
    return plan.select("label", "available", checked.alias("planned"), "test_rows", "val_rows", "train_rows")


def quota_assignment(rows: DataFrame, label: str, key: str, plan: DataFrame, seed: int = 42) -> DataFrame:
    """Assign planned rows to test, val and train; rows beyond the plan are not selected."""
    ranked = hash_ranked(rows.withColumn("_u", hash_unit(seed, F.col(key))), "_u", key, [label], "_rank")
    side = plan.select(F.col("label").alias(label), "test_rows", "val_rows", "planned")
    r = F.col("_rank")
    return (
        ranked.join(F.broadcast(side), label)
        .withColumn(
            "split",
            F.when(r <= F.col("test_rows"), "test")
            .when(r <= F.col("test_rows") + F.col("val_rows"), "val")
            .when(r <= F.col("planned"), "train"),
        )
        .where(F.col("split").isNotNull())
        .drop("_u", "_rank", "test_rows", "val_rows", "planned")
    )


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("available"))


def stratified_split(rows: DataFrame, label: str, key: str, test_size: float = 0.25, seed: int = 42) -> DataFrame:
    plan = quota_plan(label_counts(rows, label), 0.0, test_size, balance=False)
    return quota_assignment(rows, label, key, plan, seed)


def balanced_sample(rows: DataFrame, label: str, key: str, target_rows: int, seed: int = 42) -> DataFrame:
    """Up to half the target per class; all rows when the target is not positive or not exceeded."""
    if target_rows <= 0:
        return rows
    per_class = max(1, target_rows // 2)
    total = rows.agg(F.count("*")).scalar()
    ranked = hash_ranked(rows.withColumn("_u", hash_unit(seed, F.col(key))), "_u", key, [label], "_rank")
    return (
        ranked.withColumn("_total", total)
        .where((F.col("_rank") <= per_class) | (F.col("_total") <= target_rows))
        .drop("_u", "_rank", "_total")
    )


def uniform_sample(rows: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Exactly max(1, floor(n * fraction)) rows."""
    ranked = hash_ranked(rows.withColumn("_u", hash_unit(seed, F.col(key))), "_u", key, (), "_rank", total="_n")
    return ranked.where(
        F.col("_rank") <= F.greatest(F.floor(F.col("_n") * F.lit(fraction)), F.lit(1))
    ).drop("_u", "_rank", "_n")


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows."""
    ranked = hash_ranked(rows.withColumn("_u", hash_unit(seed, F.col(key))), "_u", key, (), "_rank")
    return ranked.where(F.col("_rank") <= n).drop("_u", "_rank")


def duplicate_sample(rows: DataFrame, key: str, text: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Distinct (id, text) rows chosen for a second annotation."""
    return rows.select(key, text).distinct().where(hash_unit(seed, F.col(key)) < min(1.0, fraction))


def text_key(text: Column, label: Column) -> Column:
    return F.sha1(F.concat(F.lower(clean(text)), F.lit("|"), label.cast("int").cast("string")))


def disjoint_split(rows: DataFrame, label: str, text: str, test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """Split distinct texts, not rows, so that no text is on both sides."""
    keyed = rows.withColumn("text_key", text_key(F.col(text), F.col(label)))
    keys = keyed.groupBy("text_key").agg(F.min(label).alias("label"))
    assigned = stratified_split(keys, "label", "text_key", test_size, seed).select("text_key", "split")
    return keyed.join(assigned, "text_key")


def key_overlap(split_rows: DataFrame) -> DataFrame:
    """Texts per side and texts on both sides."""
    sides = split_rows.groupBy("text_key").agg(
        F.max((F.col("split") == "train").cast("int")).alias("a"),
        F.max((F.col("split") == "test").cast("int")).alias("b"),
    )
    return sides.agg(
        F.sum("a").alias("train_unique_text_keys"),
        F.sum("b").alias("test_unique_text_keys"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("text_key_overlap"),
    )


GROUPED, BY_ROW, FALLBACK = "grouped_text_key", "row_stratified", "row_stratified_fallback"


def _key_sides(keyed: DataFrame, test_size: float, seed: int) -> DataFrame:
    """(text_key, label, n, split): keys in hash order go to the test side while their rows fit into the label's quota.

    The first key of a label goes there whatever its rows, if the quota is not zero.
    """
    groups = materialise(keyed.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min("_label").alias("label"), F.count("*").alias("n")))
    quotas = _allocated(groups.groupBy("label").agg(F.sum("n").alias("available")), "available", test_size, "quota")
    cut = with_hash_piece(groups.withColumn("_u", hash_unit(seed, F.col("text_key"))), "_u")
    ordered = running_totals(cut, [F.col("_u"), F.col("text_key")], {"upto": F.col("n")}, ["label"])
    test = (F.col("quota") > 0) & ((F.col("upto") <= F.col("quota")) | (F.col("upto") == F.col("n")))
    side = F.when(test, "test").otherwise("train")
    return ordered.join(F.broadcast(quotas.select("label", "quota")), "label").select("text_key", "label", "n", side.alias("split"))


def split_mode(sides: DataFrame) -> DataFrame:
    """One row: the mode that sides of keys allow, and the rows of each side. A row for each label is all it looks at."""
    per = sides.groupBy("label").agg(
        F.sum(F.when(F.col("split") == "train", F.col("n")).otherwise(0)).alias("train"), F.sum(F.when(F.col("split") == "test", F.col("n")).otherwise(0)).alias("test")
    )
    total = per.agg(
        F.count("*").alias("labels"), F.count_if(F.col("train") > 0).alias("train_labels"), F.sum("train").alias("train"), F.sum("test").alias("test")
    )
    apart = (F.col("labels") >= 2) & (F.col("train_labels") >= 2) & (F.col("test") > 0)
    return total.select(F.when(apart, GROUPED).otherwise(FALLBACK).alias("mode"), "labels", "train", "test")


def split_rows(
    rows: DataFrame, label: str, text: str, key: str, test_size: float = 0.25, seed: int = 42, text_disjoint: bool = True
) -> DataFrame:
    """Add text_key, split and split_mode: texts apart if that is feasible, else rows stratified by label.

    Blank texts have no key and no side in a split of texts. That split needs two labels with keys, a
    test side, and two labels on the train side; otherwise all rows are split by label, whatever their
    texts. A single label is split as well. Rows without a label have no side.
    """
    blank = clean(F.coalesce(F.col(text), F.lit(""))) == ""
    keyed = rows.withColumns({"text_key": F.when(~blank, text_key(F.col(text), F.col(label))), "_label": F.col(label)}).where(F.col(label).isNotNull())
    mode = BY_ROW
    if text_disjoint:
        sides = materialise(_key_sides(keyed, test_size, seed))
        mode = split_mode(sides).first().mode
        if mode == GROUPED:
            return keyed.drop("_label").join(sides.select("text_key", "split"), "text_key").withColumn("split_mode", F.lit(mode))
    plan = _allocated(label_counts(keyed, label), "available", test_size, "test_rows")
    plan = plan.select("label", "test_rows", F.lit(0).cast("bigint").alias("val_rows"), F.col("available").alias("planned"))
    return quota_assignment(keyed.drop("_label"), label, key, plan, seed).withColumn("split_mode", F.lit(mode))


def label_summary(split_rows: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Rows and share of label 1 by split and label, by split, by label and in all, in one pass."""
    return (
        split_rows.select(F.col(split).alias("split"), F.col(label).alias("label"))
        .groupingSets([["split", "label"], ["split"], ["label"], []], "split", "label")
        .agg(
            F.when((F.grouping("split") == 0) & (F.grouping("label") == 0), "split_label").when(F.grouping("split") == 0, "split")
            .when(F.grouping("label") == 0, "label").otherwise("all").alias("level"),
            F.count("*").alias("rows"),
            F.avg((F.col("label") == 1).cast("double")).alias("positive_rate"),
        )
    )

"""Relational TF-IDF over long (document, term) tables.

A document is identified by the hash of its text, so equal texts are tokenised, weighted and
matched once, however many rows carry them; ``copies`` keeps corpus statistics exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.text import char_ngrams, word_ngrams
from ..session import materialise


@dataclass(frozen=True)
class VocabularyConfig:
    word_max_features: int = 40_000
    char_max_features: int = 30_000
    min_df: int = 2
    max_df: float = 1.0
    stop_words: tuple[str, ...] = terms.ENGLISH_STOP
    postings_per_task: int = 20_000


def document_key(text: Column) -> Column:
    return F.sha2(F.lower(text), 256)


def distinct_documents(df: DataFrame, text: str) -> DataFrame:
    """One row per distinct lower-cased text: doc_key, text, copies."""
    return df.groupBy(document_key(F.col(text)).alias("doc_key")).agg(
        F.any_value(F.lower(F.col(text))).alias("text"), F.count("*").alias("copies")
    )


def numbered(df: DataFrame, into: str) -> DataFrame:
    """Add a compact unique number; written out, so that it cannot change afterwards."""
    return materialise(df.withColumn(into, F.monotonically_increasing_id()))


def _counted(grams: Column) -> Column:
    """Distinct entries of an array with their number, from the runs of the sorted array: array of (term, tf)."""

    def runs(g: Column) -> Column:
        starts = F.filter(F.transform(g, lambda x, i: F.when((i == 0) | (x != F.get(g, i - 1)), i)), lambda i: i.isNotNull())
        ends = lambda s, j: F.coalesce(F.get(s, j + 1), F.size(g))
        # One-element arrays name what is used several times, so that it is computed once.
        each = lambda s: F.transform(s, lambda i, j: F.struct(F.get(g, i).alias("term"), (ends(s, j) - i).cast("long").alias("tf")))
        return F.flatten(F.transform(F.array(starts), each))

    return F.flatten(F.transform(F.array(F.sort_array(grams)), runs))


def split_repeats(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other row has, and those that share theirs (null is a key); None where all are the former."""
    repeated = materialise(docs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows")).where("_rows > 1").drop("_rows"))
    if repeated.isEmpty():
        return docs, None
    same = F.col(key).eqNullSafe(F.col("_key"))
    return docs.join(repeated, same, "left_anti"), docs.join(repeated, same, "left_semi")


def term_counts(
    docs: DataFrame, cfg: VocabularyConfig, views: tuple[str, ...] = ("w", "c"), key: str = "doc_id", unique: bool = False
) -> DataFrame:
    """Long table of term frequencies; the view (word or character) is the term's prefix.

    Rows that repeat a key are one document; others are counted row by row, and their terms are not shuffled. Where
    ``unique`` says that none repeats a key, none is looked for.
    """
    grams = []
    if "w" in views:
        grams.append(F.transform(word_ngrams(F.col("text"), cfg.stop_words), lambda g: F.concat(F.lit("w:"), g)))
    if "c" in views:
        grams.append(F.transform(char_ngrams(F.col("text")), lambda g: F.concat(F.lit("c:"), g)))
    single, several = (docs, None) if unique else split_repeats(docs, key)
    counts = single.select(key, "copies", F.inline(_counted(F.concat(*grams))))
    if several is None:
        return counts
    return counts.unionByName(
        several.select(key, "copies", F.explode(F.concat(*grams)).alias("term"))
        .groupBy(key, "copies", "term")
        .agg(F.count("*").alias("tf"))
    )


def term_stats(counts: DataFrame) -> DataFrame:
    """Document frequency and corpus count of every term."""
    return counts.groupBy("term").agg(
        F.sum("copies").alias("df"), F.sum(F.col("tf") * F.col("copies")).alias("total")
    )


#: Words that are counted at once.
COUNTED_WORDS = 1 << 19


def word_stats(docs: DataFrame, cfg: VocabularyConfig, key: str = "doc_id") -> DataFrame:
    """``term_stats`` of the word terms of ``term_counts``, without a row for each document and term.

    Words and pairs of them are counted as numbers; a batch gives one row for each of its distinct terms.
    """
    at_once = COUNTED_WORDS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stats(row: np.ndarray, code: np.ndarray, size: int, copies: np.ndarray) -> list[pa.Array]:
            """df and total of each code below ``size``, all of which occur."""
            once = np.unique(row * size + code)
            df = np.bincount(once % size, copies[once // size], size)
            return [pa.array(x.astype(np.int64)) for x in (df, np.bincount(code, copies[row], size))]

        for b in batches:
            lists = b.column(0)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            all_copies, run = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes) // at_once
            for cut in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(run)) + 1):
                words = lists.slice(cut[0], len(cut)).flatten().dictionary_encode() if len(cut) else ()
                if not len(words):
                    continue
                copies, known, code = all_copies[cut], words.dictionary, words.indices.to_numpy().astype(np.int64)
                row, n = np.repeat(np.arange(len(cut)), sizes[cut]), len(known)
                yield pa.RecordBatch.from_arrays([known, *stats(row, code, n, copies)], ["term", "df", "total"])
                same = row[1:] == row[:-1]
                pairs, code = np.unique((code[:-1] * n + code[1:])[same], return_inverse=True)
                if len(pairs):
                    text = pc.binary_join_element_wise(known.take(pa.array(pairs // n)), known.take(pa.array(pairs % n)), " ")
                    yield pa.RecordBatch.from_arrays([text, *stats(row[1:][same], code, len(pairs), copies)], ["term", "df", "total"])

    single, several = split_repeats(docs, key)
    words = word_ngrams(F.col("text"), cfg.stop_words, 1)
    out = single.select(words.alias("words"), "copies").mapInArrow(count, "term string, df bigint, total bigint")
    out = out.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).withColumn("term", F.concat(F.lit("w:"), "term"))
    if several is None:
        return out
    out = out.unionByName(term_stats(term_counts(several, cfg, ("w",), key)))
    return out.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def word_vocabulary(docs: DataFrame, cfg: VocabularyConfig) -> DataFrame:
    """``vocabulary`` of the word terms of documents, rows that repeat a doc_id being one."""
    return _vocabulary(word_stats(docs, cfg), docs, cfg, ("w",))


def vocabulary(counts: DataFrame, docs: DataFrame, cfg: VocabularyConfig, views: tuple[str, ...] = ("w", "c")) -> DataFrame:
    """Terms within the document-frequency bounds, the most frequent ones of each view, with idf.

    At most word_max_features + char_max_features rows, so it can always be broadcast (and its
    numbering window stays that small). Each of ``views`` reads the counts once, so name those that the counts have.
    """
    return _vocabulary(term_stats(counts), docs, cfg, views)


def _vocabulary(stats: DataFrame, docs: DataFrame, cfg: VocabularyConfig, views: tuple[str, ...]) -> DataFrame:
    n_docs = docs.agg(F.sum("copies").alias("n")).scalar()
    kept = (
        stats
        .withColumn("n_docs", n_docs)
        .where((F.col("df") >= cfg.min_df) & (F.col("df") <= cfg.max_df * F.col("n_docs")))
    )
    caps = {"w": cfg.word_max_features, "c": cfg.char_max_features}
    parts = [
        kept.where(F.col("term").startswith(f"{view}:")).orderBy(F.desc("total"), F.asc("term")).limit(caps[view]) for view in views
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .select(
            F.row_number().over(Window.orderBy("term")).alias("term_id"),
            "term",
            F.col("term").startswith("w:").alias("is_word"),
            "df",
            (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"),
        )
    )


def vectors(counts: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """One unit vector per document: each view normalised, then both together.

    ``vec`` is an array of (t, w, idf) structs, t being the term number.
    """
    weighted = counts.join(F.broadcast(vocab), "term").withColumn("w", F.col("tf") * F.col("idf"))
    square = F.col("w") * F.col("w")
    rows = weighted.groupBy(key).agg(
        F.collect_list(F.struct(F.col("term_id").alias("t"), "w", "idf", "is_word")).alias("raw"),
        F.sqrt(F.sum(F.when(F.col("is_word"), square).otherwise(0.0))).alias("word_norm"),
        F.sqrt(F.sum(F.when(F.col("is_word"), 0.0).otherwise(square))).alias("char_norm"),
    )
    views = F.sqrt((F.col("word_norm") > 0).cast("double") + (F.col("char_norm") > 0).cast("double"))

    def scaled(x: Column) -> Column:
        norm = F.when(x["is_word"], F.col("word_norm")).otherwise(F.col("char_norm"))
        return F.struct(x["t"].alias("t"), (x["w"] / norm / views).alias("w"), x["idf"].alias("idf"))

    return rows.select(key, F.transform("raw", scaled).alias("vec"))

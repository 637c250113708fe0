"""Exact top-k text-similarity join inside listing kinds, and the peer price built on it.

Queries and catalog are cut into blocks by their number of terms, and one task matches a block of queries
with a block of the catalog, of which it keeps the best of each query: pairs are never rows of a table.
For each query the most common terms are set aside while their joint weight stays below the similarity
floor. Two documents that share nothing else cannot reach the floor, so candidates come from the
remaining (rarer) terms only. Partial scores then bound each candidate from below and above; only
candidates that can still enter the pool have the set-aside terms added. Nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.text import clean
from ..session import materialise
from .catalog import allowed_kinds, global_rating_mean, normalized_kind, priced_catalog
from .ordering import top_per_group
from .tfidf import (
    VocabularyConfig, distinct_documents, document_key, numbered, term_counts, vectors, vocabulary,
)

SLACK = 1e-9
#: A block of queries and a block of the catalog take about so many times the vocabulary's ``postings_per_task`` terms
#: (12 bytes a term, and as much again for the block's own index).
QUERY_BLOCK, CATALOG_BLOCK = 50, 100
#: A scope with few blocks has its queries cut into so many pairs of blocks, for the sake of idle cores.
LEAST_PAIRS = 8


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 20
    pool_multiplier: int = 4
    min_similarity: float = 0.12
    allowed_kinds: tuple[str, ...] | None = None
    vocabulary: VocabularyConfig = field(default_factory=VocabularyConfig)

    @property
    def pool(self) -> int:
        return max(2, self.top_k * self.pool_multiplier + 1)


def _named_scopes(base: DataFrame) -> DataFrame:
    """Kinds with at least two rows; at most the seven named kinds."""
    return (
        base.groupBy("kind")
        .agg(F.count("*").alias("_n"))
        .where((F.col("_n") >= 2) & (F.col("kind") != "other"))
        .select("kind")
    )


def _scope_id(kind: Column) -> Column:
    """Number of a named kind; 0 stands for the whole catalog."""
    listed = F.array(*[F.lit(k) for k in terms.LISTING_KINDS])
    return F.coalesce(F.array_position(listed, kind), F.lit(0)).cast("int")


def _scope_name(scope_id: Column) -> Column:
    listed = F.array(*[F.lit(k) for k in terms.LISTING_KINDS])
    return F.coalesce(F.try_element_at(listed, F.nullif(scope_id, F.lit(0))), F.lit(""))


def _split_head(vec: Column, floor: float) -> Column:
    """Query terms from common to rare with the number of leading terms that can be set aside."""
    ordered = F.array_sort(F.transform(vec, lambda x: F.struct(x["idf"].alias("idf"), x["t"].alias("t"), x["w"].alias("w"))))
    limit = (floor * (1.0 - 1e-6)) ** 2
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(0).alias("n"), F.lit(0.0).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["w"] * x["w"]
        fits = seen <= limit
        return F.struct(
            seen.alias("seen"),
            (acc["n"] + fits.cast("int")).alias("n"),
            F.when(fits, seen).otherwise(acc["kept"]).alias("kept"),
        )

    cut = F.aggregate(ordered, start, step)
    return F.struct(ordered.alias("terms"), cut["n"].alias("n"), F.sqrt(cut["kept"]).alias("norm"))


def _block_counts(queries: DataFrame, catalog: DataFrame, query_terms: int, catalog_terms: int) -> DataFrame:
    """Number of blocks of queries and of the catalog in each scope that both have; one row a scope."""
    sized = lambda df, name: df.groupBy("scope_id").agg(F.sum(F.size("vec")).alias(name), F.count("*").alias(f"{name}_rows"))
    both = sized(queries, "_q").join(sized(catalog, "_c"), "scope_id")
    blocks = both.withColumn("_nc", F.greatest(F.ceil(F.col("_c") / catalog_terms), F.lit(1)).cast("int"))
    wanted = F.greatest(F.ceil(F.col("_q") / query_terms), F.ceil(F.lit(LEAST_PAIRS) / F.col("_nc")))
    return blocks.select("scope_id", "_nc", F.least(wanted, F.col("_q_rows")).cast("int").alias("_nq"))


def _block_matcher(pool: int, floor: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of a block of queries and one of the catalog: the pool of each query from this block."""

    def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        column = table.column(name).combine_chunks()
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes)).astype(np.int64)

    def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of all ranges, one after another."""
        sizes = ends - starts
        return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)

    def match(queries: pa.Table, catalog: pa.Table) -> pa.Table:
        # Rows of the catalog stand in the order that decides between equal similarities.
        catalog = catalog.take(pc.sort_indices(catalog, sort_keys=[("first_id", "ascending")], null_placement="at_start"))
        rows, (c_term, c_at) = len(catalog), lists(catalog, "t")
        c_weight = lists(catalog, "w")[0]
        order = np.argsort(c_term, kind="stable")
        (head, head_at), (tail, tail_at) = lists(queries, "head"), lists(queries, "tail")
        head_weight, tail_weight = lists(queries, "head_w")[0], lists(queries, "tail_w")[0]
        terms_end = 1 + max((int(x.max()) for x in (c_term, head, tail) if len(x)), default=0)
        listed = np.append(0, np.cumsum(np.bincount(c_term, minlength=terms_end)))
        row_of, weight_of = np.repeat(np.arange(rows), np.diff(c_at))[order], c_weight[order]
        aside = np.zeros(terms_end)
        tail_norm = queries.column("tail_norm").to_numpy()
        whose, what, scores = [], [], []
        for i in range(len(queries) if rows else 0):
            near, own = head[head_at[i] : head_at[i + 1]], head_weight[head_at[i] : head_at[i + 1]]
            at = ranges(listed[near], listed[near + 1])
            dot = np.bincount(row_of[at], weight_of[at] * np.repeat(own, listed[near + 1] - listed[near]), minlength=rows)
            room = tail_norm[i] + SLACK
            found = np.flatnonzero((dot > 0) & (dot >= floor - room))
            if len(found) > pool:
                # Certain members of the pool by partial score give the bar the others have to be able to pass.
                found = found[dot[found] >= np.partition(dot[found], len(found) - pool)[len(found) - pool] - room]
            if not len(found):
                continue
            common = tail[tail_at[i] : tail_at[i + 1]]
            aside[common] = tail_weight[tail_at[i] : tail_at[i + 1]]
            at = ranges(c_at[found], c_at[found + 1])
            ends = np.cumsum(c_at[found + 1] - c_at[found])
            rest = np.add.reduceat(aside[c_term[at]] * c_weight[at], np.append(0, ends[:-1]))
            aside[common] = 0.0
            similarity = np.round(np.minimum(dot[found] + rest, 1.0), 8)
            best = np.flatnonzero(similarity >= floor)
            best = best[np.argsort(-similarity[best], kind="stable")[:pool]]
            whose.append(np.full(len(best), i))
            what.append(found[best])
            scores.append(similarity[best])
        joined = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
        what = pa.array(joined(what, np.int64))
        return pa.table({
            "q_id": queries.column("q_id").take(pa.array(joined(whose, np.int64))), "c_id": catalog.column("c_id").take(what),
            "first_id": catalog.column("first_id").take(what), "similarity": pa.array(joined(scores, np.float64)),
        })

    return match


def similar_documents(queries: DataFrame, catalog: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """Top pool of catalog documents per query document: q_id, c_id, similarity.

    queries: q_id, scope_id, vec.  catalog: c_id, scope_id, vec, first_id. Both are read twice. Blocks are bounded
    by their terms, and so is a task's memory; shuffled are the blocks, once for each block of the other side, and
    at most a pool of rows for each query and block of the catalog.
    """
    terms_each = cfg.vocabulary.postings_per_task
    counts = F.broadcast(_block_counts(queries, catalog, QUERY_BLOCK * terms_each, CATALOG_BLOCK * terms_each))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda terms, name: F.transform(terms, lambda x: x[name])
    tail = F.slice("split.terms", F.lit(1), F.col("split.n"))
    head = F.slice("split.terms", F.col("split.n") + 1, F.size("split.terms"))
    q = queries.join(counts, "scope_id").withColumn("split", _split_head(F.col("vec"), cfg.min_similarity)).select(
        "scope_id", block("q_id", "_nq").alias("qb"), every("_nc").alias("cb"), "q_id", F.col("split.norm").alias("tail_norm"),
        part(head, "t").alias("head"), part(head, "w").alias("head_w"), part(tail, "t").alias("tail"), part(tail, "w").alias("tail_w"),
    )
    c = catalog.join(counts, "scope_id").select(
        "scope_id", every("_nq").alias("qb"), block("c_id", "_nc").alias("cb"), "c_id", "first_id",
        part(F.col("vec"), "t").alias("t"), part(F.col("vec"), "w").alias("w"),
    )
    pair = ["scope_id", "qb", "cb"]
    found = q.groupBy(*pair).cogroup(c.groupBy(*pair)).applyInArrow(
        _block_matcher(cfg.pool, cfg.min_similarity), "q_id long, c_id long, first_id string, similarity double"
    )
    return top_per_group(found, ["q_id"], [F.desc("similarity"), F.asc("first_id")], cfg.pool).drop("rank", "first_id")


@dataclass(frozen=True)
class RetrievalIndex:
    """Fitted retrieval model: vocabulary, document vectors per scope, and member rows.

    members: one row a product, its number m_id, parent_asin and the columns shown for a neighbour.
    links: the products (m_id, parent_asin) of each document c_id, so one or two rows a product.
    documents: c_id, scope_id, first_id, n_rows, vec (unit vectors).  vocab: term, term_id, idf.
    """

    vocab: DataFrame
    documents: DataFrame
    members: DataFrame
    links: DataFrame
    rating_mean: DataFrame
    cfg: RetrievalConfig

    PARTS = ("vocab", "documents", "members", "links", "rating_mean")

    @staticmethod
    def fit(catalog: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> "RetrievalIndex":
        """Index the priced rows of a catalog (unique parent_asin).

        A named kind with two or more rows indexes its own rows; scope 0 indexes all.
        """
        base = numbered(
            priced_catalog(catalog, cfg.allowed_kinds).select(
                normalized_kind(F.col("listing_kind")).alias("kind"),
                document_key(F.col("product_document")).alias("doc_key"),
                "parent_asin", "title", "store", "main_category", "listing_kind", "price",
                "average_rating", "review_count", "product_document",
            ),
            "m_id",
        )
        docs = numbered(distinct_documents(base, "product_document"), "doc_id")
        counts = materialise(term_counts(docs, cfg.vocabulary, unique=True))
        vocab = materialise(vocabulary(counts, docs, cfg.vocabulary))
        ids = base.select("kind", "doc_key", "parent_asin", "m_id")
        own = ids.join(F.broadcast(_named_scopes(base)), "kind", "left_semi").withColumn("scope_id", _scope_id(F.col("kind")))
        scoped = own.unionByName(ids.withColumn("scope_id", F.lit(0))).drop("kind")
        groups = numbered(scoped.groupBy("scope_id", "doc_key").agg(F.min("parent_asin").alias("first_id"), F.count("*").alias("n_rows")), "c_id")
        doc_vectors = docs.select("doc_key", "doc_id").join(vectors(counts, vocab), "doc_id").drop("doc_id")
        documents = materialise(groups.join(doc_vectors, "doc_key").drop("doc_key"))
        links = materialise(scoped.join(groups.select("scope_id", "doc_key", "c_id"), ["scope_id", "doc_key"]).select("c_id", "m_id", "parent_asin"))
        members = base.drop("kind", "doc_key", "product_document")
        return RetrievalIndex(vocab, documents, members, links, global_rating_mean(base), cfg)

    def save(self, path: str) -> None:
        for part in self.PARTS:
            getattr(self, part).write.mode("overwrite").parquet(f"{path}/{part}")

    @staticmethod
    def load(spark: SparkSession, path: str, cfg: RetrievalConfig = RetrievalConfig()) -> "RetrievalIndex":
        return RetrievalIndex(
            *[spark.read.parquet(f"{path}/{part}") for part in RetrievalIndex.PARTS], cfg
        )


def neighbours(queries: DataFrame, index: RetrievalIndex, cfg: RetrievalConfig | None = None, key: str = "parent_asin") -> DataFrame:
    """Up to k most similar indexed rows per query row, of the same listing kind.

    Queries need parent_asin, listing_kind and product_document. A kind that the index does not
    name searches the whole catalog; a kind that is not allowed finds nothing. ``cfg`` may
    override k and the similarity floor of the index. ``key`` names the unique query key that the
    result carries as query_id; parent_asin only keeps a query from finding its own product, and
    queries may share it.
    """
    cfg = cfg or index.cfg
    named = index.documents.where(F.col("scope_id") > 0).select("scope_id").distinct()
    asks = queries.select(
        F.col(key).alias("query_id"),
        F.col("parent_asin").alias("own"),
        normalized_kind(F.col("listing_kind")).alias("kind"),
        document_key(F.col("product_document")).alias("doc_key"),
        F.lower("product_document").alias("text"),
    ).withColumn("_scope", _scope_id(F.col("kind")))
    allowed = allowed_kinds(cfg.allowed_kinds)
    if allowed is not None:
        asks = asks.where(F.col("kind").isin(*allowed))
    asks = asks.join(F.broadcast(named.withColumnRenamed("scope_id", "_named")), F.col("_scope") == F.col("_named"), "left")
    asks = asks.select("query_id", "own", "doc_key", "text", F.coalesce("_named", F.lit(0)).alias("scope_id"))
    ask_docs = numbered(
        asks.groupBy("scope_id", "doc_key").agg(F.any_value("text").alias("text"), F.lit(1).alias("copies")), "q_id"
    )
    ask_vectors = vectors(term_counts(ask_docs, cfg.vocabulary, key="q_id", unique=True), index.vocab, "q_id")
    query_docs = materialise(ask_docs.select("q_id", "scope_id").join(ask_vectors, "q_id"))
    best = similar_documents(query_docs, index.documents, cfg)

    # Expand to rows: documents that follow a whole pool of more similar rows cannot matter, and of the
    # others at most pool members, the lowest ids first.
    sized = best.join(index.documents.select("c_id", F.least("n_rows", F.lit(cfg.pool)).alias("n_rows")), "c_id")
    above = Window.partitionBy("q_id").orderBy(F.desc("similarity"))
    sized = sized.withColumn("so_far", F.sum("n_rows").over(above)).withColumn(
        "equal", F.sum("n_rows").over(Window.partitionBy("q_id", "similarity"))
    )
    best = materialise(sized.where(F.col("so_far") - F.col("equal") < cfg.pool).select("q_id", "c_id", "similarity"))
    # The pool of a query document is one row; each query takes its neighbours from it, and only those get their columns.
    rows = top_per_group(index.links, ["c_id"], [F.asc("parent_asin")], cfg.pool).drop("rank")
    pool = top_per_group(best.join(rows, "c_id"), ["q_id"], [F.desc("similarity"), F.asc("parent_asin")], cfg.pool)
    pool = pool.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "parent_asin", "m_id", "similarity"))).alias("pool"))
    others = F.slice(F.filter("pool", lambda x: x["parent_asin"] != F.col("own")), 1, cfg.top_k)
    matched = (
        asks.select("query_id", "own", "scope_id", "doc_key")
        .join(ask_docs.select("q_id", "scope_id", "doc_key"), ["scope_id", "doc_key"])
        .join(pool, "q_id")
        .select("query_id", "scope_id", F.explode(others).alias("x"))
        .select("query_id", "x.parent_asin", "x.m_id", "x.similarity", _scope_name(F.col("scope_id")).alias("retrieval_listing_kind"))
    )
    first = top_per_group(matched, ["query_id"], [F.desc("similarity"), F.asc("parent_asin")], cfg.top_k).drop("parent_asin")
    return first.join(index.members, "m_id").select(
        "query_id", "rank", "parent_asin", "title", "store", "main_category", "listing_kind",
        "price", "similarity", "average_rating", "review_count", "retrieval_listing_kind",
    )


def market_context(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Similarity-weighted peer price, mean similarity and neighbour count per query row."""
    agg = found.groupBy(F.col("query_id").alias("parent_asin")).agg(
        F.try_divide(F.sum(F.col("price") * F.col("similarity")), F.sum("similarity")).alias("peer_price"),
        F.count("*").alias("neighbor_count"),
        F.avg("similarity").alias("average_neighbor_similarity"),
        F.max("retrieval_listing_kind").alias("retrieval_listing_kind"),
    )
    return queries.join(agg, "parent_asin", "left").withColumns(
        {
            "neighbor_count": F.coalesce("neighbor_count", F.lit(0)),
            "average_neighbor_similarity": F.coalesce("average_neighbor_similarity", F.lit(0.0)),
            "retrieval_listing_kind": F.coalesce("retrieval_listing_kind", F.lit("")),
        }
    )


def neighbour_lists(found: DataFrame) -> DataFrame:
    """Neighbour rows as one rank-ordered list per query (at most k entries)."""
    entry = F.struct("rank", "parent_asin", "price", "similarity")
    return found.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("neighbors"))


def embedding_document(title: Column, bullets: Column, description: Column) -> Column:
    """Text handed to an encoder: one pair of brackets stripped, white space collapsed."""
    def part(c: Column) -> Column:
        bare = F.regexp_replace(clean(c), r"^\[(.*)\]$", "$1")
        return F.trim(bare)

    return F.concat(
        F.lit("Title: "), part(title), F.lit(" | Bullet Points: "), part(bullets),
        F.lit(" | Description: "), part(description),
    )

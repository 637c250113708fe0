"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside cells, one representative per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from meritlens.llm.common import components, group_apart, materialise

LINK = 0.98
#: Vectors in a cell, about; no more than CELLS cells in all (the only data that is broadcast: CELLS centroids).
CELL, CELLS = 512, 1 << 14
#: Centroids of a label are fitted on so many of its vectors, the first by the hash of their ids and components.
SAMPLE, ROUNDS = 1 << 14, 8
#: Rows compared with all centroids of their label at once.
AT_ONCE = 1024
#: Rows on either side of a block product.
BLOCK = 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; scaled by their largest component first."""
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors. Starts from rows spread over the input; an empty cell keeps its centroid."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        home = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(size > 1e-12, sums / np.where(size > 1e-12, size, 1), centroids)
    return centroids


def drawn(classes: DataFrame, sizes: DataFrame) -> DataFrame:
    """About twice the sample of every label and dimension in ``sizes``, by hash, so that no window orders a whole label."""
    rows = classes.join(sizes, ["label", "dim"]).withColumn("u", F.xxhash64("rep", "v"))
    return rows.where((F.col("u") / 2.0**64 + 0.5) * F.col("n") <= 2 * SAMPLE)


def _fit(classes: DataFrame, cell: int) -> dict[tuple[int, int], np.ndarray]:
    """Centroids by (label, dimension), for those with more vectors than one cell holds."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    by_hash = Window.partitionBy("label", "dim").orderBy("u", "rep")
    sample = drawn(classes, sizes).withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= SAMPLE)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        k = min(-(-int(pdf["n"].iloc[0]) // cell), max(1, len(pdf) // 8))
        pdf = pdf.sort_values("r")
        got = spherical_kmeans(unit(np.stack(pdf["v"].to_numpy())), k)
        return pd.DataFrame({"label": pdf["label"].iloc[0], "dim": pdf["dim"].iloc[0], "cell": range(len(got)), "c": list(got)})

    rows = sample.groupBy("label", "dim").applyInPandas(fit, "label int, dim int, cell int, c array<double>").collect()
    out: dict[tuple[int, int], list] = {}
    for r in sorted(rows, key=lambda r: r.cell):
        out.setdefault((r.label, r.dim), []).append(r.c)
    return {k: np.array(v) for k, v in out.items()}


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", link: float = LINK) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null and their dimensions agree, by
    cosine in double precision. Equal vectors are one class. A class is at home in the cell of its
    nearest centroid and visits every other cell whose border is so near that a vector with cosine
    ``link`` to it could be at home there, so all its links are found in its home cell and none is
    lost. A cell's rows are cut into blocks and block pairs are multiplied; a block pair sends on
    the number of links of each row and one link per row that holds its local components together.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label, link with nothing. Ids are integers and may repeat: rows with equal vectors and labels
    are linked, whatever their ids. A null id counts as the smallest. Extra columns are ignored; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("int").alias("label"))
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & ~wrong
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = group_apart(rows.where("good"), ["label", "v"], F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = materialise(classes.withColumn("dim", F.size("v")))
    named = rows.where("good").select("id", "label", "v").join(classes.select("label", "v", "rep", "copies"), ["label", "v"])
    named = materialise(named.select("id", "rep", "copies").union(rows.where("NOT good").select("id", F.lit(None).cast("long"), F.lit(1).cast("long"))))
    # A representative of two classes (a repeated id) stands for both; its links are those of either.
    cell = max(CELL, -(-classes.count() // CELLS))
    centroids = spark.sparkContext.broadcast(_fit(classes, cell))
    reach = float(np.sqrt(1 - link * link)) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            take, cells, home = [], [], []
            for pair in set(zip(label.tolist(), dim.tolist(), strict=True)):
                own = np.flatnonzero((label == pair[0]) & (dim == pair[1]))
                c = centroids.value.get(pair)
                if c is None:
                    take.append(own)
                    cells.append(np.zeros(len(own), np.int32))
                    home.append(np.ones(len(own), bool))
                    continue
                for start in range(0, len(own), AT_ONCE):
                    some = own[start : start + AT_ONCE]
                    every = np.arange(len(some))
                    flat = batch.column("v").take(pa.array(some)).flatten().to_numpy().reshape(len(some), pair[1])
                    near = unit(flat) @ c.T
                    best = near.argmax(axis=1)
                    apart = np.sqrt(np.maximum(2 - 2 * (c[best] @ c.T), 0))
                    visits = near[every, best][:, None] - near <= reach * apart + 1e-9
                    visits[every, best] = True
                    i, j = np.nonzero(visits)
                    take.append(some[i])
                    cells.append(j.astype(np.int32))
                    home.append(best[i] == j)
            take = np.concatenate(take)
            part = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(cells)), pa.array(np.concatenate(home))], [*part.schema.names, "cell", "home"])

    kept = classes.select("rep", "copies", "label", "dim", "v")
    placed = materialise(kept.mapInArrow(place, StructType([*kept.schema, StructField("cell", IntegerType()), StructField("home", BooleanType())])))
    place_key = ["label", "dim", "cell"]
    counts = group_apart(placed, place_key, F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    dealt = placed.join(counts.select(*place_key, blocks("homes").alias("nh"), blocks("all").alias("nm")).where("nh > 0"), place_key)
    dealt = dealt.withColumns({"h": F.when(F.col("home"), F.pmod(F.xxhash64("rep"), "nh")).otherwise(-1), "m": F.pmod(F.xxhash64("rep", F.lit(1)), "nm")})
    pairs = F.expr(
        "array_union(IF(home, transform(sequence(0, nm - 1), j -> struct(CAST(h AS INT) AS i, j AS j)), array()),"
        " transform(sequence(0, nh - 1), i -> struct(i AS i, CAST(m AS INT) AS j)))"
    )
    dealt = dealt.select(*place_key, "rep", "copies", "v", "h", "m", F.explode(pairs).alias("b")).select("*", "b.i", "b.j").drop("b")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        x = unit(np.stack(pdf["v"].to_numpy()))
        q = np.flatnonzero((pdf["h"] == pdf["i"]).to_numpy())
        m = np.flatnonzero((pdf["m"] == pdf["j"]).to_numpy())
        linked = x[q] @ x[m].T >= link
        linked &= q[:, None] != m[None, :]
        low = ids.copy()
        a, b = np.nonzero(linked)
        a, b = q[a], m[b]
        while len(a):  # smallest id of each local component
            before = low.copy()
            np.minimum.at(low, a, before[b])
            np.minimum.at(low, b, before[a])
            if (before == low).all():
                break
        links = np.zeros(len(ids), np.int64)
        links[q] = linked @ copies[m]
        return pd.DataFrame({"id": ids, "links": links, "to": low})[(links > 0) | (low != ids)]

    found = materialise(dealt.groupBy(*place_key, "i", "j").applyInPandas(product, "id long, links long, to long"))
    degrees = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    grown = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")).where("a != b").distinct())
    out = named.join(degrees, "rep", "left").join(grown.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(
        "id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def op6_embedding_dedup(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors).withColumnRenamed("id", "vec_id")


OP6_SQL = """
WITH v AS (
  SELECT vec_id, label, CASE WHEN label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e
  FROM embeddings
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  WITH RECURSIVE walk(node, seen) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT walk.node, l.y FROM walk JOIN l ON l.x = walk.seen
  ) SELECT node, min(seen) AS component_id FROM walk GROUP BY node
), d AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM v JOIN r ON r.node = vec_id LEFT JOIN d ON d.x = vec_id
"""

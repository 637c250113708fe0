"""Near duplicates by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlens.llm.common import bit_table, components, fresh, frugal, group_apart, materialise, maybe_member, text_batches
from meritlens.llm.words import chunks, mixed, slice_hashes, split_words

#: Bands of ROWS coordinates: a pair at the similarity 0.8 shares none with probability 1.2e-7.
BANDS, ROWS = 40, 5
#: Positions of the second permutation; the first one is a bijection of 64-bit hashes, cut to so many.
PLACES = 1 << 20
#: Places of tokens that are told apart by what labels have them, and places of a row between tasks.
TOKEN_PLACES, BLOCK = 1 << 22, 1 << 12
#: Rounds in which a bucket compares one pivot with its other components, before the rest is searched by rare shingles.
PIVOTS = 1
_ORDER = 0xD6E8FEB86659FD93  # odd multiples of it tell the words of a shingle apart
_SECOND = np.random.default_rng(1009).permutation(PLACES).astype(np.int32)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; with fewer words, of all its words as one."""
    data, start, end, count = split_words(texts)
    hashes = slice_hashes(data, start, end)
    total = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words if len(total) else 0):
        total += hashes[k : len(total) + k] * np.uint64(_ORDER * (2 * k + 1) % (1 << 64))
    total = mixed(total)
    out, at = [], 0
    for n in count.tolist():
        if n >= words:
            out.append(np.unique(total[at : at + n - words + 1]))
        elif n:
            few = sum((h * _ORDER * (2 * k + 1) for k, h in enumerate(hashes[at : at + n].tolist())), n)
            out.append(mixed(np.array([few % (1 << 64)], np.uint64)))
        else:
            out.append(total[:0])
        at += n
    return out


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the minimum of the second permutation, shifted by k, over the permuted set.

    The shifted values of one element lie next to each other, so all coordinates come from one slice
    of the permutation for each shingle.
    """
    ring = np.concatenate([_SECOND, _SECOND[:coordinates]])
    shifted = np.lib.stride_tricks.sliding_window_view(ring, coordinates)
    place = (mixed(shingles ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(44)).astype(np.int64)
    low = np.full(coordinates, PLACES, np.int32)
    for start in range(0, len(place), 2048):
        np.minimum(low, shifted[place[start : start + 2048]].min(axis=0), out=low)
    return low


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """For each row: size and two hashes of its shingle set, and a key for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column(1), words)
                size = np.array([len(s) for s in sets], np.int64)
                full = [i for i, s in enumerate(sets) if len(s)]
                one = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                two = np.array([np.bitwise_xor.reduce(s * np.uint64(0x9FB21C651E98DF25)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                drawn = np.array([signature(sets[i], bands * rows) for i in full], np.uint64).reshape(len(full), bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(full), bands)).copy()
                for r in range(rows):
                    key = mixed(key * np.uint64(PLACES * 4 + 1) + drawn[:, :, r])
                ends = np.zeros(len(sets) + 1, np.int32)
                ends[1:] = np.cumsum(np.where(size > 0, bands, 0))
                lists = pa.ListArray.from_arrays(ends, pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(one), pa.array(two), lists], ["id", "n", "h1", "h2", "keys"])

    return docs.mapInArrow(frugal(run), "id long, n long, h1 long, h2 long, keys array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column(1), words)
                ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "s"])

    return docs.mapInArrow(frugal(run), "id long, s array<long>")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Linked are rows whose sets of word shingles (A-Z lower-cased) have 100 * intersection >= percent
    * union. Equal sets are one class with its smallest id as representative. Representatives that
    share a band are candidates; in each bucket a pivot is compared with all members of other
    components and links join components. After PIVOTS rounds, each linear in the size of a bucket,
    what is left are members of different components that no pivot has met: of those, pairs that share
    one of their rarest shingles are compared. Sets of the asked similarity always do, and passages
    that many documents share do not make pairs.
    All links are confirmed on the full sets, which are computed again from the texts of candidates
    only.

    A null, empty or blank text has no shingles and links with nothing; fewer than ``words`` words
    are one shingle. Ids are integers; rows that repeat an id are one node with several texts, and
    each row is returned. Rows with a null id are nodes of their own and are returned with their
    size, a null component and kept = true. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    source = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    signed = materialise(_signed(source, words, bands, rows))
    classes = group_apart(signed.where("n > 0 AND id IS NOT NULL"), ["n", "h1", "h2"], F.min("id").alias("rep"))
    nodes = materialise(
        signed.join(classes, ["n", "h1", "h2"], "left").select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("keys")).alias("keys"))
    )
    reps = nodes.where("keys IS NOT NULL").select("id", "n", F.explode("keys").alias("key")).distinct()
    shared = group_apart(reps, ["key"], F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    members = materialise(reps.join(shared, "key").select("key", "id", "n", F.col("id").alias("label"), F.lit(False).alias("used")))
    at_hand = bit_table(members, F.xxhash64("id"))
    sets = materialise(_sets(maybe_member(source, F.xxhash64("id"), at_hand, "hit").where("hit").select("id", "t"), words))

    links = []
    while True:
        # Members of different components that no pivot has met, by bucket.
        spread = members.where("NOT used").groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key")
        spread = spread.agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))
        left, size = spread.agg(F.sum("pairs")).first()[0] or 0, members.count()
        if left == 0:
            break
        last = len(links) >= PIVOTS or left <= max(1000, size)
        if last:
            pairs = _by_rare_shingles(members.where("NOT used").select("id", "label").distinct(), sets, percent)
        else:
            pivots = group_apart(members.where("NOT used"), ["key"], F.min(F.struct("label", "id", "n")).alias("pivot"))
            met = members.join(pivots, "key")
            pairs = met.where("label != pivot.label").select(F.col("pivot.id").alias("p"), F.col("id").alias("x"), F.col("pivot.n").alias("pn"), "n")
            pairs = pairs.where(f"100 * least(n, pn) >= {percent} * greatest(n, pn)").select("p", "x").distinct()
        found = materialise(_linked(materialise(pairs), sets, percent))
        links.append(found)
        if last:
            break
        relabelled = components(_union(links), "p", "x")
        grown = relabelled.select(F.col("node").alias("id"), F.col("component").alias("to"))
        members = met.withColumn("used", F.col("used") | (F.col("id") == F.col("pivot.id"))).drop("pivot", "label")
        members = members.join(grown, "id", "left").withColumn("label", F.coalesce("to", "id")).drop("to")
        still = group_apart(members.where("NOT used"), ["key"], F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        members = materialise(members.join(still.select("key"), "key").select("key", "id", "n", "label", "used"))
    if links:
        grown = components(_union(links), "p", "x").withColumnRenamed("node", "rep")
        nodes = nodes.join(grown, "rep", "left")
    else:
        nodes = nodes.withColumn("component", F.lit(None).cast("long"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return nodes.select(
        "id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def _by_rare_shingles(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (p, x) of different labels that may reach the similarity, by the rarest shingles of their sets.

    Two sets of that similarity share a shingle among the first n - ceil(n * percent / 100) + 1 of
    each in any common order, and what may follow that shingle bounds their intersection. The order
    here is by the counts of a table of fixed size, then by hash, so it needs no join.
    """
    spark = nodes.sparkSession
    ids = bit_table(nodes, F.xxhash64("id"))
    own = materialise(maybe_member(sets, F.xxhash64("id"), ids, "hit").where("hit").drop("hit").join(nodes, "id").select("id", "label", "s"))

    def everywhere(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        place = (batch.column("s").flatten().to_numpy().view(np.uint64) >> np.uint64(44)).astype(np.int64)
        return place, np.ones(len(place), np.int64)

    table = np.zeros(PLACES, np.int64)
    for place, count in _by_place(own, everywhere, [np.add]):
        table[place] = count
    shared = spark.sparkContext.broadcast(table)

    def first(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Row, rank, size and token of the rarest shingles of all sets of a batch."""
        at, rank, size, token = ([np.zeros(0, np.int64)] for _ in range(4))
        for i, s in enumerate(batch.column("s")):
            s = s.values.to_numpy().view(np.uint64)
            n = len(s)
            rarest = np.lexsort((s, shared.value[(s >> np.uint64(44)).astype(np.int64)]))[: n - -(-n * percent // 100) + 1]
            at.append(np.full(len(rarest), i))
            rank.append(np.arange(len(rarest)))
            size.append(np.full(len(rarest), n))
            token.append(s[rarest].view(np.int64))
        return tuple(np.concatenate(x) for x in (at, rank, size, token))

    def labelled(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        at, _, _, token = first(batch)
        label = batch.column("label").to_numpy()[at]
        return _token_place(token), label, label

    # Places at which the rarest shingles of several labels lie; a shingle that one label has alone gives no pair.
    several = np.zeros(TOKEN_PLACES, bool)
    for place, low, high in _by_place(own, labelled, [np.minimum, np.maximum]):
        several[place[low < high]] = True
    useful = spark.sparkContext.broadcast(np.packbits(several))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(useful.value).view(bool)
        for batch in batches:
            at, rank, size, token = first(batch)
            hit = bits[_token_place(token)]
            rows = pa.array(at[hit])
            columns = [batch.column("id").take(rows), batch.column("label").take(rows), *(pa.array(c[hit]) for c in (rank, size, token))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "rank", "n", "token"])

    rare = own.mapInArrow(frugal(run), "id long, label long, rank long, n long, token long")
    several = group_apart(rare, ["token"], F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    rare = materialise(rare.join(several, "token"))
    a, b = rare.alias("a"), rare.alias("b")
    room = "least(a.n - a.rank, b.n - b.rank)"  # this shingle and all after it
    fits = f"{100 + percent} * ({room}) >= {percent} * (a.n + b.n) AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)"
    met = a.join(b, F.expr(f"a.token = b.token AND a.id < b.id AND a.label != b.label AND {fits}"))
    return met.select(F.col("a.id").alias("p"), F.col("b.id").alias("x")).distinct()


def _token_place(token: np.ndarray) -> np.ndarray:
    return (mixed(token.view(np.uint64)) % np.uint64(TOKEN_PLACES)).astype(np.int64)


def _by_place(df: DataFrame, read: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], merge: list[np.ufunc]) -> Iterator[tuple[np.ndarray, ...]]:
    """Places and their values (integers), merged over all rows, block by block of places.

    ``read`` gives places and values of a batch. A task merges its own before it sends them, as a row a block, so neither
    the rows sent nor what the caller gets grow with the number of values.
    """

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        place, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(place, kind="stable")
        place, start = np.unique(place[order], return_index=True)
        return place, *(f.reduceat(v[order], start) if len(place) else v for f, v in zip(merge, values, strict=True))

    def rows(parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        block, start = np.unique(parts[0] // BLOCK, return_index=True)
        ends = np.append(start, len(parts[0])).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(block), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in parts)], names)

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = None
        for batch in batches:
            own = read(batch)
            so_far = merged([own] if so_far is None else [so_far, own])
        if so_far is not None:
            yield rows(so_far)

    def in_block(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([rows(merged([tuple(table.column(c).combine_chunks().flatten().to_numpy() for c in names[1:])]))])

    names = ["block", "place", *(f"v{i}" for i in range(len(merge)))]
    schema = ", ".join(["block long", *(f"{c} array<long>" for c in names[1:])])
    found = df.mapInArrow(frugal(in_task), schema).groupBy("block").applyInArrow(in_block, schema).toArrow()
    for row in found.to_batches():
        for i in range(len(row)):
            yield tuple(row.column(c)[i].values.to_numpy() for c in names[1:])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, x) whose sets reach the similarity."""

    ids = bit_table(pairs.select(F.explode(F.array("p", "x")).alias("i")), F.xxhash64("i"))
    near = maybe_member(sets, F.xxhash64("id"), ids, "hit").where("hit").drop("hit")
    both = pairs.join(near.withColumnsRenamed({"id": "x", "s": "sx"}), "x").join(near.withColumnsRenamed({"id": "p", "s": "sp"}), "p")
    met = F.size(F.array_intersect("sx", "sp"))
    linked = both.where(100 * met >= percent * (F.size("sx") + F.size("sp") - met))
    # Repeated ids repeat pairs. The pairs are not grouped where the join left them: a pivot's rows may be split.
    return group_apart(linked, ["p", "x"], F.count("*").alias("c")).drop("c")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` whose id stands for its group; only rows whose id may be dropped meet the list of dropped ids."""
    own, maybe = fresh(docs, "_id", "_maybe")
    gone = materialise(near_duplicates(docs, id_col, **options).where("NOT kept").select(F.col("id").alias(own)).distinct())
    marked = maybe_member(docs, F.xxhash64(F.col(id_col).cast("long")), bit_table(gone, F.xxhash64(own)), maybe)
    checked = marked.where(F.col(maybe)).join(gone, F.col(id_col) == F.col(own), "left_anti")
    return marked.where(~F.col(maybe)).unionByName(checked).drop(maybe)


def op1_minhash_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, words=4).withColumnRenamed("id", "doc_id")


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh
  FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), b AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (
  WITH RECURSIVE walk(node, seen) AS (
    SELECT doc_id, doc_id FROM n UNION SELECT walk.node, b.y FROM walk JOIN b ON b.x = walk.seen
  ) SELECT node, min(seen) AS component_id FROM walk GROUP BY node
)
SELECT n.doc_id, n.n AS n_shingles, component_id, component_id = n.doc_id AS kept FROM n JOIN r ON r.node = n.doc_id
"""

"""Merkle manifest of a dataset: a tree of SHA-256 whose parents keep the hash state before each child.

A parent hashes its children one after the other and keeps a copy of the running state before each
slot. To fold a replaced child, the state kept at its slot is resumed with the replacement and the
siblings to its right only. Leaves are cut into blocks of FANOUT ** LEVELS consecutive ones; a task
builds the lower levels of a block, the digests of blocks are the leaves of the next stage, and the
path from a block to the root comes back as one row a block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlens.llm.common import materialise, numbered

#: Children of a parent, and levels that one task builds (8 ** 4 leaves).
FANOUT, LEVELS = 8, 4
_PATH = "array<struct<slot int, run array<string>>>"


def field(c: Column) -> Column:
    """A value as it is hashed: its bytes behind their count, or a dash for null."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


class Parent:
    """A parent of a run of children: its digest, and the states before each of them."""

    __slots__ = ("run", "states", "right", "others", "digest")

    def __init__(self, run: list[str]) -> None:
        self.run, self.states = run, []
        state = hashlib.sha256()
        for child in run:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()
        self.right = ["".join(run[i + 1 :]).encode() for i in range(len(run))]
        self.others = ["".join(run[:i] + run[i + 1 :]).encode() for i in range(len(run))]

    def resumed(self, slot: int, replacement: str) -> str:
        """The digest with another child in a slot."""
        state = self.states[slot].copy()
        state.update(replacement.encode())
        state.update(self.right[slot])
        return state.hexdigest()


def depth(leaves: int, fanout: int = FANOUT) -> int:
    """Levels of parents above so many leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // fanout), levels + 1
    return levels


def grown(leaves: list[str], levels: int, fanout: int = FANOUT) -> list[list[Parent]]:
    """So many levels of parents above a run of leaves, the lowest first."""
    out = []
    for _ in range(levels):
        out.append([Parent(leaves[i : i + fanout]) for i in range(0, len(leaves), fanout)])
        leaves = [p.digest for p in out[-1]]
    return out


def _levels_here(n: int, fanout: int, levels: int) -> int:
    """Levels of a tree of n leaves that lie inside a block."""
    return min(levels, depth(n, fanout))


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("at")


def _stages(leaves: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """(tree, at, n, digest) of the leaves and of the blocks of each stage, until every tree is one node."""

    def top(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        tree, at, n, run = (table.column(c).to_pylist() for c in ("tree", "at", "n", "digest"))
        above = grown(run, _levels_here(n[0], fanout, levels), fanout)
        digest = above[-1][0].digest if above else run[0]
        return pa.table({"tree": tree[:1], "at": [at[0] // fanout**levels], "n": [-(-n[0] // fanout**levels)], "digest": [digest]})

    stages = [leaves]
    while (stages[-1].agg(F.max("n")).first()[0] or 0) > 1:
        blocks = stages[-1].select("tree", "at", "n", "digest").groupBy("tree", (F.col("at") / fanout**levels).cast("long").alias("block"))
        stages.append(materialise(blocks.applyInArrow(top, "tree string, at long, n long, digest string")))
    return stages


def _with_paths(children: DataFrame, parents: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Paths of a stage's nodes: their way through their block, then that of the block."""

    def paths(key: tuple, rows: pa.Table, block: pa.Table) -> pa.Table:
        rows = _ordered(rows)
        tree, at, n, run = (rows.column(c).to_pylist() for c in ("tree", "at", "n", "digest"))
        above, rest = grown(run, _levels_here(n[0], fanout, levels), fanout), block.column("path")[0].as_py()
        own = []
        for i in range(len(run)):
            steps = [{"slot": i // fanout**k % fanout, "run": level[i // fanout ** (k + 1)].run} for k, level in enumerate(above)]
            own.append(steps + rest)
        same = {c: [block.column(c)[0].as_py()] * len(run) for c in ("subroot", "root")}
        return pa.table({"tree": tree, "at": at, "path": pa.array(own, block.schema.field("path").type), **same})

    here = children.groupBy("tree", (F.col("at") / fanout**levels).cast("long").alias("block"))
    return materialise(here.cogroup(parents.groupBy("tree", "at")).applyInArrow(paths, f"tree string, at long, path {_PATH}, subroot string, root string"))


def _downwards(stages: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Paths of the lowest blocks (the stage above the leaves), or of the trees where the leaves are the only stage."""
    for stage in reversed(stages[1:-1]):
        top = _with_paths(stage, top, fanout, levels)
    return top


def build(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """Stages of all trees, and (tree, at, path, subroot, root): the path of every lowest block to the root.

    ``leaves`` (tree, at, n, digest) are numbered from 0 in their tree. The subroots of the trees, in
    the order of the trees' names, are the leaves of a last tree whose top is the root.
    """
    stages = _stages(leaves, fanout, levels)
    subroots = stages[-1].select(F.col("tree").alias("name"), F.col("digest").alias("subroot"))
    named = numbered(subroots.withColumn("tree", F.lit("")), ["tree"], ["name"])
    named = materialise(named.select("tree", "name", F.col("_at").alias("at"), F.col("_n").alias("n"), F.col("subroot").alias("digest")))
    upper = _stages(named, fanout, levels)
    top = upper[-1].select("tree", "at", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    top = _downwards([named.select("tree", "at", "n", "digest"), *upper[1:]], top, fanout, levels)
    if len(upper) > 1:
        top = _with_paths(named.select("tree", "at", "n", "digest"), top, fanout, levels)
    top = named.select("at", "name", "digest").join(top.drop("tree", "subroot"), "at")
    top = materialise(top.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot"), "root"))
    return stages, _downwards(stages, top, fanout, levels)


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The nodes that a dataset's manifest keeps: (tree, stage, at, digest) of the leaves, of the blocks of each stage and of the subroots."""
    stages, _ = build(leaves, fanout, levels)
    out = [s.select("tree", F.lit(k).alias("stage"), "at", "digest") for k, s in enumerate(stages)]
    for s in out[1:]:
        out[0] = out[0].union(s)
    return out[0]


def audit(
    docs: DataFrame, id_col: str, tree_col: str, leaf: Column, claimed: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS
) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are numbered by id within their tree (a value of ``tree_col``; null is a tree, the first).
    While a level has several nodes, every ``fanout`` consecutive ones have a parent, the digest of
    their digests; a tree of one leaf is that leaf. ``proof_sha256`` hashes the siblings of a row's
    path level by level up to the root, from left to right. ``folded_root`` is recomputed for every
    row from its ``claimed`` digest (its leaf where that is null): each parent resumes the state that
    it kept before the slot. ``verified`` says whether that is the root.

    Null values of hashed columns differ from empty ones. Rows with a null id are the first of their
    tree; rows that repeat an id are ordered by their leaves, and equal rows are leaves each, in any
    order. An empty table gives no rows. Columns that no expression names are ignored.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("-")).alias("tree"),
        leaf.alias("digest"),
        (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"),
    )
    placed = numbered(source, ["tree"], ["id", "digest", "claimed"])
    leaves = materialise(placed.select("tree", F.col("_at").alias("at"), F.col("_n").alias("n"), "id", "digest", "claimed"))
    stages, blocks = build(leaves, fanout, levels)

    def fold(key: tuple, rows: pa.Table, block: pa.Table) -> pa.Table:
        rows = _ordered(rows)
        n, run, claims = (rows.column(c).to_pylist() for c in ("n", "digest", "claimed"))
        subroot, root, path = (block.column(c)[0].as_py() for c in ("subroot", "root", "path"))
        lower = grown(run, _levels_here(n[0], fanout, levels), fanout)
        upper = [(step["slot"], Parent(step["run"])) for step in path]
        upper_others = b"".join(p.others[slot] for slot, p in upper)
        proofs, folded = [], []
        for i, (own, claim) in enumerate(zip(run, claims, strict=True)):
            node, others = claim or own, []
            for k, level in enumerate(lower):
                slot, parent = i // fanout**k % fanout, level[i // fanout ** (k + 1)]
                others.append(parent.others[slot])
                node = parent.resumed(slot, node)
            for slot, parent in upper:
                node = parent.resumed(slot, node)
            proofs.append(hashlib.sha256(b"".join(others) + upper_others).hexdigest())
            folded.append(node)
        same = {"subroot": [subroot] * len(run), "root": [root] * len(run)}
        verified = [node == root for node in folded]
        return pa.table({"id": rows.column("id"), "leaf": run, **same, "proof_sha256": proofs, "folded_root": folded, "verified": verified})

    here = leaves.groupBy("tree", (F.col("at") / fanout**levels).cast("long").alias("block"))
    if len(stages) == 1:  # every tree is a single leaf
        blocks = blocks.withColumn("at", F.lit(0).cast("long"))
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return here.cogroup(blocks.groupBy("tree", "at")).applyInArrow(fold, schema)


def op11_merkle_manifest(docs: DataFrame) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    checked = audit(docs, "doc_id", "lang", leaf_digest(*columns, F.col("text")), F.when(tampered, leaf_digest(*columns, lowered)))
    return checked.withColumnRenamed("id", "doc_id")


OP11_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
      lambda s, b: list_reduce([xor(s, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
        lambda x, z: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) AS crc
  FROM documents
), d AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS claimed
  FROM f
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), nodes AS (
  SELECT lang, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM nodes WHERE n > 1 GROUP BY lang, lvl + 1, pos // 8
), subs AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM tops WHERE n > 1 GROUP BY lvl + 1, pos // 8
), low AS (
  SELECT lang, pos AS own, 0 AS lvl, pos, coalesce(claimed, leaf) AS h, '' AS others, false AS done FROM leaves
  UNION ALL
  SELECT w.lang, w.own, w.lvl + 1, w.pos // 8, sha256(string_agg(CASE WHEN k.pos = w.pos THEN w.h ELSE k.h END, '' ORDER BY k.pos)),
    any_value(w.others) || coalesce(string_agg(CASE WHEN k.pos <> w.pos THEN k.h END, '' ORDER BY k.pos), ''), false
  FROM low w JOIN nodes k ON k.lang IS NOT DISTINCT FROM w.lang AND k.lvl = w.lvl AND k.pos // 8 = w.pos // 8 AND k.n > 1
  GROUP BY w.lang, w.own, w.lvl + 1, w.pos // 8
), ends AS (
  SELECT w.lang, w.own, s.subroot, s.pos, w.h, w.others
  FROM low w JOIN (SELECT lang, own, max(lvl) AS lvl FROM low GROUP BY ALL) m ON m.lang IS NOT DISTINCT FROM w.lang AND m.own = w.own AND m.lvl = w.lvl
  JOIN subs s ON s.lang IS NOT DISTINCT FROM w.lang
), high AS (
  SELECT lang, own, 0 AS lvl, pos, h, others FROM ends
  UNION ALL
  SELECT w.lang, w.own, w.lvl + 1, w.pos // 8, sha256(string_agg(CASE WHEN k.pos = w.pos THEN w.h ELSE k.h END, '' ORDER BY k.pos)),
    any_value(w.others) || coalesce(string_agg(CASE WHEN k.pos <> w.pos THEN k.h END, '' ORDER BY k.pos), '')
  FROM high w JOIN tops k ON k.lvl = w.lvl AND k.pos // 8 = w.pos // 8 AND k.n > 1
  GROUP BY w.lang, w.own, w.lvl + 1, w.pos // 8
)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(w.others) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN (SELECT h, lvl FROM tops WHERE n = 1) t ON true
JOIN high w ON w.lang IS NOT DISTINCT FROM l.lang AND w.own = l.pos AND w.lvl = t.lvl
"""

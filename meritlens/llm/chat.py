"""Chat formatting as a prefix tree: turns that conversations share are emitted once, depth first.

A node of the tree is a turn behind all turns before it. Distinct conversations are ordered so that
those with the same beginning are neighbours; each emits the nodes that no earlier one has, as one
run of tokens. A run attends to itself (causally) and to intervals of earlier runs, its ancestors;
position ids go on from those. Conversations with the same first turn make up a pack.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from meritlens.llm.align import byte_encoding
from meritlens.llm.common import group_apart, materialise, numbered


class Template:
    """Marks of a turn, and the control strings that are escaped inside roles and texts.

    A control string inside a text gets the escape character behind its first character, also where
    it has such characters there already; reading takes one away. No control string may begin
    inside another one, so escaping touches each of them once and nothing else.
    """

    def __init__(
        self,
        turn: str = "<|turn|>",
        text: str = "<|text|>",
        end: str = "<|end|>",
        others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"),
        escape: str = "\\",
        learned: tuple[str, ...] = ("assistant",),
    ) -> None:
        self.turn, self.text, self.end, self.learned = turn, text, end, learned
        controls = (turn, text, end, *others)
        for a in controls:
            inside = any(a[i:].startswith(b) or b.startswith(a[i:]) for b in controls for i in range(1, len(a)))
            if len(a) < 2 or escape in a or inside or controls.count(a) > 1:
                raise ValueError(f"control string {a!r} cannot be escaped")
        stem = [(re.escape(c[0]), f"(?={re.escape(escape)}*{re.escape(c[1:])})") for c in controls]
        self.to_escape = re.compile("|".join(first + rest for first, rest in stem))
        self.to_free = re.compile("|".join(f"(?<={first}){re.escape(escape)}{rest}" for first, rest in stem))
        self.escape = lambda m: m.group() + escape

    def escaped(self, text: str) -> str:
        return self.to_escape.sub(self.escape, text)

    def freed(self, text: str) -> str:
        return self.to_free.sub("", text)

    def parts(self, role: str, text: str) -> tuple[str, str, str]:
        """What stands before the text, the text, and what stands behind it."""
        return f"{self.turn}{self.escaped(role)}{self.text}", self.escaped(text), self.end

    def parsed(self, formatted: str) -> tuple[str, str]:
        """Role and text of a formatted turn."""
        if not formatted.startswith(self.turn) or not formatted.endswith(self.end):
            raise ValueError("a turn lacks its marks")
        role, text = formatted[len(self.turn) : -len(self.end)].split(self.text)
        return self.freed(role), self.freed(text)


class Packs(NamedTuple):
    """``nodes``: pack, run (its first token), at (place in the run), start, position, ids, loss (its first token and the one
    behind the last, in the node), role; ``runs``: end, pack, start, stop, position, intervals (first token, token behind the
    last, nodes) with the run itself as the last one; ``members``: conversation and the ``end`` of the run that completes it."""

    nodes: DataFrame
    runs: DataFrame
    members: DataFrame


_ENCODINGS: dict = {}


def _encoding(name: str):
    if name not in _ENCODINGS:
        _ENCODINGS[name] = byte_encoding(SparkFiles.get(name))
    return _ENCODINGS[name]


def _shipped(df: DataFrame, tokenizer: str | None) -> str:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    df.sparkSession.sparkContext.addFile(tokenizer)
    return os.path.basename(tokenizer)


def _encoded(turns: DataFrame, name: str, template: Template) -> DataFrame:
    """(node, role, text) as tokens: node, ids, n, loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _encoding(name).encode_ordinary
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                ids, loss = [], []
                for role, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    head, body, tail = (tokens(x) for x in template.parts(role, text))
                    ids.append(np.array(head + body + tail, np.int32))
                    loss.append([len(head), len(head) + len(body)] if role in template.learned else [0, 0])
                sizes = [len(x) for x in ids]
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(np.concatenate(ids)))
                columns = [part.column(0), lists, pa.array(sizes, pa.int64()), pa.array(loss, pa.list_(pa.int32())), part.column(1)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "ids", "n", "loss", "role"])

    return turns.select("node", "role", "text").mapInArrow(run, "node string, ids array<int>, n long, loss array<int>, role string")


def pack(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template | None = None,
    tokenizer: str | None = None,
) -> Packs:
    """Pack conversations, rows of ``turns`` with one id, into prefix trees of tokens.

    Rows are ordered by turn (null first), then role and text where turns repeat; equal rows are turns
    each. Null roles and texts count as empty. Rows with a null id are one conversation. Nodes are known
    by 128 bits of hashes of the turns up to them. Loss covers the texts of the roles that ``template``
    learns. Extra columns are ignored, whatever their names; an empty table gives empty frames.

    Conversations of any length and groups of any size are cut into pieces by ``numbered``; equal ones are
    one before their paths are compared. A path is compared by the turns at which it parts from others.
    """
    template, name = template or Template(), _shipped(turns, tokenizer)
    source = turns.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-")).alias("conv"),
    )
    source = materialise(source.withColumn("uid", F.monotonically_increasing_id()))
    light = source.select("uid", "id", "conv", "turn", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role").alias("h2"), F.xxhash64("role").alias("r"))
    placed = numbered(light, ["conv"], ["turn", "r", "h1", "h2"]).withColumnsRenamed({"_at": "place", "_n": "turns"})
    wide = lambda *c: F.xxhash64(*c).cast("decimal(38,0)")
    placed = placed.select("uid", "id", "conv", "place", "turns", wide("h1", "place").alias("x1"), wide("h2", "place").alias("x2"))
    summed = numbered(placed, ["conv"], ["place"], {"s1": "x1", "s2": "x2"})
    key = lambda place, a, b: F.md5(F.concat_ws(":", place.cast("string"), a.cast("string"), b.cast("string")))
    place, s1, s2 = F.col("place"), F.col("s1"), F.col("s2")
    rows = materialise(summed.select(
        "uid", "id", "conv", "place", "turns", key(place, s1, s2).alias("node"),
        F.when(place > 0, key(place - 1, s1 - F.col("x1"), s2 - F.col("x2"))).alias("parent"),
    ))
    # Equal conversations end in the same node; one of them stands for all.
    last = rows.where(place == F.col("turns") - 1)
    members = materialise(last.select("id", F.col("node").alias("end")))
    ends = group_apart(last.withColumnRenamed("node", "end"), ["end"], F.min("conv").alias("conv"), F.first("turns").alias("length"))
    spine = materialise(rows.drop("id", "turns").join(ends, "conv").drop("conv"))
    nodes = group_apart(spine, ["node"], F.first("parent").alias("parent"))
    forks = group_apart(nodes.where("parent IS NOT NULL"), ["parent"], F.count("*").alias("c")).where("c > 1").select("parent")
    parting = spine.where("parent IS NULL").unionByName(spine.join(forks, "parent", "left_semi").select(*spine.columns))
    paths = parting.groupBy("end", "length").agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("path"))
    paths = paths.select("end", "length", "path", F.col("path")[0]["node"].alias("pack"))
    ranked = materialise(numbered(paths, ["pack"], ["path", "length"]).select("end", "pack", F.col("_at").alias("rank")))
    spine = materialise(spine.join(ranked, "end"))
    owned = materialise(group_apart(spine, ["node"], F.min(F.struct("rank", "uid", "place", "pack")).alias("own")).select("node", "own.*"))
    encoded = materialise(_encoded(source.join(owned.select("uid", "node"), "uid"), name, template))
    # Where the nodes lie: first token in the pack, by run and depth.
    sized = owned.join(encoded.select("node", "n"), "node")
    laid = numbered(sized, ["pack"], ["rank", "place"], {"stop": "n"}).select("node", "pack", "rank", "place", "n", (F.col("stop") - F.col("n")).alias("start"), "stop")
    laid = materialise(laid)
    # Every path with the runs it goes through, and the tokens before each node.
    on_path = spine.select("end", "place", "node", F.col("rank").alias("reader")).join(laid.select("node", F.col("rank").alias("run"), "n", "start", "stop"), "node")
    on_path = materialise(numbered(on_path, ["end"], ["place"], {"seen": "n"}))
    positions = on_path.where("reader = run").select("node", (F.col("seen") - F.col("n")).alias("position"))
    parts = on_path.groupBy("end", "run", "reader").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("nodes"), F.min(F.col("seen") - F.col("n")).alias("position")
    )
    runs = parts.groupBy("end").agg(
        F.max("start").alias("start"), F.max("stop").alias("stop"), F.max("position").alias("position"),
        F.sort_array(F.collect_list(F.struct("start", "stop", "nodes"))).alias("intervals"),
    )
    runs = materialise(runs.join(ranked, "end").select("end", "pack", "start", "stop", "position", "intervals"))
    first = group_apart(laid, ["pack", "rank"], F.min("start").alias("run"), F.min("place").alias("from"))
    out = laid.join(first, ["pack", "rank"]).join(positions, "node").join(encoded.drop("n"), "node")
    out = out.select("pack", "run", (F.col("place") - F.col("from")).alias("at"), "start", "position", "ids", "loss", "role")
    return Packs(materialise(out), runs, members)


def read_back(packs: Packs, template: Template | None = None, tokenizer: str | None = None) -> DataFrame:
    """Conversations out of their tokens: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    For each run the nodes of its attention intervals are put in the order of their tokens, decoded,
    parsed and freed of escapes. A task reads node by node and hashes as it goes, so a conversation's
    length does not bound its memory. ``turns_sha256`` hashes role, line feed, text, line feed of each turn;
    the loss columns count and hash the text under the loss mask.
    """
    template, name = template or Template(), _shipped(packs.nodes, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, end, state, out = _encoding(name).decode, None, None, []

        def closed() -> list:
            return [end, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            for row_end, ids, loss in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if row_end != end:
                    if end is not None:
                        out.append(closed())
                    end, state = row_end, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = ids.values.to_pylist()
                formatted = decode(ids)
                role, text = template.parsed(formatted)
                masked = template.freed(decode(ids[loss[0] : loss[1]]))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(formatted)
            if len(out) > 1024:
                yield table(out)
                out = []
        if end is not None:
            out.append(closed())
        yield table(out)

    schema = "end string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def table(rows: list[list]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in schema.split(", ")])

    wanted = packs.runs.select("end", "pack", F.explode("intervals").alias("i")).select("end", "pack", F.col("i.start").alias("run"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("i.nodes") - 1)).alias("at"))
    found = wanted.join(packs.nodes.select("pack", "run", "at", "start", "ids", "loss"), ["pack", "run", "at"]).select("end", "ids", "loss", "start")
    read = found.repartition("end").sortWithinPartitions("end", "start").select("end", "ids", "loss").mapInArrow(run, schema)
    return packs.members.join(materialise(read), "end").drop("end")


def sequences(packs: Packs) -> DataFrame:
    """Training rows, one a run: pack, start, ids, position_ids, loss_mask (0 or 1 a token) and the intervals it may attend to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.concatenate([n["ids"] for n in row["nodes"]]).astype(np.int32)
                mask = np.concatenate([(np.arange(len(n["ids"])) >= n["loss"][0]) & (np.arange(len(n["ids"])) < n["loss"][1]) for n in row["nodes"]])
                places = np.arange(len(ids)) + row["position"]
                lists = [pa.array([x.tolist()], pa.list_(pa.int32())) for x in (ids, places, mask.astype(np.int32))]
                same = [pa.array([row[c]], batch.schema.field(c).type) for c in ("pack", "start", "intervals")]
                yield pa.RecordBatch.from_arrays([*same, *lists], schema.names)

    whole = packs.nodes.groupBy("pack", "run").agg(F.sort_array(F.collect_list(F.struct("at", "ids", "loss"))).alias("nodes"))
    rows = packs.runs.join(whole.withColumnRenamed("run", "start"), ["pack", "start"]).select("pack", "start", "intervals", "position", "nodes")
    lists = [StructField(c, ArrayType(IntegerType())) for c in ("ids", "position_ids", "loss_mask")]
    schema = StructType([rows.schema["pack"], StructField("start", LongType()), rows.schema["intervals"], *lists])
    return rows.mapInArrow(run, schema)


def op12_chat_format(conversations: DataFrame) -> DataFrame:
    """All conversations and one of control strings only, packed and read back."""
    hard = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(pack(turns)).withColumnRenamed("id", "conv_id")

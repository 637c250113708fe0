"""Alignment of two tokenizers' tokens: divide and conquer at the byte offsets where both end a token.

A task encodes a chunk of texts with both tokenizers and cuts all of its intervals in step: in every
interval a common end near the middle is looked for by bisection, the interval is cut there and both
halves go on; an interval without a common end is a leaf, a group of tokens that belong together.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from meritlens.llm.bpe import _ragged, byte_letters
from meritlens.llm.common import materialise

#: Pre-tokens of byte-level files of this kind (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters aligned at once (or one text, if it is longer).
CHUNK_CHARS = 500_000
#: Pairs counted by a task before it sends them on.
HELD_PAIRS = 1 << 20
#: Pairs whose count every task knows; the rest are joined.
FREQUENT_PAIRS = 1 << 20


# Tokenizers in the tasks ----------------------------------------------------------------------------------------------


def byte_encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a byte-level BPE file; strings of its special tokens are plain text to it."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = byte_letters(), model["vocab"]
    parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = {a + b for a, b in parts}
    ranks = [vocab[a + b] for a, b in parts]
    if ranks != sorted(ranks):
        raise ValueError(f"{path} does not number its tokens in the order of its merges")
    tokens = {bytes(letters[c] for c in token): i for token, i in vocab.items() if len(token) == 1 or token in made}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={})


class Pair:
    """Both tokenizers, the bytes of their tokens and the decimal texts of the ids."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        self.byte = byte_encoding(byte_file)
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.sizes = self.byte.max_token_value + 1, self.piece.get_piece_size()
        known = dict(zip(map(self.byte.encode_single_token, self.byte.token_byte_values()), self.byte.token_byte_values(), strict=True))
        self.a_bytes = self._table([known.get(i, b"") for i in range(self.sizes[0])])
        self.b_bytes = self._table([self._piece(i) for i in range(self.sizes[1])])
        digits = [f"{i},".encode() for i in range(max(self.sizes))]
        self.digits = np.zeros((len(digits), max(map(len, digits))), np.uint8)
        self.n_digits = np.array([len(d) for d in digits], np.int64)
        for row, d in zip(self.digits, digits, strict=True):
            row[: len(d)] = list(d)

    def _piece(self, i: int) -> bytes:
        text = self.piece.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if self.piece.is_byte(i) else text.replace("▁", " ").encode()

    @staticmethod
    def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(t) for t in tokens], np.int64)
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


_OPEN: dict[tuple[str, str], Pair] = {}


def _opened(names: tuple[str, str]) -> Pair:
    if names not in _OPEN:
        _OPEN[names] = Pair(*(SparkFiles.get(n) for n in names))
    return _OPEN[names]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def _shipped(spark: SparkSession, files: tuple[str, str] | None) -> tuple[str, str]:
    files = files or default_tokenizers()
    for path in files:
        spark.sparkContext.addFile(path)
    return tuple(os.path.basename(f) for f in files)


# One chunk ------------------------------------------------------------------------------------------------------------


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last A and the last B token of each group of the intervals [a_lo, a_hi], [b_lo, b_hi] of tokens.

    Ends are byte offsets, increasing over all tokens; the last tokens of an interval end together. An
    interval's inner A ends are tried from the middle outwards, each by bisection among the B ends;
    the first common one cuts it. An interval that has none, or one token on a side, is a group.
    """
    found_a, found_b = [], []
    tried = np.zeros(len(a_lo), np.int64)
    while len(a_lo):
        inner = a_hi - a_lo
        leaf = (b_hi == b_lo) | (tried >= inner)
        if leaf.any():
            found_a.append(a_hi[leaf])
            found_b.append(b_hi[leaf])
            go_on = ~leaf
            a_lo, a_hi, b_lo, b_hi, tried, inner = (x[go_on] for x in (a_lo, a_hi, b_lo, b_hi, tried, inner))
        at = a_lo + (inner - 1) // 2 + np.where(tried % 2 == 1, 1, -1) * ((tried + 1) // 2)
        end = a_ends[at]
        place = np.searchsorted(b_ends, end)
        cut = b_ends[place] == end
        miss, m, p = ~cut, at[cut], place[cut]
        a_lo, a_hi = np.concatenate([a_lo[miss], a_lo[cut], m + 1]), np.concatenate([a_hi[miss], m, a_hi[cut]])
        b_lo, b_hi = np.concatenate([b_lo[miss], b_lo[cut], p + 1]), np.concatenate([b_hi[miss], p, b_hi[cut]])
        tried = np.concatenate([tried[miss] + 1, np.zeros(2 * len(m), np.int64)])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(a)
    return a[order], b[order]


class Chunk:
    """Texts of a chunk, encoded and aligned. Texts that cannot be aligned have no tokens."""

    def __init__(self, texts: list[str | None], pair: Pair) -> None:
        self.pair, self.count = pair, len(texts)
        full = [i for i, t in enumerate(texts) if t]
        bytes_of = [(" " + texts[i]).encode() for i in full]
        a_lists = [pair.byte.encode_ordinary(" " + texts[i]) for i in full]
        b_lists = pair.piece.encode([texts[i] for i in full], num_threads=1) if full else []
        good = [self._same(x, a, b) for x, a, b in zip(bytes_of, a_lists, b_lists, strict=True)]
        self.docs = np.array([i for i, ok in zip(full, good, strict=True) if ok], np.int64)
        a_lists = [x for x, ok in zip(a_lists, good, strict=True) if ok]
        b_lists = [x for x, ok in zip(b_lists, good, strict=True) if ok]
        self.n_a, self.n_b = (np.array([len(x) for x in lists], np.int64) for lists in (a_lists, b_lists))
        self.a, self.b = (np.concatenate([*(np.array(x, np.int64) for x in lists), np.zeros(0, np.int64)]) for lists in (a_lists, b_lists))
        del a_lists, b_lists, bytes_of
        self.a_ends, self.b_ends = np.cumsum(pair.a_bytes[2][self.a]), np.cumsum(pair.b_bytes[2][self.b])
        a_stop, b_stop = np.cumsum(self.n_a), np.cumsum(self.n_b)
        self.a_last, self.b_last = shared_cuts(self.a_ends, self.b_ends, a_stop - self.n_a, a_stop - 1, b_stop - self.n_b, b_stop - 1)
        self.a_doc, self.b_doc = (np.repeat(np.arange(len(self.docs)), n) for n in (self.n_a, self.n_b))
        self.n_groups = np.bincount(self.a_doc[self.a_last], minlength=len(self.docs))

    def _same(self, data: bytes, a: list[int], b: list[int]) -> bool:
        """Whether the joined bytes of both tokenizers are those of the space and the text."""
        for ids, (flat, start, size) in ((a, self.pair.a_bytes), (b, self.pair.b_bytes)):
            ids = np.array(ids, np.int64)
            if int(size[ids].sum()) != len(data) or flat[_ragged(start[ids], size[ids])].tobytes() != data:
                return False
        return True

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text (of those with tokens), A id and B id of every link: a stretch of bytes between neighbouring ends is one."""
        a_at = np.arange(len(self.a))
        common = np.zeros(len(self.b), bool)
        common[self.b_last] = True
        rest = np.flatnonzero(~common)
        a_at = np.concatenate([a_at, np.searchsorted(self.a_ends, self.b_ends[rest])])
        b_at = np.concatenate([np.searchsorted(self.b_ends, self.a_ends), rest])
        return self.a_doc[a_at], self.a[a_at], self.b[b_at]

    def group_texts(self) -> list[bytes]:
        """The groups of each text with tokens as decimal ids: ``a1,a2|b1;a3|b2,b3``."""
        a_group, b_group = (np.searchsorted(last, np.arange(len(x))) for last, x in ((self.a_last, self.a), (self.b_last, self.b)))
        # Groups stand one after the other, their A tokens before their B tokens.
        a_place = np.arange(len(self.a)) + np.append(0, self.b_last + 1)[a_group]
        b_place = np.arange(len(self.b)) + (self.a_last + 1)[b_group]
        ids, ends = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        mark_a, mark_b = np.full(len(self.a), ord(","), np.uint8), np.full(len(self.b), ord(","), np.uint8)
        mark_a[self.a_last], mark_b[self.b_last] = ord("|"), ord(";")
        ids[a_place], ids[b_place], ends[a_place], ends[b_place] = self.a, self.b, mark_a, mark_b
        width = self.pair.n_digits[ids]
        flat = self.pair.digits[ids][np.arange(self.pair.digits.shape[1]) < width[:, None]]
        stop = np.cumsum(width)
        flat[stop - 1] = ends
        data, doc_stop = flat.tobytes(), np.append(0, stop)[np.cumsum(self.n_a + self.n_b)]
        return [data[s : e - 1] for s, e in zip([0, *doc_stop.tolist()], doc_stop.tolist(), strict=False)]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch with about CHUNK_CHARS characters, or one text."""
    start, held, chars = 0, [], 0
    for text in batch.column(column):
        held.append(text.as_py())
        chars += len(held[-1] or "")
        if chars >= CHUNK_CHARS:
            yield batch.slice(start, len(held)), held
            start, held, chars = start + len(held), [], 0
    if held:
        yield batch.slice(start, len(held)), held


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), pa.array(flat, kind))


# Frames ---------------------------------------------------------------------------------------------------------------


def token_groups(docs: DataFrame, keep: list[str], text_col: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """The columns ``keep`` and the alignment of every row: a_ids, b_ids, and a_last, b_last: the last token of each group.

    Tokenizer A takes a space and the text, B the text alone (it adds the space). Special tokens'
    strings in texts are plain text. Null and empty texts, and texts that one of the tokenizers does
    not give back byte by byte, have empty lists. Rows that repeat are aligned each; an empty table
    gives no rows; columns of ``docs`` beside ``keep`` are ignored, whatever their names.
    """
    names = _shipped(docs.sparkSession, tokenizers)
    columns = ["a_ids", "b_ids", "a_last", "b_last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _slices(batch, batch.num_columns - 1):
                c = Chunk(texts, _opened(names))
                n_a, n_b, n_groups = (np.bincount(c.docs, n, c.count).astype(np.int64) for n in (c.n_a, c.n_b, c.n_groups))
                doc = c.a_doc[c.a_last]
                first_a, first_b = (np.cumsum(c.n_a) - c.n_a)[doc], (np.cumsum(c.n_b) - c.n_b)[doc]
                lists = [_lists(c.a, n_a, pa.int32()), _lists(c.b, n_b, pa.int32()),
                         _lists(c.a_last - first_a, n_groups, pa.int32()), _lists(c.b_last - first_b, n_groups, pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], schema.names)

    source = docs.select(*keep, F.col(text_col).alias("_aligned"))
    schema = StructType([*source.schema[:-1], *(StructField(c, ArrayType(IntegerType())) for c in columns)])
    return source.mapInArrow(run, schema)


def _aligned(docs: DataFrame, id_col: str, text_col: str, names: tuple[str, str], held_pairs: int) -> DataFrame:
    """A row for every row of ``docs`` with its counts, digest and linked id pairs, and rows without ``row`` that count pairs of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, waiting, waiting_n, held = None, [], [], 0

        def counted() -> pa.RecordBatch:
            codes, where = np.unique(np.concatenate(waiting), return_inverse=True)
            total = np.bincount(where, np.concatenate(waiting_n)).astype(np.int64)
            cuts = np.append(np.arange(0, len(codes), 4096), len(codes))
            lists = [_lists(codes, np.diff(cuts), pa.int64()), _lists(total, np.diff(cuts), pa.int64())]
            none = pa.nulls(len(cuts) - 1, pa.int64())
            return pa.RecordBatch.from_arrays([none] * 6 + [pa.nulls(len(cuts) - 1, pa.string()), *lists], schema.names)

        for batch in batches:
            for part, texts in _slices(batch, 2):
                pair = pair or _opened(names)
                c = Chunk(texts, pair)
                doc, a, b = c.links()
                code, many = np.unique((doc * pair.sizes[0] + a) * pair.sizes[1] + b, return_counts=True)
                doc, code = code // (pair.sizes[0] * pair.sizes[1]), code % (pair.sizes[0] * pair.sizes[1])
                every = lambda x: np.bincount(c.docs, x, c.count).astype(np.int64)  # noqa: E731, B023
                digest = np.full(c.count, "", object)
                digest[c.docs] = [hashlib.sha256(t).hexdigest() for t in c.group_texts()]
                n_links, kinds = np.bincount(doc, many, len(c.docs)), every(np.bincount(doc, minlength=len(c.docs)))
                columns = [*part.columns[:2], *(pa.array(every(x)) for x in (c.n_a, c.n_b, c.n_groups, n_links)), pa.array(digest, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, _lists(code, kinds, pa.int64()), _lists(many, kinds, pa.int64())], schema.names)
                waiting.append(code)
                waiting_n.append(many)
                held += len(code)
                if held >= 4 * held_pairs:
                    codes, where = np.unique(np.concatenate(waiting), return_inverse=True)
                    waiting, waiting_n, held = [codes], [np.bincount(where, np.concatenate(waiting_n)).astype(np.int64)], len(codes)
                    if held >= held_pairs:
                        yield counted()
                        waiting, waiting_n, held = [], [], 0
        if held:
            yield counted()

    counts = [StructField(n, LongType()) for n in ("row", "id", "n_a", "n_b", "n_groups", "n_links")]
    schema = StructType([*counts, StructField("groups_sha256", StringType()), StructField("codes", ArrayType(LongType())), StructField("many", ArrayType(LongType()))])
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, schema)


def align_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizers: tuple[str, str] | None = None,
    held_pairs: int = HELD_PAIRS,
    frequent_pairs: int = FREQUENT_PAIRS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Groups are those of ``token_groups``; links are the pairs of an A and a B token that share bytes.
    The count of an id pair is the number of links of the whole table that hold it: ``n_best`` are the
    links whose pair no other pair of the same B id exceeds, ``count_sum`` sums the counts over links.

    Tasks count pairs themselves before the shuffle. At most ``frequent_pairs`` of the commonest pairs
    are known to all tasks with their counts; links of other pairs, none of which is frequent, meet their
    counts in a join. The highest count of each B id is a table of the size of its vocabulary.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have zeros and
    an empty digest. Repeated rows and null ids are rows like any other and their links count; an
    empty table gives no rows; extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    files = tokenizers or default_tokenizers()
    names = _shipped(spark, files)
    size_b = sentencepiece.SentencePieceProcessor(model_file=files[1]).get_piece_size()
    aligned = materialise(_aligned(docs, id_col, text_col, names, held_pairs))
    pieces = aligned.where("row IS NULL").select(F.explode(F.arrays_zip("codes", "many")).alias("p"))
    counts = materialise(pieces.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.many").alias("n")))
    best = np.zeros(size_b, np.int64)
    highest = counts.groupBy((F.col("code") % size_b).cast("int").alias("b")).agg(F.max("n").alias("n")).toArrow()
    best[highest.column("b").to_numpy()] = highest.column("n").to_numpy()
    # Pairs by steps of their count: as many whole steps from the top as fit.
    step = F.floor(F.log2(F.col("n")) * 8).cast("int")
    room, lowest, all_fit = frequent_pairs, 1 << 20, True
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).orderBy(F.desc("step")).collect():  # some hundred rows
        if r.pairs > room:
            all_fit = False
            break
        room, lowest = room - r.pairs, r.step
    known = counts.where(step >= lowest).toArrow()
    code, n = (known.column(c).to_numpy().astype(np.int64) for c in ("code", "n"))
    order = np.argsort(code)
    shared = spark.sparkContext.broadcast((np.append(code[order], np.int64(1 << 62)), np.append(n[order], 0), best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, totals, best = shared.value
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                flat, many = (part.column(c).flatten().to_numpy() for c in (7, 8))
                sizes = part.column(7).value_lengths().to_numpy()
                doc = np.repeat(np.arange(len(part)), sizes)
                place = np.searchsorted(codes, flat)
                hit = codes[place] == flat
                total = np.where(hit, totals[place], 0)
                top = hit & (total == best[flat % len(best)])
                # Sums of whole numbers: float64 weights would round them from 2**53 on.
                sums = np.append(0, np.cumsum(total * many))[np.append(0, np.cumsum(sizes))]
                rest = np.bincount(doc[~hit], minlength=len(part))
                columns = [*part.columns[:7], pa.array(np.bincount(doc, many * top, len(part)).astype(np.int64)), pa.array(np.diff(sums))]
                yield pa.RecordBatch.from_arrays([*columns, _lists(flat[~hit], rest, pa.int64()), _lists(many[~hit], rest, pa.int64())], schema.names)

    fields = aligned.schema
    schema = StructType([*fields[:7], StructField("n_best", LongType()), StructField("count_sum", LongType()), *fields[7:]])
    scored = aligned.where("row IS NOT NULL").mapInArrow(run, schema)
    if all_fit:
        return scored.drop("row", "codes", "many")
    scored = materialise(scored)
    left = scored.where("size(codes) > 0").select("row", F.explode(F.arrays_zip("codes", "many")).alias("p")).select("row", "p.many", F.col("p.codes").alias("code"))
    rare = counts.where(step < lowest).withColumn("b", F.col("code") % size_b).join(F.broadcast(counts.groupBy((F.col("code") % size_b).alias("b")).agg(F.max("n").alias("top"))), "b")
    found = left.join(rare, "code").groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("top"), F.col("many")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("many")).alias("more")
    )
    out = scored.join(found, "row", "left")
    more = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more"), "groups_sha256")


def op13_token_alignment(docs: DataFrame) -> DataFrame:
    return align_tokens(docs).withColumnRenamed("id", "doc_id")

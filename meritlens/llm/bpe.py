"""Byte-level BPE with a minimal acyclic transducer of frequent words; unseen words are merged exactly.

The driver compiles one artifact from a tokenizer file and the corpus' frequent words: an automaton
whose suffixes are shared and whose arcs carry additive outputs (a word's outputs sum up to its
place in the lexicon, which points to its ids), the merge table, the bytes of every token and the
classes of code points. Executors fetch the artifact once and memory-map it; tasks walk all words of
a chunk through the automaton in step and merge the rest in step as well.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from meritlens.llm.common import fresh, frugal, give_back, materialise, new_folder, text_batches

#: Most words of the lexicon besides special tokens, and the share of a block's words that makes a word frequent.
LEXICON, FREQUENT = 1 << 17, 1e-6
#: Characters in a block of counted words, in a piece of it that is counted at once, and in a chunk that is encoded at once.
BLOCK_CHARS, PIECE_CHARS, CHUNK_CHARS = 16_000_000, 500_000, 300_000
#: Words that the driver merges at once, and bytes of the artifact that it hands over at once.
LEXICON_PART, WRITTEN = 1 << 14, 1 << 20
#: Words of more bytes are merged one by one with a heap.
LONG_WORD = 64
LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
_CODES = 0x110000


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    head, place = {}, 0
    for name, a in arrays.items():
        place = -(-place // 64) * 64
        head[name] = (a.dtype.str, a.shape, place)
        place += a.nbytes
    text = json.dumps(head).encode().ljust(4096)
    assert len(text) == 4096
    out = bytearray(4096 + place)
    out[:4096] = text
    for name, a in arrays.items():
        at = 4096 + head[name][2]
        out[at : at + a.nbytes] = np.ascontiguousarray(a).tobytes()
    return bytes(out)


def _mapped(path: str) -> dict[str, np.ndarray]:
    data = np.memmap(path, np.uint8, "r")
    head = json.loads(bytes(data[:4096]))
    return {
        name: np.frombuffer(data, dtype, int(np.prod(shape)), 4096 + place).reshape(shape) for name, (dtype, shape, place) in head.items()
    }


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of the slices (start, length), one slice after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


# The tokenizer file -------------------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of this kind, and its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tokenizer(path: str) -> dict:
    """Vocabulary, merges and special tokens of a byte-level BPE file; other kinds are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    odd = spec.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
    odd = odd or model.get("byte_fallback") or model.get("ignore_merges")
    specials = spec.get("added_tokens") or []
    if not plain or odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in specials):
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    letters, vocab = byte_letters(), model["vocab"]
    size = max([*vocab.values(), *(t["id"] for t in specials)]) + 1
    tokens = [b""] * size
    for text, i in vocab.items():
        tokens[i] = bytes(letters[c] for c in text)
    for t in specials:
        tokens[t["id"]] = t["content"].encode()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in merges], np.int64)
    right = np.array([vocab[b] for _, b in merges], np.int64)
    made = np.array([vocab[a + b] for a, b in merges], np.int64)
    key = left * size + right
    order = np.argsort(key, kind="stable")
    return {
        "merge_key": key[order], "merge_rank": order.astype(np.int64), "merge_id": made[order],
        "byte_id": np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64),
        "token_bytes": np.frombuffer(b"".join(tokens), np.uint8),
        "token_end": np.cumsum([len(t) for t in tokens]).astype(np.int64),
        "specials": {t["content"]: t["id"] for t in specials},
    }


def code_classes() -> np.ndarray:
    """Letter, number, white space or other for each code point; the last entry stands between texts."""
    out = np.full(_CODES + 1, OTHER, np.uint8)
    for plane in range(0, _CODES, 1 << 12):  # strings of few characters, as the whole of them takes 50 MB for a moment
        some = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(plane, plane + (1 << 12)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, some):
                out[plane + m.start() : plane + m.end()] = kind
    out[_CODES] = EDGE
    return out


# Pre-tokens ---------------------------------------------------------------------------------------------------------


def word_starts(codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A mask of the characters that start a pre-token; texts in ``codes`` end with the edge code.

    The rule is that of the usual pattern: contractions, then runs of letters, of numbers or of
    other characters with a space before them, then white space, whose last character goes to what
    follows if it is a space.
    """
    kind = classes[codes]
    starts = np.ones(len(codes), bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == EDGE)
    run = np.flatnonzero(starts)
    run_kind, run_end = kind[run], np.append(run[1:], len(codes))
    gap = np.flatnonzero((run_kind == SPACE) & (kind[np.minimum(run_end, len(codes) - 1)] != EDGE))
    last = run_end[gap] - 1
    starts[last] = True
    joined = gap[codes[last] == 0x20]
    starts[run_end[joined]] = False
    # Contractions: a lone apostrophe that starts a pre-token, and letters after it.
    lone = run[(run_kind == OTHER) & (run_end - run == 1) & (codes[run] == 0x27) & starts[run]]
    for at in lone.tolist():
        letters = bytes(c if c < 128 else 0 for c in codes[at + 1 : at + 3].tolist())
        n = 1 if letters[:1] in (b"s", b"t", b"m", b"d") else 2 if letters in (b"re", b"ve", b"ll") else 0
        if n:
            starts[at + 1] = False
            if kind[at + 1 + n] == LETTER:
                starts[at + 1 + n] = True
    return starts


# Merging unseen words -----------------------------------------------------------------------------------------------


def merge_words(words: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and the number of ids of each."""
    size = len(model["token_end"])
    keys, ranks, made = model["merge_key"], model["merge_rank"], model["merge_id"]
    lengths = np.array([len(w) for w in words], np.int64)
    short = np.flatnonzero(lengths <= LONG_WORD)
    symbols = model["byte_id"][np.frombuffer(b"".join(words[i] for i in short.tolist()), np.uint8)]
    owner = np.repeat(short, lengths[short])
    done_symbols, done_owner = [], []
    never = np.int64(1 << 40)
    while len(symbols):
        pair = symbols[:-1] * size + symbols[1:]
        place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        fits = (keys[place] == pair) & (owner[:-1] == owner[1:])
        rank = np.append(np.where(fits, ranks[place], never), never)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        per_word = np.diff(np.append(first, len(owner)))
        low = np.repeat(np.minimum.reduceat(rank, first), per_word)
        over = low == never
        if over.any():
            done_symbols.append(symbols[over])
            done_owner.append(owner[over])
        take = (rank == low) & ~over
        # The same pair may overlap itself ("aaa"): of consecutive hits every second one is merged.
        at = np.flatnonzero(take)
        if not len(at):
            break
        new_run = np.append(True, np.diff(at) != 1)
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        symbols = symbols.copy()
        symbols[at] = made[place[at]]
        keep = ~over
        keep[at + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        ids = _merge_long(words[i], model)
        done_symbols.append(np.array(ids, np.int64))
        done_owner.append(np.full(len(ids), i))
    if not done_owner:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    all_owner = np.concatenate(done_owner)
    order = np.argsort(all_owner, kind="stable")
    return np.concatenate(done_symbols)[order], np.bincount(all_owner, minlength=len(words))


def _merge_long(word: bytes, model: dict) -> list[int]:
    """One long word: a heap of pairs by rank and place over a linked list."""
    if "pairs" not in model:
        model["pairs"] = dict(zip(model["merge_key"].tolist(), zip(model["merge_rank"].tolist(), model["merge_id"].tolist(), strict=True), strict=True))
    pairs, size = model["pairs"], len(model["token_end"])
    symbol = model["byte_id"][np.frombuffer(word, np.uint8)].tolist()
    after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
    after[-1] = -1
    heap = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (hit := pairs.get(symbol[i] * size + symbol[after[i]])):
            heapq.heappush(heap, (hit[0], i, symbol[i], symbol[after[i]], hit[1]))

    for i in range(len(symbol) - 1):
        offer(i)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != a or j < 0 or symbol[j] != b:
            continue
        symbol[i], symbol[j] = made, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [s for s in symbol if s >= 0]


# The lexicon --------------------------------------------------------------------------------------------------------


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words, laid out in one array of arcs.

    Arc ``base[state] + byte`` belongs to ``owner``; the outputs along a word's arcs sum up to its
    place among the words. State 0 has no arcs and accepts nothing; state 1 is the start.
    """
    arcs: list[dict[int, int]] = [{}, {}]
    final = [False, False]
    known: dict[tuple, int] = {}
    path = [1]  # states along the last word, not yet shared
    last = b""

    def settle(down_to: int) -> None:
        while len(path) - 1 > down_to:
            state, byte = path.pop(), last[len(path) - 1]
            key = (final[state], *arcs[state].items())
            arcs[path[-1]][byte] = known.setdefault(key, state)

    for word in words:
        same = 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        settle(same)
        for _ in word[same:]:
            arcs.append({})
            final.append(False)
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    settle(0)
    used, number, todo = [0, 1], {0: 0, 1: 1}, [1]
    while todo:
        for target in arcs[todo.pop()].values():
            if target not in number:
                number[target] = len(used)
                used.append(target)
                todo.append(target)
    below = {}

    def count(state: int) -> int:
        stack = [state]
        while stack:
            s = stack[-1]
            missing = [t for t in arcs[s].values() if t not in below]
            if missing:
                stack += missing
            else:
                below[s] = final[s] + sum(below[t] for t in arcs[s].values())
                stack.pop()
        return below[state]

    count(1)
    base = np.zeros(len(used), np.int32)
    room = 2048 + 2 * sum(len(arcs[s]) for s in used)
    owner, target, output = (np.full(room, -1, np.int32), np.zeros(room, np.int32), np.zeros(room, np.int32))
    vacant = np.ones(room, bool)
    vacant[:256] = False
    free, window = 256, 4096
    for s in sorted(used, key=lambda s: -len(arcs[s])):
        labels = sorted(arcs[s])
        if not labels:
            continue
        low = free - labels[0]  # first places where every arc of the state finds room
        while True:
            if low + window + 512 > room:
                room = max(2 * room, low + window + 512)
                owner, target, output, vacant = (
                    np.concatenate([a, np.full(room - len(a), fill, a.dtype)]) for a, fill in ((owner, -1), (target, 0), (output, 0), (vacant, True))
                )
            fits = vacant[low + labels[0] : low + labels[0] + window].copy()
            for x in labels[1:]:
                fits &= vacant[low + x : low + x + window]
            if fits.any():
                low += int(fits.argmax())
                break
            low += window
        so_far = int(final[s])
        for x in labels:
            t = arcs[s][x]
            owner[low + x], target[low + x], output[low + x] = number[s], number[t], so_far
            vacant[low + x] = False
            so_far += below[t]
        base[number[s]] = low
        free += int(vacant[free:].argmax())
    end = int(np.flatnonzero(owner >= 0).max(initial=0)) + 257
    return {
        "base": base, "owner": owner[:end], "target": target[:end], "output": output[:end],
        "final": np.array([final[s] for s in used], bool),
        "longest": np.array([max(map(len, words), default=0)], np.int64),
    }


def look_up(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, fst: dict[str, np.ndarray]) -> np.ndarray:
    """Place in the lexicon of each word (a slice of bytes), or -1; all words walk in step."""
    longest = int(fst["longest"][0])
    found = np.full(len(starts), -1, np.int64)
    fitting = np.flatnonzero(lengths <= longest)
    order = fitting[np.argsort(-lengths[fitting].astype(np.int16), kind="stable")]
    at, size = starts[order], lengths[order]
    state, place = np.ones(len(order), np.int32), np.zeros(len(order), np.int32)
    active = np.searchsorted(-size, -np.arange(longest), side="left") if len(order) else np.zeros(longest, int)
    base, owner, target, output = fst["base"], fst["owner"], fst["target"], fst["output"]
    for step in range(longest):
        n = int(active[step])
        if not n:
            break
        s = state[:n]
        arc = base[s] + data[at[:n] + step]
        state[:n] = np.where(owner[arc] == s, target[arc], 0)
        place[:n] += output[arc]
    good = fst["final"][state]
    found[order[good]] = place[good]
    return found


def frequent_words(docs: DataFrame, text_col: str = "text", share: float = FREQUENT, most: int = LEXICON) -> list[str]:
    """The most frequent words (with the space before them) of all texts.

    Every text is counted, in blocks; a block sends on the words with at least ``share`` of its
    words. A word with that share of the corpus has it in some block, so none of those is lost.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, counts, counted_chars, merged = [], 0, [], 0, 0

        def piece() -> pa.Table:
            found = pc.value_counts(pc.split_pattern(pa.chunked_array(held), " ").combine_chunks().flatten())
            return pa.table({"word": found.field(0), "n": found.field(1)})

        def merge() -> pa.Table:
            both = pa.concat_tables(counts).group_by("word").aggregate([("n", "sum")])
            return both.rename_columns({"n_sum": "n"}).select(["word", "n"]).combine_chunks()

        def block() -> pa.RecordBatch:
            table = merge()
            total = max(1, pc.sum(table.column("n")).as_py() or 0)
            many = table.filter(pc.greater_equal(table.column("n"), max(1.0, share * total))).combine_chunks()
            words = pc.utf8_rtrim(many.column("word").combine_chunks(), characters=".,;:!?|*%$&#")
            return pa.RecordBatch.from_arrays([words.cast(pa.string()), many.column("n").combine_chunks()], ["word", "n"])

        for batch in batches:
            for start in range(0, len(batch), 64):
                part = pc.fill_null(batch.column(0).slice(start, 64), "")
                held.append(part.cast(pa.large_string()))
                chars += part.nbytes
                if chars >= PIECE_CHARS:
                    counts.append(piece())
                    held, chars, counted_chars = [], 0, counted_chars + chars
                    if counted_chars >= BLOCK_CHARS:
                        yield block()
                        counts, counted_chars, merged = [], 0, 0
                    elif sum(map(len, counts)) > max(200_000, 2 * merged):  # one table again, before the pieces outgrow it
                        counts = [merge()]
                        merged = len(counts[0])
        if held:
            counts.append(piece())
        if counts:
            yield block()

    counted = text_batches(docs).select(text_col).mapInArrow(frugal(count), "word string, n long")
    counted = counted.where("word != '' AND NOT word RLIKE '\\\\s' AND octet_length(word) < 40").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialise(counted)
    # Words by steps of their count: as many whole steps from the top as fit, so only the lexicon reaches the driver.
    step = F.floor(F.log2(F.col("n")) * 8).cast("int")
    room, lowest = most, 1 << 20
    for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():  # some hundred rows
        if r.words > room:
            break
        room, lowest = room - r.words, r.step
    return counted.where(step >= lowest).orderBy(F.desc("n"), "word").toArrow().column("word").to_pylist()


def compile_lexicon(spark: SparkSession, words: list[str], tokenizer: str) -> str:
    """Compile the artifact, put it into the shared folder and give its name to all executors.

    The words are a cache: ids are those of exact merging whatever the list holds.
    """
    model = read_tokenizer(tokenizer)
    specials = model.pop("specials")
    classes = code_classes()
    pattern_ok = []
    for w in dict.fromkeys([" " + w for w in words] + words[: len(words) // 4]):
        codes = np.append(np.frombuffer(w.encode("utf-32-le"), np.uint32), _CODES)
        if word_starts(codes, classes).sum() == 2:  # one pre-token and the edge
            pattern_ok.append(w.encode())
    lexicon = sorted(set(pattern_ok) | {s.encode() for s in specials})
    del pattern_ok
    ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, len(lexicon), LEXICON_PART):  # words are merged each by itself, so part by part in the driver's memory
        some = lexicon[start : start + LEXICON_PART]
        merged, many = merge_words(some, model)
        own = {i: specials[w.decode()] for i, w in enumerate(some) if w.decode() in specials}
        ends = np.cumsum(many)
        for i in sorted(own, reverse=True):
            merged = np.concatenate([merged[: ends[i] - many[i]], [own[i]], merged[ends[i] :]])
        many = many.copy()
        many[list(own)] = 1
        ids.append(merged.astype(np.int64))
        counts.append(many.astype(np.int64))
    give_back()
    model |= build_automaton(lexicon)
    del lexicon
    give_back()
    model |= {
        "lexicon_ids": np.concatenate(ids),
        "lexicon_end": np.cumsum(np.concatenate(counts)).astype(np.int64),
        "classes": classes,
        "special_text": np.frombuffer(json.dumps(list(specials)).encode(), np.uint8),
    }
    name = f"bpe-{uuid.uuid4().hex}.bin"
    path = f"{new_folder(spark, 'lexicon')}/{name}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    packed = _pack(model)
    for start in range(0, len(packed), WRITTEN):  # each call takes several copies of its bytes here and in the JVM
        out.write(bytearray(packed[start : start + WRITTEN]))
    out.close()
    del packed, model
    give_back()
    spark.sparkContext.addFile(path)
    return name


# In the tasks -------------------------------------------------------------------------------------------------------

_OPEN: dict[str, Codec] = {}


class Codec:
    """Encodes and decodes with a memory-mapped artifact."""

    def __init__(self, path: str) -> None:
        self.model = _mapped(path)
        self.specials = json.loads(bytes(self.model["special_text"]))
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    @staticmethod
    def named(name: str) -> Codec:
        if name not in _OPEN:
            _OPEN[name] = Codec(os.path.join(SparkFiles.getRootDirectory(), name))
        return _OPEN[name]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        model = self.model
        pieces, piece_text, special = [], [], []
        for i, text in enumerate(texts):
            cut = self.split.split(text) if self.split and any(s in text for s in self.specials) else [text]
            for k, piece in enumerate(cut):  # every second piece is a special token
                pieces.append(piece)
                piece_text.append(i)
                special.append(k % 2 == 1)
        joined = "\0".join(pieces) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int32)
        piece_end = np.cumsum(np.array([len(p) + 1 for p in pieces], np.int64))
        codes[piece_end - 1] = _CODES
        starts = word_starts(codes, model["classes"])
        for k in np.flatnonzero(special).tolist():
            starts[piece_end[k] - 1 - len(pieces[k]) : piece_end[k] - 1] = False
            starts[piece_end[k] - 1 - len(pieces[k])] = True
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + ((codes >= 0x10000) & (codes < _CODES)).astype(np.int64)
        width[piece_end - 1] = 1
        byte_at = np.cumsum(width) - width
        first = np.flatnonzero(starts)
        edges = codes[first] == _CODES
        begin = byte_at[first]
        length = np.diff(np.append(begin, byte_at[-1] + 1))
        words_before = np.cumsum(~edges)
        per_piece = np.diff(np.append(0, words_before[edges]))
        begin, length = begin[~edges], length[~edges]
        data = np.frombuffer(joined.encode(), np.uint8)

        place = look_up(data, begin, length, model)
        ends = model["lexicon_end"]
        offset = np.where(place > 0, ends[np.maximum(place - 1, 0)], 0)
        count = np.where(place >= 0, ends[place] - offset, 0)
        flat = model["lexicon_ids"]
        unseen = np.flatnonzero(place < 0)
        if len(unseen):
            raw, distinct = data.tobytes(), {}
            which = [distinct.setdefault(raw[b : b + n], len(distinct)) for b, n in zip(begin[unseen].tolist(), length[unseen].tolist(), strict=True)]
            ids, counts = merge_words(list(distinct), model)
            which = np.array(which)
            offset[unseen] = len(flat) + (np.cumsum(counts) - counts)[which]
            count[unseen] = counts[which]
            flat = np.concatenate([flat, ids])
        ids = flat[_ragged(offset, count)]
        before = np.append(0, np.cumsum(count))
        word_end = np.cumsum(per_piece)
        ids_per_piece = before[word_end] - before[word_end - per_piece]
        return ids, np.bincount(piece_text, ids_per_piece, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of the id lists that lie one after the other; bytes that are no UTF-8 become U+FFFD."""
        ends = self.model["token_end"]
        start = np.where(ids > 0, ends[ids - 1], 0)
        size = ends[ids] - start
        data = self.model["token_bytes"][_ragged(start, size)].tobytes()
        before = np.append(0, np.cumsum(size))
        stop = np.cumsum(counts)
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(before[stop - counts].tolist(), before[stop].tolist(), strict=True)]


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch with about CHUNK_CHARS characters, or one text."""
    start, held, chars = 0, [], 0
    for text in batch.column(column):
        text = text.as_py() or ""
        held.append(text)
        chars += len(text)
        if chars >= CHUNK_CHARS:
            yield start, held
            start, held, chars = start + len(held), [], 0
    if held:
        yield start, held


def encode(docs: DataFrame, artifact: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the token ids of a text column; a null text has no ids. Other columns stay, as does the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.named(artifact)
        for batch in batches:
            for start, texts in _chunks(batch, text_col):
                ids, counts = codec.encode(texts)
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), pa.array(ids.astype(np.int32)))
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, ids_col])

    kept = text_batches(docs).drop(ids_col)
    return kept.mapInArrow(run, StructType([*kept.schema, StructField(ids_col, ArrayType(IntegerType()))]))


def decode(docs: DataFrame, artifact: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of an id column; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.named(artifact)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                lists = part.column(ids_col)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = codec.decode(pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), counts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text_col])

    kept = docs.drop(text_col)
    return kept.mapInArrow(run, StructType([*kept.schema, StructField(text_col, StringType())]))


def digests(docs: DataFrame, artifact: str, keep: list[str], ids: bool = False, text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: the columns ``keep``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    A null text is the empty text. Rows that repeat are encoded each; an empty table gives no rows.
    Columns of ``keep`` that are named like one of the results give way to it.
    """
    results = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    keep = [c for c in keep if c.lower() not in results]
    (own,) = fresh(docs, "_encoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.named(artifact)
        for batch in batches:
            for start, texts in _chunks(batch, own):
                tokens, counts = codec.encode(texts)
                decoded = codec.decode(tokens, counts)
                raw, stop = tokens.astype("<u4"), np.cumsum(counts)
                columns = [
                    *batch.slice(start, len(texts)).columns[:-1],
                    pa.array(counts),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip((stop - counts).tolist(), stop.tolist(), strict=True)]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                ]
                if ids:
                    columns.append(pa.ListArray.from_arrays(np.append(0, stop).astype(np.int32), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    source = text_batches(docs).select(*keep, F.col(text_col).alias(own))
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    fields += [StructField("ids", ArrayType(IntegerType()))] * ids
    schema = StructType([*source.schema[:-1], *fields])
    names = schema.names
    return source.mapInArrow(frugal(run), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def tokenise(docs: DataFrame, keep: list[str], tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """Digests (and ids) of all texts with the lexicon of their own frequent words; null is the empty text."""
    artifact = compile_lexicon(docs.sparkSession, frequent_words(docs), tokenizer or default_tokenizer())
    return digests(docs, artifact, keep, ids)


def op10_bpe(docs: DataFrame) -> DataFrame:
    return tokenise(docs, ["doc_id"])

"""Language of texts by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meritlens.llm.common import held_out, logistic, materialise
from meritlens.llm.words import chunks, mixed

#: Characters of the longest n-gram.
ORDER = 4
#: The fit reads about so many documents of each language at most, and about so many characters in all, as many
#: of each language; a quarter of them calibrates.
SAMPLE, SAMPLE_CHARS = 1500, 2_000_000
#: It reads so many documents of a language at least, if there are so many: of long ones the first characters, but
#: CUT of each at least, however many languages there are.
LEAST, CUT = 16, 500
SEED = 23
NO_LANGUAGE = "und"
#: Share of calibration texts of a language that count as foreign to its model.
REJECT = 0.001
_PAD, _SPACE = 0x110000, 0x20


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    out = np.zeros(_PAD + 1, bool)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(_PAD))
    for m in regex.finditer(r"\p{L}+", every):
        out[m.start() : m.end()] = True
    return out


def stream(texts: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts in lower case, the text of each (-1 for padding), and letters per text.

    Runs of anything but letters are one space; every text is led by padding of ORDER - 1 spaces, so
    no n-gram spans two texts.
    """
    lowered = pc.utf8_lower(texts.cast(pa.large_string())).to_pylist()
    pad = "\0" * (ORDER - 1)
    codes = np.frombuffer((pad + pad.join(lowered)).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in lowered], np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes + ORDER - 1)
    first = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
    padding = np.zeros(len(codes), bool)
    padding[(first[:, None] + np.arange(ORDER - 1)).reshape(-1)] = True
    letter = letters[codes] & ~padding
    gap = ~letter & ~padding
    keep = ~gap
    keep[1:] |= letter[:-1] & gap[1:]  # a gap is kept once, after a letter
    codes = np.where(letter, codes, _SPACE)[keep]
    return codes, np.where(padding, -1, owner)[keep], np.bincount(owner[letter], minlength=len(sizes))


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For each length up to ORDER the hash of the n-gram that ends at each character."""
    out = [mixed(codes.astype(np.uint64) + np.uint64(1))]
    for k in range(2, ORDER + 1):
        longer = np.zeros(len(codes), np.uint64)
        longer[1:] = mixed(out[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:].astype(np.uint64) + np.uint64(k << 32))
        out.append(longer)
    return out


@dataclass
class Models:
    """One model per language. ``keys[k]`` are sorted hashes of n-grams of length k + 1 seen in any language;
    rows of ``logp[k]`` are their log-probabilities by language, rows of ``weight[k]`` the log-weights of
    the shorter model after them. What no language has seen falls back on these."""

    languages: list[str]
    letters: np.ndarray
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)
    unknown: np.ndarray | None = None
    sure: np.ndarray | None = None
    usual: np.ndarray | None = None
    bound: np.ndarray | None = None

    def find(self, k: int, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash among n-grams of length k + 1, or -1."""
        place = np.minimum(np.searchsorted(self.keys[k], hashes), len(self.keys[k]) - 1)
        return np.where(self.keys[k][place] == hashes, place, -1)

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character by text and language, scored characters and letters per text."""
        codes, owner, letters = stream(texts, self.letters)
        grams = gram_hashes(codes)
        at = np.flatnonzero(owner >= 0)
        total = np.zeros((len(texts), len(self.languages)))
        n = np.bincount(owner[at], minlength=len(texts))
        back = np.zeros((len(at), len(self.languages)), np.float32)
        todo = np.arange(len(at))
        for k in range(ORDER - 1, -1, -1):
            if not len(todo):
                break
            row = self.find(k, grams[k][at[todo]])
            hit = row >= 0
            back[todo[hit]] += self.logp[k][row[hit]]
            todo = todo[~hit]
            if k:
                context = self.find(k - 1, grams[k - 1][at[todo] - 1])
                seen = context >= 0
                back[todo[seen]] += self.weight[k - 1][context[seen]]
        back[todo] += self.unknown
        full = np.flatnonzero(n)
        if len(full):
            total[full] = np.add.reduceat(back, (np.cumsum(n) - n)[full], axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n, letters

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated score and rejection of each text."""
        if not self.languages:
            return [NO_LANGUAGE] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, n, letters = self.entropies(texts)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(best)), best]
        score = 1 / (1 + np.exp(-_features(entropy, n) @ self.sure))
        strange = (lowest - self.usual[best]) * np.sqrt(np.minimum(n, 400)) > self.bound[best]
        none = letters == 0
        return [NO_LANGUAGE if x else self.languages[b] for x, b in zip(none, best, strict=True)], np.where(none, 0.0, score), strange | none


def _features(entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the certainty of a choice depends on: the lead of the best model, times the root of the length."""
    if entropy.shape[1] == 1:
        lead = np.zeros(len(entropy))
    else:
        two = np.partition(entropy, 1, axis=1)
        lead = two[:, 1] - two[:, 0]
    return np.column_stack([np.ones(len(n)), lead * np.sqrt(n), np.minimum(lead * np.sqrt(n), 1)])


def train(texts: list[str], languages: list[str]) -> Models:
    """Kneser-Ney models from labelled texts: counts at the longest length, numbers of distinct left neighbours below."""
    names = sorted(set(languages))
    models = Models(names, letter_table())
    number = np.array([names.index(x) for x in languages])
    fitted = np.random.default_rng(SEED).random(len(texts)) < 0.75
    fitted = fitted if len(set(number[fitted].tolist())) == len(names) else np.ones(len(texts), bool)
    own = np.flatnonzero(fitted)
    codes, owner, _ = stream(pa.array([texts[i] for i in own], pa.large_string()), models.letters)
    grams, at = gram_hashes(codes), np.flatnonzero(owner >= 0)
    lang = number[own].astype(np.int32)[owner[at]]
    count = len(names)
    kinds = [np.unique(g[at], return_index=True, return_inverse=True) for g in grams]
    kinds = [(k, first, same.astype(np.int32)) for k, first, same in kinds]
    models.keys = [k[0] for k in kinds]
    # How often each n-gram counts: occurrences for the longest, distinct left neighbours for the others.
    counts = [None] * ORDER
    longest = kinds[-1]
    counts[-1] = np.zeros((len(longest[0]), count))
    np.add.at(counts[-1], (longest[2], lang), 1)
    for k in range(ORDER - 2, -1, -1):
        suffix = kinds[k][2][kinds[k + 1][1]]  # of each longer n-gram, by its first place
        counts[k] = np.zeros((len(kinds[k][0]), count))
        np.add.at(counts[k], suffix, (_occurs(kinds[k + 1], lang, count) > 0).astype(float))
    below = np.full((1, count), 1.0 / (len(kinds[0][0]) + 1))
    for k in range(ORDER):
        c = counts[k]
        one, two = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        discount = np.where(one + two > 0, one / np.maximum(one + 2 * two, 1), 0.5)
        discount = np.clip(discount, 0.1, 0.95)
        first = kinds[k][1]
        if k:
            before = models.find(k - 1, grams[k - 1][at[first] - 1])
            size = len(kinds[k - 1][0])
            known, before = before >= 0, np.maximum(before, 0)
            suffix = kinds[k - 1][2][first]
        else:
            before, known, size, suffix = np.zeros(len(first), int), np.ones(len(first), bool), 1, np.zeros(len(first), int)
        total, follow = np.zeros((size, count)), np.zeros((size, count))
        np.add.at(total, before[known], c[known])
        np.add.at(follow, before[known], (c[known] > 0).astype(float))
        rest = np.where(total > 0, discount * follow / np.maximum(total, 1), 1.0)
        # n-grams after padding have contexts that no text holds: their own counts are not used, the shorter model is.
        share = np.where(known[:, None] & (total[before] > 0), np.maximum(c - discount, 0) / np.maximum(total[before], 1), 0.0)
        weight = np.where(known[:, None], rest[before], 1.0)
        p = share + weight * below[suffix]
        models.logp.append(np.log(p).astype(np.float32))
        if k:
            models.weight.append(np.log(np.maximum(rest, 1e-12)).astype(np.float32))
        else:
            models.unknown = np.log(rest[0] * below[0]).astype(np.float32)
        below = p
    check = np.flatnonzero(~fitted) if (~fitted).any() else own
    parts = [models.entropies(pa.array([texts[i] for i in check[s : s + 200]], pa.large_string())) for s in range(0, len(check), 200)]
    entropy, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    right = entropy.argmin(axis=1) == number[check]
    models.sure = logistic(_features(entropy, n), right.astype(float), np.ones(len(check)))
    models.usual, models.bound = np.zeros(count), np.zeros(count)
    for i in range(count):
        mine = (number[check] == i) & right & (n > 0)
        mine = mine if mine.any() else n > 0
        e = entropy[mine, i]
        models.usual[i] = np.median(e) if len(e) else 0
        models.bound[i] = np.quantile((e - models.usual[i]) * np.sqrt(np.minimum(n[mine], 400)), 1 - REJECT) * 1.5 if len(e) else np.inf
    return models


def _occurs(kind: tuple, lang: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros((len(kind[0]), count))
    np.add.at(out, (kind[2], lang), 1)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models of the languages of rows that are not held out and have a language and a text.

    Reads a bounded sample of each language: its first documents in the order of a hash of id and text, as many as
    fit into its part of SAMPLE_CHARS characters, but LEAST to SAMPLE; of a very long one a window drawn by the hash. No language with a text to learn from is left out.
    Rows equal in id and text count once.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("id")))
    own = own.withColumn("draw", F.xxhash64("id", "t", F.lit(SEED)))
    each = own.groupBy("lang", "draw").agg(F.max(F.length("t")).alias("chars"))
    totals = materialise(each.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.min("draw").alias("lowest")))
    part = SAMPLE_CHARS / max(totals.count(), 1)
    take = F.least(F.lit(SAMPLE), F.greatest(F.lit(LEAST), F.floor(part * F.col("docs") / F.greatest("chars", F.lit(1)))))
    # Hashes up to here hold that many documents, but for one case in millions; the lowest hash is always among them.
    share = F.least(F.lit(1.0), (F.col("take") + 6 * F.sqrt("take") + 18) / F.col("docs"))
    bound = F.when(F.col("share") < 1, ((F.col("share") - 0.5) * 2.0**64).cast("long")).otherwise((1 << 63) - 1)
    plan = totals.withColumn("take", take).withColumn("share", share).select("lang", "take", F.greatest(bound, "lowest").alias("bound"))
    low = own.join(plan, "lang").where(F.col("draw") <= F.col("bound"))
    # Of a long text a window of so many characters, at a place that its hash draws.
    most = max(int(part / LEAST), CUT)
    window = F.expr(f"substring(t, CAST(1 + pmod(draw, greatest(length(t) - {most}, 0) + 1) AS INT), {most})")
    low = low.groupBy("lang", "draw").agg(F.first("take").alias("take"), F.first("id").alias("id"), F.first(window).alias("t"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    rows = low.withColumn("place", place).where(F.col("place") <= F.col("take")).orderBy("id", "t", "lang").select("t", "lang").toArrow()
    return train(rows.column("t").to_pylist(), rows.column("lang").to_pylist()) if len(rows) else Models([], np.zeros(0, bool))


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row, from its whole text alone.

    The language with the lowest cross-entropy per character; ``score`` is the calibrated
    probability that it is right; ``rejected`` marks texts that fit even this model worse than
    nearly all calibration texts. Null texts and texts without letters are ``und``, with score 0,
    and rejected. Without any language to learn all texts are. Rows that repeat are answered each; an
    empty table gives no rows; extra columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                lang, score, rejected = shared.value.predict(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    source = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op2_language(docs: DataFrame) -> DataFrame:
    found = identify(docs, fit(docs)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")

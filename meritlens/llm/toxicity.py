"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from meritlens.llm.common import fresh, frugal, give_back, held_out, logistic, materialise, text_batches
from meritlens.llm.words import CHUNK_BYTES, chunks, slice_hashes, split_words

#: Words in a window; windows overlap by a quarter.
WINDOW, STRIDE = 64, 48
#: The fit reads about so many documents of each class at most, and about so many characters of each class.
SAMPLE, SAMPLE_CHARS = 2500, 5_000_000
#: Hidden units of a direction and of the attention; sizes of the learned and of the counted hash tables.
HIDDEN, ATTENTION, EMBED, ROOM, COUNTED = 8, 8, 4, 1 << 12, 1 << 20
GRAMS = (4, 6)
THRESHOLD = 0.7
#: Passes over the sample, more where they are fewer than STEPS steps of BATCH texts.
EPOCHS, STEPS, BATCH, RATE, SEED = 10, 600, 64, 0.01, 7
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class Words:
    """Words of a chunk of texts: the distinct ones with their character n-grams, and the running text as indexes."""

    def __init__(self, texts: pa.Array) -> None:
        data, start, end, self.count = split_words(pc.utf8_lower(texts.cast(pa.large_string())), _BREAKS)
        data = np.concatenate([np.array([0x20], np.uint8), np.where(_BREAKS[data], np.uint8(0x20), data)])
        hashes = slice_hashes(data, start + 1, end + 1)
        self.hash, first, index = np.unique(hashes, return_index=True, return_inverse=True)
        self.index = index.astype(np.int32)
        start, end = start[first], end[first] + 2  # with the space on either side
        places, sizes, owners = [], [], []
        for n in GRAMS:
            many = np.maximum(end - start - n + 1, 0)
            stop = np.cumsum(many)
            places.append(np.repeat(start - (stop - many), many) + np.arange(int(stop[-1]) if len(stop) else 0))
            sizes.append(np.full(len(places[-1]), n))
            owners.append(np.repeat(np.arange(len(first)), many))
        place, size, owner = np.concatenate(places), np.concatenate(sizes), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.gram = (slice_hashes(data, place[order], place[order] + size[order]) & np.uint64(COUNTED - 1)).astype(np.int32)
        self.grams = np.bincount(owner, minlength=len(first))

    @classmethod
    def of_all(cls, texts: list[str]) -> Words:
        """Words of many texts, taken apart chunk by chunk."""
        starts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // (CHUNK_BYTES // 4), prepend=-1))
        parts = [cls(pa.array(texts[a:b], pa.large_string())) for a, b in zip(starts, [*starts[1:], len(texts)], strict=True)]
        out = cls.__new__(cls)
        out.count = np.concatenate([p.count for p in parts])
        out.hash, first, same = np.unique(np.concatenate([p.hash for p in parts]), return_index=True, return_inverse=True)
        before = np.cumsum([0, *(len(p.hash) for p in parts)])
        out.index = np.concatenate([same[b + p.index].astype(np.int32) for b, p in zip(before, parts, strict=False)])
        every = cls.__new__(cls)
        every.grams, every.gram = np.concatenate([p.grams for p in parts]), np.concatenate([p.gram for p in parts])
        del parts
        out.grams = every.grams[first]
        out.gram = np.concatenate([every.gram[:0], *(every.gram[_grams_of(every, first[r])] for r in _runs(len(first)))])
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and number of words of each window, and windows per text; a text without words has one empty window."""
        many = np.maximum(1, -(-(self.count - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(self.count)), many)
        step = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        begin = (np.cumsum(self.count) - self.count)[text] + step * STRIDE
        return begin, np.minimum(self.count[text] - step * STRIDE, WINDOW), many


def _per_word(values: np.ndarray, grams: np.ndarray, kind: np.ufunc) -> np.ndarray:
    """Sum or maximum of the values of each word's n-grams; 0 for words without any."""
    out = np.zeros((len(grams), *values.shape[1:]), np.float32)
    full = np.flatnonzero(grams)
    if len(full):
        out[full] = kind.reduceat(values, (np.cumsum(grams) - grams)[full], axis=0)
    return out


def _grams_of(words: Words, rows: np.ndarray) -> np.ndarray:
    """Places of the n-grams of some words."""
    many = words.grams[rows]
    stop = np.cumsum(many)
    first = (np.cumsum(words.grams) - words.grams)[rows]
    return np.repeat(first - (stop - many), many) + np.arange(int(stop[-1]) if len(stop) else 0)


def _runs(n: int, size: int = 20_000) -> list[np.ndarray]:
    return [np.arange(s, min(s + size, n)) for s in range(0, n, size)]


def _places(index: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Words (window, time) of windows; ``index`` ends with a window of no words."""
    return index[np.minimum(begin[:, None] + np.arange(WINDOW), len(index) - 1)]


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log of the rate in toxic over that in clean text, drawn to zero where there are few occurrences."""
    total = toxic + clean
    share = toxic.sum() / max(total.sum(), 1)
    return (np.log((toxic + 4) / (total * share + 4)) - np.log((clean + 4) / (total * (1 - share) + 4))).astype(np.float32) / 3


class Network:
    """Parameters and passes. Inputs of a word: counted log-odds of the word and its n-grams, and two learned embeddings."""

    def __init__(self, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        inputs = 3 + 2 * EMBED
        some = lambda *shape: (draw.standard_normal(shape) * (1 / np.sqrt(shape[0]))).astype(np.float32)
        self.word_odds = np.zeros(COUNTED, np.float32)
        self.gram_odds = np.zeros(COUNTED, np.float32)
        self.p = {
            "word": some(ROOM, EMBED), "char": some(ROOM, EMBED),
            "in": some(inputs, 6 * HIDDEN), "in0": np.zeros(6 * HIDDEN, np.float32),
            "ahead": some(HIDDEN, 3 * HIDDEN), "back": some(HIDDEN, 3 * HIDDEN),
            "look": some(2 * HIDDEN, ATTENTION), "look0": np.zeros(ATTENTION, np.float32), "weigh": some(ATTENTION),
            "out": some(2 * HIDDEN), "out0": np.zeros(1, np.float32),
        }
        self.scale = np.array([1, 0, 0], np.float64)  # logit = scale . (network, 1, log windows)

    def inputs(self, words: Words, rows: np.ndarray | None = None) -> np.ndarray:
        """Inputs of the distinct words, or of some of them."""
        hashes, grams, gram = words.hash, words.grams, words.gram
        if rows is not None:
            hashes, grams, gram = hashes[rows], grams[rows], gram[_grams_of(words, rows)]
        some = np.maximum(grams, 1).astype(np.float32)
        odds = self.gram_odds[gram]
        char = _per_word(self.p["char"][gram & (ROOM - 1)], grams, np.add) / some[:, None]
        return np.column_stack([
            self.word_odds[hashes & np.uint64(COUNTED - 1)], _per_word(odds, grams, np.maximum), _per_word(odds, grams, np.add) / some,
            self.p["word"][hashes & np.uint64(ROOM - 1)], char,
        ])

    def projected(self, words: Words) -> np.ndarray:
        """Inputs of all words as the recurrent layers take them; a last row of zeros stands for no word."""
        out = np.zeros((len(words.hash) + 1, 6 * HIDDEN), np.float32)
        for rows in _runs(len(words.hash)):
            out[rows] = self.inputs(words, rows) @ self.p["in"] + self.p["in0"]
        return out

    def window_logits(self, projected: np.ndarray, index: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin), np.float32)
        for s in range(0, len(begin), 1024):
            out[s : s + 1024], _ = self.forward(projected, _places(index, begin[s : s + 1024]), size[s : s + 1024])
        return out

    @staticmethod
    def _run(x: np.ndarray, mask: np.ndarray, u: np.ndarray, trace: bool) -> tuple[np.ndarray, list]:
        """States of one direction; x is (time, window, 3 hidden) of projected inputs."""
        h, states, steps = np.zeros((x.shape[1], HIDDEN), np.float32), np.empty((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)):
            hu = h @ u
            gate = 1 / (1 + np.exp(-(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])))
            z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if trace:
                steps.append((h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = np.where(mask[t], new, h)
            states[t] = h
        return states, steps

    def forward(self, projected: np.ndarray, at: np.ndarray, size: np.ndarray, trace: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits of windows; ``at`` (window, time) are rows of the projected inputs."""
        p, width = self.p, max(1, int(size.max(initial=0)))
        at, mask = at[:, :width].T, (np.arange(width)[:, None] < size[None, :])[:, :, None]
        x = projected[at]
        ahead, one = self._run(x[:, :, : 3 * HIDDEN], mask, p["ahead"], trace)
        back, two = self._run(x[::-1, :, 3 * HIDDEN :], mask[::-1], p["back"], trace)
        h = np.concatenate([ahead, back[::-1]], axis=2)
        seen = np.tanh(h @ p["look"] + p["look0"])
        e = np.where(mask[:, :, 0], seen @ p["weigh"], -30)
        e = np.exp(e - e.max(axis=0))
        share = e * mask[:, :, 0] / (e.sum(axis=0) + 1e-9)
        pooled = (h * share[:, :, None]).sum(axis=0)
        return pooled @ p["out"] + p["out0"], (at, mask, x, one, two, h, seen, share, pooled)

    def gradients(self, d: np.ndarray, kept: tuple) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the parameters behind the projected inputs, and those of the inputs by place."""
        at, mask, x, one, two, h, seen, share, pooled = kept
        p, g = self.p, {}
        g["out"], g["out0"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dpool = d[:, None] * p["out"]
        dshare = (h * dpool).sum(axis=2)
        de = share * (dshare - (share * dshare).sum(axis=0))
        g["weigh"] = np.tensordot(de, seen, axes=([0, 1], [0, 1]))
        dseen = de[:, :, None] * p["weigh"] * (1 - seen * seen)
        g["look"], g["look0"] = np.tensordot(h, dseen, axes=([0, 1], [0, 1])), dseen.sum(axis=(0, 1))
        dh = share[:, :, None] * dpool + dseen @ p["look"].T
        dx = np.zeros_like(x)
        for name, steps, flip, place in (("ahead", one, False, slice(0, 3 * HIDDEN)), ("back", two, True, slice(3 * HIDDEN, None))):
            down, m = dh[:, :, :HIDDEN] if name == "ahead" else dh[::-1, :, HIDDEN:], mask[::-1] if flip else mask
            u, du, carry = p[name], np.zeros_like(p[name]), 0
            for t in range(len(steps) - 1, -1, -1):
                before, z, r, n, hn = steps[t]
                total = down[t] + carry
                new = total * m[t]
                dn = new * (1 - z) * (1 - n * n)
                dz, dr = new * (before - n) * z * (1 - z), dn * hn * r * (1 - r)
                inner = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ inner
                carry = total * ~m[t] + new * z + inner @ u.T
                dx[len(x) - 1 - t if flip else t][:, place] = np.concatenate([dz, dr, dn], axis=1)
            g[name] = du
        return g, dx, at

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The highest logit of all overlapping windows of each text, and the number of windows."""
        words = Words(texts)
        begin, size, many = words.windows()
        index = np.append(words.index, np.full(WINDOW, len(words.hash), np.int32))
        logits = self.window_logits(self.projected(words), index, begin, size)
        return np.maximum.reduceat(logits, np.cumsum(many) - many) if len(many) else logits, many

    def probability(self, texts: pa.Array) -> np.ndarray:
        logit, many = self.scores(texts)
        return 1 / (1 + np.exp(-(self.scale[0] * logit + self.scale[1] + self.scale[2] * np.log(many))))


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray, seed: int = SEED) -> Network:
    """Fit on whole texts with labels: only the most toxic window of a text, as scored so far, is fitted to its label.

    ``texts`` is emptied once it is read, as the driver's memory holds the fit. Four fifths train the network, the rest calibrates its logits; ``weight`` is the number of rows of
    the corpus that a text of its class stands for.
    """
    net = Network(seed)
    draw = np.random.default_rng(seed)
    words = Words.of_all(texts)
    texts.clear()
    give_back()
    n_texts = len(toxic)
    fit = draw.random(n_texts) < 0.8
    begin, size, many = words.windows()
    text = np.repeat(np.arange(n_texts), many)
    word_text = np.repeat(np.arange(n_texts, dtype=np.int32), words.count)
    count = lambda rows: np.bincount(words.index[rows[word_text]], minlength=len(words.hash))
    tables = []
    for rows in (fit & (toxic == 1), fit & (toxic == 0)):
        n = count(rows).astype(np.float64)
        tables.append((np.bincount((words.hash & np.uint64(COUNTED - 1)).astype(np.int64), n, COUNTED),
                       sum(np.bincount(words.gram[_grams_of(words, r)], np.repeat(n[r], words.grams[r]), COUNTED) for r in _runs(len(words.hash)))))
    net.word_odds, net.gram_odds = log_odds(tables[0][0], tables[1][0]), log_odds(tables[0][1], tables[1][1])
    del tables, n, word_text
    index = np.append(words.index, np.full(WINDOW, len(words.hash), np.int32))
    word_slot = (words.hash & np.uint64(ROOM - 1)).astype(np.int64)
    odds = np.concatenate([net.inputs(words, r)[:, :2].max(axis=1) for r in _runs(len(words.hash))] or [np.zeros(0)])
    sums = np.append(0, np.cumsum(np.maximum(odds, 0)[words.index]))
    toxic_by = sums[begin + size] - sums[begin]
    del odds, sums
    give_back()
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(int(fit.sum()), 1)))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch in (epochs // 3, 2 * epochs // 3):
            toxic_by = net.window_logits(net.projected(words), index, begin, size)
        best = np.lexsort((toxic_by, text))[np.cumsum(many) - 1]
        rows = draw.permutation(np.flatnonzero(fit))
        for s in range(0, len(rows), BATCH):
            row = rows[s : s + BATCH]
            used, local = np.unique(_places(index, begin[best[row]]), return_inverse=True)
            real = used[used < len(words.hash)]
            x = net.inputs(words, real)
            projected = np.concatenate([x @ net.p["in"] + net.p["in0"], np.zeros((len(used) - len(real), 6 * HIDDEN), np.float32)])
            logit, kept = net.forward(projected, local.reshape(len(row), WINDOW), size[best[row]], trace=True)
            g, dx, place = net.gradients(((1 / (1 + np.exp(-logit)) - toxic[row]) / len(row)).astype(np.float32), kept)
            dproj = np.zeros_like(projected)
            np.add.at(dproj, place.reshape(-1), dx.reshape(-1, dx.shape[2]))
            dproj = dproj[: len(real)]
            g["in"], g["in0"] = x.T @ dproj, dproj.sum(axis=0)
            dinput = dproj @ net.p["in"].T
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], word_slot[real], dinput[:, 3 : 3 + EMBED])
            each = (dinput[:, 3 + EMBED :] / np.maximum(words.grams[real], 1)[:, None]).astype(np.float32)
            np.add.at(g["char"], words.gram[_grams_of(words, real)] & (ROOM - 1), np.repeat(each, words.grams[real], axis=0))
            step += 1
            for k, v in g.items():  # Adam with weight decay
                one, two = moments[k]
                one += 0.1 * (v - one)
                two += 0.001 * (v * v - two)
                net.p[k] -= RATE * ((one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-7) + 1e-3 * net.p[k])
    held = np.flatnonzero(~fit)
    held = held if len(set(toxic[held].tolist())) == 2 else np.arange(n_texts)
    give_back()
    logit = np.maximum.reduceat(net.window_logits(net.projected(words), index, begin, size), np.cumsum(many) - many)
    net.scale = logistic(np.column_stack([logit, np.ones(len(logit)), np.log(many)])[held], toxic[held], weight[held])
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | float:
    """A network for ``labels`` (doc_id, toxic) of rows that are not held out.

    Reads a bounded sample: labelled documents are drawn by the hash of their id, class by class, so
    that about SAMPLE documents and SAMPLE_CHARS characters of a class are expected. Rows without
    a label, with another label than 0 and 1 or without an id teach nothing. If a class is missing, the
    share of label 1 (0 without labels) is given instead of a network.
    """
    own = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    light = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"))
    known = materialise(light.join(own, "doc_id"))
    totals = {r.toxic: (r.docs, r.chars) for r in known.groupBy("toxic").agg(F.count("*").alias("docs"), F.sum("n").alias("chars")).collect()}
    if set(totals) != {0, 1}:
        return float(min(totals)) if totals else 0.0
    share = {k: min(1.0, SAMPLE / n, SAMPLE_CHARS / max(chars, 1)) for k, (n, chars) in totals.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
    chosen = known.where(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).select("doc_id", "toxic").distinct()
    # The sample has about 2 * SAMPLE ids, so it may be sent to all tasks.
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "doc_id")
    rows = sample.select("toxic", F.coalesce("t", F.lit("")).alias("t")).orderBy("doc_id", "t").toArrow()
    toxic = rows.column("toxic").to_numpy()
    if len(set(toxic.tolist())) < 2:
        return totals[1][0] / (totals[0][0] + totals[1][0])
    texts = rows.column("t").to_pylist()
    del rows
    net = train(texts, toxic.copy(), np.where(toxic == 1, 1 / share[1], 1 / share[0]))
    give_back()
    return net


def score(docs: DataFrame, model: Network | float, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of every row: all overlapping windows of the whole text are scored, the highest counts.

    Null, empty and wordless texts have one empty window and the score that the network gives to it.
    Rows that repeat have equal scores; an empty table gives no rows; ``score_col`` may not be one of ``keep``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [] if text_col in keep else [text_col]  # the text goes to the workers once
    at = [*keep, *extra].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in chunks(batch, at, CHUNK_BYTES // 4):
                p = np.full(len(part), model) if isinstance(model, float) else model.probability(pc.fill_null(part.column(at), ""))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(p.astype(np.float64))], [*keep, score_col])

    source = text_batches(docs).select(*keep, *extra)
    return source.mapInArrow(frugal(run), StructType([*source.schema[: len(keep)], StructField(score_col, DoubleType())]))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of documents that the network, fitted on them and their labels, does not reject."""
    (own,) = fresh(docs, "_score")
    return score(docs, fit(docs, labels), docs.columns, score_col=own).where(F.col(own) < threshold).drop(own)


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

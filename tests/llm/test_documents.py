"""Document operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meritlens.llm import bpe, exact, langid, lines, minhash, mixing, shards, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, id long, t string, n int, len int, score double, ids string, key string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
draw = random.Random(5)
VOCABULARY = ["".join(draw.choice("abcdeéß漢") for _ in range(draw.randint(1, 7))) for _ in range(300)]


def words(n):
    return " ".join(draw.choice(VOCABULARY) for _ in range(n))


def edited(text, changes):
    ws = text.split(" ")
    for _ in range(changes):
        ws[draw.randrange(len(ws))] = draw.choice(VOCABULARY)
    return " ".join(ws)


def corpus():
    base, other = words(120), words(60)
    texts = [None, "", " \t\n", "one", "One", "one two", base, base, base.upper(), base + " ", " ".join(base), words(30_000), other]
    texts += [edited(base, k % 5) for k in range(30)] + [edited(other, 1) for _ in range(5)]
    texts += [words(draw.randint(1, 40)) for _ in range(40)] + ["a <|endoftext|> b", "x" * 5000, "\0 \x1c '", "🙂🙂 " * 50]
    rows = [(i, t, ["de", "fr", None][i % 3], ["a", "b", None, "c"][i % 4], i, "t", 1, 2, 0.5, "x", "k") for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[1], (None, base, None, "a", 1, "t", 1, 2, 0.5, "x", "k")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def roots(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text, k):
    ws = [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, k):
    sets = [(r[0], shingles(r[1], k)) for r in rows if r[0] is not None]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    root = roots([a for a, _ in sets], links)
    want = Counter((a, len(x), root[a], root[a] == a) for a, x in sets)
    want[(None, len(shingles(rows[-1][1], k)), None, True)] += 1
    assert counted(minhash.near_duplicates(docs, words=k), "id", "n_shingles", "component_id", "kept") == want


def test_many_close_texts_keep_their_links(spark):
    """A chain of texts where each is close to its neighbours only, and a passage that all other texts share."""
    chain, text = [], words(100).split(" ")
    for i in range(40):
        text = text[2:] + [f"new{i}", f"more{i}"]
        chain.append(" ".join(text))
    shared = words(60)
    texts = chain + [f"{shared} {' '.join(f'w{i}x{j}' for j in range(25))}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, 4) for t in texts]
    links = [(i, j) for i in range(100) for j in range(i + 1, 100) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = roots(range(100), links)
    got = {r.id: r.component_id for r in minhash.near_duplicates(df, words=4).collect()}
    assert got == root and len(set(root.values())) < 100


def test_keep_one(docs, rows):
    got = minhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = {r.id for r in minhash.near_duplicates(docs).where("kept").collect()}
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in rows if r[0] in kept)


def test_exact_duplicates(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub("", r[1] or "")].append(r)
    want = Counter()
    for text, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1] or ""), r[0] is not None, r[0] or 0))[0]
        for r in own:
            want[(r[0], keep, len(own), r[0] == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert counted(exact.op3_exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    early = exact.exact_duplicates(docs).where("digest IS NULL").count()
    assert early > 0  # some texts are settled before the full hash


def test_shards(docs, rows):
    got = shards.op8_sharding(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots))) and 0 <= shard < 40
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(len(v) == 1 for v in by_id.values())


def test_jump_moves_the_fair_share():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 40_000)
    now, grown = shards.jump(keys, 40, 41)
    moved = now != grown
    assert (grown[moved] == 40).all() and abs(moved.mean() - 1 / 41) < 0.004
    assert np.bincount(now, minlength=40).std() < 50

    def plain(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
        return b

    assert now[:300].tolist() == [plain(int(k), 40) for k in keys[:300]]


def test_highest_quotients():
    draw = np.random.default_rng(2)
    for _ in range(50):
        votes, seats, most = draw.integers(0, 50, 6).astype(float), int(draw.integers(0, 60)), draw.integers(0, 30, 6)
        got = np.zeros(6, int)
        for _ in range(min(seats, int(most[votes > 0].sum()))):
            quotients = np.where((got < most) & (votes > 0), votes / (2 * got + 1), -1)
            got[quotients.argmax()] += 1
        ours = mixing.sainte_lague(votes, seats, most)
        assert ours.sum() == got.sum()
        # Equal quotients may go either way; the lowest quotient that got a seat is the same.
        low = lambda g: sorted(votes[i] / (2 * k + 1) for i in range(6) for k in range(g[i]))
        assert np.allclose(low(ours), low(got))


def test_mixture(docs, rows):
    size = lambda t: len([w for w in SPACE.split(t or "") if w])
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, total, target = set(sources), 1.5 * sum(sizes.values()), {}
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if share[s] > 2 * sizes[s]}
        for s in above or left:
            target[s] = 2 * sizes[s] if above else share[s]
        total -= sum(target[s] for s in above)
        left = left - above if above else set()
    got = mixing.op7_source_mixing(docs).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((r[0], size(r[1]), r[3]) for r in rows)
    for s in sources:
        own = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, target[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 0.005 * target[s] + 2
    assert counted(mixing.mix(docs.repartition(5)), "doc_id", "size", "taken") == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_mixed_rows_have_the_taken_words(docs):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[(r.doc_id, r.source)] += r.taken
    got = Counter()
    for r in mixing.mixed_rows(docs).collect():
        got[(r.doc_id, r.source)] += len([w for w in SPACE.split(r.text) if w])
    assert all(abs(got[k] - v) <= 1 for k, v in taken.items())


def test_recurring_lines(spark):
    notice = "Licensed under version {} of the public licence text"
    texts = [f"first {words(12)}\n{notice.format(i)}\nlast {words(9)}" for i in range(8)]
    texts += ["same story told twice\nwith an end of its own"] * 9  # copies share all surroundings
    texts += [None, "", "\n\n \n", "12 34\n56", words(20_000)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string")
    gone = counted(lines.recurring_lines(df), "id", "place")
    assert set(gone) == {(i, 1) for i in range(1, 8)}
    got = {r.doc_id: r for r in lines.drop_lines(df).collect()}
    assert got[3].text == "\n".join(texts[3].split("\n")[::2]) and got[3].n_dropped == 1 and got[3].line == "x"
    assert all(got[i].text == t and got[i].n_dropped == 0 for i, t in enumerate(texts) if i == 0 or i > 7)
    assert lines.drop_lines(df).count() == len(rows)


def test_recurring_lines_wherever_they_stand(spark):
    notice, footer = "all rights to this text are kept", ["page of the old archive", "do not copy this page", "ask the keeper first"]
    passage, signs, refrain = words(40), "漢字" * 60, "and so we sing again tonight"
    texts = []
    for i in range(9):
        texts.append("\n".join([words(12), "", notice, "", words(14), *footer]))
    texts += ["\n".join([words(11), passage, words(13), signs]) for _ in range(3)]
    texts += ["\n".join([refrain, words(9)] * 8 + [words(10)])]
    texts += [f"{words(9)}\n{words(8)} {k}" for k in range(4)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = counted(lines.recurring_lines(df), "id", "place")
    want = {(i, p) for i in range(1, 9) for p in (2, 5, 6, 7)} | {(i, p) for i in (10, 11) for p in (1, 3)}
    assert set(gone) == want
    got = {r.doc_id: r for r in lines.drop_lines(df).collect()}
    assert got[4].text == "\n".join(texts[4].split("\n")[k] for k in (0, 1, 3, 4)) and got[4].n_dropped == 4
    assert all(got[i].text == texts[i] for i in (0, 9, *range(12, len(texts))))


def test_rows_lose_only_lines_of_their_own(spark):
    notice = "all rights to this text are kept"
    texts = [f"{words(7)}\n{notice}\n{words(9)}" for _ in range(7)] + [f"{words(8)}\n{words(10)}\n{words(6)}"]
    rows = [(i, t) for i, t in enumerate(texts[:5])] + [(None, t) for t in texts[5:]] + [(3, texts[7]), (None, None), (None, texts[6])]
    got = Counter((r.doc_id, r.text, r.n_dropped) for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    cut = lambda t: "\n".join(t.split("\n")[::2])
    left = {k: [r for r in got if r[0] == k and r[2] == 0] for k in (None, 3)}
    assert (None, texts[7], 0) in left[None] and (None, None, 0) in left[None] and left[3] == [(3, texts[7], 0)]
    kept = [r for r in got if r[1] and notice in r[1]]
    assert len(kept) == 1 and kept[0][0] is None  # the first by id: nulls come before numbers
    want = Counter((k, t, 0) if not t or notice not in t or (k, t, 0) in kept else (k, cut(t), 1) for k, t in rows)
    assert got == want


def test_bpe_is_exact(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, want = Tokenizer.from_file(str(path)), Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        back = library.decode(ids, skip_special_tokens=False)
        want[(r[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert counted(bpe.op10_bpe(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_general_interface(docs):
    artifact = bpe.compile_lexicon(docs.sparkSession, [], str(public_tokenizers.path("byte_bpe_50k.json")))
    back = bpe.decode(bpe.encode(docs, artifact), artifact)
    assert back.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded"]
    assert all((r.text or "") == r.decoded for r in back.collect())


def test_automaton_knows_its_words_only():
    own = sorted({w.encode() for w in VOCABULARY} | {b"a", b"ab", b"abc"})
    fst = bpe.build_automaton(own)
    asked = own + [b"zz", b"abcdx", b"a" * 50, b"\xff", own[3] + b"!"]
    data, length = np.frombuffer(b"".join(asked), np.uint8), np.array([len(w) for w in asked])
    found = bpe.look_up(data, np.cumsum(length) - length, length, fst)
    assert found.tolist() == [*range(len(own)), *[own.index(w) if w in own else -1 for w in asked[len(own) :]]]
    assert len(fst["base"]) < sum(map(len, own))  # suffixes are shared


def test_toxicity_learns_held_out_rows(spark):
    clean = ["the", "of", "and", "river", "stone", "house", "tree", "walk", "blue", "seven"]
    bad = ["idiotic", "wretch", "scumbag"]
    rows, marks = [], []
    for i in range(700):
        ws = [draw.choice(clean) for _ in range(draw.randint(5, 300))]
        toxic = i % 4 == 0
        for _ in range(1 + len(ws) // 40 if toxic else 0):
            ws[draw.randrange(len(ws))] = draw.choice(bad) + draw.choice(["", "s", "!"])
        rows.append((i, " ".join(ws), 0.1))
        marks.append((i, int(toxic) if i % 7 else None))
    rows += [(900, None, 0.1), (901, "", 0.1), (902, "  ", 0.1), (903, "!!", 0.1), (904, " ".join(clean) * 4000 + " you wretch", 0.1), (None, "x", 0.1)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.op5_toxicity(df, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(700))
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.95
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.op5_toxicity(docs, none).collect()} == {(0.0, 0)}


def test_gradients_agree_with_differences():
    net = toxicity.Network()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, at, size = np.random.default_rng(3).standard_normal((9, 6 * toxicity.HIDDEN)), np.array([[0, 1, 2, 3], [4, 5, 6, 8]]), np.array([4, 3])
    logit, kept = net.forward(x, at, size, trace=True)
    g, _, _ = net.gradients(np.array([1.0, -2.0]), kept)
    for name in ("ahead", "back", "look", "weigh", "out"):
        place = np.unravel_index(g[name].argmax(), g[name].shape)
        old, net.p[name][place] = net.p[name][place], net.p[name][place] + 1e-3
        up = net.forward(x, at, size)[0] @ [1.0, -2.0]
        net.p[name][place] = old
        assert math.isclose((up - logit @ [1.0, -2.0]) / 1e-3, g[name][place], rel_tol=0.05, abs_tol=1e-3)


def test_language(spark):
    syllables = {"xa": ["ba", "ro", "ti", "mu"], "xb": ["sch", "ung", "ein", "ü"], "xc": ["que", "ión", "ñ", "lla"]}
    rows = []
    for i in range(400):
        lang = ["xa", "xb", "xc"][i % 3]
        text = " ".join("".join(draw.choice(syllables[lang]) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(3, 60)))
        rows.append((i, text, lang if i % 5 else None, 1.0))
    rows += [(900, None, "xa", 1.0), (901, "", None, 1.0), (902, "12 !? \n", "xb", 1.0), (903, "漢字", None, 1.0), (904, "baro " * 60_000, None, 1.0), (None, "tita muba", "xa", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    got = {r.doc_id: r for r in langid.op2_language(df).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902, 904, None)] == ["und", "und", "und", "xa", "xa"]
    assert got[903].lang_pred in syllables and got[903].rejected
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(400))
    assert np.mean([got[i].lang_pred == ["xa", "xb", "xc"][i % 3] for i in held]) > 0.98


def test_a_rare_language_of_long_texts_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 24_000)
    spoken = lambda parts, n: " ".join("".join(draw.choice(parts) for _ in range(3)) for _ in range(n))
    rows = [(i, spoken(["ba", "ro", "ti", "mu"] if i % 2 else ["sch", "ung", "ein", "ü"], 30), "xa" if i % 2 else "xb") for i in range(400)]
    rows += [(1000 + i, spoken(["que", "ión", "ñ", "lla"], 4000), "xc") for i in range(12)]
    rows += [(2000, spoken(["dzi", "ksy", "wą"], 5000), "xd"), (2000, spoken(["dzi", "ksy", "wą"], 5000), "xd")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    models = langid.fit(df)
    assert models.languages == ["xa", "xb", "xc", "xd"]
    new = [(0, spoken(["que", "ión", "ñ", "lla"], 20)), (1, spoken(["dzi", "ksy", "wą"], 20)), (2, spoken(["ba", "ro", "ti", "mu"], 20))]
    got = {r.id: r.lang_pred for r in langid.identify(spark.createDataFrame(new, "doc_id long, text string"), models).collect()}
    assert got == {0: "xc", 1: "xd", 2: "xa"}


def test_language_models_sum_to_one():
    texts = [words(50) for _ in range(40)]
    models = langid.train(texts, ["a" if i % 2 else "b" for i in range(40)])
    chars = sorted(set(" ".join(texts)))
    prefix = texts[0][:20]
    codes = np.array([[*map(ord, prefix[-3:]), ord(c)] for c in chars])
    for i in range(2):
        total = 0.0
        for row in codes:
            grams = langid.gram_hashes(row)
            value, k = 0.0, langid.ORDER - 1
            while k >= 0:
                hit = models.find(k, grams[k][-1:])[0]
                if hit >= 0:
                    value += models.logp[k][hit, i]
                    break
                if k and (before := models.find(k - 1, grams[k - 1][-2:-1])[0]) >= 0:
                    value += models.weight[k - 1][before, i]
                k -= 1
            else:
                value += models.unknown[i]
            total += math.exp(value)
        assert 0.9 < total < 1.01  # the rest is for characters never seen


@pytest.mark.parametrize(
    "operator",
    [
        minhash.op1_minhash_dedup, langid.op2_language, exact.op3_exact_dedup, mixing.op7_source_mixing, mixing.mixed_rows, shards.op8_sharding,
        lines.op9_line_dedup, bpe.op10_bpe, lambda d: toxicity.op5_toxicity(d, d.select("doc_id", F.lit(1).alias("toxic"))),
    ],
)
def test_empty_tables(empty, operator):
    assert operator(empty).count() == 0


def test_hashes_tell_texts_apart():
    sets = minhash.shingle_sets(pa.array(["a b c d", "a b d c", "A B C D", "ab c d", "a", "b", None, "a b", "b a"]), 4)
    assert len({s.tobytes() for s in sets}) == 8
    assert sets[0].tolist() == sets[2].tolist() and len(sets[6]) == 0


def test_chunks_of_few_words(spark):
    """Every number of words of a shingle with chunks of few words in all."""
    for k in range(1, 9):
        for n in range(9):
            texts = ["w " * n, None, "x" * (n % 2)]
            got = minhash.shingle_sets(pa.array(texts), k)
            assert [len(s) for s in got] == [len(shingles(t, k)) for t in texts]
    assert minhash.shingle_sets(pa.array([], pa.string()), 5) == []


def near_copies(n, lines_each=30):
    base = [" ".join(draw.choice(VOCABULARY) for _ in range(20)) for _ in range(lines_each)]
    out = []
    for i in range(n):
        own = list(base)
        own[draw.randrange(lines_each)] = " ".join(draw.choice(VOCABULARY) for _ in range(20))
        out.append("\n".join(own))
    return out


def test_near_copies_stay_whole(spark):
    """Texts that differ in a line are one document for the line count, so none is cut; what others share with them goes."""
    notice = "this notice stands in many documents that have otherwise nothing at all in common with each other ever"
    copies = near_copies(6)
    others = [f"{words(12)}\n{notice}\n{words(15)}" for _ in range(6)]
    texts = copies + others + [f"{copies[0]}\n{notice}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.drop_lines(df).collect()}
    assert [got[i] for i in range(6)] == copies
    assert [notice in got[i] for i in range(6, 13)] == [True] + [False] * 6
    assert len({r.component_id for r in minhash.near_duplicates(df).where("id < 6").collect()}) == 1


def plain_recurring(docs):
    """Lines to drop by dicts: leaves, constant tokens, templates, near-copy classes."""
    parsed = []
    for i, t in docs:
        for place, raw in enumerate((t or "").split("\n") if t is not None else []):
            tokens = [w for w in SPACE.split(raw) if w]
            masked = ["<*>" if re.search("[0-9]", w) else w for w in tokens]
            if masked:
                line = " ".join(masked)
                long = len(masked) >= lines.LONG_TOKENS or (len(masked) <= lines.DEPTH and len(line) >= lines.LONG_CHARS)
                leaf = (len(masked), tuple(masked[: lines.DEPTH]), long)
                parsed.append((i, t, place, raw, tuple(masked), leaf))
    need = lambda leaf: lines.RECURS_LONG if leaf[2] else lines.RECURS
    stands, of_line = defaultdict(set), defaultdict(set)
    for _, t, _, _, masked, leaf in parsed:
        of_line[leaf, masked].add(t)
    token_count = Counter()
    for (leaf, masked), ts in of_line.items():
        for k, w in enumerate(masked):
            token_count[leaf, k, w] += len(ts)
    named = []
    for i, t, place, raw, masked, leaf in parsed:
        fixed = [token_count[leaf, k, w] >= need(leaf) for k, w in enumerate(masked)]
        later = fixed[lines.DEPTH :]
        if sum(later) >= lines.CONSTANT * len(later) and any(f and w != "<*>" for f, w in zip(fixed, masked, strict=True)):
            template = (leaf, tuple(w if f else "<*>" for f, w in zip(fixed, masked, strict=True)))
            named.append((i, t, place, raw, template))
            stands[template].add(t)
    often = {x for x, ts in stands.items() if len(ts) >= need(x[0])}
    lost, whole = Counter(), Counter()
    for _, t, _, raw, x in named:
        lost[t] += len(raw) * (x in often)
    for _, t, _, raw, _, _ in parsed:
        whole[t] += len(raw)
    suspects = [t for t in whole if lost[t] and lost[t] >= lines.SUSPECT * whole[t]]
    sets = {t: shingles(t, 5) for t in suspects}
    links = [(a, b) for n, a in enumerate(suspects) for b in suspects[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    same = roots(suspects, links)
    classes, first = defaultdict(set), {}
    for i, t, place, _, x in named:
        classes[x].add(same.get(t, t))
        first[x] = min(first.get(x, (i, t, place)), (i, t, place))
    return {(i, place) for i, t, place, _, x in named if len(classes[x]) >= need(x[0]) and (i, t, place) != first[x]}


def test_recurring_lines_against_plain_version(spark):
    few = VOCABULARY[:12]
    frames = [" ".join(draw.choice(few) for _ in range(draw.choice([2, 5, 9, 18]))) for _ in range(14)]

    def line():
        ws = draw.choice(frames).split(" ")
        for _ in range(draw.randrange(3)):
            ws[draw.randrange(len(ws))] = draw.choice([str(draw.randrange(50)), draw.choice(VOCABULARY)])
        return draw.choice([" ", "  ", "\t"]).join(ws)

    texts = ["\n".join(line() if draw.random() < 0.5 else words(draw.randint(1, 20)) for _ in range(draw.randint(1, 9))) for _ in range(80)]
    texts += near_copies(5, 8) + [texts[3], texts[4], None, "", "\n \n"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.id, r.place) for r in lines.recurring_lines(df).collect()}
    want = plain_recurring(docs)
    assert got == want and len(want) > 30

"""Merkle manifest, chat packing and token alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meritlens.llm import align, chat, merkle
from meritlens.llm.common import numbered

draw = random.Random(8)
H = lambda x: hashlib.sha256(x.encode()).hexdigest()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(df, columns, want):
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(want)


def test_numbered(spark):
    rows = [(draw.choice([None, "a", "b"]), draw.randrange(40), draw.randrange(9)) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, o int, x int")
    got = numbered(df, ["k"], ["o", "x"], {"upto": "x"}, piece_rows=50).collect()
    for k in (None, "a", "b"):
        own = sorted((r for r in got if r.k == k), key=lambda r: r._at)
        assert [r._at for r in own] == list(range(len(own))) and {r._n for r in own} == {len(own)}
        assert [(r.o, r.x) for r in own] == sorted((o, x) for key, o, x in rows if key == k)
        assert [r.upto for r in own] == [sum(x.x for x in own[: i + 1]) for i in range(len(own))]
    assert numbered(df.limit(0), ["k"], ["o"]).count() == 0


# Merkle manifest ------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, digest string, path int"


def plain_tree(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for i, t, lang, s, n in rows:
        head = field(i) + field(s) + field(lang) + field(n)
        tampered = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        leaf = H(head + field(t))
        trees[lang].append((i, leaf, H(head + field(t and t.translate(LOWER))) if tampered else leaf))

    def levels(leaves):
        out = [leaves]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
        return out

    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for x in names:
        trees[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[x] = levels([r[1] for r in trees[x]])
    top = levels([built[x][-1][0] for x in names]) if names else []
    out = []
    for place, x in enumerate(names):
        for k, (i, leaf, node) in enumerate(trees[x]):
            others = ""
            for tree, at in ((built[x], k), (top, place)):
                for row in tree[:-1]:
                    run, slot = row[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    others += "".join(run[:slot] + run[slot + 1 :])
                    node = H("".join([*run[:slot], node, *run[slot + 1 :]]))
                    at //= 8
            out.append((i, leaf, built[x][-1][0], top[-1][0], H(others), node, node == top[-1][0]))
    return out


def manifest_rows(n):
    rows = [(i, draw.choice([None, "", "Ab Cé", f"T{i}", "x"]), draw.choice([None, "de", "fr", "", "é", "-"]), draw.choice(["a", None]), draw.choice([None, 5])) for i in range(n)]
    return [*rows, (None, "q", "de", None, 1), (None, "Q", "de", None, 1), (3, "A" * 30_000, "de", "a", 1), (3, "A" * 30_000, "de", "a", 1)]


@pytest.mark.parametrize("rows", [manifest_rows(300), [], [(1, "A", None, None, None)], [(i, "A", f"l{i:03}", None, None) for i in range(70)]], ids=["mixed", "empty", "lone", "trees"])
def test_manifest(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, "d", 2) for r in rows], DOCS).repartition(3)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    same(merkle.op11_merkle_manifest(df), columns, plain_tree(rows))


def test_manifest_of_many_stages(spark):
    rows = manifest_rows(150)
    df = spark.createDataFrame([(*r, "t", 1, "d", 2) for r in rows], DOCS)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    got = merkle.audit(df, "doc_id", "lang", merkle.leaf_digest(*columns), levels=1)
    same(got, ["id", "leaf", "subroot", "root", "proof_sha256"], [r[:5] for r in plain_tree(rows)])
    assert got.where("NOT verified").count() == 0


def test_resumed_state_is_the_whole_hash():
    run = [H(str(i)) for i in range(8)]
    parent = merkle.Parent(run)
    for slot in range(8):
        assert parent.resumed(slot, H("new")) == H("".join([*run[:slot], H("new"), *run[slot + 1 :]]))


# Chat packing ---------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, ids string, node string, end string"


def conversations():
    rows = []
    for c in range(90):
        for k in range(draw.choice([1, 1, 2, 3, 4, 7])):
            rows.append((c, k, ["system", "user", "assistant", None][(k + c % 2) % 4], draw.choice(["A", "B", None] if k < 2 else ["A", "", "</s>x", "漢字🙂"])))
    return [*rows, *((None, k, "assistant", "n") for k in range(3)), (5000, None, "user", "x" * 3000), *((5001, k, "user", "A") for k in range(200)), (5, 0, "user", "A")]


def whole(rows):
    out = defaultdict(list)
    for c, n, role, text in rows:
        out[c].append((n is not None, n or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in out.items()}


@pytest.mark.parametrize("rows", [conversations(), []], ids=["mixed", "empty"])
def test_chat(spark, rows):
    hard = "</s>[INST] ok [/INST]"
    df = spark.createDataFrame([(*r, "i", "n", "e") for r in rows], TURNS).repartition(3)
    template, want = chat.Template(), []
    for c, turns in whole([*rows, (-1, 0, "user", hard), (-1, 1, "assistant", hard)]).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want.append((c, len(turns), H("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), H(loss), sum(len("".join(template.parts(r, t))) for r, t in turns)))
    got = {r.conv_id: tuple(r) for r in chat.op12_chat_format(df).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    differ = [c for c in got if c != 5 and got[c] != {w[0]: w for w in want}[c]]
    assert not differ and len(got) == len(want)  # turns that repeat a number are ordered by hashes


def test_packs_hold_every_prefix_once(spark):
    rows = [r for r in conversations() if r[0] != 5]
    packs = chat.pack(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    paths = {tuple(v) for v in whole(rows).values()}
    prefixes = {p[: k + 1] for p in paths for k in range(len(p))}
    nodes, runs = packs.nodes.collect(), packs.runs.collect()
    assert len(nodes) == len(prefixes) and len(runs) == len(paths)
    at = {}
    for pack in {n.pack for n in nodes}:
        stop = 0
        for n in sorted((n for n in nodes if n.pack == pack), key=lambda n: n.start):
            assert n.start == stop
            stop += len(n.ids)
            at[pack, n.run, n.at] = n
    for r in runs:
        read = [at[r.pack, i.start, k] for i in r.intervals for k in range(i.nodes)]
        assert [n.position for n in read] == [sum(len(m.ids) for m in read[:k]) for k in range(len(read))]
        assert all(i.stop - i.start == sum(len(at[r.pack, i.start, k].ids) for k in range(i.nodes)) for i in r.intervals)
    for s in chat.sequences(packs).collect():
        assert len(s.ids) == len(s.position_ids) == len(s.loss_mask) and s.position_ids == list(range(s.position_ids[0], s.position_ids[0] + len(s.ids)))


def test_escapes_are_reversible():
    template = chat.Template()
    parts = ["<", "|", "turn", "|>", "\\", "</s>", "<s>", "[INST]", "[/INST]", "[", "<|end|>", "<|text|>", "<\\|end|>", "<\\\\/s>", "a", "<<SYS>>", "SYS>>", ">"]
    for _ in range(20_000):
        role, text = ("".join(draw.choice(parts) for _ in range(draw.randint(0, 8))) for _ in range(2))
        head, body, tail = template.parts(role, text)
        assert template.parsed(head + body + tail) == (role, text)
        assert not any(c in body for c in ("<|turn|>", "<|text|>", "<|end|>", "</s>", "[INST]"))
    with pytest.raises(ValueError):
        chat.Template(turn="<a<", text="<a<b")


# Token alignment ------------------------------------------------------------------------------------------------------


def plain_alignment(rows):
    files = align.default_tokenizers()
    a_model, b_model, letters = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1]), align.byte_letters()
    a_model.encode_special_tokens = True
    per, counts = [], Counter()

    def spans(tokens):
        out, at = [], 0
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    for i, text in rows:
        a, b, groups, links = [], [], [], []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            a_bytes = [bytes(letters[c] for c in a_model.id_to_token(x)) for x in a]
            b_bytes = [bytes([int(b_model.id_to_piece(x)[3:5], 16)]) if b_model.is_byte(x) else b_model.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
                a, b = [], []
            else:
                sa, sb = spans(a_bytes), spans(b_bytes)
                last = 0
                for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
                    groups.append("|".join(",".join(str(x) for x, (s, e) in zip(ids, sp, strict=True) if s >= last and e <= cut) for ids, sp in ((a, sa), (b, sb))))
                    last = cut
                links = [(x, y) for x, (s, e) in zip(a, sa, strict=True) for y, (u, v) in zip(b, sb, strict=True) if s < v and u < e]
        counts.update(links)
        per.append((i, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (i, a, b, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), H(";".join(g)) if g else "") for i, a, b, g, k in per
    ]


@pytest.fixture(scope="module")
def texts():
    some = ["water", "Haus", "déjà", "漢字", "the", "ing", "12,5", "\t", "🙂", "\n\n", "x1x2", "don't", "  "]
    rows = [(i, draw.choice([" ", ""]).join(draw.choice(some) for _ in range(draw.randint(1, 60)))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, "a▁b"), (103, "<|endoftext|> <s> </s> <unk>"), (None, "a b"), (100, "zz"), (1, " "), (2, "x" * 700), (3, "\0 a"), (4, "word " * 2000), rows[0]]


@pytest.mark.parametrize("options", [{}, {"frequent_pairs": 50, "held_pairs": 100}, {"frequent_pairs": 0}], ids=["known", "some_joined", "all_joined"])
def test_alignment(spark, texts, options):
    df = spark.createDataFrame([(*r, "c", 1, "n") for r in texts], "doc_id long, text string, codes string, n int, row string").repartition(3)
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same(align.align_tokens(df, **options), columns, plain_alignment(texts))


def test_groups_and_empty_table(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = {(i, a, b, g) for i, a, b, g, *_ in plain_alignment(texts)}
    got = align.token_groups(df, ["doc_id"]).collect()
    assert {(r.doc_id, len(r.a_ids), len(r.b_ids), len(r.a_last)) for r in got} == want and len(got) == len(texts)
    assert all(r.a_last == sorted(set(r.a_last)) and (not r.a_ids or (r.a_last[-1], r.b_last[-1]) == (len(r.a_ids) - 1, len(r.b_ids) - 1)) for r in got)
    assert align.op13_token_alignment(df.limit(0)).collect() == []

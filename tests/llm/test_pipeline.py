"""The pipeline's stages on a small corpus, each against a plain version of what it has to do."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

draw = random.Random(11)
CLEAN = ["river", "stone", "house", "tree", "walk", "blue", "seven", "lamp", "paper", "glass", "wind", "over", "under", "field", "north"]
BAD = ["wretch", "scumbag", "idiotic"]
NOTICE = "all rights to this text are kept by whoever wrote it down first"


def text(n, bad=0):
    ws = [draw.choice(CLEAN) + draw.choice(["", "s", "er", "ing"]) for _ in range(n)]
    for _ in range(bad):
        ws[draw.randrange(n)] = draw.choice(BAD)
    return " ".join(ws)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs, labels = [], []
    for i in range(360):
        toxic = i % 5 == 0
        n = draw.randint(20, 120)
        docs.append([i, text(n, 2 + n // 30 if toxic else 0), "en", f"s{i % 4}", 0])
        labels.append((i, 1, int(toxic)))
    for i in range(1, 60, 4):  # near copies and lines that many documents share
        docs.append([1000 + i, docs[i][1].replace(" ", "  ", 3), "en", "s0", 0])
        docs[i + 101][1] = f"{text(9)}\n{NOTICE}\n{docs[i + 101][1]}"
    docs += [[2000, None, None, None, 0], [2001, "", "en", "s1", 0]]
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs, results = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{sf_dir}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        results.append({} if "ids" in docs.columns else defaultdict(list))
        for r in docs.collect():
            if "ids" not in docs.columns:
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
                results[-1][r.doc_id].append(r)
    clean, cut, single, mixed, _ = results

    toxic = {i for i in range(360) if i % 5 == 0}
    gone = set(range(360)) - set(clean)
    assert len(gone ^ toxic) <= 8 and 2000 in clean and 2001 in clean

    assert set(cut) == set(clean)
    holders = sorted(i for i, (r,) in clean.items() if r.text and NOTICE in r.text)
    assert [i for i in holders if NOTICE in cut[i][0].text] == holders[:1]
    for i, (r,) in cut.items():
        lines = [x for x in (clean[i][0].text or "").split("\n") if i == holders[0] or x != NOTICE]
        assert (r.text or "") == "\n".join(lines)

    shingles = {}
    for i, (r,) in cut.items():
        ws = (r.text or "").lower().split()
        shingles[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
    root = {i: i for i in shingles}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(shingles)
    for a in ids:
        for b in ids:
            x, y = shingles[a], shingles[b]
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    assert set(single) == {i for i in ids if top(i) == i} and len(single) < len(cut)

    size = lambda t: len((t or "").split())
    total = sum(size(r.text) for (r,) in single.values())
    assert abs(sum(size(r.text) for rs in mixed.values() for r in rs) - 1.5 * total) <= 0.01 * total
    for i, rs in mixed.items():
        own = single[i][0].text
        assert all(own.startswith(r.text) and r.n_chars == len(r.text) for r in rs) and sum(r.text != own for r in rs) <= 1 and len(rs) <= 3

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = Counter((i, tuple(library.encode(r.text, add_special_tokens=False).ids)) for i, rs in mixed.items() for r in rs)
    assert Counter((r.doc_id, tuple(r.ids)) for r in docs.collect()) == want


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert [re.sub(r"\W", "", n) for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]

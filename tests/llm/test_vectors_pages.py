"""Embeddings and archives against brute force."""

import gzip
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from meritlens.llm import vectors, warc


def brute(rows):
    ok = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append(i)
    links = defaultdict(list)
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    links[i].append(j)
    seen = {}
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            low = min(rows[j][0] for j in group)
            seen |= {j: low for j in group}
    return Counter((r[0], len(links[i]), seen[i], seen[i] == r[0]) for i, r in enumerate(rows))


def some_vectors(n, seed):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((n // 6, 12))
    rows = []
    for i in range(n):
        v = centres[draw.integers(len(centres))] + draw.standard_normal(12) * draw.choice([0, 0.05, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    return rows


@pytest.mark.parametrize("cell, sample, at_once", [(vectors.CELL, vectors.SAMPLE, 1024), (20, vectors.SAMPLE, 1024), (20, 40, 7)])
def test_near_vectors(spark, monkeypatch, cell, sample, at_once):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "SAMPLE", sample)
    monkeypatch.setattr(vectors, "AT_ONCE", at_once)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = some_vectors(240, cell)
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 1), (502, None, 0), (503, [], 0), (504, [0.0] * 12, 0), (505, [None] * 12, 0)]
    rows += [(506, [float("nan")] * 12, 0), (507, [float("inf")] + [1.0] * 11, 0), (508, rows[3][1], None), (509, [1.0, 2.0], 0), (510, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, r[0], "v") for r in rows], "vec_id long, embedding array<float>, label int, rep long, v string")
    got = Counter(tuple(r) for r in vectors.op6_embedding_dedup(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute(rows)


def test_a_label_sends_about_twice_the_sample_to_its_fit(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SAMPLE", 200)
    rows = [(i, v, 0, len(v)) for i, v, _ in some_vectors(3000, 5)] + [(7, v, 1, len(v)) for _, v, _ in some_vectors(300, 6)]
    classes = spark.createDataFrame(rows, "rep long, v array<double>, label int, dim int")
    fitted = vectors._fit(classes, 20)
    assert len(fitted[0, 12]) == 25 and len(fitted[1, 12]) == 15  # an eighth of the sample; one a cell, though all ids are equal
    drawn = vectors.drawn(classes, classes.groupBy("label", "dim").count().withColumnRenamed("count", "n")).groupBy("label").count().collect()
    assert 300 < dict(drawn)[0] < 500 and dict(drawn)[1] == 300


def test_no_vectors(spark):
    assert vectors.op6_embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"


def pages():
    long = "<p>" + "same payload " * 20
    html = [None, "", "short", "short", long, long, long, FAKE * 3, "x\r\n" * 40, "ends with break\r\n\r\n" * 8, "é漢🙂" * 60, "b" * 300_000, "WARC/1.0", "\r\n\r\n" + FAKE]
    rows = [(i, f"http://a/{i}\r\nX: y", h, "f") for i, h in enumerate(html)] + [(-5, None, long, "f"), (None, "u", long, "f")]
    return rows + [(i, "u", f"<p>page {i}</p>" + "z" * i, "f") for i in range(100, 160)]


def test_archives(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(2)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        same = min(r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None)
        first = len(raw) < 100 or same == i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first else "revisit", None if first else same))
    got = warc.op4_warc(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_archives_keep_payloads_and_reject_what_is_inside(spark, tmp_path):
    rows = pages()
    folder = str(tmp_path / "out")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, file string"), folder, records=7)
    seen = warc.candidates(spark, folder)
    assert seen.where("record_id = '<urn:x-page:99>'").count() == 4
    read = warc.read_archives(spark, folder, payload=True).collect()
    assert len(read) == len(rows) and not [r for r in read if r.record_id == "<urn:x-page:99>"]
    by_id = {str(r[0]): r[2] or "" for r in rows if r[0] is not None}
    for r in read:
        name = r.record_id[len("<urn:x-page:") : -1]
        if r.type == "response" and name:
            assert r.payload.decode() == by_id[name]


def test_a_broken_archive_gives_what_comes_before(spark, tmp_path):
    record = lambda i, n: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r{i}>\r\nContent-Length: {n}\r\n\r\n{'x' * 20}\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress((record(1, 20) + record(2, 20) + record(3, 500) + record(4, 20)).encode()))
    assert {r.record_id for r in warc.read_archives(spark, str(tmp_path)).collect()} == {"<r1>", "<r2>"}


def test_false_headers_hash_no_byte_twice(spark, tmp_path):
    false = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: {1 << 20}\r\n\r\n"
    html = [false * 10_000, "y" * 1000 + "\r\n", "\r\n" + false, "paragraph\r\n\r\n" * 100_000]
    rows = [(i, "u", h) for i, h in enumerate(html)]
    folder = str(tmp_path / "out")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    (path,) = (tmp_path / "out").glob("*.gz")
    whole = gzip.decompress(path.read_bytes())
    scan = warc.Scan("f")
    for piece in whole.split(b"\r\n\r\n")[:-1]:
        scan.take(piece)
    hashed = [r for r in scan.rows if r["payload_digest"]]
    assert len(hashed) == 4 and sum(r["payload_bytes"] for r in hashed) == sum(map(len, html)) < len(whole)
    assert {r["record_id"] for r in scan.rows if not r["payload_digest"]} == {"<urn:x-page:99>"}
    read = warc.read_archives(spark, folder).collect()
    assert {(r.record_id, r.payload_digest) for r in read} == {(f"<urn:x-page:{i}>", hashlib.sha256(h.encode()).hexdigest()) for i, h in enumerate(html)}


def test_headers_of_a_piece_are_those_of_a_plain_search():
    rng = np.random.default_rng(5)
    parts = [b"WARC/1.1", b"WARC/1.0", b"x", b"\r\n", b"\r\n", b"WARC-Type: a", b"warc-type :b", b"Content-Length: 5", b"Content-Length: x", b"Content-Length: " + b"9" * 30, b":", b"\r", b"\n"]
    for _ in range(3000):
        piece = b"".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 12)))
        want, at = [], piece.find(b"WARC/1.")
        while at >= 0:
            first, *lines = piece[at:].split(b"\r\n")
            fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(b":") for x in lines) if colon}
            length = fields.get(b"content-length", b"")
            if len(first) <= 12 and b"warc-type" in fields and length.isdigit() and len(length) < 19:
                want.append((at, {k: v for k, v in fields.items() if k in warc._FIELDS}))
            at = piece.find(b"WARC/1.", at + 1)
        assert warc._headers(piece) == want


def test_no_pages(spark):
    assert warc.op4_warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

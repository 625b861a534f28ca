"""Line dedup, mixing, neighbours, URL filter, TIFF: against plain Python."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain import DOCS, SPACE, low, sha, words
from tidemark.llm import lines, mixing, neighbours, tiff, urls
from tidemark.llm.components import connected_components
from tidemark.llm.scratch import Scratch, shared_dir

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def key_of(line):
    return low(line.strip(SPACE).encode())


def test_line_dedup(edge, edge_rows):
    seen = Counter(k for r in edge_rows for k in {key_of(x) for x in (r[1] or "").split("\n")} if k)
    want = Counter()
    for i, text, *_ in edge_rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not (key_of(x) and seen[key_of(x)] >= 10)]
        want[i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)] += 1
    got = Counter((r.doc_id, r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in lines.dedup_lines(edge).collect())
    assert got == want and any(k[2] for k in got)


def test_line_dedup_edges(spark, none):
    assert lines.dedup_lines(none).count() == 0
    df = spark.createDataFrame([(i, "a\nA \nb") for i in range(3)], "doc_id long, text string").withColumns({"h1": F.lit(1), "key": F.lit("k"), "pos": F.lit(2), "line": F.lit("l"), "n": F.lit(0)})
    got = lines.dedup_lines(df, min_docs=3, batches=1).collect()
    assert {r["__kept"] for r in got} == {""} and got[0]["__n_dropped"] == 3 and got[0]["key"] == "k"
    one = spark.createDataFrame([(1, "\n".join(f"line {i % 7}" for i in range(20000)))], "doc_id long, text string")
    assert lines.dedup_lines(one, min_docs=1).first()["__kept"] == ""


def test_runs_compact(spark):
    runs = lines.LineRuns(spark, min_docs=3, fanout=2)
    for batch in range(5):
        runs.add(spark.createDataFrame([(1, 0, 1), (batch, 7, 1)], "h1 long, h2 long, n long"))
    assert {(r.h1, r.h2) for r in runs.finish().collect()} == {(1, 0)}


def water(sizes, weights, most):
    target, clamped = {}, set()
    total = sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(most * sizes[s] for s in clamped)
        share = {s: left * weights[s] / sum(weights[t] for t in free) for s in free}
        new = {s for s in free if share[s] > most * sizes[s]}
        if not new:
            return {s: share.get(s, most * sizes[s]) for s in sizes}
        clamped |= new


def test_mixing(edge, edge_rows):
    got = mixing.mix(edge).collect()
    assert len(got) == len(edge_rows)
    sizes = Counter()
    for r in edge_rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(sizes[s], round(want[s], 6)) for s in sizes})
    assert all(0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in got)
    again = mixing.mix(edge.repartition(5)).collect()
    plain = lambda rows: Counter(tuple(r) for r in rows)
    assert plain(got) == plain(again)
    mixed = mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns and mixed.count() == sum(r.repeats for r in got)


def test_mixing_reaches_targets(spark):
    rows = [(i, "w " * (1 + i % 5), "en", "abcd"[i % 4] if i % 9 else None, 0) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS))
    taken, target = Counter(), {}
    for r in got.collect():
        source = rows[r.doc_id][3]
        taken[source] += r.taken
        target[source] = r.target
    assert len(target) == 5 and all(abs(taken[s] - target[s]) <= 5 for s in target)


def test_mixing_edges(spark, none):
    assert mixing.mix(none).count() == 0
    empty = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", None)], DOCS)
    assert [(r.size, r.taken, r.target) for r in mixing.mix(empty).collect()] == [(0, 0, 0.0)] * 2


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000, 1000 + i) for i in range(200)] + [(i, i + 1) for i in range(2000, 2016)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), Scratch(spark, "t")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


PAGES = [(1, "http://x.example.org/es/1", '<link rel="canonical" href="https://other.example.com/fr/2">'), (2, "https://OTHER.example.com/fr/2#top", "<p>"),
         (3, "http://deep.other.example.net/de/8", None), (4, "https://a.net/fr", "<META HTTP-EQUIV=refresh content='0; url=/fr/9'>"), (5, "https://a.net/fr/9?x=1", ""), (6, None, None), (7, "nothing", "x"),
         (8, "http://example.com/en/71?q", '<link href="//x.example.org/es/1" rel=canonical>'), (9, "http://notexample.com/en/7", None), (10, "http://example.com/en/6", None), (11, "http://a.net", None),
         (12, "https://a.net/fr/9", '<link rel="canonical" href="http://x.example.org/es/1">'), (12, "https://a.net/fr/9", '<link rel="canonical" href="http://x.example.org/es/1">')]


def test_urls(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"node": F.lit(1), "host": F.lit("h"), "component": F.lit(0)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got == {
        1: ("x.example.org", "/es/1", "org/es/", "block"), 2: ("other.example.com", "/fr/2", None, "block"), 3: ("deep.other.example.net", "/de/8", "example.net/de/8", "block"),
        4: ("a.net", "/fr", None, "block"), 5: ("a.net", "/fr/9", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("example.com", "/en/71", "example.com/en/7", "allow"),
        9: ("notexample.com", "/en/7", "com/en/", "block"), 10: ("example.com", "/en/6", "com/en/", "block"), 11: ("a.net", "", None, "allow"), 12: ("a.net", "/fr/9", None, "block")}
    assert urls.filter_urls(df).count() == len(PAGES) and urls.filter_urls(df.limit(0)).count() == 0
    extra = spark.createDataFrame([("http://a.net/", "http://example.com/en/6")], "a string, b string")
    other = spark.createDataFrame([(1, "https://a.net/", None), (2, "http://example.com/en/6", None)], "page_id long, url string, html string")
    assert {r.verdict for r in urls.filter_urls(other, edges=extra).collect()} == {"block"}


def test_urls_of_many_rules(spark, monkeypatch):
    """Rules as a table judge as the expression does, also those of equal length; relative links are resolved."""
    rules = [*urls.RULES, ("block", "x.com", "/a"), ("allow", "com", "/abc"), ("allow", "net", "/de/"), ("block", "net", "/de/")]
    rows = [*PAGES, (20, "http://x.com/abc", None), (21, "http://y.x.com/ab", None), (22, "http://y.com/abcd", None), (23, "http://p.net/de/3", None),
            (24, "http://q.info/a/b/c?x=1", '<link rel=canonical href="../z?a=1&amp;b=2">'), (25, "http://q.info/a/z?a=1&b=2", None),
            (26, "http://q.info/k", '<link rel=canonical href="?p=2">'), (27, "http://q.info/k?p=2", '<link rel=canonical href="http://x.com/a">'), (28, "no url", '<link rel=canonical href="http://x.com/a">')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    wanted = sorted(map(str, urls.filter_urls(df, rules).collect()))
    by_id = {r.page_id: r for r in urls.filter_urls(df, rules).collect()}
    assert (by_id[20].rule, by_id[21].verdict, by_id[22].rule, by_id[23].verdict, by_id[28].verdict) == ("x.com/a", "block", "com/abc", "allow", "allow")
    assert by_id[24].alias_of == by_id[25].alias_of is not None and by_id[26].verdict == by_id[27].verdict == "block"
    monkeypatch.setattr(urls, "INLINE", 0)
    assert sorted(map(str, urls.filter_urls(df, rules).collect())) == wanted
    table = spark.createDataFrame(rules, "verdict string, host string, path string").coalesce(1)
    assert sorted(map(str, urls.filter_urls(df, table).collect())) == wanted


def test_urls_of_targets_that_are_no_rows(spark):
    rows = [(1, "http://a.net/1", '<link rel="canonical" href="http://x.example.org/es/1?q">'), (2, "http://b.net/2", "<meta http-equiv=refresh content='0; url=http://x.example.org/es/1?q'>"),
            (3, "http://c.net/3", None), (4, "http://d.net/4", '<link rel="canonical" href="http://x.example.org/fr/1">'), (5, "http://a.net/de/5", '<link rel="canonical" href="http://x.example.org/es/1?q">')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = spark.createDataFrame([("http://c.net/3", "http://gone.example.com/en/6#top")], "a string, b string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(df, edges=edges).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    plain = df.select("page_id", "url", F.lit(None).cast("string").alias("html"))
    assert {r.page_id: r.verdict for r in urls.filter_urls(plain, edges=edges).collect()} == {1: "allow", 2: "allow", 3: "block", 4: "allow", 5: "allow"}


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] + [1.0] * 15), (5080, [1.0]), (5100, []), (5120, [float("inf")] * 16), (7, rows[8][1]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"block": F.lit(1), "id": F.lit(2)})
    got = neighbours.search(df, df.where("vec_id % 20 = 0")).collect()
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and i < 5000 and v]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    hit = total = 0
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {i for i in range(0, 3000, 20)}
    for q, rs in found.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and all(a.score > b.score or (a.score == b.score and a.vec_id <= b.vec_id) for a, b in zip(rs, rs[1:]))
        s = m @ m[list(ids).index(q)]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit, total = hit + len(best & {r.vec_id for r in rs}), total + 20
        for r in rs:
            assert math.isclose(r.score, max(s[ids == r.vec_id]), rel_tol=1e-12) or r.vec_id == 7
    assert hit / total >= 0.9
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id, r.score) for r in neighbours.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, -1.0)]


@pytest.mark.parametrize("size", [1e-200, 1e200, 1.0])
def test_neighbours_of_any_length(spark, size):
    """Components whose squares are no double-precision numbers any more, beside a vector of another order of size."""
    x = np.random.default_rng(6).standard_normal((40, 4)) * size
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, [1e-300, 0.0, 0.0, 1e-310]), (120, [5e-324, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), k=60).collect()
    found = Counter(r.query_id for r in got)
    assert found == dict.fromkeys([0, 20, 100, 120], len(rows) - 1)


def recall(spark, sf_dir):
    """Share of the exact neighbours that op8 finds on a table of the driver's."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding is not None]
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in neighbours.op8_neighbours(spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        s = m @ m[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        hit += len(found & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    return hit / 20 / len(got)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, name):
    path = os.path.join(os.path.dirname(SF.rstrip("/")), name)
    if not os.path.isdir(path):
        pytest.skip("no such table")
    assert recall(spark, path) >= 0.9


def test_tiff_round_trip(edge, edge_rows, spark, none):
    got = tiff.read_pages(tiff.texts_to_tiff(edge).withColumn("page", F.lit("clash"))).collect()
    assert len(got) == len(edge_rows) and not any(r.error for r in got)
    want = Counter()
    for i, t, *_ in edge_rows:
        raw = (t or "").encode()
        want[i, len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))] += 1
    assert Counter((r.doc_id, r.n_bytes, bytes(r.pixels)) for r in got) == want
    assert len({r.compression for r in got}) == 3
    assert tiff.read_pages(tiff.texts_to_tiff(none)).count() == 0


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa", bytes(range(256)) * 40, b"abcabcabc" * 5000, os.urandom(9000), b"\0" * 70000])
def test_codecs(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    if data:
        rows = np.frombuffer(data, np.uint8).reshape(1, -1)
        assert tiff.packbits_decode(tiff.packbits_encode_rows(rows), len(data)) == data


@pytest.mark.parametrize("compression", [tiff.STORED, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor,tile", [(1, 0), (2, 0), (1, 32), (2, 48)])
def test_tiff_forms(compression, predictor, tile):
    rows = np.random.default_rng(0).integers(0, 9, (100, 70), dtype=np.uint8)
    (tags,) = tiff.directories(tiff.write_gray(rows, compression, predictor, tile, rows_per_strip=33))
    facts, out = tiff.decode_page(tiff.write_gray(rows, compression, predictor, tile, rows_per_strip=33), tags)
    assert (out[:, :, 0] == rows).all() and facts["layout"] == ("tiles" if tile else "strips")


def many_pages():
    """Big-endian, two pages: 16-bit planar with predictor, and 8-bit RGB."""
    import struct

    a = np.arange(24, dtype=">u2").reshape(2, 4, 3) * 1000
    planes = [np.diff(a[:, :, p].astype(np.int64), axis=1, prepend=0).astype(">u2").tobytes() for p in range(3)]
    b = np.arange(36, dtype=np.uint8).reshape(3, 4, 3)
    body = b"".join([*planes, b.tobytes()])
    base, ifd1 = 8, 8 + len(body)

    def ifd(tags, at, nxt):
        head, extra = struct.pack(">H", len(tags)), b""
        after = at + 2 + 12 * len(tags) + 4
        for t, v in sorted(tags.items()):
            head += struct.pack(">HHI", t, 4, len(v)) + (struct.pack(">I", v[0]) if len(v) == 1 else struct.pack(">I", after + len(extra)))
            extra += b"" if len(v) == 1 else struct.pack(f">{len(v)}I", *v)
        return head + struct.pack(">I", nxt(after + len(extra))) + extra

    n = len(planes[0])
    one = ifd({256: [4], 257: [2], 258: [16], 259: [1], 277: [3], 278: [2], 284: [2], 317: [2], 273: [base, base + n, base + 2 * n], 279: [n] * 3}, ifd1, lambda end: end)
    two = ifd({256: [4], 257: [3], 258: [8], 259: [1], 277: [3], 278: [3], 273: [base + 3 * n], 279: [36]}, ifd1 + len(one), lambda end: 0)
    return b"MM" + struct.pack(">HI", 42, ifd1) + body + one + two, a, b


def test_tiff_pages_and_bad_files(spark):
    data, a, b = many_pages()
    bad = tiff.write_gray(np.zeros((64, 64), np.uint8), tiff.LZW)
    files = spark.createDataFrame([(1, data), (2, None), (3, b"II"), (4, bad[:100]), (5, bad[:8] + b"\xff" * 20 + bad[28:])], "id long, media binary")
    got = {(r.id, r["page"]): r for r in tiff.read_pages(files).collect()}
    assert bytes(got[1, 0].pixels) == a.astype("<u2").tobytes() and bytes(got[1, 1].pixels) == b.tobytes() and got[1, 0].bits == 16
    assert all(got[i, 0].error and got[i, 0].pixels is None for i in (2, 3, 4, 5))


def test_tiff_sizes_that_cannot_be(spark):
    """Widths, strips and tiles of zero, and pages beyond all memory, give a row with an error each."""
    import struct

    good = tiff.write_gray(np.zeros((64, 64), np.uint8), tiff.DEFLATE)
    tiled = tiff.write_gray(np.zeros((64, 64), np.uint8), tiff.DEFLATE, tile=32)

    def changed(data, tag, value):
        at = data.index(struct.pack("<HHI", tag, 4, 1)) + 8
        return data[:at] + struct.pack("<I", value) + data[at + 4 :]

    files = [changed(good, tiff.WIDTH, 0), changed(good, tiff.LENGTH, 0), changed(good, tiff.ROWS_PER_STRIP, 0), changed(tiled, tiff.TILE_WIDTH, 0),
             changed(changed(good, tiff.WIDTH, 1 << 20), tiff.LENGTH, 1 << 22), changed(good, tiff.WIDTH, 1 << 31), changed(tiled, tiff.TILE_WIDTH, 1 << 30), changed(good, tiff.SAMPLES, 0)]
    got = tiff.read_pages(spark.createDataFrame([(i, f) for i, f in enumerate([*files, good])], "id long, media binary")).collect()
    assert {r.id: r.error is None for r in got} == {i: i == len(files) for i in range(len(files) + 1)}


def test_query_columns(spark):
    got = tiff.op10_tiff(spark, SF).limit(20).collect()
    assert all(r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes) and 0 <= r.tail_crc32 < 2**32 for r in got)
    assert zlib.crc32(b"") == 0 and shared_dir(spark) and sha("") == sha(b"")

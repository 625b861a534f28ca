"""Quality, language model, near duplicates, repeats, pieces and the pipeline: against plain Python."""

import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plain import DOCS, low, sha, words
from tidemark.llm import jaccard, lattice_lm, pieces, quality, repeats, scratch
from tidemark.llm import sentencepieces as sp

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


# ------------------------------------------------------------------ quality
def labelled(spark, n=400):
    rng = np.random.default_rng(2)
    good, bad = [f"word{i}" for i in range(300)], [f"slur{i}" for i in range(6)]
    rows, labels = [], []
    for i in range(n):
        kind = i % 5
        text = rng.choice(good, 60).tolist()
        if kind == 3:
            text[:8] = rng.choice(bad, 8).tolist()
        if kind == 4:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text), "en" if i % 2 else "fr", "s", 0))
        if i % 3:
            labels.append((i, int(kind != 4), int(kind == 3)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    kept = {r.doc_id for r in quality.select(docs, labels).collect()}
    held = [i for i in range(400) if i % 3 == 0]
    good, bad = [i for i in held if i % 5 < 3], [i for i in held if i % 5 >= 3]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.05 * len(bad)
    assert kept == {r.doc_id for r in quality.select(docs.repartition(7), labels).collect()}


def test_quality_recomputed(spark):
    """Rates, shares, weights, k and the sample itself, in plain numpy from the n-grams' cells."""
    docs, labels = labelled(spark, 150)
    docs = docs.union(docs.where("doc_id = 7").withColumn("doc_id", F.lit(1000).cast("long")))  # a copy of an unlabelled or labelled text
    rows, marks = docs.orderBy("doc_id").collect(), {r.doc_id: 1 if r.toxic else 0 if r.quality else 2 for r in labels.collect()}
    order = sorted(Counter(r.lang for r in rows).items(), key=lambda x: (-x[1], x[0]))
    group_of = {lang: i for i, (lang, _) in enumerate(order)}

    def cells(r):
        raw = np.frombuffer(r.text.encode(), np.uint8)
        return quality.features(raw, np.array([0, len(raw)]), np.array([group_of[r.lang]]))[0].tolist()

    own = {r.doc_id: cells(r) for r in rows}
    once = {}
    for r in rows:
        if r.doc_id in marks:
            once.setdefault((r.text, marks[r.doc_id]), r)
    count = [Counter() for _ in range(3)]
    for (_, kind), r in once.items():
        count[kind].update(own[r.doc_id])
    every = sum(count, Counter())
    total = lambda c, g: sum(n for cell, n in c.items() if cell >> quality.BITS == g)
    ratio = {(k, g): total(count[k], g) / max(total(every, g), 1) for k in range(3) for g in group_of.values()}
    logs = np.array([[sum(math.log(count[k][c] + 2) - math.log(every[c] * ratio[k, c >> quality.BITS] + 2) for c in own[r.doc_id]) for k in range(3)] for r in rows])
    share = np.bincount([k for _, k in once], minlength=3) / len(once)
    for _ in range(quality.STEPS):
        post = np.exp(logs + np.log(share + 1e-12) - np.logaddexp.reduce(logs + np.log(share + 1e-12), axis=1)[:, None])
        new, k = post.mean(axis=0), round(post[:, 0].sum())
        done = abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    weight = logs[:, 0] - np.logaddexp.reduce(logs + np.log(share + 1e-12), axis=1)
    noise = []
    for r in rows:
        u = (int(__import__("hashlib").md5(f"{quality.SEED}:{r.doc_id}".encode()).hexdigest()[:15], 16) + 0.5) / 2**60
        noise.append(-math.log(-math.log(u)))
    best = np.argsort(-(weight + noise), kind="stable")[:k]
    got = {r.doc_id: r for r in quality.select(docs, labels).collect()}
    assert set(got) == {rows[i].doc_id for i in best}
    assert np.allclose([got[rows[i].doc_id]["__log_weight"] for i in best], weight[best], rtol=1e-4, atol=1e-3)
    assert all(got[rows[i].doc_id]["__n_features"] == len(own[rows[i].doc_id]) for i in best)


def test_quality_edges(spark, edge, none, edge_rows):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (104, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.select(edge.withColumns({"kind": F.lit("k"), "n": F.lit(1), "cell": F.lit(2)}), labels)
    assert got.count() <= len(edge_rows) and "kind" in got.columns
    assert quality.select(edge, labels.limit(0)).count() == len(edge_rows)
    assert quality.select(none, labels).count() == 0


def test_quality_of_balanced_labels(spark):
    docs, _ = labelled(spark)
    kind = lambda i: {3: 1, 4: 2}.get(i % 5, 0)
    taken = [i for k in range(3) for i in [i for i in range(400) if kind(i) == k][:60]]
    labels = spark.createDataFrame([(i, int(kind(i) != 2), int(kind(i) == 1)) for i in taken], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.select(docs, labels).collect()}
    good, bad = [i for i in range(400) if not kind(i)], [i for i in range(400) if kind(i)]
    assert sum(i in kept for i in good) >= 0.9 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal(3000), np.full(500, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for k in (1, 2, 700, 1500, 3502):
        assert quality.kth_largest(df, "x", k, bins=16) == sorted(x, reverse=True)[k - 1]


# ------------------------------------------------------------ language model
def segmentations(s, v):
    if not s:
        yield ()
        return
    for j in range(1, min(len(s), v.longest) + 1):
        row = v.by_string.get(s[:j])
        if row is None and j == 1:
            row = int(v.byte_row[s[0]])
        if row is not None:
            for rest in segmentations(s[j:], v):
                yield (row, *rest)


def test_lattice_sums_all_segmentations(vocabulary):
    v = vocabulary
    rng = np.random.default_rng(1)
    w = np.log(rng.dirichlet(np.ones(len(v.strings)), 2) + 1e-12)
    strings = [b" the", b" hello", "élan".encode(), b"x", b"   a", b"\xff\xfe"]
    got = pieces.marginals(v, strings, w)
    for s, row in zip(strings, got, strict=True):
        for k in range(2):
            assert math.isclose(row[k], np.logaddexp.reduce([sum(w[k][r] for r in p) for p in segmentations(s, v)]), rel_tol=1e-9)
    counts = np.array([[2.0], [1.0], [1.0], [3.0], [1.0], [1.0]])
    want = np.zeros(len(v.strings))
    for s, c in zip(strings, counts[:, 0], strict=True):
        paths = list(segmentations(s, v))
        logs = np.array([sum(v.prior[r] for r in p) for p in paths])
        for p, q in zip(paths, np.exp(logs - np.logaddexp.reduce(logs)), strict=True):
            for r in p:
                want[r] += c * q
    assert np.allclose(pieces.expected_counts(v, strings, counts, v.prior)[:, 0], want)


def check_base(rows, got):
    train = Counter()
    out = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: [low(w) for w in words(t)] + [b""]
    for i, t, *_ in rows:
        if not out(i):
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    want = Counter((i, out(i), len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, f"{sum(math.log10((train[w] + .5) / (n + .5 * (v + 1))) for w in tokens(t)):.6f}") for i, t, *_ in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6f}") for r in got) == want


def test_lm_edges(edge, edge_rows, none, monkeypatch):
    got = lattice_lm.score(edge).collect()
    check_base(edge_rows, got)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    monkeypatch.setattr(lattice_lm, "FREQUENT", 5)  # nearly all words by the join
    joined = lattice_lm.score(edge).collect()
    check_base(edge_rows, joined)
    plain = lambda rows: Counter((r.doc_id, f"{r.score:.6f}") for r in rows)
    assert plain(got) == plain(joined)
    assert lattice_lm.score(none).count() == 0


def test_lm_weights_see_all_words(edge, monkeypatch):
    plain = lambda: Counter((r.doc_id, f"{r.score:.6f}") for r in lattice_lm.score(edge).collect())
    want = plain()
    for frequent in (5, 1):
        monkeypatch.setattr(lattice_lm, "FREQUENT", frequent)
        assert plain() == want


def test_lm_learns(spark):
    got = lattice_lm.op4_lm_score(spark, SF).collect()
    held = [r for r in got if r.held_out]
    untrained = -8.0  # log10 of a token under the vocabulary's own scores is far lower than this a token
    assert held and sum(r.score for r in held) / sum(r.n_tokens for r in held) > untrained


# ----------------------------------------------------------- near duplicates
def brute_components(rows, width, percent):
    sets = []
    for _, t, *_ in rows:
        w = [low(x) for x in words(t)]
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_near_duplicates(spark, edge, edge_rows, width, percent):
    got = Counter(tuple(r) for r in jaccard.near_duplicates(edge.withColumns({"token": F.lit(1), "g": F.lit(2), "sig": F.lit("s")}), width, percent).collect())
    assert got == brute_components(edge_rows, width, percent)


def test_near_duplicate_groups(spark):
    """Chains and large groups of near copies, beside texts that only share a passage."""
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(3000)]
    rows, base = [], rng.choice(vocab, 200).tolist()
    for i in range(60):
        t = list(base)
        for k in rng.integers(0, 200, rng.integers(0, 6)):
            t[k] = str(rng.choice(vocab))
        rows.append((i, " ".join(t), "en", "s", 0))
    chain = rng.choice(vocab, 150).tolist()
    for i in range(60, 80):
        chain = list(chain)
        chain[(i * 7) % 150] = f"c{i}"
        rows.append((i, " ".join(chain), "en", "s", 0))
    passage = rng.choice(vocab, 40).tolist()
    for i in range(80, 130):
        rows.append((i, " ".join([*rng.choice(vocab, 60).tolist(), *passage]), "en", "s", 0))
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    for width, percent in ((3, 90), (5, 80), (5, 95)):
        assert Counter(tuple(r) for r in jaccard.near_duplicates(df, width, percent).collect()) == brute_components(rows, width, percent)


def test_near_duplicates_of_nothing(spark, none):
    assert jaccard.near_duplicates(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, None, None)], DOCS)
    assert sorted(tuple(r) for r in jaccard.near_duplicates(blank).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_bit_filter(spark):
    values = [0, 1, 2, 32767, 32768, 32769, 65536, (1 << 18) - 1, (1 << 18) + 5, -1]
    table = jaccard.bit_filter(spark.createDataFrame([(v,) for v in values], "h long"), "h", 18)
    assert np.flatnonzero(jaccard._bit(np.arange(1 << 18), table)).tolist() == sorted({v % (1 << 18) for v in values})


def test_scores_recomputed(spark, edge, edge_rows, vocabulary):
    """The score of every row from counts, expected uses and lattices, in plain Python."""
    v = vocabulary
    trained = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 5 != 1
    named = sorted(Counter(r[2] for r in edge_rows).items(), key=lambda x: (-x[1], x[0] is not None and 1, x[0] or ""))
    classes = [x for x, _ in named if x is not None]
    k_of = lambda lang: classes.index(lang) if lang in classes else len(classes)
    n_classes = len(classes) + (None in dict(named))
    c = [Counter() for _ in range(n_classes)]
    tokens = lambda t: [low(w) for w in words(t)] + [b""]
    for i, t, lang, *_ in edge_rows:
        if trained(i):
            c[k_of(lang)].update(tokens(t))
    size = np.array([sum(x.values()) for x in c], float)
    once = np.array([sum(n == 1 and w != b"" for w, n in x.items()) for x in c])
    ends = np.array([x[b""] for x in c])
    unseen, share = np.minimum(0.5, 2 * (once + 1) / (size + 2)), (ends + 1) / (ends.sum() + n_classes)
    known = sorted(set().union(*c) - {b""})
    counts = np.array([[x[w] for x in c] for w in known], float)
    own = np.exp(v.prior) / np.exp(v.prior).sum()
    mixed = lambda u: np.log(lattice_lm.OWN * own + (1 - lattice_lm.OWN) * np.where(u.sum(axis=-1, keepdims=True) > 0, u / u.sum(axis=-1, keepdims=True).clip(1e-300), own))
    shared = v.prior
    for _ in range(lattice_lm.STEPS):
        uses = pieces.expected_counts(v, [b" " + w for w in known], counts, shared).T
        shared = mixed(uses.sum(axis=0))
    weights = mixed(uses)
    got = Counter((r.doc_id, round(r.score, 5)) for r in lattice_lm.score(edge).collect())
    want = Counter()
    for i, t, *_ in edge_rows:
        mine = Counter(tokens(t))
        by_class = np.log10(share)
        for w, n in mine.items():
            have = np.array([x[w] for x in c], float)
            if w == b"":
                p = (have + 1) / (size + 2)
            else:
                p = (1 - unseen) * have / np.maximum(size, 1) + unseen * np.exp(pieces.marginals(v, [b" " + w], weights)[0])
            by_class = by_class + n * np.log10(p)
        want[i, round(float(np.logaddexp.reduce(by_class * np.log(10)) / np.log(10)), 5)] += 1
    close = lambda x: sorted((-1 if i is None else i, s) for i, s in x.elements())
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-5, abs_tol=1e-4) for a, b in zip(close(got), close(want), strict=True))


# ------------------------------------------------------------------ repeats
def brute_repeats(rows, length):
    order = {i: k for k, i in enumerate(sorted({r[0] for r in rows if r[0] is not None}))}
    rank = lambda i: order[i] if i is not None else len(order)
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            first[k] = min(first.get(k, 1 << 60), rank(i))
    out = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < rank(i):
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i, len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), kept] += 1
    return out


@pytest.mark.parametrize("length", [50, 12])
def test_repeats(edge, edge_rows, length):
    got = repeats.remove_repeats(edge.withColumns({"h": F.lit(1), "doc": F.lit(2), "kind": F.lit(3), "start": F.lit("s")}), length).collect()
    assert Counter((r.doc_id, r["__n_bytes"], r["__n_removed"], r["__n_spans"], bytes(r["__kept"])) for r in got) == brute_repeats(edge_rows, length)


def test_repeats_of_random_cuts(spark):
    rng = np.random.default_rng(3)
    pool = [bytes(rng.integers(97, 101, rng.integers(20, 200)).astype(np.uint8)) for _ in range(25)]
    rows = [(int(rng.integers(0, 10**6)), b"".join(pool[k][int(rng.integers(0, 9)) :] for k in rng.integers(0, 25, 6)).decode(), "en", "s", 0) for _ in range(60)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert Counter((r.doc_id, r["__n_bytes"], r["__n_removed"], r["__n_spans"], bytes(r["__kept"])) for r in got) == brute_repeats(rows, 50)


def test_repeats_told_apart_by_both_halves():
    """Wholes that share their first 64 bits are different ones where the other 32 differ."""
    z = np.zeros(3, np.int64)
    e = repeats.Entries(np.array([3, 2, 1]), z, z, z, None, (np.full(3, 7, np.uint64), np.array([1, 1, 2], np.uint64) << np.uint64(32)))
    ids, more, least, number = e.wholes()
    assert ids.tolist() == [7, 7] and more.tolist() == [1, 2] and least.tolist() == [2, 1] and number.tolist() == [0, 0, 1]
    raw = lambda m, d: repeats.byte_planes(np.array([7], np.uint64)) + repeats.byte_planes(np.array([m], np.uint32)) + repeats.byte_planes(np.array([d]))
    assert repeats._answers(repeats.WHOLE, [1, 1, 1], [raw(1, 5), raw(2, 9), raw(1, 4)]).tolist() == [True, False, False]
    assert repeats._answers(repeats.CORE, [1, 1], [repeats.byte_planes(np.array([v], np.uint64)) for v in (7, 8)]).tolist() == [False, False]


def test_repeats_over_many_units_and_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "UNIT", 3000)
    rng = np.random.default_rng(8)
    words = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(60)]
    rows = [(int(i), " ".join(rng.choice(words[: 12 if i % 3 else 60], 80)), "en", "s", 0) for i in rng.permutation(200)]
    monkeypatch.setattr(repeats, "PART", 5000)
    got = repeats.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    assert Counter((r.doc_id, r["__n_bytes"], r["__n_removed"], r["__n_spans"], bytes(r["__kept"])) for r in got) == brute_repeats(rows, 50)
    with pytest.raises(TypeError):
        repeats.remove_repeats(spark.createDataFrame([("a", "t")], "doc_id string, text string"))


def test_repeats_of_nothing(none):
    assert repeats.remove_repeats(none).count() == 0


# ------------------------------------------------------------------- pieces
@pytest.mark.parametrize("text", ["the end", "on élan", "", "a\nb", "  x ", "▁", "aaaa", "\x00é", "hello  world\n\n x"])
def test_n_best(vocabulary, text):
    v, raw = vocabulary, text.encode()
    paths = sorted((-sum(v.prior[r] for r in p) for p in segmentations(b" " + raw, v)))
    for n in (1, 2, 5):
        (found,) = list(sp.encode_texts(v, [raw], n))
        assert len(found) == min(n, len(paths)) and np.allclose([-s for s, _ in found], paths[:n])
        assert all(sp.decode(v, rows) == raw for _, rows in found) and len({tuple(rows.tolist()) for _, rows in found}) == len(found)
        assert all(math.isclose(s, sum(v.prior[r] for r in rows), rel_tol=1e-9) for s, rows in found)


def test_cutting_changes_nothing(vocabulary, monkeypatch):
    texts = [b"some words here\nand  there", b"one"]
    cut = [[(round(s, 9), r.tolist()) for s, r in f] for f in sp.encode_texts(vocabulary, texts, 4)]
    monkeypatch.setattr(pieces, "can_cut", lambda v: False)
    whole = [[(round(s, 9), r.tolist()) for s, r in f] for f in sp.encode_texts(vocabulary, texts, 4)]
    assert [[s for s, _ in f] for f in cut] == [[s for s, _ in f] for f in whole] and cut[0][0] == whole[0][0]


def test_long_unspaced_text(vocabulary):
    """200 kB without a space: linear memory, and the best path is that of the short segments' way."""
    import tracemalloc

    rng = np.random.default_rng(9)
    text = bytes(rng.choice(np.frombuffer(b"etaoinshrdlu0123456789+/", np.uint8), 200_000))
    ((best, second),) = list(sp.encode_texts(vocabulary, [text], 2))
    tracemalloc.start()
    list(sp.encode_texts(vocabulary, [text[:20_000]], 2))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sp.decode(vocabulary, best[1]) == text and sp.decode(vocabulary, second[1]) == text and second[0] <= best[0] and most < 60e6
    part = text[: sp.LONG + 500]
    one = sp.Segments(vocabulary, [part, b" a"])
    limit, sp.LONG = sp.LONG, 1 << 20
    try:
        two = sp.Segments(vocabulary, [part, b" a"])
    finally:
        sp.LONG = limit
    assert np.allclose(one.score, two.score) and np.allclose(one.second, two.second) and one.flat.tolist() == two.flat.tolist()


def test_encode(spark, edge, edge_rows, none):
    got = sp.encode(edge.withColumns({"ids": F.lit(1), "score": F.lit(2)}), with_ids=True)
    rows = got.collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in rows) == Counter((i, sha(t or "")) for i, t, *_ in edge_rows)
    assert all(r.round_trip and r.n_found == 2 and r.second_score <= r.score for r in rows if r.n_bytes)
    back = sp.decode_ids(got.select("doc_id", F.col("ids")[0].alias("ids")), out="text").collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t, *_ in edge_rows)
    assert sp.encode(none).count() == 0


def test_query_asks_for_several(spark, vocabulary):
    """The query's N is above 2; its N best are those of the texts, recomputed."""
    rows = {r.doc_id: r for r in sp.op9_sentencepiece(spark, SF).collect()}
    assert max(r.n_found for r in rows.values()) == sp.N_BEST > 2
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(20).collect()]
    for d in docs:
        (found,) = list(sp.encode_texts(vocabulary, [(d.text or "").encode()], sp.N_BEST))
        every = hashlib.sha256()
        for _, at in found:
            ids = vocabulary.ids[at]
            every.update(len(ids).to_bytes(8, "little") + ids.tobytes())
        assert rows[d.doc_id].n_found == len(found) and rows[d.doc_id].nbest_sha256 == every.hexdigest()
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True) and rows[d.doc_id].decoded_sha256 == sha(d.text or "")
        assert len({at.tobytes() for _, at in found}) == len(found) and all(sp.decode(vocabulary, at) == (d.text or "").encode() for _, at in found)


# ----------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    sizes = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "near_duplicates":
            comps = brute_components([tuple(r) for r in before.collect()], 5, 80)
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c for _, _, c in comps})
    assert sizes[0] == sizes[1] >= sizes[2] > 0 and docs.where(~F.col("round_trip")).count() == 0


def test_pipeline_edges(spark, edge, none):
    for docs in (edge, none):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            docs = spark.createDataFrame(out.collect(), out.schema)


def test_driver_returns_freed_memory(spark):
    jvm = spark.sparkContext._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status"
    if not os.path.exists(status):
        pytest.skip("no /proc here")
    held = lambda: next(int(x.split()[1]) for x in open(status) if x.startswith("RssAnon")) // 1024
    scratch.Scratch._released = 0.0
    scratch.Scratch(spark, "t").release()  # what else is free goes first
    many = [jvm.java.util.zip.Deflater() for _ in range(600)]  # some 260 kB each outside the heap
    for x in many[:-1]:  # the last one lies above the others, so that they stay with the C library
        x.end()
    before = held()
    scratch.Scratch._released = 0.0
    scratch.Scratch(spark, "t").release()
    assert held() < before - 30
    many[-1].end()


def test_broadcasts_end_with_their_step(spark, monkeypatch):
    made, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: made.append(send(self, value)) or made[-1])
    docs, labels = labelled(spark, 60)
    twice = docs.union(docs.where("doc_id = 7").select(F.lit(1000).cast("long"), F.concat("text", F.lit(" more")), "lang", "source", "n_chars"))
    out = [quality.select(docs, labels), jaccard.near_duplicates(twice)]
    assert len(made) >= 3 and not any(b._jbroadcast.isValid() for b in made)
    assert out[0].count() and out[1].where("doc_id = 1000 and component = 7").count() == 1  # nothing needs them any more

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import importance, periodic_runs, segment_search
from rankweave.llm.common import Scratch

# ---- importance resampling --------------------------------------------------------------------------------------


def plain_features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_draw(docs, target, buckets=10_000, percent=25, least=20):
    """Sorted (doc_id, n_features, weight, score, rank); ids are unique and not null."""
    hashed = {i: (plain_features(t)[0], [zlib.crc32(f.encode()) % buckets for f in plain_features(t)[1]]) for i, t in docs}
    s, t = Counter(), Counter()
    for _, found in hashed.values():
        s.update(found)
    for text in target:
        t.update(zlib.crc32(f.encode()) % buckets for f in plain_features(text)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    rows = {}
    for i, (n, found) in hashed.items():
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i in rows if hashed[i][0] >= least), key=lambda i: (-rows[i][2], i))
    for place, i in enumerate(able[: percent * len(able) // 100]):
        rows[i][3] = place + 1
    return sorted((i, *r) for i, r in rows.items())


def drawn(df):
    return sorted((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect())


def test_crc_matrices_equal_zlib():
    rng = np.random.default_rng(1)
    features = [rng.integers(0, 256, n, np.uint8).tobytes() for n in [0, 1, 1, 2, 7, 7, 7, 255, 256, 257, 5000]] + [b"123456789"]
    assert importance.crc_of(features).tolist() == [zlib.crc32(f) for f in features]
    assert importance.crc_of([b"123456789"]).tolist() == [0xCBF43926] and len(importance.crc_of([])) == 0


@pytest.mark.parametrize("together, buckets", [(200_000, 10_000), (30, 10_000), (200_000, 100_000)])
def test_draw_equals_plain(spark, tiny, monkeypatch, together, buckets):
    monkeypatch.setattr(importance, "TOGETHER", together)
    rng = np.random.default_rng(2)
    words = ["Alpha", "beta", "Gamma42", "délta", "中文", "x", "the", "THE", "of", "_", "--"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, "!?\x00\x7f"), (303, "long" * 30_000), (304, "a b " * 30_000), (305, "É\x80𝄞 z\n9")]
    target = ["the beta of gamma42", None, "中文 x x x"]
    bench = spark.createDataFrame([(t, 1, 2) for t in target], "text string, doc_id int, n_words int")
    assert drawn(importance.resample(tiny(docs), bench, buckets=buckets)) == plain_draw(docs, target, buckets)


def test_draw_of_odd_rows(spark, tiny, odd):
    bench = spark.createDataFrame([("no id here",)], "text string")
    rows = importance.resample(odd, bench, least_words=1).collect()
    assert len(rows) == 10
    ranked = sorted(r["rank"] for r in rows if r["rank"] is not None)
    able = [r for r in rows if r.n_words >= 1]
    assert ranked == list(range(1, len(able) * 25 // 100 + 1))
    assert all(r.weight == 0 and r.n_features == 0 for r in rows if r.n_words == 0)
    twice = [r for r in importance.resample(odd, bench, percent=100, least_words=1).collect() if r.doc_id == 3]
    assert len(twice) == 2 and twice[0].score == twice[1].score and abs(twice[0]["rank"] - twice[1]["rank"]) == 1
    assert importance.resample(tiny([]), bench).count() == 0
    empty = importance.resample(tiny([(1, "one two")]), bench.limit(0), percent=100, least_words=1).first()
    assert (empty.n_features, empty["rank"]) == (3, 1)


def test_ties_and_a_hot_id(spark):
    """Equal scores are numbered by id; rows of one id spread over partitions and keep one order."""
    rows = spark.range(900).selectExpr("id % 3 * 0 + 5 AS doc_id", "30L AS n_words", "1L AS n_features", "0L AS weight")
    got = importance.draw(rows.unionByName(rows.selectExpr("4L AS doc_id", "n_words", "n_features", "weight").limit(2)), Scratch(spark, "t"), 50, 20, 7).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 452))


def test_benchmark_like_texts_are_drawn(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = plain_draw([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in bench.collect()])
    assert drawn(importance.resample(docs, bench)) == want


# ---- periodic runs ----------------------------------------------------------------------------------------------


def plain_runs(words, shortest=6, exponent=4):
    """Every period, every start: the definition."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, exponent * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def run_list(words, **settings):
    numbers = np.array([ord(w) for w in words], np.int64)
    return list(zip(*(x.tolist() for x in periodic_runs.find_runs(numbers, **settings))))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_the_definition(letters):
    rng = np.random.default_rng(letters)
    for _ in range(400):
        words = "".join(rng.choice(list("abcde")[:letters], rng.integers(0, 60)))
        if rng.random() < 0.7:  # periods of periods, cut and joined
            part = "".join(rng.choice(list("abcde")[:letters], rng.integers(1, 9)))
            words += (part * rng.integers(2, 9) + part[: rng.integers(0, len(part) + 1)]) * rng.integers(1, 6) + words[:7]
        assert run_list(words) == plain_runs(words), words
        assert run_list(words, shortest=20, exponent=5) == plain_runs(words, 20, 5), words


def test_runs_that_overlap_and_nest():
    for words in ["aaaaaabababababab", "abaabaabaabaabaaaaaa", ("aaaab" * 5 + "c") * 5, "a" * 5, "a" * 6, "abababab", "abcabcabcab", "abcabcabcabc"]:
        assert run_list(words) == plain_runs(words), words
    with pytest.raises(ValueError):
        run_list("aa", exponent=3)


def test_one_word_a_million_times():
    starts, lengths, periods = periodic_runs.find_runs(np.zeros(1_000_000, np.int64))
    assert (starts.tolist(), lengths.tolist(), periods.tolist()) == ([0], [1_000_000], [1])


@pytest.mark.parametrize("together", [200_000, 25])
def test_runs_of_texts(tiny, monkeypatch, together):
    monkeypatch.setattr(periodic_runs, "TOGETHER", together)
    docs = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "one"), (5, "x " * 9), (6, "a b\na  b a\tb a b c"), (7, "x " * 9), (7, "x " * 9), (None, "é é é é é é é"),
        (8, "a\x85a a a a a a a a a"), (9, "do it " * 40_000 + "now now now now now now"), (10, "y x x x x x x y y y y y y"), (11, "x y"),
    ]
    got = periodic_runs.periodic_runs(tiny(docs)).collect()
    assert [r.doc_id for r in got] == [i for i, _ in docs]
    for r, (_, text) in zip(got, docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = [(0, 80_000, 2), (80_000, 6, 1)] if r.doc_id == 9 else plain_runs(words)
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert periodic_runs.periodic_runs(tiny([])).count() == 0


def test_looped_tails(tiny):
    docs = [(i, f"  w{i % 3} one two\nthree  four five six seven " * (i % 7)) for i in range(400)] + [(None, "a b"), (500, None)]
    hit = 0
    for r, (i, text) in zip(periodic_runs.loop_tails(tiny(docs)).collect(), docs):
        words = (text or "").split()
        h = zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if i is not None and h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            assert r.text == " ".join(words[k if k < a else a + (k - a) % p] for k in range(n))
            hit += 1
        else:
            assert r.text == text
    assert hit > 20


def test_runs_query_equals_plain(spark):
    from rankweave.llm import queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got, some = queries.op13_periodic_runs(spark, d).collect(), 0
    assert len(got) == len(texts)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words)
        some += len(runs) > 0
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for k, w in enumerate(words) if k not in gone))
    assert some > 5


# ---- exact top-k search -----------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def plain_top(rows, is_query, k=20):
    able = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(64 * float(np.float32(x))) for x in v]
            able.append((i, [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in ints]))
    out = []
    for a, (i, v) in enumerate(able):
        if i is not None and is_query(i):
            scored = [(min(max(sum(map(int.__mul__, v, w)), -(1 << 63)), (1 << 63) - 1), j) for b, (j, w) in enumerate(able) if b != a and len(w) == len(v)]
            best = sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(best)]
    return Counter(out)


def vectors(kind, n=600, dims=32):
    rng = np.random.default_rng(5)
    if kind == "even":
        x = rng.normal(size=(n, dims))
    elif kind == "clustered":
        x = rng.normal(size=(12, dims))[rng.integers(0, 12, n)] * 3 + rng.normal(size=(n, dims)) * 0.05
    elif kind == "level":  # segments differ by their mean
        x = np.repeat(rng.normal(size=(n, 4)), dims // 4, axis=1) + rng.normal(size=(n, dims)) * 0.05
    else:  # few values: ties everywhere
        x = rng.integers(-1, 2, size=(n, dims)) / 64
    return [(int(i), v) for i, v in enumerate(x.astype(np.float32).astype(float).tolist())]


@pytest.mark.parametrize("kind", ["even", "clustered", "level", "ties"])
@pytest.mark.parametrize("block, levels", [(4096, (1, 4, 16)), (50, (1, 4, 16)), (50, (3, 7, 100))])
def test_top_products_equal_all_pairs(spark, kind, block, levels):
    rows = vectors(kind)
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS v", "2 AS _row", "'x' AS dims")
    got = segment_search.top_k(df, F.col("vec_id") % 20 == 0, block=block, levels=levels)
    assert Counter(map(tuple, got.collect())) == plain_top(rows, lambda i: i % 20 == 0)


def test_bounds_hold_and_prune():
    for kind, most in [("even", 1.01), ("clustered", 0.4), ("level", 0.4)]:
        x = np.floor(64 * np.array([v for _, v in vectors(kind, 2000)]))
        last = np.full((50, len(x)), np.inf)
        for n in (1, 2, 4, 8, 16, 32):
            bound = segment_search.statistics(x[:50], n) @ segment_search.statistics(x, n).T
            assert (bound >= x[:50] @ x.T - 1e-6).all() and (bound <= last + 1e-6).all()  # finer is never looser
            last = bound
        _, _, computed = segment_search.search_block(x[:50], x, np.arange(len(x)), np.arange(50), 20, (1, 4, 16))
        assert computed <= most * 50 * len(x), kind


def test_top_products_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.0, 0.0]), (0, [0.0, 0.0]), (20, [1.0, -0.01]), (1, [1.0, 1.0]), (None, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
        (40, [2.0]), (6, [3.0]), (60, []), (7, []), (80, [1.0, 2.0, 3.0]), (100, [3e38, -3e38, 1.0, 2.0]), (8, [1.0, 0.5, 3e38, 3.0]), (9, [2e9, 1e9, 1e9, 1.0]),
    ]
    df = spark.createDataFrame(rows, VECTORS)
    for block in (4096, 1):
        got = segment_search.top_k(df, F.col("vec_id") % 20 == 0, k=3, block=block)
        assert Counter(map(tuple, got.collect())) == plain_top(rows, lambda i: i % 20 == 0, 3)
    assert segment_search.top_k(df.limit(0), F.lit(True)).count() == 0
    assert segment_search.top_k(df.filter("vec_id = 1"), F.lit(False)).count() == 0


def test_a_third_of_all_vectors_is_one(spark):
    rows = vectors("even", 400)
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    got = segment_search.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, block=64)
    assert Counter(map(tuple, got.collect())) == plain_top(rows, lambda i: i % 20 == 0)
    per = defaultdict(int)
    for r in got.collect():
        per[r.query_id] += 1
    assert set(per.values()) == {20}

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import hamming_index, metric_join, url_filter

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_links(rows, cosine=0.93):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n, above, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is None or la != lb or not ok(a) or not ok(b) or len(a) != len(b):
                continue
            a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
            if (a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                above[max(top(i), top(j))] = min(top(i), top(j))
    lowest = {}
    for i in range(n):
        lowest[top(i)] = min(lowest.get(top(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], lowest[top(i)], rows[i][0] == lowest[top(i)]) for i in range(n))


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(float).tolist(), i % 2) for i in range(120)]
    for i in range(100):  # a chain of neighbours, copies, another length of the same direction
        base = np.array(rows[i % 5][1])
        rows.append((1000 - i, (base + rng.normal(size=8) * 0.15 * (i % 3)).tolist(), (i % 5) % 2))
    rows += [(2000, [0.0] * 8, 0), (2001, None, 0), (2002, [float("nan")] + [1.0] * 7, 0), (2003, [float("inf")] + [1.0] * 7, 0),
             (2004, rows[0][1], None), (2005, [], 0), (2006, rows[0][1][:4], 0), (2007, [None] + [1.0] * 7, 1)]
    return rows


@pytest.mark.parametrize("cell, block", [(4096, 1024), (20, 16)])
def test_links_equal_all_pairs(spark, vector_rows, cell, block):
    df = spark.createDataFrame(vector_rows, VECTORS).selectExpr("*", "1 AS node", "2 AS cell", "'x' AS v")
    got = sorted(map(tuple, metric_join.link_vectors(df, cell=cell, block=block).collect()))
    assert got == plain_links(vector_rows)


def test_links_of_a_pivot_alone_in_its_cell(spark):
    rng = np.random.default_rng(8)
    rows = []
    for label in range(200):  # three near copies and a noisier one, of which two become pivots
        base = rng.normal(size=16)
        base /= np.linalg.norm(base)
        rows += [(label * 4 + i, (base + rng.normal(size=16) * (0.05 if i == 0 else 0.005)).tolist(), label) for i in range(4)]
    want = plain_links(rows)
    assert sum(n for _, n, _, _ in want) > 2300
    assert sorted(map(tuple, metric_join.link_vectors(spark.createDataFrame(rows, VECTORS), cell=2).collect())) == want


def test_only_pivots_reach_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(0, i, rng.normal(size=4).tobytes()) for i in range(60)] + [(1 + i // 3, 60 + i, rng.normal(size=4).tobytes()) for i in range(900)]
    nodes = spark.createDataFrame([(label, 4, node, v) for label, node, v in rows], "label int, dims int, node long, v binary")
    sizes, collect = [], type(nodes).collect
    monkeypatch.setattr(type(nodes), "collect", lambda df: sizes.append(len(out := collect(df))) or out)
    pivots = metric_join._pivots(nodes, 10, 100)
    assert {k: len(v) for k, v in pivots.items()} == {(0, 4): 6}
    assert max(sizes) == 6


def test_links_of_few(spark):
    assert metric_join.link_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    got = metric_join.link_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)], VECTORS)).collect()
    assert sorted((r.n_links, str(r.component_id), r.kept) for r in got) == [(0, "None", True), (1, "1", True), (1, "1", True)]


def brute(rows, is_query, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = Counter(len(v) for _, v in ok).most_common(1)[0][0]
    ok = [(i, v) for i, v in ok if len(v) == size]
    out = {}
    for a, (i, v) in enumerate(ok):
        if is_query(i):
            out[i] = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for b, (j, w) in enumerate(ok) if b != a)[:k]
    return out


@pytest.mark.parametrize("block, ask", [(4096, 1024), (16, 3)])
def test_search_of_every_code_is_exact(spark, vector_rows, block, ask):
    df = spark.createDataFrame(vector_rows, VECTORS).selectExpr("*", "1 AS j", "2 AS _row")
    got = hamming_index.nearest(df, F.col("vec_id") % 10 == 0, radius=64, block=block, ask=ask).orderBy("query_id", "rank").collect()
    want = brute(vector_rows, lambda i: i % 10 == 0, 10)
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r.score, r.vec_id))
    assert by.keys() == want.keys()
    for q, found in by.items():
        assert [v for _, v in found] == [v for _, v in want[q]]
        assert [s for s, _ in found] == pytest.approx([s for s, _ in want[q]], rel=1e-12)


def test_probing_misses_no_code_within_the_radius(spark, vector_rows):
    """Substrings find what a scan of all codes within the radius finds."""
    rows = [r for r in vector_rows if r[0] < 2000]
    df = spark.createDataFrame(rows, VECTORS)
    x = np.array([np.array(v, np.float32) for _, v, _ in rows], float)
    # The operator learns from its sample in hash order; all rows here, so the same rotation up to the order of sums.
    order = [r[0] for r in df.select("vec_id", F.col("embedding").cast("array<double>").alias("a")).orderBy(F.xxhash64("a"), "vec_id").collect()]
    at = {i: k for k, (i, _, _) in enumerate(rows)}
    mean, projection = hamming_index.learn_rotation(x[[at[i] for i in order]])
    code = hamming_index.codes(x, mean, projection)
    got = defaultdict(set)
    for r in hamming_index.nearest(df, F.col("vec_id") % 20 == 0, k=300, radius=20, substrings=8).collect():
        got[r.query_id].add(r.vec_id)
    for q in got:  # fewer than k within the radius: the second pass adds all others, so look at a small k as well
        assert len(got[q]) == len(rows) - 1
    some = hamming_index.nearest(df, F.col("vec_id") % 20 == 0, k=2, radius=20, substrings=8).collect()
    for q in {r.query_id for r in some}:
        near = np.nonzero(np.bitwise_count(code ^ code[at[q]]).sum(axis=1) <= 20)[0]
        near = [k for k in near if rows[k][0] != q]
        if len(near) >= 2:
            best = sorted((float(np.sqrt(((x[k] - x[at[q]]) ** 2).sum())), rows[k][0]) for k in near)[:2]
            assert [v for _, v in best] == [r.vec_id for r in sorted(some, key=lambda r: r.rank) if r.query_id == q]


def test_shares_are_a_pigeonhole_bound():
    rng = np.random.default_rng(0)
    for radius in range(0, 64):
        share = hamming_index.shares(64, 16, radius)
        for _ in range(50):
            flips = np.zeros(64, int)
            flips[rng.choice(64, radius, replace=False)] = 1
            assert (flips.reshape(16, 4).sum(axis=1) <= np.array(share)).any()


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    got = defaultdict(set)
    for r in hamming_index.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    want = brute(rows, lambda i: i % 100 == 0, 10)
    assert np.mean([len(got[q] & {v for _, v in best}) / 10 for q, best in want.items()]) >= 0.9


@pytest.mark.parametrize("dims, clusters", [(64, 0), (256, 0), (768, 0), (64, 40), (256, 40), (768, 40), (3, 0)])
def test_learned_radius_keeps_recall(dims, clusters):
    """Radius and substrings from the sample alone, held against brute force over four times as many rows."""
    rng = np.random.default_rng(dims + clusters)
    x = rng.normal(size=(4000, dims))
    if clusters:
        x = rng.normal(size=(clusters, dims))[rng.integers(clusters, size=4000)] + 0.2 * x
    bits = min(hamming_index.MOST_BITS, 64 * -(-dims // 64))
    mean, projection = hamming_index.learn_rotation(x[:1000], bits)
    code = hamming_index.codes(x, mean, projection)
    radius = hamming_index.learn_radius(x[:1000], code[:1000], 10, hamming_index.RECALL)
    held = []
    for q in range(1000, 4000, 100):
        gap = ((x - x[q]) ** 2).sum(axis=1)
        gap[q] = np.inf
        near = np.argsort(gap)[:10]
        held.append((np.bitwise_count(code[near] ^ code[q]).sum(axis=1) <= radius).mean())
    assert np.mean(held) >= 0.9  # the radius comes from a quarter of the rows
    n = hamming_index.best_substrings(bits, radius)
    if n:
        share = hamming_index.shares(bits, n, radius)
        assert sum(len(hamming_index._flips(bits // n, s)) for s in share) < 2 ** (bits // n)  # fewer pairs than a scan
    assert not clusters or n


@pytest.mark.parametrize("dims, clusters", [(256, 0), (96, 30)])
def test_recall_off_the_table(spark, dims, clusters):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(1500, dims))
    if clusters:
        x = rng.normal(size=(clusters, dims))[rng.integers(clusters, size=1500)] + 0.2 * x
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = defaultdict(set)
    for r in hamming_index.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, sample=1000).collect():
        got[r.query_id].add(r.vec_id)
    want = brute(rows, lambda i: i % 50 == 0, 10)
    assert np.mean([len(got[q] & {v for _, v in best}) / 10 for q, best in want.items()]) >= 0.95


def test_search_of_few(spark):
    assert hamming_index.nearest(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0
    got = hamming_index.nearest(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], VECTORS), F.col("vec_id") == 1)
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in got.collect()) == [(1, 1, 1, 0.0), (1, 1, 1, 0.0), (1, 2, 2, 1.414214), (1, 2, 2, 1.414214)]


# ---- URLs -------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://A.B.Net/x?y#z", "https://net/", "http://net", "http://Example.NET/en/1", "http://example.net/enx",
    "http://sub.example.com/de/", "http://example.com/de", "http://notexample.com/de/", "http://x.org/fr/?q", "http://x.org?/fr/",
    "a://b://c/d", "http://ex.org/de\n/p", "http://É.net/É", "http://www.bad.org/p.html", "https://bad.org/p/#f", "http://bad.org:80/p", "http://bad.org/P",
    "http://bad.org/p", "http://bad.org/p",
]
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
         (None, "x", "/"), ("block", None, "/"), ("block", "net", "/")]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest.split("/")[0].split("?")[0].split("#")[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), a, h + p) for a, h, p in RULES if a and h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[1]
    return host, path, None, "block" if host.replace("www.", "").removesuffix(":80") == "bad.org" and path in ("/p", "/p/", "/p.html") else "allow"


def test_verdicts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "1 AS key", "'h' AS host", "2 AS _block", "3 AS row")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    listed = spark.createDataFrame([("bad.org/p",), ("bad.org/p",), (None,), ("",)], "key string")
    got = url_filter.judge_urls(pages, rules, listed).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url), r.url
        assert (r.key, r._block, r.row) == (1, 2, 3)
    nothing = url_filter.judge_urls(pages, rules.limit(0), listed.limit(0)).collect()
    assert {r.verdict for r in nothing} == {"allow"} and url_filter.judge_urls(pages.limit(0), rules, listed).count() == 0


def test_hosts_of_very_many_labels(spark):
    hosts = ["a." * 50_000 + "x.net", "b." * 50_000 + "sub.example.com", "c." * 50_000 + "none", "bad.org\n"]
    pages = spark.createDataFrame([(i, f"http://{h}/de/") for i, h in enumerate(hosts)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    listed = spark.createDataFrame([("bad.org/de",)], "key string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, listed).collect()}
    assert got == {0: ("net/", "block"), 1: ("example.com/de/", "block"), 2: (None, "allow"), 3: (None, "allow")}
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0), listed).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negative_and_the_join_no_false_positive(spark):
    listed = spark.range(500).selectExpr("concat('k', id) AS key")
    asked = spark.range(2000).selectExpr("concat('k', id) AS key")
    assert url_filter.listed_keys(asked, listed, bits_per_key=4).count() == 500


def test_url_plan_is_native(spark):
    from rankweave.llm import queries

    plan = queries.op5_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))

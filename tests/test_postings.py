import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from rankweave.operators import postings as p
from rankweave.operators import retrieval as r
from rankweave.sources import tables
from rankweave.streaming import index_upkeep as up

MENTIONS = "model string, disease string, CUI string, UMLS_name string, semantic_type_name string"
QUERIES = "dataset string, patient_id string, CUI string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def key(df):
    return sorted(tuple(x) for x in df.collect())


def mention_rows(seed, diseases=400):
    """A concept in every disease, some in many, most in few; lengths differ."""
    rng, rows = random.Random(seed), []
    for m in "ab":
        for d in range(diseases):
            for c in ["hot"] * rng.randint(1, 6) + [f"w{rng.randint(0, 5)}" for _ in range(rng.randint(0, 12))] + [f"r{rng.randint(0, 150)}" for _ in range(4)]:
                rows.append((m, f"d{d}", c, f"{rng.choice('xyz')} {c}", rng.choice(["Finding", "Enzyme"])))
    return rows


def query_rows(seed):
    rng = random.Random(seed)
    rows = [("p", str(q), c) for q in range(40) for c in {"hot", f"w{q % 6}", f"w{(q + 1) % 6}", f"r{rng.randint(0, 150)}", f"r{rng.randint(0, 150)}", "none"}]
    return rows + [("p", "only hot", "hot"), ("p", "nothing", "none"), ("p", "one rare", "r1")]


def direct(queries, index, k):
    pairs = queries.join(index, "CUI").groupBy(*r.QUERY, "disease").agg(
        F.round(F.sum("bm25"), r.SCORE_DIGITS).alias("bm25_sum"), F.count("*").alias("shared_cui_count"))
    return key(r._top_k(pairs, k))


@pytest.mark.parametrize("seed, bands, seed_rows", [(1, 8, 200), (2, 1, 20), (3, 30, 5)])
def test_block_matching_equals_direct(spark, seed, bands, seed_rows):
    index = r.bm25_index(spark.createDataFrame(mention_rows(seed), MENTIONS)).cache()
    queries = spark.createDataFrame(query_rows(seed), QUERIES)
    blocks = p.posting_blocks(index, bands).cache()
    for k in (1, 5):
        want = direct(queries, index, k)
        assert key(p.match_blocks(queries, blocks, k, seed_rows)) == want
        assert key(p.match_blocks(queries, blocks, k, seed_rows, bounds=p.block_bounds(blocks))) == want
        assert key(r.bm25_match(queries, index, k, seed_rows)) == want
    index.unpersist()
    blocks.unpersist()


def test_more_wanted_than_there_are(spark):
    index = r.bm25_index(spark.createDataFrame(mention_rows(4, 30), MENTIONS))
    queries = spark.createDataFrame(query_rows(4), QUERIES)
    assert key(p.match_blocks(queries, p.posting_blocks(index), 1000)) == direct(queries, index, 1000)
    assert p.match_blocks(queries.limit(0), p.posting_blocks(index)).count() == 0
    assert p.match_blocks(queries, p.posting_blocks(index.limit(0))).count() == 0


def test_ties_at_the_bound_stay(spark):
    rows = [("m", f"d{i:02d}", c, 1.0 if i < 9 else 0.5) for i in range(60) for c in ("x", "y")]
    index = spark.createDataFrame(rows, "model string, disease string, CUI string, bm25 double")
    queries = spark.createDataFrame([("p", "1", "x"), ("p", "1", "y")], QUERIES)
    got = p.match_blocks(queries, p.posting_blocks(index), 5, seed_rows=6)
    assert [x.disease for x in got.orderBy("rank").collect()] == [f"d{i:02d}" for i in range(5)] and key(got) == direct(queries, index, 5)


def test_fewer_postings_are_joined(spark):
    """The strong concepts' weak blocks are skipped too, which leaving out weak concepts alone cannot do."""
    index = r.bm25_index(spark.createDataFrame(mention_rows(5, 1500), MENTIONS)).cache()
    queries = spark.createDataFrame([("p", str(q), f"w{q}") for q in range(6)] + [("p", str(q), "hot") for q in range(6)], QUERIES)
    read = p.postings_read(queries, p.posting_blocks(index), k=5).agg(F.sum("postings").alias("all"), F.sum("read").alias("read")).first()
    strong = queries.filter("CUI <> 'hot'").join(index, "CUI").count()
    assert read["all"] == queries.join(index, "CUI").count() and read["read"] < 0.5 * strong
    index.unpersist()


def test_blocks_are_bands_of_weight(spark):
    index = r.bm25_index(spark.createDataFrame(mention_rows(6), MENTIONS))
    rows = p.posting_blocks(index, bands=2).groupBy("model", "CUI", "block").agg(F.max("bm25").alias("high"), F.min("bm25").alias("low"))
    assert all(x.low > x.high / 2 ** 0.5 * 0.999999 for x in rows.collect())
    assert "Window" not in plan_of(p.posting_blocks(index))  # no task sorts all postings of a concept


@pytest.fixture
def table(spark):
    name = f"t_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def children(plan, at):
    """The subtrees right below line ``at`` of a printed plan, as lists of lines."""
    depth = lambda line: re.search(r"[A-Za-z*(]", line).start()
    lines, out = plan.splitlines(), []
    for line in lines[at + 1:]:
        if not line.strip() or depth(line) <= depth(lines[at]):
            break
        if depth(line) == depth(lines[at]) + 3:
            out.append([])
        out[-1].append(line)
    return out


def test_bucketed_index_is_not_shuffled(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = r.bm25_index(spark.createDataFrame(mention_rows(7, 60), MENTIONS))
        stored = tables.save_bucketed(index, table, ["model", "disease", "CUI"], 8)
        assert key(stored) == key(index)
        queries = spark.createDataFrame(query_rows(7), QUERIES)
        ranked = spark.createDataFrame(r.bm25_match(queries, index, 3).collect())
        got = r.matched_concepts(ranked, queries, stored)
        plan = plan_of(got)
        assert key(got) == key(r.matched_concepts(ranked, queries, index))
        (at,) = [i for i, line in enumerate(plan.splitlines()) if re.search(r"SortMergeJoin \[model#\d+, disease#\d+, CUI#\d+\]", line)]
        left, right = children(plan, at)
        assert any("Bucketed: true" in line for line in right) and not any("Exchange" in line for line in right), plan
        assert any("Exchange" in line for line in left)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ---- index upkeep -----------------------------------------------------------------------------------------------


def index_rows(df):
    return sorted((x.model, x.disease, x.CUI, x.UMLS_name, x.semantic_type_name, x.tf, x.df, round(x.idf, 9), round(x.bm25, 9)) for x in df.collect())


def test_three_batches_equal_a_rebuild(spark, tmp_path):
    rows, path = mention_rows(8, 90), f"file://{tmp_path}/index"
    part = lambda i: spark.createDataFrame([x for x in rows if int(x[1][1:]) % 3 == i] + [(None, "d", "c", "n", "t"), ("a", None, "c", "n", "t"), ("a", "d", None, "n", "t")], MENTIONS)
    whole = lambda n: index_rows(r.bm25_index(spark.createDataFrame([x for x in rows if int(x[1][1:]) % 3 < n], MENTIONS)))
    for i in range(3):
        assert up.add_batch(part(i), path, f"b{i}") == [f"b{j}" for j in range(i + 1)]
        assert index_rows(up.read_index(spark, path)) == whole(i + 1)
    assert index_rows(up.read_index(spark, path, upto="b1")) == whole(2)
    old = {(x[0], x[1], x[2]): x[8] for x in whole(1)}
    new = {(x[0], x[1], x[2]): x[8] for x in whole(3)}
    assert sum(new[k] != v for k, v in old.items()) > len(old) / 2  # old weights change
    # run again, and the same diseases under another name: nothing is added
    up.add_batch(part(1), path, "b1")
    up.add_batch(part(1), path, "b9")
    assert index_rows(up.read_index(spark, path)) == whole(3)


def test_an_unfinished_batch_does_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = mention_rows(9, 30)
    one, two = (spark.createDataFrame([x for x in rows if int(x[1][1:]) % 2 == i], MENTIONS) for i in range(2))
    up.add_batch(one, path, "one")
    up.add_batch(two, path, "two")
    whole = index_rows(up.read_index(spark, path))
    (tmp_path / "index/two/_done").unlink()  # as if the run had ended before
    assert up.batches(spark, path) == ["one"] and len(index_rows(up.read_index(spark, path))) < len(whole)
    up.add_batch(two, path, "two")
    assert index_rows(up.read_index(spark, path)) == whole
    with pytest.raises(ValueError):
        up.add_batch(one, path, "../x")
    with pytest.raises(ValueError):
        up.read_index(spark, f"{path}-none")


def test_old_terms_are_not_read_again(spark, tmp_path):
    """A damaged term file of an old batch stops reading the index, not adding to it."""
    path = f"file://{tmp_path}/index"
    rows = mention_rows(10, 20)
    up.add_batch(spark.createDataFrame(rows[: len(rows) // 2], MENTIONS), path, "one")
    for part in ("terms", "spellings", "concepts"):
        for f in (tmp_path / "index/one" / part).glob("part-*"):
            f.rename(f.with_suffix(".hidden"))
    assert up.add_batch(spark.createDataFrame([("a", "new", "hot", "n", "t")], MENTIONS), path, "two") == ["one", "two"]
    (x,) = spark.read.parquet(f"{path}/two/terms").collect()
    assert (x.disease, x.tf, x.doc_len) == ("new", 1, 1)


def test_index_upkeep_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    up.add_batch(spark.createDataFrame([], MENTIONS), path, "empty")
    assert up.read_index(spark, path).count() == 0
    up.add_batch(spark.createDataFrame(mention_rows(11, 10), MENTIONS), path, "more")
    assert index_rows(up.read_index(spark, path)) == index_rows(r.bm25_index(spark.createDataFrame(mention_rows(11, 10), MENTIONS)))

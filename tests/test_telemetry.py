import json

import pytest

from rankweave.operators import citations as c
from rankweave.operators import telemetry as t


def test_runtime_stats(spark):
    df = spark.createDataFrame([("m", "1.0"), ("m", "3.0"), ("m", "bad"), ("m", None), ("n", "2")], "model string, total_running_time string")
    row = {r["model"]: r for r in t.runtime_stats(df).collect()}["m"]
    assert (row["avg_total_running_time"], row["std_total_running_time"], row["record_count"], row["iqr_total_running_time"]) == (2.0, 1.0, 2, 2.0)


USAGE = [
    ("a", '{"input_tokens": 10, "output_tokens": 4, "output_tokens_details": {"reasoning_tokens": 1}}'),
    ("a", '{"input_tokens": 30, "output_tokens": "x"}'),
    ("a", "not json"),
    ("a", None),
]


def test_token_stats(spark):
    paths = {"input": "input_tokens", "output": "output_tokens", "reasoning": "output_tokens_details.reasoning_tokens"}
    values = t.token_values(spark.createDataFrame(USAGE, "model string, usage string"), "usage", paths)
    rows = {r["metric"]: r for r in t.token_stats(values).collect()}
    assert rows["input"]["avg_value"] == 20.0 and rows["output"]["n"] == 1 and rows["reasoning"]["std_value"] is None
    assert t.token_ratios(values, {"share": ("reasoning", "output"), "none": ("x", "input")}).first().asDict() == {"model": "a", "share": 0.25, "none": None}


def test_token_cost_tiers(spark):
    usage = spark.createDataFrame([("unpriced", 5, 5), ("flat", 1_000_000, 1_000_000), ("tier", 200_000, 100_000), ("tier", 200_001, 100_000)], "model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("flat", None, 3.0, 3.0, 15.0, 15.0), ("tier", 200_000, 1.25, 2.5, 10.0, 15.0)],
        "model string, threshold long, input_low double, input_high double, output_low double, output_high double")
    rows = {r["model"]: r for r in t.token_cost(usage, prices).collect()}
    assert rows["flat"]["total_cost"] == 18.0 and rows["flat"]["n_unpriced"] == 0
    assert rows["unpriced"]["total_cost"] is None and rows["unpriced"]["n_unpriced"] == 1
    assert rows["tier"]["input_cost"] == pytest.approx(0.25 + 0.200001 * 2.5, abs=1e-6) and rows["tier"]["output_cost"] == 2.5


def responses(spark, value):
    return spark.createDataFrame([("m", "d", value), ("m", "bad", "{oops"), ("m", "null", None)], "model string, disease_name string, j string")


def test_query_layouts(spark):
    blocks = json.dumps([{"type": "server_tool_use", "name": "web_search", "input": {"query": "q\"1"}}, {"type": "text", "text": "x"},
                         {"type": "server_tool_use", "name": "web_search", "input": {}}, {"type": "server_tool_use", "name": "other", "input": {"query": "no"}}])
    events = json.dumps([{"type": "web_search_call", "action": {"query": "q", "type": "search"}}, {"type": "web_search_call", "action": {"query": "q"}}, {"type": "reasoning"}])
    grounding = {"grounding_metadata": {"web_search_queries": ["a", "b"]}}
    get = lambda layout, value, **kw: sorted(r["query"] for r in t.extract_queries(responses(spark, value), layout, "j", **kw).collect())
    assert get("blocks", blocks) == ['q"1']
    assert get("events", events) == ["q", "q"] and get("events", events, distinct=True) == ["q"]
    assert get("grounding", json.dumps(grounding)) == ["a", "b"]
    assert get("grounding", json.dumps([grounding, {"content": 1}, grounding])) == ["a", "a", "b", "b"]
    with pytest.raises(ValueError):
        t.extract_queries(responses(spark, blocks), "unknown", "j")


def test_query_counts_with_missing_diseases(spark):
    queries = spark.createDataFrame([("m", "d1", "x"), ("m", "d1", "y"), ("m", "d2", "x")], "model string, disease_name string, query string")
    diseases = spark.createDataFrame([("m", "d1"), ("m", "d2"), ("m", "d3")], "model string, disease_name string")
    row = t.query_count_summary(queries, diseases).first()
    assert (row["avg_query_count"], row["min_query_count"], row["max_query_count"], row["num_diseases_with_queries"]) == (1.0, 1, 2, 2)
    assert t.query_count_summary(queries).first()["avg_query_count"] == 1.5


def test_flatten_responses(spark):
    block_answer = {"id": "1", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "hidden", "encrypted_content": "z"},
              {"type": "web_search_tool_result", "content": [{"title": "t", "url": "u", "encrypted_content": "z"}, {"title": "k", "url": "v"}]}, {"type": "text", "text": "b"}]}
    event_answer = {"id": "2", "output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "first"}, {"type": "output_text", "text": "second"}]}]}
    choice_answer = {"id": "3", "choices": [{"message": {"content": "choice"}}]}
    part_answer = {"id": "4", "candidates": [{"content": {"parts": [{"text": "part"}, {"text": "later"}]}}]}
    rows = [("m", str(i), json.dumps(d)) for i, d in enumerate((block_answer, event_answer, choice_answer, part_answer))] + [("m", "bad", "nope"), ("m", "null", None)]
    out = {r["disease_name"]: r for r in t.flatten_responses(spark.createDataFrame(rows, "model string, disease_name string, response string"), ["id", "content", "choices"]).collect()}
    assert [out[str(i)]["disease_text"] for i in range(4)] == ["a\nb", "first", "choice", "part"]
    assert out["0"]["id"] == "1" and "encrypted" not in out["0"]["content"] and '"title":"k"' in out["0"]["content"] and '"title":"t"' not in out["0"]["content"]
    assert json.loads(out["2"]["choices"]) == choice_answer["choices"]
    assert out["bad"]["disease_text"] is None and out["null"]["id"] is None


def test_citation_extractors(spark):
    text = "x [A](https://a.org/p?q=1) y [B c](http://b.org) [no](ftp://z) [A](https://a.org/p?q=1)"
    md = spark.createDataFrame([("d", text), ("e", "none"), ("n", None)], "disease_name string, disease_text string")
    cites = c.markdown_citations(md)
    assert sorted((r["label"], r["domain"]) for r in cites.collect()) == [("A", "a.org"), ("A", "a.org"), ("B c", "b.org")]
    assert sorted(r["disease_name"] for r in c.diseases_without_citations(md, cites).collect()) == ["e", "n"]
    stats = c.citation_stats(cites).first()
    assert (stats["total_citations"], stats["n_diseases"], stats["std_citations"]) == (3, 1, None)
    chunks = [{"grounding_metadata": {"grounding_chunks": [{"web": {"uri": "https://x.org/1", "title": "x.org"}}, {}]}}, {"grounding_metadata": {"grounding_chunks": [{"web": {"uri": "https://y.org"}}]}}]
    got = c.grounding_citations(spark.createDataFrame([("d", json.dumps(chunks))], "disease_name string, candidates string")).collect()
    assert [(r["label"], r["domain"]) for r in got] == [("x.org", "x.org")]
    content = json.dumps([{"title": "T", "type": "r", "url": "https://u.org/a"}, {"title": "T", "type": "r", "url": "https://u.org/a"}, {"title": "only"}])
    got = c.triple_citations(spark.createDataFrame([("d", content)], "disease_name string, content string")).collect()
    assert [(r["label"], r["type"], r["domain"]) for r in got] == [("T", "r", "u.org")]


def test_top_sites(spark):
    rows = [("d1", "nih.gov", "u"), ("d2", "nih.gov", "u"), ("d1", "youtube.com", "u"), ("d1", "zzz.net", "u"), ("d1", "zzz.net", "u")]
    cites = spark.createDataFrame(rows, "disease_name string, domain string, url string")
    assert [r["website"] for r in c.top_sites(cites, 2).collect()] == ["nih.gov", "youtube.com"]
    got = {r["category"]: (r["unique_disease_count"], r["citation_percentage"]) for r in c.site_category_summary(cites, 2).collect()}
    assert got == {"Government / Official Databases": (2, 40.0), "Media Platforms": (1, 20.0)}


def test_pivot_and_status(spark):
    rows = spark.createDataFrame([("x", "a", 1), ("x", "a", 2), ("y", "b", 5)], "category string, model string, n int")
    got = {r["category"]: (r["a"], r["b"]) for r in t.category_pivot(rows, "category", "model", ["n"], ["a", "b"]).collect()}
    assert got == {"x": (3, 0), "y": (0, 5)}
    log = spark.createDataFrame([("m", "p", "1", 3, None), ("m", "p", "2", 0, None), ("m", "p", "3", 0, "boom")], "model string, dataset string, patient_id string, n_rows int, error string")
    row = t.status_summary(log).first()
    assert (row["n_items"], row["n_saved"], row["n_skipped"], row["n_failed"], row["total_rows"]) == (3, 1, 1, 1, 3)

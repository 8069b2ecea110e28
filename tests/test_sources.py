import json

import pytest
from pyspark.sql import functions as F

from rankweave.operators.concepts import terminology_map
from rankweave.sources import readers, tables
from rankweave.sources.schema import standardize
from rankweave.streaming.incremental import append_new


@pytest.fixture
def database(spark, tmp_path):
    spark.sql(f"CREATE DATABASE t1 LOCATION '{tmp_path}/t1'")
    yield "t1"
    spark.sql("DROP DATABASE t1 CASCADE")


def test_standardize(spark):
    rows = [(" 1 ", "p", "0.5", "b"), ("1", "p", "0.4", "a"), ("2", "p", "bad", "c"), ("nan", "p", "1", "d"), ("", "p", "1", "e"), (None, "p", "1", "f")]
    df = spark.createDataFrame(rows, "PID string, set string, Score string, name string")
    aliases = {"patient_id": ("pid",), "dataset": ("set",), "score": (), "disease": ("name",), "extra": ("nothing",)}
    out = standardize(df, aliases, ["patient_id", "score"], {"score": "double"}, ["patient_id"], ["score"])
    assert [tuple(r) for r in out.collect()] == [("1", "p", 0.4, "a")]
    assert out.columns == ["patient_id", "dataset", "score", "disease"]
    with pytest.raises(ValueError, match="extra"):
        standardize(df, aliases, ["extra"])


def test_csv_is_typed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('patient_id,rank\n1,10\n2,2\n')
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), "patient_id string, rank int")
    assert [r["rank"] for r in df.orderBy("rank").collect()] == [2, 10]
    assert dict(readers.read_csv(spark, str(tmp_path / "a.csv")).dtypes)["rank"] == "int"


def test_pipe_file(spark, tmp_path):
    fields = ["C1"] + [""] * 10 + ["MSH", "PT", "D1", 'Name "x"', "", "", ""]
    (tmp_path / "m.rrf").write_text("|".join(fields) + "\n" + "|".join(fields) + "\n")
    got = terminology_map(readers.read_pipe(spark, str(tmp_path / "m.rrf"))).collect()
    assert [(r["CUI"], r["CODE"], r["CUI_Name"]) for r in got] == [("C1", "D1", 'Name "x"')]


def test_json_documents_and_path_keys(spark, tmp_path):
    for dataset, pid, doc in (("pub med", "1", {"patient_id": "1"}), ("hms", "2", [{"patient_id": "2"}, {"patient_id": "3"}])):
        folder = tmp_path / dataset / pid
        folder.mkdir(parents=True)
        (folder / "case.json").write_text(json.dumps(doc))
    df = readers.read_json_documents(spark, str(tmp_path / "*/*/*.json"), "patient_id string")
    got = sorted(tuple(r) for r in readers.with_path_keys(df, ["dataset", "folder"]).collect())
    assert got == [("1", "pub med", "1"), ("2", "hms", "2"), ("3", "hms", "2")]


def test_save_load_overwrite(spark, database):
    first = spark.createDataFrame([("a", 1), ("b", 2)], "model string, v int")
    tables.save(first, f"{database}.x", ["model"])
    stored = tables.save(first.withColumn("w", F.lit(7)).filter("v = 2"), f"{database}.x", ["model"])
    assert [r.asDict() for r in stored.collect()] == [{"v": 2, "w": 7, "model": "b"}]
    tables.load(spark, f"{database}.x", "xview")
    assert spark.sql("SELECT count(*) AS n FROM xview").first()["n"] == 1


def test_files_by_key(spark, tmp_path):
    df = spark.createDataFrame([("p", "1", "t")], "dataset string, patient_id string, text string")
    tables.save_json(df, str(tmp_path / "j"), ["dataset", "patient_id"])
    tables.save_csv(df, str(tmp_path / "c"), ["dataset"])
    assert (tmp_path / "j" / "dataset=p" / "patient_id=1").is_dir()
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["text"] == "t"


def test_append_new_is_idempotent(spark, database):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    name = f"{database}.log"
    assert append_new(df, name, ["name"]).count() == 2
    assert append_new(df, name, ["name"]).count() == 2
    more = spark.createDataFrame([("c", 3), ("a", 9)], "name string, v int")
    assert sorted(tuple(r) for r in append_new(more, name, ["name"]).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_csv_is_split_unless_fields_hold_line_breaks(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("a,b\n" + "".join(f'{i},"text {i} ""quoted"", more"\n' for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = readers.read_csv(spark, path, "a int, b string")
        assert df.rdd.getNumPartitions() > 3 and df.count() == 20000
        assert df.filter("a = 7").first()["b"] == 'text 7 "quoted", more'
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with open(path, "w") as f:
        f.write('a,b\n1,"two\nlines"\n')
    assert readers.read_csv(spark, path, "a int, b string", multi_line=True).first()["b"] == "two\nlines"


def test_staging_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from rankweave.session import staging_dir

    sc = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint.dir"):
        staging_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))


def test_staged_tables_are_dropped(spark):
    from rankweave import session

    stored = session.stage(spark.range(3))
    path = stored.inputFiles()[0]
    assert stored.count() == 3
    session.drop_staged(spark)
    import os
    from urllib.parse import urlparse

    assert not os.path.exists(os.path.dirname(urlparse(path).path))

import uuid

import pytest
from pyspark.sql.types import DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, NullType, ShortType, StringType, TimestampType

from rankweave.streaming.incremental import append_new, finish_swap, wider


@pytest.fixture
def name(spark, tmp_path):
    database = f"d_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION 'file://{tmp_path}/db'")
    yield f"{database}.t"
    spark.sql(f"DROP DATABASE {database} CASCADE")


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def test_no_column_is_lost(spark, name):
    append_new(spark.createDataFrame([(1, "a")], "id int, x string"), name, ["id"])
    append_new(spark.createDataFrame([("b", 2.5, 2)], "X string, y double, id int"), name, ["id"])
    got = append_new(spark.createDataFrame([(3, 7)], "id int, z long"), name, ["id"])
    assert got.columns == ["id", "x", "y", "z"]
    want = [{"id": 1, "x": "a", "y": None, "z": None}, {"id": 2, "x": "b", "y": 2.5, "z": None}, {"id": 3, "x": None, "y": None, "z": 7}]
    assert rows(got) == sorted(want, key=str)
    again = append_new(spark.createDataFrame([(3, 7)], "id int, z long"), name, ["id"])
    assert again.count() == 3


def test_types_are_widened(spark, name):
    append_new(spark.createDataFrame([(1, 1, 1.5, "2024-01-01")], "id int, n int, f float, d string").selectExpr("id", "n", "f", "date(d) AS d"), name, ["id"])
    more = spark.createDataFrame([(1 << 40, 1 << 41, 0.1, "2024-01-02 03:04:05")], "id long, n long, f double, d string").selectExpr("id", "n", "f", "timestamp(d) AS d", "null AS v")
    got = append_new(more, name, ["id"])
    assert {f.name: type(f.dataType) for f in got.schema} == {"id": LongType, "n": LongType, "f": DoubleType, "d": TimestampType, "v": StringType}
    assert sorted((r.id, r.n, r.f, str(r.d)) for r in got.collect()) == [(1, 1, 1.5, "2024-01-01 00:00:00"), (1 << 40, 1 << 41, 0.1, "2024-01-02 03:04:05")]
    text = append_new(spark.createDataFrame([(5, "many")], "id int, n string"), name, ["id"])
    assert sorted(r.n for r in text.collect()) == ["1", str(1 << 41), "many"] and text.filter("id = 5").first().f is None
    assert not spark.catalog.tableExists(f"{name}__next") and not spark.catalog.tableExists(f"{name}__old")


def test_narrower_types_and_fewer_columns_change_nothing(spark, name):
    append_new(spark.createDataFrame([(1, 2.5, "x")], "id long, a double, b string"), name, ["id"])
    got = append_new(spark.createDataFrame([(2, 3)], "id short, a short"), name, ["id"])
    assert [f.dataType for f in got.schema] == [LongType(), DoubleType(), StringType()]
    assert sorted((r.id, r.a, r.b or "") for r in got.collect()) == [(1, 2.5, "x"), (2, 3.0, "")]


def test_partitions_stay(spark, name):
    append_new(spark.createDataFrame([(1, "p", 1)], "id int, k string, n int"), name, ["id"], ["k"])
    got = append_new(spark.createDataFrame([(2, "q", 1 << 40, "new")], "id int, k string, n long, c string"), name, ["id"])
    assert sorted(tuple(r) for r in got.select("id", "k", "n", "c").collect() if r.c) == [(2, "q", 1 << 40, "new")]
    assert [c.name for c in spark.catalog.listColumns(name) if c.isPartition] == ["k"] and got.count() == 2
    spark.table(name).write.partitionBy("k").saveAsTable(f"{name}__next")  # ended before the copy was whole
    spark.sql(f"ALTER TABLE {name}__next SET TBLPROPERTIES ('complete' = 'true')")
    spark.sql(f"DROP TABLE {name}")
    finish_swap(spark, name)
    assert sorted((r.id, r.k) for r in spark.table(name).collect()) == [(1, "p"), (2, "q")]


def test_new_columns_rewrite_no_file(spark, name, tmp_path):
    append_new(spark.createDataFrame([(1,)], "id int"), name, ["id"])
    before = {f.name: f.stat().st_mtime_ns for f in tmp_path.rglob("part-*")}
    append_new(spark.createDataFrame([(2, "x")], "id int, c string"), name, ["id"])
    after = {f.name: f.stat().st_mtime_ns for f in tmp_path.rglob("part-*")}
    assert before.items() <= after.items()


def test_a_swap_that_broke_off(spark, name):
    table = lambda n, v: spark.createDataFrame([(v,)], "id int").write.saveAsTable(n)
    table(f"{name}__next", 2)  # not written to its end
    table(name, 1)
    finish_swap(spark, name)
    assert rows(spark.table(name)) == [{"id": 1}] and not spark.catalog.tableExists(f"{name}__next")
    table(f"{name}__next", 3)
    spark.sql(f"ALTER TABLE {name}__next SET TBLPROPERTIES ('complete' = 'true')")
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__old")  # ended between the two renames
    got = append_new(spark.createDataFrame([(4,)], "id int"), name, ["id"])
    assert rows(got) == [{"id": 3}, {"id": 4}] and not spark.catalog.tableExists(f"{name}__old")


@pytest.mark.parametrize("old, new, want", [
    (IntegerType(), ShortType(), IntegerType()), (FloatType(), IntegerType(), DoubleType()), (FloatType(), ShortType(), FloatType()),
    (LongType(), DoubleType(), StringType()), (DecimalType(10, 2), IntegerType(), DecimalType(12, 2)), (DecimalType(38, 10), LongType(), DecimalType(38, 10)),
    (DecimalType(38, 30), LongType(), StringType()), (DateType(), StringType(), StringType()), (NullType(), DateType(), DateType()), (DateType(), NullType(), DateType()),
])
def test_wider(old, new, want):
    assert wider(old, new) == want and wider(new, old) == want

from rankweave.sources.readers import read_lines, split_bad_lines

SCHEMA = "id INT, name STRING, score DOUBLE, day DATE"


def test_counts_add_up_to_the_input(spark, tmp_path):
    good = ['1,a,2.5,2024-01-01', '2,"b, c",,2024-01-02', "3,,1e3,"]
    bad = ["x,a,1,2024-01-01", "4,a,1", "5,a,1,2024-01-01,more", "6,a,much,2024-01-01", "7,a,1,today", "id,name"]
    (tmp_path / "one.csv").write_text("id,name,score,day\n" + "\n".join(good[:2] + bad[:3]) + "\n\n")
    (tmp_path / "two.csv").write_text("id,name,score,day\n" + "\n".join(good[2:] + bad[3:]))
    lines = read_lines(spark, str(tmp_path), header="id,name,score,day")
    kept, apart = split_bad_lines(lines, SCHEMA)
    assert sorted(r.line for r in apart.collect()) == sorted(bad)
    rows = {r.id: (r.name, r.score, str(r.day)) for r in kept.collect()}
    assert rows == {1: ("a", 2.5, "2024-01-01"), 2: ("b, c", None, "2024-01-02"), 3: (None, 1000.0, "None")}
    assert kept.count() + apart.count() == lines.count() == 9
    assert {r.file.rsplit("/", 1)[1] for r in apart.select("file").distinct().collect()} == {"one.csv", "two.csv"}


def test_a_line_is_judged_by_all_fields(spark):
    lines = spark.createDataFrame([("1,a,x,2024-01-01",), ("2,a,1,2024-01-01",)], "line string")
    kept, apart = split_bad_lines(lines, SCHEMA)
    assert [r.id for r in kept.select("id").collect()] == [2] and apart.count() == 1 and kept.count() == 1


def test_empty_table(spark):
    kept, apart = split_bad_lines(spark.createDataFrame([], "line string"), SCHEMA, "|")
    assert kept.count() == apart.count() == 0 and kept.columns == ["id", "name", "score", "day"]

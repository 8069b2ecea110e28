import json
import uuid

import pytest

from rankweave.streaming import files
from rankweave.streaming.files import append_files

SCHEMA = "id INT, model STRING, text STRING"


@pytest.fixture
def place(spark, tmp_path):
    database = f"d_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION 'file://{tmp_path}/db'")
    (tmp_path / "in").mkdir()
    yield tmp_path, f"{database}.t"
    spark.sql(f"DROP DATABASE {database} CASCADE")


def put(folder, name, *rows):
    (folder / "in" / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def run(spark, place, **settings):
    folder, table = place
    stored = append_files(spark, str(folder / "in"), SCHEMA, table, ["id"], str(folder / "taken"), **settings)
    return sorted((r.id, r.model, r.text) for r in stored.collect())


def test_each_run_takes_the_new_files(spark, place):
    put(place[0], "a.json", {"id": 1, "model": "m", "text": "x"}, {"id": 2, "text": "y"}, {"model": "no id"}, "no json")
    first = [(1, "m", "x"), (2, None, "y")]
    assert run(spark, place) == first
    assert run(spark, place) == first  # nothing new
    put(place[0], "b.json", {"id": 2, "text": "later"}, {"id": 3, "text": "z"}, {"id": 3, "text": "b"})
    assert run(spark, place, files_per_batch=1) == [*first, (3, None, "b")]


def test_a_batch_run_twice_adds_nothing(spark, place, monkeypatch):
    put(place[0], "a.json", *({"id": i, "text": "x" * i} for i in range(20)))
    plain = files.append_new

    def broken(*args):
        plain(*args)
        raise RuntimeError("lost after the rows were written, before the batch was noted")

    monkeypatch.setattr(files, "append_new", broken)
    with pytest.raises(Exception):
        run(spark, place)
    monkeypatch.setattr(files, "append_new", plain)
    assert run(spark, place) == [(i, None, "x" * i) for i in range(20)]


def test_batches_are_prepared(spark, place):
    put(place[0], "a.json", {"id": 1, "text": " x "})
    assert run(spark, place, prepare=lambda rows: rows.selectExpr("id", "model", "trim(text) AS text")) == [(1, None, "x")]

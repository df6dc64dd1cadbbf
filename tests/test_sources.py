"""File readers, payload decoding, entity tables, and the shared folder."""

import json

import pytest
from pyspark.sql import functions as F

from studyloom.schemas import ANSWER_MESSAGE, ENTITIES, QUIZ_SUBMISSION_PAYLOAD
from studyloom.session import shared_folder
from studyloom.sources import content, entities, payloads, sinks


def test_index_files(spark, tmp_path):
    files = {
        "01_web_index.json": json.dumps({"z_last": ["b.md", "a.md"], "a_first": [], "m": ["b.md"]}),
        "c++ 3_index.json": '{"s": ["x"]}',
        "empty_index.json": "",
        "broken_index.json": '{"a": [',
        "object_index.json": "{}",
        "list_index.json": '["a"]',
        "tail_index.json": '{"a": ["b"]} tail',
        "other.json": '{"a": ["b"]}',
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    got = sorted(map(tuple, content.read_content_index(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(
        [("01_web", "z_last", 0, 0, "b.md"), ("01_web", "z_last", 0, 1, "a.md"), ("01_web", "a_first", 1, None, None), ("01_web", "m", 2, 0, "b.md"), ("c++ 3", "s", 0, 0, "x")],
        key=str,
    )


def test_content_files(spark, tmp_path):
    (tmp_path / "01_web" / "deep").mkdir(parents=True)
    bodies = {"a.md": b"x\r\ny", "b.MD": "é".encode(), "bad.md": b"\xff", "deep/c.PDF": b"p", "d.txt": b"t", "e.jpeg": b"j"}
    for name, body in bodies.items():
        (tmp_path / "01_web" / name).write_bytes(body)
    files = content.read_content_files(spark, str(tmp_path))
    assert sorted((r["name"], r["parent"], r["type"]) for r in files.collect()) == [
        ("a.md", "01_web", "md"), ("b.MD", "01_web", "MD"), ("bad.md", "01_web", "md"), ("c.PDF", "deep", "PDF"), ("e.jpeg", "01_web", "jpeg"),
    ]
    assert sorted((r["name"], r["text"]) for r in content.load_text(files).collect()) == [("a.md", "x\ny"), ("b.MD", "é")]


def test_notebooks(spark, tmp_path):
    cells = [
        {"cell_type": "markdown", "source": ["# It's\n", 'say "x"'], "metadata": {}},
        {"cell_type": "code", "source": ["a = 1\n", "b\t\\"], "outputs": []},
        {"cell_type": "raw", "source": "plain"},
    ]
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": cells}))
    (tmp_path / "bad.ipynb").write_text("{")
    rows = content.load_notebooks(content.read_content_files(spark, str(tmp_path))).collect()
    want = " ".join(f"'{c['cell_type']}' cell: '{c['source']}'\n\n" for c in cells)
    assert [(r["name"], r["text"]) for r in rows] == [("n.ipynb", want)]


def test_payloads(spark):
    bodies = ['{"type": "submit_answer", "answer": 2, "response_time": 1.5}', "{", '{"type": ""}']
    frame = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    good, bad = payloads.decode_payloads(frame, ANSWER_MESSAGE, "type")
    assert [(r["id"], r["payload"]["answer"], r["payload"]["response_time"]) for r in good.collect()] == [(0, 2, 1.5)]
    assert sorted((r["id"], r["reason"]) for r in bad.collect()) == [(1, "Invalid JSON format"), (2, "Empty type")]


def test_quiz_submission_payload(spark):
    body = json.dumps({"session_id": 4, "answers": [0, None], "quiz_data": {"questions": [{"question": "q", "options": ["a"], "correct_answer": 0}]}})
    frame = spark.createDataFrame([(body,)], "body string")
    good, _ = payloads.decode_payloads(frame.withColumn("id", F.lit(1)), QUIZ_SUBMISSION_PAYLOAD + ", kind string", "kind")
    assert good.count() == 0


@pytest.mark.parametrize("name", sorted(ENTITIES))
def test_entity_schemas_are_readable(spark, name):
    assert spark.createDataFrame([], ENTITIES[name]).schema.fields


def test_read_entity_and_choices(spark, tmp_path):
    rows = spark.createDataFrame([(1, "waiting"), (2, "lost"), (3, None)], "id long, status string")
    rows.write.parquet(str(tmp_path / "rooms"))
    read = entities.read_entity(spark, str(tmp_path), "rooms")
    assert {"code", "finished_at"} <= set(read.columns)
    assert [r["id"] for r in entities.invalid_choices(read, "rooms").collect()] == [2]


class Named:
    """A session on a cluster, with or without the shared folder named."""

    def __init__(self, folder):
        self.folder = folder
        self.conf = self
        self.sparkContext = self
        self.master = "yarn"

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(Named("hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError):
        shared_folder(Named(None), "x")


def test_files_are_written_without_folders_of_their_own(spark, tmp_path, monkeypatch):
    rows = [(f"m{i % 2}/page{i}.md", "é" * i) for i in range(40)] + [("m0/page0.md", "again"), ("m1/none.PDF", None), (None, "lost"), ("m1/x.html", "h")]
    root = str(tmp_path / "made")
    sinks.write_files(spark.createDataFrame(rows, "path string, value string").repartition(5), f"file://{root}")
    monkeypatch.setattr(content, "READ_TASKS", 3)
    files = content.read_content_files(spark, root)
    assert files.rdd.getNumPartitions() <= 3
    want = {(f"page{i}.md", f"m{i % 2}", 2 * i + 1) for i in range(1, 40)} | {("page0.md", "m0", 7), ("none.PDF", "m1", 1)}
    assert {(r["name"], r["parent"], r["length"]) for r in files.select("name", "parent", "length").collect()} == want
    assert sorted(p.name for p in (tmp_path / "made").iterdir()) == ["m0", "m1"]
    assert all(p.is_file() for m in ("m0", "m1") for p in (tmp_path / "made" / m).iterdir())
    empty = str(tmp_path / "empty")
    sinks.write_files(spark.createDataFrame([], "path string, value string"), empty)
    assert content.read_content_files(spark, empty).count() == 0

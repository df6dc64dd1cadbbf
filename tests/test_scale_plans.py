"""Rankings in bands, the inverted file, postings and readers: results and plans."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from studyloom.operators import corpus, exercises, ordered, retrieval, rooms
from studyloom.plans import catalog
from studyloom.plans.registry import view
from studyloom.session import shared_folder
from studyloom.sources import content, sinks

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_large_room_is_ranked_in_bands(spark, monkeypatch):
    """A room of 200,000 players, most without points and many who joined in the same second."""
    monkeypatch.setattr(ordered, "BAND", 500)
    monkeypatch.setattr(ordered, "BANDS", 64)
    n = 200_000
    players = spark.range(n).select(
        F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 50).cast("long").alias("room_id"), F.col("id").alias("user_id"),
        F.when(F.col("id") % 3 == 0, F.pmod(F.xxhash64("id"), F.lit(3000))).otherwise(0).alias("score"),
        F.timestamp_seconds(1_700_000_000 + F.pmod(F.xxhash64(F.col("id") + 1), F.lit(40_000))).alias("joined_at"),
    )
    players = sinks.write_snapshot(players, shared_folder(spark, "test-players"))
    order = "score DESC, joined_at, user_id"
    want = players.selectExpr("room_id", "user_id", f"row_number() OVER (PARTITION BY room_id ORDER BY {order}) AS want")
    got = rooms.ranked(players)
    assert got.count() == n
    assert got.join(want, ["room_id", "user_id"]).where("position <> want").count() == 0
    assert got.where("medal = 'gold'").count() == players.select("room_id").distinct().count()


def test_bands_are_of_about_equal_size(spark, monkeypatch):
    seen = {}
    positions = ordered.positions

    def watched(df, keys, slices, order, name):
        seen["largest"] = df.groupBy(*keys, "__band").count().agg(F.max("count")).first()[0]
        return positions(df, keys, slices, order, name)

    monkeypatch.setattr(ordered, "positions", watched)
    rows = spark.range(100_000).select(F.lit(1).alias("k"), "id", F.floor(F.sqrt("id")).alias("x"))
    ordered.banded_positions(rows, ["k"], F.col("x"), [F.col("x"), F.col("id")])
    assert seen["largest"] <= 4 * 100_000 / ordered.BANDS + 700  # one value of x has 633 rows at most


@pytest.mark.parametrize("cells", [None, 40])
def test_recall_of_the_inverted_file(spark, cells):
    folder = "/root/testdata/sf0.01"
    vectors = view(spark, folder, "fx_vectors").select("id", "vector")
    asked = vectors.where("id % 5 = 0").select(F.col("id").alias("query_id"), "vector")
    cells_ = retrieval.fit_cells(vectors, cells)
    indexed = retrieval.assign_cells(vectors, cells_)
    assert indexed.count() == vectors.count()  # every row, though the cells are fitted on a sample
    exact = {(r.query_id, r.id) for r in retrieval.knn(asked, vectors).collect()}
    found = {(r.query_id, r.id) for r in retrieval.knn_probed(asked, indexed, cells_).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    whole = {(r.query_id, r.id, r["rank"]) for r in retrieval.knn_probed(asked, indexed, cells_, probes=len(cells_.centres)).collect()}
    assert whole == {(r.query_id, r.id, r["rank"]) for r in retrieval.knn(asked, vectors).collect()}


def test_recall_of_the_query(spark):
    exact = {(r.query_id, r.id) for r in catalog.queries()["knn_topk"](spark, "/root/testdata/sf0.01").collect()}
    found = {(r.query_id, r.id) for r in catalog.queries()["knn_index"](spark, "/root/testdata/sf0.01").collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_an_inverted_file_with_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_CHUNKS", 50)
    rows = [(i, [1.0, 1.0]) for i in range(400)] + [(1000 + i, [float(i), -float(i)]) for i in range(100)] + [(2000, None)]
    chunks = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.1]), (2, [50.0, -50.0]), (3, None)], "query_id long, vector array<double>")
    cells_ = retrieval.fit_cells(chunks, 8)
    got = retrieval.knn_probed(asked, retrieval.assign_cells(chunks, cells_), cells_, 3, probes=4).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 1050), (2, 2, 1049), (2, 3, 1051)]
    nothing = chunks.limit(0)
    empty = retrieval.fit_cells(nothing)
    assert retrieval.knn_probed(asked, retrieval.assign_cells(nothing, empty), empty).count() == 0


def test_search_builds_its_postings_once(spark):
    plan = plan_of(entry.queries()["index_search"](spark, FOLDER))
    assert "SortAggregate" not in plan and plan.count("Generate explode") <= 2 and "Window" not in plan.replace("WindowGroupLimit", "").split("file_pos", 1)[0]
    index = spark.createDataFrame(
        [("m", "Intro", 0, "Alpha_intro.md", 0), ("m", "Intro", 0, "b.md", 1), ("m", "empty", 1, None, None), ("n", "Intro", 0, "x.md", 0)],
        "module string, section string, section_pos int, file string, file_pos long",
    )
    queries = spark.createDataFrame([(1, "m", "INTRO"), (2, "m", ""), (3, "m", "z"), (4, "n", ".m"), (5, "m", "empty")], "query_id long, module string, query string")
    got = corpus.by_relevance(corpus.search_index(index, queries)).collect()
    rows = sorted((r.query_id, r.position, r.type, r.section, r.file, r.relevance) for r in got)
    assert rows == [
        (1, 1, "section", "Intro", None, "high"), (1, 2, "file", "Intro", "Alpha_intro.md", "high"),
        (2, 1, "file", "Intro", "Alpha_intro.md", "high"), (2, 2, "file", "Intro", "b.md", "high"),
        (2, 3, "section", "Intro", None, "medium"), (2, 4, "section", "empty", None, "medium"),
        (4, 1, "file", "Intro", "x.md", "high"), (5, 1, "section", "empty", None, "high"),
    ]


def test_readers_scan_files(spark):
    assert "FileScan text" in plan_of(entry.queries()["scan_content_index"](spark, FOLDER))
    plan = plan_of(entry.queries()["scan_content_files"](spark, FOLDER))
    assert "FileScan binaryFile" in plan and "content" not in plan.split("ReadSchema", 1)[1]


def test_names_of_folders_written_by_spark(spark):
    rows = spark.createDataFrame(
        [("file:/d/parent=m1/name=a.md/part-00000-x.c000.txt",), ("/d/m1/a.md",), ("/d/x=1/b.md",), ("/d/m1/part-1.md",)], "path string"
    )
    got = [r[0] for r in rows.select(content.named_path(F.col("path"))).collect()]
    assert got == ["file:/d/m1/a.md", "/d/m1/a.md", "/d/1/b.md", "/d/m1/part-1.md"]


def test_no_sorted_aggregation_in_updates(spark):
    for name in ("sink_insert_if_absent", "join_file_section"):
        assert "SortAggregate" not in plan_of(entry.queries()[name](spark, FOLDER))


def test_progress_of_one_year(spark):
    rows = spark.createDataFrame([(1, "2024-12-31"), (2, "2025-01-01"), (3, "2025-12-31"), (4, "2026-01-01")], "id int, at string")
    got = exercises.admin_search(rows.withColumn("at", F.to_date("at")), "", [], bucket=("at", "year", "2025-06-01"))
    assert sorted(r.id for r in got.collect()) == [2, 3]


def test_rows_of_one_split_are_repaired_in_many_tasks(spark):
    from studyloom.operators import generated

    texts = spark.range(100).coalesce(1).selectExpr("id", "'x' AS topic", "'no json' AS text")
    rows = generated.repair(texts)
    assert rows.count() == 100
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1

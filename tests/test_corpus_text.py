"""Chunking against a literal statement of its rules, and exact neighbour search."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studyloom.operators import corpus, retrieval


def stated_chunks(text, size, overlap, marks=("\n\n", "\n", " ", "")):
    """The rules written down plainly: lists are copied and lengths recounted."""
    mark = next(m for m in marks if m == "" or m in text)
    rest = marks[marks.index(mark) + 1 :]
    if mark:
        cut = re.split(f"({re.escape(mark)})", text)
        pieces = [cut[0]] + [cut[i] + cut[i + 1] for i in range(1, len(cut), 2)]
    else:
        pieces = list(text)
    pieces = [p for p in pieces if p]
    out, small = [], []

    def merge(parts):
        done, current = [], []
        for part in parts:
            if sum(map(len, current)) + len(part) > size:
                if current:
                    done.append("".join(current).strip())
                    while sum(map(len, current)) > overlap or (sum(map(len, current)) + len(part) > size and current):
                        current = current[1:]
            current = current + [part]
        done.append("".join(current).strip())
        return [d for d in done if d]

    for piece in pieces:
        if len(piece) < size:
            small.append(piece)
        else:
            if small:
                out += merge(small)
                small = []
            out += stated_chunks(piece, size, overlap, rest) if rest else [piece]
    return out + (merge(small) if small else [])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_chunks_follow_the_rules(text, size, overlap):
    assert corpus.split_text(text, size, overlap) == stated_chunks(text, size, overlap)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abcdé \n", min_size=1000, max_size=6000))
def test_chunks_are_short_and_stripped(text):
    chunks = corpus.split_text(text)
    assert all(0 < len(c) <= corpus.CHUNK_SIZE and c == c.strip() for c in chunks)
    assert set("".join(chunks)) >= set(text) - set(" \n")


def test_a_whole_file_is_kept_by_its_first_page(spark):
    long = "word " * 400
    rows = [("/d/a.md", 0, "short"), ("/d/a.md", 1, long), ("/d/b.md", 2, "x" * 1000), ("/d/b.md", 7, "tail"), ("/d/c.pdf", 0, "")]
    pages = spark.createDataFrame(rows, "path string, page int, text string")
    chunks = corpus.chunk_ids(corpus.chunk(pages)).collect()
    assert sorted((r["id"], len(r["text"])) for r in chunks if r["path"] == "/d/a.md") == [("a-0", 5), ("a-1", 2000)]
    assert sorted((r["id"], r["page"]) for r in chunks if r["path"] == "/d/b.md") == [("b-0", 2), ("b-1", 7)]
    assert [r["id"] for r in chunks if r["path"] == "/d/c.pdf"] == ["c-0"]


def test_ids_count_over_the_pages_of_a_big_file(spark):
    rng = random.Random(2)
    rows = [("/d/hot.md", page, pos, "t") for page in range(0, 5000, 7) for pos in range(rng.randrange(1, 4))]
    got = corpus.chunk_ids(spark.createDataFrame(rows, "path string, page int, pos int, text string"))
    ordered = [r["id"] for r in got.orderBy("page", "pos").collect()]
    assert ordered == [f"hot-{i}" for i in range(len(rows))]


def vectors(spark, n, seed, name="id"):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, 8)).astype("float32")
    points[: n // 4] = points[0]  # many equal vectors: ties must go to the smaller id
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return points.astype("float64"), spark.createDataFrame(rows, f"{name} long, vector array<float>")


def nearest(points, chunks, k):
    out = {}
    for q, p in enumerate(points):
        d = ((chunks - p) ** 2).sum(1)
        out[q] = sorted(range(len(chunks)), key=lambda i: (d[i], i))[:k]
    return out


def ranked(hits):
    found = {}
    for r in hits.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    return found


def test_neighbours_both_ways(spark, monkeypatch):
    points, queries = vectors(spark, 30, 1, "query_id")
    corpus_points, chunks = vectors(spark, 400, 2)
    want = nearest(points, corpus_points, 5)
    chunks = chunks.repartition(3)
    assert ranked(retrieval.knn(queries, chunks)) == want
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 8)
    monkeypatch.setattr(retrieval, "BLOCK_CHUNKS", 60)
    assert ranked(retrieval.knn(queries, chunks)) == want


def test_fewer_chunks_than_neighbours(spark):
    points, queries = vectors(spark, 3, 1, "query_id")
    corpus_points, chunks = vectors(spark, 4, 2)
    assert ranked(retrieval.knn(queries, chunks, 9)) == nearest(points, corpus_points, 9)
    assert retrieval.knn(queries.where("query_id < 0"), chunks).count() == 0


def test_context_and_prompt(spark):
    hits = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (2, 10, 1)], "query_id long, id long, rank int")
    chunks = spark.createDataFrame([(10, "ten", None), (11, "eleven", "e.md")], "id long, text string, source string")
    got = {r["query_id"]: (r["context"], r["sources"]) for r in retrieval.context(hits, chunks).collect()}
    assert got == {1: ("eleven\n\nten", ["e.md", "Unknown"]), 2: ("ten", ["Unknown"])}
    row = spark.range(1).select(
        retrieval.prompt("{{x}} {a}-{b}", a=F.lit("{b}"), b=F.lit(3)).alias("p"),
        retrieval.topic_in_module(F.lit("t"), F.lit("Git")).alias("m"),
        retrieval.topic_in_module(F.lit("t"), F.lit(None).cast("string")).alias("n"),
    ).first()
    assert tuple(row) == ("{x} {b}-3", "t (dans le contexte de Git)", "t")


def test_few_texts_are_cut_at_a_time(spark, monkeypatch):
    """Not a whole batch of Arrow, whatever its texts are long."""
    monkeypatch.setattr(corpus, "CUT_CHARS", 3000)
    texts = ["a b " * n for n in (1000, 10, 2000, 5, 5, 600, 0)] + [None, "c d " * 300]
    parts = [x.to_pylist() for x in corpus._slices(pa.array(texts))]
    assert [t for x in parts for t in x] == texts and len(parts) > 4
    assert all(len(x) == 1 or sum(len(t or "") for t in x) <= 3000 for x in parts)
    pages = spark.createDataFrame([(f"/d/{i}.md", 0, t) for i, t in enumerate(texts) if t], "path string, page int, text string")
    got = {r.path: r.parts for r in corpus.chunk_lists(pages).collect()}
    for i, t in enumerate(texts):
        if t:
            assert got[f"/d/{i}.md"] == (corpus.split_text(t) if len(t) >= 1000 else [t])


def test_pairs_of_blocks_are_dealt_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_CHUNKS", 50)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 50)
    monkeypatch.setattr(retrieval, "TILE", 7)
    monkeypatch.setattr(retrieval, "MEASURED", 20)
    points, queries = vectors(spark, 300, 1, "query_id")
    corpus_points, chunks = vectors(spark, 300, 2)
    hits = retrieval.knn(queries, chunks, 3)
    assert ranked(hits) == nearest(points, corpus_points, 3)
    # a share of the chunks and a part of the queries make the key, not the share alone
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "share" in plan.split("Join Inner", 1)[1].split("\n", 1)[0] and "part" in plan.split("Join Inner", 1)[1].split("\n", 1)[0]


def test_limits_from_minima_of_groups():
    rng = np.random.default_rng(3)
    for n in (5, 63, 64, 1000, 1003):
        rough = rng.integers(0, 50, (20, n)).astype(float)
        for take in (1, 2, 5):
            limits = retrieval._limits(rough, take)
            assert ((rough <= limits[:, None]).sum(axis=1) >= take).all()

"""Searches of many queries against a plain restatement and against the search of one."""

import random

import numpy as np
import pytest

from factloom.operators import search

SCHEMA = "{} string, embedding array<float>"


def rows(n, seed, prefix):
    draw = random.Random(seed)
    # Few different values, so that many products tie.
    return [(f"{prefix}{i}", [float(draw.choice((-1, 0, 1))) / 2 for _ in range(4)]) for i in range(n)]


@pytest.mark.parametrize("blocks", [(3, 5), (4096, 16384)])
def test_each_query_gets_its_nearest_rows_ties_by_id(spark, blocks):
    held, asked = rows(40, 1, "f"), rows(11, 2, "q")
    vectors = spark.createDataFrame([*held, ("none", None), (None, [1.0, 0.0, 0.0, 0.0])], SCHEMA.format("fragment_id"))
    queries = spark.createDataFrame([*asked, ("nothing", None)], SCHEMA.format("query_id"))
    got = {(r.query_id, r.fragment_id, r.similarity) for r in search.nearest_each(vectors, queries, 7, *blocks).collect()}
    expected = set()
    for query, a in asked:
        ranked = sorted((-round(float(np.dot(a, b)), 8), f) for f, b in held)[:7]
        expected |= {(query, f, -s) for s, f in ranked}
    assert got == expected


def test_fewer_rows_than_asked_for_and_empty_sides(spark):
    vectors, queries = spark.createDataFrame(rows(3, 1, "f"), SCHEMA.format("fragment_id")), spark.createDataFrame(rows(2, 2, "q"), SCHEMA.format("query_id"))
    assert search.nearest_each(vectors, queries, 7).count() == 6
    assert search.nearest_each(vectors.limit(0), queries, 7).count() == 0
    assert search.nearest_each(vectors, queries.limit(0), 7).count() == 0


def test_hybrid_of_many_is_the_hybrid_of_each(spark):
    held, asked = rows(30, 3, "f"), rows(4, 4, "q")
    vectors, queries = spark.createDataFrame(held, SCHEMA.format("fragment_id")), spark.createDataFrame(asked, SCHEMA.format("query_id"))
    texts = spark.createDataFrame([(f, f"d{i % 5}", "Ёлка and fir" if i % 3 else None) for i, (f, _) in enumerate(held)], "fragment_id string, document_id string, text string")
    hidden = spark.createDataFrame([("d2",)], "document_id string")
    got = {(r.query_id, r.fragment_id, r.score) for r in search.hybrid_each(vectors, texts, queries, "елка or fir", hidden, 4, 2).collect()}
    for query, vector in asked:
        one = {(query, r.fragment_id, r.score) for r in search.hybrid(vectors, texts, vector, "елка or fir", hidden, 4, 2).collect()}
        assert {g for g in got if g[0] == query} == one


def test_index_recall_and_work(spark):
    """Clouds of vectors: nine in ten true neighbours at least, from less than half of the rows; every row is in one list."""

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    held = [(f"f{k:04d}", (centres[k % 30] + rng.normal(size=16) * 0.4).tolist()) for k in range(1500)]
    vectors = spark.createDataFrame([*held, ("none", None)], "fragment_id string, embedding array<double>")
    queries = spark.createDataFrame([(k, (centres[k % 30] + rng.normal(size=16) * 0.4).tolist()) for k in range(60)], "query_id long, embedding array<double>")
    index = search.fit_index(vectors, 10, sample=600, checks=100)
    indexed = search.in_lists(vectors, index, "fragment_id")
    assert indexed.count() == 1500 and index.recall >= 0.95
    for how in ({}, {"query_rows": 7, "vector_rows": 9}):
        got = {(r.query_id, r.fragment_id): r.similarity for r in search.nearest_in_index(indexed, queries, index, 10, **how).collect()}
        true = {(r.query_id, r.fragment_id): r.similarity for r in search.nearest_each(vectors, queries, 10).collect()}
        assert len(got) > 540 and len(got.keys() & true.keys()) >= 0.9 * len(true)
        assert all(abs(s - true[key]) < 1e-9 for key, s in got.items() if key in true)
    assert search.in_lists(queries, index, "query_id", index.probes).join(indexed, "list").count() < 0.5 * 60 * 1500
    empty = search.fit_index(vectors.where("false"), 10)
    assert search.nearest_in_index(search.in_lists(vectors.where("false"), empty, "fragment_id"), queries.where("false"), empty).collect() == []


def test_blocks_are_arrow_tables(spark):
    """A block's vectors are one array, not an object a row."""
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "fragment_id string, embedding array<float>")
    asked = spark.createDataFrame([(7, [2.0, 1.0])], "query_id long, embedding array<float>")
    found = search.nearest_each(vectors, asked, 2)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.query_id, r.fragment_id, r.similarity) for r in found.orderBy("similarity").collect()] == [(7, "a", 2.0), (7, "c", 3.0)]

"""What a query's plan carries: no columns, rows or joins that its result does not need."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import citations, graph
from factloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_sources_carry_no_names(spark):
    assert " AS lab#" not in plan(spark, "fact_sources_dedup")


def test_equal_table_rows_are_read_once(spark):
    assert plan(spark, "table_values").count("Aggregate") == 2


def test_markers_are_read_without_an_index(spark):
    row = spark.range(1).select(citations.markers(F.lit("a [1] b [2-4, 9] c [7")).alias("m"))
    assert [m.numbers for m in row.head().m if m.numbers] == [["1"], ["2", "3", "4", "9"]]
    index = F.create_map(F.lit("1"), F.lit("x"), F.lit("3"), F.lit("y"))
    assert row.select(citations.resolved(F.col("m"), index)).head()[0] == "a [x] b [y] c [7"


def facts(spark):
    rows = [("c1", "d", "f1", "e1", "Red Ring", "p", "x", "lab 1", "increase"), ("c2", "d", "f2", "e1", "red ring", "p", "y", "lab 2", "decrease"), ("c3", "d", "f3", "e2", "bolt", "p", "x", "lab 1", "increase"), ("c3", "d", "f3", "e2", "bolt", "p", "x", "lab 1", "increase")]
    return spark.createDataFrame(rows, "id string, document_id string, fragment_id string, experiment_id string, material string, process string, property string, lab string, effect_direction string")


def test_projection_without_deleted_claims_is_the_graph_without_them(spark):
    all_, gone = facts(spark), spark.createDataFrame([("c2",)], "id string")
    want = graph.without(*graph.fact_projection(all_), gone)
    nodes, edges = graph.fact_projection(all_, all_.join(gone, "id", "left_anti"), distinct=False)
    assert sorted(nodes.select("id", "label", "name").collect()) == sorted(want[0].select("id", "label", "name").collect())
    assert sorted(edges.distinct().collect()) == sorted(want[1].collect())


def test_reach_takes_repeated_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    found = graph.reachable(edges, spark.createDataFrame([("a",)], "id string"), 5)
    assert sorted(found.select("id", "hop").collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_first_mention_labels_a_name_of_several_spellings(spark):
    nodes = graph.entity_nodes(graph.entity_mentions(facts(spark)))
    assert {r.key: r.label for r in nodes.where("type = 'Material'").collect()} == {"red ring": "Red Ring", "bolt": "bolt"}

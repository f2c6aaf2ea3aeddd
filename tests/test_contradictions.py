"""Contradictions, cell by cell, beside all pairs of facts."""

import math
import os
import random

import pytest

from factloom.operators import facts as fact_op
from factloom.plans import catalogue

SF = "/root/testdata/sf0.001"
SCHEMA = "id string, material string, process string, property string, lab string, temperature_c double, effect_direction string"


def by_all_pairs(rows, tolerance=5.0):
    fold = lambda s: (s or "").strip().lower()
    near = lambda a, b: a is None or b is None or abs(a - b) <= tolerance
    found = set()
    for _, m, p, k, lab, t, way in rows:
        for _, m2, p2, k2, lab2, t2, way2 in rows:
            same = fold(m) == fold(m2) != "" and fold(k) == fold(k2) != ""
            if same and (way, way2) == ("increase", "decrease") and (fold(p) == fold(p2) or not fold(p) or not fold(p2)) and near(t, t2):
                found.add((fold(m), fold(k), ", ".join(sorted({lab or "", lab2 or ""}))))
    return sorted(found)


def made(n, labs, materials=("Cu", "cu ", "Ni", None), seed=3):
    draw = random.Random(seed)
    temperatures = [None, math.nan, math.inf, -math.inf, 1e20, 1e30, 0.1, 5.1, -0.0, 5.0, math.nextafter(5.0, 0), math.nextafter(5.0, 9), 1e16, 1e16 + 4] + [draw.uniform(-20, 20) for _ in range(40)] + [float(k) for k in range(-10, 30)]
    return [(str(k), draw.choice(materials), draw.choice(["p", "P", "q", "", None]), draw.choice(["h", "g"]), draw.choice(labs), draw.choice(temperatures), draw.choice(["increase", "decrease", "neutral"])) for k in range(n)]


def found(spark, rows, **more):
    return sorted(tuple(r) for r in fact_op.contradictions(spark.createDataFrame(rows, SCHEMA), **more).collect())


@pytest.mark.parametrize("block", [3, 20, 8192])
def test_cells_find_each_pair_once(spark, block):
    rows = made(160, [None, "A", "b", *(f"lab {k}" for k in range(40))])
    assert found(spark, rows, block=block) == by_all_pairs(rows)


def test_texts_that_name_different_pairs_are_there_once(spark):
    rows = made(120, ["A", "B", "A, B", "C", "B, C", "A, B, C", ""], ("Cu",)) + made(30, ["x", "y"], ("Ni",), 4)
    assert found(spark, rows, block=2) == by_all_pairs(rows)


def test_few_and_no_facts(spark):
    assert found(spark, made(3, ["A"], seed=1)[:0]) == []
    rows = [("1", "Cu", "p", "h", "A", 1.0, "increase"), ("2", "Cu", "p", "h", "B", 6.0, "decrease"), ("3", "Cu", "p", "h", "C", 6.1, "decrease")]
    assert found(spark, rows) == [("cu", "h", "A, B")] and found(spark, rows[:1]) == []


def test_pairs_are_not_shuffled(spark):
    """What makes pairs makes each once: neither a join nor an aggregate of pairs stands in the plan, which grew with them."""
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    plan = catalogue.QUERIES["find_contradictions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    pairs = plan.split("MapInArrow")[0]
    assert "Aggregate" not in pairs and "Join" not in pairs and "MapInArrow" in plan

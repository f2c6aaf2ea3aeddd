"""Numeric conditions and parameter templates on small fixtures, by plain restatements."""

import random

from pyspark.sql import functions as F

from factloom.operators import conditions as op

CANDIDATE = "candidate_id string, status string, document_id string, parameters array<struct<name:string,value:double,value_min:double,value_max:double,unit:string>>"
CONDITION = "question_id string, condition_id string, parameter string, value_min double, value_max double, unit string"


def test_contained(spark):
    rng = random.Random(1)
    word = lambda most: "".join(rng.choice("ab ") for _ in range(rng.randrange(most)))
    texts, needles = sorted({word(9) for _ in range(60)}), sorted({word(5) for _ in range(40)})
    got = op.contained(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    assert sorted(map(tuple, got)) == sorted((t, n) for t in texts for n in needles if n in t)


HOURS = {"h": 1.0, "мин": 1 / 60}


def restated(candidates, conditions, claims, hidden):
    """Every question, candidate, parameter and condition in turn."""
    out = []
    ids = {c[0] for c in candidates}
    for q, cond, name, least, most, unit in conditions:
        mapped = {"candidate-" + c.replace("claim-", "") for r, c in claims if r == q} & ids
        for cid, status, doc, parameters in candidates:
            if status != "approved" or doc in hidden or (mapped and cid not in mapped):
                continue
            for at, (other, v, low, high, own) in enumerate(parameters or []):
                other = (other or "").lower()
                if not other.strip() or not (name.lower() in other or other in name.lower()):
                    continue
                scale = lambda x, u: x if x is None or unit not in HOURS or u not in HOURS else x * HOURS[u]
                low, high = scale(v if low is None else low, own), scale(v if high is None else high, own)
                a, b = scale(least, unit), scale(most, unit)
                if not (high is not None and a is not None and high < a) and not (low is not None and b is not None and low > b):
                    out.append((q, cond, cid, doc, at))
    return sorted(out, key=str)


def test_conditions_met(spark):
    rng = random.Random(2)
    number = lambda: rng.choice([None, 0.0, -3.0, rng.uniform(-100, 100), rng.uniform(0, 1e-8), 10.0 ** rng.randrange(25)])
    name = lambda: rng.choice(["time", "Hold time", "TIME ", "hold", "", "  ", None, "t", "temperature"])
    candidates = [
        (f"candidate-{k}", rng.choice(["approved", "approved", "pending"]), rng.choice([None, "d1", "d2"]), rng.choice([None, [], [(name(), number(), number(), number(), rng.choice(["h", "мин", "", None, "xyz"])) for _ in range(3)]]))
        for k in range(80)
    ]
    conditions = [(f"q{k % 6}", f"c{k}", rng.choice(["time", "hold time", "temp", "t"]), number(), number(), rng.choice(["h", "мин", None, "zzz"])) for k in range(14)]
    claims = [("q0", "claim-3"), ("q0", "claim-999"), ("q1", "claim-998"), *[("q2", f"claim-{k}") for k in range(0, 80, 2)], ("q2", "claim-4")]
    args = spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(conditions, CONDITION), spark.createDataFrame(claims, "question_id string, claim_id string"), spark.createDataFrame([("d2",)], "document_id string")
    want = restated(candidates, conditions, claims, {"d2"})
    assert len(want) > 50
    met = op.conditions_met(*args)
    assert sorted(map(tuple, met.collect()), key=str) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_parameter_claims_keep_branches_apart(spark):
    nodes = [("c1", "Claim", "c1"), ("c2", "Claim", "c2"), ("c3", "Claim", "c3"), ("e1", "Experiment", "e1"), ("p1", "NumericParameter", "Current density"), ("p2", "Condition", "density"), ("p3", "Condition", "pH"), ("m", "Material", "density")]
    edges = [("c1", "p1", "MENTIONS"), ("e1", "p1", "measured_parameter"), ("e1", "p2", "operates_at_condition"), ("c2", "e1", "BASED_ON"), ("c3", "p3", "MENTIONS"), ("c3", "m", "MENTIONS"), ("m", "p1", "MENTIONS")]
    asked = [("a", "DENSITY"), ("b", "ph"), ("c", "nothing")]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = op.parameter_claims(frame(nodes, "id string, label string, name string"), frame(edges, "source string, target string, label string"), frame(asked, "question_id string, parameter string"))
    assert sorted(map(tuple, got.collect())) == [("a", "experiment", "c2"), ("a", "mention", "c1"), ("b", "mention", "c3")]
    other = got.select("question_id", "claim_id").unionByName(frame([("b", "c9")], "question_id string, claim_id string"))
    assert sorted(map(tuple, op.template_claims(got, other.withColumn("x", F.lit(1))).collect())) == [("a", "c1"), ("a", "c2"), ("b", "c3"), ("b", "c9")]

"""Passages of any length in texts, against a plain search."""

import random

from factloom.operators import quotes


def test_passages_of_any_length(spark):
    rng = random.Random(1)
    piece = lambda most: "".join(rng.choice("ab é") for _ in range(rng.randrange(most)))
    texts = [*enumerate(piece(60) for _ in range(50)), (90, ""), (91, None)]
    needles = [*((f"p{k}", piece(rng.choice([2, 4, 9]))) for k in range(40)), ("same", "ab"), ("same2", "ab"), ("empty", ""), ("none", None)]
    docs, items = spark.createDataFrame(texts, "doc_id long, hay string").repartition(3), spark.createDataFrame(needles, "item_id string, needle string")
    want = sorted((i, p) for i, hay in texts for p, needle in needles if hay is not None and needle is not None and needle in hay)
    for most in (32_000_000, 20):
        assert sorted(map(tuple, quotes.passages_in(docs, items, most_chars=most).collect())) == want
    assert quotes.passages_in(docs, items.where("false")).collect() == quotes.passages_in(docs.where("false"), items).collect() == []

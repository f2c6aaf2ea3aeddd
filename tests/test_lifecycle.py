from pyspark.sql import functions as F

from factloom.operators import facts as fact_op
from factloom.operators import graph, lifecycle


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, made int")
    new = spark.createDataFrame([(2, "B", 99), (3, "c", 30)], "id int, name string, made int")
    once = lifecycle.upsert(target, new, "id", keep=("made",))
    assert rows(once, "id") == [(1, "a", 10), (2, "B", 20), (3, "c", 30)] == rows(lifecycle.upsert(once, new, "id", keep=("made",)), "id")
    assert rows(lifecycle.upsert(target, new, "id", only=("name",)), "id") == [(1, "a", 10), (2, "B", 20), (3, "c", 30)]
    partly = new.select("id", F.lit(None).cast("string").alias("name"))
    assert rows(lifecycle.upsert(target, partly, "id"), "id") == [(1, "a", 10), (2, None, 20), (3, None, None)]
    vectors = spark.createDataFrame([("f", [0.123456789123])], "fragment_id string, embedding array<double>")
    assert lifecycle.upsert_vectors(vectors, vectors).first().embedding == [0.12345679] and lifecycle.of_dimension(vectors, 2).count() == 0


def test_cascade_and_retract(spark):
    docs = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    fragments = spark.createDataFrame([("f1", "d1"), ("f2", "d2")], "fragment_id string, document_id string")
    vectors = spark.createDataFrame([("f1",), ("f2",)], "fragment_id string")
    candidates = spark.createDataFrame([("c1", ("d1",)), ("c2", ("d2",)), ("c3", None)], "id string, source struct<document_id: string>")
    left = lifecycle.cascade_delete(docs.limit(1).where("document_id = 'd1'").union(spark.createDataFrame([("d1",)], "document_id string")), documents=docs, fragments=fragments, vectors=vectors, candidates=candidates)
    assert [sorted(r[0] for r in left[t].collect()) for t in ("documents", "fragments", "vectors", "candidates")] == [["d2"], ["f2"], ["f2"], ["c2", "c3"]]
    facts = spark.createDataFrame([("a", "d1", ["b", "c"], "conflicting"), ("b", "d2", ["a"], "conflicting"), ("c", "d3", ["a", "x"], "conflicting"), ("e", "d3", [], "approved")], "id string, document_id string, conflicts_with array<string>, status string")
    gone = spark.createDataFrame([("d1",)], "document_id string")
    assert rows(lifecycle.retract(facts, gone), "id") == [("b", "d2", [], "approved"), ("c", "d3", ["x"], "conflicting"), ("e", "d3", [], "approved")]


def test_decisions_edits_and_reprocessing(spark):
    candidates = spark.createDataFrame([("1", "pending_review"), ("2", "approved"), ("3", "approved")], "id string, status string")
    decisions = spark.createDataFrame([("1", "approve"), ("2", "unapprove"), ("9", "reject"), ("3", "burn")], "id string, decision string")
    assert rows(lifecycle.decide(candidates, decisions), "id") == [("1", "approved", "done"), ("2", "pending_review", "done"), ("3", "approved", "unknown decision"), ("9", None, "no such candidate")]
    base = spark.createDataFrame([("1", "Cu", "x"), ("2", "Ni", "y")], "id string, material string, secret string")
    over = spark.createDataFrame([("1", "Медь", "no")], "id string, material string, secret string")
    assert rows(lifecycle.edited(base, over, ("material",)), "id") == [("1", "Медь", "x", True), ("2", "Ni", "y", False)]
    schema = "id string, document_id string, status string, edited_by_human boolean"
    old = spark.createDataFrame([("1", "d", "rejected", None), ("2", "d", "approved", True), ("3", "d", "approved", False), ("4", "e", "approved", None)], schema)
    fresh = spark.createDataFrame([(k, "d", "pending_review", False) for k in "1235"], schema)
    assert [r[:3] for r in rows(lifecycle.reprocess(old, fresh), "id")] == [("1", "d", "rejected"), ("2", "d", "approved"), ("3", "d", "pending_review"), ("4", "e", "approved"), ("5", "d", "pending_review")]


def test_versions_duplicates_evolution(spark):
    docs = spark.createDataFrame([("d", "v1")], "id string, current_version_id string")
    versions = spark.createDataFrame([("v1", "sum", 1), ("v0", "old", 0)], "id string, checksum string, version_number int")
    assert lifecycle.current_version(docs, versions, "sum").first().id == "d" and lifecycle.current_version(docs, versions, "old").count() == 0
    assert rows(lifecycle.duplicates(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k"), "k") == [(1, 2)]
    assert lifecycle.evolved(docs, docs.withColumn("x", F.lit(1))).columns == ["id", "current_version_id", "x"]


def test_conflicts(spark):
    schema = "id string, material string, process string, property string, lab string, temperature_c double, effect_direction string"
    facts = spark.createDataFrame([("1", "Cu", "p", "h", "A", 705.0, "increase"), ("2", "cu", "p", "h", "B", 790.0, "decrease"), ("3", "Cu", "", "h", "C", None, "снижение"), ("4", "Ni", "p", "h", "A", 1.0, "decrease"), ("5", "Cu", "q", "h", "D", 704.0, "decrease")], schema)
    assert rows(fact_op.mark_conflicts(facts).select("id", "status"), "id") == [("1", "conflicting"), ("2", "conflicting"), ("3", "conflicting"), ("4", "approved"), ("5", "conflicting")]
    links = {r.id: r.conflicts_with for r in fact_op.conflict_links(facts).collect()}
    assert links == {"1": ["2", "3", "5"], "2": ["1"], "3": ["1"], "5": ["1"]}
    assert all(a in links[b] for a in links for b in links[a])
    assert rows(fact_op.contradictions(facts).select("labs"), "labs") == [("A, C",)]
    named = fact_op.filtered(facts.withColumns({"confidence": F.lit(1.0), "is_hypothesis": F.lit(False)}), materials=("медь",), synonyms={"cu": "Медь", "медь": "Медь"})
    assert sorted(r.id for r in named.collect()) == ["1", "2", "3", "5"]


def test_graph_names(spark):
    facts = spark.createDataFrame([("c1", "d", "СаО", "unknown", "h", "рост"), ("c2", "d", "CaO", "p", "n/a", ""), ("c3", "d", "сао ", "p", "h", "down")], "id string, document_id string, material string, process string, property string, effect_direction string")
    nodes, edges = graph.answer_graph(facts)
    got = {r.id: (r.type, r.label) for r in nodes.collect()}
    assert {k for k in got if k.startswith("material")} == {"material-cao", "material-cao-2"}
    assert got["c1"] == ("Claim", "h: рост") and got["c2"] == ("Claim", "c2") and got["c3"] == ("Claim", "h: down")
    assert "process-unknown" not in got and edges.where("label = 'CITES'").count() == 3
    entities = [("Process", "обжиг"), ("Odd", "x"), ("Equipment", "n/a")]
    relations = [("обжиг", "uses", "печь"), ("обжиг", "uses", "обжиг"), ("обжиг", "odd", "обжиг")]
    claims = spark.createDataFrame([("c", entities, relations)], "id string, entities array<struct<type: string, name: string>>, relations array<struct<subject: string, predicate: string, object: string>>")
    mentions, links = graph.semantic_projection(claims, ("Process", "Equipment"), {"uses": ((), ())})
    assert rows(mentions, "name") == [("c", "Process", "обжиг")] and rows(links, "subject") == [("обжиг", "uses", "обжиг")]
    assert graph.region_names("за рубежом")[0] == "Канада" and graph.region_names("РФ") == ["Россия"] and graph.region_names("Чили") is None
    text = spark.createDataFrame([("практика заводов Канады и россиян, индивидуальных",)], "t string")
    assert text.select(graph.regions_in(F.col("t")).alias("r")).first().r == ["Россия", "Канада"]

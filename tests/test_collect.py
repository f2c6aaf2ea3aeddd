from pyspark.sql import functions as F

from factloom.operators import collect, graph
from factloom.questions import Condition, Question

FACT = "id string, document_id string, fragment_id string, experiment_id string, material string, process string, property string, lab string, temperature_c double, effect_direction string, effect_value double, effect_unit string, confidence double, is_hypothesis boolean"
FACTS = [
    ("claim-1", "d1", "fragment-1", "e1", "Медь", "плавка", "выход", "A", 10.0, "increase", 5.0, "%", 0.9, False),
    ("claim-2", "d2", "fragment-2", "e2", "медь", "плавка", "Выход", "B", 12.0, "decrease", None, None, 0.7, False),
    ("claim-3", "d3", "fragment-3", "e3", "никель", "обжиг меди", "чистота", "C", None, "increase", None, None, 0.8, False),
    ("claim-4", "d4", "fragment-4", "e4", "медь", "плавка", "выход", "D", 11.0, "increase", None, None, 1.0, False),
    ("claim-5", "d1", "fragment-5", "e5", "медь", "", "выход", "A", 10.0, "increase", None, None, 0.95, True),
]


def base(spark, **more):
    facts = spark.createDataFrame(FACTS, FACT)
    documents = spark.createDataFrame([("d1", 2020, True, False), ("d2", 2010, False, False), ("d3", None, None, False), ("d4", 2021, True, True)], "document_id string, year int, is_scientific boolean, hidden boolean")
    fragments = spark.createDataFrame([(f"fragment-{k}", f"d{k if k < 5 else 1}", f"текст о меди {k}") for k in range(1, 6)], "fragment_id string, document_id string, text string")
    vectors = spark.createDataFrame([(f"fragment-{k}", [1.0, k / 10]) for k in range(1, 6)], "fragment_id string, embedding array<double>")
    return collect.Base(facts, documents, fragments, vectors, **more)


def ids(df):
    return [r.id for r in df.orderBy("rank", "id").collect()]


def test_words(spark):
    assert collect.question_words("Как ВП и electrowinning влияют на ёмкость?", {"вп": "взвешенная плавка", "electrowinning": "Электроэкстракция"}) == ["как", "вп", "взвешенная", "плавка", "electrowinning", "электроэкстракция", "влияют", "емкость"]


def test_fast(spark):
    b = base(spark)
    e = collect.collect_fast(b, "выход меди", [1.0, 0.0], k=3)
    assert ids(e.facts) == ["claim-5", "claim-1", "claim-3", "claim-2"]  # the most confident first; d4 is hidden; "меди" is a word of claim-3's process
    assert [r.fragment_id for r in e.hits.orderBy("rank").collect()] == ["fragment-1", "fragment-2", "fragment-3"]  # all equally near and with one of two words, so by id
    assert len(e.contradictions) == 1 and "лаборатории: A, B." in e.contradictions[0]
    assert collect.collect_fast(b, "на в", None) is None


def test_full(spark):
    b = base(spark)
    e = collect.collect_full(spark, b, "q", Question("q", material="медь", property="выход"), [1.0, 0.0])
    assert ids(e.facts) == ["claim-1", "claim-2"] and e.related.count() == 0 and e.gaps == [] and len(e.contradictions) == 1
    late = collect.collect_full(spark, b, "q", Question("q", material="медь", year_min=2015), [1.0, 0.0])
    assert ids(late.facts) == ["claim-1"] and {r.document_id for r in late.hits.collect()} == {"d1"}
    assert late.gaps == ["Результаты подтверждены менее чем двумя независимыми источниками.", "По заданному сроку издания отброшено фактов: 1 (включая источники, у которых год не определён)."]
    loose = collect.collect_full(spark, b, "q", Question("q", material="меди", equipment="печь"))
    assert ids(loose.related) == ["claim-3"] and loose.facts.count() == 0 and len(loose.hypotheses) == 1 and "«меди» (1 факт(ов))" in loose.hypotheses[0]
    assert all(r.is_hypothesis for r in loose.related.collect())
    none = collect.collect_full(spark, b, "q", None)
    assert none.facts.count() == 0 and none.gaps == ["Нет подтверждённых фактов для заданной комбинации условий."]


def test_full_asks_the_graph_and_the_numbers(spark):
    b = base(spark)
    b.mentions = graph.entity_mentions(b.facts)
    b.candidates = spark.createDataFrame(
        [("candidate-1", "approved", "d1", [("температура плавки", 700.0, None, None, "°C")]), ("candidate-3", "approved", "d3", [("температура", 100.0, None, None, "°C")])],
        "candidate_id string, status string, document_id string, parameters array<struct<name:string,value:double,value_min:double,value_max:double,unit:string>>",
    )
    e = collect.collect_full(spark, b, "q", Question("q", material="никель", property="нет", entities=(("Process", "обжиг"),)))
    assert ids(e.facts) == ["claim-3"]  # by the graph alone: no fact passes the filter
    q = Question("q", material="магний", target=Condition("температура", 600.0, 800.0, "°C"))
    e = collect.collect_full(spark, b, "q", q)
    assert e.facts.count() == 0 and e.related.count() == 0 and e.gaps == []  # numbers are direct evidence
    e = collect.collect_full(spark, b, "q", Question("q", material="медь", target=Condition("температура", 900.0, None, "°C")))
    assert e.gaps == ["Нет данных, напрямую подтверждающих целевой показатель «температура»."]


def test_a_question_gives_an_answer(spark):
    b = base(spark)
    seen = {}

    def model(text, shown):
        seen.update(shown)
        return {"summary": "Растёт [1], но [2, 9].", "sufficient": True}

    got, errors = collect.ask(spark, b, "медь", model, planner=lambda t: {"material": "медь", "property": "выход"}, embed=lambda t: [1.0, 0.0], fast=False)
    assert errors == [] and [f["n"] for f in seen["facts"]] == [1, 2] and [h["n"] for h in seen["search_hits"]] == [3, 4, 5, 6]
    assert got.summary == "Растёт [fragment-1], но [fragment-2]." and (got.status, got.confidence) == ("direct", 0.8)
    assert [r.id for r in got.experiments.collect()] == ["claim-1", "claim-2"] and len(got.contradictions) == 1

    def broken(*_):
        raise TimeoutError("late")

    got, errors = collect.ask(spark, b, "медь", broken, planner=broken, embed=broken, fast=False)
    assert errors == ["TimeoutError: late"] * 3 and got.status == "none" and got.experiments.count() == 0
    got, errors = collect.ask(spark, b, "медь", broken)
    assert len(errors) == 1 and got.status == "direct" and got.experiments.count() == 3 and got.summary.startswith("Ответ собран без языковой модели")


def test_the_graph_leads_to_all_claims_of_a_name_and_of_a_region(spark):
    b = base(spark)
    b.mentions = spark.createDataFrame([(f"claim-{k}", "Material", "медный сплав") for k in range(100)], "id string, type string, name string")
    b.regions = spark.createDataFrame([(f"claim-{k}", ["США"]) for k in range(100, 200)], "id string, regions array<string>")
    found = collect.traversed(spark, b, Question("q", material="сплав", region="США"))
    assert found.count() == found.distinct().count() == 200  # 40 of each before

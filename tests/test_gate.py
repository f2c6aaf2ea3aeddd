from pyspark.sql import functions as F

from factloom.operators import citations, gate, windows

PAYLOAD = (
    "struct<material: string, property: string, experiment_id: string, process: string, temperature_c: double, duration_h: double, effect_direction: string, effect_value: double, "
    "effect_unit: string, equipment: string, lab: string, numeric_parameters: array<struct<name: string, value: double, value_min: double, value_max: double, unit: string, raw_text: string>>>"
)
SOURCE = "struct<document_id: string, fragment_id: string, quote: string>"


def payload(**kw):
    names = ["material", "property", "experiment_id", "process", "temperature_c", "duration_h", "effect_direction", "effect_value", "effect_unit", "equipment", "lab", "numeric_parameters"]
    return tuple(kw.get(n) for n in names)


def test_the_gate(spark):
    text = "Нагрев штейна до 750 °C за 30 мин дал «рост» извлечения на 5 %."
    frags = [("f1", "d", None, None, text), ("h", "d", 1, 1, "Показатель | A | B"), ("r", "d", 1, 2, "t°C | 60 | 61")]
    fragments = gate.with_headers(spark.createDataFrame(frags, "fragment_id string, document_id string, table int, row int, text string"))
    good = payload(material="штейн", property="извлечение", temperature_c=750.0, duration_h=0.5, effect_direction="рост", effect_value=5.0, effect_unit="%", equipment=" - ", numeric_parameters=[])
    rows = [
        ("candidate-1", good, ("d", "f1", 'дал "рост" извлечения')),
        ("candidate-2", payload(material="штейн", property="N/A", temperature_c=900.0, numeric_parameters=[("температура", 3000.0, None, None, "°C", ""), ("pH", 4.0, None, None, "мг/л", "")]), ("d", "f1", "выдумано")),
        ("candidate-3", good, None),
        ("candidate-4", payload(material="a", property="b", temperature_c=61.0), ("d", "r", "t°C | 60")),
    ]
    judged = gate.judged(spark.createDataFrame(rows, f"id string, payload {PAYLOAD}, source {SOURCE}"), fragments)
    got = {r.id: r for r in judged.collect()}
    assert (got["candidate-1"].status, got["candidate-1"].confidence, got["candidate-1"].review_issues) == ("approved", 1.0, [])
    issues = [(i.code, i.field) for i in got["candidate-2"].review_issues]
    assert issues == [("field_missing", "property"), ("quote_unconfirmed", "quote"), ("number_unconfirmed", "temperature_c"), ("number_unconfirmed", "температура"), ("number_implausible", "температура"), ("number_unconfirmed", "pH"), ("unit_mismatch", "pH")]
    assert got["candidate-2"].confidence == 0.0
    assert [(i.code, i.field) for i in got["candidate-3"].review_issues] == [("source_missing", "source")]
    assert got["candidate-4"].status == "approved"
    facts = {f.id: f for f in gate.facts_of(judged).collect()}
    assert set(facts) == {"claim-1", "claim-4"}
    f = facts["claim-1"]
    assert (f.material_id, f.effect_direction, f.equipment, f.lab, f.temperature_c) == ("material-штейн", "increase", None, "", 750.0)


def test_equal_statements_are_checked_once(spark):
    """The checks stand behind an aggregate by what they read, and tell -0.0 from 0.0, which number_in_text writes in two ways."""
    fragments = spark.createDataFrame([(f"f{k}", None, text) for k, text in enumerate(["held at 0 x", "held at 0 x", "held at -0 x", "held at 0 x"])], "fragment_id string, header string, text string")
    rows = [(f"candidate-{k}", payload(material=f"m{k}", property="p", effect_value=v, effect_unit="x", numeric_parameters=[("a", v, None, None, "x", "")]), ("d", f"f{k}", "held at")) for k, v in enumerate((0.0, 0.0, -0.0, -0.0))]
    judged = gate.judged(spark.createDataFrame(rows, f"id string, payload {PAYLOAD}, source {SOURCE}"), fragments)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("number_issues") < plan.index("Aggregate [_key")
    found = {r.id: [i.field for i in r.number_issues] for r in judged.collect()}
    assert found["candidate-0"] == found["candidate-1"] == found["candidate-2"] == [] and found["candidate-3"] == ["effect_value", "a"]


def test_values_with_units(spark):
    cases = [("Температура, оС | Расход, л/мин", "60 | 5", "60 оС\n5 л/мин"), ("Показатель | A | B", "t°C | 60 | 60", "60 °C\n60 °C"), ("A | B", "Выход, % | 90 | 91", "90 %\n91 %"), ("№ | Величина | Единицы измерения", "1 | 5 | мг/л", "1 мг/л\n5 мг/л"), ("a", "5", ""), ("a, м | b, с", "1 | 2 | 3 | 4", "")]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "i int, h string, r string, want string")
    for r in rows.select("want", gate.values_with_units(F.col("h"), F.col("r")).alias("got")).collect():
        assert r.got == r.want


def test_citations(spark):
    cases = [("A [3, 7]", {"3": "f-a", "7": "f-b"}, "A [f-a, f-b]"), ("в [2023]", {"1": "x"}, "в [2023]"), ("[5–7] x", {"5": "a", "6": "b", "7": "c"}, "[a, b, c] x"), ("[1–999]", {"1": "a"}, "[1–999]"), ("[2, 2, 9] [x] [", {"2": "q"}, "[q] [x] ["), ("", {}, "")]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "i int, t string, m map<string,string>, want string")
    for r in rows.select("want", citations.translate_markers(F.col("t"), F.col("m")).alias("got")).collect():
        assert r.got == r.want
    texts = spark.createDataFrame([(0, "x [fragment-2, claim-1] y"), (1, "[fragment-1] [fragment-2] [claim-9]")], "position int, text string")
    fragments = spark.createDataFrame([(f"fragment-{k}", "d", "t" * 300) for k in (1, 2)], "fragment_id string, document_id string, text string")
    facts = spark.createDataFrame([("claim-1", "fragment-7", "e")], "id string, fragment_id string, document_id string")
    got = citations.cited_sources(texts, fragments, facts).orderBy("rank").collect()
    assert [(r.cited, r.fragment_id, r.document_id, r.quote and len(r.quote)) for r in got] == [("fragment-2", "fragment-2", "d", 200), ("claim-1", "fragment-7", "e", None), ("fragment-1", "fragment-1", "d", 200)]
    pre = spark.createDataFrame([("Гипотеза (косвенная): рост",), ("косвенно:",), ("обычный",)], "t string")
    assert [r.x for r in pre.select(citations.strip_hypothesis_prefix(F.col("t")).alias("x")).collect()] == ["Рост", "косвенно:", "обычный"]


def test_numbering(spark):
    facts = spark.createDataFrame([(k, f"a{k}") for k in range(20)], "rank int, fragment_id string")
    hits = spark.createDataFrame([(k, f"b{k}") for k in range(20)], "rank int, fragment_id string")
    rows = citations.number_evidence(facts, hits).orderBy("n").collect()
    assert [r.fragment_id for r in rows] == [f"a{k}" for k in range(15)] + [f"b{k}" for k in range(10)]


def test_quotes_are_attributed(spark):
    frags = [("f1", "о меди и никеле"), ("f2", "Рост «извлечения» меди"), ("f3", "иное")]
    rows = [("a", "рост извлечения", frags), ("b", "никеле и прочее", frags), ("c", "zzz", frags), ("d", None, frags)]
    df = spark.createDataFrame(rows, "id string, quote string, fragments array<struct<fragment_id: string, text: string>>")
    assert {r.id: r.fragment_id for r in windows.attribute_quote(df).collect()} == {"a": "f2", "b": "f1", "c": "f1", "d": "f1"}

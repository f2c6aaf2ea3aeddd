import json

from pyspark.sql import functions as F

from factloom import models
from factloom.operators import answer, routing, web
from factloom.domain import Domain

FACT = "rank int, id string, document_id string, fragment_id string, experiment_id string, material string, process string, property string, lab string, temperature_c double, effect_direction string, effect_value double, effect_unit string, confidence double, is_hypothesis boolean"


def fact(k, **kw):
    row = {"rank": k, "id": f"claim-{k}", "document_id": f"d{k % 2}", "fragment_id": f"fragment-{k}", "experiment_id": "e", "material": "медь", "process": "плавка", "property": "выход", "lab": "l", "temperature_c": 1.0, "effect_direction": "increase", "effect_value": 5.0, "effect_unit": "%", "confidence": 0.8, "is_hypothesis": False} | kw
    return tuple(row.values())


def evidence(spark):
    facts = spark.createDataFrame([fact(k) for k in range(3)], FACT)
    hits = spark.createDataFrame([(0, "fragment-9", "d1", "hit text", 0.5)], "rank int, fragment_id string, document_id string, text string, score double")
    return answer.Evidence(facts, spark.createDataFrame([], FACT), hits, hypotheses=["Косвенно: рост"])


def context(spark):
    fragments = spark.createDataFrame([(f"fragment-{k}", f"d{k % 2}", "t") for k in range(10)], "fragment_id string, document_id string, text string")
    documents = spark.createDataFrame([("d0", True), ("d1", None)], "document_id string, is_scientific boolean")
    return fragments, documents


def test_finalize_direct(spark):
    e = evidence(spark)
    got = answer.finalize(spark, e, {"summary": "Да [1, 4]. [2020]", "gaps": ["нет [2]"], "hypotheses": ["рост"], "sufficient": True}, *context(spark), e.facts)
    assert got.summary == "Да [fragment-0, fragment-9]. [2020]" and got.gaps == ["нет [fragment-1]"] and got.hypotheses == ["Рост", "рост"]
    assert (got.status, got.confidence, got.scientific_share) == ("direct", 0.8, 0.5)
    assert [r.effect for r in got.experiments.collect()] == ["рост на 5%"] * 3
    assert {r.fragment_id for r in got.sources.collect()} == {"fragment-0", "fragment-1", "fragment-2", "fragment-9"}
    assert {r.type for r in got.nodes.collect()} == {"Claim", "Document", "Material", "Process"} and got.edges.count() == 9


def test_finalize_insufficient(spark):
    e = evidence(spark)
    got = answer.finalize(spark, e, {"summary": "x [1]", "sufficient": False}, *context(spark), e.facts)
    assert (got.status, got.experiments.count(), got.related_experiments.count(), got.confidence, got.nodes.count()) == ("partial", 0, 3, 0.8, 0)
    silent = answer.finalize(spark, e, {}, *context(spark), e.facts)
    assert silent.summary.startswith("Ответ собран без языковой модели") and "3 факт" in silent.summary
    assert json.loads(answer.preview(e).first().preview).keys() == {"facts", "related", "search_hits"}


def test_claims_from_a_model(spark):
    text = "Медь: выход increases. Никель: чистота decreases. " + "x" * 30
    windows = spark.createDataFrame([("w1", text, "S", "text"), ("w2", "short", "", "text")], "window_id string, text string, section string, kind string")
    asked = models.prompts(windows, "{section}|{fragment_text}")
    assert [r.window_id for r in asked.collect()] == ["w1"]
    got = models.claims(models.call(asked)).orderBy("claim_no").collect()
    assert [(r.payload.material, r.payload.property, r.payload.effect_direction, r.confidence) for r in got] == [("S|Медь", "выход", "increase", 0.9), ("Никель", "чистота", "decrease", 0.9)]
    reply = '```json {"claims": [{"property": " "}, {"material": "a", "temperature_c": "5,5", "effect_direction": "up", "confidence": 7}, {"material": "b", "confidence": "x", "numeric_parameters": [{"name": "pH", "value": 4}]}]}```'
    rows = models.claims(spark.createDataFrame([("w", reply), ("v", "no json"), ("u", None)], "window_id string, answer string")).orderBy("claim_no").collect()
    assert [(r.claim_no, r.payload.material, r.payload.property, r.payload.temperature_c, r.payload.effect_direction, r.confidence) for r in rows] == [(1, "a", "не указано", 5.5, "unknown", 1.0), (2, "b", "не указано", None, "unknown", 0.5)]

    def broken():
        raise_ = lambda prompt: 1 / 0
        return raise_

    assert models.call(asked, broken).first().answer is None
    t = spark.createDataFrame([('{"teaser": "...что медь?", "question": "q"}',), ('{"teaser": "медь"}',)], "a string").select(models.teaser(F.col("a")).alias("t")).collect()
    assert [(r.t.teaser, r.t.question) if r.t else None for r in t] == [("…что медь?", "q"), None]


def test_routes(spark):
    rows = spark.createDataFrame([("как дела?",), ("Что такое штейн",), ("отжиг при 700 °C",), ("",), ("про Файнштейн и медь",), ("чем отличается одно",)], "q string")
    domain = Domain(synonyms={"файнштейн": "Файнштейн"})
    got = rows.select(routing.off_topic(F.col("q"), domain).alias("o"), routing.needs_full_path(F.col("q")).alias("f")).collect()
    assert [(r.o, r.f) for r in got] == [(True, False), (False, False), (False, True), (True, False), (False, False), (True, True)]
    kinds = spark.createDataFrame([("a 1", "text", False), ("a", "table", False), ("a", "text", True), ("a", "text", False)], "t string, k string, i boolean")
    assert [r.r for r in kinds.select(models.route(F.col("t"), F.col("k"), F.col("i")).alias("r")).collect()] == ["full", "full", "vision", "light"]


def test_web(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://a/1</id><title>T  <b>1</b></title><summary>S1</summary><published>2021-01-01</published></entry><entry><id>http://a/2</id><title>T2</title><summary>S2</summary><published>x</published></entry></feed>'
    got = web.parse_atom(spark.createDataFrame([(1, atom.replace("  <b>1</b>", ""))], "question_id int, body string")).collect()
    assert [(r.title, r.url, r.snippet, r.year) for r in got] == [("T", "http://a/1", "S1", 2021), ("T2", "http://a/2", "S2", None)]
    cross = json.dumps({"message": {"items": [{"URL": "u", "title": ["<i>t</i>"], "abstract": "<p>abc</p>", "issued": {"date-parts": [[1999, 2]]}}, {"title": ["no url"]}, {"URL": "v", "container-title": ["J"]}]}})
    got = web.parse_crossref(spark.createDataFrame([(1, cross)], "question_id int, body string")).collect()
    assert [(r.title, r.url, r.snippet, r.year) for r in got] == [("t", "u", "abc", 1999), ("v", "v", "J", None)]
    semantic = json.dumps({"data": [{"title": "a", "abstract": None, "url": "u", "year": 2000}]})
    assert web.parse_semantic(spark.createDataFrame([(1, semantic), (2, "bad")], "question_id int, body string")).count() == 1
    q = spark.createDataFrame([("Какие методы очистки шахтной воды применяются",)], "q string")
    assert q.select(web.simplified(F.col("q"), ("какие", "применяются")).alias("x")).first().x == "методы очистки шахтной воды"
    assert q.select(web.with_glossary(F.lit("Stein, steinway STEIN"), {"stein": "matte"}).alias("x")).first().x == "matte, steinway matte"
    results = spark.createDataFrame([(1, 0, 0, "A", "http://x.org/1", "медь"), (1, 0, 1, "a", "http://y.org", ""), (1, 1, 0, "B", "https://www.x.org/1/", "s"), (1, 1, 1, "C", "http://z.org", "никель")], "question_id int, priority int, position int, title string, url string, snippet string")
    assert [r.title for r in web.merge_results(results).orderBy("rank").collect()] == ["A", "C"]
    assert [r.url for r in web.relevant(results, "про никеля").collect()] == ["http://z.org"] and web.from_domains(results, ("y.org",)).count() == 1


def test_atom_entries_keep_their_own_fields(spark):
    feed = """<feed xmlns="a" xmlns:x="y"><title>all</title><entry><id>u1</id><title>A</title></entry>
        <entry><id>u2</id><published>2019-01-02</published><title>B</title><summary>s2 &amp; more</summary><x:c>z</x:c></entry><entry><title>no url</title></entry></feed>"""
    got = web.parse_atom(spark.createDataFrame([(1, feed), (2, None)], "question_id int, body string")).orderBy("position").collect()
    assert [(r.title, r.url, r.snippet, r.year) for r in got] == [("A", "u1", "", None), ("B", "u2", "s2 & more", 2019)]

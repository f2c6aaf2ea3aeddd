import pytest
from pyspark.sql import functions as F

from factloom.functions.quantity import Quantities, number_in_text


def hits(spark, texts):
    q = Quantities()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", q.hits(F.col("t")).alias("h")).orderBy("i").collect()
    return [[(h.value, h.kind, round(h.normalized_value, 6), h.normalized_unit) for h in r.h] for r in rows]


def test_numbers_with_units(spark):
    cases = {
        "700-750 °C": [(700.0, "temperature", 700.0, "C"), (750.0, "temperature", 750.0, "C")],
        "200...300 мг/л": [(200.0, "concentration", 200.0, "mg/L"), (300.0, "concentration", 300.0, "mg/L")],
        "нагрев до 323 K": [(323.0, "temperature", 49.85, "C"), (323.0, "temperature", 323.0, "C")],
        "EXP-001": [],
        "30 с при": [(30.0, "duration", 0.008333, "h")],
        "2 части": [],
        "12 000 мг/л": [(12000.0, "concentration", 12000.0, "mg/L")],
        "pH 4-6": [(4.0, "dimensionless", 4.0, "pH"), (6.0, "dimensionless", 6.0, "pH")],
        "рН 3,5": [(3.5, "dimensionless", 3.5, "pH")],
        "1538 оС": [(1538.0, "temperature", 1538.0, "C")],
        "5 осей": [],
        "5 г/л и 2,5 МПа": [(5.0, "concentration_high", 5.0, "g/L"), (2.5, "pressure", 2.5, "MPa")],
        "−5 °C": [(-5.0, "temperature", -5.0, "C")],
        "": [],
    }
    assert dict(zip(cases, hits(spark, list(cases)), strict=True)) == cases
    assert hits(spark, [None]) == [[]]


def test_convert(spark):
    q = Quantities()
    rows = [(60.0, "мин", "duration"), (1.0, "atm", "pressure_bar"), (323.15, "K", "temperature"), (5.0, "г/л", "duration"), (5.0, None, "duration"), (7.0, "pH", "dimensionless"), (3.0, "ppm", "concentration_trace"), (2.0, "x", None)]
    got = spark.createDataFrame(rows, "v double, u string, q string").select(q.convert(F.col("v"), F.col("u"), F.col("q")).alias("c")).collect()
    assert [(round(r.c.value, 5), r.c.unit) if r.c else None for r in got] == [(1.0, "h"), (1.01325, "bar"), (50.0, "C"), None, (5.0, "h"), (7.0, "pH"), (3.0, "g/t"), (2.0, "x")]


@pytest.mark.parametrize(("value", "unit", "quantity", "text", "seen"), [(5.0, "мг/л", None, "5 г/л", False), (5000.0, "мг/л", None, "5 г/л", True), (50.0, "°C", None, "50 K", True), (2.0, None, "duration", "120 мин", True), (42.0, None, None, "всего 42 штуки", True), (42.0, None, None, "всего 142 штуки", False), (4.2, None, None, "итого 4,2", True)])
def test_seen_in_source(spark, value, unit, quantity, text, seen):
    q = Quantities()
    row = spark.createDataFrame([(value, unit, quantity, text)], "v double, u string, q string, t string")
    assert row.select(q.seen(F.col("v"), F.col("u"), F.col("q"), q.hits(F.col("t")), F.col("t")).alias("s")).first().s is seen


def test_rules(spark):
    q = Quantities()
    rows = spark.createDataFrame([("graphite",), ("температура электролита в ванне",), ("Температура",), ("",)], "n string")
    assert [r.r.name if r.r else None for r in rows.select(q.rule(F.col("n")).alias("r")).collect()] == ["pH", "температура электролита", "температура", None]


def test_plain_numbers(spark):
    rows = spark.createDataFrame([(0.5, "на 0,5 больше", True), (0.5, "10,5", False), (1e6, "1e+06", True), (12.0, "12.5", False)], "v double, t string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", number_in_text(F.col("v"), F.col("t")).alias("got")).collect())

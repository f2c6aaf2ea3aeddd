"""The answer to a question, from its parts: rows, summary without a model, sources, preview, picks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import citations
from . import facts as fact_op
from . import graph as graph_op


def effect_text(direction: Column, value: Column, unit: Column) -> Column:
    """"рост на 5%": the direction's label, and by how much."""
    label = tx.direction_label(direction)
    return F.when(value.isNull(), label).otherwise(F.concat(label, F.lit(" на "), tx.general_number(value), F.coalesce(unit, F.lit(""))))


def experiment_rows(facts: DataFrame, *order: Column, most: int = 20) -> DataFrame:
    """The first facts as rows of the answer's table."""
    first = facts.orderBy(*order, "id").limit(most)
    value, unit = (F.col(c) if c in facts.columns else F.lit(None).cast(k) for c, k in (("effect_value", "double"), ("effect_unit", "string")))
    return first.select("id", "experiment_id", "material", "process", "temperature_c", "property", effect_text(F.col("effect_direction"), value, unit).alias("effect"), "lab", "confidence", "document_id", "fragment_id")


def degraded_summary(n_facts: int, n_direct: int, hits: list[tuple[str, str]], failed: bool) -> str:
    """What a summary without a model says. hits: (name, text) of the first hits, at most as many as are shown."""
    if n_direct:
        body = f"В базе знаний найдено {n_facts} факт(ов) по запросу — см. таблицу фактов и источники."
    elif n_facts:
        body = f"Прямых фактов не найдено; есть {n_facts} косвенных кейс(ов) по смежным понятиям — см. гипотезы."
    elif hits:
        lines = "\n- ".join(f"«{name}» — {text[:160].strip()}…" for name, text in hits[:3])
        body = f"Фактов в графе не найдено, но семантический поиск дал {len(hits)} релевантных фрагментов:\n- {lines}"
    else:
        body = "В базе знаний ничего не найдено по этому запросу."
    return ("Ответ собран без языковой модели (см. причину выше). " if failed else "") + body


@dataclass
class Evidence:
    """What was found for a question. facts and related are fact tables with `rank`; hits: rank, fragment_id, document_id, text, score."""

    facts: DataFrame
    related: DataFrame
    hits: DataFrame
    contradictions: list[str] = field(default_factory=list)
    gaps: list[str] = field(default_factory=list)
    hypotheses: list[str] = field(default_factory=list)


@dataclass
class Answer:
    """The sections of an answer: tables, and the few texts that are shown."""

    summary: str
    status: str
    confidence: float
    scientific_share: float | None
    experiments: DataFrame
    related_experiments: DataFrame
    sources: DataFrame
    nodes: DataFrame
    edges: DataFrame
    contradictions: list[str]
    gaps: list[str]
    hypotheses: list[str]


def _merged(*lists: list[str]) -> list[str]:
    return list(dict.fromkeys(t for texts in lists for t in texts or []))


def finalize(spark: SparkSession, evidence: Evidence, model: dict, fragments: DataFrame, documents: DataFrame, visible: DataFrame, most: int = 12) -> Answer:
    """The answer from the evidence and the model's reply (summary, contradictions, gaps, hypotheses, sufficient).

    A reply that calls the evidence insufficient makes all of it related: the table of direct facts and the graph are empty, and confidence is the related
    facts'. Sources are the first `most`, and every fragment that a text cites. Texts and markers are a page's worth; facts, sources and graph stay tables.
    """
    numbered = citations.number_evidence(evidence.facts.select("rank", "fragment_id"), evidence.hits.select("rank", "fragment_id"))
    index = {str(r.n): r.fragment_id for r in numbered.collect()}  # 25 rows at most
    n_facts, n_related, n_hits = evidence.facts.count(), evidence.related.count(), evidence.hits.count()
    shown = [(r.document_id, r.text) for r in evidence.hits.orderBy("rank", "fragment_id").limit(8).collect()] if n_hits else []
    summary = model.get("summary") or degraded_summary(n_facts or n_related, n_facts, shown, not model)
    texts = [summary, *_merged(evidence.contradictions, model.get("contradictions")), "\0", *_merged(evidence.gaps, model.get("gaps")), "\0", *_merged(evidence.hypotheses, model.get("hypotheses"))]
    table = spark.createDataFrame(list(enumerate(texts)), "position int, text string")
    marks = F.create_map(*[F.lit(x) for pair in index.items() for x in pair]) if index else F.create_map().cast("map<string,string>")
    table = table.withColumn("text", citations.translate_markers(F.col("text"), marks))
    done = [r.text for r in table.orderBy("position").collect()]
    summary, rest = done[0], "\1".join(done[1:]).split("\0")
    contradictions, gaps, hypotheses = ([t for t in part.split("\1") if t] for part in rest)
    if hypotheses:
        bare = spark.createDataFrame(list(enumerate(hypotheses)), "i int, t string").orderBy("i").select(citations.strip_hypothesis_prefix(F.col("t")).alias("t"))
        hypotheses = _merged([r.t for r in bare.collect()])
    cited = citations.cited_sources(table.where(F.col("text") != "\0"), fragments, visible)
    facts, related = evidence.facts, evidence.related
    direct = n_facts > 0
    if model.get("sufficient") is False:
        linked = visible.join(cited.select("fragment_id"), "fragment_id", "left_semi").withColumn("rank", F.lit(1 << 30))
        related = fact_op.unique_facts(*[x.select(facts.columns) for x in (related, facts, linked)]).withColumn("rank", F.col("list_no") * (1 << 31) + F.col("rank")).drop("list_no")
        facts, direct = facts.limit(0), False
    experiments, other = (experiment_rows(x, F.col("rank")) for x in (facts, related))
    found = fact_op.sources(evidence.facts.select("document_id", "fragment_id", "rank").unionByName(evidence.hits.select("document_id", "fragment_id", (F.col("rank") + (1 << 30)).alias("rank"))), F.col("rank"))
    first = found.orderBy("rank", "fragment_id").limit(most)
    sources = fact_op.first_of_each(first.select("document_id", "fragment_id", F.col("rank").cast("long").alias("rank")).unionByName(cited.select("document_id", "fragment_id", (F.col("rank") + (1 << 40)).cast("long").alias("rank"))), ["fragment_id"], F.col("rank"))
    notes = cited.select("document_id", "fragment_id").unionByName(experiments.select("document_id", "fragment_id")).unionByName(other.select("document_id", "fragment_id")).dropDuplicates(["fragment_id"])
    share = fact_op.scientific_share(notes, documents).first().scientific_share
    pool = related if model.get("sufficient") is False else facts
    nodes, edges = graph_op.answer_graph(facts.orderBy("rank", "id").limit(20))
    status = "direct" if direct else "partial" if n_related + n_facts + n_hits else "none"
    return Answer(summary, status, fact_op.mean_confidence(pool).first().confidence, share, experiments, other, sources, nodes, edges, contradictions, gaps, hypotheses)


def preview(evidence: Evidence) -> DataFrame:
    """One row, one JSON text: what can be shown before a model has answered."""
    rows = lambda df, k: df.orderBy("rank").limit(k).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("j"))
    parts = [("facts", rows(evidence.facts, 20)), ("related", rows(evidence.related, 20)), ("search_hits", rows(evidence.hits, 8))]
    out = None
    for name, part in parts:
        one = part.select(F.lit(1).alias("one"), F.col("j").alias(name))
        out = one if out is None else out.join(one, "one")  # one row on either side
    return out.select(F.to_json(F.struct(*[n for n, _ in parts])).alias("preview"))


def did_you_know(facts: DataFrame, phrases: DataFrame, seed: int) -> DataFrame:
    """A fact for the front page: one that has a phrase (id, teaser, question), if there is any; the choice follows the seed."""
    both = facts.join(phrases, "id", "left").withColumn("cold", F.col("teaser").isNull())
    return both.orderBy("cold", F.xxhash64("id", F.lit(seed)), "id").limit(1).drop("cold")


def document_list(documents: DataFrame, scientific: bool | None = None, types: tuple[str, ...] = (), title: str = "", newest_first: bool = True) -> DataFrame:
    """Documents of a reader's choice, by year, those without a year last."""
    keep = F.lit(True)
    if scientific is not None:
        keep &= F.coalesce(F.col("is_scientific"), F.lit(False)) == scientific
    if types:
        keep &= F.col("doc_type").isin(*types)
    if title:
        keep &= F.contains(F.translate(F.lower("filename"), "ё", "е"), F.lit(title.lower().replace("ё", "е")))
    year = F.col("year")
    return documents.where(keep).orderBy(year.desc_nulls_last() if newest_first else year.asc_nulls_last(), "document_id")


def recent_questions(asked: DataFrame, most: int = 5) -> DataFrame:
    """user_id, question: each user's last different questions, the newest first."""
    last = asked.groupBy("user_id", "question").agg(F.max("ts").alias("ts"))
    return last.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "question"))).where(F.col("n") <= most)

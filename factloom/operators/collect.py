"""From a question to its evidence, and on to its answer: the fast way by words and nearest fragments, the full way by a plan, the graph, filters and numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..questions import Question, parse
from ..shared import written
from . import answer, conditions, graph, search
from . import facts as fact_op

#: The best rank; a fact's rank is this less its score in millionths, so that lower ranks come first.
_BEST = 10_000_000


@dataclass
class Base:
    """What questions are asked of. documents: document_id, year, is_scientific, hidden; fragments: fragment_id, document_id, text; vectors: fragment_id, embedding.

    Optional: mentions (id, type, name: what the graph's claims name; `graph.entity_mentions(facts)`), nodes and edges of the stored graph, regions (id, regions) of claims, candidates with parameters.
    What is not given finds nothing.
    """

    facts: DataFrame
    documents: DataFrame
    fragments: DataFrame
    vectors: DataFrame | None = None
    mentions: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    regions: DataFrame | None = None
    candidates: DataFrame | None = None
    synonyms: dict | None = None

    def hidden(self) -> DataFrame:
        return self.documents.where("hidden").select("document_id")

    def visible(self) -> DataFrame:
        return fact_op.visible(self.facts, self.hidden())


def question_words(text: str, synonyms: dict | None = None) -> list[str]:
    """The words of a question that facts are looked for by: of over two letters, or known synonyms, with the words of what these stand for."""
    aliases = {k.strip().lower().replace("ё", "е"): v for k, v in (synonyms or {}).items()}
    cut = lambda t: [w for w in "".join(c if c.isascii() and c.isalnum() or "а" <= c <= "я" else " " for c in t.lower().replace("ё", "е")).split()]
    found = [w for w in cut(text) if len(w) > 2 or w in aliases]
    return list(dict.fromkeys(x for w in found for x in (w, *(cut(aliases[w]) if w in aliases else ()))))


def _hits(base: Base, text: str, vector: list[float] | None, k: int) -> DataFrame:
    """rank, fragment_id, document_id, text, score: at most k rows."""
    if vector is None or base.vectors is None:
        return base.fragments.limit(0).select(F.lit(0).alias("rank"), "fragment_id", "document_id", "text", F.lit(0.0).alias("score"))
    found = search.hybrid(base.vectors, base.fragments, vector, text, base.hidden(), k)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "fragment_id")) - 1)  # k rows
    return written(base.fragments.join(F.broadcast(ranked), "fragment_id").select("rank", "fragment_id", "document_id", "text", "score"), k)


def contradiction_texts(facts: DataFrame, most: int, synonyms: dict | None = None) -> list[str]:
    """What is said of contradictions among the facts: the first `most` texts, by name."""
    name = lambda c: F.min(fact_op.canonical_entity(F.col(c), synonyms)).alias(c)
    names = fact_op.conflict_keys(facts, synonyms).groupBy("material_key", "property_key").agg(name("material"), name("property"))
    said = F.concat("material", F.lit(", "), "property", F.lit(": разные источники показывают противоположный эффект при сопоставимых условиях; лаборатории: "), "labs", F.lit("."))
    found = fact_op.contradictions(facts, synonyms=synonyms).join(names, ["material_key", "property_key"])
    return [r.t for r in found.select(said.alias("t")).distinct().orderBy("t").limit(most).collect()]


def collect_fast(base: Base, text: str, vector: list[float] | None = None, k: int = 10, most_facts: int = 30, most_texts: int = 50) -> answer.Evidence | None:
    """Nearest fragments and facts with a word of the question, the most confident; None where there are neither."""
    hits = _hits(base, text, vector, k)
    words = question_words(text, base.synonyms)
    found = fact_op.word_matches(base.visible(), words, most_facts) if words else base.facts.limit(0)
    facts = written(_ranked(found.withColumn("rank_score", F.col("confidence"))), most_facts)
    if facts.isEmpty() and hits.isEmpty():
        return None
    return answer.Evidence(facts, facts.limit(0), hits, contradiction_texts(facts, most_texts, base.synonyms))


def _ranked(facts: DataFrame) -> DataFrame:
    return facts.withColumn("rank", (F.lit(_BEST) - F.round(F.col("rank_score") * 1_000_000)).cast("long")).drop("rank_score")


def traversed(spark: SparkSession, base: Base, question: Question) -> DataFrame | None:
    """claim_id: all that the graph leads to from a question's names, numbers and region, each once; None where nothing was asked of the graph or there is none."""
    found = []
    terms = _terms(question)
    if terms and base.mentions is not None:
        found.append(graph.entity_neighbours(base.mentions, terms))
    asked = [c.parameter for c in _conditions(question)]
    if asked and base.nodes is not None and base.edges is not None:
        found.append(conditions.parameter_claims(base.nodes, base.edges, spark.createDataFrame([(0, p) for p in asked], "question_id int, parameter string")).select("claim_id"))
    if question.region and base.regions is not None:
        found.append(graph.region_claims(base.regions, question.region, None))
    return reduce(DataFrame.unionByName, found).distinct() if found else None


def _conditions(question: Question) -> list:
    return [*question.conditions, *([question.target] if question.target else [])]


def _terms(question: Question) -> list[str]:
    """What is looked for by name: of the graph all at once, of facts one by one when nothing fits them all."""
    return [t for t in (question.material, question.process, question.equipment, *(name for _, name in question.entities)) if t]


def indirect(base: Base, question: Question) -> tuple[DataFrame, list[str]]:
    """Facts whose material or process holds one of the question's names, as hypotheses, ranked by the first name they hold; and what is said of each name that is found."""
    terms, visible = _terms(question), base.visible()
    if not terms:
        return visible.limit(0).withColumn("rank", F.lit(0).cast("long")), []
    holds = lambda t: F.contains(F.lower("material"), n := F.lower(fact_op.canonical_entity(F.lit(t), base.synonyms))) | F.contains(F.lower("process"), n)
    rank = F.coalesce(*[F.when(holds(t), F.lit(i)) for i, t in enumerate(terms)])
    found = fact_op.first_of_each(visible.withColumn("rank", rank.cast("long")).where("rank is not null"), ["id"], F.col("rank"))
    counts = {r.term: r.facts for r in fact_op.loose_search(visible, list(dict.fromkeys(terms)), base.synonyms).collect()}  # a row for each name
    said = [f"Прямых данных по полной комбинации не найдено. Найдены косвенные кейсы по «{t}» ({counts[t]} факт(ов)) — не подтверждённый вывод, гипотеза для проверки." for t in terms if counts.get(t)]
    return found.withColumn("is_hypothesis", F.lit(True)), said


def numeric_evidence(spark: SparkSession, base: Base, question: Question, claims: DataFrame | None) -> DataFrame | None:
    """The candidates' parameters that can meet the question's conditions and its target, from documents of its years; those without a source stay. None where no numbers were asked for."""
    asked = _conditions(question)
    if not asked or base.candidates is None:
        return None
    rows = [(0, i, c.parameter, c.value_min, c.value_max, c.unit) for i, c in enumerate(asked)]
    wanted = spark.createDataFrame(rows, "question_id int, condition_id int, parameter string, value_min double, value_max double, unit string")
    led = claims.select(F.lit(0).alias("question_id"), "claim_id") if claims is not None else None
    met = conditions.conditions_met(base.candidates, wanted, led, base.hidden())
    sourced = fact_op.in_years(met.where("document_id is not null"), base.documents, question.year_min, question.year_max)
    return written(sourced.unionByName(met.where("document_id is null").select(sourced.columns)))


def collect_full(
    spark: SparkSession,
    base: Base,
    text: str,
    question: Question | None,
    vector: list[float] | None = None,
    confidence_min: float = 0.0,
    hypotheses: bool = False,
    materials: tuple[str, ...] = (),
    properties: tuple[str, ...] = (),
    labs: tuple[str, ...] = (),
    k: int = 10,
    most_texts: int = 50,
) -> answer.Evidence:
    """Facts that the graph leads to and those that pass the filters, of the question's years, ranked; numbers that meet its conditions; nearest fragments of its years.

    question: the plan, or None if there is none: then only fragments are found. Where neither facts nor numbers are found, facts of one of its names stand in as related, with a hypothesis each.
    Facts are tables of any size, ranked without a global order; texts are a page's worth (`most_texts`). Equal scores are told apart by id.
    """
    hits = _hits(base, text, vector, k)
    visible = base.visible()
    empty = visible.limit(0).withColumn("rank", F.lit(0).cast("long"))
    if question is None:
        return answer.Evidence(empty, empty, hits, [], [r.gap for r in fact_op.gaps(empty).collect()])
    years = (question.year_min, question.year_max)
    claims = traversed(spark, base, question)
    claims = written(claims) if claims is not None else None
    pools = [fact_op.filtered(visible, confidence_min, hypotheses, question.material, question.property, materials, properties, labs, base.synonyms)]
    if claims is not None:
        # Claims come first: hidden documents are then looked for among their facts alone.
        led = base.facts.join(claims.select(F.col("claim_id").alias("id")), "id", "left_semi").select(base.facts.columns)
        pools.insert(0, fact_op.visible(led, base.hidden()).select(visible.columns))
    merged = written(_ranked(fact_op.ranked(fact_op.unique_facts(*pools).drop("list_no"), question.material, question.property, question.process, base.synonyms)))
    facts = fact_op.in_years(merged, base.documents, *years)
    dropped = 0
    if years != (None, None):
        facts = written(facts.select(merged.columns))
        dropped = merged.count() - facts.count()
        hits = fact_op.in_years(hits, base.documents, *years).select(hits.columns)
    numeric = numeric_evidence(spark, base, question, claims)
    direct = not facts.isEmpty() or (numeric is not None and not numeric.isEmpty())
    related, said = empty, []
    if not direct:
        related, said = indirect(base, question)
        related = written(fact_op.in_years(related, base.documents, *years).select(empty.columns))
    gaps = [r.gap for r in fact_op.gaps(facts, question.target.parameter if question.target else None, numeric).collect()]
    if dropped:
        gaps.append(f"По заданному сроку издания отброшено фактов: {dropped} (включая источники, у которых год не определён).")
    return answer.Evidence(facts, related, hits, contradiction_texts(facts, most_texts, base.synonyms), gaps, said)


def pack(evidence: answer.Evidence, n_facts: int = 15, n_hits: int = 10) -> dict:
    """What a model is shown: the first facts and hits, numbered through as `citations.number_evidence` numbers them, and the texts. n_facts + n_hits rows at most."""
    first = lambda df, n: [r.asDict(True) for r in df.orderBy("rank", "fragment_id").limit(n).collect()]
    facts, hits = first(evidence.facts, n_facts), first(evidence.hits, n_hits)
    return {"facts": [{"n": i, **r} for i, r in enumerate(facts, 1)], "search_hits": [{"n": i, **r} for i, r in enumerate(hits, 1 + len(facts))], "contradictions": evidence.contradictions, "gaps": evidence.gaps}


def ask(
    spark: SparkSession,
    base: Base,
    text: str,
    model: Callable[[str, dict], dict],
    planner: Callable[[str], dict] | None = None,
    embed: Callable[[str], list[float]] | None = None,
    fast: bool = True,
    now: int = 2100,
    **filters,
) -> tuple[answer.Answer, list[str]]:
    """The answer to a question, and what failed on the way. The fast way first, if it is asked for and finds something; else the full one.

    A planner, an embedder or a model that raises is named among the errors, and the answer is made of what is there without it.
    """
    errors: list[str] = []

    def tried(call, *args):
        try:
            return call(*args) if call else None
        except Exception as e:
            errors.append(f"{type(e).__name__}: {e}")

    vector = tried(embed, text)
    evidence = collect_fast(base, text, vector) if fast else None
    if evidence is None:
        plan = tried(planner, text)
        evidence = collect_full(spark, base, text, parse(text, plan, now) if plan is not None else None, vector, **filters)
    reply = tried(model, text, pack(evidence)) or {}
    return answer.finalize(spark, evidence, reply, base.fragments, base.documents, base.visible()), errors

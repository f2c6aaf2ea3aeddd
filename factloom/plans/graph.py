"""Queries over the knowledge graph and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import graph as op
from ..shared import written


def _facts(spark, d, *columns):
    """Facts with some of their columns, written: the branches of a graph read them instead of joining the tables each."""
    return written(views.facts(spark, d).select("id", *columns))


def _answer_facts(spark, d):
    return _facts(spark, d, "document_id", "material", "process", "property", "effect_direction")


def graph_nodes(spark, d):
    nodes, _ = op.answer_graph(_answer_facts(spark, d))
    return nodes.groupBy("type", "id").agg(F.min("label").alias("label"))


def graph_edges(spark, d):
    return op.answer_graph(_answer_facts(spark, d))[1].groupBy("source", "label").agg(F.count("*").alias("targets"))


_STORED = ("experiment_id", "fragment_id", "material", "property", "effect_direction", "lab")


def graph_projection(spark, d):
    nodes, edges = op.fact_projection(_facts(spark, d, *_STORED))
    return nodes.groupBy("label").agg(F.count("*").alias("n")).unionByName(edges.groupBy("label").agg(F.count("*").alias("n")))


def _cut_graph(spark, d):
    """The stored graph after the claims of one return flag are deleted: experiments and laboratories may be left alone."""
    facts = _facts(spark, d, *_STORED, "confidence")
    gone = F.coalesce(F.expr("effect_direction <> 'increase' or confidence < 0.99"), F.lit(False))
    # A claim goes with any of its facts.
    claims = facts.where(~gone).join(facts.where(gone).select("id"), "id", "left_anti")
    return op.fact_projection(facts, claims, distinct=False)


def graph_orphans(spark, d):
    nodes, edges = _cut_graph(spark, d)
    return op.orphans(nodes.select("id", "label"), edges)


def graph_reach(spark, d):
    _, edges = op.fact_projection(views.facts(spark, d), distinct=False)
    start = views.facts(spark, d).where("confidence = 1.0 and temperature_c = 50").select("id")
    return op.reachable(edges, start, 2).groupBy("hop").agg(F.count("*").alias("n"))


def entity_neighbors(spark, d):
    return op.entity_neighbours(op.entity_mentions(views.facts(spark, d)), ["MINT", "promo"], 40)


def region_claims(spark, d):
    """Pages whose text names a place, taken for regions by their language: a question for one of them."""
    regions = {"home": ("example.net",), "France": ("fr/",), "Germany": ("de/",), "Spain": ("es/",)}
    pages = views.table(spark, d, "pages").select(F.col("page_id").alias("id"), op.regions_in(F.col("url"), regions).alias("regions"))
    return op.region_claims(pages, "abroad", None, regions)


QUERIES = {f.__name__: f for f in (graph_nodes, graph_edges, graph_projection, graph_orphans, graph_reach, entity_neighbors, region_claims)}

_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
_EDGES = f"""edges as (
  select distinct id as source, 'material-' || {_SLUG.format("material")} as target, 'ABOUT' as label from facts_v
  union select id, experiment_id, 'BASED_ON' from facts_v union select experiment_id, 'property-' || {_SLUG.format("property")}, 'MEASURED' from facts_v
  union select id, 'effect-' || id, 'HAS_EFFECT' from facts_v union select experiment_id, 'lab-' || {_SLUG.format("lab")}, 'PERFORMED_AT' from facts_v
  union select id, fragment_id, 'SUPPORTED_BY' from facts_v)"""

ORACLE_SQL = {
    "graph_nodes": f"""with {views.SQL} select 'Claim' as type, id, min(property || case effect_direction when 'increase' then ': рост' when 'decrease' then ': снижение' else ': без изменений' end) as label from facts_v group by id
        union all select distinct 'Document', 'document-' || document_id, document_id from facts_v
        union all select distinct 'Material', 'material-' || {_SLUG.format("material")}, material from facts_v
        union all select distinct 'Process', 'process-' || {_SLUG.format("process")}, process from facts_v""",
    "graph_edges": f"""with {views.SQL}, e as (select distinct 'material-' || {_SLUG.format("material")} as source, id as target, 'ABOUT' as label from facts_v
        union select 'process-' || {_SLUG.format("process")}, id, 'USED_IN' from facts_v union select id, 'document-' || document_id, 'CITES' from facts_v)
        select source, label, count(*) as targets from e group by all""",
    "graph_projection": f"""with {views.SQL}, {_EDGES}, n as (
        select 'Material' as label, material as id from facts_v union select 'Experiment', experiment_id from facts_v union select 'Property', property from facts_v union select 'Effect', id from facts_v
        union select 'Laboratory', lab from facts_v union select 'SourceFragment', fragment_id from facts_v union select 'Claim', id from facts_v)
        select label, count(*) as n from n group by label union all select label, count(*) from edges group by label""",
    "graph_orphans": f"""with {views.SQL}, {_EDGES}, gone as (select id from facts_v where effect_direction <> 'increase' or confidence < 0.99),
        kept as (select source, target from edges where source not in (select id from gone) and target not in (select id from gone)),
        nodes as (select 'material-' || {_SLUG.format("material")} as id, 'Material' as label from facts_v union select experiment_id, 'Experiment' from facts_v
          union select 'property-' || {_SLUG.format("property")}, 'Property' from facts_v union select 'effect-' || id, 'Effect' from facts_v union select 'lab-' || {_SLUG.format("lab")}, 'Laboratory' from facts_v),
        h1 as (select distinct target as id from kept where source in (select id from facts_v)),
        h2 as (select distinct target as id from kept where source in (select id from h1)),
        reached as (select id from h1 union select id from h2)
        select id, label from nodes where id not in (select id from reached)""",
    "graph_reach": f"""with {views.SQL}, {_EDGES}, h0 as (select distinct id from facts_v where confidence = 1.0 and temperature_c = 50),
        h1 as (select distinct target as id from edges where source in (select id from h0) and target not in (select id from h0)),
        h2 as (select distinct target as id from edges where source in (select id from h1) and target not in (select id from h0) and target not in (select id from h1))
        select 0 as hop, count(*) as n from h0 union all select 1, count(*) from h1 union all select 2, count(*) from h2""",
    "entity_neighbors": f"""with {views.SQL} select distinct id as claim_id from facts_v where contains(lower(material), 'mint') or contains(lower(process), 'mint')
        or contains(lower(material), 'promo') or contains(lower(process), 'promo') order by 1 limit 40""",
    "region_claims": r"select page_id as claim_id from pages where regexp_matches(lower(url), '\b(fr/|de/|es/)')",
}

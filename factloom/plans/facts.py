"""Queries over facts and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import facts as op



def _hidden(spark, d):
    return views.documents(spark, d).where("hidden").select("document_id")


def visible_facts(spark, d):
    return op.visible(views.facts(spark, d), _hidden(spark, d)).select("id", "document_id", "material", "confidence")


def facts_filtered_ranked(spark, d):
    """Visible facts of a period, without hypotheses, of good confidence, ranked for a question: the first 20."""
    facts = op.filtered(op.visible(views.facts(spark, d), _hidden(spark, d)), confidence_min=0.93)
    facts = op.in_years(facts, views.documents(spark, d), 1996, 1999)
    ranked = op.ranked(facts, property="Brand#13", process="PROMO")
    return ranked.orderBy(F.round("rank_score", 6).desc(), "id").limit(20).select("id", "document_id", "material", "property", F.round("rank_score", 6).alias("rank_score"))


def fact_sources_dedup(spark, d):
    # The first of each carries all columns it is given through the sort and the shuffle.
    return op.sources(views.facts(spark, d).select("document_id", "fragment_id", "id"), F.col("id"))


def answer_confidence(spark, d):
    return op.mean_confidence(op.filtered(views.facts(spark, d), property="Brand#13"))


def evidence_status(spark, d):
    facts = views.facts(spark, d)
    direct = F.count_if((F.col("confidence") >= 0.97) & ~F.col("is_hypothesis"))
    counts = facts.groupBy("property").agg(direct.alias("direct"), F.count("*").alias("related"))
    return counts.select("property", op.evidence_status(F.col("direct"), F.col("related")).alias("status"))


def doc_fact_counts(spark, d):
    return op.document_counts(views.documents(spark, d), views.facts(spark, d))


def scientific_share(spark, d):
    return op.scientific_share(op.filtered(views.facts(spark, d), property="Brand#13"), views.documents(spark, d))


def about(spark, d, hypotheses=True):
    """The facts that a question about one property is answered from."""
    return op.filtered(views.facts(spark, d), hypotheses=hypotheses, property="Brand#13")


def find_gaps(spark, d):
    """What the evidence for a question lacks that names a target no number supports; then what one without facts lacks."""
    none = op.filtered(views.facts(spark, d), property="Brand#99")
    return op.gaps(about(spark, d), "выход по току").unionByName(op.gaps(none))


def topic_gaps(spark, d):
    """Documents whose results with a process come from fewer than two laboratories."""
    topics = views.facts(spark, d).groupBy("document_id", "process").agg(F.count("*").alias("facts"), F.min("lab").alias("a"), F.max("lab").alias("b"))
    return topics.where("a = b").select("document_id", "process", "facts")


def indirect_search(spark, d):
    return op.loose_search(views.facts(spark, d), ["PROMO", "almond", "ECONOMY", "nothing like it"])


def word_match_facts(spark, d):
    """The 30 most confident facts that share a word key with a question."""
    return op.word_matches(views.facts(spark, d), ["promotional", "antiques", "mint"]).select("id", "material", "process", "confidence")


def mark_conflicts(spark, d):
    return op.mark_conflicts(views.facts(spark, d)).select("id", "status")


def conflict_groups(spark, d):
    return op.conflict_groups(views.facts(spark, d))


def conflict_links(spark, d):
    """Every fact with opposites: its class, their number and the first of them."""
    return op.conflict_members(views.facts(spark, d))


def find_contradictions(spark, d):
    return op.contradictions(views.facts(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        visible_facts, facts_filtered_ranked, fact_sources_dedup, answer_confidence, evidence_status, doc_fact_counts, scientific_share, find_gaps, topic_gaps,
        indirect_search, word_match_facts, mark_conflicts, conflict_groups, conflict_links, find_contradictions,
    )
}

ORACLE_SQL = {
    "visible_facts": f"with {views.SQL} select id, document_id, material, confidence from facts_v where document_id not in (select document_id from docs_v where hidden)",
    "facts_filtered_ranked": f"""with {views.SQL} select f.id, f.document_id, f.material, f.property,
        round(f.confidence + case when lower(trim(f.property)) = 'brand#13' then 0.25 else 0 end + case when contains(lower(f.process), 'promo') then 0.2 else 0 end, 6) as rank_score
        from facts_v f join docs_v d using (document_id)
        where not d.hidden and f.confidence >= 0.93 and not f.is_hypothesis and d.year between 1996 and 1999 order by rank_score desc, id limit 20""",
    "fact_sources_dedup": f"with {views.SQL} select document_id, fragment_id, min(id) as id from facts_v group by all",
    "answer_confidence": f"with {views.SQL} select coalesce(round(avg(confidence), 3), 0.0) as confidence from facts_v where property = 'Brand#13' and not is_hypothesis",
    "evidence_status": f"""with {views.SQL} select property, case when count(*) filter (where confidence >= 0.97 and not is_hypothesis) > 0 then 'direct'
        when count(*) > 0 then 'partial' else 'none' end as status from facts_v group by property""",
    "doc_fact_counts": f"""with {views.SQL} select d.document_id, count(f.id) as facts, count(distinct f.experiment_id) as experiments
        from docs_v d left join facts_v f using (document_id) group by d.document_id""",
    "scientific_share": f"""with {views.SQL} select round(avg(coalesce(cast(is_scientific as int), 0)), 2) as scientific_share
        from facts_v left join docs_v using (document_id) where property = 'Brand#13' and not is_hypothesis""",
    "find_gaps": f"""with {views.SQL}, c as (select count(*) as n, count(distinct lab) as labs from facts_v where property = 'Brand#13')
        select 'Нет подтверждённых фактов для заданной комбинации условий.' as gap
        union all select 'Результаты подтверждены менее чем двумя независимыми источниками.' from c where n > 0 and labs < 2
        union all select 'Нет данных, напрямую подтверждающих целевой показатель «выход по току».' from c where n > 0""",
    "topic_gaps": f"with {views.SQL} select document_id, process, count(*) as facts from facts_v group by all having count(distinct lab) < 2",
    "indirect_search": f"""with {views.SQL} select term, count(*) as facts from facts_v, (values ('PROMO'), ('almond'), ('ECONOMY'), ('nothing like it')) t(term)
        where contains(lower(material), lower(term)) or contains(lower(process), lower(term)) group by term""",
    "word_match_facts": f"""with {views.SQL} select id, material, process, confidence from facts_v
        where len(list_filter(regexp_extract_all(lower(concat_ws(' ', material, process, property)), '[a-zа-я0-9]+'),
          lambda w: (length(w) <= 4 and w = 'mint') or (length(w) > 4 and substr(w, 1, 5) in ('promo', 'antiq')))) > 0
        order by confidence desc, id limit 30""",
    "mark_conflicts": f"""with {views.SQL}, g as (select material, property from facts_v group by all having count(*) filter (where effect_direction = 'increase') > 0
        and count(*) filter (where effect_direction = 'decrease') > 0)
        select id, case when effect_direction <> 'neutral' and (material, property) in (select (material, property) from g) then 'conflicting' else 'approved' end as status from facts_v""",
    "conflict_groups": f"""with {views.SQL} select lower(material) as material_key, lower(property) as property_key, count(*) filter (where effect_direction = 'increase') as ups,
        count(*) filter (where effect_direction = 'decrease') as downs from facts_v group by 1, 2 having ups > 0 and downs > 0""",
    "conflict_links": f"""with {views.SQL}, f as (select id, lower(material) as material_key, lower(property) as property_key, effect_direction as direction from facts_v where effect_direction <> 'neutral'),
        g as (select material_key, property_key, direction, count(distinct id) as opposites, min(id) as first_opposite from f group by 1, 2, 3)
        select f.id, material_key, property_key, f.direction, g.opposites, g.first_opposite from f join g using (material_key, property_key) where f.direction <> g.direction""",
    "find_contradictions": f"""with {views.SQL}, f as (select * from facts_v)
        select distinct lower(a.material) as material_key, lower(a.property) as property_key, case when a.lab = b.lab then a.lab else least(a.lab, b.lab) || ', ' || greatest(a.lab, b.lab) end as labs
        from f a join f b on a.material = b.material and a.property = b.property
        where a.effect_direction = 'increase' and b.effect_direction = 'decrease' and a.process = b.process and abs(a.temperature_c - b.temperature_c) <= 5""",
}

"""Queries over tables in time and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import facts as fact_op
from ..operators import jobstates
from ..operators import lifecycle as op
from ..shared import written


def job_latest_status(spark, d):
    return op.latest_status(views.jobs(spark, d)).select("job_id", "status", "n_events")


def pending_jobs(spark, d):
    return op.latest_status(views.jobs(spark, d)).agg(F.count_if(F.col("status").isin("queued", "processing")).alias("pending"))


def job_states(spark, d):
    """The state of every job at the time of the last event, those given up that have not ended and were not heard of for three days; and what its events do wrong."""
    events = views.jobs(spark, d)
    found = jobstates.job_states(events, events.agg(F.max("ts")).scalar(), 3 * 86400)
    return found.select("job_id", "status", "since_us", F.array_join("issues", ",").alias("issues"))


def checksum_dedup(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    return op.by_checksum(docs, "text", F.col("doc_id")).select("doc_id", "checksum", "n_copies")


def upsert_documents(spark, d):
    """Documents of 1998 on reclassified, and two that are new."""
    docs = views.documents(spark, d)
    changed = docs.where("year >= 1998").select("document_id", F.lit("report").alias("doc_type"), F.lit(2000).alias("year"))
    new = spark.createDataFrame([("doc-new-1", "note", 2001), ("doc-new-2", "note", 2002)], "document_id string, doc_type string, year int")
    return op.upsert(docs.select("document_id", "doc_type", "year", "hidden"), changed.unionByName(new), "document_id", keep=("year",))


def cascade_delete(spark, d):
    gone = views.documents(spark, d).where("hidden").select("document_id")
    left = op.cascade_delete(gone, documents=views.documents(spark, d), facts=views.facts(spark, d))
    return left["documents"].select(F.lit("documents").alias("table_name"), "document_id").unionByName(left["facts"].select(F.lit("facts").alias("table_name"), "document_id")).groupBy("table_name").agg(F.count("*").alias("n"))


def retract_document(spark, d):
    """The status of every fact that stays when the hidden documents are deleted, and how many opposites it keeps."""
    facts = views.facts(spark, d).select("id", "document_id", "material", "property", "effect_direction")
    left = op.cascade_delete(views.documents(spark, d).where("hidden").select("document_id"), facts=facts)["facts"]
    return fact_op.conflict_counts(written(left)).select("id", F.when(F.col("links") > 0, "conflicting").otherwise("approved").alias("status"), "links")


def missing_vectors(spark, d):
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("key"))
    return op.missing(docs, views.table(spark, d, "embeddings").select(F.col("vec_id").alias("key")), "key")


def label_agg(spark, d):
    return views.table(spark, d, "labels").groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"))


def review_queue(spark, d):
    """Facts that need a look: hypotheses of low confidence, the least confident first."""
    queue = views.facts(spark, d).where("is_hypothesis and confidence < 0.92")
    return queue.orderBy("confidence", "id").limit(50).select("id", "confidence")


QUERIES = {f.__name__: f for f in (job_latest_status, pending_jobs, job_states, checksum_dedup, upsert_documents, cascade_delete, retract_document, missing_vectors, label_agg, review_queue)}

ORACLE_SQL = {
    "job_latest_status": f"with {views.SQL} select job_id, arg_max(status, (ts, event_id)) as status, count(*) as n_events from jobs_v group by job_id",
    "pending_jobs": f"with {views.SQL}, l as (select job_id, arg_max(status, (ts, event_id)) as status from jobs_v group by job_id) select count(*) filter (where status in ('queued', 'processing')) as pending from l",
    "job_states": f"""with {views.SQL}, e as (select job_id, epoch_us(ts) as us, event_id as id, status from jobs_v),
        ended as (select job_id, min((us, id)) as fin, arg_min(status, (us, id)) as status from e where status in ('completed', 'failed') group by job_id),
        j as (select e.job_id, any_value(n.fin) as fin, any_value(n.status) as final, min(us) filter (where e.status = 'queued') as queued, min(us) filter (where e.status = 'processing') as working, max(us) as last, arg_min(e.status, (us, id)) as first,
          bool_or(e.status = 'processing' and (us, id) < n.fin) as processed, bool_or(e.status <> n.status and (us, id) > n.fin) as more from e left join ended n using (job_id) group by e.job_id),
        k as (select *, final is null and (select max(us) from e) - last > 3 * 86400000000 as stuck from j)
        select job_id, case when stuck then 'failed' else coalesce(final, case when working is not null then 'processing' else 'queued' end) end as status, coalesce(fin[1], working, queued) as since_us,
          concat_ws(',', case when first <> 'queued' then 'not_queued' end, case when final is not null and not processed then 'not_processed' end, case when final is not null and more then 'after_end' end, case when stuck then 'timed_out' end) as issues from k""",
    "checksum_dedup": "select min(doc_id) as doc_id, sha256(text) as checksum, count(*) as n_copies from documents group by sha256(text)",
    "upsert_documents": f"""with {views.SQL} select document_id, case when year >= 1998 then 'report' else doc_type end as doc_type, year, hidden from docs_v
        union all select * from (values ('doc-new-1', 'note', 2001, cast(null as boolean)), ('doc-new-2', 'note', 2002, null))""",
    "cascade_delete": f"""with {views.SQL} select 'documents' as table_name, count(*) as n from docs_v where not hidden
        union all select 'facts', count(*) from facts_v where document_id not in (select document_id from docs_v where hidden)""",
    "retract_document": f"""with {views.SQL}, f as (select facts_v.* from facts_v join docs_v using (document_id) where not hidden),
        g as (select material, property, effect_direction, count(distinct id) as n from f where effect_direction <> 'neutral' group by all),
        l as (select f.id, coalesce(max(g.n), 0) as links from f left join g on f.material = g.material and f.property = g.property and f.effect_direction <> 'neutral' and f.effect_direction <> g.effect_direction group by f.id)
        select id, case when links > 0 then 'conflicting' else 'approved' end as status, links from l""",
    "missing_vectors": "select doc_id as key from documents where doc_id not in (select vec_id from embeddings)",
    "label_agg": "select toxic, count(*) as n, count(*) filter (where quality = 1) as good from labels group by toxic",
    "review_queue": f"with {views.SQL} select id, confidence from facts_v where is_hypothesis and confidence < 0.92 order by confidence, id limit 50",
}

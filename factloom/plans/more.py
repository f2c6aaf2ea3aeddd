"""Queries over titles, rows, tables in tables, time windows and table upkeep, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import answer, facts, graph, lifecycle, windows
from ..sources import traits


def claim_titles(spark, d):
    return graph.claim_title(views.facts(spark, d)).groupBy("title").agg(F.count("*").alias("n"))


def fact_phrases(spark, d):
    rows = views.facts(spark, d).withColumns({"effect_value": F.col("temperature_c"), "effect_unit": F.lit("%")})
    return facts.phrase(rows).groupBy("phrase").agg(F.count("*").alias("n"))


def experiment_rows(spark, d):
    rows = views.facts(spark, d).withColumns({"effect_value": F.col("temperature_c"), "effect_unit": F.lit("%")})
    return answer.experiment_rows(rows, F.col("confidence").desc()).select("id", "experiment_id", "effect")


def document_list(spark, d):
    docs = views.documents(spark, d).withColumn("filename", F.concat(F.lit("Отчёт "), "document_id"))
    return answer.document_list(docs, scientific=True, types=("1-URGENT",), title="отчет").limit(30).select("document_id", "year")


def recent_questions(spark, d):
    asked = views.table(spark, d, "events").select("user_id", F.col("event_type").alias("question"), "ts")
    return answer.recent_questions(asked, 3).select("user_id", "question", F.col("n").cast("long").alias("n"))


def table_windows(spark, d):
    """Orders as tables of their lines: those without a digit or with little text would be layout."""
    rows = views.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_suppkey").alias("s"))
    text = F.when(F.col("l_orderkey") % 2 == 0, F.col("flag")).otherwise(F.concat_ws(" ", "flag", F.col("s").cast("string")))
    found = windows.table_windows(rows.select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("table"), F.col("l_linenumber").alias("row"), text.alias("text")), 6)
    return found.select("document_id", F.col("n").cast("long").alias("n"), "text")


def title_pages(spark, d):
    """Orders as documents, lines as pages."""
    rows = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), F.row_number().over(_lines()).alias("ordinal"), F.col("l_partkey").cast("string").alias("text"))
    return traits.title_pages(rows, 8, 4)


def _lines():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def status_by_day(spark, d):
    jobs = views.jobs(spark, d)
    return jobs.groupBy(F.window("ts", "1 day").alias("w"), "status").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "status", "n")


def repeated_keys(spark, d):
    return lifecycle.duplicates(views.facts(spark, d).select("fragment_id"), "fragment_id")


def evolved_documents(spark, d):
    """A column that older rows lack."""
    old = views.documents(spark, d).where("year < 1998").select("document_id", "year")
    new = views.documents(spark, d).where("year >= 1998").select("document_id", "doc_type")
    return lifecycle.evolved(old, new).groupBy("year", "doc_type").agg(F.count("*").alias("n"))


def orphaned_fragments(spark, d):
    """Fragments of the lines that no question word names: documents without a question of the same number."""
    return lifecycle.missing(views.fragments(spark, d).select(F.col("doc_id").alias("key")).distinct(), views.questions(spark, d).select(F.col("conv_id").alias("key")), "key")


QUERIES = {f.__name__: f for f in (claim_titles, fact_phrases, experiment_rows, document_list, recent_questions, table_windows, title_pages, status_by_day, repeated_keys, evolved_documents, orphaned_fragments)}

_WAY = "case effect_direction when 'increase' then 'рост' when 'decrease' then 'снижение' else 'без изменений' end"
ORACLE_SQL = {
    "claim_titles": f"with {views.SQL} select material || ', ' || process || ' — ' || property || ': ' || {_WAY} as title, count(*) as n from facts_v group by 1",
    "fact_phrases": f"with {views.SQL} select material || ', ' || property || ': ' || {_WAY} || ' на ' || cast(cast(temperature_c as int) as varchar) || ' %' as phrase, count(*) as n from facts_v group by 1",
    "experiment_rows": f"with {views.SQL} select id, experiment_id, {_WAY} || ' на ' || cast(cast(temperature_c as int) as varchar) || '%' as effect from facts_v order by confidence desc, id limit 20",
    "document_list": f"with {views.SQL} select document_id, year from docs_v where is_scientific and doc_type = '1-URGENT' order by year desc, document_id limit 30",
    "recent_questions": """with l as (select user_id, event_type as question, max(ts) as ts from events group by all)
        select user_id, question, n from (select *, row_number() over (partition by user_id order by ts desc, question) as n from l) where n <= 3""",
    "table_windows": """with r as (select l_orderkey, l_linenumber, min(l_returnflag) as flag, min(l_suppkey) as s from lineitem group by all),
        t as (select l_orderkey as document_id, count(*) as n, string_agg(case when l_orderkey % 2 = 0 then flag else flag || ' ' || s end, ' ' order by l_linenumber) as text from r group by l_orderkey)
        select document_id, n, text from t where regexp_matches(text, '[0-9]') or length(text) >= 6""",
    "title_pages": """with l as (select l_orderkey as document_id, l_linenumber as page, cast(l_partkey as varchar) as text, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as o from lineitem),
        p as (select *, dense_rank() over (partition by document_id order by page) as k, max(page) over (partition by document_id) as last_page from l)
        select document_id, substr(string_agg(text, ' ' order by o) filter (where k <= 2), 1, 8) as head, substr(string_agg(text, ' ' order by o) filter (where page = last_page), 1, 4) as tail from p group by document_id""",
    "status_by_day": f"with {views.SQL} select strftime(ts, '%Y-%m-%d') as day, status, count(*) as n from jobs_v group by all",
    "repeated_keys": f"with {views.SQL} select fragment_id, count(*) as n from facts_v group by fragment_id having count(*) > 1",
    "evolved_documents": f"with {views.SQL} select case when year < 1998 then year end as year, case when year >= 1998 then doc_type end as doc_type, count(*) as n from docs_v group by 1, 2",
    "orphaned_fragments": "select doc_id as key from documents where doc_id not in (select conv_id from conversations where role = 'user')",
}

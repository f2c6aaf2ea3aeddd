"""The shared tables in the shape of the domain: documents, facts, vectors, pages, questions, jobs and line fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: document_id, year, is_scientific (null: not evaluated), hidden, doc_type."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string")).alias("document_id"),
        F.year("o_orderdate").alias("year"),
        F.when(status == "F", True).when(status == "O", False).alias("is_scientific"),
        (F.col("o_orderpriority") == "5-LOW").alias("hidden"),
        F.col("o_orderpriority").alias("doc_type"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts."""
    text = lambda c: F.col(c).cast("string")
    lines, parts, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.select(
        F.concat_ws("-", F.lit("claim"), text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"), F.col("l_quantity").cast("int").cast("string")).alias("id"),
        F.concat(F.lit("doc-"), text("l_orderkey")).alias("document_id"),
        F.concat_ws("-", F.lit("fragment"), text("l_orderkey"), text("l_linenumber")).alias("fragment_id"),
        F.concat(F.lit("exp-"), text("l_partkey")).alias("experiment_id"),
        F.col("p_name").alias("material"),
        F.col("p_type").alias("process"),
        F.col("p_brand").alias("property"),
        F.col("s_name").alias("lab"),
        F.col("l_quantity").alias("temperature_c"),
        F.when(F.col("l_returnflag") == "A", "increase").when(F.col("l_returnflag") == "R", "decrease").otherwise("neutral").alias("effect_direction"),
        F.round(1.0 - F.col("l_discount"), 2).alias("confidence"),
        ((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.06)).alias("is_hypothesis"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "error", "failed").otherwise("completed")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), "ts", "event_id", status.alias("status"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: doc_id, ordinal from 1, line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("ordinal"), "line")


#: The same views for DuckDB, to put in front of a query.
SQL = """
docs_v as (select concat('doc-', cast(o_orderkey as varchar)) as document_id, cast(year(o_orderdate) as int) as year,
  case o_orderstatus when 'F' then true when 'O' then false end as is_scientific, o_orderpriority = '5-LOW' as hidden, o_orderpriority as doc_type from orders),
facts_v as (select concat('claim-', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar), '-', cast(l_partkey as varchar), '-', cast(l_suppkey as varchar), '-', cast(cast(l_quantity as int) as varchar)) as id,
  concat('doc-', cast(l_orderkey as varchar)) as document_id, concat('fragment-', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as fragment_id,
  concat('exp-', cast(l_partkey as varchar)) as experiment_id, p_name as material, p_type as process, p_brand as property, s_name as lab, l_quantity as temperature_c,
  case l_returnflag when 'A' then 'increase' when 'R' then 'decrease' else 'neutral' end as effect_direction, round(1.0 - l_discount, 2) as confidence,
  l_linestatus = 'F' and l_tax > 0.06 as is_hypothesis
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey),
frags_v as (select doc_id, unnest(generate_series(1, len(p))) as ordinal, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents)),
q_v as (select conv_id, turn, text as question from conversations where role = 'user'),
jobs_v as (select concat('job-', cast(user_id as varchar)) as job_id, ts, event_id,
  case event_type when 'view' then 'queued' when 'click' then 'processing' when 'error' then 'failed' else 'completed' end as status from events)
"""

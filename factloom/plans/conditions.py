"""Queries over numeric conditions and parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import conditions as op


def _candidates(spark, d):
    """Line items as candidates: a quantity of minutes under the part's name or its last word, and a size without a unit under its brand."""
    lines, parts = views.table(spark, d, "lineitem"), views.table(spark, d, "part")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey)
    none = F.lit(None).cast("double")
    name = F.when(F.col("l_linenumber") % 2 == 1, F.col("p_name")).otherwise(F.element_at(F.split("p_name", " "), -1))
    quantity = F.struct(name.alias("name"), none.alias("value"), F.col("l_quantity").cast("double").alias("value_min"), (F.col("l_quantity") + F.col("l_linenumber")).cast("double").alias("value_max"), F.lit("мин").alias("unit"))
    size = F.struct(F.col("p_brand").alias("name"), F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).alias("value"), none.alias("value_min"), none.alias("value_max"), F.lit(None).cast("string").alias("unit"))
    id_ = F.concat_ws("-", F.lit("candidate"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return rows.select(id_.alias("candidate_id"), F.when(F.col("l_linestatus") == "F", "approved").otherwise("pending").alias("status"), F.concat(F.lit("doc-"), F.col("l_orderkey").cast("string")).alias("document_id"), F.array(quantity, size).alias("parameters"))


def _conditions(spark, d):
    """Each nation asks for a time under the last word of part names (in hours, with one end or two), and for a size under the name of a brand."""
    key, parts = F.col("n_nationkey"), views.table(spark, d, "part")
    words = parts.select(F.element_at(F.split("p_name", " "), -1).alias("word")).distinct()
    nations = views.table(spark, d, "nation").select("n_name", "n_nationkey")
    asking = nations.join(words, F.pmod(F.crc32("word"), F.lit(5)) == key % 5)
    time = asking.select(F.col("n_name").alias("question_id"), F.concat(F.lit("time-"), "word").alias("condition_id"), F.when(key % 3 == 0, F.concat("word", F.lit(" content"))).otherwise(F.col("word")).alias("parameter"),
        F.when(key % 4 != 1, key * 0.031 + 0.0101).alias("value_min"), F.when(key % 4 != 2, key * 0.031 + 0.1303).alias("value_max"), F.lit("ч").alias("unit"))
    boxes = parts.select("p_brand").distinct()
    size = nations.join(boxes, F.pmod(F.crc32("p_brand"), F.lit(25)) == key).select(F.col("n_name").alias("question_id"), F.concat(F.lit("size-"), "p_brand").alias("condition_id"), F.col("p_brand").alias("parameter"),
        (key + 4.5).alias("value_min"), (key + 7.5).alias("value_max"), F.lit(None).cast("string").alias("unit"))
    return time.unionByName(size)


def condition_matches(spark, d):
    """Candidates that can meet each nation's conditions; the first nations were led to claims of their own suppliers."""
    lines, suppliers = views.table(spark, d, "lineitem"), views.table(spark, d, "supplier")
    nations = views.table(spark, d, "nation").where("n_nationkey < 15")
    claim = F.concat_ws("-", F.lit("claim"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    led = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("question_id"), claim.alias("claim_id"))
    hidden = views.documents(spark, d).where("hidden").select("document_id")
    return op.conditions_met(_candidates(spark, d), _conditions(spark, d), led, hidden).select("question_id", "condition_id", "candidate_id", F.col("at").cast("int").alias("at"))


def _parameter_graph(spark, d):
    """Brands as parameters and part names as conditions of experiments; returned lines mention the brand."""
    lines, parts = views.table(spark, d, "lineitem"), views.table(spark, d, "part")
    claim = F.concat_ws("-", F.lit("claim"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    exp = F.concat(F.lit("exp-"), F.col("p_partkey").cast("string"))
    box, kind = F.concat(F.lit("parameter-"), "p_brand"), F.concat(F.lit("condition-"), "p_name")
    node = lambda rows, id_, label, name: rows.select(id_.alias("id"), F.lit(label).alias("label"), name.alias("name"))
    nodes = node(lines, claim, "Claim", claim).unionByName(node(parts, exp, "Experiment", exp))
    nodes = nodes.unionByName(node(parts, box, "NumericParameter", F.col("p_brand")).distinct()).unionByName(node(parts, kind, "Condition", F.col("p_name")).distinct())
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey)
    edge = lambda rows, a, b, label: rows.select(a.alias("source"), b.alias("target"), F.lit(label).alias("label"))
    edges = edge(rows.where("l_returnflag = 'R'"), claim, box, "MENTIONS").unionByName(edge(rows, claim, exp, "BASED_ON"))
    edges = edges.unionByName(edge(parts.where("p_size > 25"), exp, box, "measured_parameter")).unionByName(edge(parts, exp, kind, "operates_at_condition"))
    words = parts.select(F.explode(F.array(F.substring("p_brand", 1, 7), F.element_at(F.split("p_name", " "), 2))).alias("parameter")).distinct()
    return nodes, edges, words.select(F.lower("parameter").alias("question_id"), "parameter")


def parameter_claims(spark, d):
    return op.parameter_claims(*_parameter_graph(spark, d))


def template_claims(spark, d):
    """Claims of both branches and those of hypotheses on the named material: the union of two templates."""
    nodes, edges, asked = _parameter_graph(spark, d)
    facts = views.facts(spark, d).where("is_hypothesis").select(F.lower(F.element_at(F.split("material", " "), 2)).alias("question_id"), F.regexp_replace("id", "-[0-9]+$", "").alias("claim_id"))
    return op.template_claims(op.parameter_claims(nodes, edges, asked, distinct=False), facts)


QUERIES = {f.__name__: f for f in (condition_matches, parameter_claims, template_claims)}

_CLAIM = "concat_ws('-', '{0}', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar), cast(l_suppkey as varchar))"
_BRANCHES = f"""
rows_v as (select {_CLAIM.format("claim")} as claim, l_returnflag, p_partkey, p_brand, p_name, p_size from lineitem join part on p_partkey = l_partkey),
asked as (select distinct parameter from (select substr(p_brand, 1, 7) as parameter from part union select split_part(p_name, ' ', 2) from part)),
branches as (
  select distinct lower(parameter) as question_id, 'mention' as branch, claim as claim_id from rows_v join asked on contains(lower(p_brand), lower(parameter)) where l_returnflag = 'R'
  union select distinct lower(parameter), 'experiment', claim from rows_v join asked on contains(lower(p_brand), lower(parameter)) and p_size > 25 or contains(lower(p_name), lower(parameter)))"""
_CRC = """crc as (select list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by k) as t from (select unnest(range(256)) as k))"""
_CRC_OF = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: cast(ascii(c) as bigint))), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])))"
ORACLE_SQL = {
    "condition_matches": f"""with {views.SQL}, {_CRC},
words as (select word, {_CRC_OF.format("word")} as h from (select distinct split_part(p_name, ' ', -1) as word from part), crc),
boxes as (select p_brand, {_CRC_OF.format("p_brand")} as h from (select distinct p_brand from part), crc),
conds as (
  select n_name as question_id, 'time-' || word as condition_id, lower(case when n_nationkey % 3 = 0 then word || ' content' else word end) as parameter,
         case when n_nationkey % 4 <> 1 then n_nationkey * 0.031::double + 0.0101::double end as least, case when n_nationkey % 4 <> 2 then n_nationkey * 0.031::double + 0.1303::double end as most, true as hours
  from nation join words on h % 5 = n_nationkey % 5
  union all select n_name, 'size-' || p_brand, lower(p_brand), n_nationkey + 4.5::double, n_nationkey + 7.5::double, false from nation join boxes on h % 25 = n_nationkey),
cand as (
  select {_CLAIM.format("candidate")} as candidate_id, concat('doc-', cast(l_orderkey as varchar)) as document_id, s_nationkey, l_linestatus = 'F' as approved,
         lower(case when l_linenumber % 2 = 1 then p_name else split_part(p_name, ' ', -1) end) as name0, cast(l_quantity as double) as low0, cast(l_quantity + l_linenumber as double) as high0,
         lower(p_brand) as name1, case when p_size > 5 then cast(p_size as double) end as size
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey),
item as (
  select candidate_id, document_id, s_nationkey, 0 as "at", name0 as name, low0 as low, high0 as high, true as minutes from cand where approved
  union all select candidate_id, document_id, s_nationkey, 1, name1, size, size, false from cand where approved),
led as (select n_name, n_nationkey from nation where n_nationkey < 15 and n_nationkey in (select s_nationkey from cand))
select question_id, condition_id, candidate_id, "at"
from item join conds on (contains(name, parameter) or contains(parameter, name))
  and not coalesce(case when minutes and hours then high / 60 else high end < least, false) and not coalesce(case when minutes and hours then low / 60 else low end > most, false)
left join led on n_name = question_id
where (n_name is null or s_nationkey = n_nationkey) and document_id not in (select document_id from docs_v where hidden)""",
    "parameter_claims": f"with {_BRANCHES} select question_id, branch, claim_id from branches",
    "template_claims": f"""with {views.SQL}, {_BRANCHES}
select question_id, claim_id from branches union select lower(split_part(material, ' ', 2)), regexp_replace(id, '-[0-9]+$', '') from facts_v where is_hypothesis""",
}

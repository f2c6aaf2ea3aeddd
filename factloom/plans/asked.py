"""Queries over the gate between candidates and facts, over citations, and over questions with their evidence; and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import views
from ..operators import citations, collect, gate
from ..operators import facts as fact_op
from ..operators import graph as graph_op
from ..questions import Question
from ..shared import written


def _candidates(spark, d):
    """Line items as candidates, each with a fragment of its own that states its quantity, line and discount; even lines stand in a table, whose head has the units.

    Returned items' temperature is 3 higher than their fragment says, open items' quotations are changed, and those without tax have no source.
    """
    text = lambda c: F.col(c).cast("string")
    lines = views.table(spark, d, "lineitem")
    id_ = F.concat_ws("-", F.lit("candidate"), *map(text, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), *[F.round(F.col(c) * 100).cast("long").cast("string") for c in ("l_quantity", "l_discount", "l_tax")], "l_returnflag", "l_linestatus")
    whole = lambda c, by=1: F.round(F.col(c) * by).cast("int")
    rows = lines.select(
        id_.alias("id"), "l_returnflag", "l_linestatus", whole("l_quantity").alias("q"), whole("l_discount", 100).alias("p"), F.col("l_linenumber").alias("n"),
        (whole("l_tax", 100) == 0).alias("bare"), F.concat(F.lit("doc-"), text("l_orderkey")).alias("document_id"), F.concat(F.lit("Brand "), text("l_partkey")).alias("material"),
    ).distinct()
    in_table = F.col("n") % 2 == 0
    plain = F.concat_ws(" ", F.lit("held at"), text("q"), F.lit("°C for"), text("n"), F.lit("ч, changed by"), text("p"), F.lit("%"))
    stated = F.when(in_table, F.concat_ws(" | ", text("q"), text("n"), text("p"))).otherwise(plain)
    fragment = F.concat(F.lit("fragment-"), "id")
    fragments = rows.select(fragment.alias("fragment_id"), stated.alias("text"), F.when(in_table, F.lit("Temperature, °C | Time, ч | Effect, %")).alias("header"))
    payload = F.struct(
        "material", F.when(F.col("l_returnflag") == "N", "N/A").otherwise("strength").alias("property"), (F.col("q") + F.when(F.col("l_returnflag") == "R", 3).otherwise(0)).cast("double").alias("temperature_c"),
        F.col("n").cast("double").alias("duration_h"), F.col("p").cast("double").alias("effect_value"), F.lit("%").alias("effect_unit"), F.when(F.col("l_returnflag") == "A", "рост").otherwise("снижение").alias("effect_direction"),
        F.lit("").alias("process"), F.lit("lab").alias("lab"), F.array().cast("array<struct<name:string,value:double,value_min:double,value_max:double,unit:string,raw_text:string>>").alias("numeric_parameters"),
    )
    quote = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("«"), F.upper(stated), F.lit("»"))).otherwise(F.concat(stated, F.lit(" or so")))
    source = F.when(~F.col("bare"), F.struct("document_id", fragment.alias("fragment_id"), quote.alias("quote")))
    return rows.select("id", payload.alias("payload"), source.alias("source")), fragments


def gate_review(spark, d):
    """Every candidate's verdict: its status, confidence and issues."""
    judged = gate.judged(*_candidates(spark, d))
    issues = F.array_join(F.transform("review_issues", lambda i: F.concat(i["code"], F.lit(":"), i["field"])), ",")
    return judged.select("id", "status", "confidence", issues.alias("issues"))


def gate_facts(spark, d):
    """The facts of the approved candidates. Verdicts are written first, so a filter on the status doesn't repeat the checks."""
    facts = gate.facts_of(written(gate.judged(*_candidates(spark, d))))
    return facts.select("id", "material", "material_id", "property", "effect_direction", "temperature_c", "duration_h", F.col("source.fragment_id").alias("fragment_id"))


def table_values(spark, d):
    """Values with their units from the rows of tables: the unit in the head, in the first cell, or in a column of its own."""
    # Equal rows are read once, with their number.
    rows = views.table(spark, d, "lineitem").groupBy("l_linenumber", "l_quantity").agg(F.count("*").alias("n"))
    text = lambda c: F.round(F.col(c)).cast("int").cast("string")
    kind = F.col("l_linenumber") % 3
    header = F.when(kind == 0, "Amount, °C | Note").when(kind == 1, "Показатель | A | B").otherwise("Item | Amount | Unit")
    row = F.when(kind == 0, F.concat(text("l_quantity"), F.lit(" | x"))).when(kind == 1, F.concat(F.lit("Yield, % | "), text("l_quantity"), F.lit(" | "), text("l_linenumber"))).otherwise(F.concat(F.lit("x | "), text("l_quantity"), F.lit(" | мг/л")))
    found = rows.select("l_linenumber", F.regexp_replace(gate.values_with_units(header, row), "\n", ";").alias("lines"), "n")
    return found.groupBy("l_linenumber", "lines").agg(F.sum("n").alias("n"))


def citation_markers(spark, d):
    """For each order a text that cites its lines by number: numbers, a list, a range, one that is no line; and the ids it cites then."""
    lines = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order")).agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("ns"))  # seven lines at most
    index = lines.select("order", F.map_from_arrays("ns", F.transform("ns", lambda n: F.concat_ws("-", F.lit("fragment"), F.col("order").cast("string"), n))).alias("index"))
    # One text for all orders: its markers are read once, in a table of one row.
    said = spark.range(1).select(citations.markers(F.lit("A [1] b [2, 99], c [3-5] d [2023].")).alias("marks"))
    text = citations.resolved(F.col("marks"), F.col("index"))
    return index.crossJoin(F.broadcast(said)).select("order", text.alias("text")).select("order", "text", F.size(citations.cited_ids(F.col("text"))).cast("long").alias("cited"))


def _facts(spark, d) -> DataFrame:
    """Facts once for each id, written: all questions read them."""
    return written(fact_op.first_of_each(views.facts(spark, d), ["id"], F.col("confidence"), F.col("effect_direction"), F.col("is_hypothesis")))


def _base(spark, d, facts: DataFrame, graph: bool) -> collect.Base:
    """Their fragments and vectors are left out."""
    fragments = facts.select("fragment_id", "document_id", F.col("material").alias("text"))
    return collect.Base(facts, views.documents(spark, d), fragments, mentions=graph_op.entity_mentions(facts) if graph else None)


#: Questions, and whether the graph is asked too.
ASKED = (
    (Question("rings of one brand", material="small ring", property="Brand#2", year_min=1996), True),
    (Question("a brand before", property="Brand#17", year_max=1997), True),
    (Question("rings", material="ring", process="bolt"), False),
    (Question("nothing", material="unobtainium", property="Brand#2"), True),
)


def question_evidence(spark, d):
    """What is found for each question: facts with their confidence, related facts, gaps and hypotheses."""
    out, facts = [], _facts(spark, d)
    for no, (question, with_graph) in enumerate(ASKED):
        e = collect.collect_full(spark, _base(spark, d, facts, with_graph), question.text, question)
        counts = e.facts.agg(F.count("*").alias("facts"), F.coalesce(F.round(F.avg("confidence"), 2), F.lit(0.0)).alias("confidence"))
        related = e.related.agg(F.count("*").alias("related"))
        # One row on either side.
        both = counts.withColumn("no", F.lit(no)).join(related.withColumn("no", F.lit(no)), "no")
        out.append(both.select("no", "facts", "confidence", "related", F.lit(len(e.gaps)).alias("gaps"), F.lit(len(e.hypotheses)).alias("hypotheses")))
    return reduce(DataFrame.unionByName, out)


QUERIES = {f.__name__: f for f in (gate_review, gate_facts, table_values, citation_markers, question_evidence)}

_ROWS = """rows_v as (select distinct concat_ws('-', 'candidate', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_quantity * 100) as bigint), cast(round(l_discount * 100) as bigint), cast(round(l_tax * 100) as bigint), l_returnflag, l_linestatus) as id,
  l_returnflag as flag, l_linestatus as state, cast(round(l_quantity) as int) as q, l_linenumber as n, round(l_tax * 100) = 0 as bare, l_partkey as part from lineitem),
judged_v as (select *, flag = 'N' as no_property, not bare and state <> 'F' as no_quote, not bare and flag = 'R' as no_number from rows_v)"""

ORACLE_SQL = {
    "gate_review": f"""with {_ROWS} select id, case when no_property or bare or no_quote or no_number then 'pending_review' else 'approved' end as status,
          round(((not bare and not no_quote)::int + (not no_number)::int + (not no_property)::int) / 3.0, 3)::double as confidence,
          concat_ws(',', case when no_property then 'field_missing:property' end, case when bare then 'source_missing:source' end, case when no_quote then 'quote_unconfirmed:quote' end, case when no_number then 'number_unconfirmed:temperature_c' end) as issues from judged_v""",
    "gate_facts": f"""with {_ROWS} select replace(id, 'candidate-', 'claim-') as id, 'Brand ' || part as material, 'material-brand-' || part as material_id, 'strength' as property, 'increase' as effect_direction,
          q::double as temperature_c, n::double as duration_h, 'fragment-' || id as fragment_id from judged_v where not (no_property or bare or no_quote or no_number)""",
    "table_values": """select l_linenumber, case l_linenumber % 3 when 0 then q || ' °C' when 1 then q || ' %;' || l_linenumber || ' %' else q || ' мг/л' end as lines, count(*) as n
        from (select l_linenumber, cast(round(l_quantity) as int) as q from lineitem) group by 1, 2""",
    "citation_markers": """with l as (select l_orderkey as o, list(distinct l_linenumber) as ns from lineitem group by 1),
        f as (select o, ns, list_transform(list_filter([1], lambda x: list_contains(ns, x)), lambda x: 'fragment-' || o || '-' || x) as a, list_transform(list_filter([2], lambda x: list_contains(ns, x)), lambda x: 'fragment-' || o || '-' || x) as b,
          list_transform(list_filter([3, 4, 5], lambda x: list_contains(ns, x)), lambda x: 'fragment-' || o || '-' || x) as c from l)
        select o as "order", 'A [' || case when len(a) > 0 then array_to_string(a, ', ') else '1' end || '] b [' || case when len(b) > 0 then array_to_string(b, ', ') else '2, 99' end || '], c ['
          || case when len(c) > 0 then array_to_string(c, ', ') else '3-5' end || '] d [2023].' as text, len(a) + len(b) + len(c) as cited from f""",
    "question_evidence": f"""with {views.SQL}, one as (select distinct on (id) * from facts_v order by id, confidence, effect_direction, is_hypothesis),
        seen as (select f.*, d.year from one f join docs_v d on d.document_id = f.document_id where not d.hidden),
        led as (select id from one where contains(lower(material), 'small ring') or contains(lower(process), 'small ring')),
        q as (select 0 as no, * from seen where (id in (select id from led) or (lower(material) = 'small ring' and lower(property) = 'brand#2' and not is_hypothesis))
          union all select 1, * from seen where lower(property) = 'brand#17' and not is_hypothesis
          union all select 2, * from seen where lower(material) = 'ring' and not is_hypothesis),
        kept as (select * from q where no = 2 or (no = 0 and year >= 1996) or (no = 1 and year <= 1997)),
        n as (select k.no, (select count(*) from q where q.no = k.no) as found, (select count(*) from kept where kept.no = k.no) as facts, (select count(distinct lab) from kept where kept.no = k.no) as labs,
          coalesce((select round(avg(confidence), 2) from kept where kept.no = k.no), 0.0) as confidence from (values (0), (1), (2), (3)) k(no)),
        r as (select count(*) as related, (count(*) filter (where contains(lower(material), 'ring')) > 0)::int + (count(*) filter (where contains(lower(material), 'bolt')) > 0)::int as said
          from seen where contains(lower(material), 'ring') or contains(lower(material), 'bolt') or contains(lower(process), 'ring') or contains(lower(process), 'bolt'))
        select no, facts, confidence, case when no = 2 and facts = 0 then related else 0 end as related, (case when facts = 0 or labs < 2 then 1 else 0 end) + (found > facts)::int as gaps, case when no = 2 and facts = 0 then said else 0 end as hypotheses from n, r""",
}

"""Queries over texts: scalar functions, fragments, windows, quantities, routing, pages; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import text as tx
from ..functions.quantity import Quantities
from ..operators import routing, web, windows
from ..sources import traits


def fragments(spark, d):
    return views.fragments(spark, d).select("doc_id", "ordinal", tx.normalize_text(F.col("line")).alias("normalized_text")).where("normalized_text <> ''")


def split_blocks(spark, d):
    """Blocks of documents whose lines are taken for paragraphs, at most 300 characters."""
    docs = views.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return docs.select("doc_id", F.posexplode(tx.split_blocks(F.col("text"), 300)).alias("at", "block")).select("doc_id", F.col("at").cast("long").alias("at"), F.length("block").cast("long").alias("n"))


def merge_short(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return docs.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(tx.merge_short(F.col("lines"))).cast("long").alias("n_blocks"))


def text_windows(spark, d):
    frags = views.fragments(spark, d).select(F.col("doc_id").alias("document_id"), "ordinal", F.lit("paragraph").alias("element_type"), F.lit("").alias("section"), F.lit(1).alias("page"), F.col("line").alias("text"))
    return windows.text_windows(frags).select("document_id", F.col("window_no").cast("long").alias("window_no"), "first", "last", F.col("n").cast("long").alias("n"))


def slugs(spark, d):
    return views.table(spark, d, "part").select("p_partkey", tx.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), tx.index_token(F.lower("p_type")).alias("token"))


def name_keys(spark, d):
    return views.table(spark, d, "customer").select("c_custkey", tx.canonical(F.concat(F.lit("  "), "c_mktsegment", F.lit("\t X "))).alias("key"), tx.clean_extracted(F.when(F.col("c_nationkey") == 1, " N/A ").otherwise(F.col("c_name"))).alias("clean"), tx.direction(F.when(F.col("c_nationkey") < 9, "Рост").otherwise("")).alias("direction"))


def general_numbers(spark, d):
    return views.table(spark, d, "customer").select("c_custkey", tx.general_number(F.col("c_acctbal")).alias("text"))


def url_normalise(spark, d):
    return views.table(spark, d, "pages").select("page_id", tx.normalize_url(F.col("url")).alias("key"), tx.host(F.col("url")).alias("host"))


def strip_tags(spark, d):
    return views.table(spark, d, "pages").select("page_id", F.length(tx.strip_tags(F.col("html"))).cast("long").alias("n"), F.sha2(F.regexp_replace(tx.strip_tags(F.col("html")), " ", ""), 256).alias("digest"))


def web_merge(spark, d):
    """Pages as results: the day of the number is the question, the group its priority."""
    pages = views.table(spark, d, "pages")
    results = pages.select((F.col("page_id") % 7).alias("question_id"), (F.col("page_id") % 3).alias("priority"), F.col("page_id").alias("position"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url", F.lit("").alias("snippet"))
    return web.merge_results(results).select("question_id", F.col("rank").cast("long").alias("rank"), "url")


def offtopic_route(spark, d):
    return views.questions(spark, d).select("conv_id", "turn", routing.off_topic(F.col("question")).alias("off_topic"), routing.needs_full_path(F.col("question")).alias("full_path"))


def doc_origin(spark, d):
    return traits.origin(views.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text"))


def doc_year(spark, d):
    texts = views.table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.concat_ws(" ", F.lit("published"), F.year("o_orderdate").cast("string"), F.lit("and 12345")).alias("text"))
    return traits.year_mode(texts)


def unit_convert(spark, d):
    """Quantities of the line items, read as minutes, in hours; and as atmospheres, in bar."""
    q = Quantities()
    lines = views.table(spark, d, "lineitem")
    as_hours = q.convert(F.col("l_quantity"), F.lit("мин"), F.lit("duration"))
    as_bar = q.convert(F.col("l_quantity"), F.lit("атм"), F.lit("pressure_bar"))
    wrong = q.convert(F.col("l_quantity"), F.lit("г/л"), F.lit("duration"))
    return lines.groupBy("l_quantity").agg(F.count("*").alias("n")).select("l_quantity", F.round(as_hours["value"], 9).alias("hours"), F.round(as_bar["value"], 9).alias("bar"), wrong["value"].isNull().alias("mismatch"), "n")


def quantity_hits(spark, d):
    """Quantities found in sentences made of the line items."""
    q = Quantities()
    sentence = F.concat_ws(" ", F.lit("нагрев до"), F.col("l_quantity").cast("int").cast("string"), F.lit("°C,"), F.concat_ws("-", F.col("l_linenumber").cast("string"), (F.col("l_linenumber") + 2).cast("string")), F.lit("мг/л, EXP-001"))
    rows = views.table(spark, d, "lineitem").select(sentence.alias("text")).distinct()
    hits = rows.select(F.explode(q.hits(F.col("text"))).alias("h"))
    return hits.groupBy("h.kind").agg(F.count("*").alias("n"), F.round(F.sum("h.normalized_value"), 6).alias("total"))


def numeric_condition_match(spark, d):
    """Line items whose range of quantities, in minutes, can meet half an hour to three quarters."""
    q = Quantities()
    none = F.lit(None).cast("double")
    item = F.struct(none.alias("value"), F.col("l_quantity").alias("value_min"), (F.col("l_quantity") + F.col("l_linenumber")).alias("value_max"), F.lit("мин").alias("unit"))
    hit = q.in_range(item, F.lit(0.5), F.lit(0.75), F.lit("ч"))
    return views.table(spark, d, "lineitem").where(hit).groupBy("l_linenumber").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        fragments, split_blocks, merge_short, text_windows, slugs, name_keys, general_numbers, url_normalise, strip_tags, web_merge, offtopic_route,
        doc_origin, doc_year, unit_convert, quantity_hits, numeric_condition_match,
    )
}

_SP = "'[ \\t\\n\\r\\f\\x0b]+'"
ORACLE_SQL = {
    "fragments": f"with {views.SQL} select doc_id, ordinal, lower(trim(regexp_replace(line, {_SP}, ' ', 'g'))) as normalized_text from frags_v where normalized_text <> ''",
    "merge_short": """with recursive l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls, len(string_split(text, chr(10))) as n_lines from documents),
        r as (select doc_id, ls, n_lines, 1 as i, 0 as wait, 0 as done from l
          union all select doc_id, ls, n_lines, i + 1, case when w < 60 then w else 0 end, done + case when w < 60 then 0 else 1 end
          from (select *, case when wait > 0 then wait + 1 else 0 end + length(ls[i]) as w from r where i <= len(ls)))
        select doc_id, n_lines, done + case when wait > 0 and done = 0 then 1 else 0 end as n_blocks from r where i = len(ls) + 1""",
    "text_windows": f"""with recursive {views.SQL}, f as (select doc_id, ordinal, length(trim(line)) as n, row_number() over (partition by doc_id order by ordinal) as k from frags_v where length(trim(line)) > 0),
        r as (select doc_id, ordinal, k, n as size, 0 as no from f where k = 1
          union all select f.doc_id, f.ordinal, f.k, case when r.size + f.n > 2500 then f.n else r.size + f.n end, r.no + case when r.size + f.n > 2500 then 1 else 0 end from r join f on f.doc_id = r.doc_id and f.k = r.k + 1)
        select doc_id as document_id, cast(no as bigint) as window_no, min(ordinal) as first, max(ordinal) as last, count(*) as n from r group by all""",
    "slugs": "select p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') as slug, case when length(p_type) <= 4 then lower(p_type) else substr(lower(p_type), 1, 5) end as token from part",
    "name_keys": "select c_custkey, lower(c_mktsegment) || ' x' as key, case when c_nationkey = 1 then '' else c_name end as clean, case when c_nationkey < 9 then 'increase' else 'unknown' end as direction from customer",
    "general_numbers": "select c_custkey, printf('%g', c_acctbal) as text from customer",
    "url_normalise": """select page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/+$', '') as key,
        regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') as host from pages""",
    "strip_tags": f"with t as (select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), {_SP}, ' ', 'g')) as x from pages) select page_id, length(x) as n, sha256(replace(x, ' ', '')) as digest from t",
    "web_merge": """with recursive p as (select page_id % 7 as question_id, url, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/+$', '') as u,
          lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))) as t, row_number() over (partition by page_id % 7 order by page_id % 3, page_id) as k from pages),
        r as (select question_id, k, u, t, url, true as take, [u] as us, [t] as ts, 1 as n from p where k = 1
          union all select q.question_id, q.k, q.u, q.t, q.url, g, case when g then list_append(us, q.u) else us end, case when g then list_append(ts, q.t) else ts end, n + cast(g as int)
          from (select p.*, r.us, r.ts, r.n, not list_contains(r.us, p.u) and not (p.t <> '' and list_contains(r.ts, p.t)) and r.n < 12 as g from r join p on p.question_id = r.question_id and p.k = r.k + 1) q)
        select question_id, cast(n as bigint) as rank, url from r where take""",
    "offtopic_route": f"""with {views.SQL}, x as (select conv_id, turn, lower(trim(question)) as t from q_v)
        select conv_id, turn, t = '' or (not regexp_matches(t, '[0-9]') and length(t) <= 80) as off_topic, regexp_matches(t, '[0-9]') or contains(t, ' vs ') as full_path from x""",
    "doc_origin": r"""select doc_id as document_id, case when length(regexp_replace(lower(text), '[^a-z]', '', 'g')) > 0.5 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) then 'foreign' else 'ru' end as origin from documents""",
    "doc_year": "with c as (select o_custkey as document_id, year(o_orderdate) as y, count(*) as n from orders group by all) select document_id, cast(arg_max(y, (n, y)) as int) as year from c group by document_id",
    "unit_convert": "select l_quantity, round(l_quantity / 60, 9) as hours, round(l_quantity * 0.101325 * 10, 9) as bar, true as mismatch, count(*) as n from lineitem group by l_quantity",
    "quantity_hits": """with t as (select distinct cast(l_quantity as int) as q, l_linenumber as n from lineitem)
        select 'temperature' as kind, count(*) as n, cast(sum(q) as double) as total from t union all select 'concentration', 2 * count(*), cast(sum(2 * n + 2) as double) from t""",
    "numeric_condition_match": "select l_linenumber, count(*) as n from lineitem where not (l_quantity + l_linenumber < 30) and not (l_quantity > 45) group by l_linenumber",
}

"""Results from the web: merged, filtered, judged by their words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shared import written


def merge_results(results: DataFrame, most: int = 12, batch: int = 64) -> DataFrame:
    """results (question_id, priority, position, title, url, snippet) -> the first `most` of each question, in order, none with the url or the title of one that was kept.

    A fold over each question's ordered results: dropping duplicates by url and then by title would drop results for the sake of ones that are dropped themselves.
    It takes up to `batch` results of a question a round: the first that nothing kept so far excludes, so each round keeps one at least and `most` rounds are enough. Mostly the first round fills the
    list or ends the results. A window limit leaves `batch` rows of a question to a task before the shuffle, and equal rows are counted, so no question's results are gathered.
    """
    item = F.struct("priority", "position", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("snippet", F.lit("")).alias("snippet"))
    counted = results.groupBy("question_id", item.alias("r")).agg(F.count("*").alias("n"))
    keyed = counted.withColumns({"u": tx.normalize_url(F.col("r.url")), "t": tx.normalize_text(F.col("r.title"))})
    copies = F.when((F.col("u") == "") & (F.col("t") == ""), F.least("n", F.lit(most))).otherwise(1)  # rows without either exclude nothing
    rows = written(keyed.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select("question_id", F.struct("r", "copy").alias("at"), "u", "t"))
    order = Window.partitionBy("question_id").orderBy("at")
    none = F.array().cast("array<string>")
    empty = F.struct(none.alias("us"), none.alias("ts"), F.array().cast(f"array<{dict(rows.dtypes)['at']}>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        seen = ((x["u"] != "") & F.array_contains(s["us"], x["u"])) | ((x["t"] != "") & F.array_contains(s["ts"], x["t"]))
        take = ~seen & (F.size(s["kept"]) < most)
        more = lambda list_, v: F.when(take & (v != ""), F.concat(list_, F.array(v))).otherwise(list_)
        return F.struct(more(s["us"], x["u"]).alias("us"), more(s["ts"], x["t"]).alias("ts"), F.when(take, F.concat(s["kept"], F.array(x["at"]))).otherwise(s["kept"]).alias("kept"))

    parts, state = [], None
    for _ in range(most + 1):
        left = rows.withColumn("s", empty)
        if state is not None:  # questions that go on: those whose batch was full and whose list was not
            left = rows.join(state.select("question_id", "s", "last"), rows["question_id"].eqNullSafe(state["question_id"])).drop(state["question_id"])
            left = left.where((F.col("at") > F.col("last")) & ~F.array_contains("s.us", F.col("u")) & ~F.array_contains("s.ts", F.col("t"))).drop("last")
        first = left.withColumn("k", F.row_number().over(order)).where(F.col("k") <= batch)
        lists = first.groupBy("question_id").agg(F.first("s").alias("s"), F.array_sort(F.collect_list(F.struct("at", "u", "t"))).alias("xs"))
        folded = lists.select("question_id", F.aggregate("xs", F.col("s"), step).alias("s"), F.element_at("xs", -1)["at"].alias("last"), (F.size("xs") == batch).alias("full"))
        if state is not None:  # those without further results keep their list
            ended = state.join(folded.select(F.col("question_id").alias("_q")), F.col("question_id").eqNullSafe(F.col("_q")), "left_anti")
            folded = folded.unionByName(ended.withColumn("full", F.lit(False)).select(folded.columns))
        folded = written(folded)
        open_ = F.col("full") & (F.size("s.kept") < most)
        parts.append(folded.where(~open_))
        state = folded.where(open_)
        if state.isEmpty():
            break
    done = reduce(DataFrame.unionByName, parts).select("question_id", F.posexplode("s.kept").alias("rank", "x"))
    return done.select("question_id", (F.col("rank") + 1).alias("rank"), "x.r.title", "x.r.url", "x.r.snippet")


def key_terms(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Latin and digit words of 3 letters and more whole, Cyrillic ones of 4 and more by their first 5; without the stop words; each once."""
    words = F.filter(tx.tokens(text), lambda w: ~w.isin(*stop) if stop else F.lit(True))
    latin = F.filter(words, lambda w: w.rlike("^[a-z0-9]{3,}$"))
    other = F.transform(F.filter(words, lambda w: w.rlike("[а-я]") & (F.length(w) >= 4)), lambda w: F.substring(w, 1, 5))
    return F.array_distinct(F.concat(latin, other))


def relevant(results: DataFrame, question: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """Results that share a key term with the question."""
    return results.where(F.arrays_overlap(key_terms(F.concat_ws(" ", "title", "snippet"), stop), key_terms(F.lit(question), stop)))


def from_domains(results: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """Results whose url holds one of the domains; without domains all."""
    return results.where(F.exists(F.array(*map(F.lit, domains)), lambda d: F.contains(F.lower("url"), d))) if domains else results


def simplified(question: Column, stop: tuple[str, ...] = (), most: int = 8) -> Column:
    """The question's first words of over three letters, without the stop words: what is searched for."""
    words = F.regexp_extract_all(F.translate(F.lower(question), "ё", "е"), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 3) & (~w.isin(*stop) if stop else F.lit(True)))
    return F.array_join(F.slice(kept, 1, most), " ")


def with_glossary(text: Column, glossary: dict[str, str]) -> Column:
    """Whole words replaced, any case."""
    for word, other in glossary.items():
        text = F.regexp_replace(text, rf"(?iu)\b\Q{word}\E\b", other)
    return text


def relevant_by_meaning(results: DataFrame, question_vector: list[float], least: float = 0.45) -> DataFrame:
    """Results (with `embedding`) at least that near to the question."""
    from ..functions.vectors import dot

    return results.where(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in question_vector])) >= least)


def parse_atom(feeds: DataFrame, most: int = 5) -> DataFrame:
    """feeds (question_id, body: Atom XML) -> title, url, snippet, year, source of its entries; what an entry lacks is empty."""
    body = F.regexp_replace("body", r'xmlns="[^"]*"', "")
    entries = F.slice(F.regexp_extract_all(body, F.lit(r"(?s)<entry[\s>].*?</entry>"), F.lit(0)), 1, most)
    field = lambda f: F.expr(f"xpath_string(_entry, '/entry/{f}')")
    one = feeds.select("question_id", F.posexplode(entries).alias("position", "_entry"))
    return _results(one, field("title"), field("id"), field("summary"), tx.year_in(field("published")), "arxiv")


def parse_crossref(answers: DataFrame, most: int = 5) -> DataFrame:
    """answers (question_id, body: JSON of works) -> results."""
    date = "struct<`date-parts`: array<array<string>>>"
    work = f"struct<URL: string, title: array<string>, abstract: string, `container-title`: array<string>, published: {date}, issued: {date}, `published-print`: {date}, `published-online`: {date}>"
    items = F.from_json("body", f"message struct<items: array<{work}>>")["message"]["items"]
    one = answers.select("question_id", F.posexplode(F.slice(items, 1, most)).alias("position", "e"))
    year = F.coalesce(*[tx.year_in(F.get(F.get(F.col(f"e.`{k}`.`date-parts`"), F.lit(0)), F.lit(0))) for k in ("published", "issued", "published-print", "published-online")])
    snippet = F.coalesce(F.nullif(tx.strip_tags(F.col("e.abstract")), F.lit("")), F.get(F.col("e.`container-title`"), F.lit(0)))
    return _results(one, F.get(F.col("e.title"), F.lit(0)), F.col("e.URL"), snippet, year, "crossref")


def parse_semantic(answers: DataFrame, most: int = 5) -> DataFrame:
    """answers (question_id, body: JSON of papers) -> results."""
    items = F.from_json("body", "data array<struct<title: string, abstract: string, url: string, year: string>>")["data"]
    one = answers.select("question_id", F.posexplode(F.slice(items, 1, most)).alias("position", "e"))
    return _results(one, F.col("e.title"), F.col("e.url"), F.col("e.abstract"), tx.year_in(F.col("e.year")), "semanticscholar")


def _results(rows: DataFrame, title: Column, url: Column, snippet: Column, year: Column, source: str) -> DataFrame:
    named = F.coalesce(F.nullif(tx.strip_tags(title), F.lit("")), url)
    out = rows.select("question_id", "position", named.alias("title"), tx.strip(url).alias("url"), F.substring(tx.strip_tags(snippet), 1, 300).alias("snippet"), year.alias("year"), F.lit(source).alias("source"))
    return out.where(F.coalesce("url", F.lit("")) != "")

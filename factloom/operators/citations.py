"""Citations: numbering evidence, turning numbers in a text into ids, and finding what they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widest range of numbers that is written out.
WIDEST = 25


def number_evidence(facts: DataFrame, hits: DataFrame, n_facts: int = 15, n_hits: int = 10) -> DataFrame:
    """n, fragment_id: the first facts (rank, fragment_id), then the first hits (rank, fragment_id), numbered through. At most n_facts + n_hits rows reach the window."""
    first = facts.orderBy("rank", "fragment_id").limit(n_facts).select(F.lit(0).alias("part"), "rank", "fragment_id")
    then = hits.orderBy("rank", "fragment_id").limit(n_hits).select(F.lit(1).alias("part"), "rank", "fragment_id")
    return first.unionByName(then).select(F.row_number().over(Window.orderBy("part", "rank", "fragment_id")).alias("n"), "fragment_id")


def markers(text: Column) -> Column:
    """array<struct<part, numbers>>: a text cut at its brackets, and the numbers that [3], [3, 7] and [5-10] stand for; null for what is between them. The same for any index, so a text that meets many is read once."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[\s*\d[\d\s,–—\-]*\]|[^\[]+|\["), F.lit(0))

    def expand(token: Column) -> Column:
        low, high = F.regexp_extract(token, r"^(\d+)\s*[–—\-]\s*(\d+)$", 1).try_cast("int"), F.regexp_extract(token, r"^(\d+)\s*[–—\-]\s*(\d+)$", 2).try_cast("int")
        fits = (high >= low) & (high - low <= WIDEST)
        numbers = F.transform(F.sequence(F.when(fits, low).otherwise(0), F.when(fits, high).otherwise(0)), lambda n: n.cast("string"))
        return F.when(low.isNull(), F.array(token)).when(fits, numbers).otherwise(F.array().cast("array<string>"))

    def numbers(part: Column) -> Column:
        tokens = F.transform(F.split(F.regexp_replace(part, r"^\[|\]$", ""), ","), lambda x: F.trim(x))
        return F.flatten(F.transform(tokens, expand))

    return F.transform(parts, lambda p: F.struct(p.alias("part"), F.when(p.rlike(r"^\[\s*\d"), numbers(p)).alias("numbers")))


def resolved(marks: Column, index: Column) -> Column:
    """The text of `markers` with ids by `index` (map of number, as text, to id). Numbers not in it are dropped; a bracket with none that is stays."""
    found = F.transform(marks, lambda m: F.struct(m["part"].alias("part"), F.array_distinct(F.array_compact(F.transform(m["numbers"], lambda n: F.try_element_at(index, n)))).alias("ids")))
    return F.array_join(F.transform(found, lambda m: F.when(F.coalesce(F.size(m["ids"]), F.lit(0)) > 0, F.concat(F.lit("["), F.array_join(m["ids"], ", "), F.lit("]"))).otherwise(m["part"])), "")


def translate_markers(text: Column, index: Column) -> Column:
    """[3], [3, 7] and [5-10] in a text to [ids] by `index` (map of number, as text, to id). Numbers not in it are dropped; a bracket with none that is stays."""
    return resolved(markers(text), index)


def cited_ids(text: Column) -> Column:
    """The ids of fragments and claims that a text cites, in order, each once."""
    brackets = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[((?:fragment|claim)-[^\[\]]+)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(brackets, lambda b: F.split(b, r"\s*,\s*"))))


def cited_sources(texts: DataFrame, fragments: DataFrame, facts: DataFrame) -> DataFrame:
    """texts (position, text) -> rank, cited, fragment_id, document_id, quote of each cited fragment, claims through their facts, each fragment once, by first citation."""
    cited = texts.select("position", F.posexplode(cited_ids(F.col("text"))).alias("at", "cited"))
    of_claim = facts.select(F.col("id").alias("cited"), F.col("fragment_id").alias("_fragment"), F.col("document_id").alias("_document"))
    named = cited.join(of_claim, "cited", "left").withColumn("fragment_id", F.when(F.col("cited").startswith("claim-"), F.col("_fragment")).otherwise(F.col("cited")))
    found = named.join(fragments.select("fragment_id", "document_id", F.substring("text", 1, 200).alias("quote")), "fragment_id", "left")
    known = found.withColumn("document_id", F.coalesce("document_id", "_document")).where("fragment_id is not null and document_id is not null")
    first = known.groupBy("fragment_id").agg(F.min(F.struct("position", "at")).alias("first"), F.min_by(F.struct("cited", "document_id", "quote"), F.struct("position", "at")).alias("s"))
    return first.select(F.row_number().over(Window.orderBy("first.position", "first.at")).alias("rank"), "s.cited", "fragment_id", "s.document_id", "s.quote")


def strip_hypothesis_prefix(text: Column) -> Column:
    """A hypothesis without its leading label, its first letter upper-cased; a text without one, or of nothing else, as it is."""
    label = r"(?iu)^\s*(?:(?:(?:не)?прямая|косвенная)\s+гипотеза|гипотеза(?:\s*\(\s*(?:(?:не)?прямая|косвенная)\s*\))?|косвенно)\s*:\s*"
    bare = F.ltrim(F.regexp_replace(F.coalesce(text, F.lit("")), label, ""))
    changed = F.coalesce(text, F.lit("")).rlike(label) & (bare != "")
    return F.when(changed, F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.length(bare)))).otherwise(F.coalesce(text, F.lit("")))

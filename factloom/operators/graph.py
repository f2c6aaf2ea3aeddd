"""The knowledge graph as two tables: nodes (id, label, type) and edges (source, target, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import REGIONS, SEMANTIC_TYPES
from ..functions import text as tx
from ..shared import dropped, written
from .facts import canonical_entity, first_of_each


def claim_label(prop: Column, direction: Column, quote: Column, id_: Column) -> Column:
    """property: direction; without a direction the property; without that the quotation's start; or the id."""
    label = tx.direction_label(tx.direction(direction))
    cut = F.concat(F.substring(F.trim(quote), 1, 40), F.when(F.length(F.trim(quote)) > 40, "…").otherwise(""))
    stated = F.when(label != "unknown", F.concat(prop, F.lit(": "), label)).otherwise(prop)
    return F.when(~tx.is_junk(prop), stated).when(F.trim(F.coalesce(quote, F.lit(""))) != "", cut).otherwise(id_)


def entity_mentions(facts: DataFrame) -> DataFrame:
    """fact id, type, name, relation: what each fact names; stand-ins for "not extracted" are left out."""
    named = F.array(
        F.struct(F.lit("Material").alias("type"), F.col("material").alias("name"), F.lit("ABOUT").alias("relation")),
        F.struct(F.lit("Process").alias("type"), F.col("process").alias("name"), F.lit("USED_IN").alias("relation")),
    )
    if "equipment" in facts.columns:
        named = F.concat(named, F.array(F.struct(F.lit("Equipment").alias("type"), F.col("equipment").alias("name"), F.lit("USED_IN").alias("relation"))))
    if "entities" in facts.columns:  # array<struct<type, name>>
        wanted = F.filter("entities", lambda e: e["type"].isin(*SEMANTIC_TYPES))
        named = F.concat(named, F.transform(F.coalesce(wanted, F.expr("array()").cast("array<struct<type:string,name:string>>")), lambda e: F.struct(e["type"].alias("type"), tx.clean_extracted(e["name"]).alias("name"), F.lit("MENTIONS").alias("relation"))))
    return facts.select("id", F.explode(named).alias("e")).select("id", "e.*").where(~tx.is_junk(F.col("name")))


def _spellings(mentions: DataFrame) -> DataFrame:
    """type, name, key: each name once, written."""
    return written(mentions.select("type", "name").distinct().withColumn("key", tx.canonical(F.col("name"))))


def _nodes_of(mentions: DataFrame, spellings: DataFrame) -> DataFrame:
    """type, key, label, id: a key of one spelling has that as its label; only mentions of the others are compared, by the id of the fact."""
    keys = spellings.groupBy("type", "key").agg(F.count("*").alias("n"), F.min("name").alias("label"))
    several = spellings.join(keys.where("n > 1").select("type", "key"), ["type", "key"])
    named = mentions.select("type", "name", "id").join(written(several), ["type", "name"]).select("type", "key", "id", F.col("name").alias("label"))
    first = keys.where("n = 1").select("type", "key", "label").unionByName(named.groupBy("type", "key").agg(F.min_by("label", F.struct("id", "label")).alias("label")))
    base = F.concat(F.lower("type"), F.lit("-"), F.coalesce(F.nullif(tx.slug(F.col("label")), F.lit("")), F.substring(F.sha2("key", 256), 1, 12)))
    numbered = first.withColumn("base", base).withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("key")))
    return numbered.select("type", "key", "label", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))).alias("id"))


def entity_nodes(mentions: DataFrame) -> DataFrame:
    """type, key, label, id: one node for each (type, canonical name), labelled by its first mention; equal slugs get -2, -3, ... in order of key.

    Mentions are first reduced to distinct names, so the numbering sees names, not facts.
    """
    return _nodes_of(mentions, _spellings(mentions))


def answer_graph(facts: DataFrame, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of some facts: claims, what they name, and their documents."""
    mentions = entity_mentions(facts)
    spellings = _spellings(mentions)
    entities = _nodes_of(mentions, spellings)
    quote = F.col("quote") if "quote" in facts.columns else F.lit(None).cast("string")
    claims = facts.select("id", claim_label(F.col("property"), F.col("effect_direction"), quote, F.col("id")).alias("label"), F.lit("Claim").alias("type"))
    cited = facts.select("document_id").distinct()
    label = F.col("document_id")
    if documents is not None and "filename" in documents.columns:
        cited = cited.join(documents.select("document_id", "filename"), "document_id", "left")
        label = F.coalesce(tx.short_label(F.col("filename")), F.col("document_id"))
    papers = cited.select(F.concat(F.lit("document-"), "document_id").alias("id"), label.alias("label"), F.lit("Document").alias("type"))
    nodes = first_of_each(claims, ["id"], F.col("label")).unionByName(entities.select("id", "label", "type")).unionByName(papers)
    # Names are looked up as they are written; every edge has a fact's id at one end, so rows dealt by it meet their like without another shuffle.
    ids = written(spellings.join(entities.select("type", "key", F.col("id").alias("source")), ["type", "key"]).select("type", "name", "source"))
    named = mentions.join(ids, ["type", "name"]).select("id", "source", F.col("id").alias("target"), F.col("relation").alias("label"))
    cites = facts.select("id", F.col("id").alias("source"), F.concat(F.lit("document-"), "document_id").alias("target"), F.lit("CITES").alias("label"))
    return nodes, named.unionByName(cites).repartition("id").distinct().drop("id")


def fact_projection(facts: DataFrame, claims: DataFrame | None = None, distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    """The stored graph of facts: material, experiment, property, effect, laboratory, fragment and claim nodes, and the six edges between them.

    claims: the facts whose claims are still there, if others were deleted (what those named stays); distinct: whether edges are each there once, for readers that can't have them repeated.
    Names become ids once each; claims and their edges are dealt by the fact's id, once.
    """
    claims = facts if claims is None else claims
    slugged = {"Material": ("material-", "material"), "Property": ("property-", "property"), "Laboratory": ("lab-", "lab")}
    node_id = lambda n: F.concat(F.lit(slugged[n][0]), tx.slug(F.col(slugged[n][1])))
    names = facts.select(F.explode(F.array(*[F.struct(F.col(c).alias("name"), F.lit(n).alias("label")) for n, (_, c) in slugged.items()])).alias("n")).select("n.*").distinct()
    prefix = F.create_map(*[F.lit(x) for n, (start, _) in slugged.items() for x in (n, start)])
    named = names.select(F.concat(F.try_element_at(prefix, F.col("label")), tx.slug(F.col("name"))).alias("id"), "label", "name").groupBy("id", "label").agg(F.min("name").alias("name"))
    own = facts.select(F.explode(F.array(*[F.struct(F.col(c).alias("id"), F.lit(n).alias("label")) for n, c in (("Experiment", "experiment_id"), ("SourceFragment", "fragment_id"))])).alias("n")).select("n.*").distinct().select("id", "label", F.col("id").alias("name"))
    effects = facts.select("id", "effect_direction").repartition("id").groupBy("id").agg(F.min("effect_direction").alias("name")).select(F.concat(F.lit("effect-"), "id").alias("id"), F.lit("Effect").alias("label"), "name")
    stated = claims.select("id").repartition("id").distinct().select("id", F.lit("Claim").alias("label"), F.col("id").alias("name"))
    nodes = named.unionByName(own).unionByName(effects).unionByName(stated)

    edge = lambda *ends: F.explode(F.array(*[F.struct(a.alias("source"), b.alias("target"), F.lit(r).alias("label")) for a, r, b in ends])).alias("e")
    of_claim = claims.select("id", "material", "experiment_id", "fragment_id")
    of_claim = (of_claim.repartition("id") if distinct else of_claim).select("id", edge(
        (F.col("id"), "ABOUT", node_id("Material")), (F.col("id"), "BASED_ON", F.col("experiment_id")), (F.col("id"), "HAS_EFFECT", F.concat(F.lit("effect-"), F.col("id"))), (F.col("id"), "SUPPORTED_BY", F.col("fragment_id")),
    )).select("id", "e.*")
    # Pairs of names are reduced before they become ids.
    pairs = facts.select(F.explode(F.array(*[F.struct(F.col("experiment_id").alias("source"), F.col(c).alias("name"), F.lit(r).alias("label"), F.lit(p).alias("prefix")) for c, r, p in (("property", "MEASURED", "property-"), ("lab", "PERFORMED_AT", "lab-"))])).alias("e")).select("e.*")
    of_experiment = (pairs.distinct() if distinct else pairs).select("source", F.concat("prefix", tx.slug(F.col("name"))).alias("target"), "label")
    if not distinct:
        return nodes, of_claim.drop("id").unionByName(of_experiment)
    return nodes, of_claim.distinct().drop("id").unionByName(of_experiment.distinct())


#: Ids of a frontier that every task may hold; a larger one is joined by a shuffle.
HELD_IDS = 2_000_000


def reachable(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """id, hop: nodes at most `hops` steps along edges from `start` (id), with the least number of steps. Each step joins the last frontier only.

    The edges are written once and each frontier too, so a step's plan reads them and the frontiers before it, however the edges were made; no step follows an empty frontier. Ends without id are left out, and edges may repeat.
    A frontier of up to HELD_IDS ids goes to the edges, so that these are not shuffled.
    """
    step = written(edges.select(F.col("source").alias("id"), F.col("target").alias("next")).where("id is not null and next is not null"))
    frontier = written(start.select("id").where("id is not null").distinct().withColumn("hop", F.lit(0)))
    seen = frontier
    for k in range(1, hops + 1):
        n = frontier.count()
        if not n:
            break
        found = step.join(F.broadcast(frontier) if n <= HELD_IDS else frontier, "id").select(F.col("next").alias("id")).distinct()
        frontier = written(found.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(k)))
        seen = seen.unionByName(frontier)
    dropped(step)
    return seen


def orphans(nodes: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """Nodes other than claims and fragments that no claim reaches in 1 to `hops` steps. What both read is written first, since how it was made may be long."""
    nodes = written(nodes.where("label <> 'SourceFragment'"))
    reached = reachable(edges, nodes.where("label = 'Claim'"), hops).where("hop > 0").select("id")
    return nodes.where("label <> 'Claim'").join(reached, "id", "left_anti")


def without(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of `gone` (id) and their edges."""
    kept = nodes.join(gone, "id", "left_anti")
    ends = edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    return kept, ends.select(edges.columns)


def junk_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose name stands for "not extracted"."""
    return nodes.where(tx.is_junk(F.col("name")))


def entity_neighbours(mentions: DataFrame, terms: list[str], k: int | None = None) -> DataFrame:
    """claim ids that mention an entity whose name holds a term, any case; all, or the first k by id. Terms are literals, so mentions are read once."""
    hit = F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower("name"), t))
    found = mentions.where(hit).select(F.col("id").alias("claim_id")).distinct()
    return found.orderBy("claim_id").limit(k) if k else found


def regions_in(text: Column, regions: dict | None = None) -> Column:
    """The regions whose markers start a word of the text, in the dictionary's order."""
    folded = tx.canonical(text)
    quote = lambda m: r"\b\Q" + m + r"\E"
    found = [F.when(folded.rlike("|".join(quote(m) for m in markers)), F.lit(name)) for name, markers in (regions or REGIONS).items()]
    return F.array_compact(F.array(*found))


def region_names(asked: str, regions: dict | None = None) -> list[str] | None:
    """The regions a question means by "abroad" or "at home"; None: look for the name itself."""
    names, folded = list(regions or REGIONS), asked.strip().lower().replace("ё", "е")
    if any(m in folded for m in ("рубеж", "мировой практик", "мировая практик", "иностран", "abroad", "foreign")):
        return names[1:]
    if any(m in folded for m in ("отечествен", "росси", "рф")):
        return names[:1]
    return None


def region_claims(claims: DataFrame, asked: str, k: int | None = 40, regions: dict | None = None) -> DataFrame:
    """claims (id, regions: array) -> the claims of the region asked for."""
    names = region_names(asked, regions)
    if names is not None:
        hit = F.arrays_overlap("regions", F.array(*map(F.lit, names)))
    else:
        hit = F.exists("regions", lambda r: F.contains(F.lower(r), F.lit(asked.lower())))
    found = claims.where(hit).select(F.col("id").alias("claim_id")).distinct()
    return found.orderBy("claim_id").limit(k) if k else found


def semantic_projection(claims: DataFrame, types: tuple[str, ...], predicates: dict[str, tuple[tuple, tuple]], synonyms: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """claims (id, entities, relations) -> mentions (claim, type, name) and relations (subject, predicate, object).

    Entities of other types, stand-ins, and relations of other predicates or with an end that is no entity of the claim are left out.
    """
    tidy = lambda c: tx.clean_extracted(canonical_entity(tx.clean_extracted(c), synonyms))
    entities = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), tidy(e["name"]).alias("name")))
    kept = claims.withColumn("entities", F.filter(entities, lambda e: e["type"].isin(*types) & (e["name"] != "")))
    mentions = kept.select("id", F.explode("entities").alias("e")).select(F.col("id").alias("claim"), "e.type", "e.name").distinct()
    names = F.transform("entities", lambda e: e["name"])
    relation = F.transform("relations", lambda r: F.struct(tidy(r["subject"]).alias("subject"), r["predicate"].alias("predicate"), tidy(r["object"]).alias("object")))
    wanted = kept.withColumn("names", names).withColumn("relations", F.filter(relation, lambda r: r["predicate"].isin(*predicates) & F.array_contains("names", r["subject"]) & F.array_contains("names", r["object"])))
    return mentions, wanted.select(F.explode("relations").alias("r")).select("r.*").distinct()


def claim_title(facts: DataFrame) -> DataFrame:
    """id, title of facts: what it is about, then what it states."""
    junk, col = tx.is_junk, lambda c, kind="string": F.col(c) if c in facts.columns else F.lit(None).cast(kind)
    context = F.array_join(F.filter(F.array("material", "process"), lambda p: ~junk(p)), ", ")
    value = F.when(col("effect_value", "double").isNull(), "").otherwise(F.concat(F.lit(" "), tx.general_number(col("effect_value", "double")), F.coalesce(col("effect_unit"), F.lit(""))))
    effect = F.trim(F.concat(tx.direction_label(F.col("effect_direction")), value))
    stated = F.when(effect != "", F.concat("property", F.lit(": "), effect)).otherwise(F.col("property"))
    body = F.when(~junk(F.col("property")), stated).otherwise(F.coalesce(F.nullif(F.trim(col("quote")), F.lit("")), F.col("id")))
    return facts.select("id", F.when(context != "", F.concat(context, F.lit(" — "), body)).otherwise(body).alias("title"))


def context_entities(facts: DataFrame, fragments: DataFrame, documents: DataFrame, regions: dict | None = None) -> DataFrame:
    """id, type, name: the regions that a fact's fragment names, and the authors of its document as experts."""
    places = facts.select("id", "fragment_id").join(fragments.select("fragment_id", regions_in(F.col("text"), regions).alias("names")), "fragment_id").select("id", F.lit("Region").alias("type"), F.explode("names").alias("name"))
    people = facts.select("id", "document_id").join(documents.select("document_id", "authors"), "document_id").select("id", F.lit("Expert").alias("type"), F.explode("authors").alias("name"))
    return places.unionByName(people)

"""Tables over time: merges, cascades, job status, deduplication by content, decisions on candidates. Each returns the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import first_of_each


def upsert(target: DataFrame, rows: DataFrame, key: str, keep: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """target with rows merged by key: columns in `keep` stay as they were, with `only` given just those change; new keys are added.

    rows has one row for each key; columns it lacks stay.
    """
    new = [c for c in rows.columns if c != key]
    changed = [c for c in new if c not in keep and (only is None or c in only)]
    source = rows.select(F.col(key), F.struct(*new).alias("_new"))
    both = target.withColumn("_old", F.lit(True)).join(source, key, "full_outer")

    def value(c: str):
        if c == key or c not in new:
            return F.col(c)
        added = F.col(f"_new.{c}")
        if c in changed:
            return F.when(F.col("_new").isNotNull(), added).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_old").isNull(), added).otherwise(F.col(c)).alias(c)

    return both.select(*[value(c) for c in target.columns])


def upsert_vectors(target: DataFrame, rows: DataFrame) -> DataFrame:
    """fragment_id, embedding: merged, numbers kept to eight places."""
    tidy = rows.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 8)))
    return upsert(target, tidy, "fragment_id")


def latest_status(events: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last status of each job, from its append-only events."""
    return events.groupBy(key).agg(F.max_by("status", F.struct(*order)).alias("status"), F.max("ts").alias("updated_at"), F.count("*").alias("n_events"))


def cascade_delete(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the documents in `gone` (document_id). Vectors follow their fragments."""
    out = {}
    for name, table in tables.items():
        if "document_id" in table.columns:
            out[name] = table.join(gone, "document_id", "left_anti").select(table.columns)
        elif "source" in table.columns:
            out[name] = table.where(F.col("source.document_id").isNull()).unionByName(
                table.withColumn("document_id", F.col("source.document_id")).where("document_id is not null").join(gone, "document_id", "left_anti").drop("document_id")
            )
        else:
            out[name] = table
    if "fragments" in tables and "vectors" in tables:
        lost = tables["fragments"].join(gone, "document_id", "left_semi").select("fragment_id")
        out["vectors"] = tables["vectors"].join(lost, "fragment_id", "left_anti")
    return out


def retract(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """facts (id, document_id, conflicts_with, status) without those of the documents in `gone`: links to them go, and a fact without links is approved again."""
    removed = facts.join(gone, "document_id", "left_semi").select(F.col("id").alias("other"))
    stays = facts.join(gone, "document_id", "left_anti")
    lost = stays.select("id", F.explode("conflicts_with").alias("other")).join(removed, "other").groupBy("id").agg(F.collect_set("other").alias("_lost"))
    left = F.when(F.col("_lost").isNull(), F.col("conflicts_with")).otherwise(F.array_except("conflicts_with", "_lost"))
    status = F.when((F.col("status") == "conflicting") & F.col("_lost").isNotNull() & (F.size("_left") == 0), "approved").otherwise(F.col("status"))
    return stays.join(lost, "id", "left").withColumn("_left", left).withColumn("status", status).withColumn("conflicts_with", F.col("_left")).select(facts.columns)


def by_checksum(files: DataFrame, content: str = "content", *order) -> DataFrame:
    """The first of the files with equal content, and how many there are."""
    keyed = files.withColumn("checksum", F.sha2(F.col(content).cast("binary"), 256))
    counts = keyed.groupBy("checksum").agg(F.count("*").alias("n_copies"))
    return first_of_each(keyed.drop(content), ["checksum"], *order).join(counts, "checksum")


def decide(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates (id, status) with decisions (id, decision: approve, reject, unapprove) applied; outcome tells of decisions that do not fit (one row each)."""
    to = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "unapprove", "pending_review")
    both = candidates.join(decisions, "id", "full_outer")
    outcome = F.when(F.col("status").isNull(), "no such candidate").when(F.col("decision").isNotNull() & to.isNull(), "unknown decision").when(F.col("decision").isNotNull(), "done")
    return both.select("id", F.when(outcome == "done", to).otherwise(F.col("status")).alias("status"), outcome.alias("outcome"))


def edited(candidates: DataFrame, overrides: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """candidates with an expert's values (id and some of `fields`) in place of the extracted ones; edited_by_human is set where there are any."""
    allowed = [c for c in overrides.columns if c in fields]
    source = overrides.select("id", F.struct(*allowed).alias("_o"))
    joined = candidates.join(source, "id", "left")
    cols = [F.coalesce(F.col(f"_o.{c}"), F.col(c)).alias(c) if c in allowed else F.col(c) for c in candidates.columns if c != "edited_by_human"]
    own = F.coalesce(F.col("edited_by_human"), F.lit(False)) if "edited_by_human" in candidates.columns else F.lit(False)
    return joined.select(*cols, (F.col("_o").isNotNull() | own).alias("edited_by_human"))


def reprocess(candidates: DataFrame, fresh: DataFrame) -> DataFrame:
    """Candidates after a new extraction: rejected or human-edited ones win, others are replaced by the fresh ones of their documents."""
    safe = candidates.where("status = 'rejected' or coalesce(edited_by_human, false)")
    untouched = candidates.join(fresh.select("document_id").distinct(), "document_id", "left_anti")
    new = fresh.join(safe.select("id"), "id", "left_anti")
    return safe.unionByName(untouched.join(safe.select("id"), "id", "left_anti").select(candidates.columns)).unionByName(new.select(candidates.columns))


def missing(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that are not done yet."""
    return rows.join(done.select(key), key, "left_anti")


def evolved(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows added to a table whose columns they may lack or exceed; what either side lacks is null."""
    return target.unionByName(rows, allowMissingColumns=True)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has: empty where the key is one."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def of_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors of the dimension in use; others are to be made anew."""
    return vectors.where(F.size("embedding") == dimension)


def current_version(documents: DataFrame, versions: DataFrame, checksum: str) -> DataFrame:
    """The document whose current version has that checksum, with it."""
    found = versions.where(F.col("checksum") == checksum).select(F.col("id").alias("current_version_id"), "version_number")
    return documents.join(found, "current_version_id").orderBy("id").limit(1)

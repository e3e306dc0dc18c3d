"""Writing, checking and moving records: validation, corrections, transfer, import, purge, migration, export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.values import calendar_shift, is_symbol
from tidemark.operators.components import stored
from tidemark.operators.scan import RAW_FAMILIES, archived, as_of, raw_history, raw_log
from tidemark.plans.context import Context, QueryError
from tidemark.sources.tables import digest_of


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, in the given order; null if all hold."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))


def validate_assertions(batch: DataFrame, predicates: DataFrame, known_values: tuple[str, ...], revision: int) -> DataFrame:
    """(assertion_id, reason) of drafts that can't be written: predicate, lifecycle, value, polarity, validity, in this order."""
    rows = batch.join(predicates.select("predicate_id", F.col("lifecycle").alias("predicate_lifecycle")), "predicate_id", "left")
    checks = [
        ("unknown_predicate", F.col("predicate_lifecycle").isNotNull()),
        ("retired_predicate", F.col("predicate_lifecycle") != "retired"),
        ("value_not_allowed", F.col("value_canon").isin(*known_values)),
        ("polarity", F.col("polarity").isin("positive", "negative")),
        ("empty_validity", F.col("valid_end").isNull() | (F.col("valid_start") < F.col("valid_end"))),
        ("revision", F.col("revision") <= revision),
    ]
    return rows.withColumn("reason", first_reason(checks)).filter("reason IS NOT NULL").select("assertion_id", "reason")


def value_violations(rows: DataFrame, column: str, *, minimum: int | None = None, maximum: int | None = None, max_bytes: int | None = None, min_bytes: int | None = None, allowed: tuple | None = None, pattern: str | None = None, symbol: bool = False, required: bool = False, scale: int | None = None) -> DataFrame:
    """Rows whose value breaks a constraint, and the first that it breaks."""
    c, checks = F.col(column), []
    if required:
        checks.append(("required", c.isNotNull()))
    for name, test in (("minimum", c >= minimum if minimum is not None else None), ("maximum", c <= maximum if maximum is not None else None), ("max_bytes", F.octet_length(c) <= max_bytes if max_bytes is not None else None), ("min_bytes", F.octet_length(c) >= min_bytes if min_bytes is not None else None), ("allowed", c.isin(*allowed) if allowed else None), ("pattern", c.rlike(pattern) if pattern else None), ("symbol", is_symbol(c) if symbol else None), ("scale", F.length(F.regexp_extract(c.cast("string"), r"\.(\d*)$", 1)) <= scale if scale is not None else None)):
        if test is not None:
            checks.append((name, c.isNull() | test))
    return rows.withColumn("reason", first_reason(checks)).filter("reason IS NOT NULL")


def dangling(records: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """References to records that don't exist."""
    return records.filter(F.col(key).isNotNull()).join(targets.select(F.col(target_key).alias(key)), key, "left_anti")


def repeated(records: DataFrame, key: str) -> DataFrame:
    return records.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def verify(store) -> DataFrame:
    """(check, n): repeated ids and dangling references of a store."""
    checks = {
        "repeated_assertions": repeated(store.assertions, "assertion_id"),
        "repeated_events": repeated(store.world_events, "event_id"),
        "retractions_without_assertion": dangling(store.assertion_retractions, "assertion_id", store.assertions, "assertion_id"),
        "closures_without_assertion": dangling(store.assertion_closures, "assertion_id", store.assertions, "assertion_id"),
        "mask_retractions_without_mask": dangling(store.mask_retractions, "mask_id", store.masks, "mask_id"),
        "mask_closures_without_mask": dangling(store.mask_closures, "mask_id", store.masks, "mask_id"),
        "boundary_closures_without_boundary": dangling(store.boundary_closures, "boundary_id", store.boundaries, "boundary_id"),
        "boundary_retractions_without_boundary": dangling(store.boundary_retractions, "boundary_id", store.boundaries, "boundary_id"),
        "evidence_without_source": dangling(store.evidence, "source_id", store.sources, "source_id"),
        "relations_without_event": dangling(store.event_relations, "to_id", store.world_events, "event_id"),
        "provenance_without_record": dangling(store.provenance, "to_id", store.assertions, "assertion_id"),
    }
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("check"), F.count("*").alias("n")) for name, rows in checks.items()])


def correct(assertions: DataFrame, changes: DataFrame, revision: int, id_offset: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replacements, retractions and corrects edges, all at one revision; slot and context stay as they were."""
    changed = assertions.join(changes.select("assertion_id", F.col("value_canon").alias("new_value")), "assertion_id")
    new_id = F.col("assertion_id") + id_offset
    replacements = changed.withColumns({"value_canon": F.col("new_value"), "revision": F.lit(revision).cast("long"), "assertion_id": new_id}).select(*assertions.columns)
    retractions = changed.select("assertion_id", F.lit(revision).cast("long").alias("revision"))
    edges = changed.select(new_id.alias("from_id"), F.col("assertion_id").alias("to_id"), F.lit("corrects").alias("relation"), F.lit(revision).cast("long").alias("revision"))
    return replacements, retractions, edges


def commit(head: int, expected: int, dependencies: dict[str, int], heads: dict[str, int]) -> int:
    """The next revision, if nothing that the writer has read has changed since."""
    stale = sorted(k for k, seen in dependencies.items() if heads.get(k, 0) > seen)
    if stale or expected > head:
        raise QueryError(f"conflict: {stale or 'unknown head'}")
    return head + 1


def remap(records: DataFrame, columns: list[str], mapping: DataFrame) -> DataFrame:
    """Ids replaced by (source_id, target_id); those without a mapping stay."""
    for c in columns:
        own = mapping.select(F.col("source_id").alias("_from"), F.col("target_id").alias("_to"))
        records = records.join(own, records[c] == F.col("_from"), "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")
    return records


def import_collisions(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming ids that exist already or that two incoming records share."""
    taken = incoming.join(existing.select(key), key, "left_semi").select(key, F.lit("exists").alias("reason"))
    return taken.unionByName(repeated(incoming, key).select(key, F.lit("repeated").alias("reason"))).distinct()


def transfer_preview(store, ctx: Context, target_space: int) -> DataFrame:
    """(kind, n) of what a copy of the branch's content would take: assertions, lifecycle records that go with them, and archived ones left out."""
    rows = as_of(store.assertions, ctx)
    hidden = archived(store.archive_transitions, ctx.as_of).withColumnRenamed("target_id", "assertion_id")
    copied = stored(rows.join(hidden, "assertion_id", "left_anti").select("assertion_id", "cutoff"))
    parts = [copied.agg(F.lit("assertion").alias("kind"), F.count("*").alias("n")), rows.join(hidden, "assertion_id", "left_semi").agg(F.lit("archived_omitted").alias("kind"), F.count("*").alias("n"))]
    for kind, life in (("retraction", store.assertion_retractions), ("closure", store.assertion_closures)):
        own = life.join(copied, "assertion_id").filter(F.col("revision") <= F.col("cutoff"))
        parts.append(own.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


#: Families whose records stand in a branch, and their keys: what a copy or an export takes.
CONTENT = (("assertion", "assertions", "assertion_id"), ("mask", "masks", "mask_id"), ("boundary", "boundaries", "boundary_id"), ("event", "world_events", "event_id"))


def visible_content(store, ctx: Context) -> DataFrame:
    """(family, id, revision) of everything in the branch that can be copied."""
    return reduce(DataFrame.unionByName, [as_of(getattr(store, t), ctx).select(F.lit(f).alias("family"), F.col(k).alias("id"), "revision") for f, t, k in CONTENT])


def transfer(store, ctx: Context, target_space: int, revision: int, id_offset: int) -> tuple[DataFrame, DataFrame]:
    """Copies of the branch's assertions in another space at one revision, and their lineage."""
    rows = as_of(store.assertions, ctx).drop("distance", "cutoff")
    copies = rows.withColumns({"assertion_id": F.col("assertion_id") + id_offset, "space_id": F.lit(target_space).cast("long"), "revision": F.lit(revision).cast("long")}).select(*store.assertions.columns)
    lineage = rows.select(F.col("assertion_id").alias("source_id"), (F.col("assertion_id") + id_offset).alias("copy_id"), F.lit(revision).cast("long").alias("revision"))
    return copies, lineage


def transfer_content(store, ctx: Context, target_space: int, revision: int, id_offset: int) -> dict[str, DataFrame]:
    """Copies of all content of the branch, family by family, and their lineage; exact masks follow the assertions that they hide."""
    out, lineage = {}, []
    for family, table, key in CONTENT:
        rows = as_of(getattr(store, table), ctx).drop("distance", "cutoff")
        moved = {key: F.col(key) + id_offset, "space_id": F.lit(target_space).cast("long"), "revision": F.lit(revision).cast("long")}
        if family == "mask":
            moved["assertion_id"] = F.col("assertion_id") + id_offset
        out[table] = rows.withColumns(moved).select(*getattr(store, table).columns)
        lineage.append(rows.select(F.lit(family).alias("family"), F.col(key).alias("source_id"), (F.col(key) + id_offset).alias("copy_id"), F.lit(revision).cast("long").alias("revision")))
    return out | {"transfer_lineage": reduce(DataFrame.unionByName, lineage)}


def prepare_import(incoming: DataFrame, existing: DataFrame, key: str, mapping: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(reason, n) of what keeps an import from being written: ids that two records get, ids that exist, mapped ids that meet, references that lead nowhere."""
    mapped = remap(incoming, [key], mapping)
    checks = {"repeated": repeated(incoming, key), "exists": mapped.join(existing.select(key), key, "left_semi"), "mapped_together": repeated(mapped, key).join(repeated(incoming, key).select(key), key, "left_anti")}
    for column, (targets, target_key) in references.items():
        checks[f"dangling_{column}"] = dangling(incoming, column, targets, target_key)
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("reason"), F.count("*").alias("n")) for name, rows in checks.items()])


def purge_closure(edges: DataFrame, seeds: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """All nodes that depend on the seeds over (a, b), where b depends on a; the seeds included."""
    reached = frontier = stored(seeds.select("node").distinct())
    for _ in range(max_rounds):
        step = frontier.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = stored(step.join(reached, "node", "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
    raise QueryError("the dependencies are deeper than the number of rounds allowed")


def purge(records: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return records.join(gone.select(F.col("node").alias(key)), key, "left_anti")


def purge_report(store, gone: DataFrame) -> DataFrame:
    """(family, n) of what a purge of assertions would take with it: the assertions, their lifecycle, evidence for them, provenance at them."""
    node = gone.select(F.col("node").alias("assertion_id"))
    parts = {"assertion": store.assertions.join(node, "assertion_id", "left_semi"), "assertion_retraction": store.assertion_retractions.join(node, "assertion_id", "left_semi"), "assertion_closure": store.assertion_closures.join(node, "assertion_id", "left_semi"), "evidence": store.evidence.join(gone.select(F.col("node").alias("target_id")), "target_id", "left_semi")}
    ends = store.provenance.select("edge_id", F.explode(F.array("from_id", "to_id")).alias("node")).join(gone.select("node"), "node", "left_semi").select("edge_id").distinct()
    parts["provenance"] = ends
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(f).alias("family"), F.count("*").alias("n")) for f, rows in parts.items()])


def migrate_validity(assertions: DataFrame, years: int, months: int, days: int) -> DataFrame:
    """World time of assertions, in days, shifted by the calendar."""
    epoch = F.lit("1970-01-01").cast("date")

    def moved(c: str) -> Column:
        return F.datediff(calendar_shift(F.date_add(epoch, F.col(c).cast("int")), years, months, days), epoch).cast("long")

    return assertions.withColumns({"valid_start": moved("valid_start"), "valid_end": moved("valid_end")})


def estimate(records: DataFrame, columns: list[str]) -> DataFrame:
    """Records and bytes that a migration would touch."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns])
    return records.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_bytes"))


def export_rows(store, ctx: Context, first: int, last: int) -> DataFrame:
    """Assertions of the branch that were recorded in a range of revisions."""
    return as_of(store.assertions, ctx).filter(F.col("revision").between(first, last)).drop("distance", "cutoff")


def sharing_rows(store, ctx: Context, first: int, last: int, allowed: Column) -> DataFrame:
    """export_rows that may be read and whose every dependency may be read too; what is left out leaves no trace."""
    rows = stored(export_rows(store, ctx, first, last).filter(allowed))
    edges = store.provenance.filter(F.col("relation") == "derived_from").join(rows.select(F.col("assertion_id").alias("from_id")), "from_id", "left_semi")
    lacking = edges.join(rows.select(F.col("assertion_id").alias("to_id")), "to_id", "left_anti").select(F.col("from_id").alias("assertion_id"))
    return rows.join(lacking, "assertion_id", "left_anti")


def sharing_records(store, ctx: Context, first: int, last: int, rights) -> DataFrame:
    """(family, id, revision) of an export that a caller may share: records of the branch in a range of revisions that may be read, and of which everything that they refer to is in the export too.

    One pass, not a fixpoint: what a record refers to is held against the readable ones.  Nothing tells what was left out.
    """
    rows = stored(export_rows(store, ctx, first, last).filter(rights.assertions()).select("assertion_id", "revision"))
    ids = rows.select("assertion_id")
    between = F.col("revision").between(first, last)
    masks = as_of(store.masks, ctx).filter(between & rights.masks())
    exact = masks.filter(F.col("selector") == "exact").join(ids, "assertion_id", "left_semi").select("mask_id", "revision")
    masks = exact.unionByName(masks.filter(F.col("selector") != "exact").select("mask_id", "revision"))
    edges = store.provenance.filter(between & rights.provenance(ctx.space))
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.select(F.col("assertion_id").alias(end)), end, "left_semi")
    parts = {"assertion": (rows, "assertion_id"), "mask": (masks, "mask_id"), "provenance": (edges, "edge_id")}
    for family, life, key, owner in (("assertion_retraction", store.assertion_retractions, "assertion_id", ids), ("assertion_closure", store.assertion_closures, "assertion_id", ids), ("mask_retraction", store.mask_retractions, "mask_id", masks), ("mask_closure", store.mask_closures, "mask_id", masks)):
        parts[family] = (life.filter(between).join(owner.select(key), key, "left_semi"), key)
    return reduce(DataFrame.unionByName, [r.select(F.lit(f).alias("family"), F.col(k).alias("id"), "revision") for f, (r, k) in parts.items()])


def class_summary(store, revision: int) -> DataFrame:
    """(family, n) for every family, empty ones included."""
    return reduce(DataFrame.unionByName, [raw_log(getattr(store, t), revision).agg(F.lit(f).alias("family"), F.count("*").alias("n")) for f, t, _, _ in RAW_FAMILIES])


def alternation_errors(transitions: DataFrame) -> DataFrame:
    """Archive transitions that repeat the one before them; the first one archives."""
    keys = [c for c in ("target_kind", "target_id") if c in transitions.columns]
    before = F.lag("action").over(Window.partitionBy(*keys).orderBy("revision"))
    return transitions.withColumn("before", before).filter(F.coalesce(F.col("action") == F.col("before"), F.col("action") == "unarchive")).select("target_id", "action", "revision")


def write_export(rows: DataFrame, path: str) -> None:
    """An export: the rows, and a summary that tells whether they are whole."""
    rows.write.parquet(f"{path}/rows")
    kept = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    kept.agg(F.count("*").alias("n"), digest_of(kept).alias("digest")).write.json(f"{path}/summary")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an export, or an error if their number or digest isn't that of its summary."""
    rows = spark.read.parquet(f"{path}/rows")
    want = spark.read.schema("n long, digest string").json(f"{path}/summary").first()
    got = rows.agg(F.count("*").alias("n"), digest_of(rows).alias("digest")).first()
    if want is None or (got.n, got.digest) != (want.n, want.digest):
        raise QueryError("the export is not whole")
    return rows


def admin_raw_read(store, rights, database, revision: int, reason: str) -> DataFrame:
    """The raw history for an administrator; the attempt is recorded durably before anything is given out."""
    head = database.head()
    row = store.spark.createDataFrame([(rights.principal, revision, reason, rights.may("admin_raw_read"))], "principal string, revision long, reason string, allowed boolean")
    database.append({"audit": row}, head)
    rights.demand("admin_raw_read")
    return raw_history(store, revision)


def corpus(spark: SparkSession, n: int) -> DataFrame:
    """Assertions of a benchmark, from their number alone: four fifths on 128 entities, three quarters on 16 predicates."""
    mixed = (F.col("id") * F.lit(2654435761)) % F.lit(1 << 32)
    part = lambda k: F.floor(mixed / F.lit(k)).cast("long")
    entity = F.when(part(1) % 5 < 4, 1 + part(7) % 128).otherwise(129 + part(11) % 100_000)
    predicate = F.when(part(13) % 4 < 3, 1 + part(17) % 16).otherwise(17 + part(19) % 500)
    return spark.range(n).select(F.col("id").alias("assertion_id"), entity.alias("subject_id"), predicate.alias("predicate_id"), (1 + part(23) % 100).alias("space_id"), (part(29) % 3).alias("layer_id"), (part(31) % 5 == 0).alias("masked"))

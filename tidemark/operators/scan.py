"""As-of scans and candidate scans of assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.context import Context, QueryError, level, literal_map, precedence


#: Ancestries of up to so many branches become literals of the expression; longer ones are joined.
LITERAL_BRANCHES = 200


def as_of(records: DataFrame, ctx: Context) -> DataFrame:
    """Records of the branch and its ancestors, each ancestor up to its cutoff; adds distance and cutoff."""
    line = ctx.ancestry()
    if len(line) > LITERAL_BRANCHES:
        return records.join(ctx.visible_spaces(records.sparkSession), "space_id").filter(F.col("revision") <= F.col("cutoff"))
    seen = records.filter(F.col("space_id").isin([s for s, _, _ in line]))
    added = {"distance": literal_map([(s, d) for s, d, _ in line], F.col("space_id")).cast("int"), "cutoff": literal_map([(s, c) for s, _, c in line], F.col("space_id"))}
    return seen.withColumns(added).filter(F.col("revision") <= F.col("cutoff"))


def raw_log(records: DataFrame, revision: int) -> DataFrame:
    """All records of a family up to a revision, whatever their branch."""
    return records.filter(F.col("revision") <= revision)


def contains(start: str, end: str, t: Column) -> Column:
    """Whether a half-open interval, open where null, holds t."""
    return (F.col(start).isNull() | (F.col(start) <= t)) & (F.col(end).isNull() | (t < F.col(end)))


def overlaps(start: str, end: str, window_start: int, window_end: int) -> Column:
    """Whether a half-open interval, open where null, has a point of the window."""
    return (F.col(start).isNull() | (F.col(start) < window_end)) & (F.col(end).isNull() | (F.col(end) > window_start))


def latest(records: DataFrame, key: str | list[str], revision: int) -> DataFrame:
    """The last record of each key at a revision, as one aggregate instead of a window."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in records.columns if c not in (*keys, "revision")]
    top = F.max(F.struct("revision", *rest)).alias("top")
    return records.filter(F.col("revision") <= revision).groupBy(*keys).agg(top).select(*keys, "top.*")


def archived(transitions: DataFrame, revision: int, kind: str = "assertion") -> DataFrame:
    """Ids of a kind whose last transition at the revision archived them."""
    own = transitions.filter(F.col("target_kind") == kind) if "target_kind" in transitions.columns else transitions
    last = lambda action: F.max(F.when(F.col("action") == action, F.col("revision")))
    ends = raw_log(own, revision).groupBy("target_id").agg(last("archive").alias("shut"), last("unarchive").alias("open"))
    return ends.filter(F.col("shut").isNotNull() & (F.col("open").isNull() | (F.col("open") < F.col("shut")))).select("target_id")


def unarchived(records: DataFrame, key: str, transitions: DataFrame, revision: int, kind: str) -> DataFrame:
    hidden = archived(transitions, revision, kind).withColumnRenamed("target_id", key)
    return records.join(hidden, key, "left_anti")


def partition(records: DataFrame, ctx: Context) -> DataFrame:
    """Records of the context's perspective, mode and layers."""
    ids = [layer for layer, _ in ctx.selected_layers()]
    return records.filter((F.col("perspective_id") == ctx.perspective) & (F.col("mode") == ctx.mode) & F.col("layer_id").isin(ids))


def unretracted(records: DataFrame, retractions: DataFrame, key: str) -> DataFrame:
    """Records without a retraction that their own branch cutoff lets through."""
    gone = retractions.groupBy(key).agg(F.min("revision").alias("retracted_at"))
    return records.join(gone, key, "left").filter(F.col("retracted_at").isNull() | (F.col("retracted_at") > F.col("cutoff"))).drop("retracted_at")


def with_closures(records: DataFrame, closures: DataFrame, key: str) -> DataFrame:
    """Records with ``ends``, their closures as (revision, close_at): one for a record of a valid store, so they are few."""
    ends = closures.groupBy(key).agg(F.collect_list(F.struct("revision", "close_at")).alias("ends"))
    return records.join(ends, key, "left")


def closed_at() -> Column:
    """The earliest end that a visible closure gives a record ``with_closures``; null without any."""
    return F.array_min(F.transform(F.filter("ends", lambda e: e["revision"] <= F.col("cutoff")), lambda e: e["close_at"]))


def open_at(records: DataFrame, closures: DataFrame, key: str, t: Column) -> DataFrame:
    """Records whose validity no visible closure has ended at t."""
    rows = with_closures(records, closures, key)
    return rows.filter(F.col("ends").isNull() | ~F.exists("ends", lambda e: (e["revision"] <= F.col("cutoff")) & (e["close_at"] <= t))).drop("ends")


def candidates(store, ctx: Context, *, subject: int | None = None, predicate: int | None = None, allowed: Column | None = None, cutoff: bool = False) -> DataFrame:
    """Assertions that may take part at the context's world time, with their precedence and its level.

    Rights are a filter on the records themselves, so hidden ones influence nothing that follows.
    """
    rows = store.assertions
    if subject is not None:
        rows = rows.filter(F.col("subject_id") == subject)
    if predicate is not None:
        rows = rows.filter(F.col("predicate_id") == predicate)
    if allowed is not None:
        rows = rows.filter(allowed)
    rows = as_of(partition(rows, ctx), ctx)
    rows = unretracted(rows, store.assertion_retractions, "assertion_id")
    if ctx.world_time is not None:
        t = F.lit(ctx.world_time)
        rows = open_at(rows.filter(contains("valid_start", "valid_end", t)), store.assertion_closures, "assertion_id", t)
    rows = unarchived(rows, "assertion_id", store.archive_transitions, ctx.as_of, "assertion")
    rows = rows.withColumns({"prec": precedence(ctx), "level": level(ctx)})
    return rows if cutoff else rows.drop("cutoff")


def history(store, ctx: Context, *, subject: int | None = None, predicate: int | None = None) -> DataFrame:
    """Assertions of a subject, a predicate or a slot in the branch, by revision and id."""
    rows = store.assertions
    if subject is not None:
        rows = rows.filter(F.col("subject_id") == subject)
    if predicate is not None:
        rows = rows.filter(F.col("predicate_id") == predicate)
    return as_of(partition(rows, ctx), ctx).orderBy("revision", "assertion_id")


#: Tag order of families: name, table, key, and the table and key that say in which branch a record stands (None: in none).
RAW_FAMILIES = [
    ("assertion", "assertions", "assertion_id", ("assertions", "assertion_id")),
    ("assertion_retraction", "assertion_retractions", "assertion_id", ("assertions", "assertion_id")),
    ("assertion_closure", "assertion_closures", "assertion_id", ("assertions", "assertion_id")),
    ("mask", "masks", "mask_id", ("masks", "mask_id")),
    ("mask_retraction", "mask_retractions", "mask_id", ("masks", "mask_id")),
    ("mask_closure", "mask_closures", "mask_id", ("masks", "mask_id")),
    ("boundary", "boundaries", "boundary_id", ("boundaries", "boundary_id")),
    ("boundary_retraction", "boundary_retractions", "boundary_id", ("boundaries", "boundary_id")),
    ("boundary_closure", "boundary_closures", "boundary_id", ("boundaries", "boundary_id")),
    ("event", "world_events", "event_id", ("world_events", "event_id")),
    ("event_span_closure", "event_span_closures", "event_id", ("world_events", "event_id")),
    ("event_retraction", "event_retractions", "event_id", ("world_events", "event_id")),
    ("event_mask", "event_masks", "event_mask_id", ("event_masks", "event_mask_id")),
    ("event_relation", "event_relations", "relation_id", None),
    ("event_relation_retraction", "event_relation_retractions", "relation_id", None),
    ("source", "sources", "source_id", None),
    ("evidence", "evidence", "evidence_id", None),
    ("evidence_retraction", "evidence_retractions", "evidence_id", None),
    ("provenance", "provenance", "edge_id", None),
    ("provenance_retraction", "provenance_retractions", "edge_id", None),
    ("archive_transition", "archive_transitions", "transition_id", None),
]


def canonical(rows: DataFrame) -> DataFrame:
    """(tag, family, id, revision) in the order of tag and id; a record that stands twice fails the query."""
    keys = ["tag", "family", "id", "revision"] + (["kind"] if "kind" in rows.columns else [])
    once = F.when(F.count("*") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a record stands twice in the raw history")).cast("boolean"))
    return rows.groupBy(*keys).agg(once.alias("once")).filter("once").select("tag", "family", "id", "revision").orderBy("tag", "id", "revision")


def raw_history(store, revision: int, rights=None) -> DataFrame:
    """All records of all families at a revision, as (tag, family, id, revision) in canonical order.

    With rights, only records that may be read raw; a lifecycle record stands in the branch of what it
    belongs to.  No archive state, mask or retraction hides anything here.
    """
    if rights is not None:
        rights.demand("raw_history_read")
    out = None
    for tag, (name, table, key, owner) in enumerate(RAW_FAMILIES):
        rows = raw_log(getattr(store, table), revision)
        if rights is not None:
            if "space_id" not in rows.columns:
                known = getattr(store, owner[0]).select(key, "space_id") if owner else None
                rows = rows.join(known, key) if owner else rows.withColumn("space_id", F.lit(None).cast("long"))
            rows = rows.filter(rights.raw(name, key=key))
        kind = F.col("target_kind") if "target_kind" in rows.columns else F.lit("")
        rows = rows.select(F.lit(tag).alias("tag"), F.lit(name).alias("family"), F.col(key).cast("long").alias("id"), F.col("revision").cast("long").alias("revision"), kind.alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return canonical(out)


def lifecycle(store, revision: int, target: int | None = None) -> DataFrame:
    """(kind, assertion_id, revision) of retractions and closures through a revision, of one assertion or of all."""
    parts = [raw_log(rows, revision).select(F.lit(kind).alias("kind"), "assertion_id", "revision") for kind, rows in (("retraction", store.assertion_retractions), ("closure", store.assertion_closures))]
    out = parts[0].unionByName(parts[1])
    return out if target is None else out.filter(F.col("assertion_id") == target)


def record(store, family: str, number: int) -> DataFrame:
    """One record by its typed id; an unknown family is refused."""
    for name, table, key, _ in RAW_FAMILIES:
        if name == family:
            return getattr(store, table).filter(F.col(key) == number)
    raise QueryError(f"unknown family {family}")


def definitions(store, predicate: int, revision: int | None = None) -> DataFrame:
    """The revisions of a predicate's definition, the earliest first."""
    rows = store.schema_predicates.filter(F.col("predicate_id") == predicate)
    return (rows if revision is None else raw_log(rows, revision)).orderBy("revision")


def valid_at(store, t: int) -> DataFrame:
    """(family, id) of assertions, masks and boundaries whose validity holds t, those without one included."""
    out = None
    for name, table, key in (("assertion", "assertions", "assertion_id"), ("mask", "masks", "mask_id"), ("boundary", "boundaries", "boundary_id")):
        rows = getattr(store, table).filter(contains("valid_start", "valid_end", F.lit(t))).select(F.lit(name).alias("family"), F.col(key).alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def slot_history(store, ctx: Context, subject: int, predicate: int) -> DataFrame:
    """(family, id, revision) of all history of one slot that the branch sees: assertions, masks that may hide some of them, boundaries, and the lifecycle of each."""
    assertions = history(store, ctx, subject=subject, predicate=predicate).select("assertion_id", "revision", "cutoff")
    own = (F.col("subject_id") == subject) & (F.col("predicate_id") == predicate)
    spaces = F.col("space_id").isin(ctx.space_ids())
    masks = partition(raw_log(store.masks, ctx.as_of), ctx).filter(spaces)
    exact = masks.filter(F.col("selector") == "exact").join(assertions.select("assertion_id"), "assertion_id", "left_semi")
    masks = exact.unionByName(masks.filter((F.col("selector") != "exact") & own).select(exact.columns))
    boundaries = partition(raw_log(store.boundaries, ctx.as_of), ctx).filter(own & spaces)
    parts = [assertions.select(F.lit("assertion").alias("family"), F.col("assertion_id").alias("id"), "revision")]
    for name, rows in (("assertion_retraction", store.assertion_retractions), ("assertion_closure", store.assertion_closures)):
        seen = rows.join(assertions.select("assertion_id", "cutoff"), "assertion_id").filter(F.col("revision") <= F.col("cutoff"))
        parts.append(seen.select(F.lit(name).alias("family"), F.col("assertion_id").alias("id"), "revision"))
    for name, key, rows, life in (("mask", "mask_id", masks, {"mask_retraction": store.mask_retractions, "mask_closure": store.mask_closures}), ("boundary", "boundary_id", boundaries, {"boundary_retraction": store.boundary_retractions, "boundary_closure": store.boundary_closures})):
        parts.append(rows.select(F.lit(name).alias("family"), F.col(key).alias("id"), "revision"))
        for kind, records in life.items():
            parts.append(raw_log(records, ctx.as_of).join(rows.select(key), key, "left_semi").select(F.lit(kind).alias("family"), F.col(key).alias("id"), "revision"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# catalogs

def entities(store, revision: int) -> DataFrame:
    """Entities at a revision, with the revision that retired them."""
    gone = raw_log(store.entity_retirements, revision).groupBy("entity_id").agg(F.min("revision").alias("retired_at"))
    return raw_log(store.entities, revision).join(gone, "entity_id", "left").select("entity_id", "entity_type", "retired_at")


def perspectives(store, revision: int) -> DataFrame:
    """The last definition of each perspective at a revision, and whether it is retired."""
    gone = raw_log(store.perspective_retirements, revision).groupBy("perspective_id").agg(F.max("revision").alias("retired_at"))
    return latest(store.perspectives, "perspective_id", revision).join(gone, "perspective_id", "left").select("perspective_id", "label", F.coalesce(F.col("retired_at") >= F.col("revision"), F.lit(False)).alias("retired"))


def project(store, revision: int) -> DataFrame:
    """(kind, id, detail) of the project at a revision: branches, layers and predicates."""
    spaces = store.history_spaces.filter(F.col("base_revision") <= revision).select(F.lit("space").alias("kind"), F.col("space_id").alias("id"), F.concat_ws(":", F.col("parent_id").cast("string"), F.col("base_revision").cast("string")).alias("detail"))
    layers = store.layers.select(F.lit("layer").alias("kind"), F.col("layer_id").alias("id"), F.col("layer_rank").cast("string").alias("detail"))
    predicates = latest(store.schema_predicates, "predicate_id", revision).select(F.lit("predicate").alias("kind"), F.col("predicate_id").alias("id"), F.col("policy").alias("detail"))
    return spaces.unionByName(layers).unionByName(predicates.withColumn("id", F.col("id").cast("long")))


def facts(store, revision: int, rights=None) -> DataFrame:
    """(family, id) of typed facts at a revision that may be read: assertions, masks, boundaries, events."""
    out = None
    for name, table, key, right in (("assertion", "assertions", "assertion_id", "assertions"), ("mask", "masks", "mask_id", "masks"), ("boundary", "boundaries", "boundary_id", "boundaries"), ("event", "world_events", "event_id", "events")):
        rows = raw_log(getattr(store, table), revision)
        rows = rows if rights is None else rows.filter(getattr(rights, right)())
        rows = rows.select(F.lit(name).alias("family"), F.col(key).alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out

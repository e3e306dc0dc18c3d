"""What a transaction must hold before it is committed, and the records that it writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.operators import evidence as I
from tidemark.operators.movement import dangling, repeated
from tidemark.operators.security import Target, all_of, column
from tidemark.plans.context import Context, QueryError

LIFECYCLE = ("active", "deprecated", "retired")


def _counted(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n) for every check, those that hold included."""
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("check"), F.count("*").alias("n")) for name, rows in checks.items()])


def relations_after(store, ctx: Context, added: DataFrame | None = None, retracted: DataFrame | None = None) -> DataFrame:
    """Active relations as a transaction would leave them: without those it retracts, with those it adds, in normal form."""
    rows = E.active_relations(store, ctx.as_of).select("relation_id", "kind", "from_id", "to_id")
    if retracted is not None:
        rows = rows.join(retracted.select("relation_id"), "relation_id", "left_anti")
    if added is not None:
        kind, a, b = E.normalized_relation(F.col("kind"), F.col("from_id"), F.col("to_id"))
        rows = rows.unionByName(added.select("relation_id", kind.alias("kind"), a.alias("from_id"), b.alias("to_id")))
    return rows


def relation_errors(store, ctx: Context, added: DataFrame | None = None, retracted: DataFrame | None = None) -> DataFrame:
    """(check, n) of the whole event graph after a transaction: repeated relations, ends that don't exist, and cycles."""
    rows = relations_after(store, ctx, added, retracted)
    ends = rows.select("relation_id", F.explode(F.array("from_id", "to_id")).alias("event_id"))
    return _counted({"repeated_relations": E.repeated_relations(rows), "relations_without_event": dangling(ends, "event_id", store.world_events, "event_id"), "before_cycle": E.before_residue(rows), "causes_cycle": E.causes_residue(rows)})


def provenance_errors(store, ctx: Context, added: DataFrame | None = None, retracted: DataFrame | None = None) -> DataFrame:
    """(check, n) of the provenance graph after a transaction: repeated edges, self loops and cycles of dependencies."""
    rows = I.active_provenance(store, ctx.as_of).select("edge_id", "from_id", "to_id", "relation")
    if retracted is not None:
        rows = rows.join(retracted.select("edge_id"), "edge_id", "left_anti")
    if added is not None:
        rows = rows.unionByName(added.select(rows.columns))
    return _counted({"repeated_edges": I.duplicates(rows), "self_loops": rows.filter("from_id = to_id"), "dependency_cycle": E.cycle_residue(I.dependencies(rows))})


def transaction_errors(store, ctx: Context, *, assertions: DataFrame | None = None, relations: DataFrame | None = None, provenance: DataFrame | None = None) -> DataFrame:
    """(check, n) over all records of a transaction together: ids, references, and both graphs."""
    parts = [relation_errors(store, ctx, relations), provenance_errors(store, ctx, provenance)]
    if assertions is not None:
        taken = assertions.select("assertion_id").unionByName(store.assertions.join(assertions.select("assertion_id"), "assertion_id", "left_semi").select("assertion_id"))
        parts.append(_counted({"repeated_assertions": repeated(taken, "assertion_id"), "assertions_without_branch": dangling(assertions, "space_id", store.history_spaces, "space_id"), "assertions_without_layer": dangling(assertions, "layer_id", store.layers, "layer_id")}))
    return reduce(DataFrame.unionByName, parts)


def unwritable(batch: DataFrame, rights) -> DataFrame:
    """Drafts that the caller may not write: the branch must be readable, the layer writable, and each field."""
    target = Target(F.col("space_id"), F.col("layer_id"), "assertion", F.col("assertion_id"))
    right = all_of(rights.policy, rights.principal, target, ("history_space_read", "layer_write", "assertion_create"))
    return batch.filter(~column(right)).select("assertion_id")


def lifecycle_errors(records: DataFrame, key: str, closures: DataFrame, retractions: DataFrame) -> DataFrame:
    """(key, reason) of lifecycle records of masks or boundaries that can't be: without a record, before it, or a second of a kind."""
    out = None
    for name, rows in (("closure", closures), ("retraction", retractions)):
        own = rows.select(key, F.col("revision").alias("at")).join(records.select(key, "revision"), key, "left")
        reason = F.when(F.col("revision").isNull(), f"{name}_without_record").when(F.col("at") < F.col("revision"), f"{name}_before_record")
        part = own.withColumn("reason", reason).filter("reason IS NOT NULL").select(key, "reason")
        part = part.unionByName(repeated(rows, key).select(key, F.lit(f"{name}_twice").alias("reason")))
        out = part if out is None else out.unionByName(part)
    return out


def correct_events(events: DataFrame, changes: DataFrame, revision: int, id_offset: int) -> tuple[DataFrame, DataFrame]:
    """Corrected events under new ids, and corrects edges to the old ones, at one revision; nothing is retracted.

    ``changes`` has event_id and the new start_us and end_us; kind, branch, layer and participants stay.
    """
    new = changes.select("event_id", F.col("start_us").alias("new_start"), F.col("end_us").alias("new_end"))
    changed = events.join(new, "event_id")
    number = F.col("event_id") + id_offset
    made = changed.withColumns({"start_us": F.col("new_start"), "end_us": F.col("new_end"), "revision": F.lit(revision).cast("long"), "event_id": number}).select(events.columns)
    edges = changed.select(number.alias("from_id"), F.col("event_id").alias("to_id"), F.lit("corrects").alias("relation"), F.lit(revision).cast("long").alias("revision"))
    return made, edges


def supersede_sources(sources: DataFrame, changes: DataFrame, revision: int, id_offset: int) -> tuple[DataFrame, DataFrame]:
    """Sources with a new locator under new ids, and corrects edges to the old ones."""
    changed = sources.join(changes.select("source_id", F.col("locator").alias("new_locator")), "source_id")
    number = F.col("source_id") + id_offset
    made = changed.withColumns({"locator": F.col("new_locator"), "revision": F.lit(revision).cast("long"), "source_id": number}).select(sources.columns)
    edges = changed.select(number.alias("from_id"), F.col("source_id").alias("to_id"), F.lit("corrects").alias("relation"), F.lit(revision).cast("long").alias("revision"))
    return made, edges


def retract(records: DataFrame, key: str, ids: DataFrame, revision: int) -> DataFrame:
    """Retractions of known records at a revision; an unknown id fails the query."""
    known = records.select(F.col(key), F.lit(True).alias("known"))
    sure = F.coalesce("known", F.raise_error(F.lit("no such record")).cast("boolean"))
    return ids.select(key).distinct().join(known, key, "left").filter(sure).select(key, F.lit(revision).cast("long").alias("revision"))


def publish_schema(definitions: DataFrame, drafts: DataFrame, revision: int) -> DataFrame:
    """Rows to append to the definitions; the lifecycle only goes on, from active to deprecated to retired."""
    place = F.create_map(*(x for k, name in enumerate(LIFECYCLE) for x in (F.lit(name), F.lit(k))))
    newest = definitions.groupBy("predicate_id").agg(F.max_by("lifecycle", "revision").alias("now"), F.max("revision").alias("last"))
    bad = F.when(place[F.col("lifecycle")].isNull(), "unknown lifecycle").when(F.col("now").isNotNull() & (place[F.col("lifecycle")] < place[F.col("now")]), "a lifecycle doesn't go back").when(F.col("last") >= revision, "the revision is not new")
    rows = drafts.join(newest, "predicate_id", "left").withColumn("bad", bad)
    fine = F.when(F.col("bad").isNull(), F.lit(True)).otherwise(F.raise_error("bad").cast("boolean"))
    return rows.filter(fine).withColumn("revision", F.lit(revision).cast("long")).select(definitions.columns)


def with_branch(spaces: tuple, number: int, parent: int | None, base: int, head: int) -> tuple:
    """The catalog with one more branch; its base is a revision that the parent has, a root's is 0."""
    known = {s for s, _, _ in spaces}
    if number in known or (parent is not None and parent not in known):
        raise QueryError("the branch exists, or its parent doesn't")
    if not 0 <= base <= head or (parent is None and base):
        raise QueryError("no such base revision")
    return (*spaces, (number, parent, base))


def with_layer(layers: tuple, number: int, rank: int) -> tuple:
    """The catalog with a new layer, or a new rank of one; ranks are unique, so the base layer is."""
    rest = tuple(x for x in layers if x[0] != number)
    if rank in {r for _, r in rest}:
        raise QueryError("two layers of one rank")
    return (*rest, (number, rank))


def perspective_change(perspectives: DataFrame, retirements: DataFrame, drafts: DataFrame, revision: int) -> DataFrame:
    """New or changed perspectives to append; retired ones don't change."""
    gone = retirements.select("perspective_id").distinct().withColumn("gone", F.lit(True))
    sure = F.when(F.col("gone").isNull(), F.lit(True)).otherwise(F.raise_error(F.lit("the perspective is retired")).cast("boolean"))
    return drafts.join(gone, "perspective_id", "left").filter(sure).withColumn("revision", F.lit(revision).cast("long")).select(perspectives.columns)


def archive(transitions: DataFrame, targets: DataFrame, action: str, revision: int) -> DataFrame:
    """Transitions to append; archive and unarchive alternate, the first is archive."""
    state = transitions.groupBy("target_id").agg(F.max_by("action", "revision").alias("now"))
    fits = F.coalesce("now", F.lit("unarchive")) != action
    sure = F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit(f"already {action}d, or never archived")).cast("boolean"))
    return targets.select("target_id").distinct().join(state, "target_id", "left").filter(sure).select("target_id", F.lit(action).alias("action"), F.lit(revision).cast("long").alias("revision"))

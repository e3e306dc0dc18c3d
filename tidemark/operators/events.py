"""Visibility of events, their times, and the graph of relations between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components, stored
from tidemark.operators.scan import raw_log, unarchived
from tidemark.plans.context import Context, QueryError, precedence


def in_layers(rows: DataFrame, ctx: Context) -> DataFrame:
    return rows.filter(F.col("layer_id").isin([x for x, _ in ctx.selected_layers()]))


def effective_end(store, events: DataFrame, ctx: Context) -> DataFrame:
    """Adds the end of the effective time: an open span takes its visible closure.  Stored times stay as they are."""
    closed = raw_log(store.event_span_closures, ctx.as_of).groupBy("event_id").agg(F.min("close_at").alias("close_at"))
    end = F.when(F.col("is_span") & F.col("end_us").isNull(), F.col("close_at")).otherwise(F.col("end_us"))
    return events.join(closed, "event_id", "left").withColumn("effective_end", end).drop("close_at")


def happens_at(t: int) -> Column:
    """Instants at t, and spans that hold t."""
    span = (F.col("start_us") <= t) & (F.col("effective_end").isNull() | (F.col("effective_end") > t))
    return F.when(F.col("is_span"), span).otherwise(F.col("start_us") == t)


def happens_within(start: int, end: int) -> Column:
    """Instants in [start, end), and spans that overlap it."""
    span = (F.col("start_us") < end) & (F.col("effective_end").isNull() | (F.col("effective_end") > start))
    return F.when(F.col("is_span"), span).otherwise((F.col("start_us") >= start) & (F.col("start_us") < end))


def of_known_kind(events: DataFrame, kinds: DataFrame, revision: int) -> DataFrame:
    """Events, or an error if the schema doesn't know the kind of one."""
    known = raw_log(kinds, revision).select("kind").distinct().withColumn("known", F.lit(True))
    sure = F.coalesce("known", F.raise_error(F.concat(F.lit("unknown event kind "), F.col("kind"))).cast("boolean"))
    return events.join(known, "kind", "left").filter(sure).select(events.columns)


def event_masks(store, ctx: Context, rights=None) -> DataFrame:
    """Event masks recorded, selected and not retracted, with their precedence."""
    rows = in_layers(raw_log(store.event_masks, ctx.as_of), ctx)
    rows = rows if rights is None else rows.filter(rights.event_masks())
    gone = raw_log(store.event_mask_retractions, ctx.as_of).select("event_mask_id").distinct()
    return rows.join(gone, "event_mask_id", "left_anti").withColumn("mask_prec", precedence(ctx)).filter(F.col("mask_prec").isNotNull())


def visible_events(store, ctx: Context, *, at: int | None = None, within: tuple[int, int] | None = None, rights=None) -> DataFrame:
    """Events of the ancestry that are recorded, selected, unarchived, of a known kind, and neither retracted nor hidden by a mask of strictly higher precedence.

    Branch cutoffs don't apply to events.  Rights come first, so a hidden event takes its lifecycle with it.
    """
    rows = in_layers(raw_log(store.world_events, ctx.as_of), ctx)
    if rights is not None:
        rows = rows.filter(rights.events())
    rows = of_known_kind(rows.withColumn("prec", precedence(ctx)).filter(F.col("prec").isNotNull()), store.event_kinds, ctx.as_of)
    rows = rows.join(raw_log(store.event_retractions, ctx.as_of).select("event_id"), "event_id", "left_anti")
    rows = unarchived(rows, "event_id", store.event_archive_transitions, ctx.as_of, "event")
    top = event_masks(store, ctx, rights).groupBy("event_id").agg(F.max("mask_prec").alias("mask_prec"))
    rows = rows.join(top, "event_id", "left").filter(F.col("mask_prec").isNull() | (F.col("mask_prec") <= F.col("prec"))).drop("mask_prec")
    rows = effective_end(store, rows, ctx)
    if at is not None:
        rows = rows.filter(happens_at(at))
    if within is not None:
        rows = rows.filter(happens_within(*within))
    return rows


def normalized_relation(kind: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """after becomes before with its ends swapped; ends of same_time stand in order."""
    swap = kind == "after"
    same = kind == "same_time"
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(swap, F.lit("before")).otherwise(kind), F.when(same, low).when(swap, b).otherwise(a), F.when(same, high).when(swap, a).otherwise(b)


def active_relations(store, revision: int) -> DataFrame:
    """Relations recorded and not retracted at a revision, in their normal form."""
    gone = raw_log(store.event_relation_retractions, revision).select("relation_id")
    rows = raw_log(store.event_relations, revision).join(gone, "relation_id", "left_anti")
    kind, a, b = normalized_relation(F.col("kind"), F.col("from_id"), F.col("to_id"))
    return rows.select("relation_id", kind.alias("kind"), a.alias("from_id"), b.alias("to_id"), "revision")


def repeated_relations(relations: DataFrame) -> DataFrame:
    """Relations that are stated more than once."""
    return relations.groupBy("kind", "from_id", "to_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def neighbours(relations: DataFrame, event: int, kind: str | None = None) -> DataFrame:
    """Relations at an event, of one kind or of all."""
    rows = relations.filter((F.col("from_id") == event) | (F.col("to_id") == event))
    return rows if kind is None else rows.filter(F.col("kind") == kind)


def of_participant(events: DataFrame, participant: int, role: str | None = None) -> DataFrame:
    rows = events.filter(F.col("participant_id") == participant)
    return rows if role is None else rows.filter(F.col("role") == role)


def visible_relations(store, ctx: Context, rights=None) -> DataFrame:
    """Active relations that may be read, between events that both are visible."""
    ids = stored(visible_events(store, ctx, rights=rights).select("event_id"))
    edges = active_relations(store, ctx.as_of)
    if rights is not None:
        edges = edges.filter(rights.event_relations())
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.select(F.col("event_id").alias(end)), end, "left_semi")
    return edges.select("relation_id", "kind", "from_id", "to_id", "revision")


def same_time_components(relations: DataFrame) -> DataFrame:
    """(event_id, representative) of events tied by same_time: the least id stands for all."""
    edges = relations.filter(F.col("kind") == "same_time").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return connected_components(edges).select(F.col("node").alias("event_id"), F.col("root").alias("representative"))


def cycle_residue(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Nodes of (a, b) that remain after nodes without incoming edges are taken off again and again.

    No node remains exactly if there is no cycle.  Every round is a semi join of the edges that are
    left, written to the shared folder; only their number comes to the driver.
    """
    left = stored(edges.select("a", "b").distinct())
    count = left.count()
    for _ in range(max_rounds):
        targets = left.select(F.col("b").alias("a")).distinct()
        left = stored(left.join(targets, "a", "left_semi"))
        now = left.count()
        if now in (count, 0):
            return left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        count = now
    raise QueryError("the graph is deeper than the number of rounds allowed")


def before_residue(relations: DataFrame) -> DataFrame:
    """Events in or behind cycles of before, where events of the same time count as one."""
    named = same_time_components(relations)
    edges = relations.filter(F.col("kind") == "before")
    for end, out in (("from_id", "a"), ("to_id", "b")):
        names = named.select(F.col("event_id").alias(end), F.col("representative").alias(out))
        edges = edges.join(names, end, "left").withColumn(out, F.coalesce(out, end))
    return cycle_residue(edges.select("a", "b"))


def causes_residue(relations: DataFrame) -> DataFrame:
    """Events in or behind cycles of causes."""
    return cycle_residue(relations.filter(F.col("kind") == "causes").select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))


def participant_errors(events: DataFrame, kinds: DataFrame) -> DataFrame:
    """(event_id, role, n, reason): roles that a kind doesn't have, participants named twice, and numbers outside the kind's bounds."""
    counts = events.groupBy("event_id", "kind", "role").agg(F.count("*").alias("n"), F.countDistinct("participant_id").alias("different"))
    rules = kinds.select("kind", "role", "min_participants", "max_participants")
    rows = counts.join(rules, ["kind", "role"], "left")
    reason = F.when(F.col("min_participants").isNull(), "unknown_role").when(F.col("n") > F.col("different"), "named_twice").when(F.col("n") < F.col("min_participants"), "too_few").when(F.col("n") > F.col("max_participants"), "too_many")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").select("event_id", "role", "n", "reason")


def participant_counts(events: DataFrame) -> DataFrame:
    """Participants of each event by role, to be held against the cardinality of the kind."""
    return events.groupBy("event_id", "role").agg(F.count("*").alias("n"))

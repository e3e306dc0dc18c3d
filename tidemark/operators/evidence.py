"""Evidence for records, and provenance edges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import raw_log
from tidemark.plans.context import Context


def evidence_history(store, ctx: Context, rights=None) -> DataFrame:
    """Evidence with a source at the revision, for targets that the branch sees; retracted edges stay, with the least revision that retracts them.

    With rights: only from sources and for targets that may be read, and where the edge itself may.
    """
    sources, rows = raw_log(store.sources, ctx.as_of), raw_log(store.evidence, ctx.as_of)
    if rights is not None:
        sources, rows = sources.filter(rights.sources()), rows.filter(rights.evidence_targets() & rights.evidence(ctx.space))
    seen = ctx.visible_spaces(store.spark).withColumnRenamed("space_id", "target_space_id")
    rows = rows.join(sources.select("source_id", "locator"), "source_id").join(seen, "target_space_id").filter(F.col("target_revision") <= F.col("cutoff"))
    gone = raw_log(store.evidence_retractions, ctx.as_of).groupBy("evidence_id").agg(F.min("revision").alias("retracted_at"))
    state = F.when(F.col("retracted_at").isNull(), "active").otherwise("retracted")
    return rows.join(gone, "evidence_id", "left").select("evidence_id", "source_id", "locator", "target_id", "relation", "retracted_at", state.alias("state"))


def evidence_neighbours(evidence: DataFrame, *, source: int | None = None, target: int | None = None, relation: str | None = None) -> DataFrame:
    """Evidence from a source, for a target, between both, or of a relation."""
    for name, wanted in (("source_id", source), ("target_id", target), ("relation", relation)):
        if wanted is not None:
            evidence = evidence.filter(F.col(name) == wanted)
    return evidence.select("evidence_id", "source_id", "target_id", "relation")


def active_provenance(store, revision: int) -> DataFrame:
    gone = raw_log(store.provenance_retractions, revision).select("edge_id")
    return raw_log(store.provenance, revision).join(gone, "edge_id", "left_anti")


def visible_provenance(store, ctx: Context, rights) -> DataFrame:
    """Active edges between assertions that may be read, where the edge itself may."""
    if not rights.may("query_resolve"):
        return active_provenance(store, ctx.as_of).limit(0)
    ends = store.assertions.filter(rights.endpoints("assertion", "assertion_id")).select("assertion_id")
    edges = active_provenance(store, ctx.as_of).filter(rights.provenance(ctx.space))
    for end in ("from_id", "to_id"):
        edges = edges.join(ends.select(F.col("assertion_id").alias(end)), end, "left_semi")
    return edges


def dependencies(edges: DataFrame) -> DataFrame:
    """Edges (a, b) from what is used to what uses it; corrections keep their direction."""
    turned = F.col("relation").isin("derived_from", "resulted_from")
    return edges.select(F.when(turned, F.col("to_id")).otherwise(F.col("from_id")).alias("a"), F.when(turned, F.col("from_id")).otherwise(F.col("to_id")).alias("b"))


def neighbours(edges: DataFrame, node: int, direction: str = "both") -> DataFrame:
    """Edges at a node: out, in, or both; a self loop once."""
    out = F.col("from_id") == node
    into = F.col("to_id") == node
    return edges.filter(out if direction == "out" else into if direction == "in" else out | into)


def duplicates(edges: DataFrame) -> DataFrame:
    """Edges that are stated more than once."""
    return edges.groupBy("from_id", "to_id", "relation").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


#: Families of records whose corrections stay within the family, and the ends that other relations may have.
RECORDS = ("assertion", "mask", "boundary", "event", "event_mask", "event_relation", "source", "evidence", "provenance", "archive_transition")


def edge_errors(edges: DataFrame) -> DataFrame:
    """(edge_id, reason) of edges (from_family, from_id, to_family, to_id, relation) that break a rule: self loops, corrections across families, unknown relations or families."""
    loop = (F.col("from_family") == F.col("to_family")) & (F.col("from_id") == F.col("to_id"))
    reason = (
        F.when(~F.col("relation").isin("corrects", "derived_from", "resulted_from"), "unknown_relation")
        .when(~F.col("from_family").isin(*RECORDS) | ~F.col("to_family").isin(*RECORDS), "unknown_family")
        .when(loop, "self_loop")
        .when((F.col("relation") == "corrects") & (F.col("from_family") != F.col("to_family")), "corrects_other_family")
        .when((F.col("relation") == "resulted_from") & (F.col("to_family") != "event"), "resulted_from_no_event")
    )
    return edges.withColumn("reason", reason).filter("reason IS NOT NULL").select("edge_id", "reason")

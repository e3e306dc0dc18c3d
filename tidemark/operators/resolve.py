"""Resolution of slots to known, unknown or conflicting values, for all slots at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import masks as M
from tidemark.operators.aggregate import within
from tidemark.operators.scan import candidates, latest
from tidemark.plans.context import Context, QueryError, joined_ids

SLOT = ["subject_id", "predicate_id"]
POLICIES = ("single_value_replace", "multi_value_overlay", "multi_value_replace")


def slots(store, predicate: int | None = None, rights=None) -> DataFrame:
    """The slots that readable assertions name."""
    rows = store.assertions if predicate is None else store.assertions.filter(F.col("predicate_id") == predicate)
    return (rows if rights is None else rows.filter(rights.assertions())).select(*SLOT).distinct()


def single_value(rows: DataFrame, keys: list[str] = SLOT) -> DataFrame:
    """The records of highest precedence decide; value and polarity must agree, ids and revisions never break a tie.

    Records are put together by precedence first, so a slot with very many is aggregated partially
    wherever they lie; only one row for each precedence of a slot meets the others.
    """
    said = F.struct("value_canon", "polarity")
    by_level = rows.groupBy(*keys, "level").agg(F.min(said).alias("low"), F.max(said).alias("high"), F.collect_list("assertion_id").alias("ids"))
    out = by_level.groupBy(*keys).agg(F.max_by(F.struct("low", "high", "ids"), "level").alias("top")).select(*keys, "top.*")
    known = F.col("low") == F.col("high")
    ids = F.array_join(F.transform(F.array_sort("ids"), lambda x: x.cast("string")), ",")
    return out.select(*keys, F.when(known, "known").otherwise("conflict").alias("outcome"), F.when(known, F.col("low.value_canon")).alias("value"), F.when(known, F.col("low.polarity")).alias("polarity"), ids.alias("contributors"))


def single_contributors(rows: DataFrame, keys: list[str] = SLOT) -> DataFrame:
    """(slot, assertion_id): the records that decide, as rows; no slot is gathered."""
    top = rows.groupBy(*keys).agg(F.max("level").alias("top"))
    return rows.join(top, keys).filter(F.col("level") == F.col("top")).select(*keys, "assertion_id")


def multi_value(rows: DataFrame, keys: list[str] = SLOT) -> DataFrame:
    """Each value of a slot once: with one polarity it is a value, with both a conflict."""
    def ids(polarity: str) -> Column:
        return joined_ids(F.when(F.col("polarity") == polarity, F.col("assertion_id")))

    out = rows.groupBy(*keys, F.col("value_canon").alias("value")).agg(ids("positive").alias("positive"), ids("negative").alias("negative"))
    state = F.when((F.col("positive") != "") & (F.col("negative") != ""), "conflict").when(F.col("positive") != "", "positive").otherwise("negative")
    return out.withColumn("state", state)


def value_states(rows: DataFrame, keys: list[str] = SLOT) -> DataFrame:
    """(slot, value, state), without the ids."""
    low, high = F.min("polarity"), F.max("polarity")
    return rows.groupBy(*keys, F.col("value_canon").alias("value")).agg(F.when(low == high, low).otherwise("conflict").alias("state"))


def multi_outcome(values: DataFrame, keys: list[str] = SLOT) -> DataFrame:
    """One row a slot: conflict if any value has both polarities."""
    conflicts = F.sum((F.col("state") == "conflict").cast("long"))
    return values.groupBy(*keys).agg(F.when(conflicts > 0, "conflict").otherwise("known").alias("outcome"), F.count("*").alias("n_values"), conflicts.alias("n_conflicts"))


def with_unknown(all_slots: DataFrame, resolved: DataFrame, keys: list[str] = SLOT) -> DataFrame:
    return all_slots.join(resolved, keys, "left").withColumn("outcome", F.coalesce("outcome", F.lit("unknown")))


def boundary_cutoffs(store, ctx: Context, rights=None) -> DataFrame:
    """Highest precedence of the boundaries of each slot that are active at the context's time."""
    return M.active(store, ctx, "boundary", rights).groupBy(*SLOT).agg(F.max("level").alias("boundary_level"))


def flag_cut(rows: DataFrame, cutoffs: DataFrame, keys: list[str] = SLOT) -> DataFrame:
    """Candidates with ``cut``: whether a boundary has a higher precedence."""
    return rows.join(cutoffs, keys, "left").withColumn("cut", F.coalesce(F.col("level") < F.col("boundary_level"), F.lit(False))).drop("boundary_level")


def apply_boundaries(rows: DataFrame, cutoffs: DataFrame, keys: list[str] = SLOT) -> DataFrame:
    """Candidates of at least the boundary's precedence."""
    return flag_cut(rows, cutoffs, keys).filter(~F.col("cut")).drop("cut")


def surviving(store, ctx: Context, predicate: int | None = None, rights=None, subject: int | None = None) -> DataFrame:
    """Candidates after masks, of a predicate or of all; rights hold for both."""
    allowed = rights.assertions() if rights else None
    return M.apply_masks(candidates(store, ctx, subject=subject, predicate=predicate, allowed=allowed), M.active_masks(store, ctx, rights))


def resolve_single(store, ctx: Context, predicate: int = 0, rights=None) -> DataFrame:
    return with_unknown(slots(store, predicate, rights), single_value(surviving(store, ctx, predicate, rights)))


def resolve_overlay(store, ctx: Context, predicate: int = 1, rights=None) -> DataFrame:
    return with_unknown(slots(store, predicate, rights), multi_outcome(value_states(surviving(store, ctx, predicate, rights))))


def resolve_replace(store, ctx: Context, predicate: int = 2, rights=None) -> DataFrame:
    """A boundary without survivors makes the slot known and empty."""
    cutoffs = boundary_cutoffs(store, ctx, rights)
    left = apply_boundaries(surviving(store, ctx, predicate, rights), cutoffs)
    out = slots(store, predicate, rights).join(multi_outcome(value_states(left)), SLOT, "left").join(cutoffs, SLOT, "left")
    outcome = F.coalesce("outcome", F.when(F.col("boundary_level").isNotNull(), F.lit("known_empty")), F.lit("unknown"))
    return out.select(*SLOT, outcome.alias("outcome"), F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"))


def resolve_by_schema(store, ctx: Context, rights=None) -> DataFrame:
    """(slot, policy, outcome) of every slot, by the policy that the schema gives its predicate at the revision.

    All policies are answered from one pass over the survivors.  A slot of a predicate that the schema
    doesn't know yet has the outcome unknown_predicate.
    """
    schema = F.broadcast(latest(store.schema_predicates, "predicate_id", ctx.as_of).select("predicate_id", "policy"))
    cutoffs = boundary_cutoffs(store, ctx, rights)
    rows = surviving(store, ctx, None, rights).join(schema, "predicate_id").join(cutoffs, SLOT, "left")
    rows = rows.filter((F.col("policy") != "multi_value_replace") | F.col("boundary_level").isNull() | (F.col("level") >= F.col("boundary_level")))
    said = F.struct("value_canon", "polarity")
    by_level = rows.groupBy(*SLOT, "level").agg(F.min(said).alias("low"), F.max(said).alias("high"))
    single = by_level.groupBy(*SLOT).agg(F.max_by(F.struct("low", "high"), "level").alias("top")).select(*SLOT, (F.col("top.low") == F.col("top.high")).alias("agree"))
    multi = multi_outcome(value_states(rows)).select(*SLOT, "n_conflicts")
    out = slots(store, None, rights).join(schema, "predicate_id", "left").join(single, SLOT, "left").join(multi, SLOT, "left").join(cutoffs, SLOT, "left")
    outcome = (
        F.when(F.col("policy").isNull(), "unknown_predicate")
        .when(F.col("agree").isNull() & (F.col("policy") == "multi_value_replace") & F.col("boundary_level").isNotNull(), "known_empty")
        .when(F.col("agree").isNull(), "unknown")
        .when(F.col("policy") == "single_value_replace", F.when(F.col("agree"), "known").otherwise("conflict"))
        .otherwise(F.when(F.col("n_conflicts") > 0, "conflict").otherwise("known"))
    )
    return out.select(*SLOT, "policy", outcome.alias("outcome"))


def resolve_point(store, ctx: Context, subject: int, predicate: int, rights=None) -> DataFrame:
    """One slot by the schema's policy, within the context's budgets."""
    known = {r.predicate_id: r for r in latest(store.schema_predicates.filter(F.col("predicate_id") == predicate), "predicate_id", ctx.as_of).collect()}
    if predicate not in known:
        raise QueryError("the schema doesn't know the predicate at that revision")
    within(candidates(store, ctx, subject=subject, predicate=predicate, allowed=rights.assertions() if rights else None), ctx.max_candidates, "candidates")
    slot = store.spark.createDataFrame([(subject, predicate)], "subject_id long, predicate_id long")
    rows = surviving(store, ctx, predicate, rights, subject)
    policy = known[predicate].policy
    if policy == "single_value_replace":
        return with_unknown(slot, single_value(rows)).select(*SLOT, "outcome", "contributors")
    cutoffs = boundary_cutoffs(store, ctx, rights).filter((F.col("subject_id") == subject) & (F.col("predicate_id") == predicate))
    if policy == "multi_value_replace":
        rows = apply_boundaries(rows, cutoffs)
    out = multi_outcome(value_states(rows)).join(rows.groupBy(*SLOT).agg(joined_ids(F.col("assertion_id")).alias("contributors")), SLOT)
    out = slot.join(out, SLOT, "left").join(cutoffs, SLOT, "left")
    empty = F.when(F.col("boundary_level").isNotNull() & F.lit(policy == "multi_value_replace"), "known_empty").otherwise("unknown")
    return out.select(*SLOT, F.coalesce("outcome", empty).alias("outcome"), "contributors")


#: Stages of an explanation, in order.
STAGES = ("candidate_scan", "mask_projection", "replacement_boundary", "resolution")


def _flagged(store, ctx: Context, predicate: int, rights=None) -> DataFrame:
    """Candidates with the last stage that they came into: 1 masked, 2 cut off by a boundary, 3 kept out by nothing."""
    rows = candidates(store, ctx, predicate=predicate, allowed=rights.assertions() if rights else None)
    rows = flag_cut(M.flag_masked(rows, M.active_masks(store, ctx, rights)), boundary_cutoffs(store, ctx, rights))
    return rows.withColumn("reached", F.when(F.col("masked"), 1).when(F.col("cut"), 2).otherwise(3))


def explain(store, ctx: Context, predicate: int = 2, rights=None) -> DataFrame:
    """(slot, stage_no, stage, n_in, n_out): what each stage of a resolution with boundaries let through; one pass over the candidates."""
    if rights is not None:
        rights.demand("query_explain")
    rows = _flagged(store, ctx, predicate, rights)
    totals = rows.groupBy(*SLOT).agg(F.count("*").alias("n0"), F.count(F.when(F.col("reached") > 1, 1)).alias("n1"), F.count(F.when(F.col("reached") > 2, 1)).alias("n2"))
    sides = [("n0", "n0"), ("n0", "n1"), ("n1", "n2"), ("n2", "n2")]
    stages = (F.struct(F.lit(k + 1).alias("stage_no"), F.lit(s).alias("stage"), F.col(a).alias("n_in"), F.col(b).alias("n_out")) for k, (s, (a, b)) in enumerate(zip(STAGES, sides, strict=True)))
    return totals.select(*SLOT, F.inline(F.array(*stages)))


def explain_records(store, ctx: Context, predicate: int = 2, rights=None) -> DataFrame:
    """(slot, stage_no, role, family, id): the records that came into and out of each stage, and the masks and boundaries that it applied."""
    if rights is not None:
        rights.demand("query_explain")
    rows = _flagged(store, ctx, predicate, rights)
    fates = [F.struct(F.lit(k).alias("stage_no"), F.lit(role).alias("role"), F.lit(need).alias("need")) for k, role, need in ((1, "out", 0), (2, "in", 0), (2, "out", 2), (3, "in", 2), (3, "out", 3), (4, "in", 3), (4, "out", 3))]
    moved = rows.select(*SLOT, "assertion_id", "reached", F.inline(F.array(*fates))).filter(F.col("reached") >= F.col("need"))
    moved = moved.select(*SLOT, "stage_no", "role", F.lit("assertion").alias("family"), F.col("assertion_id").alias("id"))
    masks = M.applied_masks(rows, M.active_masks(store, ctx, rights)).join(rows.select("assertion_id", *SLOT), "assertion_id")
    masks = masks.select(*SLOT, F.lit(2).alias("stage_no"), F.lit("applied").alias("role"), F.lit("mask").alias("family"), F.col("mask_id").alias("id")).distinct()
    active = M.active(store, ctx, "boundary", rights).join(rows.select(*SLOT).distinct(), SLOT, "left_semi")
    cuts = active.join(boundary_cutoffs(store, ctx, rights), SLOT).filter(F.col("level") == F.col("boundary_level"))
    cuts = cuts.select(*SLOT, F.lit(3).alias("stage_no"), F.lit("applied").alias("role"), F.lit("boundary").alias("family"), F.col("boundary_id").alias("id"))
    return moved.unionByName(masks).unionByName(cuts)


def check_stages(stages: list[dict]) -> None:
    """Refuses an explanation whose stages are out of order, or whose stage puts out what didn't come in."""
    order = [STAGES.index(s["stage"]) for s in stages]
    if order != sorted(set(order)) or not stages or order[0] != 0 or order[-1] != 3:
        raise QueryError("stages stand in order, each once, from the scan to the resolution")
    before = None
    for s in stages:
        for name in ("in", "out", "applied"):
            if len(set(s[name])) < len(s[name]) or list(s[name]) != sorted(s[name]):
                raise QueryError("records of a stage are unique and in order")
        if s["stage"] != "candidate_scan" and (not set(s["out"]) <= set(s["in"]) or list(s["in"]) != list(before)):
            raise QueryError("a stage takes what the one before put out, and adds nothing")
        before = s["out"]

"""Masks hide assertions of strictly lower precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import contains, partition, raw_log, unarchived
from tidemark.plans.context import Context, level

#: Selector -> the columns that tie a mask to assertions.
SELECTORS = {
    "exact": ["assertion_id"],
    "proposition": ["subject_id", "predicate_id", "value_canon", "polarity"],
    "slot": ["subject_id", "predicate_id"],
}


def known(store, ctx: Context, family: str, rights=None) -> DataFrame:
    """Masks or boundaries recorded, unarchived and readable at the revision, inside the ancestry, with ``closed_at``.

    Branch cutoffs don't apply to them.  Rights come first, so a hidden one takes its lifecycle with it.
    """
    name, table = {"mask": ("mask", "masks"), "boundary": ("boundary", "boundaries")}[family]
    key = f"{name}_id"
    rows = partition(raw_log(getattr(store, table), ctx.as_of), ctx)
    if rights is not None:
        rows = rows.filter(getattr(rights, table)())
    rows = unarchived(rows, key, store.archive_transitions, ctx.as_of, name)
    closed = raw_log(getattr(store, f"{name}_closures"), ctx.as_of).groupBy(key).agg(F.min("close_at").alias("closed_at"))
    rows = rows.join(closed, key, "left").withColumn("level", level(ctx))
    return rows.filter(F.col("level").isNotNull())


def active(store, ctx: Context, family: str, rights=None) -> DataFrame:
    """The known ones that aren't retracted, and that hold the context's world time if it has one."""
    rows = known(store, ctx, family, rights)
    gone = raw_log(getattr(store, f"{family}_retractions"), ctx.as_of).select(f"{family}_id").distinct()
    rows = rows.join(gone, f"{family}_id", "left_anti")
    if ctx.world_time is not None:
        t = F.lit(ctx.world_time)
        rows = rows.filter(contains("valid_start", "valid_end", t) & (F.col("closed_at").isNull() | (t < F.col("closed_at"))))
    return rows


def active_masks(store, ctx: Context, rights=None) -> DataFrame:
    return active(store, ctx, "mask", rights)


def highest(masks: DataFrame) -> dict[str, DataFrame]:
    """For each kind of selector: its keys, and ``above``, the highest precedence of masks on them.

    One partial aggregate serves all kinds, whatever the number of masks on a key.  The kind is taken
    from the aggregate's result, so that the three uses share its shuffle.
    """
    used = {k: F.when(F.col("selector").isin([s for s, keys in SELECTORS.items() if k in keys]), F.col(k)) for keys in SELECTORS.values() for k in keys}
    tops = masks.groupBy("selector", *(c.alias(f"_{k}") for k, c in used.items())).agg(F.max("level").alias("above"), F.max("selector").alias("kind"))
    return {s: tops.filter(F.col("kind") == s).select(*(F.col(f"_{k}").alias(k) for k in keys), "above") for s, keys in SELECTORS.items()}


def flag_masked(candidates: DataFrame, masks: DataFrame) -> DataFrame:
    """Candidates with ``masked``: whether a mask hides them."""
    rows = candidates.withColumn("masked", F.lit(False))
    for selector, tops in highest(masks).items():
        rows = rows.join(tops, SELECTORS[selector], "left").withColumn("masked", F.col("masked") | F.coalesce(F.col("above") > F.col("level"), F.lit(False))).drop("above")
    return rows


def apply_masks(candidates: DataFrame, masks: DataFrame) -> DataFrame:
    """Candidates that no mask hides."""
    for selector, tops in highest(masks).items():
        candidates = candidates.join(tops, SELECTORS[selector], "left").filter(F.col("above").isNull() | (F.col("above") <= F.col("level"))).drop("above")
    return candidates


def matching_masks(candidates: DataFrame, masks: DataFrame) -> DataFrame:
    """(assertion_id, mask_id, wins): all masks that match each candidate, and whether they hide it."""
    out = None
    for selector, keys in SELECTORS.items():
        m = masks.filter(F.col("selector") == selector).select(*keys, "mask_id", F.col("level").alias("mask_level"))
        hits = candidates.join(m, keys).select("assertion_id", "mask_id", (F.col("mask_level") > F.col("level")).alias("wins"))
        out = hits if out is None else out.unionByName(hits)
    return out


def applied_masks(candidates: DataFrame, masks: DataFrame) -> DataFrame:
    """(assertion_id, mask_id): for each hidden candidate the mask of least id that hides it."""
    return matching_masks(candidates, masks).filter("wins").groupBy("assertion_id").agg(F.min("mask_id").alias("mask_id"))

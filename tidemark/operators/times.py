"""Resolution over all of world time: slots are split at every endpoint that matters, and each cell is resolved.

Every step is linear in the intervals: assertions lose the stretches in which masks or boundaries hide
them, unions of intervals give steps up and down, and running sums over a slot's endpoints tell what each
cell holds.  Only the assertions of a cell's highest precedence are put beside it, for their ids.  What several
steps read is written once, so no task holds the sorts of many copies of a plan, and no stage sends their counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import masks as M
from tidemark.operators.components import stored
from tidemark.operators.scan import as_of, closed_at, partition, raw_log, unarchived, unretracted, with_closures
from tidemark.plans.context import Context, QueryError, level

SLOT = ["subject_id", "predicate_id"]
LOW, HIGH = -(1 << 62), 1 << 62
#: Width of the stretches of time by which cells and assertions meet.
SPAN = 512


def intervals(rows: DataFrame) -> DataFrame:
    """Rows with ``start`` and ``stop``: validity, and the closure that ends it."""
    stop = F.coalesce(F.least("valid_end", "closed_at"), F.lit(HIGH))
    return rows.withColumns({"start": F.coalesce("valid_start", F.lit(LOW)), "stop": stop}).filter(F.col("start") < F.col("stop"))


def union(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, stop): the disjoint intervals that those of a key cover together."""
    order = Window.partitionBy(*keys).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > before, F.lit(True)).cast("long")
    numbered = rows.select(*keys, "start", "stop", opens.alias("opens")).withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("part")


def subtract(rows: DataFrame, hidden: DataFrame) -> DataFrame:
    """Rows without the stretches (from, to) that ``hidden`` names for them; hidden has the columns of rows too."""
    ends = rows.withColumns({"from": F.col("stop"), "to": F.col("stop")})
    line = Window.partitionBy("assertion_id", "start").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest("start", F.coalesce(F.max("to").over(line), F.col("start")))
    gaps = hidden.select(ends.columns).unionByName(ends).withColumn("begin", begin).withColumn("end", F.least("from", "stop"))
    return gaps.filter(F.col("begin") < F.col("end")).withColumns({"start": F.col("begin"), "stop": F.col("end")}).select(rows.columns)


def _hiding(rows: DataFrame, hiders: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with each stretch in which a hider of their key has a higher precedence."""
    spans = union(hiders, [*keys, "level"]).withColumnsRenamed({"start": "from", "stop": "to", "level": "above"})
    return rows.join(spans, keys).filter((F.col("above") > F.col("level")) & (F.col("from") < F.col("stop")) & (F.col("to") > F.col("start"))).drop("above")


class Known:
    """What the branch knows of a predicate's slots at a revision, written once: assertions that aren't archived, retracted ones included, and masks."""

    def __init__(self, store, ctx: Context, predicate: int, rights=None):
        self.store, self.ctx, self.predicate, self.rights = store, ctx.at(world_time=None), predicate, rights
        rows = store.assertions.filter(F.col("predicate_id") == predicate)
        rows = rows if rights is None else rows.filter(rights.assertions())
        rows = as_of(partition(rows, ctx), ctx)
        rows = unarchived(rows, "assertion_id", store.archive_transitions, ctx.as_of, "assertion").withColumn("level", level(ctx))
        self.assertions = stored(rows.select("assertion_id", *SLOT, "value_canon", "polarity", "valid_start", "valid_end", "level", "cutoff"))
        self.masks = stored(M.known(store, self.ctx, "mask", rights))


def live(known: Known) -> DataFrame:
    """Unretracted assertions with the intervals in which no mask hides them, written once."""
    store, rows = known.store, unretracted(known.assertions, known.store.assertion_retractions, "assertion_id")
    rows = with_closures(rows, store.assertion_closures, "assertion_id").withColumn("closed_at", closed_at())
    rows = stored(intervals(rows).select("assertion_id", *SLOT, "value_canon", "polarity", "level", "start", "stop"))
    gone = raw_log(store.mask_retractions, known.ctx.as_of).select("mask_id").distinct()
    masks = intervals(known.masks.join(gone, "mask_id", "left_anti"))
    hidden = None
    for selector, keys in M.SELECTORS.items():
        part = _hiding(rows, masks.filter(F.col("selector") == selector), keys).select(*rows.columns, "from", "to")
        hidden = part if hidden is None else hidden.unionByName(part)
    return stored(subtract(rows, hidden))


def cells(known: Known) -> DataFrame:
    """Half-open cells of each slot between all endpoints that matter: (slot, cell_start, cell_end, at), open ends null.

    Endpoints come from assertions that aren't archived, retracted ones included, from masks that may
    hide some of them, from boundaries, and from the closures of all these.  Assertions and boundaries
    with a validity open a slot; masks and closures only divide it.  A slot without endpoints is one
    cell; cells aren't merged.  ``at`` is a point of the cell.
    """
    store, ctx, rows, masks = known.store, known.ctx, known.assertions, known.masks
    own = F.col("predicate_id") == known.predicate
    closed = rows.select(*SLOT, "assertion_id", "cutoff").join(store.assertion_closures, "assertion_id").filter(F.col("revision") <= F.col("cutoff"))
    exact = masks.filter(F.col("selector") == "exact").drop(*SLOT).join(rows.select("assertion_id", *SLOT), "assertion_id")
    wide = masks.filter((F.col("selector") != "exact") & own).join(rows.select(*SLOT).distinct(), SLOT, "left_semi")
    masks = exact.select("mask_id", *SLOT, "valid_start", "valid_end").unionByName(wide.select("mask_id", *SLOT, "valid_start", "valid_end"))
    mask_ends = raw_log(store.mask_closures, ctx.as_of).join(masks.select("mask_id", *SLOT), "mask_id")
    boundaries = M.known(store, ctx, "boundary", known.rights).filter(own)
    boundary_ends = raw_log(store.boundary_closures, ctx.as_of).join(boundaries.select("boundary_id", *SLOT), "boundary_id")
    valid = boundaries.filter("valid_start IS NOT NULL OR valid_end IS NOT NULL")

    def ends(frame: DataFrame, *columns: str) -> DataFrame:
        return frame.select(*SLOT, F.explode(F.array(*columns)).alias("edge"))

    opened = rows.select(*SLOT).unionByName(valid.select(*SLOT)).distinct()
    firm = ends(rows, "valid_start", "valid_end").unionByName(ends(valid, "valid_start", "valid_end")).unionByName(ends(closed, "close_at")).unionByName(ends(masks, "valid_start", "valid_end")).unionByName(ends(mask_ends, "close_at"))
    edges = firm.unionByName(ends(boundary_ends, "close_at").join(opened, SLOT, "left_semi")).filter("edge IS NOT NULL").distinct()
    ahead = F.lead("edge").over(Window.partitionBy(*SLOT).orderBy("edge"))
    inner = edges.select(*SLOT, F.col("edge").alias("cell_start"), ahead.alias("cell_end"), F.col("edge").alias("at"))
    nothing = F.lit(None).cast("long")
    least = F.min("edge")
    outer = opened.join(edges, SLOT, "left").groupBy(*SLOT).agg(least.alias("cell_end"), F.coalesce(least - 1, F.lit(0)).alias("at"))
    return inner.unionByName(outer.select(*SLOT, nothing.alias("cell_start"), "cell_end", "at"))


def running(grid: DataFrame, steps: DataFrame, names: list[str]) -> DataFrame:
    """The grid with the sums of all steps (slot, at, names) up to each cell."""
    zero = {n: F.lit(0).cast("long") for n in names}
    marked = grid.withColumns({**zero, "cell": F.lit(True)})
    moved = steps.select(*SLOT, F.lit(None).cast("long").alias("cell_start"), F.lit(None).cast("long").alias("cell_end"), "at", *(F.col(n).cast("long").alias(n) for n in names), F.lit(False).alias("cell"))
    both = marked.select(moved.columns).unionByName(moved).groupBy(*SLOT, "at").agg(F.max("cell_start").alias("cell_start"), F.max("cell_end").alias("cell_end"), F.max("cell").alias("cell"), *(F.sum(n).alias(n) for n in names))
    line = Window.partitionBy(*SLOT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({n: F.sum(n).over(line) for n in names}).filter("cell").drop("cell")


def _steps(spans: DataFrame, name: str, size: Column | int = 1) -> DataFrame:
    """A step up where each span starts, and down where it stops."""
    size = F.lit(size) if isinstance(size, int) else size
    return spans.select(*SLOT, F.inline(F.array(F.struct(F.col("start").alias("at"), size.cast("long").alias(name)), F.struct(F.col("stop").alias("at"), (-size).cast("long").alias(name)))))


def _held(inner: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells with ``held``: the rows of their level that hold their point, by id; null without a level.

    They meet by slot, level and stretch of time.  The rows of such a stretch are one array that its cells pick from,
    so pairs of cells and rows are never written, sorted or sent.
    """
    on = [*SLOT, "level", "stretch"]
    inner = inner.withColumn("stretch", F.floor(F.col("at") / SPAN))
    bounds = inner.groupBy(*SLOT).agg(F.min("at").alias("first"), F.max("at").alias("final"))
    low, high = F.floor(F.greatest("start", "first") / SPAN), F.floor(F.least(F.col("stop") - 1, F.col("final")) / SPAN)
    spread = rows.join(bounds, SLOT).filter((F.col("start") <= F.col("final")) & (F.col("stop") > F.col("first"))).withColumn("stretch", F.explode(F.sequence(low, high)))
    spread = spread.join(inner.select(*on).distinct(), on, "left_semi")
    groups = spread.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("assertion_id", "value_canon", "polarity", "start", "stop"))).alias("told"))
    holds = F.filter("told", lambda x: (x["start"] <= F.col("at")) & (F.col("at") < x["stop"]))
    return inner.join(groups.hint("merge"), on, "left").withColumn("held", holds).drop("stretch", "told")


def all_times_single(store, ctx: Context, predicate: int = 0, rights=None) -> DataFrame:
    """Every slot of a single-valued predicate in every cell: the highest precedence decides, as at a point."""
    if len(ctx.levels()) > 62:
        raise QueryError("more than 62 levels of precedence")
    known = Known(store, ctx, predicate, rights)
    rows = live(known)
    steps = _steps(union(rows, [*SLOT, "level"]), "held", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level").cast("int")))
    inner = running(cells(known), steps, ["held"]).withColumn("level", F.when(F.col("held") > 0, F.length(F.bin("held")) - 1).cast("long"))
    inner = stored(inner.select(*SLOT, "at", "cell_start", "cell_end", "level"))
    said = F.transform("held", lambda x: F.struct(x["value_canon"].alias("value_canon"), x["polarity"].alias("polarity")))
    ids = F.array_join(F.transform("held", lambda x: x["assertion_id"].cast("string")), ",")
    out = _held(inner, rows).withColumns({"low": F.array_min(said), "high": F.array_max(said), "contributors": ids})
    same = F.col("low") == F.col("high")
    outcome = F.when(F.col("low").isNull(), "unknown").when(same, "known").otherwise("conflict")
    return out.select(*SLOT, "cell_start", "cell_end", outcome.alias("outcome"), F.when(same, F.col("low.value_canon")).alias("value"), F.when(same, F.col("low.polarity")).alias("polarity"), F.when(F.col("low").isNotNull(), F.col("contributors")).alias("contributors"))


def _value_steps(rows: DataFrame) -> DataFrame:
    """Where the numbers of values and of values with both polarities change: (slot, at, n_values, n_conflicts)."""
    spans = union(rows, [*SLOT, "value_canon", "polarity"])
    ends = F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("by")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("by"))))
    side = lambda name: F.sum(F.when(F.col("polarity") == name, F.col("by")).otherwise(0)).alias(name)
    changes = spans.select(*SLOT, "value_canon", "polarity", ends).groupBy(*SLOT, "value_canon", "at").agg(side("positive"), side("negative"))
    line = Window.partitionBy(*SLOT, "value_canon").orderBy("at")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    held = changes.withColumns({"p": F.sum("positive").over(upto), "n": F.sum("negative").over(upto)})
    held = held.withColumns({"any": ((F.col("p") > 0) | (F.col("n") > 0)).cast("long"), "both": ((F.col("p") > 0) & (F.col("n") > 0)).cast("long")})
    return held.select(*SLOT, "at", *((F.col(x) - F.coalesce(F.lag(x).over(line), F.lit(0))).alias(y) for x, y in (("any", "n_values"), ("both", "n_conflicts"))))


def all_times_overlay(store, ctx: Context, predicate: int = 1, rights=None) -> DataFrame:
    """Every slot of a multi-valued predicate in every cell: its numbers of values and of conflicts, over all precedences."""
    known = Known(store, ctx, predicate, rights)
    out = running(cells(known), _value_steps(live(known)), ["n_values", "n_conflicts"])
    outcome = F.when(F.col("n_conflicts") > 0, "conflict").when(F.col("n_values") > 0, "known").otherwise("unknown")
    return out.select(*SLOT, "cell_start", "cell_end", outcome.alias("outcome"), "n_values", "n_conflicts")


def all_times_replace(store, ctx: Context, predicate: int = 2, rights=None) -> DataFrame:
    """As the overlay, but only what no active boundary of higher precedence cuts off; a boundary alone makes a cell known and empty."""
    boundaries = intervals(M.active(store, ctx.at(world_time=None), "boundary", rights).filter(F.col("predicate_id") == predicate)).select(*SLOT, "level", "start", "stop")
    known = Known(store, ctx, predicate, rights)
    rows = live(known)
    rows = stored(subtract(rows, _hiding(rows, boundaries, SLOT).select(*rows.columns, "from", "to")))
    steps = _value_steps(rows).withColumn("n_boundaries", F.lit(0).cast("long"))
    cuts = _steps(union(boundaries, SLOT), "n_boundaries").withColumns({"n_values": F.lit(0).cast("long"), "n_conflicts": F.lit(0).cast("long")})
    names = ["n_values", "n_conflicts", "n_boundaries"]
    out = running(cells(known), steps.select(*SLOT, "at", *names).unionByName(cuts.select(*SLOT, "at", *names)), names)
    outcome = F.when(F.col("n_conflicts") > 0, "conflict").when(F.col("n_values") > 0, "known").when(F.col("n_boundaries") > 0, "known_empty").otherwise("unknown")
    return out.select(*SLOT, "cell_start", "cell_end", outcome.alias("outcome"), "n_values", "n_conflicts")


def complete_empty(slots: DataFrame, grid: DataFrame) -> DataFrame:
    """Slots that no cell describes: nothing in the context opens a time for them."""
    return slots.select(*SLOT).distinct().join(grid.select(*SLOT).distinct(), SLOT, "left_anti")

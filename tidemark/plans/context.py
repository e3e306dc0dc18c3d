"""What a query is pinned to: revision, world time, branch, layers, perspective, and the caller's rights."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.derived import LAYERS, SPACES

#: Catalogs above this are not small any more and are refused as dimensions.
MAX_CATALOG = 100_000


class QueryError(ValueError):
    """A request or a store that the engine refuses."""


@dataclass(frozen=True)
class Context:
    as_of: int
    space: int
    world_time: int | None = None
    layers: tuple[int, ...] | str = "all"
    perspective: int = 0
    mode: str = "world_state"
    spaces: tuple = tuple(SPACES)
    layer_ranks: tuple = tuple(LAYERS)
    max_candidates: int = 1_000_000
    max_results: int = 100_000

    def __post_init__(self):
        if self.as_of < 0:
            raise QueryError("a revision is not negative")
        if (self.perspective == 0) != (self.mode == "world_state") or self.mode not in ("world_state", "knows", "believes", "claims"):
            raise QueryError("world_state goes with the world, other modes with a perspective")
        if len(self.spaces) > MAX_CATALOG or len(self.layer_ranks) > MAX_CATALOG:
            raise QueryError("the catalog of branches or layers is too large")

    def at(self, **changes) -> Context:
        return replace(self, **changes)

    def ancestry(self) -> list[tuple[int, int, int]]:
        """(space, distance, cutoff) from the space to its root; the cutoff is the least base revision on the way."""
        known = {s: (parent, base) for s, parent, base in self.spaces}
        out, space, cutoff, seen = [], self.space, self.as_of, set()
        while space is not None:
            if space not in known or space in seen:
                raise QueryError(f"space {space} is missing or its ancestry is a cycle")
            seen.add(space)
            out.append((space, len(out), cutoff))
            parent, base = known[space]
            space, cutoff = parent, min(cutoff, base)
        return out

    def selected_layers(self) -> list[tuple[int, int]]:
        """(layer, rank) of the selection: all, base (least rank), or explicit ids."""
        ranks = dict(self.layer_ranks)
        if self.layers == "all":
            chosen = list(ranks)
        elif self.layers == "base":
            chosen = [min(ranks, key=ranks.get)]
        else:
            chosen = list(self.layers)
        if missing := [x for x in chosen if x not in ranks]:
            raise QueryError(f"unknown layers {missing}")
        if not chosen:
            raise QueryError("no layer is selected")
        return sorted((x, ranks[x]) for x in set(chosen))

    def space_ids(self) -> list[int]:
        return [s for s, _, _ in self.ancestry()]

    def levels(self) -> list[tuple[int, int]]:
        """All precedences of the context, the lowest first: (nearness, layer rank)."""
        return sorted({(-d, rank) for _, d, _ in self.ancestry() for _, rank in self.selected_layers()})

    def visible_spaces(self, spark: SparkSession) -> DataFrame:
        """The ancestry as a table of as many rows as the branch is deep."""
        return F.broadcast(spark.createDataFrame(self.ancestry(), "space_id long, distance int, cutoff long"))


def literal_map(pairs: list[tuple[int, int]], key: Column) -> Column:
    """Looks up a small driver-side dimension inside the expression: no join, no shuffle."""
    return F.create_map(*(F.lit(x).cast("long") for p in pairs for x in p))[key.cast("long")]


def precedence(ctx: Context) -> Column:
    """Order of contexts: a nearer branch first, then the higher layer rank.  Null outside the ancestry or the layers."""
    distance = literal_map([(s, d) for s, d, _ in ctx.ancestry()], F.col("space_id"))
    rank = literal_map(ctx.selected_layers(), F.col("layer_id"))
    return F.when(distance.isNotNull() & rank.isNotNull(), F.struct((-distance).alias("nearness"), rank.alias("layer_rank")))


def level(ctx: Context) -> Column:
    """The place of the precedence among all of the context, as an integer; null where precedence is."""
    place = {p: k for k, p in enumerate(ctx.levels())}
    layers = [(layer, rank) for layer, rank in ctx.selected_layers()]
    own = [F.create_map(*(F.lit(x).cast("long") for layer, rank in layers for x in (layer, place[-d, rank]))) for _, d, _ in ctx.ancestry()]
    by_space = F.create_map(*(x for (s, _, _), m in zip(ctx.ancestry(), own, strict=True) for x in (F.lit(s).cast("long"), m)))
    return by_space[F.col("space_id").cast("long")][F.col("layer_id").cast("long")]


def catalog(store) -> dict:
    """Branches and layers of a store, for a Context; refused where they are no small catalog."""
    found = {}
    for name, rows, columns in (("spaces", store.history_spaces, ("space_id", "parent_id", "base_revision")), ("layer_ranks", store.layers, ("layer_id", "layer_rank"))):
        kept = rows.select(*columns).limit(MAX_CATALOG + 1).collect()
        found[name] = tuple(sorted((tuple(r) for r in kept), key=lambda r: r[0]))
    return found


def joined_ids(column: Column) -> Column:
    """Ids of a group, ascending, as text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: x.cast("string")), ",")

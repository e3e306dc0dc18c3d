"""Rules that are easy to get wrong, on small stores."""

import itertools
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import aggregate as A
from tidemark.operators import events as E
from tidemark.operators import filters as C
from tidemark.operators import graph as G
from tidemark.operators import jobs as J
from tidemark.operators import masks as M
from tidemark.operators import movement as N
from tidemark.operators import resolve as R
from tidemark.operators import scan as S
from tidemark.operators import search as K
from tidemark.operators import security as L
from tidemark.operators import times as T
from tidemark.operators import transactions as X
from tidemark.plans.context import Context, QueryError, catalog
from tidemark.sources.tables import Database, DatabaseStore, write_store

ASSERTION = "assertion_id long, subject_id long, predicate_id long, space_id long, layer_id long, perspective_id int, mode string, value_canon string, polarity string, valid_start long, valid_end long, revision long"
MASK = "mask_id long, space_id long, layer_id long, perspective_id int, mode string, selector string, assertion_id long, subject_id long, predicate_id long, value_canon string, polarity string, valid_start long, valid_end long, revision long"


def assertion(i, space=1, layer=0, value="a", polarity="positive", start=0, end=None, revision=1, subject=1, predicate=0):
    return (i, subject, predicate, space, layer, 0, "world_state", value, polarity, start, end, revision)


def mask(i, selector, target, space=1, layer=0, revision=1, value="a", polarity="positive", start=None, end=None, predicate=0):
    return (i, space, layer, 0, "world_state", selector, target, 1, predicate, value, polarity, start, end, revision)


def boundary(i, space=2, layer=0, predicate=2, revision=1, start=None, end=None, subject=1):
    return (i, space, layer, 0, "world_state", subject, predicate, start, end, revision)


def store(spark, assertions=(), masks=(), retractions=(), closures=(), transitions=(), boundaries=(), mask_retractions=(), mask_closures=(), boundary_retractions=(), boundary_closures=()):
    make = spark.createDataFrame
    return SimpleNamespace(
        spark=spark,
        assertions=make(list(assertions), ASSERTION),
        masks=make(list(masks), MASK),
        mask_retractions=make(list(mask_retractions), "mask_id long, revision long"),
        mask_closures=make(list(mask_closures), "mask_id long, revision long, close_at long"),
        assertion_retractions=make(list(retractions), "assertion_id long, revision long"),
        assertion_closures=make(list(closures), "assertion_id long, revision long, close_at long"),
        archive_transitions=make([t if len(t) == 4 else ("assertion", *t) for t in transitions], "target_kind string, target_id long, action string, revision long"),
        boundaries=make(list(boundaries), "boundary_id long, space_id long, layer_id long, perspective_id int, mode string, subject_id long, predicate_id long, valid_start long, valid_end long, revision long"),
        boundary_retractions=make(list(boundary_retractions), "boundary_id long, revision long"),
        boundary_closures=make(list(boundary_closures), "boundary_id long, revision long, close_at long"),
    )


CTX = Context(as_of=100, space=2, world_time=50, spaces=((1, None, 0), (2, 1, 10)), layer_ranks=((0, 0), (1, 10)))


def ids(frame, column="assertion_id"):
    return sorted(r[column] for r in frame.collect())


def test_ancestry_takes_the_least_cutoff():
    ctx = Context(as_of=100, space=3, spaces=((1, None, 0), (2, 1, 50), (3, 2, 70)))
    assert ctx.ancestry() == [(3, 0, 100), (2, 1, 70), (1, 2, 50)]
    with pytest.raises(QueryError):
        Context(as_of=1, space=1, spaces=((1, 2, 0), (2, 1, 0))).ancestry()
    with pytest.raises(QueryError):
        Context(as_of=1, space=1, perspective=1)
    with pytest.raises(QueryError):
        CTX.at(layers=(9,)).selected_layers()


def test_a_retraction_after_the_branch_is_not_seen_in_the_child(spark):
    s = store(spark, [assertion(1, revision=5), assertion(2, revision=5), assertion(3, revision=11)], retractions=[(1, 8), (2, 20)])
    assert ids(S.candidates(s, CTX)) == [2]  # 3 was recorded after the branch
    assert ids(S.candidates(s, CTX.at(space=1))) == [3]


def test_a_mask_after_the_branch_is_seen_in_the_child(spark):
    s = store(spark, [assertion(1, revision=5)], masks=[mask(7, "exact", 1, layer=1, revision=60)])
    assert ids(M.apply_masks(S.candidates(s, CTX), M.active_masks(s, CTX))) == []


@pytest.mark.parametrize("selector,value,polarity,hidden", [("exact", "x", "negative", True), ("proposition", "a", "positive", True), ("proposition", "b", "positive", False), ("proposition", "a", "negative", False), ("slot", "b", "negative", True)])
def test_mask_selectors(spark, selector, value, polarity, hidden):
    s = store(spark, [assertion(1, revision=5)], masks=[mask(7, selector, 1, space=2, value=value, polarity=polarity)])
    assert (ids(M.apply_masks(S.candidates(s, CTX), M.active_masks(s, CTX))) == []) == hidden


def test_masks_of_equal_precedence_or_outside_do_nothing(spark):
    s = store(spark, [assertion(1, revision=5)], masks=[mask(7, "exact", 1), mask(8, "exact", 1, space=9, layer=1), mask(9, "exact", 1, layer=1, revision=200)])
    assert ids(M.apply_masks(S.candidates(s, CTX), M.active_masks(s, CTX))) == [1]


def test_retracted_masks_do_nothing_and_the_least_id_is_traced(spark):
    masks = [mask(9, "slot", 1, space=2), mask(8, "exact", 1, space=2), mask(7, "slot", 1, space=2)]
    s = store(spark, [assertion(1, revision=5)], masks=masks, mask_retractions=[(7, 50)])
    assert M.applied_masks(S.candidates(s, CTX), M.active_masks(s, CTX)).first().mask_id == 8


def test_a_closure_ends_at_its_instant(spark):
    s = store(spark, [assertion(1, revision=5), assertion(2, revision=5)], closures=[(1, 6, 50), (2, 6, 51)])
    assert ids(S.candidates(s, CTX)) == [2]


def test_unarchived_again(spark):
    s = store(spark, [assertion(1, revision=5), assertion(2, revision=5)], transitions=[(1, "archive", 6), (2, "archive", 6), (2, "unarchive", 90)])
    assert ids(S.candidates(s, CTX)) == [2]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_single_value_does_not_depend_on_input_order(spark, order):
    rows = [assertion(1, revision=5), assertion(2, revision=6), assertion(3, space=2, value="b", revision=7)]
    got = R.resolve_single(store(spark, [rows[k] for k in order]), CTX).first()
    assert (got.outcome, got.value, got.contributors) == ("known", "b", "3")


def test_polarity_is_part_of_the_value(spark):
    got = R.resolve_single(store(spark, [assertion(1, revision=5), assertion(2, polarity="negative", revision=5)]), CTX).first()
    assert (got.outcome, got.value, got.contributors) == ("conflict", None, "1,2")


def test_a_boundary_cuts_lower_precedence_and_empties_a_slot(spark):
    low = store(spark, [assertion(1, revision=5, predicate=2)], boundaries=[boundary(1)])
    assert R.resolve_replace(low, CTX).first().outcome == "known_empty"
    equal = store(spark, [assertion(1, revision=5, predicate=2, space=2)], boundaries=[boundary(1)])
    assert R.resolve_replace(equal, CTX).first().outcome == "known"
    none = store(spark, [assertion(1, revision=500, predicate=2)])
    assert R.resolve_replace(none, CTX).first().outcome == "unknown"


def test_overlay_conflicts_per_value(spark):
    rows = [assertion(1, predicate=1, revision=5), assertion(2, predicate=1, polarity="negative", space=2), assertion(3, predicate=1, value="b", revision=5)]
    got = R.resolve_overlay(store(spark, rows), CTX).first()
    assert (got.outcome, got.n_values, got.n_conflicts) == ("conflict", 2, 1)


def test_a_point_agrees_with_its_cell(spark):
    rows = [assertion(1, start=0, end=40, revision=5), assertion(2, start=20, value="b", revision=6), assertion(3, start=30, end=60, value="c", space=2)]
    s = store(spark, rows, closures=[(2, 7, 80)])
    cells = T.all_times_single(s, CTX).collect()
    for t in (-5, 0, 10, 20, 25, 30, 45, 60, 79, 80, 500):
        point = R.resolve_single(s, CTX.at(world_time=t)).first()
        own = [c for c in cells if (c.cell_start is None or c.cell_start <= t) and (c.cell_end is None or t < c.cell_end)]
        assert len(own) == 1 and (own[0].outcome, own[0].value) == (point.outcome, point.value), t


MASKING = [mask(7, "exact", 1, layer=1, start=20, end=60), mask(8, "slot", 1, layer=1, start=None, end=10)]


@pytest.mark.parametrize("t,hidden", [(5, True), (10, False), (19, False), (20, True), (44, True), (45, False), (60, False)])
def test_masks_act_while_they_are_valid(spark, t, hidden):
    s = store(spark, [assertion(1, revision=5)], masks=MASKING, mask_closures=[(7, 6, 45), (8, 500, 0)])
    ctx = CTX.at(world_time=t)
    assert (ids(M.apply_masks(S.candidates(s, ctx), M.active_masks(s, ctx))) == []) == hidden


def test_archived_masks_and_boundaries_do_nothing(spark):
    s = store(spark, [assertion(1, revision=5, predicate=2)], masks=[mask(7, "exact", 1, layer=1)], boundaries=[boundary(7)], transitions=[("mask", 7, "archive", 9), ("boundary", 7, "archive", 9)])
    assert R.resolve_replace(s, CTX).first().outcome == "known"
    assert R.resolve_replace(s, CTX.at(as_of=8)).first().outcome == "known_empty"


@pytest.mark.parametrize("made,outcome", [({}, "known_empty"), ({"boundary_closures": [(1, 5, 50)]}, "known"), ({"boundary_closures": [(1, 5, 51)]}, "known_empty"), ({"boundary_retractions": [(1, 99)]}, "known")])
def test_boundaries_end(spark, made, outcome):
    s = store(spark, [assertion(1, revision=5, predicate=2)], boundaries=[boundary(1, start=10)], **made)
    assert R.resolve_replace(s, CTX).first().outcome == outcome
    assert R.resolve_replace(s, CTX.at(world_time=9)).first().outcome == "known"


def test_slots_without_endpoints_are_one_cell(spark):
    s = store(spark, [assertion(1, start=None, revision=5)], boundaries=[boundary(1, subject=8), boundary(2, subject=9, start=3)])
    assert [(c.cell_start, c.cell_end, c.outcome, c.contributors) for c in T.all_times_single(s, CTX).collect()] == [(None, None, "known", "1")]
    assert sorted((c.subject_id, c.cell_start or 0, c.outcome) for c in T.all_times_replace(s, CTX).collect()) == [(9, 0, "unknown"), (9, 3, "known_empty")]
    every = spark.createDataFrame([(8, 2), (9, 2)], "subject_id long, predicate_id long")
    assert ids(T.complete_empty(every, T.cells(T.Known(s, CTX, 2))), "subject_id") == [8]


@pytest.mark.parametrize("seed", range(2))
def test_points_agree_with_their_cells(spark, seed):
    """Random stores with masks, boundaries and lifecycle, for all three policies."""
    rng = random.Random(seed)
    when = lambda: rng.choice([None, *range(0, 100, 10)])

    def span():
        a, b = when(), when()
        return {"start": a, "end": None if a is not None and b is not None and b <= a else b}

    rows = [assertion(k, space=rng.choice([1, 2]), layer=rng.choice([0, 1]), value=rng.choice("ab"), polarity=rng.choice(["positive", "negative"]), revision=rng.randrange(1, 12), subject=rng.choice([1, 1, 2]), predicate=rng.randrange(3), **span()) for k in range(1, 25)]
    masks = [mask(k, rng.choice(["exact", "proposition", "slot"]), rng.randrange(1, 25), space=rng.choice([1, 2]), layer=rng.choice([0, 1]), value=rng.choice("ab"), predicate=rng.randrange(3), **span()) for k in range(8)]
    s = store(spark, rows, masks, retractions=[(k, 7) for k in (2, 9)], closures=[(k, 9, 10 * rng.randrange(9)) for k in (3, 4, 5)], transitions=[(6, "archive", 8)], boundaries=[boundary(k, space=rng.choice([1, 2]), layer=rng.choice([0, 1]), **span()) for k in range(3)], mask_closures=[(1, 9, 40)], mask_retractions=[(2, 9)], boundary_closures=[(1, 9, 60)])
    whole = [T.all_times_single(s, CTX).collect(), T.all_times_overlay(s, CTX).collect(), T.all_times_replace(s, CTX).collect()]
    for t in (-5, 15, 40, 200):
        ctx = CTX.at(world_time=t)
        for cells, points, show in zip(whole, (R.resolve_single(s, ctx), R.resolve_overlay(s, ctx), R.resolve_replace(s, ctx)), (lambda r: (r.outcome, r.value, r.contributors or ""), lambda r: (r.outcome, r.n_values or 0, r.n_conflicts or 0), lambda r: (r.outcome, r.n_values, r.n_conflicts)), strict=True):
            now = {(c.subject_id, c.predicate_id): show(c) for c in cells if (c.cell_start is None or c.cell_start <= t) and (c.cell_end is None or t < c.cell_end)}
            for p in points.collect():
                slot = (p.subject_id, p.predicate_id)
                assert slot not in now or now[slot] == show(p), (t, slot)


READ = tuple((c, "allow") for c in ("history_space_read", "layer_read", "assertion_read", "mask_read", "replacement_boundary_read", "field_read", "query_resolve"))


def policy(*rules):
    return L.Policy((("ann", "active"), ("bob", "disabled")), (L.Role("reader", READ),), (L.Assignment("ann", "reader"), L.Assignment("bob", "reader")), rules)


def test_hidden_rows_change_nothing(spark):
    """Two worlds that differ only in what may not be read give the same answers: records, masks, boundaries and slots."""
    rights = L.Rights(policy(L.Rule("deny", "layer_read", scope=L.Scope(layer=1))), "ann")
    seen = [assertion(1, revision=5), assertion(3, predicate=2, revision=5)]
    one = store(spark, seen)
    other = store(spark, [*seen, assertion(2, layer=1, value="secret", revision=5), assertion(9, layer=1, subject=77)], masks=[mask(7, "slot", 1, layer=1)], boundaries=[boundary(1, layer=1)], mask_closures=[(7, 5, 99)])
    observe = lambda s: {"single": R.resolve_single(s, CTX, rights=rights), "replace": R.resolve_replace(s, CTX, rights=rights), "cells": T.all_times_single(s, CTX, rights=rights), "facts": S.candidates(s, CTX, allowed=rights.assertions())}
    assert L.paired_worlds(observe, one, other) == []
    assert [k for k, _, _ in L.paired_worlds(lambda s: {"open": R.resolve_single(s, CTX)}, one, other)] == ["open"]


@pytest.mark.parametrize("field", ["mask.selector", "mask.validity"])
def test_masks_need_rights_to_their_fields(spark, field):
    s = store(spark, [assertion(1, revision=5)], masks=[mask(7, "exact", 1, layer=1)])
    assert ids(R.surviving(s, CTX, rights=L.Rights(policy(), "ann"))) == []
    assert ids(R.surviving(s, CTX, rights=L.Rights(policy(L.Rule("deny", "field_read", scope=L.Scope(field=field))), "ann"))) == [1]


def test_policy(spark):
    p = policy(L.Rule("deny", "assertion_read", scope=L.Scope(record=("assertion", 2))), L.Rule("deny", "field_read", ("principal", "ann"), L.Scope(space=3, field="assertion.value/5")), L.Rule("allow", "query_search", scope=L.Scope(layer=1)))
    rows = spark.createDataFrame([(1, 1, 0, 5), (2, 1, 0, 5), (3, 3, 0, 5), (4, 3, 0, 6), (5, None, 0, 6)], "assertion_id long, space_id long, layer_id long, predicate_id long")
    assert ids(rows.filter(L.Rights(p, "ann").assertions())) == [1, 4, 5]
    assert rows.filter(L.Rights(p, "bob").assertions()).isEmpty() and rows.filter(L.Rights(p, "nobody").assertions()).isEmpty()
    assert rows.filter(L.Rights(L.Policy(p.principals, p.roles, (L.Assignment("ann", "reader", L.Scope(space=1)),)), "ann").endpoints("assertion", "assertion_id")).count() == 2  # the role is held in one branch
    # a scoped right is no right to an operation without a target
    assert p.allows("ann", "query_resolve") and not p.allows("ann", "query_search")
    for bad in (lambda: L.Policy((("a", "active"), ("a", "active"))), lambda: L.Policy((), (), (L.Assignment("x", "y"),)), lambda: policy(L.Rule("allow", "fly")), lambda: L.Rights(p, "ann").demand("query_search")):
        with pytest.raises(QueryError):
            bad()
    assert len(L.CAPABILITIES) == len(set(L.CAPABILITIES)) == 78


def test_policy_changes(spark):
    p = policy()
    q = p.with_rule(L.Rule("deny", "query_resolve"))
    assert (p.revision, q.revision) == (0, 1) and p.allows("ann", "query_resolve") and not q.allows("ann", "query_resolve")
    assert q.without_rule(q.rules[0]).allows("ann", "query_resolve") and q.fingerprint("ann") != p.fingerprint("ann")
    assert not p.revoked(L.Assignment("ann", "reader")).allows("ann", "query_resolve")
    assert not p.with_principal("ann", "disabled").allows("ann", "query_resolve")
    assert p.with_principal("eve").assigned(L.Assignment("eve", "reader")).allows("eve", "query_resolve")
    with pytest.raises(QueryError):
        p.with_principal("bob", "active")
    assert L.select_policy([p, q], "ann", 5) is q
    with pytest.raises(QueryError):
        L.select_policy([p, q], "ann", 5, 0)  # no right to earlier permissions now
    r = L.Policy(q.principals, q.roles, q.assignments, (L.Rule("allow", "security_permission_history_read"),), 2)
    assert L.select_policy([p, q, r], "ann", 5, 1) is q
    with pytest.raises(QueryError):
        L.select_policy([p, q, r], "ann", 5, 6)


def relations(spark, rows):
    return spark.createDataFrame(rows, "relation_id long, kind string, from_id long, to_id long")


def test_cycles_over_joined_events(spark):
    chain = [(1, "before", 1, 2), (2, "before", 2, 3)]
    assert E.before_residue(relations(spark, chain)).isEmpty()
    assert ids(E.before_residue(relations(spark, [*chain, (3, "same_time", 1, 3)])), "node") == [1, 2]
    assert ids(E.cycle_residue(spark.createDataFrame([(1, 2), (2, 1), (2, 3), (5, 6)], "a long, b long")), "node") == [1, 2, 3]  # 3 is behind the cycle


@pytest.mark.parametrize("few", [100_000, 0])
def test_components(spark, monkeypatch, few):
    from tidemark.operators import components
    from tidemark.operators.components import connected_components

    monkeypatch.setattr(components, "BROADCAST_EDGES", few)
    path = [(k, k + 1) for k in range(40)] + [(100, 99), (7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def leaves(frame):
    """How many tables the plan reads; a copy of a step counts again."""
    return frame._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_live_rows_are_written_once(spark, monkeypatch):
    rows = [assertion(1, start=0, end=40, revision=5), assertion(2, start=20, value="b", revision=6), assertion(3, start=30, end=60, value="c", space=2), assertion(4, start=None, end=33, value="c", space=2)]
    s = store(spark, rows, MASKING, closures=[(2, 7, 80)])
    assert leaves(T.live(T.Known(s, CTX, 0))) == 1
    whole = T.all_times_single(s, CTX)
    # cells, the rows that they pick from, and which of these cells ask for: no join back to the cells
    assert leaves(whole) == 4
    monkeypatch.setattr(T, "SPAN", 7)
    assert sorted(map(str, T.all_times_single(s, CTX).collect())) == sorted(map(str, whole.collect()))


def test_all_times_with_values_share_their_steps(spark):
    s = store(spark, [assertion(1, start=0, end=40, revision=5, predicate=2)], masks=[mask(7, "slot", 1, layer=1, start=20, end=30, predicate=2)], boundaries=[boundary(1, start=10, end=35)])
    grid = leaves(T.cells(T.Known(s, CTX, 2)))
    assert leaves(T.all_times_overlay(s, CTX, 2)) == grid + 1
    assert leaves(T.all_times_replace(s, CTX)) <= grid + 10


def test_traversal(spark):
    nodes = spark.createDataFrame([(k,) for k in range(6)], "event_id long")
    edges = relations(spark, [(1, "before", 0, 1), (2, "before", 1, 2), (3, "before", 2, 0), (4, "same_time", 3, 1), (5, "before", 2, 9), (6, "causes", 0, 5)])
    n, e = G.traverse(nodes, edges, G.GraphSpec((0,), ("before", "same_time"), max_depth=5))
    assert {r.node: r.depth for r in n.collect()} == {0: 0, 1: 1, 2: 2, 3: 2}
    assert {(r.edge_id, r.from_id, r.to_id) for r in e.collect()} == {(1, 0, 1), (2, 1, 2), (3, 2, 0), (4, 1, 3)}
    n, e = G.traverse(nodes, edges, G.GraphSpec((0,), ("before", "same_time"), max_depth=5, emit_repeated=False))
    assert ids(e, "edge_id") == [1, 2, 4]
    n, _ = G.traverse(nodes, edges, G.GraphSpec((0,), ("before",), "incoming", 1))
    assert ids(n, "node") == [0, 2]
    n, _ = G.traverse(nodes, edges, G.GraphSpec((0, 77), ("before",), max_depth=0))
    assert ids(n, "node") == [0]
    # caps hold at the roots, at every level, and at the last
    for spec in (G.GraphSpec((0,), ("before",), max_nodes=1), G.GraphSpec((0,), ("before",), max_nodes=1, max_depth=1), G.GraphSpec((0, 1), ("before",), max_nodes=1, max_depth=0), G.GraphSpec((0, 1, 2), ("before",), max_edges=2), G.GraphSpec((0,), ("before",), max_depth=3, max_edges=2)):
        with pytest.raises(QueryError):
            G.traverse(nodes, edges, spec)
    with pytest.raises(QueryError):
        G.GraphSpec((), ("before",))


def test_traversal_takes_all_roots(spark, monkeypatch):
    from tidemark import registry

    n = 10_050
    monkeypatch.setattr(E, "visible_events", lambda s, ctx: spark.range(n).selectExpr("id * 500 AS event_id").unionByName(spark.range(1).selectExpr("1L AS event_id")))
    monkeypatch.setattr(E, "visible_relations", lambda s, ctx: relations(spark, [(1, "before", (n - 1) * 500, 1)]))
    got = registry._bfs(None, "outgoing", 1)
    assert got.filter("depth = 0").count() == n
    assert [r.node for r in got.filter("depth = 1").collect()] == [1]


def test_graph_over_facts_has_no_cap(spark, sf_dir, monkeypatch):
    from tidemark import registry

    n = 100_050
    nodes = spark.range(n).selectExpr("id * 7 + 3 AS id").unionByName(spark.range(2, 3)).select(G.typed("assertion", "id").alias("node"))
    edges = relations(spark, [(1, "corrects", 3, 2)]).select(F.col("relation_id").cast("string").alias("relation_id"), "kind", G.typed("assertion", "from_id").alias("from_id"), G.typed("assertion", "to_id").alias("to_id"))
    monkeypatch.setattr(G, "record_graph", lambda s, ctx: (nodes, edges))
    got = registry.queries()["graph_over_facts"](spark, sf_dir)
    assert got.filter("depth = 0").count() == n
    assert [r.id for r in got.filter("depth = 1").collect()] == [2]


def test_search(spark):
    docs = spark.createDataFrame([(1, "a b", "c"), (2, "a\x0bb", None), (3, "A b", ""), (4, None, "b")], "result_key long, text string, title string")
    assert ids(K.search(docs, ["a", "b"]), "result_key") == [1]
    assert ids(K.search(docs, ["a", "c"], ("text", "title")), "result_key") == [1]
    assert ids(K.search(docs, ["b"], ("text", "title"), every=False), "result_key") == [1, 3, 4]
    assert ids(K.full_text(docs, ("not", "b")), "result_key") == [2, 4]
    with pytest.raises(QueryError):
        K.token("a b")


def test_filters_never_let_the_missing_through(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "k int, v int")
    keep = lambda tree: ids(rows.filter(C.compile_filter(tree)), "k")
    assert keep(("is", "v", 5)) == [2]
    assert keep(("not", ("is", "v", 5))) == [1, 3]
    assert keep(("range", "v", 5, 9, True, False)) == [3]
    assert keep(("any", ("exists", "v"), ("match_all",))) == [1, 2, 3]
    deep = ("match_all",)
    for _ in range(40):
        deep = ("not", deep)
    for bad in (deep, ("range", "v", None, None), ("huh",), ("all",)):
        with pytest.raises(QueryError):
            C.compile_filter(bad)


def test_pages_and_cursors(spark):
    now = [0.0]
    cursors = C.Cursors(60, lambda: now[0])
    rows = spark.range(7).withColumnRenamed("id", "k")
    got, cursor, pages = [], None, 0
    while True:
        page, cursor = C.read_page(rows, "k", 3, cursors, {"who": "ann"}, cursor)
        got += [r.k for r in page]
        pages += 1
        if cursor is None:
            break
    assert got == list(range(7)) and pages == 3
    _, cursor = C.read_page(rows, "k", 3, cursors, {"who": "ann"}, max_results=5)
    with pytest.raises(QueryError):  # all pages together
        C.read_page(rows, "k", 3, cursors, {"who": "ann"}, cursor, max_results=5)
    _, cursor = C.read_page(rows, "k", 3, cursors, {"who": "ann"})
    with pytest.raises(QueryError):
        cursors.redeem(cursor, {"who": "bob"})
    with pytest.raises(QueryError):
        cursors.redeem(cursor, {"who": "ann"})  # the failure has dropped it
    _, cursor = C.read_page(rows, "k", 3, cursors, {"who": "ann"})
    now[0] = 61
    with pytest.raises(QueryError):
        cursors.redeem(cursor, {"who": "ann"})


def test_aggregates_refuse(spark):
    rows = spark.createDataFrame([(1, "int"), (1, "text")], "k int, kind string")
    for refuse in (lambda: A.within(rows, 1), lambda: A.one_kind(rows, "kind"), lambda: A.unique_keys(rows, "k"), lambda: A.grouped_count(rows, [])):
        with pytest.raises(QueryError):
            refuse()
    assert A.within(rows, 2).count() == 2


def test_wide_numbers(spark):
    texts = ["-170141183460469231731687303715884105728", "-1.5", "-1.25", "0", "0.001", "1", "10.5", "170141183460469231731687303715884105727", "340282366920938463463374607431768211455"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy(F.rand(1))
    assert [r.k for r in rows.orderBy(V.wide_integer_key(F.col("t"))).collect()] == list(range(len(texts)))
    odd = spark.createDataFrame([("-0.00", "0"), ("007.10", "7.1"), ("-3.", None), ("1e5", None), ("", None), (None, None)], "t string, want string")
    assert all(r.got == r.want for r in odd.withColumn("got", V.decimal_canonical(F.col("t"))).collect())


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    day = lambda t: F.lit(t).cast("date")
    assert str(get(V.calendar_shift(day("2024-01-31"), 0, 1, 0))) == "2024-02-29"
    assert str(get(V.calendar_shift(day("2024-02-29"), 1, 0, 1))) == "2025-03-01"
    ns = V.NANOSECONDS_PER_DAY
    assert get(V.shift_nanoseconds(F.lit(30 * ns + 7), 0, 1, 0)) == 58 * ns + 7
    assert get(V.shift_nanoseconds(F.lit(-ns + 5), 0, 0, 1)) == 5
    assert get(V.world_nanoseconds(F.lit(1 << 62), F.lit(4))) is None
    assert get(V.add_duration(F.lit((1 << 63) - 1), F.lit(1))) is None
    assert get(V.compare_on_timeline(F.lit(1), F.lit(2), F.lit(1), F.lit(3))) == -1
    assert get(V.compare_on_timeline(F.lit(1), F.lit(2), F.lit(2), F.lit(3))) is None
    assert [get(V.varint(F.lit(x).cast("long"))) for x in (0, 127, 128, 300)] == ["00", "7f", "8001", "ac02"]
    assert get(V.urlsafe(F.lit(b"\xfb\xff"))) == "-_8"
    assert get(V.is_symbol(F.lit("a_1"))) and not get(V.is_symbol(F.lit("1a"))) and not get(V.is_symbol(F.lit(None).cast("string")))
    assert get(V.fingerprint(F.lit(None).cast("string"))) != get(V.fingerprint(F.lit("")))
    assert get(V.days_from_civil(F.lit(1970), F.lit(1), F.lit(2))) == 1


def test_writes(spark):
    s = store(spark, [assertion(1), assertion(2, value="zz"), assertion(3, predicate=9), assertion(4, start=5, end=5)])
    predicates = spark.createDataFrame([(0, "active")], "predicate_id long, lifecycle string")
    got = {r.assertion_id: r.reason for r in N.validate_assertions(s.assertions, predicates, ("a",), 10).collect()}
    assert got == {2: "value_not_allowed", 3: "unknown_predicate", 4: "empty_validity"}
    replacements, retractions, edges = N.correct(s.assertions, spark.createDataFrame([(1, "new")], "assertion_id long, value_canon string"), 7, 100)
    assert (replacements.first().value_canon, retractions.first().assertion_id, edges.first().from_id) == ("new", 1, 101)
    assert N.commit(4, 4, {"slot": 3}, {"slot": 3}) == 5
    with pytest.raises(QueryError):
        N.commit(4, 4, {"slot": 3}, {"slot": 4})
    bad = N.value_violations(spark.createDataFrame([("ok",), ("Bad",), (None,), ("longer",)], "v string"), "v", required=True, max_bytes=4, symbol=True)
    assert sorted(r.reason for r in bad.collect()) == ["max_bytes", "required", "symbol"]
    closure = N.purge_closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a long, b long"), spark.createDataFrame([(1,)], "node long"))
    assert ids(closure, "node") == [1, 2, 3]
    assert N.alternation_errors(spark.createDataFrame([(1, "archive", 1), (1, "archive", 2), (2, "archive", 1)], "target_id long, action string, revision long")).count() == 1


def test_database(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    assert db.head() == 0
    assert db.append({"t": spark.range(3)}, 0) == 1 and db.append({"t": spark.range(3, 5)}, 1) == 2
    with pytest.raises(QueryError):
        db.append({"t": spark.range(1)}, 1)
    assert db.read("t", 1).count() == 3 and db.read("t").count() == 5
    assert db.compact("t", ["id"], 2) == 3 and db.read("t").count() == 5
    assert db.compact("t", ["id"], 3) == 3  # nothing to gain
    assert db.reclaim([1]) == 0  # a writer may still be about to publish it
    assert db.reclaim([1], grace=0) == 1 and db.read("t", 1).count() == 3 and db.read("t").count() == 5


def test_stream_of_appends(spark, tmp_path):
    from tidemark.streaming.appends import apply_batches, live_counts, read_log

    source = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "subject_id long, revision long")
    rows.write.parquet(source)
    got = []
    apply_batches(read_log(spark, source, rows.schema), f"file://{tmp_path}/state", lambda batch, number: got.append(batch.count())).awaitTermination()
    assert sum(got) == 3
    query = live_counts(read_log(spark, source, rows.schema), ["subject_id"]).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.subject_id, r.n, r.revision) for r in spark.table("live").collect()} == {(1, 2, 6), (2, 1, 7)}


def test_operations_run_once(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    assert db.once("op", "x", {"t": spark.range(3)}, 0) == 1 and db.once("op", "x", {"t": spark.range(3)}, 0) == 1
    assert db.read("t").count() == 3
    with pytest.raises(QueryError):
        db.once("op", "y", {"t": spark.range(3)}, 1)


def test_a_store_over_a_database(spark, tmp_path):
    made = store(spark, [assertion(1, revision=5), assertion(2, space=2, value="b", revision=6)], masks=[mask(7, "exact", 1, layer=1)])
    made.history_spaces = spark.createDataFrame([(1, None, 0), (2, 1, 10)], "space_id long, parent_id long, base_revision long")
    made.layers = spark.createDataFrame([(0, 0), (1, 10)], "layer_id long, layer_rank long")
    db = Database(spark, f"file://{tmp_path}/db")
    write_store(made, [n for n in vars(made) if n != "spark"], db)
    own = DatabaseStore(db)
    ctx = Context(as_of=100, space=2, world_time=50, **catalog(own))
    assert ctx.spaces == CTX.spaces and ctx.layer_ranks == CTX.layer_ranks
    assert sorted(map(tuple, R.resolve_single(own, ctx).collect())) == sorted(map(tuple, R.resolve_single(made, CTX).collect()))
    db.append({"assertions": spark.createDataFrame([assertion(3, space=2, layer=1, value="c")], ASSERTION)}, 1)
    assert R.resolve_single(DatabaseStore(db), ctx).first().value == "c" and R.resolve_single(own, ctx).first().value == "b"  # the version is pinned
    summary = DatabaseStore(db, 1).database.summary(1).collect()
    kept = spark.createDataFrame(summary)
    assert db.differences(kept, 1).isEmpty() and db.differences(kept, 2).count() == 1
    with pytest.raises(AttributeError):
        own.nothing


def test_exports_are_whole(spark, tmp_path):
    path = f"file://{tmp_path}/export"
    N.write_export(spark.range(10), path)
    assert N.read_export(spark, path).count() == 10
    spark.range(1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(QueryError):
        N.read_export(spark, path)


def test_raw_reads_are_recorded_first(spark, tmp_path):
    from tidemark.sources.derived import Store

    s = Store(spark, "/root/testdata/sf0.001")
    db = Database(spark, f"file://{tmp_path}/db")
    with pytest.raises(QueryError):
        N.admin_raw_read(s, L.Rights(policy(), "ann"), db, 100, "why not")
    allowed = L.Rights(policy(L.Rule("allow", "admin_raw_read")), "ann")
    assert N.admin_raw_read(s, allowed, db, 100, "inspection").count() > 0
    assert [(r.principal, r.allowed) for r in db.read("audit").orderBy("allowed").collect()] == [("ann", False), ("ann", True)]


def test_migrations_go_on_where_they_stopped(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    db.append({"t": spark.range(4).withColumn("v", F.lit(1))}, 0)
    more = lambda rows: rows.withColumn("v", F.col("v") + 1)
    fail = lambda rows: rows.withColumn("v", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        J.migrate(db, [J.Step("one", "rewrite", "t", more), J.Step("two", "rewrite", "t", fail)], 1, "m")
    steps = [J.Step("one", "rewrite", "t", more), J.Step("two", "rewrite", "t", more)]
    assert J.migrate(db, steps, 1, "m") == 3 and J.migrate(db, steps, 1, "m") == 3
    assert {r.v for r in db.read("t").collect()} == {3}
    own = SimpleNamespace(t=db.read("t"))
    assert [tuple(r) for r in J.dry_run(own, steps).collect()] == [(0, 4, 4, 4), (1, 4, 4, 4)]
    assert J.impact(own, steps).count() == 2
    with pytest.raises(QueryError):
        J.Step("x", "magic", "t", more)


def test_jobs_retries_and_cancellation(spark):
    boss = J.Supervisor(spark, cpu=1, io=1, waiting=2)
    assert boss.submit("count", lambda token: spark.range(100).count()).future.result() == 100
    token = J.Token(spark)
    token.cancel()
    with pytest.raises(QueryError):
        token.check()
    slow = boss.submit("slow", lambda t: spark.range(1 << 20).select(F.sum(F.expr("aggregate(sequence(1, 5000), 0L, (a, x) -> a + x * id)"))).collect(), "io")
    while not slow.progress()[1] and not slow.future.done():
        pass
    slow.token.cancel()
    with pytest.raises(Exception):
        slow.future.result()
    boss.close()
    tries = []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise QueryError("conflict")
        return "done"

    assert J.retried(work) == "done"
    with pytest.raises(QueryError):
        J.retried(lambda: N.commit(1, 1, {"a": 0}, {"a": 1}), 2)


def test_transactions_are_checked(spark):
    from tidemark.sources.derived import Store

    s, ctx = Store(spark, "/root/testdata/sf0.001"), Context(as_of=6000, space=4)
    errors = {r.check: r.n for r in X.transaction_errors(s, ctx, assertions=s.assertions.limit(3).unionByName(s.assertions.limit(1).withColumns({"space_id": F.lit(99).cast("long"), "assertion_id": F.lit(-1).cast("long")})), relations=s.planted_relations.filter("kind = 'before'").withColumn("relation_id", F.col("relation_id") + 10**6)).collect()}
    assert errors["repeated_assertions"] == 3 and errors["assertions_without_branch"] == 1 and errors["assertions_without_layer"] == 0
    assert errors["before_cycle"] > 0 and errors["causes_cycle"] == 0 and errors["dependency_cycle"] == 0


def test_catalog_and_schema_changes(spark):
    spaces = ((1, None, 0),)
    assert X.with_branch(spaces, 2, 1, 5, 9) == ((1, None, 0), (2, 1, 5))
    assert X.with_layer(((0, 0),), 1, 10) == ((0, 0), (1, 10))
    defined = spark.createDataFrame([(1, 5, "p", "deprecated")], "predicate_id long, revision long, policy string, lifecycle string")
    draft = lambda life: spark.createDataFrame([(1, "p", life)], "predicate_id long, policy string, lifecycle string")
    assert X.publish_schema(defined, draft("retired"), 6).first().revision == 6
    known = spark.createDataFrame([(1, "a", 1)], "perspective_id long, label string, revision long")
    none, gone = spark.createDataFrame([], "perspective_id long, revision long"), spark.createDataFrame([(1, 2)], "perspective_id long, revision long")
    new = known.select("perspective_id", F.lit("b").alias("label"))
    assert X.perspective_change(known, none, new, 3).first().label == "b"
    moves = spark.createDataFrame([(1, "archive", 2)], "target_id long, action string, revision long")
    assert X.archive(moves, known.select(F.col("perspective_id").alias("target_id")), "unarchive", 3).first().action == "unarchive"
    assert X.retract(known, "perspective_id", known, 9).first().revision == 9
    for bad in (lambda: X.with_branch(spaces, 1, None, 0, 9), lambda: X.with_branch(spaces, 2, 1, 10, 9), lambda: X.with_layer(((0, 0),), 1, 0)):
        with pytest.raises(QueryError):
            bad()
    for lazy in (X.publish_schema(defined, draft("active"), 6), X.publish_schema(defined, draft("retired"), 5), X.perspective_change(known, gone, new, 3), X.archive(moves, moves, "archive", 3), X.retract(known, "perspective_id", spark.createDataFrame([(8,)], "perspective_id long"), 9)):
        with pytest.raises(Exception):
            lazy.collect()


def test_windows_and_sorting(spark):
    assert C.calendar_window("1970-01-31", months=1) == (30, 58) and C.calendar_window("1970-03-01", days=-2) == (57, 59)
    with pytest.raises(QueryError):
        C.calendar_window("1970-01-31")
    with pytest.raises(QueryError):
        C.check_sort("search", [("kind", "asc", "first")])
    rows = spark.createDataFrame([(1, "int", "5", 3), (2, "text", "5", 9), (3, None, None, None)], "k int, kind string, v string, t int")
    assert ids(rows.filter(C.compile_filter(("equals", "kind", "v", "int", "5"))), "k") == [1]
    assert ids(rows.filter(C.compile_filter(("instant_within", "t", 3, 9))), "k") == [1]


def test_search_sessions(spark):
    docs = spark.createDataFrame([(k, "a b", 1, k % 2) for k in range(7)], "result_key long, text string, space_id long, layer_id long")
    now = [policy(L.Rule("allow", "query_search"))]
    session = K.SearchSession(docs, ["a"], lambda: L.Rights(now[0], "ann"), C.Cursors(), 3)
    hits, cursor = session.page()
    assert [h.result_key for h in hits] == [0, 1, 2]
    now[0] = now[0].with_rule(L.Rule("deny", "assertion_read", scope=L.Scope(record=("assertion", 4))))
    hits, cursor = session.page(cursor)  # rights are looked at again
    assert [h.result_key for h in hits] == [3, 5, 6] and cursor is None
    assert K.search_records(docs, ["a"], L.Rights(now[0], "ann"), "event", ("locator",)).isEmpty()
    with pytest.raises(QueryError):
        K.search_records(docs, ["a"], L.Rights(policy(), "ann"))
    with pytest.raises(QueryError):
        K.SearchSession(docs, ["a"], None, C.Cursors(), 501)


def test_explanations_are_checked():
    good = [{"stage": "candidate_scan", "in": [], "out": [1, 2], "applied": []}, {"stage": "mask_projection", "in": [1, 2], "out": [2], "applied": [7]}, {"stage": "resolution", "in": [2], "out": [2], "applied": []}]
    R.check_stages(good)
    for change in ({"out": [3]}, {"in": [1]}, {"applied": [7, 7]}, {"stage": "candidate_scan"}):
        with pytest.raises(QueryError):
            R.check_stages([good[0], good[1] | change, good[2]])


def test_raw_history_refuses_repeated_records(spark):
    rows = spark.createDataFrame([(0, "assertion", 1, 5), (0, "assertion", 1, 5)], "tag int, family string, id long, revision long")
    with pytest.raises(Exception, match="twice"):
        S.canonical(rows).collect()
    assert S.canonical(rows.distinct()).count() == 1


def test_one_slot_within_its_budget(spark):
    s = store(spark, [assertion(1, revision=5), assertion(2, space=2, revision=6), assertion(3, predicate=2, revision=5), assertion(4, predicate=1, polarity="negative", revision=5)], boundaries=[boundary(1)])
    s.schema_predicates = spark.createDataFrame([(k, 1, p) for k, p in enumerate(R.POLICIES)], "predicate_id long, revision long, policy string")
    assert [R.resolve_point(s, CTX, 1, k).first().outcome for k in range(3)] == ["known", "known", "known_empty"]
    with pytest.raises(QueryError):
        R.resolve_point(s, CTX.at(max_candidates=1), 1, 0)
    with pytest.raises(QueryError):
        R.resolve_point(s, CTX, 1, 9)

"""Queries of the knowledge engine itself, with SQL for each that runs on another engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import aggregate as A
from tidemark.operators import events as E
from tidemark.operators import evidence as I
from tidemark.operators import filters as C
from tidemark.operators import graph as G
from tidemark.operators import masks as M
from tidemark.operators import movement as N
from tidemark.operators import resolve as R
from tidemark.operators import jobs as J
from tidemark.operators import scan as S
from tidemark.operators import search as K
from tidemark.operators import security as L
from tidemark.operators import times as T
from tidemark.operators import transactions as X
from tidemark.operators.components import shared_folder
from tidemark.plans.context import Context, catalog, precedence
from tidemark.sources.derived import Store, ansi_views
from tidemark.sources.tables import Database, DatabaseStore, write_store

AS_OF, WORLD_DAY, SPACE = 6000, 10200, 4
CTX = Context(as_of=AS_OF, space=SPACE, world_time=WORLD_DAY)
FROM_US, TO_US = 1_710_000_000_000_000, 1_712_000_000_000_000
BELIEVER = CTX.at(perspective=1, mode="believes")
READING = ("project_read", "schema_read", "history_space_read", "layer_read", "assertion_read", "event_read", "mask_read", "event_mask_read", "replacement_boundary_read", "lifecycle_read", "source_read", "evidence_read", "provenance_read", "field_read", "relationship_read", "query_resolve", "query_search", "query_explain", "query_graph_traverse", "query_aggregate", "raw_history_read")
POLICY = L.Policy(
    principals=(("ann", "active"), ("bob", "disabled"), ("cat", "active")),
    roles=(L.Role("reader", tuple((c, "allow") for c in READING)),),
    assignments=tuple(L.Assignment(p, "reader") for p in ("ann", "bob", "cat")),
    rules=(
        L.Rule("deny", "layer_read", ("principal", "ann"), L.Scope(layer=2)),
        L.Rule("deny", "history_space_read", ("principal", "ann"), L.Scope(space=1)),
        L.Rule("deny", "assertion_read", ("principal", "ann"), L.Scope(record=("assertion", 13))),
        L.Rule("deny", "source_read", ("principal", "ann"), L.Scope(record=("source", 3))),
        L.Rule("deny", "relationship_read", ("principal", "ann"), L.Scope(relationship="evidence/contradicts")),
        L.Rule("deny", "mask_read", ("principal", "cat"), L.Scope(space=4)),
        L.Rule("deny", "field_read", ("principal", "cat"), L.Scope(field="replacement_boundary.validity")),
        L.Rule("deny", "field_read", ("principal", "cat"), L.Scope(field="assertion.value/1")),
        L.Rule("deny", "field_read", ("principal", "cat"), L.Scope(space=3, field="assertion.text")),
        L.Rule("deny", "relationship_read", ("principal", "cat"), L.Scope(relationship="event/before")),
    ),
)
ANN, BOB, CAT = (L.Rights(POLICY, p) for p in ("ann", "bob", "cat"))
#: What ann may see of assertions, and cat, for the oracle.
ANN_SEES, CAT_SEES = "layer_id <> 2 AND space_id <> 1 AND assertion_id <> 13", "predicate_id <> 1"

#: Name -> (query, SQL after the common table expressions, or None).
REGISTRY: dict = {}

#: What the context above sees, for the oracle.
LOW, HIGH = -(1 << 62), 1 << 62
SEEN = f"""
vis(space_id, distance, cutoff) AS (
  SELECT {SPACE}, 0, {AS_OF} UNION ALL
  SELECT s.parent_id, v.distance + 1, least(v.cutoff, s.base_revision) FROM vis v JOIN history_spaces s ON s.space_id = v.space_id WHERE s.parent_id IS NOT NULL),
prec AS (SELECT v.space_id, v.cutoff, l.layer_id, -v.distance * 1000 + l.layer_rank AS prec, v.distance, l.layer_rank FROM vis v CROSS JOIN layers l),
hid AS (SELECT target_kind, target_id FROM (SELECT *, row_number() OVER (PARTITION BY target_kind, target_id ORDER BY revision DESC) AS r FROM archive_transitions WHERE revision <= {AS_OF}) WHERE r = 1 AND action = 'archive'),
hidden AS (SELECT target_id FROM hid WHERE target_kind = 'assertion'),
timeless AS (
  SELECT a.*, p.prec, p.cutoff FROM assertions a JOIN prec p ON p.space_id = a.space_id AND p.layer_id = a.layer_id
  WHERE a.revision <= p.cutoff AND a.perspective_id = 0 AND a.mode = 'world_state' AND a.assertion_id NOT IN (SELECT target_id FROM hidden)
    AND NOT EXISTS (SELECT 1 FROM assertion_retractions r WHERE r.assertion_id = a.assertion_id AND r.revision <= p.cutoff)),
cand AS (
  SELECT * FROM timeless a WHERE (valid_start IS NULL OR valid_start <= {WORLD_DAY}) AND (valid_end IS NULL OR valid_end > {WORLD_DAY})
    AND NOT EXISTS (SELECT 1 FROM assertion_closures c WHERE c.assertion_id = a.assertion_id AND c.revision <= a.cutoff AND c.close_at <= {WORLD_DAY})),
kmask AS (
  SELECT m.*, p.prec, coalesce(valid_start, {LOW}) AS since, least(coalesce(valid_end, {HIGH}), coalesce((SELECT min(close_at) FROM mask_closures c WHERE c.mask_id = m.mask_id AND c.revision <= {AS_OF}), {HIGH})) AS until
  FROM masks m JOIN prec p ON p.space_id = m.space_id AND p.layer_id = m.layer_id
  WHERE m.revision <= {AS_OF} AND m.perspective_id = 0 AND m.mode = 'world_state' AND m.mask_id NOT IN (SELECT target_id FROM hid WHERE target_kind = 'mask')),
tmask AS (SELECT * FROM kmask m WHERE NOT EXISTS (SELECT 1 FROM mask_retractions r WHERE r.mask_id = m.mask_id AND r.revision <= {AS_OF})),
amask AS (SELECT * FROM tmask WHERE since <= {WORLD_DAY} AND until > {WORLD_DAY}),
hits AS (
  SELECT c.assertion_id, m.mask_id FROM timeless c JOIN amask m ON m.prec > c.prec AND (
    (m.selector = 'exact' AND m.assertion_id = c.assertion_id) OR
    (m.selector = 'proposition' AND m.subject_id = c.subject_id AND m.predicate_id = c.predicate_id AND m.value_canon = c.value_canon AND m.polarity = c.polarity) OR
    (m.selector = 'slot' AND m.subject_id = c.subject_id AND m.predicate_id = c.predicate_id))),
surv AS (SELECT * FROM cand WHERE assertion_id NOT IN (SELECT assertion_id FROM hits)),
kbnd AS (
  SELECT b.*, p.prec, coalesce(valid_start, {LOW}) AS since, least(coalesce(valid_end, {HIGH}), coalesce((SELECT min(close_at) FROM boundary_closures c WHERE c.boundary_id = b.boundary_id AND c.revision <= {AS_OF}), {HIGH})) AS until
  FROM boundaries b JOIN prec p ON p.space_id = b.space_id AND p.layer_id = b.layer_id
  WHERE b.revision <= {AS_OF} AND b.perspective_id = 0 AND b.mode = 'world_state' AND b.boundary_id NOT IN (SELECT target_id FROM hid WHERE target_kind = 'boundary')),
tbnd AS (SELECT * FROM kbnd b WHERE NOT EXISTS (SELECT 1 FROM boundary_retractions r WHERE r.boundary_id = b.boundary_id AND r.revision <= {AS_OF})),
abnd AS (SELECT * FROM tbnd WHERE since <= {WORLD_DAY} AND until > {WORLD_DAY}),
bnd AS (SELECT subject_id, predicate_id, max(prec) AS prec FROM abnd GROUP BY 1, 2),
ev0 AS (
  SELECT e.*, p.prec, p.distance, CASE WHEN e.is_span AND e.end_us IS NULL THEN (SELECT min(c.close_at) FROM event_span_closures c WHERE c.event_id = e.event_id AND c.revision <= {AS_OF}) ELSE e.end_us END AS effective_end
  FROM world_events e JOIN prec p ON p.space_id = e.space_id AND p.layer_id = e.layer_id
  WHERE e.revision <= {AS_OF} AND NOT EXISTS (SELECT 1 FROM event_retractions r WHERE r.event_id = e.event_id AND r.revision <= {AS_OF})
    AND e.event_id NOT IN (SELECT target_id FROM event_archive_transitions WHERE revision <= {AS_OF})),
aemask AS (SELECT m.*, q.prec FROM event_masks m JOIN prec q ON q.space_id = m.space_id AND q.layer_id = m.layer_id
  WHERE m.revision <= {AS_OF} AND NOT EXISTS (SELECT 1 FROM event_mask_retractions r WHERE r.event_mask_id = m.event_mask_id AND r.revision <= {AS_OF})),
ev AS (SELECT * FROM ev0 e WHERE NOT EXISTS (SELECT 1 FROM aemask m WHERE m.event_id = e.event_id AND m.prec > e.prec)),
rel AS (SELECT relation_id, CASE kind WHEN 'after' THEN 'before' ELSE kind END AS kind, CASE kind WHEN 'after' THEN to_id WHEN 'same_time' THEN least(from_id, to_id) ELSE from_id END AS from_id,
    CASE kind WHEN 'after' THEN from_id WHEN 'same_time' THEN greatest(from_id, to_id) ELSE to_id END AS to_id, revision
  FROM event_relations r WHERE revision <= {AS_OF} AND NOT EXISTS (SELECT 1 FROM event_relation_retractions x WHERE x.relation_id = r.relation_id AND x.revision <= {AS_OF})),
vrel AS (SELECT * FROM rel WHERE from_id IN (SELECT event_id FROM ev) AND to_id IN (SELECT event_id FROM ev)),
prov AS (SELECT * FROM provenance e WHERE revision <= {AS_OF} AND NOT EXISTS (SELECT 1 FROM provenance_retractions x WHERE x.edge_id = e.edge_id AND x.revision <= {AS_OF}))
"""


def register(name: str, sql: str | None = None):
    def take(query):
        REGISTRY[name] = (lambda spark, sf_dir: query(Store(spark, sf_dir)), sql)
        return query

    return take


IDS = "coalesce(string_agg(CAST(assertion_id AS VARCHAR), ',' ORDER BY assertion_id), '')"


def _single_sql(source: str, predicate: int = 0, slots: str = "assertions") -> str:
    return f""", best AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY subject_id, predicate_id ORDER BY prec DESC) AS r FROM ({source}) WHERE predicate_id = {predicate}) WHERE r = 1),
res AS (SELECT subject_id, predicate_id, count(DISTINCT value_canon || '|' || polarity) AS kinds, min(value_canon) AS v, min(polarity) AS p, {IDS} AS contributors FROM best GROUP BY 1, 2)
SELECT s.subject_id, s.predicate_id, CASE WHEN kinds IS NULL THEN 'unknown' WHEN kinds = 1 THEN 'known' ELSE 'conflict' END AS outcome,
  CASE WHEN kinds = 1 THEN v END AS value, CASE WHEN kinds = 1 THEN p END AS polarity, contributors
FROM (SELECT DISTINCT subject_id, predicate_id FROM {slots} WHERE predicate_id = {predicate}) s LEFT JOIN res USING (subject_id, predicate_id)"""


# scans

@register("asof_scan", "SELECT a.assertion_id, a.space_id, a.revision, v.distance FROM assertions a JOIN vis v USING (space_id) WHERE a.revision <= v.cutoff")
def _(s):
    return S.as_of(s.assertions, CTX).select("assertion_id", "space_id", "revision", "distance")


@register("ancestry_cutoffs", "SELECT CAST(space_id AS BIGINT) AS space_id, CAST(distance AS INTEGER) AS distance, CAST(cutoff AS BIGINT) AS cutoff FROM vis")
def _(s):
    return CTX.visible_spaces(s.spark)


@register("raw_log", f"SELECT assertion_id, revision FROM assertions WHERE revision <= {AS_OF}")
def _(s):
    return S.raw_log(s.assertions, AS_OF).select("assertion_id", "revision")


RAW_SQL = " UNION ALL ".join(f"SELECT {k} AS tag, '{f}' AS family, CAST({key} AS BIGINT) AS id, CAST(revision AS BIGINT) AS revision FROM {t} WHERE revision <= {AS_OF}" for k, (f, t, key, _) in enumerate(S.RAW_FAMILIES))


@register("raw_history", RAW_SQL)
def _(s):
    return S.raw_history(s, AS_OF)


def _raw_sql(k: int, family: str, table: str, key: str, owner) -> str:
    """What ann may read raw: nothing of branch 1, not assertion 13, not source 3."""
    extra = {"assertion": " AND x.assertion_id <> 13", "source": " AND x.source_id <> 3"}.get(family, "")
    branch = f" JOIN {owner[0]} o ON o.{owner[1]} = x.{key} AND o.space_id <> 1" if owner else ""
    return f"SELECT {k} AS tag, '{family}' AS family, CAST(x.{key} AS BIGINT) AS id, CAST(x.revision AS BIGINT) AS revision FROM {table} x{branch} WHERE x.revision <= {AS_OF}{extra}"


@register("raw_history_authorized", " UNION ALL ".join(_raw_sql(k, *family) for k, family in enumerate(S.RAW_FAMILIES)))
def _(s):
    return S.raw_history(s, AS_OF, ANN)


@register("candidates", "SELECT c.assertion_id, c.subject_id, c.predicate_id, p.distance, CAST(p.layer_rank AS BIGINT) AS layer_rank FROM cand c JOIN prec p ON p.space_id = c.space_id AND p.layer_id = c.layer_id")
def _(s):
    return S.candidates(s, CTX).select("assertion_id", "subject_id", "predicate_id", "distance", F.col("prec.layer_rank").alias("layer_rank"))


@register("candidates_point", "SELECT assertion_id, value_canon, polarity FROM cand WHERE subject_id = 7 AND predicate_id = 1")
def _(s):
    return S.candidates(s, CTX, subject=7, predicate=1).select("assertion_id", "value_canon", "polarity")


@register("candidates_believed", f"""SELECT a.assertion_id FROM assertions a JOIN prec p ON p.space_id = a.space_id AND p.layer_id = a.layer_id WHERE a.revision <= p.cutoff AND a.perspective_id = 1 AND a.mode = 'believes'
 AND a.assertion_id NOT IN (SELECT target_id FROM hidden) AND NOT EXISTS (SELECT 1 FROM assertion_retractions r WHERE r.assertion_id = a.assertion_id AND r.revision <= p.cutoff)
 AND (valid_start IS NULL OR valid_start <= {WORLD_DAY}) AND (valid_end IS NULL OR valid_end > {WORLD_DAY}) AND NOT EXISTS (SELECT 1 FROM assertion_closures c WHERE c.assertion_id = a.assertion_id AND c.revision <= p.cutoff AND c.close_at <= {WORLD_DAY})""")
def _(s):
    return S.candidates(s, BELIEVER).select("assertion_id")


@register("candidates_authorized", f"SELECT assertion_id FROM cand WHERE {ANN_SEES}")
def _(s):
    return S.candidates(s, CTX, allowed=ANN.assertions()).select("assertion_id")


@register("base_layer_candidates", "SELECT assertion_id FROM cand WHERE layer_id = 0")
def _(s):
    return S.candidates(s, CTX.at(layers="base")).select("assertion_id")


@register("entity_history", "SELECT a.assertion_id, a.predicate_id, a.revision FROM assertions a JOIN vis v USING (space_id) WHERE a.revision <= v.cutoff AND perspective_id = 0 AND mode = 'world_state' AND subject_id = 7")
def _(s):
    return S.history(s, CTX, subject=7).select("assertion_id", "predicate_id", "revision")


@register("predicate_history", "SELECT a.assertion_id, a.subject_id, a.revision FROM assertions a JOIN vis v USING (space_id) WHERE a.revision <= v.cutoff AND perspective_id = 0 AND mode = 'world_state' AND predicate_id = 2")
def _(s):
    return S.history(s, CTX, predicate=2).select("assertion_id", "subject_id", "revision")


@register("point_history", "SELECT a.assertion_id, a.revision, a.value_canon FROM assertions a JOIN vis v USING (space_id) WHERE a.revision <= v.cutoff AND perspective_id = 0 AND mode = 'world_state' AND subject_id = 7 AND predicate_id = 1")
def _(s):
    return S.history(s, CTX, subject=7, predicate=1).select("assertion_id", "revision", "value_canon")


LIFECYCLE_SQL = f"SELECT 'retraction' AS kind, assertion_id, revision FROM assertion_retractions WHERE revision <= {AS_OF} UNION ALL SELECT 'closure', assertion_id, revision FROM assertion_closures WHERE revision <= {AS_OF}"


@register("lifecycle_through", LIFECYCLE_SQL)
def _(s):
    return S.lifecycle(s, AS_OF)


@register("lifecycle_of_target", f"SELECT * FROM ({LIFECYCLE_SQL}) WHERE assertion_id = 221")
def _(s):
    return S.lifecycle(s, AS_OF, 221)


@register("record_lookup", "SELECT * FROM assertions WHERE assertion_id = 1234")
def _(s):
    return S.record(s, "assertion", 1234)


@register("slot_history", f""", a AS (SELECT a.assertion_id, a.revision, v.cutoff FROM assertions a JOIN vis v USING (space_id) WHERE a.revision <= v.cutoff AND perspective_id = 0 AND mode = 'world_state' AND subject_id = 7 AND predicate_id = 2),
m AS (SELECT mask_id, revision FROM masks WHERE revision <= {AS_OF} AND perspective_id = 0 AND mode = 'world_state' AND space_id IN (SELECT space_id FROM vis) AND CASE WHEN selector = 'exact' THEN assertion_id IN (SELECT assertion_id FROM a) ELSE subject_id = 7 AND predicate_id = 2 END),
b AS (SELECT boundary_id, revision FROM boundaries WHERE revision <= {AS_OF} AND space_id IN (SELECT space_id FROM vis) AND subject_id = 7 AND predicate_id = 2)
SELECT 'assertion' AS family, assertion_id AS id, revision FROM a UNION ALL SELECT 'assertion_retraction', r.assertion_id, r.revision FROM assertion_retractions r JOIN a ON a.assertion_id = r.assertion_id AND r.revision <= a.cutoff
UNION ALL SELECT 'assertion_closure', r.assertion_id, r.revision FROM assertion_closures r JOIN a ON a.assertion_id = r.assertion_id AND r.revision <= a.cutoff
UNION ALL SELECT 'mask', mask_id, revision FROM m UNION ALL SELECT 'mask_retraction', mask_id, revision FROM mask_retractions WHERE revision <= {AS_OF} AND mask_id IN (SELECT mask_id FROM m)
UNION ALL SELECT 'mask_closure', mask_id, revision FROM mask_closures WHERE revision <= {AS_OF} AND mask_id IN (SELECT mask_id FROM m)
UNION ALL SELECT 'boundary', boundary_id, revision FROM b UNION ALL SELECT 'boundary_retraction', boundary_id, revision FROM boundary_retractions WHERE revision <= {AS_OF} AND boundary_id IN (SELECT boundary_id FROM b)
UNION ALL SELECT 'boundary_closure', boundary_id, revision FROM boundary_closures WHERE revision <= {AS_OF} AND boundary_id IN (SELECT boundary_id FROM b)""")
def _(s):
    return S.slot_history(s, CTX, 7, 2)


@register("entity_catalog", f"SELECT e.entity_id, entity_type, r.retired_at FROM entities e LEFT JOIN (SELECT entity_id, min(revision) AS retired_at FROM entity_retirements WHERE revision <= {AS_OF} GROUP BY 1) r USING (entity_id) WHERE revision <= {AS_OF}")
def _(s):
    return S.entities(s, AS_OF)


@register("perspective_catalog", f"SELECT p.perspective_id, label, coalesce(r.retired_at >= p.revision, false) AS retired FROM (SELECT *, row_number() OVER (PARTITION BY perspective_id ORDER BY revision DESC) AS k FROM perspectives WHERE revision <= {AS_OF}) p LEFT JOIN (SELECT perspective_id, max(revision) AS retired_at FROM perspective_retirements WHERE revision <= {AS_OF} GROUP BY 1) r USING (perspective_id) WHERE k = 1")
def _(s):
    return S.perspectives(s, AS_OF)


@register("project_metadata", f"SELECT 'space' AS kind, CAST(space_id AS BIGINT) AS id, concat_ws(':', parent_id, base_revision) AS detail FROM history_spaces WHERE base_revision <= {AS_OF} UNION ALL SELECT 'layer', layer_id, CAST(layer_rank AS VARCHAR) FROM layers UNION ALL SELECT 'predicate', predicate_id, policy FROM (SELECT *, row_number() OVER (PARTITION BY predicate_id ORDER BY revision DESC) AS k FROM schema_predicates WHERE revision <= {AS_OF}) WHERE k = 1")
def _(s):
    return S.project(s, AS_OF)


@register("facts_readable", f"SELECT 'assertion' AS family, assertion_id AS id FROM assertions WHERE revision <= {AS_OF} AND {ANN_SEES} UNION ALL SELECT 'mask', mask_id FROM masks WHERE revision <= {AS_OF} AND layer_id <> 2 AND space_id <> 1 UNION ALL SELECT 'boundary', boundary_id FROM boundaries WHERE revision <= {AS_OF} AND layer_id <> 2 AND space_id <> 1 UNION ALL SELECT 'event', event_id FROM world_events WHERE revision <= {AS_OF} AND layer_id <> 2 AND space_id <> 1")
def _(s):
    return S.facts(s, AS_OF, ANN)


@register("schema_at", f"SELECT predicate_id, policy, lifecycle, revision FROM (SELECT *, row_number() OVER (PARTITION BY predicate_id ORDER BY revision DESC) AS r FROM schema_predicates WHERE revision <= {AS_OF}) WHERE r = 1")
def _(s):
    return S.latest(s.schema_predicates, "predicate_id", AS_OF).select("predicate_id", "policy", "lifecycle", "revision")


@register("schema_history", "SELECT predicate_id, revision, policy FROM schema_predicates WHERE predicate_id = 1")
def _(s):
    return S.definitions(s, 1).select("predicate_id", "revision", "policy")


STAB = f"(valid_start IS NULL OR valid_start <= {WORLD_DAY}) AND (valid_end IS NULL OR valid_end > {WORLD_DAY})"


@register("validity_stabbing", f"SELECT 'assertion' AS family, assertion_id AS id FROM assertions WHERE {STAB} UNION ALL SELECT 'mask', mask_id FROM masks WHERE {STAB} UNION ALL SELECT 'boundary', boundary_id FROM boundaries WHERE {STAB}")
def _(s):
    return S.valid_at(s, WORLD_DAY)


@register("archive_state", f"SELECT target_kind, target_id, action, revision FROM (SELECT *, row_number() OVER (PARTITION BY target_kind, target_id ORDER BY revision DESC) AS r FROM archive_transitions WHERE revision <= {AS_OF}) WHERE r = 1")
def _(s):
    return S.latest(s.archive_transitions, ["target_kind", "target_id"], AS_OF).select("target_kind", "target_id", "action", "revision")


@register("ordinary_targets", f"SELECT assertion_id FROM assertions WHERE revision <= {AS_OF} AND assertion_id NOT IN (SELECT target_id FROM hidden)")
def _(s):
    hidden = S.archived(s.archive_transitions, AS_OF).withColumnRenamed("target_id", "assertion_id")
    return S.raw_log(s.assertions, AS_OF).join(hidden, "assertion_id", "left_anti").select("assertion_id")


# masks and resolution

for _selector in M.SELECTORS:
    def _masked(s, selector=_selector):
        masks = M.active_masks(s, CTX).filter(F.col("selector") == selector)
        return M.applied_masks(S.candidates(s, CTX), masks).select("assertion_id")

    register(f"mask_{_selector}", f"SELECT DISTINCT h.assertion_id FROM hits h JOIN masks m USING (mask_id) WHERE m.selector = '{_selector}' AND h.assertion_id IN (SELECT assertion_id FROM cand)")(_masked)


@register("mask_trace", "SELECT assertion_id, min(mask_id) AS mask_id FROM hits WHERE assertion_id IN (SELECT assertion_id FROM cand) GROUP BY assertion_id")
def _(s):
    return M.applied_masks(S.candidates(s, CTX), M.active_masks(s, CTX))


@register("mask_survivors", "SELECT assertion_id FROM surv")
def _(s):
    return M.apply_masks(S.candidates(s, CTX), M.active_masks(s, CTX)).select("assertion_id")


@register("masks_for_slot", "SELECT mask_id, selector FROM amask WHERE subject_id = 7")
def _(s):
    return M.active_masks(s, CTX).filter(F.col("subject_id") == 7).select("mask_id", "selector")


@register("boundary_cutoffs", "SELECT subject_id, predicate_id, CAST(prec AS BIGINT) AS prec FROM bnd")
def _(s):
    steps = F.array(*(F.lit(near * 1000 + rank).cast("long") for near, rank in CTX.levels()))
    return R.boundary_cutoffs(s, CTX).select("subject_id", "predicate_id", F.element_at(steps, (F.col("boundary_level") + 1).cast("int")).alias("prec"))


@register("resolve_single_point", _single_sql("SELECT * FROM surv"))
def _(s):
    return R.resolve_single(s, CTX)


@register("secure_resolve", _single_sql(f"SELECT * FROM cand WHERE {ANN_SEES}", slots=f"(SELECT * FROM assertions WHERE {ANN_SEES})"))
def _(s):
    return R.resolve_single(s, CTX, rights=ANN)  # every mask is in a layer that ann may not read


@register("secure_resolve_inactive", _single_sql("SELECT * FROM surv WHERE false", slots="(SELECT * FROM assertions WHERE false)"))
def _(s):
    return R.resolve_single(s, CTX, rights=BOB)


CAT_SURVIVORS = f"SELECT * FROM cand WHERE {CAT_SEES} AND assertion_id NOT IN (SELECT h.assertion_id FROM hits h JOIN masks m USING (mask_id) WHERE m.space_id <> 4)"


@register("secure_masks", f"SELECT assertion_id FROM ({CAT_SURVIVORS})")
def _(s):
    return R.surviving(s, CTX, rights=CAT).select("assertion_id")


MULTI_SQL = """SELECT subject_id, predicate_id, value_canon AS value,
  coalesce(string_agg(CAST(assertion_id AS VARCHAR), ',' ORDER BY assertion_id) FILTER (polarity = 'positive'), '') AS positive,
  coalesce(string_agg(CAST(assertion_id AS VARCHAR), ',' ORDER BY assertion_id) FILTER (polarity = 'negative'), '') AS negative,
  CASE WHEN count(DISTINCT polarity) = 2 THEN 'conflict' ELSE min(polarity) END AS state FROM {0} WHERE predicate_id = {1} GROUP BY 1, 2, 3"""


@register("overlay_values", MULTI_SQL.format("surv", 1))
def _(s):
    return R.multi_value(R.surviving(s, CTX, 1))


@register("resolve_overlay", f""", v AS ({MULTI_SQL.format('surv', 1)}), o AS (SELECT subject_id, predicate_id, count(*) AS n_values, count(*) FILTER (state = 'conflict') AS n_conflicts FROM v GROUP BY 1, 2)
SELECT s.*, CASE WHEN n_values IS NULL THEN 'unknown' WHEN n_conflicts > 0 THEN 'conflict' ELSE 'known' END AS outcome, n_values, n_conflicts FROM (SELECT DISTINCT subject_id, predicate_id FROM assertions WHERE predicate_id = 1) s LEFT JOIN o USING (subject_id, predicate_id)""")
def _(s):
    return R.resolve_overlay(s, CTX)


AFTER_BOUNDARY = "SELECT c.* FROM surv c LEFT JOIN bnd b ON b.subject_id = c.subject_id AND b.predicate_id = c.predicate_id WHERE b.prec IS NULL OR c.prec >= b.prec"


@register("resolve_replace", f""", kept AS ({AFTER_BOUNDARY}), v AS ({MULTI_SQL.format('kept', 2)}), o AS (SELECT subject_id, predicate_id, count(*) AS nv, count(*) FILTER (state = 'conflict') AS nc FROM v GROUP BY 1, 2)
SELECT s.subject_id, s.predicate_id, CASE WHEN nc > 0 THEN 'conflict' WHEN nv > 0 THEN 'known' WHEN b.prec IS NOT NULL THEN 'known_empty' ELSE 'unknown' END AS outcome, coalesce(nv, 0) AS n_values, coalesce(nc, 0) AS n_conflicts
FROM (SELECT DISTINCT subject_id, predicate_id FROM assertions WHERE predicate_id = 2) s LEFT JOIN o USING (subject_id, predicate_id) LEFT JOIN bnd b USING (subject_id, predicate_id)""")
def _(s):
    return R.resolve_replace(s, CTX)


@register("secure_replace", f""", v AS ({MULTI_SQL.format(f'({CAT_SURVIVORS})', 2)}), o AS (SELECT subject_id, predicate_id, count(*) AS nv, count(*) FILTER (state = 'conflict') AS nc FROM v GROUP BY 1, 2)
SELECT s.subject_id, s.predicate_id, CASE WHEN nc > 0 THEN 'conflict' WHEN nv > 0 THEN 'known' ELSE 'unknown' END AS outcome, coalesce(nv, 0) AS n_values, coalesce(nc, 0) AS n_conflicts
FROM (SELECT DISTINCT subject_id, predicate_id FROM assertions WHERE predicate_id = 2) s LEFT JOIN o USING (subject_id, predicate_id)""")
def _(s):
    return R.resolve_replace(s, CTX, rights=CAT)  # cat may not read the validity of boundaries, so none acts


@register("resolve_by_schema", f""", kept AS ({AFTER_BOUNDARY}), pol AS (SELECT predicate_id, policy FROM (SELECT *, row_number() OVER (PARTITION BY predicate_id ORDER BY revision DESC) AS r FROM schema_predicates WHERE revision <= {AS_OF}) WHERE r = 1),
best AS (SELECT subject_id, predicate_id, count(DISTINCT value_canon || '|' || polarity) AS kinds FROM (SELECT *, rank() OVER (PARTITION BY subject_id, predicate_id ORDER BY prec DESC) AS r FROM surv) WHERE r = 1 GROUP BY 1, 2),
src AS (SELECT c.* FROM surv c JOIN pol USING (predicate_id) WHERE policy = 'multi_value_overlay' UNION ALL SELECT c.* FROM kept c JOIN pol USING (predicate_id) WHERE policy = 'multi_value_replace'),
many AS (SELECT subject_id, predicate_id, count(*) FILTER (n = 2) AS nc FROM (SELECT subject_id, predicate_id, value_canon, count(DISTINCT polarity) AS n FROM src GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT s.subject_id, s.predicate_id, policy, CASE WHEN policy IS NULL THEN 'unknown_predicate' WHEN policy = 'single_value_replace' THEN CASE WHEN kinds IS NULL THEN 'unknown' WHEN kinds = 1 THEN 'known' ELSE 'conflict' END
  WHEN nc > 0 THEN 'conflict' WHEN nc = 0 THEN 'known' WHEN policy = 'multi_value_replace' AND b.prec IS NOT NULL THEN 'known_empty' ELSE 'unknown' END AS outcome
FROM (SELECT DISTINCT subject_id, predicate_id FROM assertions) s LEFT JOIN pol USING (predicate_id) LEFT JOIN best USING (subject_id, predicate_id) LEFT JOIN many USING (subject_id, predicate_id) LEFT JOIN bnd b USING (subject_id, predicate_id)""")
def _(s):
    return R.resolve_by_schema(s, CTX)


@register("resolve_one_slot", _single_sql("SELECT * FROM surv").replace("CASE WHEN kinds = 1 THEN v END AS value, CASE WHEN kinds = 1 THEN p END AS polarity, ", "") + " WHERE s.subject_id = 7")
def _(s):
    return R.resolve_point(s, CTX, 7, 0)


@register("single_contributors", "SELECT subject_id, predicate_id, assertion_id FROM (SELECT *, rank() OVER (PARTITION BY subject_id, predicate_id ORDER BY prec DESC) AS r FROM surv WHERE predicate_id = 0) WHERE r = 1")
def _(s):
    return R.single_contributors(R.surviving(s, CTX, 0))


STAGES_SQL = f""", kept AS ({AFTER_BOUNDARY}), c AS (SELECT * FROM cand WHERE predicate_id = 2), s1 AS (SELECT * FROM surv WHERE predicate_id = 2), s2 AS (SELECT * FROM kept WHERE predicate_id = 2)"""


@register("explain_stages", STAGES_SQL + """, n AS (SELECT subject_id, predicate_id, count(*) AS n0, count(*) FILTER (assertion_id IN (SELECT assertion_id FROM s1)) AS n1, count(*) FILTER (assertion_id IN (SELECT assertion_id FROM s2)) AS n2 FROM c GROUP BY 1, 2)
SELECT subject_id, predicate_id, 1 AS stage_no, 'candidate_scan' AS stage, n0 AS n_in, n0 AS n_out FROM n UNION ALL SELECT subject_id, predicate_id, 2, 'mask_projection', n0, n1 FROM n UNION ALL SELECT subject_id, predicate_id, 3, 'replacement_boundary', n1, n2 FROM n
UNION ALL SELECT subject_id, predicate_id, 4, 'resolution', n2, n2 FROM n""")
def _(s):
    return R.explain(s, CTX)


@register("explain_records", STAGES_SQL + f""", m AS (SELECT assertion_id, min(mask_id) AS mask_id FROM hits WHERE assertion_id IN (SELECT assertion_id FROM c) GROUP BY 1)
SELECT subject_id, predicate_id, n AS stage_no, role, 'assertion' AS family, assertion_id AS id FROM (
  SELECT subject_id, predicate_id, assertion_id, 1 AS n, 'out' AS role FROM c UNION ALL SELECT subject_id, predicate_id, assertion_id, 2, 'in' FROM c UNION ALL SELECT subject_id, predicate_id, assertion_id, 2, 'out' FROM s1
  UNION ALL SELECT subject_id, predicate_id, assertion_id, 3, 'in' FROM s1 UNION ALL SELECT subject_id, predicate_id, assertion_id, 3, 'out' FROM s2 UNION ALL SELECT subject_id, predicate_id, assertion_id, 4, 'in' FROM s2 UNION ALL SELECT subject_id, predicate_id, assertion_id, 4, 'out' FROM s2)
UNION ALL SELECT DISTINCT c.subject_id, c.predicate_id, 2, 'applied', 'mask', m.mask_id FROM m JOIN c USING (assertion_id)
UNION ALL SELECT b.subject_id, b.predicate_id, 3, 'applied', 'boundary', b.boundary_id FROM abnd b JOIN bnd t ON t.subject_id = b.subject_id AND t.predicate_id = b.predicate_id AND t.prec = b.prec WHERE EXISTS (SELECT 1 FROM c WHERE c.subject_id = b.subject_id AND c.predicate_id = b.predicate_id)""")
def _(s):
    return R.explain_records(s, CTX)


# all of world time

def _times_sql(predicate: int) -> str:
    slot, big = "subject_id, predicate_id", HIGH
    return f""", tk AS (SELECT a.*, p.cutoff FROM assertions a JOIN prec p ON p.space_id = a.space_id AND p.layer_id = a.layer_id WHERE a.revision <= p.cutoff AND perspective_id = 0 AND mode = 'world_state' AND predicate_id = {predicate} AND assertion_id NOT IN (SELECT target_id FROM hidden)),
rm AS (SELECT DISTINCT k.subject_id, k.predicate_id, m.mask_id, m.valid_start, m.valid_end FROM kmask m JOIN tk k ON CASE WHEN m.selector = 'exact' THEN m.assertion_id = k.assertion_id ELSE m.subject_id = k.subject_id AND m.predicate_id = k.predicate_id END),
tb AS (SELECT * FROM kbnd WHERE predicate_id = {predicate}),
opened AS (SELECT {slot} FROM tk UNION SELECT {slot} FROM tb WHERE valid_start IS NOT NULL OR valid_end IS NOT NULL),
edges AS (SELECT {slot}, edge FROM (
  SELECT {slot}, valid_start AS edge FROM tk UNION SELECT {slot}, valid_end FROM tk UNION SELECT k.subject_id, k.predicate_id, c.close_at FROM tk k JOIN assertion_closures c ON c.assertion_id = k.assertion_id AND c.revision <= k.cutoff
  UNION SELECT {slot}, valid_start FROM rm UNION SELECT {slot}, valid_end FROM rm UNION SELECT m.subject_id, m.predicate_id, c.close_at FROM rm m JOIN mask_closures c ON c.mask_id = m.mask_id AND c.revision <= {AS_OF}
  UNION SELECT {slot}, valid_start FROM tb UNION SELECT {slot}, valid_end FROM tb UNION SELECT b.subject_id, b.predicate_id, c.close_at FROM tb b JOIN boundary_closures c ON c.boundary_id = b.boundary_id AND c.revision <= {AS_OF}) JOIN opened USING (subject_id, predicate_id) WHERE edge IS NOT NULL),
grid AS (SELECT {slot}, edge AS cell_start, lead(edge) OVER (PARTITION BY {slot} ORDER BY edge) AS cell_end, edge AS pt FROM edges UNION ALL SELECT {slot}, NULL, min(edge), coalesce(min(edge) - 1, 0) FROM opened LEFT JOIN edges USING (subject_id, predicate_id) GROUP BY 1, 2),
live AS (SELECT t.*, coalesce(valid_start, {LOW}) AS since, least(coalesce(valid_end, {big}), coalesce((SELECT min(close_at) FROM assertion_closures c WHERE c.assertion_id = t.assertion_id AND c.revision <= t.cutoff), {big})) AS until FROM timeless t WHERE predicate_id = {predicate}),
shade AS (SELECT l.assertion_id, m.since, m.until FROM live l JOIN tmask m ON m.prec > l.prec AND ((m.selector = 'exact' AND m.assertion_id = l.assertion_id) OR (m.selector = 'slot' AND m.subject_id = l.subject_id AND m.predicate_id = l.predicate_id) OR
  (m.selector = 'proposition' AND m.subject_id = l.subject_id AND m.predicate_id = l.predicate_id AND m.value_canon = l.value_canon AND m.polarity = l.polarity))),
held AS (SELECT g.subject_id, g.predicate_id, g.pt, l.assertion_id, l.value_canon, l.polarity, l.prec FROM grid g JOIN live l ON l.subject_id = g.subject_id AND l.predicate_id = g.predicate_id AND l.since <= g.pt AND g.pt < l.until
  WHERE NOT EXISTS (SELECT 1 FROM shade h WHERE h.assertion_id = l.assertion_id AND h.since <= g.pt AND g.pt < h.until))"""


VALUES_SQL = """, v AS (SELECT subject_id, predicate_id, pt, value_canon, count(DISTINCT polarity) AS sides FROM {0} GROUP BY 1, 2, 3, 4), o AS (SELECT subject_id, predicate_id, pt, count(*) AS nv, count(*) FILTER (sides = 2) AS nc FROM v GROUP BY 1, 2, 3)"""


for _predicate in range(3):
    register(f"all_times_cells_{_predicate}" if _predicate else "all_times_cells", _times_sql(_predicate) + " SELECT subject_id, predicate_id, cell_start, cell_end FROM grid")(lambda s, p=_predicate: T.cells(T.Known(s, CTX, p)).drop("at"))


@register("all_times_single", _times_sql(0) + f""",
inside AS (SELECT *, rank() OVER (PARTITION BY subject_id, predicate_id, pt ORDER BY prec DESC) AS r FROM held),
res AS (SELECT subject_id, predicate_id, pt, count(DISTINCT value_canon || '|' || polarity) AS kinds, min(value_canon) AS v, min(polarity) AS p, {IDS} AS contributors FROM inside WHERE r = 1 GROUP BY 1, 2, 3)
SELECT subject_id, predicate_id, cell_start, cell_end, CASE WHEN kinds IS NULL THEN 'unknown' WHEN kinds = 1 THEN 'known' ELSE 'conflict' END AS outcome, CASE WHEN kinds = 1 THEN v END AS value, CASE WHEN kinds = 1 THEN p END AS polarity, contributors FROM grid LEFT JOIN res USING (subject_id, predicate_id, pt)""")
def _(s):
    return T.all_times_single(s, CTX)


@register("all_times_overlay", _times_sql(1) + VALUES_SQL.format("held") + """
SELECT subject_id, predicate_id, cell_start, cell_end, CASE WHEN nc > 0 THEN 'conflict' WHEN nv > 0 THEN 'known' ELSE 'unknown' END AS outcome, coalesce(nv, 0) AS n_values, coalesce(nc, 0) AS n_conflicts FROM grid LEFT JOIN o USING (subject_id, predicate_id, pt)""")
def _(s):
    return T.all_times_overlay(s, CTX)


@register("all_times_replace", _times_sql(2) + """, cut AS (SELECT g.subject_id, g.predicate_id, g.pt, max(b.prec) AS low FROM grid g JOIN tbnd b ON b.subject_id = g.subject_id AND b.predicate_id = g.predicate_id AND b.since <= g.pt AND g.pt < b.until GROUP BY 1, 2, 3),
stay AS (SELECT h.* FROM held h LEFT JOIN cut USING (subject_id, predicate_id, pt) WHERE low IS NULL OR h.prec >= low)""" + VALUES_SQL.format("stay") + """
SELECT subject_id, predicate_id, cell_start, cell_end, CASE WHEN nc > 0 THEN 'conflict' WHEN nv > 0 THEN 'known' WHEN low IS NOT NULL THEN 'known_empty' ELSE 'unknown' END AS outcome, coalesce(nv, 0) AS n_values, coalesce(nc, 0) AS n_conflicts FROM grid LEFT JOIN o USING (subject_id, predicate_id, pt) LEFT JOIN cut USING (subject_id, predicate_id, pt)""")
def _(s):
    return T.all_times_replace(s, CTX)


@register("all_times_complete_empty", _times_sql(2) + " SELECT DISTINCT subject_id, predicate_id FROM assertions WHERE predicate_id = 2 AND (subject_id, predicate_id) NOT IN (SELECT (subject_id, predicate_id) FROM grid)")
def _(s):
    return T.complete_empty(R.slots(s, 2), T.cells(T.Known(s, CTX, 2)))


@register("context_precedence", "SELECT space_id, layer_id, CAST(prec AS BIGINT) AS prec FROM prec")
def _(s):
    pairs = [(sp, la) for sp in CTX.space_ids() for la, _ in CTX.selected_layers()]
    rows = s.spark.createDataFrame(pairs, "space_id int, layer_id int").withColumn("p", precedence(CTX))
    return rows.select("space_id", "layer_id", (F.col("p.nearness") * 1000 + F.col("p.layer_rank")).cast("long").alias("prec"))


# events

@register("events_visible", "SELECT event_id, kind, CAST(distance AS BIGINT) AS distance, start_us, end_us FROM ev")
def _(s):
    return E.visible_events(s, CTX).select("event_id", "kind", (-F.col("prec.nearness")).cast("long").alias("distance"), "start_us", "end_us")


WITHIN = "(is_span AND start_us < {b} AND (effective_end IS NULL OR effective_end > {a}) OR NOT is_span AND start_us >= {a} AND start_us < {b})"


@register("event_overlap", f"SELECT event_id, start_us, end_us FROM ev WHERE {WITHIN.format(a=FROM_US, b=TO_US)}")
def _(s):
    return E.visible_events(s, CTX, within=(FROM_US, TO_US)).select("event_id", "start_us", "end_us")


@register("event_at", f"SELECT event_id FROM ev WHERE (is_span AND start_us <= {FROM_US} AND (effective_end IS NULL OR effective_end > {FROM_US})) OR (NOT is_span AND start_us = {FROM_US})")
def _(s):
    return E.visible_events(s, CTX, at=FROM_US).select("event_id")


@register("event_effective_end", "SELECT event_id, effective_end FROM ev WHERE is_span")
def _(s):
    return E.visible_events(s, CTX).filter("is_span").select("event_id", "effective_end")


@register("event_by_kind_role", "SELECT kind, role, count(*) AS n, count(DISTINCT participant_id) AS participants FROM ev GROUP BY 1, 2")
def _(s):
    return E.visible_events(s, CTX).groupBy("kind", "role").agg(F.count("*").alias("n"), F.countDistinct("participant_id").alias("participants"))


@register("event_by_participant", "SELECT event_id, kind FROM ev WHERE participant_id = 42")
def _(s):
    return E.of_participant(E.visible_events(s, CTX), 42).select("event_id", "kind")


@register("event_masked", "SELECT DISTINCT event_id FROM aemask")
def _(s):
    return E.event_masks(s, CTX).select("event_id").distinct()


ANN_EVENTS = "SELECT * FROM ev0 WHERE layer_id <> 2 AND space_id <> 1"


@register("events_authorized", f"SELECT event_id FROM ({ANN_EVENTS})")
def _(s):
    return E.visible_events(s, CTX, rights=ANN).select("event_id")  # event masks are in a layer that ann may not read


@register("event_relations_active", "SELECT relation_id, kind, from_id, to_id FROM rel")
def _(s):
    return E.active_relations(s, AS_OF).select("relation_id", "kind", "from_id", "to_id")


@register("event_relations_visible", "SELECT relation_id, kind, from_id, to_id FROM vrel")
def _(s):
    return E.visible_relations(s, CTX).select("relation_id", "kind", "from_id", "to_id")


@register("event_relation_neighbours", "SELECT relation_id, kind FROM rel WHERE from_id = 40 OR to_id = 40")
def _(s):
    return E.neighbours(E.active_relations(s, AS_OF), 40).select("relation_id", "kind")


@register("same_time_components", """, RECURSIVE_MARK reach(a, b) AS (SELECT from_id, to_id FROM rel WHERE kind = 'same_time' UNION SELECT to_id, from_id FROM rel WHERE kind = 'same_time' UNION SELECT r.a, e.to_id FROM reach r JOIN rel e ON e.kind = 'same_time' AND e.from_id = r.b)
SELECT a AS event_id, least(a, min(b)) AS representative FROM reach GROUP BY a""".replace("RECURSIVE_MARK ", ""))
def _(s):
    return E.same_time_components(E.active_relations(s, AS_OF))


@register("before_cycle_residue", "SELECT event_id AS node FROM world_events WHERE false")
def _(s):
    return E.before_residue(E.active_relations(s, AS_OF))


PLANTED_BEFORE = "(SELECT from_id AS a, to_id AS b FROM planted_relations WHERE kind = '{0}')"


def _residue_sql(edges: str) -> str:
    """Nodes that a node on a cycle reaches; ``edges`` is small."""
    return f""", e AS {edges}, walk(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM walk w JOIN e ON e.a = w.b)
SELECT DISTINCT b AS node FROM walk WHERE a IN (SELECT a FROM walk WHERE a = b)"""


@register("before_cycle_planted", _residue_sql(PLANTED_BEFORE.format("before")))
def _(s):
    return E.before_residue(s.planted_relations)


@register("causes_cycle_planted", _residue_sql(PLANTED_BEFORE.format("causes")))
def _(s):
    return E.causes_residue(s.planted_relations)


@register("participant_errors", "SELECT event_id, role, count(*) AS n, 'unknown_role' AS reason FROM world_events WHERE kind <> 'click' GROUP BY 1, 2")
def _(s):
    return E.participant_errors(s.world_events, s.event_kinds.filter("kind = 'click'"))


@register("event_graph_after", """, n AS (SELECT relation_id, kind, from_id, to_id FROM rel WHERE relation_id % 100 <> 15 UNION ALL SELECT relation_id + 1000000, kind, from_id, to_id FROM planted_relations WHERE kind = 'causes')
SELECT 'repeated_relations' AS "check", count(*) AS n FROM (SELECT 1 FROM n GROUP BY kind, from_id, to_id HAVING count(*) > 1)
UNION ALL SELECT 'relations_without_event', count(*) FROM (SELECT from_id AS x FROM n UNION ALL SELECT to_id FROM n) WHERE x NOT IN (SELECT event_id FROM world_events)
UNION ALL SELECT 'before_cycle', 0 UNION ALL SELECT 'causes_cycle', count(*) FROM (WITH RECURSIVE c AS (SELECT from_id AS a, to_id AS b FROM n WHERE kind = 'causes'), reach(x) AS (SELECT 0 UNION SELECT c.b FROM reach JOIN c ON c.a = reach.x) SELECT x FROM reach)""")
def _(s):
    added = s.planted_relations.filter("kind = 'causes'").withColumn("relation_id", F.col("relation_id") + 1_000_000)
    return X.relation_errors(s, CTX, added, E.active_relations(s, AS_OF).filter("relation_id % 100 = 15"))


@register("event_corrections", "SELECT event_id + 1000000 AS from_id, event_id AS to_id, 'corrects' AS relation, CAST(9000 AS BIGINT) AS revision FROM world_events WHERE event_id % 40 = 0")
def _(s):
    changes = s.world_events.filter("event_id % 40 = 0").select("event_id", (F.col("start_us") + 1).alias("start_us"), "end_us")
    return X.correct_events(s.world_events, changes, 9000, 1_000_000)[1]


# evidence and provenance

@register("evidence_history", f"""SELECT e.evidence_id, e.source_id, s.locator, e.target_id, e.relation, r.retracted_at, CASE WHEN r.retracted_at IS NULL THEN 'active' ELSE 'retracted' END AS state
FROM evidence e JOIN sources s ON s.source_id = e.source_id AND s.revision <= {AS_OF} JOIN vis v ON v.space_id = e.target_space_id AND e.target_revision <= v.cutoff
LEFT JOIN (SELECT evidence_id, min(revision) AS retracted_at FROM evidence_retractions WHERE revision <= {AS_OF} GROUP BY 1) r USING (evidence_id) WHERE e.revision <= {AS_OF}""")
def _(s):
    return I.evidence_history(s, CTX)


@register("evidence_neighbours", "SELECT evidence_id, source_id, target_id, relation FROM evidence WHERE source_id = 4 AND relation = 'supports'")
def _(s):
    return I.evidence_neighbours(s.evidence, source=4, relation="supports")


@register("secure_evidence", f"""SELECT e.evidence_id, e.source_id, s.locator, e.target_id, e.relation, r.retracted_at, CASE WHEN r.retracted_at IS NULL THEN 'active' ELSE 'retracted' END AS state
FROM evidence e JOIN sources s ON s.source_id = e.source_id AND s.revision <= {AS_OF} JOIN vis v ON v.space_id = e.target_space_id AND e.target_revision <= v.cutoff
LEFT JOIN (SELECT evidence_id, min(revision) AS retracted_at FROM evidence_retractions WHERE revision <= {AS_OF} GROUP BY 1) r USING (evidence_id) WHERE e.revision <= {AS_OF} AND e.source_id <> 3 AND e.target_space_id <> 1 AND e.target_id <> 13 AND e.relation <> 'contradicts'""")
def _(s):
    return I.evidence_history(s, CTX, ANN)


@register("secure_provenance", f"SELECT edge_id, from_id, to_id, relation FROM prov WHERE from_id IN (SELECT assertion_id FROM assertions WHERE {ANN_SEES}) AND to_id IN (SELECT assertion_id FROM assertions WHERE {ANN_SEES})")
def _(s):
    return I.visible_provenance(s, CTX, ANN).select("edge_id", "from_id", "to_id", "relation")


@register("provenance_edge_rules", "SELECT edge_id, CASE WHEN from_id = to_id THEN 'self_loop' WHEN relation = 'corrects' THEN 'corrects_other_family' END AS reason FROM (SELECT edge_id, from_id, CASE WHEN edge_id % 3 = 0 THEN from_id ELSE to_id END AS to_id, relation, edge_id % 3 AS k FROM provenance) WHERE from_id = to_id OR (relation = 'corrects' AND k = 1)")
def _(s):
    k = F.col("edge_id") % 3
    edges = s.provenance.select("edge_id", F.lit("assertion").alias("from_family"), "from_id", F.when(k == 1, "event").otherwise("assertion").alias("to_family"), F.when(k == 0, F.col("from_id")).otherwise(F.col("to_id")).alias("to_id"), "relation")
    return I.edge_errors(edges)


@register("provenance_active", "SELECT edge_id, from_id, to_id, relation FROM prov")
def _(s):
    return I.active_provenance(s, AS_OF).select("edge_id", "from_id", "to_id", "relation")


@register("provenance_duplicates", "SELECT from_id, to_id, relation, count(*) AS n FROM prov GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(s):
    return I.duplicates(I.active_provenance(s, AS_OF))


@register("provenance_dependencies", "SELECT CASE relation WHEN 'derived_from' THEN to_id ELSE from_id END AS a, CASE relation WHEN 'derived_from' THEN from_id ELSE to_id END AS b FROM prov")
def _(s):
    return I.dependencies(I.active_provenance(s, AS_OF))


@register("provenance_neighbours", "SELECT edge_id, relation FROM prov WHERE from_id = 10 OR to_id = 10")
def _(s):
    return I.neighbours(I.active_provenance(s, AS_OF), 10).select("edge_id", "relation")


@register("provenance_cycle", "SELECT edge_id AS node FROM prov WHERE false")
def _(s):
    return E.cycle_residue(I.dependencies(I.active_provenance(s, AS_OF)))


@register("provenance_cycle_planted", _residue_sql("(SELECT to_id AS a, from_id AS b FROM planted_provenance)"))
def _(s):
    return E.cycle_residue(I.dependencies(s.planted_provenance))


@register("provenance_graph_after", """SELECT 'repeated_edges' AS "check", count(*) AS n FROM (SELECT 1 FROM (SELECT from_id, to_id, relation FROM prov UNION ALL SELECT from_id, to_id, relation FROM prov WHERE edge_id % 70 = 3) GROUP BY from_id, to_id, relation HAVING count(*) > 1)
UNION ALL SELECT 'self_loops', count(*) FROM prov WHERE from_id = to_id UNION ALL SELECT 'dependency_cycle', 0""")
def _(s):
    added = I.active_provenance(s, AS_OF).filter("edge_id % 70 = 3").select((F.col("edge_id") + 1_000_000).alias("edge_id"), "from_id", "to_id", "relation")
    return X.provenance_errors(s, CTX, added)


# graph

def _bfs_sql(direction: str, depth: int) -> str:
    ahead = "SELECT from_id AS a, to_id AS b FROM vrel WHERE kind IN ('before', 'same_time')"
    back = "SELECT to_id AS a, from_id AS b FROM vrel WHERE kind IN ('before', 'same_time')"
    same = "SELECT to_id AS a, from_id AS b FROM vrel WHERE kind = 'same_time'"
    links = f"{ahead} UNION {back}" if direction == "both" else f"{ahead} UNION {same}"
    return f""", links AS ({links}), roots AS (SELECT DISTINCT event_id FROM ev WHERE event_id % 500 = 0),
walk(node, depth) AS (SELECT event_id, 0 FROM roots UNION SELECT l.b, w.depth + 1 FROM walk w JOIN links l ON l.a = w.node WHERE w.depth < {depth})
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node"""


def _bfs(s, direction: str, depth: int) -> DataFrame:
    nodes = E.visible_events(s, CTX).select("event_id")
    roots = nodes.filter("event_id % 500 = 0").select(F.col("event_id").alias("node"))
    return G.traverse(nodes, E.visible_relations(s, CTX), G.GraphSpec(roots, ("before", "same_time"), direction, depth))[0]


@register("bfs_out", _bfs_sql("out", 4))
def _(s):
    return _bfs(s, "outgoing", 4)


@register("bfs_both", _bfs_sql("both", 3))
def _(s):
    return _bfs(s, "both", 3)


@register("bfs_edges", _bfs_sql("out", 2).replace("SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node", """, first AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node), used AS (SELECT r.relation_id, r.kind, r.from_id, r.to_id, f.depth + 1 AS depth FROM vrel r JOIN first f ON f.node = r.from_id WHERE r.kind = 'before' AND f.depth < 2)
SELECT relation_id AS edge_id, kind, from_id, to_id, CAST(depth AS INTEGER) AS depth FROM used""").replace("'before', 'same_time'", "'before'").replace("WHERE kind = 'same_time'", "WHERE false"))
def _(s):
    nodes = E.visible_events(s, CTX).select("event_id")
    roots = nodes.filter("event_id % 500 = 0").select(F.col("event_id").alias("node"))
    return G.traverse(nodes, E.visible_relations(s, CTX), G.GraphSpec(roots, ("before",), "outgoing", 2))[1]


@register("secure_graph", f""", ok AS (SELECT * FROM ev), links AS (SELECT from_id AS a, to_id AS b FROM vrel WHERE kind = 'same_time' UNION SELECT to_id, from_id FROM vrel WHERE kind = 'same_time'), roots AS (SELECT event_id FROM ok WHERE event_id % 50 = 0),
walk(node, depth) AS (SELECT event_id, 0 FROM roots UNION SELECT l.b, w.depth + 1 FROM walk w JOIN links l ON l.a = w.node WHERE w.depth < 2) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node""")
def _(s):
    nodes = E.visible_events(s, CTX, rights=CAT).select("event_id")
    roots = nodes.filter("event_id % 50 = 0").select(F.col("event_id").alias("node"))
    return G.traverse(nodes, E.visible_relations(s, CTX, CAT), G.GraphSpec(roots, ("before", "same_time"), "outgoing", 2))[0]


@register("graph_over_facts", """, ok AS (SELECT a.assertion_id FROM assertions a JOIN vis v USING (space_id) WHERE a.revision <= v.cutoff),
pe AS (SELECT from_id AS a, to_id AS b FROM prov WHERE from_id IN (SELECT assertion_id FROM ok) AND to_id IN (SELECT assertion_id FROM ok)),
re AS (SELECT from_id AS a, to_id AS b FROM vrel WHERE kind = 'causes'),
links AS (SELECT 'assertion' AS f, a, b FROM pe UNION SELECT 'assertion', b, a FROM pe UNION SELECT 'event', a, b FROM re UNION SELECT 'event', b, a FROM re),
roots AS (SELECT 'assertion' AS f, assertion_id AS id FROM ok WHERE assertion_id % 7 = 3 UNION SELECT 'event', event_id FROM ev WHERE event_id % 40 = 0),
walk(f, id, depth) AS (SELECT f, id, 0 FROM roots UNION SELECT w.f, l.b, w.depth + 1 FROM walk w JOIN links l ON l.a = w.id AND l.f = w.f WHERE w.depth < 2)
SELECT f AS family, id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1, 2""")
def _(s):
    nodes, edges = G.record_graph(s, CTX)
    roots = nodes.filter("(node.family = 'assertion' AND node.id % 7 = 3) OR (node.family = 'event' AND node.id % 40 = 0)")
    found = G.traverse(nodes, edges, G.GraphSpec(roots, ("corrects", "derived_from", "causes"), "both", 2))[0]
    return found.select("node.family", "node.id", "depth")


# search

@register("token_all", r"SELECT result_key, 'text' AS matched_fields FROM search_documents WHERE len(list_intersect(regexp_split_to_array(text, '[\t\n\f\r ]+'), ['the', 'and'])) = 2")
def _(s):
    return K.search(s.search_documents, ["the", "and"])


@register("token_any", r"SELECT result_key, 'text' AS matched_fields FROM search_documents WHERE len(list_intersect(regexp_split_to_array(text, '[\t\n\f\r ]+'), ['der', 'las'])) > 0")
def _(s):
    return K.search(s.search_documents, ["der", "las", "der"], every=False)


@register("secure_search", r"SELECT result_key, 'text' AS matched_fields FROM search_documents WHERE space_id <> 3 AND len(list_intersect(regexp_split_to_array(text, '[\t\n\f\r ]+'), ['the', 'and'])) = 2")
def _(s):
    return K.search_records(s.search_documents, ["the", "and"], CAT)


@register("fulltext_bool", r"SELECT result_key FROM (SELECT result_key, regexp_split_to_array(text, '[\t\n\f\r ]+') AS t FROM search_documents) WHERE (list_contains(t, 'the') OR list_contains(t, 'der')) AND NOT list_contains(t, 'and')")
def _(s):
    return K.full_text(s.search_documents, ("all", ("any", "the", "der"), ("not", "and")))


# aggregates

@register("agg_count", "SELECT count(*) AS n FROM surv")
def _(s):
    return A.count(M.apply_masks(S.candidates(s, CTX), M.active_masks(s, CTX)))


@register("agg_exists", "SELECT count(*) > 0 AS found FROM surv WHERE predicate_id = 1")
def _(s):
    return A.exists(R.surviving(s, CTX, 1))


@register("agg_grouped_missing", "SELECT valid_end, polarity, count(*) AS n FROM surv GROUP BY 1, 2")
def _(s):
    return A.grouped_count(M.apply_masks(S.candidates(s, CTX), M.active_masks(s, CTX)), ["valid_end", "polarity"])


@register("agg_by_polarity", "SELECT polarity, count(*) AS n FROM surv GROUP BY 1")
def _(s):
    return A.grouped_count(M.apply_masks(S.candidates(s, CTX), M.active_masks(s, CTX)), ["polarity"])


@register("agg_contributors", """, best AS (SELECT *, rank() OVER (PARTITION BY subject_id ORDER BY prec DESC) AS r FROM surv WHERE predicate_id = 0)
SELECT polarity, count(*) AS n FROM best WHERE r = 1 GROUP BY 1""")
def _(s):
    used = A.contributors(R.resolve_single(s, CTX))
    return A.grouped_count(s.assertions.join(used, "assertion_id", "left_semi"), ["polarity"])


@register("secure_counts", f"SELECT polarity, count(*) AS n FROM cand WHERE {ANN_SEES} GROUP BY 1")
def _(s):
    ANN.demand("query_aggregate")
    return A.grouped_count(R.surviving(s, CTX, rights=ANN), ["polarity"])


# filters, sorting, pages

@register("filter_tree", f"SELECT assertion_id FROM assertions WHERE NOT (subject_id = 7 OR coalesce(valid_end < {WORLD_DAY}, false)) AND revision > 100 AND revision <= 3000 AND predicate_id IN (0, 2)")
def _(s):
    tree = ("all", ("not", ("any", ("is", "subject_id", 7), ("range", "valid_end", None, WORLD_DAY, False, True))), ("range", "revision", 100, 3000, True, False), ("in", "predicate_id", (0, 2)))
    return s.assertions.filter(C.compile_filter(tree)).select("assertion_id")


@register("filter_not_missing", "SELECT assertion_id FROM assertions WHERE valid_end IS NULL")
def _(s):
    return s.assertions.filter(C.compile_filter(("not", ("exists", "valid_end")))).select("assertion_id")


@register("filter_overlaps", f"SELECT assertion_id FROM assertions WHERE (valid_start IS NULL OR valid_start < {WORLD_DAY + 30}) AND (valid_end IS NULL OR valid_end > {WORLD_DAY})")
def _(s):
    return s.assertions.filter(C.compile_filter(("overlaps", "valid_start", "valid_end", WORLD_DAY, WORLD_DAY + 30))).select("assertion_id")


@register("project_redacted", "SELECT assertion_id, false AS assertion_id_redacted, CASE WHEN layer_id <> 2 THEN value_canon END AS value_canon, layer_id = 2 AS value_canon_redacted FROM assertions")
def _(s):
    return C.project(s.assertions, ["assertion_id", "value_canon"], {"value_canon": F.col("layer_id") != 2})


@register("filter_calendar_window", "SELECT assertion_id FROM assertions WHERE (valid_start IS NULL OR valid_start < date_diff('day', DATE '1970-01-01', DATE '1998-02-28')) AND (valid_end IS NULL OR valid_end > date_diff('day', DATE '1970-01-01', DATE '1997-12-31'))")
def _(s):
    return s.assertions.filter(C.compile_filter(("overlaps", "valid_start", "valid_end", *C.calendar_window("1997-12-31", months=2)))).select("assertion_id")


@register("filter_instants", f"SELECT event_id FROM world_events WHERE NOT is_span AND start_us >= {FROM_US} AND start_us < {TO_US}")
def _(s):
    return s.world_events.filter("NOT is_span").filter(C.compile_filter(("instant_within", "start_us", FROM_US, TO_US))).select("event_id")


@register("filter_event_kind", "SELECT event_id FROM world_events WHERE kind = 'click' AND NOT is_span")
def _(s):
    return s.world_events.filter(C.compile_filter(("all", ("is", "kind", "click"), ("not", ("is", "is_span", True))))).select("event_id")


@register("filter_equals_of_a_kind", "SELECT assertion_id FROM assertions WHERE mode = 'believes' AND value_canon = 'O'")
def _(s):
    return s.assertions.filter(C.compile_filter(("equals", "mode", "value_canon", "believes", "O"))).select("assertion_id")


@register("filter_refs", "SELECT assertion_id, revision FROM assertions WHERE assertion_id IN (SELECT target_id FROM evidence WHERE relation = 'supports')")
def _(s):
    return C.among(s.assertions, "assertion_id", s.evidence.filter("relation = 'supports'").select("target_id")).select("assertion_id", "revision")


@register("sort_missing_last", "SELECT assertion_id, valid_end FROM assertions ORDER BY valid_end DESC NULLS LAST, assertion_id")
def _(s):
    C.check_sort("candidates", [("valid_end", "desc", "last")])
    return C.sort(s.assertions, [("valid_end", "desc", "last")], "assertion_id").select("assertion_id", "valid_end")


@register("page_keyset", "SELECT assertion_id FROM surv WHERE assertion_id > 5000 ORDER BY assertion_id LIMIT 65")
def _(s):
    return C.page(M.apply_masks(S.candidates(s, CTX), M.active_masks(s, CTX)), "assertion_id", 64, 5000).select("assertion_id")


# movement

@register("verify_store", """SELECT 'repeated_assertions' AS "check", count(*) AS n FROM (SELECT assertion_id FROM assertions GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'repeated_events', count(*) FROM (SELECT event_id FROM world_events GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'retractions_without_assertion', count(*) FROM assertion_retractions WHERE assertion_id NOT IN (SELECT assertion_id FROM assertions)
UNION ALL SELECT 'closures_without_assertion', count(*) FROM assertion_closures WHERE assertion_id NOT IN (SELECT assertion_id FROM assertions)
UNION ALL SELECT 'mask_retractions_without_mask', count(*) FROM mask_retractions WHERE mask_id NOT IN (SELECT mask_id FROM masks)
UNION ALL SELECT 'mask_closures_without_mask', count(*) FROM mask_closures WHERE mask_id NOT IN (SELECT mask_id FROM masks)
UNION ALL SELECT 'boundary_closures_without_boundary', count(*) FROM boundary_closures WHERE boundary_id NOT IN (SELECT boundary_id FROM boundaries)
UNION ALL SELECT 'boundary_retractions_without_boundary', count(*) FROM boundary_retractions WHERE boundary_id NOT IN (SELECT boundary_id FROM boundaries)
UNION ALL SELECT 'evidence_without_source', count(*) FROM evidence WHERE source_id NOT IN (SELECT source_id FROM sources)
UNION ALL SELECT 'relations_without_event', count(*) FROM event_relations WHERE to_id NOT IN (SELECT event_id FROM world_events)
UNION ALL SELECT 'provenance_without_record', count(*) FROM provenance WHERE to_id NOT IN (SELECT assertion_id FROM assertions)""")
def _(s):
    return N.verify(s)


@register("validate_batch", """SELECT assertion_id, CASE WHEN value_canon NOT IN ('O', 'F') THEN 'value_not_allowed' ELSE 'revision' END AS reason FROM assertions WHERE value_canon NOT IN ('O', 'F') OR revision > 7000""")
def _(s):
    predicates = S.latest(s.schema_predicates, "predicate_id", 100_000)
    return N.validate_assertions(s.assertions, predicates, ("O", "F"), 7000)


@register("correction_batch", "SELECT assertion_id + 1000000000 AS from_id, assertion_id AS to_id, 'corrects' AS relation, CAST(9000 AS BIGINT) AS revision FROM assertions WHERE assertion_id % 97 = 0")
def _(s):
    changes = s.assertions.filter("assertion_id % 97 = 0").select("assertion_id", F.lit("X").alias("value_canon"))
    return N.correct(s.assertions, changes, 9000, 1_000_000_000)[2]


@register("remap_import", "SELECT assertion_id, CASE WHEN subject_id % 2 = 0 THEN subject_id + 100000 ELSE subject_id END AS subject_id FROM assertions")
def _(s):
    mapping = s.assertions.select(F.col("subject_id").alias("source_id")).distinct().filter("source_id % 2 = 0").withColumn("target_id", F.col("source_id") + 100000)
    return N.remap(s.assertions, ["subject_id"], mapping).select("assertion_id", "subject_id")


INCOMING = "(SELECT assertion_id FROM assertions UNION ALL SELECT assertion_id + 1000000 FROM assertions UNION ALL SELECT assertion_id + 1000000 FROM assertions WHERE subject_id < 50)"


def _incoming(s) -> DataFrame:
    """All assertions, as they are and under new ids, some of these twice."""
    moved = s.assertions.withColumn("assertion_id", F.col("assertion_id") + 1_000_000)
    return s.assertions.unionByName(moved).unionByName(moved.filter("subject_id < 50"))


@register("import_collisions", f"SELECT DISTINCT assertion_id, 'exists' AS reason FROM {INCOMING} WHERE assertion_id IN (SELECT assertion_id FROM assertions) UNION ALL SELECT assertion_id, 'repeated' FROM {INCOMING} GROUP BY 1 HAVING count(*) > 1")
def _(s):
    return N.import_collisions(_incoming(s), s.assertions, "assertion_id")


@register("import_prepare", f""", inc AS (SELECT assertion_id FROM {INCOMING}), mapped AS (SELECT CASE WHEN assertion_id BETWEEN 1000010 AND 1000019 THEN 5000000 ELSE assertion_id END AS assertion_id FROM inc)
SELECT 'repeated' AS reason, count(*) AS n FROM (SELECT 1 FROM inc GROUP BY assertion_id HAVING count(*) > 1) UNION ALL SELECT 'exists', count(*) FROM mapped WHERE assertion_id IN (SELECT assertion_id FROM assertions)
UNION ALL SELECT 'mapped_together', count(*) FROM (SELECT assertion_id FROM mapped GROUP BY 1 HAVING count(*) > 1) WHERE assertion_id NOT IN (SELECT assertion_id FROM inc GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'dangling_predicate_id', 0""")
def _(s):
    mapping = s.spark.createDataFrame([(1_000_000 + k, 5_000_000) for k in range(10, 20)], "source_id long, target_id long")
    return N.prepare_import(_incoming(s), s.assertions, "assertion_id", mapping, {"predicate_id": (s.schema_predicates, "predicate_id")})


VISIBLE = f"SELECT a.*, v.cutoff FROM assertions a JOIN vis v USING (space_id) WHERE a.revision <= v.cutoff"


@register("transfer_preview", f""", rows AS ({VISIBLE}), copied AS (SELECT * FROM rows WHERE assertion_id NOT IN (SELECT target_id FROM hidden))
SELECT 'assertion' AS kind, count(*) AS n FROM copied UNION ALL SELECT 'archived_omitted', count(*) FROM rows WHERE assertion_id IN (SELECT target_id FROM hidden)
UNION ALL SELECT 'retraction', count(*) FROM assertion_retractions r JOIN copied c ON c.assertion_id = r.assertion_id AND r.revision <= c.cutoff
UNION ALL SELECT 'closure', count(*) FROM assertion_closures r JOIN copied c ON c.assertion_id = r.assertion_id AND r.revision <= c.cutoff""")
def _(s):
    return N.transfer_preview(s, CTX, 9)


@register("transfer_copy", f"SELECT assertion_id + 1000000000 AS assertion_id, CAST(9 AS BIGINT) AS space_id, CAST(9001 AS BIGINT) AS revision, subject_id FROM ({VISIBLE})")
def _(s):
    return N.transfer(s, CTX, 9, 9001, 1_000_000_000)[0].select("assertion_id", "space_id", "revision", "subject_id")


@register("purge_closure", """, dep AS (SELECT CASE relation WHEN 'derived_from' THEN to_id ELSE from_id END AS a, CASE relation WHEN 'derived_from' THEN from_id ELSE to_id END AS b FROM prov),
gone(node) AS (SELECT assertion_id FROM assertions WHERE assertion_id % 50 = 0 UNION SELECT d.b FROM gone g JOIN dep d ON d.a = g.node) SELECT node FROM gone""")
def _(s):
    seeds = s.assertions.filter("assertion_id % 50 = 0").select(F.col("assertion_id").alias("node"))
    return N.purge_closure(I.dependencies(I.active_provenance(s, AS_OF)), seeds)


@register("transfer_lineage", "SELECT 'assertion' AS family, assertion_id AS source_id, assertion_id + 1000000000 AS copy_id, CAST(9001 AS BIGINT) AS revision FROM assertions a JOIN vis v USING (space_id) WHERE a.revision <= v.cutoff UNION ALL SELECT 'mask', mask_id, mask_id + 1000000000, 9001 FROM masks m JOIN vis v USING (space_id) WHERE m.revision <= v.cutoff UNION ALL SELECT 'boundary', boundary_id, boundary_id + 1000000000, 9001 FROM boundaries b JOIN vis v USING (space_id) WHERE b.revision <= v.cutoff UNION ALL SELECT 'event', event_id, event_id + 1000000000, 9001 FROM world_events e JOIN vis v USING (space_id) WHERE e.revision <= v.cutoff")
def _(s):
    return N.transfer_content(s, CTX, 9, 9001, 1_000_000_000)["transfer_lineage"]


@register("visible_content", "SELECT 'assertion' AS family, assertion_id AS id, revision FROM assertions a JOIN vis v USING (space_id) WHERE a.revision <= v.cutoff UNION ALL SELECT 'mask', mask_id, revision FROM masks m JOIN vis v USING (space_id) WHERE m.revision <= v.cutoff UNION ALL SELECT 'boundary', boundary_id, revision FROM boundaries b JOIN vis v USING (space_id) WHERE b.revision <= v.cutoff UNION ALL SELECT 'event', event_id, revision FROM world_events e JOIN vis v USING (space_id) WHERE e.revision <= v.cutoff")
def _(s):
    return N.visible_content(s, CTX)


@register("purge_report", """, gone AS (SELECT assertion_id FROM assertions WHERE assertion_id % 50 = 0) SELECT 'assertion' AS family, count(*) AS n FROM gone UNION ALL SELECT 'assertion_retraction', count(*) FROM assertion_retractions WHERE assertion_id IN (SELECT assertion_id FROM gone)
UNION ALL SELECT 'assertion_closure', count(*) FROM assertion_closures WHERE assertion_id IN (SELECT assertion_id FROM gone) UNION ALL SELECT 'evidence', count(*) FROM evidence WHERE target_id IN (SELECT assertion_id FROM gone)
UNION ALL SELECT 'provenance', count(*) FROM provenance WHERE from_id IN (SELECT assertion_id FROM gone) OR to_id IN (SELECT assertion_id FROM gone)""")
def _(s):
    return N.purge_report(s, s.assertions.filter("assertion_id % 50 = 0").select(F.col("assertion_id").alias("node")))


@register("purge_rewrite", "SELECT assertion_id FROM assertions WHERE assertion_id % 50 <> 0")
def _(s):
    gone = s.assertions.filter("assertion_id % 50 = 0").select(F.col("assertion_id").alias("node"))
    return N.purge(s.assertions, "assertion_id", gone).select("assertion_id")


@register("calendar_shift", "SELECT assertion_id, date_diff('day', DATE '1970-01-01', CAST(((DATE '1970-01-01' + CAST(valid_start AS INTEGER)) + INTERVAL 1 YEAR) + INTERVAL 1 MONTH + INTERVAL 3 DAY AS DATE)) AS valid_start FROM assertions")
def _(s):
    return N.migrate_validity(s.assertions, 1, 1, 3).select("assertion_id", "valid_start")


@register("migration_estimate", "SELECT count(*) AS n, CAST(sum(strlen(CAST(assertion_id AS VARCHAR)) + strlen(value_canon)) AS BIGINT) AS n_bytes FROM assertions")
def _(s):
    return N.estimate(s.assertions, ["assertion_id", "value_canon"])


@register("logical_export", f"SELECT assertion_id, space_id, revision FROM ({VISIBLE}) WHERE revision BETWEEN 500 AND 3000")
def _(s):
    return N.export_rows(s, CTX, 500, 3000).select("assertion_id", "space_id", "revision")


@register("sharing_export", f""", rows AS (SELECT * FROM ({VISIBLE}) WHERE revision BETWEEN 500 AND 3000 AND layer_id <> 2)
SELECT assertion_id FROM rows WHERE assertion_id NOT IN (SELECT from_id FROM provenance WHERE relation = 'derived_from' AND to_id NOT IN (SELECT assertion_id FROM rows))""")
def _(s):
    return N.sharing_rows(s, CTX, 500, 3000, F.col("layer_id") != 2).select("assertion_id")


@register("sharing_records", f""", rows AS (SELECT * FROM ({VISIBLE}) WHERE revision BETWEEN 500 AND 3000 AND {CAT_SEES}),
m AS (SELECT mask_id, revision FROM masks JOIN vis v USING (space_id) WHERE revision <= v.cutoff AND revision BETWEEN 500 AND 3000 AND space_id <> 4 AND (selector <> 'exact' OR assertion_id IN (SELECT assertion_id FROM rows)))
SELECT 'assertion' AS family, assertion_id AS id, revision FROM rows UNION ALL SELECT 'mask', mask_id, revision FROM m
UNION ALL SELECT 'provenance', edge_id, revision FROM provenance WHERE revision BETWEEN 500 AND 3000 AND from_id IN (SELECT assertion_id FROM rows) AND to_id IN (SELECT assertion_id FROM rows)
UNION ALL SELECT 'assertion_retraction', assertion_id, revision FROM assertion_retractions WHERE revision BETWEEN 500 AND 3000 AND assertion_id IN (SELECT assertion_id FROM rows)
UNION ALL SELECT 'assertion_closure', assertion_id, revision FROM assertion_closures WHERE revision BETWEEN 500 AND 3000 AND assertion_id IN (SELECT assertion_id FROM rows)
UNION ALL SELECT 'mask_retraction', mask_id, revision FROM mask_retractions WHERE revision BETWEEN 500 AND 3000 AND mask_id IN (SELECT mask_id FROM m)
UNION ALL SELECT 'mask_closure', mask_id, revision FROM mask_closures WHERE revision BETWEEN 500 AND 3000 AND mask_id IN (SELECT mask_id FROM m)""")
def _(s):
    return N.sharing_records(s, CTX, 500, 3000, CAT)


@register("class_summary", " UNION ALL ".join(f"SELECT '{f}' AS family, count(*) AS n FROM {t} WHERE revision <= {AS_OF}" for f, t, _, _ in S.RAW_FAMILIES))
def _(s):
    return N.class_summary(s, AS_OF)


@register("archive_alternation", "SELECT target_id, action, revision FROM archive_transitions WHERE false")
def _(s):
    return N.alternation_errors(s.archive_transitions)


@register("archive_alternation_planted", "SELECT target_id, action, revision FROM planted_transitions WHERE (target_id % 50 = 0 AND revision = 20) OR target_id % 50 = 1")
def _(s):
    return N.alternation_errors(s.planted_transitions)


@register("mask_lifecycle_errors", "SELECT mask_id, 'closure_without_record' AS reason FROM mask_closures WHERE mask_id % 4 <> 1 UNION ALL SELECT mask_id, 'retraction_without_record' FROM mask_retractions WHERE mask_id % 4 <> 1")
def _(s):
    return X.lifecycle_errors(s.masks.filter("mask_id % 4 = 1"), "mask_id", s.mask_closures, s.mask_retractions)


@register("write_rights", f"SELECT assertion_id FROM assertions WHERE layer_id <> 1 OR space_id = 1")
def _(s):
    writer = L.Policy((("eve", "active"),), (L.Role("writer", (("history_space_read", "allow"), ("assertion_create", "allow"))),), (L.Assignment("eve", "writer"),), (L.Rule("allow", "layer_write", ("role", "writer"), L.Scope(layer=1)), L.Rule("deny", "assertion_create", ("principal", "eve"), L.Scope(space=1))))
    return X.unwritable(s.assertions, L.Rights(writer, "eve"))


@register("schema_publish", "SELECT DISTINCT predicate_id, CAST(9000 AS BIGINT) AS revision, 'multi_value_overlay' AS policy, 'retired' AS lifecycle FROM schema_predicates")
def _(s):
    drafts = s.schema_predicates.select("predicate_id").distinct().select("predicate_id", F.lit("multi_value_overlay").alias("policy"), F.lit("retired").alias("lifecycle"))
    return X.publish_schema(s.schema_predicates, drafts, 9000)


@register("sources_superseded", "SELECT source_id + 1000000 AS source_id, kind, locator || '/2' AS locator, CAST(9000 AS BIGINT) AS revision FROM sources WHERE source_id % 2 = 0")
def _(s):
    changes = s.sources.filter("source_id % 2 = 0").select("source_id", F.concat("locator", F.lit("/2")).alias("locator"))
    return X.supersede_sources(s.sources, changes, 9000, 1_000_000)[0]


@register("migration_dry_run", "SELECT 0 AS step, count(*) AS n_before, count(*) AS n_after, count(*) FILTER (valid_start IS NOT NULL OR valid_end IS NOT NULL) AS n_changed FROM assertions")
def _(s):
    return J.dry_run(s, [J.Step("shift", "world_time_shift", "assertions", lambda rows: N.migrate_validity(rows, 1, 0, 0))])


@register("resolve_from_database", _single_sql("SELECT * FROM surv"))
def _(s):
    """The store written as tables of a database, with its catalogs, and resolved from there."""
    names = ("assertions", "assertion_retractions", "assertion_closures", "masks", "mask_retractions", "mask_closures", "archive_transitions", "history_spaces", "layers")
    database = Database(s.spark, f"{shared_folder(s.spark)}/tidemark/{uuid.uuid4().hex}")
    write_store(s, list(names), database)
    own = DatabaseStore(database)
    return R.resolve_single(own, CTX.at(**catalog(own)))


def _database(s, *names: str) -> Database:
    """A new database in the shared folder, with the named families as its first version."""
    database = Database(s.spark, f"{shared_folder(s.spark)}/tidemark/{uuid.uuid4().hex}")
    write_store(s, list(names), database)
    return database


@register("database_versions", "SELECT 1 AS version, count(*) AS n, sum(source_id) AS ids FROM sources UNION ALL SELECT 2, 2 * count(*), 2 * sum(source_id) + 1000000 * count(*) FROM sources UNION ALL SELECT 3, 2 * count(*), 2 * sum(source_id) + 1000000 * count(*) FROM sources")
def _(s):
    """Two segments, then one compacted segment: versions stay readable, and compaction changes nothing."""
    database = _database(s, "sources")
    database.append({"sources": s.sources.withColumn("source_id", F.col("source_id") + 1_000_000)}, 1)
    database.compact("sources", ["source_id"], 2)
    parts = [database.read("sources", v).agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.sum("source_id").alias("ids")) for v in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("candidates_indexed", "SELECT assertion_id, value_canon, polarity FROM cand WHERE subject_id = 7 AND predicate_id = 1")
def _(s):
    """The point scan over files clustered by slot, of which the reader opens those that can hold it."""
    names = ("assertions", "assertion_retractions", "assertion_closures", "archive_transitions")
    database = _database(s, *names)
    database.replace("assertions", s.assertions.repartitionByRange(8, "subject_id", "predicate_id").sortWithinPartitions("subject_id", "predicate_id"), 1)
    return S.candidates(DatabaseStore(database), CTX, subject=7, predicate=1).select("assertion_id", "value_canon", "polarity")


@register("backup_differences", "SELECT 'sources' AS \"table\", count(*) AS n, CAST(NULL AS BIGINT) AS n_now FROM sources UNION ALL SELECT 'sources', NULL, count(*) FROM sources WHERE source_id % 2 = 0")
def _(s):
    """A summary kept of one version, held against a version whose rows were replaced."""
    database = _database(s, "sources", "perspectives")
    kept = database.summary(1)
    database.replace("sources", s.sources.filter("source_id % 2 = 0"), 1)
    return database.differences(kept, 2).select("table", "n", "n_now")


@register("value_violations", "SELECT result_key, CASE WHEN strlen(text) > 2000 THEN 'max_bytes' ELSE 'pattern' END AS reason FROM search_documents WHERE text IS NOT NULL AND (strlen(text) > 2000 OR NOT regexp_matches(text, ' '))")
def _(s):
    return N.value_violations(s.search_documents, "text", max_bytes=2000, pattern=" ").select("result_key", "reason")


@register("generated_corpus", """, g AS (SELECT i, (i * 2654435761) % 4294967296 AS m FROM (SELECT unnest(range(20000)) AS i))
SELECT i AS assertion_id, CASE WHEN m % 5 < 4 THEN 1 + (m // 7) % 128 ELSE 129 + (m // 11) % 100000 END AS subject_id, CASE WHEN (m // 13) % 4 < 3 THEN 1 + (m // 17) % 16 ELSE 17 + (m // 19) % 500 END AS predicate_id, 1 + (m // 23) % 100 AS space_id, (m // 29) % 3 AS layer_id, (m // 31) % 5 = 0 AS masked FROM g""")
def _(s):
    return N.corpus(s.spark, 20_000)


# scalars

@register("scalar_decimal", """SELECT k AS id, CASE WHEN k % 2 = 0 THEN '-' ELSE '' END || CAST(k AS VARCHAR) || CASE WHEN k % 10 = 0 THEN '' ELSE '.' || CAST(k % 10 AS VARCHAR) END AS canonical FROM (SELECT o_orderkey AS k FROM orders) WHERE k > 0""")
def _(s):
    k = F.col("assertion_id")
    text = F.concat(F.when(k % 2 == 0, "-").otherwise(""), F.lit("00"), k.cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("00"))
    return s.assertions.filter(k > 0).select(k.alias("id"), V.decimal_canonical(text).alias("canonical"))


@register("scalar_symbol", "SELECT value_canon, regexp_full_match(lower(value_canon), '[a-z][a-z0-9_]*') AS is_symbol, count(*) AS n FROM assertions GROUP BY 1")
def _(s):
    return s.assertions.groupBy("value_canon").agg(F.count("*").alias("n")).select("value_canon", V.is_symbol(F.lower("value_canon")).alias("is_symbol"), "n")


@register("scalar_days_in_month", "SELECT valid_start, CAST(day(last_day(DATE '1970-01-01' + CAST(valid_start AS INTEGER))) AS INTEGER) AS days FROM assertions")
def _(s):
    return s.assertions.select("valid_start", V.days_in_month(F.date_add(F.lit("1970-01-01").cast("date"), F.col("valid_start").cast("int"))).alias("days"))


@register("scalar_world_time", "SELECT assertion_id, valid_start * 86400000000000 AS ns FROM assertions")
def _(s):
    return s.assertions.select("assertion_id", V.world_nanoseconds(F.col("valid_start"), F.lit(V.NANOSECONDS_PER_DAY)).alias("ns"))


@register("scalar_world_time_sum", "SELECT assertion_id, valid_start * 86400000000000 + 3600000000000 AS ns FROM assertions")
def _(s):
    ns = V.world_nanoseconds(F.col("valid_start"), F.lit(V.NANOSECONDS_PER_DAY))
    return s.assertions.select("assertion_id", V.add_duration(ns, F.lit(3_600_000_000_000)).alias("ns"))


@register("scalar_time_order", "SELECT assertion_id, CASE WHEN layer_id = 0 THEN CASE WHEN valid_start < valid_end THEN -1 WHEN valid_start > valid_end THEN 1 WHEN valid_start = valid_end OR valid_start IS NULL OR valid_end IS NULL THEN 0 END END AS sign FROM assertions WHERE valid_start IS NOT NULL AND valid_end IS NOT NULL")
def _(s):
    rows = s.assertions.filter("valid_start IS NOT NULL AND valid_end IS NOT NULL")
    return rows.select("assertion_id", V.compare_on_timeline(F.col("layer_id"), F.col("valid_start"), F.lit(0), F.col("valid_end")).alias("sign"))


@register("scalar_civil_days", "SELECT assertion_id, valid_start AS days FROM assertions WHERE valid_start IS NOT NULL")
def _(s):
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("valid_start").cast("int"))
    return s.assertions.filter("valid_start IS NOT NULL").select("assertion_id", V.days_from_civil(F.year(day), F.month(day), F.dayofmonth(day)).cast("long").alias("days"))


@register("scalar_varint", "SELECT assertion_id, CASE WHEN assertion_id < 128 THEN lower(printf('%02x', assertion_id)) WHEN assertion_id < 16384 THEN lower(printf('%02x%02x', 128 + assertion_id % 128, assertion_id // 128)) ELSE lower(printf('%02x%02x%02x', 128 + assertion_id % 128, 128 + (assertion_id // 128) % 128, assertion_id // 16384)) END AS code FROM assertions WHERE assertion_id < 2097152")
def _(s):
    return s.assertions.filter("assertion_id < 2097152").select("assertion_id", V.varint(F.col("assertion_id")).alias("code"))


@register("scalar_urlsafe", "SELECT result_key, rtrim(translate(to_base64(encode(text[1:60])), '+/', '-_'), '=') AS code FROM search_documents WHERE text IS NOT NULL")
def _(s):
    return s.search_documents.filter("text IS NOT NULL").select("result_key", V.urlsafe(F.encode(F.substring("text", 1, 60), "utf-8")).alias("code"))


@register("scalar_decimal_order", "SELECT k AS id, row_number() OVER (ORDER BY v) AS place FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * (o_orderkey + o_orderkey % 10 / 10.0) AS v FROM orders) WHERE k BETWEEN 1 AND 500")
def _(s):
    k = F.col("assertion_id")
    text = V.decimal_canonical(F.concat(F.when(k % 2 == 0, "-").otherwise(""), k.cast("string"), F.lit("."), (k % 10).cast("string")))
    rows = s.assertions.filter(k.between(1, 500)).select(k.alias("id"), V.decimal_key(text, 40).alias("key"))
    return rows.select("id", F.row_number().over(Window.orderBy("key")).cast("long").alias("place"))


@register("scalar_utf8_length", "SELECT result_key, CAST(strlen(text) AS INTEGER) AS n_bytes FROM search_documents")
def _(s):
    return s.search_documents.select("result_key", V.utf8_length(F.col("text")).alias("n_bytes"))


@register("scalar_fingerprint", "SELECT assertion_id, sha256(CAST(strlen(CAST(assertion_id AS VARCHAR)) AS VARCHAR) || ':' || CAST(assertion_id AS VARCHAR) || '|' || CAST(strlen(value_canon) AS VARCHAR) || ':' || value_canon) AS fingerprint FROM assertions")
def _(s):
    return s.assertions.select("assertion_id", V.fingerprint(F.col("assertion_id"), F.col("value_canon")).alias("fingerprint"))


def queries() -> dict:
    return {name: query for name, (query, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (_, sql) in REGISTRY.items():
        if sql is not None:
            joint = "" if sql.lstrip().startswith(",") else "\n"
            out[name] = f"WITH RECURSIVE {ansi_views()},\n{SEEN.strip()}{joint}{sql}"
    return out

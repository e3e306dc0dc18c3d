"""Record families derived from the order and event tables by integer projections.

The same text runs on Spark and on other SQL engines; only day and microsecond numbers differ.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

SPARK_DAY = "CAST(datediff(CAST(o_orderdate AS DATE), DATE'1970-01-01') AS BIGINT)"
SPARK_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
ANSI_DAY = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"
ANSI_MICROS = "epoch_us(ts)"

#: Name -> (base table, SELECT list and filter over it).
VIEWS = {
    "assertions": ("orders", "SELECT o_orderkey AS assertion_id, o_custkey % 397 AS subject_id, o_orderkey % 3 AS predicate_id, 1 + o_orderkey % 7 AS space_id, CAST((o_orderkey - o_orderkey % 7) / 7 AS BIGINT) % 3 AS layer_id, CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END AS perspective_id, CASE WHEN o_orderkey % 4 = 3 THEN 'believes' ELSE 'world_state' END AS mode, o_orderstatus AS value_canon, CASE WHEN o_orderkey % 5 = 0 THEN 'negative' ELSE 'positive' END AS polarity, CASE WHEN o_orderkey % 29 = 5 THEN NULL ELSE {day} END AS valid_start, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 29 = 5 THEN NULL ELSE {day} + 400 + (o_orderkey % 10) * 200 END AS valid_end, 1 + (o_orderkey * 37) % 8000 AS revision FROM {base}"),
    "assertion_retractions": ("orders", "SELECT o_orderkey AS assertion_id, 1 + (o_orderkey * 37) % 8000 + 500 AS revision FROM {base} WHERE o_orderkey % 13 = 0"),
    "assertion_closures": ("orders", "SELECT o_orderkey AS assertion_id, 1 + (o_orderkey * 37) % 8000 + 300 AS revision, {day} + 100 AS close_at FROM {base} WHERE o_orderkey % 17 = 0"),
    "archive_transitions": ("orders", "SELECT 2 * o_orderkey AS transition_id, 'assertion' AS target_kind, o_orderkey AS target_id, 'archive' AS action, 1 + (o_orderkey * 37) % 8000 + 100 AS revision FROM {base} WHERE o_orderkey % 19 = 0 UNION ALL SELECT 2 * o_orderkey + 1 AS transition_id, 'assertion' AS target_kind, o_orderkey AS target_id, 'unarchive' AS action, 1 + (o_orderkey * 37) % 8000 + 900 AS revision FROM {base} WHERE o_orderkey % 38 = 0 UNION ALL SELECT 2 * o_orderkey AS transition_id, 'mask' AS target_kind, o_orderkey AS target_id, 'archive' AS action, 1 + (o_orderkey * 37) % 8000 + 60 AS revision FROM {base} WHERE o_orderkey % 6 = 1 AND o_orderkey % 7 = 0 UNION ALL SELECT 2 * o_orderkey AS transition_id, 'boundary' AS target_kind, o_orderkey AS target_id, 'archive' AS action, 1 + (o_orderkey * 37) % 8000 + 70 AS revision FROM {base} WHERE o_orderkey % 48 = 2 AND o_orderkey % 5 = 0"),
    "masks": ("orders", "SELECT o_orderkey AS mask_id, CASE 1 + o_orderkey % 7 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 6 ELSE 1 + o_orderkey % 7 END AS space_id, 2 AS layer_id, CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END AS perspective_id, CASE WHEN o_orderkey % 4 = 3 THEN 'believes' ELSE 'world_state' END AS mode, CASE CAST((o_orderkey - o_orderkey % 6) / 6 AS BIGINT) % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'proposition' ELSE 'slot' END AS selector, o_orderkey AS assertion_id, o_custkey % 397 AS subject_id, o_orderkey % 3 AS predicate_id, o_orderstatus AS value_canon, CASE WHEN o_orderkey % 5 = 0 THEN 'negative' ELSE 'positive' END AS polarity, CASE WHEN o_orderkey % 4 = 1 THEN {day} - 200 END AS valid_start, CASE WHEN o_orderkey % 4 = 1 THEN {day} + 700 END AS valid_end, 1 + (o_orderkey * 37) % 8000 + 50 AS revision FROM {base} WHERE o_orderkey % 6 = 1"),
    "mask_closures": ("orders", "SELECT o_orderkey AS mask_id, 1 + (o_orderkey * 37) % 8000 + 120 AS revision, {day} + 400 AS close_at FROM {base} WHERE o_orderkey % 6 = 1 AND o_orderkey % 5 = 0"),
    "mask_retractions": ("orders", "SELECT o_orderkey AS mask_id, 1 + (o_orderkey * 37) % 8000 + 400 AS revision FROM {base} WHERE o_orderkey % 6 = 1 AND o_orderkey % 9 = 0"),
    "boundaries": ("orders", "SELECT o_orderkey AS boundary_id, 2 AS space_id, 1 AS layer_id, 0 AS perspective_id, 'world_state' AS mode, o_custkey % 397 AS subject_id, 2 AS predicate_id, CASE WHEN o_orderkey % 96 = 2 THEN {day} - 100 END AS valid_start, CASE WHEN o_orderkey % 96 = 2 THEN {day} + 900 END AS valid_end, 1 + (o_orderkey * 37) % 8000 AS revision FROM {base} WHERE o_orderkey % 48 = 2"),
    "boundary_closures": ("orders", "SELECT o_orderkey AS boundary_id, 1 + (o_orderkey * 37) % 8000 + 90 AS revision, {day} + 300 AS close_at FROM {base} WHERE o_orderkey % 48 = 2 AND o_orderkey % 7 = 1"),
    "boundary_retractions": ("orders", "SELECT o_orderkey AS boundary_id, 1 + (o_orderkey * 37) % 8000 + 110 AS revision FROM {base} WHERE o_orderkey % 48 = 2 AND o_orderkey % 11 = 0"),
    "world_events": ("events", "SELECT event_id, event_type AS kind, 'actor' AS role, user_id AS participant_id, 1 + event_id % 7 AS space_id, event_id % 3 AS layer_id, event_id % 2 = 1 AS is_span, {micros} AS start_us, CASE WHEN event_id % 2 = 0 OR event_id % 10 = 9 THEN NULL ELSE {micros} + (1 + event_id % 48) * 3600000000 END AS end_us, 1 + (event_id * 53) % 8000 AS revision FROM {base}"),
    "event_span_closures": ("events", "SELECT event_id, {micros} + 21600000000 AS close_at, 1 + (event_id * 53) % 8000 + 200 AS revision FROM {base} WHERE event_id % 20 = 9"),
    "event_retractions": ("events", "SELECT event_id, 1 + (event_id * 53) % 8000 + 300 AS revision FROM {base} WHERE event_id % 23 = 0"),
    "event_masks": ("events", "SELECT event_id AS event_mask_id, event_id, 4 AS space_id, 2 AS layer_id, 1 + (event_id * 53) % 8000 + 100 AS revision FROM {base} WHERE event_id % 29 = 0"),
    "event_mask_retractions": ("events", "SELECT event_id AS event_mask_id, 1 + (event_id * 53) % 8000 + 350 AS revision FROM {base} WHERE event_id % 29 = 0 AND event_id % 3 = 0"),
    "event_archive_transitions": ("events", "SELECT event_id AS target_id, 'archive' AS action, 1 + (event_id * 53) % 8000 + 150 AS revision FROM {base} WHERE event_id % 31 = 0"),
    "event_kinds": ("events", "SELECT DISTINCT event_type AS kind, 'actor' AS role, 1 AS min_participants, 1 AS max_participants, 0 AS revision FROM {base}"),
    "event_relations": ("events", "SELECT 3 * event_id AS relation_id, 'before' AS kind, event_id AS from_id, event_id + 7 AS to_id, 1 + (event_id * 53) % 8000 AS revision FROM {base} WHERE event_id % 5 = 0 UNION ALL SELECT 3 * event_id + 1 AS relation_id, 'same_time' AS kind, event_id AS from_id, event_id + 1 AS to_id, 1 + (event_id * 53) % 8000 AS revision FROM {base} WHERE event_id % 50 = 0 UNION ALL SELECT 3 * event_id + 2 AS relation_id, 'causes' AS kind, event_id AS from_id, event_id + 3 AS to_id, 1 + (event_id * 53) % 8000 AS revision FROM {base} WHERE event_id % 8 = 0 UNION ALL SELECT 3 * event_id + 2 AS relation_id, 'after' AS kind, event_id AS from_id, event_id - 11 AS to_id, 1 + (event_id * 53) % 8000 AS revision FROM {base} WHERE event_id % 16 = 12"),
    "planted_relations": ("events", "SELECT event_id AS relation_id, 'before' AS kind, event_id AS from_id, CASE WHEN event_id < 20 THEN (event_id + 1) % 20 ELSE event_id + 1 END AS to_id FROM {base} WHERE event_id < 40 UNION ALL SELECT 1000 + event_id AS relation_id, 'before' AS kind, event_id AS from_id, event_id + 20 AS to_id FROM {base} WHERE event_id = 15 UNION ALL SELECT 2000 + event_id AS relation_id, 'causes' AS kind, event_id AS from_id, (event_id + 1) % 6 AS to_id FROM {base} WHERE event_id < 12"),
    "planted_provenance": ("orders", "SELECT o_orderkey AS edge_id, o_orderkey AS from_id, (o_orderkey + 1) % 10 AS to_id, 'derived_from' AS relation FROM {base} WHERE o_orderkey < 30"),
    "planted_transitions": ("orders", "SELECT o_orderkey AS target_id, 'archive' AS action, 10 AS revision FROM {base} WHERE o_orderkey % 50 IN (0, 2) UNION ALL SELECT o_orderkey AS target_id, 'archive' AS action, 20 AS revision FROM {base} WHERE o_orderkey % 50 = 0 UNION ALL SELECT o_orderkey AS target_id, 'unarchive' AS action, 20 AS revision FROM {base} WHERE o_orderkey % 50 IN (1, 2)"),
    "event_relation_retractions": ("events", "SELECT 3 * event_id AS relation_id, 1 + (event_id * 53) % 8000 + 250 AS revision FROM {base} WHERE event_id % 35 = 0"),
    "sources": ("supplier", "SELECT s_suppkey AS source_id, 'document' AS kind, s_name AS locator, 1 + s_suppkey % 100 AS revision FROM {base}"),
    "evidence": ("orders", "SELECT o_orderkey AS evidence_id, o_orderkey % 10 AS source_id, o_orderkey AS target_id, CASE o_orderkey % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'contradicts' ELSE 'documents' END AS relation, 1 + o_orderkey % 7 AS target_space_id, 1 + (o_orderkey * 37) % 8000 AS target_revision, 1 + (o_orderkey * 37) % 8000 + 10 AS revision FROM {base} WHERE o_orderkey % 4 = 0"),
    "evidence_retractions": ("orders", "SELECT o_orderkey AS evidence_id, 1 + (o_orderkey * 37) % 8000 + 700 AS revision FROM {base} WHERE o_orderkey % 44 = 0 UNION ALL SELECT o_orderkey AS evidence_id, 1 + (o_orderkey * 37) % 8000 + 600 AS revision FROM {base} WHERE o_orderkey % 88 = 0"),
    "provenance": ("orders", "SELECT o_orderkey AS edge_id, o_orderkey AS from_id, o_orderkey - 1 AS to_id, CASE o_orderkey % 2 WHEN 0 THEN 'derived_from' ELSE 'corrects' END AS relation, 1 + (o_orderkey * 37) % 8000 AS revision FROM {base} WHERE o_orderkey % 7 = 3 OR o_orderkey % 7 = 4"),
    "provenance_retractions": ("orders", "SELECT o_orderkey AS edge_id, 1 + (o_orderkey * 37) % 8000 + 150 AS revision FROM {base} WHERE o_orderkey % 21 = 3"),
    "search_documents": ("documents", "SELECT doc_id AS result_key, text, 1 + doc_id % 7 AS space_id, doc_id % 3 AS layer_id FROM {base}"),
    "entities": ("customer", "SELECT c_custkey AS entity_id, c_mktsegment AS entity_type, 1 + c_custkey % 5000 AS revision FROM {base}"),
    "entity_retirements": ("customer", "SELECT c_custkey AS entity_id, 1 + c_custkey % 5000 + 800 AS revision FROM {base} WHERE c_custkey % 17 = 0"),
    "perspectives": ("nation", "SELECT n_nationkey % 10 AS perspective_id, n_name AS label, 1 + n_nationkey * 200 AS revision FROM {base}"),
    "perspective_retirements": ("nation", "SELECT n_nationkey % 10 AS perspective_id, 1 + n_nationkey * 200 + 500 AS revision FROM {base} WHERE n_nationkey % 10 = 7"),
    "schema_predicates": ("nation", "SELECT n_nationkey % 3 AS predicate_id, 1 + n_nationkey * 300 AS revision, CASE n_nationkey % 3 WHEN 0 THEN 'single_value_replace' WHEN 1 THEN 'multi_value_overlay' ELSE 'multi_value_replace' END AS policy, CASE WHEN n_nationkey > 20 THEN 'deprecated' ELSE 'active' END AS lifecycle FROM {base}"),
}
#: Branches: id, parent, revision of the parent up to which it is seen.
SPACES = [(1, None, 0), (2, 1, 2000), (3, 1, 2000), (4, 2, 4000), (5, 2, 4000), (6, 3, 4000), (7, 3, 4000)]
#: Layers: id, rank.
LAYERS = [(0, 0), (1, 10), (2, 20)]


class Store:
    """The record families of one database, as lazy tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def history_spaces(self) -> DataFrame:
        return self.spark.createDataFrame(SPACES, "space_id long, parent_id long, base_revision long")

    @property
    def layers(self) -> DataFrame:
        return self.spark.createDataFrame(LAYERS, "layer_id long, layer_rank long")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        base, text = VIEWS[name]
        frame = self.spark.read.parquet(f"{self.sf_dir}/{base}.parquet")
        return self.spark.sql(text.replace("{day}", SPARK_DAY).replace("{micros}", SPARK_MICROS), base=frame)


@cache
def ansi_views() -> str:
    """The families, branches and layers as common table expressions for the oracle."""
    parts = [f"{name} AS ({text.format(base=base, day=ANSI_DAY, micros=ANSI_MICROS)})" for name, (base, text) in VIEWS.items()]
    spaces = ", ".join(f"({a}, {'NULL' if b is None else b}, {c})" for a, b, c in SPACES)
    parts.append(f"history_spaces(space_id, parent_id, base_revision) AS (VALUES {spaces})")
    parts.append("layers(layer_id, layer_rank) AS (VALUES " + ", ".join(map(str, LAYERS)) + ")")
    return ",\n".join(parts)

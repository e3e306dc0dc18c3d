"""Exact top-k inner products by the three-phase uniform threshold.

The components of the vectors are split into m slices, each a list of partial scores of its own.
1. Every block of rows sends, per query and slice, its k best partial scores with the totals of those
   rows.  The k-th best total seen is a cutoff that no true answer falls below.
2. The cutoff goes back to all blocks.  A total of at least the cutoff has a slice of at least cutoff / m,
   so the entries that reach this uniform threshold are enough; they are collected with the sum of the
   slices that reached it, and those that can't come to the cutoff any more are dropped.
3. Candidates with slices below the threshold get their remaining scores exactly, and are ranked.

Queries are a stated set and meet the rows block by block; blocks are packed rows of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored, table

SLICES, QUERY_BLOCK, ROW_BLOCK = 2, 512, 8192
#: The row blocks that meet one query block are dealt over so many tasks at least.
SALTS = 16


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, embedding -> vec_id, v array<long>: floor(scale * x).

    Null and empty vectors, and those that hold a null or a non-finite component, are left out; a
    component whose multiple has more than 64 bits fails the query.  Repeated rows and null ids are kept.
    """
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**62, F.floor(x.cast("double") * scale).cast("long")).otherwise(F.raise_error(F.lit("a component has more than 64 bits")).cast("long"))
    return vectors.filter(good).select("vec_id", F.transform("embedding", whole).alias("v"))


def _packed(rows: DataFrame) -> DataFrame:
    """Blocks of at most ROW_BLOCK rows of one dimension: ids and components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROW_BLOCK):
                batch = whole.slice(at, ROW_BLOCK)
                dims = batch.column(1).value_lengths().to_numpy()
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    values = batch.column(1).take(pa.array(own)).flatten().to_numpy().astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([ids[own].tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["dim", "ids", "data"])

    return rows.select("vec_id", "v").filter(F.col("vec_id").isNotNull()).mapInArrow(run, "dim int, ids binary, data binary")


#: Scores from here on can't be returned as 64 bits.
WIDE = 1 << 62


def _partials(q: np.ndarray, v: np.ndarray, slices: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Inner products by slice of the components; the rows where these may exceed 64 bits; for those rows the whole products, exact, at most WIDE.

    Wide rows have no slices of their own (zero).
    """
    cuts = [q.shape[1] * i // slices for i in range(slices + 1)]
    high = np.abs(v).max(axis=1, initial=0).astype(float) * float(np.abs(q).max(initial=0)) * q.shape[1]
    wide = high >= 2.0**61
    whole = np.zeros((len(q), len(v)), np.int64)
    if wide.any():
        rows = np.flatnonzero(wide)
        exact = q.astype(object) @ v[rows].T.astype(object)  # Python integers
        whole[:, rows] = np.minimum(np.maximum(exact, -WIDE), WIDE).astype(np.int64)
        v = np.where(wide[:, None], 0, v)
    kind = np.float64 if high[~wide].max(initial=0) < 2**52 else np.int64  # floats hold every sum below 2^53 exactly, and multiply faster
    q, v = q.astype(kind), v.astype(kind)
    return [(q[:, a:b] @ v[:, a:b].T).astype(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], wide, whole


def _meet(blocks: DataFrame, queries: DataFrame, count: int, scan, schema: str) -> DataFrame:
    """Every block of rows with every block of queries of its dimension, through ``scan``."""
    placed = blocks.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    copies = queries.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    pairs = placed.join(copies, ["dim", "part", "salt"]).select("dim", "ids", "data", "qids", "qdata", "cutoffs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, v = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.int64).reshape(-1, row["dim"])
                qids = np.array(row["qids"], np.int64)
                q = np.array(row["qdata"], np.int64).reshape(len(qids), row["dim"])
                cutoffs = np.array(row["cutoffs"], np.int64)
                for at in range(0, len(qids), 64):
                    own = slice(at, at + 64)
                    yield scan(qids[own], ids, *_partials(q[own], v, SLICES), cutoffs[own])

    return pairs.mapInArrow(run, schema)


NO_CUTOFF = -(1 << 62)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vec_id, v of ``rows`` and of ``queries`` -> query_id, rank, vec_id, score: the k highest integer inner products.

    Rows with the query's own vec_id are no candidates; ties go to the smaller vec_id; queries with
    fewer candidates return all.  Vectors of another length than the query's, and rows without an
    id, take no part.  Products are exact whatever the components; only an answer that doesn't fit 62 bits
    fails the query.  Several rows of one vec_id are one query and separate candidates; empty tables give
    an empty table; other columns are not looked at.
    """
    blocks = stored(_packed(rows))
    asked = stored(queries.filter(F.col("vec_id").isNotNull()).dropDuplicates(["vec_id"]))
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")

    def packed_queries(with_cutoff: DataFrame) -> DataFrame:
        """About QUERY_BLOCK queries a row."""
        items = F.collect_list(F.struct("vec_id", "v", "cutoff"))
        blocks_ = with_cutoff.groupBy(F.size("v").alias("dim"), part.alias("part")).agg(items.alias("items"))
        return blocks_.select("dim", "part", F.col("items.vec_id").alias("qids"), F.flatten(F.col("items.v")).alias("qdata"), F.col("items.cutoff").alias("cutoffs"))

    def first(qids, ids, partials, wide, whole, cutoffs) -> pa.RecordBatch:
        out = []
        total = np.where(wide, whole, sum(partials))
        for p in [*partials, whole] if wide.any() else partials:
            p = np.where(qids[:, None] == ids[None, :], NO_CUTOFF, p)
            best = np.argpartition(-p, min(k, p.shape[1]) - 1, axis=1)[:, :k]
            out.append(best)
        best = np.concatenate(out, axis=1)
        q = np.repeat(qids, best.shape[1])
        v, score = ids[best].ravel(), np.take_along_axis(total, best, axis=1).ravel()
        keep = q != v
        return pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(v[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "total"])

    seen = _meet(blocks, packed_queries(asked.withColumn("cutoff", F.lit(NO_CUTOFF))), parts, first, "query_id long, vec_id long, total long").distinct()
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("total").desc(), "vec_id"))
    cutoffs = seen.withColumn("place", order).filter(F.col("place") <= k).groupBy("query_id").agg(F.min("total").alias("low"), F.count("*").alias("n"))
    cutoffs = cutoffs.select("query_id", F.when(F.col("n") == k, F.col("low")).otherwise(F.lit(NO_CUTOFF)).alias("cutoff"))
    told = stored(asked.join(cutoffs, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce("cutoff", F.lit(NO_CUTOFF)).alias("cutoff")))

    def second(qids, ids, partials, wide, whole, cutoffs) -> pa.RecordBatch:
        known = np.zeros(partials[0].shape, np.int64)
        missing = np.zeros(partials[0].shape, np.int64)
        low = cutoffs[:, None]
        for p in partials:
            high = p * SLICES >= low
            known += np.where(high, p, 0)
            missing += ~high
        known, missing = np.where(wide, whole, known), np.where(wide, 0, missing)
        enough = (missing < SLICES) & (known + missing * ((low - 1) // SLICES) >= low) & (qids[:, None] != ids[None, :])
        q, v = np.nonzero(enough)
        return pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids[v]), pa.array(known[q, v]), pa.array(missing[q, v])], names=["query_id", "vec_id", "known", "missing"])

    entries = stored(_meet(blocks, packed_queries(told), parts, second, "query_id long, vec_id long, known long, missing long"))
    whole = entries.filter("missing = 0").select("query_id", "vec_id", F.col("known").alias("score"))
    open_ = entries.filter("missing > 0").select("query_id", "vec_id").distinct()
    open_ = open_.join(rows, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").filter(F.size("v") == F.size("q"))
    product = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    scores = whole.unionByName(open_.select("query_id", "vec_id", product.alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    fits = F.when(F.abs("score") < WIDE, F.col("score")).otherwise(F.raise_error(F.lit("a score has more than 62 bits")).cast("long"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", fits.alias("score"))


def op2(spark, sf_dir: str) -> DataFrame:
    rows = stored(scaled(table(spark, sf_dir, "embeddings")))
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget.  Within a source documents stand in the order of exponential
keys -ln(u)/w, so a document of weight w comes early with a chance in proportion to w; the first
``budget`` words in that order are the sample.  Complete epochs of a source come before the
fractional selection.

Prefix sums are taken in two steps, so that a source with a third of all rows is never ordered
within one task: word sums by (source, key bucket) are accumulated over at most ``buckets`` rows a
source, and only documents of the one bucket in which the budget ends are ordered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored, words

BUCKETS = 4096
#: Sources are numbered in so many ranges of their names.
RANGES = 16
#: Targets of up to so many sources are broadcast; more are joined, each source dealt over SALTS tasks.
BROADCAST_SOURCES, SALTS = 100_000, 64


def uniform(*parts: Column) -> Column:
    """A repeatable draw from (0, 1): 52 bits of an MD5 of the parts."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def plain_quality(text: Column, size: Column) -> Column:
    """A quality weight from the text alone, 0.025 to 1: a quarter where the mean word hasn't 3 to 13 bytes, and less the more of its bytes are digits and marks."""
    mean = F.try_divide(F.octet_length(text), size)  # null without words
    marks = F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"[!-@\[-`{-~]")), F.octet_length(text)), F.lit(0.0))
    return F.when((mean >= 3) & (mean <= 13), F.lit(1.0)).otherwise(F.lit(0.25)) * F.greatest(F.lit(0.1), 1 - 3 * marks)


def _numbered(sizes: DataFrame) -> DataFrame:
    """Adds ``turn``, the place of each source in code point order from 0, null last; no task holds all sources."""
    part = F.spark_partition_id()
    spread = stored(sizes.repartitionByRange(RANGES, F.col("source").asc_nulls_last()).withColumn("part", part))
    counts = spread.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    offset = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return spread.withColumn("within", within).join(F.broadcast(counts.select("part", offset.alias("offset"))), "part").select("source", "source_size", (F.col("offset") + F.col("within") - 1).alias("turn"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """(source, source_size) -> the same with ``target``, in words.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes.
    A target stops at ``epochs`` times its source's size; the excess goes to the others by weight
    until none is above.  Each round needs two sums over the sources: those that are full stay full,
    since what is left for a weight only grows.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("long")
    s = stored(_numbered(sizes).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("cap")))
    exact = lambda x: (F.lit(str(x)) if isinstance(x, int) else x).cast("decimal(38,0)")
    total = int(s.agg(F.sum("source_size")).first()[0] or 0)
    full, known = F.lit(False), None
    while True:
        row = s.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, exact(F.col("cap")))), F.count(F.when(full, 1))).first()
        if row[2] == known:
            break
        known, open_weight, left = row[2], int(row[0] or 0), total - int(row[1] or 0)
        if not open_weight:
            break
        full = exact(F.col("cap")) * exact(open_weight) <= exact(left) * exact(F.col("weight"))
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(max(1, open_weight)))
    return s.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, quality: Column | None = None, seed: int = 8, buckets: int = BUCKETS, split_last: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source and text of ``docs`` -> doc_id, source, size, source_size, target, taken, after the columns ``keep``.

    size: words of the text.  taken: words the mix takes of the document, repeats counted: its size
    times the complete epochs, plus the fractional pass.  There the document in which the budget
    ends gives the words that are missing (``split_last``), or all of its words or none, whichever
    is nearer.  ``quality`` gives the weights of the draw (positive; default: plain_quality).

    Null sources are one source of their own, null and empty texts have size 0 and are taken 0 times.
    The draw depends on id and text, so it doesn't depend on the order of rows: ties of keys go by
    doc_id, then by a digest of the text, and what ties then too are repeated rows, which count as
    separate documents and are interchangeable.  An empty table gives an empty table.  Kept columns
    with the name of a result give way to it.
    """
    size = words(F.col("text"))
    w = F.coalesce(quality if quality is not None else plain_quality(F.col("text"), size), F.lit(1.0))
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    kept = [c for c in keep if c.lower() not in ("doc_id", "source", "size", "source_size", "target", "taken")]
    drawn = docs.select(*(F.col(f"`{c}`").alias(f"kept{k}") for k, c in enumerate(kept)), "doc_id", "source", size.alias("size"), digest.alias("_digest"), (-F.log(uniform(F.lit(seed), F.col("doc_id"), digest)) / w).alias("_key"))
    # buckets of about equal share for keys of weight 1, and as many again for the long tail of light ones
    tail = F.lit(float(buckets)).cast("double")
    drawn = stored(drawn).withColumn("_bucket", F.when(F.col("_key") < F.log(tail), F.floor((1 - F.exp(-F.col("_key"))) * buckets)).otherwise(buckets + F.floor((F.col("_key") - F.log(tail)) * 64)).cast("int"))
    cells = stored(drawn.groupBy("source", "_bucket").agg(F.sum("size").alias("cell_size")))
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, epochs)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.try_divide(F.col("target"), F.col("source_size")))).otherwise(0).cast("long")
    targets = targets.withColumn("rounds", F.least(rounds, F.lit(epochs)))
    targets = targets.withColumn("budget", F.round(F.col("target") - F.col("rounds") * F.col("source_size")).cast("long"))
    # rounding can fill the fractional pass: then it is one more round
    filled = (F.col("source_size") > 0) & (F.col("budget") >= F.col("source_size"))
    targets = targets.withColumns({"rounds": F.col("rounds") + filled.cast("long"), "budget": F.when(filled, F.lit(0)).otherwise(F.col("budget")).cast("long")})

    same = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(same), F.lit(0)))
    ends = ends.withColumnRenamed("source", "cell_source").join(targets, F.col("cell_source").eqNullSafe(F.col("source")))
    ends = ends.filter((F.col("cell_start") <= F.col("budget")) & (F.col("budget") < F.col("cell_start") + F.col("cell_size")))
    ends = ends.select(F.col("cell_source").alias("source"), F.col("_bucket").alias("last_bucket"), "cell_start")
    targets = targets.withColumnRenamed("source", "target_source").join(ends, F.col("target_source").eqNullSafe(F.col("source")), "left").drop("source")
    targets = stored(targets.select("target_source", "source_size", "target", "rounds", "budget", F.col("last_bucket").alias("_last"), F.col("cell_start").alias("_start")))

    if targets.count() <= BROADCAST_SOURCES:
        joined = drawn.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("target_source")))
    else:
        salted = drawn.withColumn("_salt", F.pmod(F.xxhash64("_digest"), F.lit(SALTS)))
        dealt = targets.withColumn("target_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(dealt, F.col("source").eqNullSafe(F.col("target_source")) & (F.col("_salt") == F.col("target_salt")))
    at_end = F.coalesce(F.col("_bucket") == F.col("_last"), F.lit(False))
    early = F.coalesce(F.col("_bucket") < F.col("_last"), F.lit(False))
    rest = joined.filter(~at_end).withColumn("_part", F.when(early, F.col("size")).otherwise(F.lit(0)))
    inner = Window.partitionBy("source").orderBy("_key", "doc_id", "_digest").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("budget") - F.col("_start") - F.coalesce(F.sum("size").over(inner), F.lit(0))
    part = F.greatest(F.lit(0), F.least(gap, F.col("size"))) if split_last else F.when(gap * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    edge = joined.filter(at_end).withColumn("_part", part)
    out = rest.unionByName(edge)
    return out.select(*(F.col(f"kept{k}").alias(c) for k, c in enumerate(kept)), "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("rounds") + F.col("_part")).alias("taken"))


def op8(spark, sf_dir: str) -> DataFrame:
    """One row per document of the mix, with production weights."""
    from tidemark.llm.shared import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, strlen(text) AS bytes,
         md5(coalesce(text, '')) AS digest, coalesce(len(regexp_extract_all(text, '[!-@\[-`{-~]')) / nullif(strlen(text), 0), 0) AS marks,
         (CAST('0x' || substr(md5('8|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (CASE WHEN size > 0 AND bytes / size BETWEEN 3 AND 13 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END * greatest(0.1::DOUBLE, 1 - 3 * marks::DOUBLE)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM d GROUP BY source),
fill(step, source, source_size, weight, target, closed) AS (
  SELECT 0, source, source_size, weight, NULL::DOUBLE, false FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight,
         CASE WHEN closed THEN target WHEN above THEN (3 * source_size)::DOUBLE ELSE (weight * lft)::DOUBLE / open_w::DOUBLE END, closed OR above
  FROM (SELECT *, NOT closed AND (3 * source_size)::HUGEINT * open_w <= lft::HUGEINT * weight AS above
        FROM (SELECT *, sum(source_size) OVER () - sum(CASE WHEN closed THEN 3 * source_size ELSE 0 END) OVER () AS lft,
                     sum(CASE WHEN closed THEN 0 ELSE weight END) OVER () AS open_w FROM fill))
  WHERE step < 60),
t AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS rounds FROM fill WHERE step = 60),
j AS (SELECT k.doc_id, k.size, t.source_size, t.target, t.rounds, round(t.target - t.rounds * t.source_size)::BIGINT AS budget,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * rounds + greatest(0, least(budget - before, size)))::BIGINT AS taken FROM j
"""

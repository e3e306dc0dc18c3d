"""What the corpus operators share: input tables, word rules, durable intermediate tables."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.components import shared_folder, stored

__all__ = ["WORD", "packed", "replacing", "shared_folder", "slices", "stored", "table", "tidy", "unpacked", "utf8", "words"]

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy() -> None:
    """Gives memory back at the end of a task: an idle Python worker still counts against its executor."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def replacing(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without the columns that results of these names take the place of, whatever their case."""
    taken = {n.lower() for n in names}
    return docs.select(*(docs[f"`{c}`"] for c in docs.columns if c.lower() not in taken))


def words(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(df: DataFrame) -> DataFrame:
    """``df`` with its text column compressed (zstd), for shuffles of whole texts; null stays null."""
    schema = df.withColumn("text", F.lit(None).cast("binary")).select(df.columns).schema
    at = df.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in slices(batch, "text"):
                known = part.column(at).is_valid().to_pylist()
                small = [len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True) if k else None for t, k in zip(texts, known, strict=True)]
                columns = [pa.array(small, pa.binary()) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def unpacked(small: bytes) -> bytes:
    """A text as ``packed`` left it; null is empty."""
    import pyarrow as pa

    size = int.from_bytes(small[:8], "little") if small else 0
    return pa.decompress(small[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def utf8(batch, name: str) -> list[bytes]:
    """A string column of an Arrow batch as bytes; null is empty."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch, name: str, size: int = 4 << 20):
    """An Arrow batch by runs of rows of about ``size`` bytes of a string or binary column, with its values as bytes; null is empty.

    A run is longer only by its last value, so tasks hold memory by bytes and not by rows.
    """
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = batch.slice(a, b - a)
        yield part, utf8(part, name)

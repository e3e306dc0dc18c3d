"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Columns doc_id, text, lang, source and n_chars go through all stages but the last, which returns the
token ids; other columns of the first table are left behind, whatever their names.  Repeated ids come from
the mix, which takes documents of small sources several times.  An empty table goes through every stage
as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, quality, simhash, suffix
from tidemark.llm.shared import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a score of 0.7 or more; learned from labels of three quarters of the ids.

    Null and empty texts get the score of no features, null ids and repeated rows are scored like any
    other; equal texts have equal scores, so they stay or go together.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), trainable=quality.remainder(4) != 2)
    return quality.score(docs.select(*COLUMNS), model).filter("quality_score >= 0.7").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (null last, ties by a digest of the text), of each group of near copies (five-word shingles, similarity 0.8).

    MinHash keys find the pairs; a chain of segments of their fingerprints' ring must hold its budgets,
    all bits may differ in 90 of 256 (39 on average at that similarity), and the sets of shingles decide.
    Null and empty texts are copies of each other; rows that repeat both id and text are one document.
    """
    gone = simhash.near_copies(docs, shingle=5).filter(~F.col("kept")).select(F.col("doc_id").alias("gone"), F.col("digest").alias("gone_digest")).distinct()
    return docs.select(*COLUMNS).join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (simhash.text_digest() == F.col("gone_digest")), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that occur earlier; documents of which nothing stays go.

    Earlier is what has a smaller id, null last, ties by a hash of the text; rows that repeat both are one
    document.  Null and empty texts, and those under 100 bytes, stay as they are.
    """
    done = suffix.remove_repeats(docs.select(*COLUMNS), characters=True)
    text = F.when(F.size("removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    cut = done.withColumn("text", text).filter((F.size("removed") == 0) | (F.octet_length("kept") > 0))
    return cut.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; at the end of a budget a document is taken whole or not at all.

    Null sources are one source; documents without words have no share and go; the draw depends on id and
    text, so repeated rows are taken alike but for the one at which a budget ends, and reruns agree.
    """
    mixed = mixing.mix(docs, split_last=False, keep=COLUMNS).filter("taken > 0")
    times = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return mixed.select(*COLUMNS, F.explode(times)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every text; a null text has none; every row by itself, repeated ones too."""
    path, pattern = bpe.multilingual()
    encoded = bpe.encode(docs, path, pattern, ("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL can't express the learned, the hashed and the tokenised stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

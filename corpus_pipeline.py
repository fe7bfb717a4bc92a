"""The corpus pipeline: each stage's result is written as Parquet and read as the next one's documents.

A stage takes the columns of documents and returns them, all but the last one. Its result reads
intermediates in the shared folder, so it's to be written before the next stage is called: that
frees what earlier results read. Null and empty texts, null and repeated ids, repeated rows,
empty tables and further columns (which are left out) are as each stage says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import langid, line_spread, minhash, packing, suffix_dedup
from lodestar.llm.common import Scope, bounded_batches, discard, release, scope, table, written
from lodestar.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_earlier = Scope()
#: Bytes of one Arrow batch here: executors run all stages in turn, and keep the heap that the largest one took.
STAGE_BATCH_BYTES = 2 << 20


def _stage(run: Stage) -> Stage:
    @wraps(run)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_earlier, bounded_batches(docs, STAGE_BATCH_BYTES))
        with scope() as held:
            out = run(spark, docs, sf_dir)
            held.keep_rest()
        _earlier.kept |= held.kept
        return out

    return call


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in no known language go; declared language and source are evidence.

    A document without letters (null or empty, too) is in no language and goes. Repeated rows and
    ids are judged row by row. Without any labelled text no language is known, and all go.
    """
    model = langid.fit(docs, "text", "lang")
    host = F.col("source")
    judged = langid.identify(docs, model, COLUMNS, F.col("text"), F.col("lang"), host, prefix="found_")
    return judged.where("found_accepted").select(COLUMNS)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sites go but for their first occurrence; so do documents that lose all their text by that.

    Null and empty texts have no lines and stay. Null sources are no site. Equal rows lose the same lines.
    """
    cut = line_spread.drop_boilerplate(docs)
    return _documents(cut.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the smallest id, then text hash.

    Documents without words and those without an id are in no group and stay. Rows that repeat an
    id with another text are documents of their own; of rows that repeat both, the first by
    language and source stays.
    """
    judged = minhash.near_duplicates(docs).select("doc_id", "text_hash", "group")
    least = judged.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("least")).select("least.*")
    alone = judged.where("group is null and doc_id is not null").select("doc_id", "text_hash").distinct()
    kept = written(least.unionByName(alone), "kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"))
    named = docs.join(kept, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_th")))
    order = Window.partitionBy("_id", "_th").orderBy("lang", "source")
    named = named.withColumn("_first", F.row_number().over(order)).where("_first = 1")
    return _documents(named.select(docs.columns).unionByName(docs.where("doc_id is null")))


@_stage
def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes go from the texts; so do documents that lose all their text by that.

    Null and shorter texts stay as they are. Equal rows repeat each other.
    """
    cut = suffix_dedup.remove_repeats(docs, keep=["lang", "source"])
    return _documents(cut.withColumnRenamed("kept_text", "text").where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)))


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 2048 tokens. Null and empty texts are one end id; repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup_stage), ("best_fit_packing", best_fit_packing)]

#: Text likelihoods, densified minima and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on what the one before has written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        now = written(stage(spark, docs, sf_dir), name)
        discard(last)
        docs = last = now
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(last)
    _earlier.kept.clear()  # the result reads these, and may be evaluated after another run's stages
    return out

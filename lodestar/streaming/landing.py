"""A landing directory of source files as a stream of facts: stateless parse, append-only relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import Corpus
from ..sources.scan import facts


def read_landing(spark: SparkSession, path: str, crate: str, max_files: int = 1_000) -> DataFrame:
    """The stream of facts rows, one a file that arrives below path, at most max_files a batch.

    A file that isn't UTF-8 or doesn't parse gives a row with its error and doesn't stop the stream.
    """
    files = (
        spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary")
        .format("binaryFile")
        .option("pathGlobFilter", "*.rs")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )
    rows = files.select("path", F.col("modificationTime").alias("modified"), F.xxhash64("path").alias("file_ord"), F.col("content").alias("source"))
    return facts(rows, crate)


def on_each_batch(stream: DataFrame, crate: str, checkpoint: str, act: Callable[[Corpus, int], None], once: bool = False) -> StreamingQuery:
    """Calls act(corpus of the batch, batch id), for findings or diffs as files arrive."""

    def run(batch: DataFrame, batch_id: int) -> None:
        corpus = Corpus(batch, crate, [], [], span_locations=True, reference_quirks=False).persist()
        try:
            act(corpus, batch_id)
        finally:
            corpus.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Interval containment: which function encloses a position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines in a bucket: with it the join's key is (file, bucket), so one long file is many keys.
BUCKET_LINES = 512


def _pairs(locations: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """containing(), with the location's _bucket."""
    bucket = lambda c: F.floor(F.col(c) / BUCKET_LINES)
    spread = spans.where("start_line is not null and end_line is not null").withColumn("_bucket", F.explode(F.sequence(bucket("start_line"), bucket("end_line"))))
    spread = spread.withColumnsRenamed({c: f"span_{c}" for c in ("ord", "file_ord")})
    at = locations.withColumn("_bucket", bucket("line"))
    inside = (F.struct("line", "column") >= F.struct("start_line", "start_col")) & (F.struct("line", "column") <= F.struct("end_line", "end_col"))
    joined = at.alias("l").join(spread.alias("s"), (F.col("l.path") == F.col("s.file")) & (F.col("l._bucket") == F.col("s._bucket")) & inside, how)
    return joined.drop(F.col("s._bucket"))


def containing(locations: DataFrame, spans: DataFrame) -> DataFrame:
    """Every (location, span) with equal file and the position inside, both ends included.

    locations: path, line, column and any others; null positions match nothing. A span goes to each
    bucket of lines it covers and a location to one, so the equi-join compares neighbours only.
    """
    return _pairs(locations, spans, "inner").drop("_bucket")


def enclosing(locations: DataFrame, spans: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Each location with the innermost function around it, or nulls.

    Innermost: the fewest lines, then the first to start, then the first in the file. key isn't needed any more:
    every row is told apart by itself, so it isn't joined again.
    """
    spans = spans.select("file", "fq_name", "is_public", "start_line", "start_col", "end_line", "end_col", "ord")
    found = _pairs(locations.withColumn("_row", F.monotonically_increasing_id()), spans, "left")
    # with the join's key first, rows stay where the join has put them
    order = Window.partitionBy("path", "_bucket", "_row").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "span_ord")
    best = found.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.select(*locations.columns, F.col("fq_name").alias("enclosing_fq"), F.col("is_public").alias("enclosing_is_public"), "start_line", "end_line")

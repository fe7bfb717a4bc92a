"""Line dedup by distinct-site spread. [built-in DataFrame functions only]

A HyperLogLog sketch of the sites of each line hash is merged by aggregation, whose map side
combines, so a line that a third of all documents hold is one row per task in the shuffle. The sketch settles lines far above
the threshold, the number of occurrences those that can't reach it; all others get an exact distinct count, as a sketch doesn't
count an empty name and counts two names with one coupon once. Lines on at least `min_sites` sites are
boilerplate: every occurrence goes but the first (smallest document id, nulls last, then position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scope, written

MIN_SITES = 5
LG_K = 12
#: Relative standard error of a sketch with 2^12 registers, and the margin in those errors.
ERROR, MARGIN = 1.04 / 2 ** (LG_K / 2), 10
#: All of Unicode's space separators, which DuckDB's trim takes off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _has_text(line: Column) -> Column:
    return F.length(F.ltrim(line, F.lit(SPACES))) > 0


def _trimmed(line: Column) -> Column:
    """Spark's trim of other signs than blanks on the right makes two arrays as long as the line, so it's called only where there are any."""
    left = F.ltrim(line, F.lit(SPACES))
    return F.when(_has_text(F.substring(line, -1, 1)), left).otherwise(F.rtrim(left, F.lit(SPACES)))


def line_count(text: str) -> Column:
    """The lines of a text that aren't blank; 0 of a null text."""
    counted = F.size(F.filter(F.split(text, "\n"), _has_text))
    return F.when(F.col(text).isNull(), 0).otherwise(counted).cast("long")


def _place() -> Column:
    return F.struct(F.col("d").isNull().alias("none"), "d", "pos")


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    cut = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("th"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    line = _trimmed(F.col("raw"))
    return cut.where(_has_text(F.col("raw"))).select("d", "th", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("#"), line).alias("h2"))


def spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first(none, d, pos) of every line on at least min_sites sites. Null sites don't count."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count("site").alias("held"), F.min(_place()).alias("first"))
    likely = written(sketched.where(F.col("held") >= min_sites).select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")), "lines")
    near = likely.where(F.col("sites") <= min_sites + 1 + MARGIN * ERROR * min_sites).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("site").alias("exact"))
    settled = likely.join(exact, ["h1", "h2"], "left")
    return settled.where(F.coalesce("exact", "sites") >= min_sites).select("h1", "h2", "first")


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with boilerplate lines cut from the text, and the columns n_lines and n_removed.

    Lines are compared without the spaces (Unicode's space separators) around them; blank lines
    are neither counted nor removed. n_lines counts the others. Null texts stay null with 0 lines. Rows with a null
    id or site are kept; equal rows get equal decisions. The columns n_lines and n_removed of the
    input, if any, are replaced. An empty table gives an empty result.
    """
    with scope() as held:
        lines = written(_lines(docs, id_col, text_col, site_col), "line-hashes")
        common = written(spread(lines, min_sites), "boilerplate")
        hits = lines.join(common, ["h1", "h2"]).where(~_place().eqNullSafe(F.col("first")))
        removed = written(hits.groupBy(F.col("d").alias("_d"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_out")), "removed")
        held.keep(removed)
    docs = docs.drop("n_lines", "n_removed")
    out = docs.join(removed, docs[id_col].eqNullSafe(F.col("_d")) & (F.xxhash64(text_col) == F.col("_th")), "left")
    parts = F.split(text_col, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_out"))
    text = F.when(F.col("_out").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    return out.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        line_count(text_col).alias("n_lines"),
        F.coalesce(F.size("_out"), F.lit(0)).cast("long").alias("n_removed"),
    )


SQL = """
WITH l AS (
  SELECT d.doc_id, u.i AS pos, d.source, trim(u.raw) AS line
  FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS raw, generate_subscripts(string_split(d.text, chr(10)), 1) AS i) u
), s AS (
  SELECT line, count(DISTINCT source) AS sites, min((doc_id, pos)) AS first FROM l WHERE line <> '' GROUP BY line
), k AS (
  SELECT l.doc_id, l.pos, l.line <> '' AS counted, coalesce(s.sites >= 5 AND (l.doc_id, l.pos) <> s.first, FALSE) AS gone
  FROM l LEFT JOIN s ON l.line = s.line
)
SELECT doc_id, CAST(count(*) FILTER (WHERE counted) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed
FROM k GROUP BY doc_id
"""

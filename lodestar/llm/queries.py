"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, html_text, ivfpq, langid, line_spread, minhash, packing, rabitq, suffix_dedup, token_files
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: its text without markup, its declared language, its host and address suffix."""
    model = langid.fit(table(spark, sf_dir, "documents"), "text", "lang")
    pages = table(spark, sf_dir, "pages")
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    host = url_host(F.col("url"))
    return langid.identify(pages, model, ["page_id", "url"], plain, declared, host, F.regexp_extract(host, r"\.([a-z]+)$", 1), references=True)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; null text is empty."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200).drop("kept", "kept_text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op4_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found to every vector whose id is divisible by 100: query_id, rank, vec_id, score."""
    return ivfpq.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_shingles, component_id, kept."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "group")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector: vec_id, n_links, component_id, kept."""
    return rabitq.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_lines, n_removed, the lines that the text left by the operator lacks."""
    cut = line_spread.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", (F.col("n_lines") - line_spread.line_count("text")).alias("n_removed"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: page_id, url, text, n_chars."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_automaton.bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the pipeline's stages leave of documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_suffix_dedup, op3_best_fit_packing, op4_ivfpq_search, op5_minhash_near_dedup, op6_token_files,
        op7_embedding_near_dedup, op8_line_spread, op9_html_main_text, op10_bpe_automaton, pipeline,
    )
}
SQL: dict[str, str] = {"op8_line_spread": line_spread.SQL}

"""Source corpora rendered from tables, so that SQL on the same tables gives every expected fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.corpus import Corpus

CRATE = "k"
DEPENDENCIES = ["serde-json"]
_EPOCH = "timestamp_seconds(0)"


#: Files a task of the parse stage.
TASK_FILES = 16_384


def spread(rows: DataFrame, key: str, files: int) -> DataFrame:
    """Rows by the hash of their key, in as many partitions as the parse of that many files needs: a small
    table is one partition of its reader, whatever the parse of its files takes."""
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, files // 1_000)
    return rows.repartition(max(tasks, -(-files // TASK_FILES), 1), key)


def _files(rows: DataFrame, key: str, path: str, source: str) -> DataFrame:
    return rows.select(F.expr(path).alias("path"), F.expr(_EPOCH).alias("modified"), F.col(key).cast("long").alias("file_ord"), F.expr(source).alias("source"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    rows = _table(spark, sf_dir, name)
    return spread(rows, key, rows.count())


def functions_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One function a part."""
    source = """concat(
        if(p_size % 3 = 0, '/// d\\n', ''), if(p_brand = 'Brand#1', '#[inline]\\n', ''), if(p_size % 2 = 0, 'pub ', ''),
        case when p_partkey % 16 = 3 then 'const ' when p_partkey % 4 = 1 then 'async ' else '' end, if(p_partkey % 8 = 2, 'unsafe ', ''),
        'fn part_', p_partkey, if(p_partkey % 5 = 0, '<T>', ''), '(x: &str, n: u8) -> Result<', p_type, ', E> { k(n) }\\n')"""
    return _files(_spread(spark, sf_dir, "part", "p_partkey"), "p_partkey", "concat('src/p', p_partkey, '.rs')", source)


def methods_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impl blocks and traits, one file a supplier."""
    source = """concat('impl S', s_nationkey, ' { pub fn m(&self) {} }\\n',
        if(s_suppkey % 2 = 0, concat('impl fmt::Display for S', s_nationkey, ' { fn fmt(&self) {} }\\n'), ''),
        if(s_suppkey % 3 = 0, concat('trait Tr', s_nationkey, ' { fn t(&self); }\\n'), ''))"""
    return _files(_spread(spark, sf_dir, "supplier", "s_suppkey"), "s_suppkey", "concat('src/s', s_suppkey, '.rs')", source)


def imports_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One import a customer, one file a nation."""
    root = "case c_mktsegment when 'BUILDING' then 'std' when 'AUTOMOBILE' then 'core' when 'MACHINERY' then 'serde_json' when 'HOUSEHOLD' then 'crate' else 'mystery' end"
    line = f"""concat(if(c_custkey % 2 = 0, 'pub ', ''), 'use ', if(c_custkey % 7 = 0 and c_mktsegment <> 'HOUSEHOLD', '::', ''), {root}, '::m', c_custkey % 10,
        case c_custkey % 3 when 0 then ';' when 1 then '::*;' else concat(' as z', c_custkey % 2, ';') end)"""
    rows = _spread(spark, sf_dir, "customer", "c_nationkey").selectExpr("c_nationkey", "c_custkey", f"{line} AS line")
    lines = rows.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "line"))).alias("lines"))
    return _files(lines, "c_nationkey", "concat('src/n', c_nationkey, '.rs')", "array_join(transform(lines, x -> x.line), '\\n')")


def orders_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One function an order, one statement a line item in the order of all columns."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    items = spread(_table(spark, sf_dir, "lineitem"), "l_orderkey", orders.count())
    line = """case l_returnflag when 'A' then if(l_linestatus = 'F', '  q.unwrap();', '  q.expect("x");') when 'N' then '  let _ = panic!("x");' else '  std::fs::read(x);' end"""
    of = Window.partitionBy("l_orderkey").orderBy(*(c for c in items.columns if c != "l_orderkey"))  # sorts rows as bytes; a list of structs would be sorted as objects
    rows = items.select("l_orderkey", F.row_number().over(of).alias("n"), F.collect_list(F.expr(line)).over(of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lines"))
    lines = rows.where("n = 1").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    source = """concat('macro_rules! m', o_orderkey, ' { () => {} }\\n', if(o_orderstatus = 'F', 'pub ', ''), 'fn order_', o_orderkey, '() {\\n',
        array_join(lines, '\\n'), '\\n}\\n')"""
    return _files(lines, "o_orderkey", "concat('src/o', o_orderkey, '.rs')", source)


def old_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(_spread(spark, sf_dir, "part", "p_partkey").where("p_partkey % 7 <> 0"), "p_partkey", "concat('src/p', p_partkey, '.rs')", "concat('pub fn part_', p_partkey, '(n: u8) {}\\npub use ext::e', p_partkey, ';\\n')")


def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = "concat('pub fn part_', p_partkey, '(n: ', if(p_size > 25, 'u16', 'u8'), ') {}\\npub use ext::e', p_partkey, ';\\n')"
    return _files(_spread(spark, sf_dir, "part", "p_partkey").where("p_partkey % 5 <> 0"), "p_partkey", "concat('src/p', p_partkey, '.rs')", source)


def nation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(_table(spark, sf_dir, "nation"), "n_nationkey", "concat('src/n', n_nationkey, '.rs')", "concat(if(n_nationkey = 0, '#![no_std]\\n', ''), 'use std::io;\\n')")


def macro_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro calls with and without a path, one file a supplier; every tenth file is broken."""
    source = """concat('pub fn f_', s_suppkey, '() {', if(s_suppkey % 2 = 0, ' std::println!("x");', ' println!("x");'), if(s_suppkey % 3 = 0, ' serde_json::json!({});', ''),
        if(s_suppkey % 5 = 0, ' crate::mine!();', ''), if(s_suppkey % 10 = 7, '', ' }'), '\n')"""
    return _files(_spread(spark, sf_dir, "supplier", "s_suppkey"), "s_suppkey", "concat('src/generated/macros/supplier_', s_suppkey, '.rs')", source)


def both_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old parts, then the new ones: most names occur twice."""
    return old_files(spark, sf_dir).unionByName(new_files(spark, sf_dir).withColumn("file_ord", F.col("file_ord") + F.lit(1 << 40)))


def generated_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing in which three of four files look generated."""
    path = "concat(case n_nationkey % 4 when 0 then 'target/n' when 1 then 'src/my_bindings' when 2 then 'src/a_pb_' else 'src/n' end, n_nationkey, '.rs') AS path"
    return _table(spark, sf_dir, "nation").selectExpr(path, "timestamp_seconds(0) AS modified", "100L AS length", "CAST(n_nationkey AS BIGINT) AS discovery_ord")


def nation_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing, as SourceScan.listing() returns it."""
    return _table(spark, sf_dir, "nation").selectExpr("concat('src/n', n_nationkey, '.rs') AS path", "timestamp_seconds(n_nationkey % 5) AS modified", "100L * n_regionkey AS length", "CAST(n_nationkey AS BIGINT) AS discovery_ord")


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, then orders, then nations, in one corpus."""
    shift = lambda df, i: df.withColumn("file_ord", F.col("file_ord") + F.lit(i << 40))
    return functions_files(spark, sf_dir).unionByName(shift(orders_files(spark, sf_dir), 1)).unionByName(shift(nation_files(spark, sf_dir), 2))


FILES = {"parts": functions_files, "suppliers": methods_files, "customers": imports_files, "orders": orders_files, "old": old_files, "new": new_files, "nations": nation_files, "macros": macro_files, "both": both_files, "all": all_files}
_kept: dict[tuple, Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str, name: str, span_locations: bool = False, relations: list[str] | None = None) -> Corpus:
    """A corpus with the relations (all of them, if not given), parsed once a session; one relation alone is read once, so it
    isn't kept: a copy of its facts would be written for each query, and stay."""
    key = (spark.sparkContext.applicationId, sf_dir, name, span_locations)
    if key in _kept:  # with all relations
        return _kept[key]
    if relations is not None:
        key = (*key, *sorted(relations), "only")
    if key not in _kept:
        files = FILES[name](spark, sf_dir)
        made = Corpus.from_sources(files, CRATE, [], DEPENDENCIES, span_locations=span_locations, relations=relations)
        if relations is None or len(set(relations)) > 1:
            made.persist(flat=relations is None)  # what one query reads is flattened for it
        _kept[key] = made
    return _kept[key]

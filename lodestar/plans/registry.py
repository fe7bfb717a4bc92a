"""The registered queries and the SQL that gives the same rows from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import containment, imports, reports, use_sites
from ..operators.snapshot import Snapshot
from ..sources.globs import GENERATED
from ..sources.scan import choose
from .synth import DEPENDENCIES, corpus, generated_listing, nation_listing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name, and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- functions

_SIGNATURE = """concat(CASE WHEN p_partkey % 16 = 3 THEN 'const ' WHEN p_partkey % 4 = 1 THEN 'async ' ELSE '' END, CASE WHEN p_partkey % 8 = 2 THEN 'unsafe ' ELSE '' END,
  'fn part_', p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' < T >' ELSE '' END, ' (x : & str , n : u8) -> Result < ', p_type, ' , E >')"""
_FN = "'k::part_' || p_partkey AS fq_name"


def _fn(df: DataFrame) -> DataFrame:
    return df.select("fq_name")


@query(f"""SELECT 'part_' || p_partkey AS name, {_FN}, p_size % 2 = 0 AS is_public, p_size % 3 = 0 AS has_docs, p_partkey % 4 = 1 AND p_partkey % 16 <> 3 AS is_async,
  p_partkey % 8 = 2 AS is_unsafe, p_partkey % 16 = 3 AS is_const, p_partkey % 5 = 0 AS is_generic, 'x : & str|n : u8' AS args, 'Result < ' || p_type || ' , E >' AS return_ty,
  'FreeFn' AS kind, concat_ws(',', CASE WHEN p_size % 3 = 0 THEN 'doc' END, CASE WHEN p_brand = 'Brand#1' THEN 'inline' END) AS attrs, {_SIGNATURE} AS signature,
  'src/p' || p_partkey || '.rs' AS path FROM part""")
def functions_all(spark, sf_dir):
    f = corpus(spark, sf_dir, "parts", relations=["functions"]).functions().df()
    flags = ["is_public", "has_docs", "is_async", "is_unsafe", "is_const", "is_generic"]
    return f.select("name", "fq_name", *flags, F.array_join("args", "|").alias("args"), "return_ty", F.col("kind.kind").alias("kind"), F.array_join("attrs", ",").alias("attrs"), "signature", F.col("location.path").alias("path"))


@query(f"SELECT {_FN}, 'Result < ' || p_type || ' , E >' AS return_ty FROM part WHERE p_size % 2 = 0 AND p_type LIKE '%O%'")
def public_api_returns(spark, sf_dir):
    return corpus(spark, sf_dir, "parts", relations=["functions"]).public_api().returns("O").df().select("fq_name", "return_ty")


@query(f"SELECT {_FN} FROM part WHERE p_size % 2 = 0 AND p_size % 3 <> 0")
def undocumented_public_api(spark, sf_dir):
    return _fn(corpus(spark, sf_dir, "parts", relations=["functions"]).undocumented_public_api().df())


@query(f"SELECT {_FN} FROM part WHERE p_partkey % 4 = 1 AND p_partkey % 5 = 0")
def fn_flags(spark, sf_dir):
    return _fn(corpus(spark, sf_dir, "parts", relations=["functions"]).functions().is_async(True).is_unsafe(False).is_const(False).is_generic(True).df())


@query(f"SELECT {_FN} FROM part WHERE 'part_' || p_partkey LIKE '%\\_1%' ESCAPE '\\'")
def fn_name_contains(spark, sf_dir):
    return _fn(corpus(spark, sf_dir, "parts", relations=["functions"]).functions().named("_9").name_contains("_1").df())


@query(f"SELECT {_FN} FROM part WHERE regexp_matches('part_' || p_partkey, '_[0-9]*7$')")
def fn_name_regex(spark, sf_dir):
    return _fn(corpus(spark, sf_dir, "parts", relations=["functions"]).functions().name_matches(r"_\d*7$").df())


@query(f"SELECT {_FN} FROM part")
def fn_takes_arg(spark, sf_dir):
    return _fn(corpus(spark, sf_dir, "parts", relations=["functions"]).functions().takes_arg("& str").df())


@query(f"SELECT {_FN} FROM part WHERE p_brand = 'Brand#1'")
def fn_has_attr(spark, sf_dir):
    return _fn(corpus(spark, sf_dir, "parts", relations=["functions"]).functions().has_attr("inline").df())


@query(f"SELECT {_FN} FROM part WHERE p_partkey % 8 = 2 AND p_size % 2 = 1")
def fn_filter_column(spark, sf_dir):
    return _fn(corpus(spark, sf_dir, "parts", relations=["functions"]).functions().is_unsafe(True).filter(~F.col("is_public")))


@query("SELECT count(*) FILTER (WHERE p_size % 2 = 0) AS public_total, count(*) FILTER (WHERE p_size % 6 = 0) AS public_documented, count(*) FILTER (WHERE p_size % 6 = 0) * 100.0::DOUBLE / count(*) FILTER (WHERE p_size % 2 = 0) AS percent FROM part")
def doc_coverage(spark, sf_dir):
    return corpus(spark, sf_dir, "parts", relations=["functions"]).doc_coverage()


@query("SELECT 'k::S' || s_nationkey || '::m' AS fq_name, TRUE AS is_public FROM supplier WHERE s_nationkey = 7")
def impl_methods(spark, sf_dir):
    return corpus(spark, sf_dir, "suppliers", relations=["functions"]).functions().in_impl("S7").public_only().df().select("fq_name", "is_public")


@query("SELECT 'k::S' || s_nationkey || '::fmt' AS fq_name, FALSE AS is_public FROM supplier WHERE s_suppkey % 2 = 0")
def impls_trait(spark, sf_dir):
    return corpus(spark, sf_dir, "suppliers", relations=["functions"]).functions().impls_trait("fmt::Display").df().select("fq_name", "is_public")


@query("SELECT 'k::Tr' || s_nationkey || '::t' AS fq_name, TRUE AS is_public FROM supplier WHERE s_suppkey % 3 = 0 AND s_nationkey = 4")
def trait_methods(spark, sf_dir):
    return corpus(spark, sf_dir, "suppliers", relations=["functions"]).functions().in_trait("Tr4").df().select("fq_name", "is_public")


# -- imports

_ROOT = "CASE c_mktsegment WHEN 'BUILDING' THEN 'std' WHEN 'AUTOMOBILE' THEN 'core' WHEN 'MACHINERY' THEN 'serde_json' WHEN 'HOUSEHOLD' THEN 'crate' ELSE 'mystery' END"
_G2 = f"""WITH g AS (SELECT c_nationkey AS file_ord, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord, {_ROOT} AS root, c_custkey % 2 = 0 AS is_public_use,
  c_custkey % 7 = 0 AND c_mktsegment <> 'HOUSEHOLD' AS is_absolute, CASE c_custkey % 3 WHEN 0 THEN 'Name' WHEN 1 THEN 'Glob' ELSE 'Rename' END AS kind,
  CASE WHEN c_custkey % 3 = 2 THEN 'z' || (c_custkey % 2) END AS alias, 'm' || (c_custkey % 10) AS head, c_custkey % 3 = 1 AS is_glob,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Std' WHEN 'AUTOMOBILE' THEN 'Core' WHEN 'MACHINERY' THEN 'Dependency' WHEN 'HOUSEHOLD' THEN 'Internal' ELSE 'UnknownExternal' END AS origin FROM customer),
i AS (SELECT *, concat(CASE WHEN is_absolute THEN '::' ELSE '' END, root, '::', head, CASE WHEN is_glob THEN '::*' ELSE '' END) AS full_path FROM g)
"""
_I = "CAST(file_ord AS BIGINT) AS file_ord, CAST(ord AS BIGINT) AS ord, full_path"


def _imp(df: DataFrame) -> DataFrame:
    return df.select("file_ord", "ord", "full_path")


def _g2(spark, sf_dir):
    return corpus(spark, sf_dir, "customers")


@query(_G2 + f"SELECT {_I}, root, concat_ws('::', head, CASE WHEN is_glob THEN '*' END) AS segments, root = 'crate' AS is_internal, is_public_use, kind, alias, is_absolute, origin FROM i")
def imports_all(spark, sf_dir):
    i = _g2(spark, sf_dir).imports().df()
    return i.select("file_ord", "ord", "full_path", "root", F.array_join("segments", "::").alias("segments"), "is_internal", "is_public_use", "kind.kind", "kind.alias", "is_absolute", "origin")


@query(_G2 + f"SELECT {_I} FROM i WHERE root = 'std'")
def imports_root(spark, sf_dir):
    return _imp(_g2(spark, sf_dir).imports().root("std").df())


@query(_G2 + f"SELECT {_I} FROM i WHERE root = 'crate'")
def imports_internal(spark, sf_dir):
    return _imp(_g2(spark, sf_dir).imports().internal_only().df())


@query(_G2 + f"SELECT {_I} FROM i WHERE is_public_use")
def imports_pub(spark, sf_dir):
    return _imp(_g2(spark, sf_dir).imports().public_use_only().df())


@query(_G2 + f"SELECT {_I} FROM i WHERE full_path LIKE 'std::m1%'")
def imports_prefix(spark, sf_dir):
    return _imp(_g2(spark, sf_dir).imports().full_path_starts_with("std::m1").df())


@query(_G2 + f"SELECT {_I}, origin FROM i WHERE origin IN ('Std', 'Core', 'Alloc')")
def imports_stdish(spark, sf_dir):
    return _g2(spark, sf_dir).imports().stdish_only().df().select("file_ord", "ord", "full_path", "origin")


@query(_G2 + f"SELECT {_I}, origin FROM i WHERE origin = 'Dependency'")
def imports_deps(spark, sf_dir):
    return _g2(spark, sf_dir).imports().deps_only().df().select("file_ord", "ord", "full_path", "origin")


@query(_G2 + f"SELECT {_I} FROM i WHERE origin = 'UnknownExternal' AND kind = 'Glob'")
def imports_filter_column(spark, sf_dir):
    return _imp(_g2(spark, sf_dir).imports().origin("UnknownExternal").filter(F.col("kind.kind") == "Glob"))


@query(_G2 + """SELECT origin, count(*) AS n, string_agg(full_path, ',' ORDER BY file_ord, ord) AS full_paths,
  CAST(list_position(['Internal', 'Std', 'Core', 'Alloc', 'WorkspaceMember', 'Dependency', 'UnknownExternal'], origin) AS BIGINT) AS origin_rank FROM i GROUP BY origin""")
def imports_by_origin(spark, sf_dir):
    return imports.group_by_origin(_g2(spark, sf_dir).imports_df).select("origin", "n", F.array_join("full_paths", ",").alias("full_paths"), "origin_rank")


@query(_G2 + "SELECT root, count(*) AS n, string_agg(full_path, ',' ORDER BY file_ord, ord) AS full_paths FROM i GROUP BY root")
def imports_by_root(spark, sf_dir):
    return imports.group_by_root(_g2(spark, sf_dir).imports_df).select("root", "n", F.array_join("full_paths", ",").alias("full_paths"))


@query(_G2 + """SELECT 'by_origin' AS section, origin AS key, count(*) AS n FROM i GROUP BY origin UNION ALL SELECT 'by_root', root, count(*) FROM i GROUP BY root
  UNION ALL SELECT 'total', NULL, count(*) FROM i UNION ALL SELECT 'pub_use', NULL, count(*) FILTER (WHERE is_public_use) FROM i UNION ALL SELECT 'glob', NULL, count(*) FILTER (WHERE kind = 'Glob') FROM i
  UNION ALL SELECT 'rename', NULL, count(*) FILTER (WHERE kind = 'Rename') FROM i UNION ALL SELECT 'absolute', NULL, count(*) FILTER (WHERE is_absolute) FROM i""")
def import_summary(spark, sf_dir):
    return imports.summary_counts(_g2(spark, sf_dir).imports_df)


@query(_G2 + f"SELECT {_I}, is_public_use FROM (SELECT *, row_number() OVER (PARTITION BY full_path, kind, alias, is_absolute, is_public_use ORDER BY file_ord, ord) AS rn FROM i) WHERE rn = 1")
def imports_unique(spark, sf_dir):
    return imports.unique(_g2(spark, sf_dir).imports_df).select("file_ord", "ord", "full_path", "is_public_use")


@query(_G2 + f"""SELECT {_I}, is_public_use, CAST(first.file_ord AS BIGINT) AS first_file_ord, CAST(first.ord AS BIGINT) AS first_ord FROM (
  SELECT *, row_number() OVER (PARTITION BY full_path, kind, alias, is_absolute ORDER BY is_public_use DESC, file_ord, ord) AS rn,
  min({{'file_ord': file_ord, 'ord': ord}}) OVER (PARTITION BY full_path, kind, alias, is_absolute) AS first FROM i) WHERE rn = 1""")
def imports_unique_prefer_pub(spark, sf_dir):
    return imports.unique_prefer_pub_use(_g2(spark, sf_dir).imports_df).select("file_ord", "ord", "full_path", "is_public_use", "first_file_ord", "first_ord")


@query(_G2 + "SELECT CASE WHEN kind = 'Glob' THEN '*' WHEN kind = 'Rename' THEN alias ELSE head END AS exported_as, ltrim(full_path, ':') AS source_path FROM i WHERE is_public_use")
def exports_surface(spark, sf_dir):
    return _g2(spark, sf_dir).public_surface().select("exported_as", "source_path")


@query(_G2 + f"SELECT {_I.replace('full_path', '')} ltrim(full_path, ':') AS full_path, root, root = 'crate' AS is_internal FROM i")
def imports_v1(spark, sf_dir):
    return _g2(spark, sf_dir).imports_v1().select("file_ord", "ord", "full_path", "root", "is_internal")


@query(_G2 + "SELECT DISTINCT full_path FROM i")
def snapshot_imports(spark, sf_dir):
    return _g2(spark, sf_dir).snapshot().imports


@query(_G2 + "SELECT DISTINCT root, kind FROM i WHERE NOT is_public_use")
def sql_views(spark, sf_dir):
    """Plain SQL over the relations' views."""
    _g2(spark, sf_dir).create_views("g2_")
    return spark.sql("SELECT DISTINCT root, kind.kind AS kind FROM g2_imports WHERE NOT is_public_use")


# -- occurrences

_G3 = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT 'src/o' || l_orderkey || '.rs' AS path, 'k::order_' || l_orderkey AS fn, o_orderstatus = 'F' AS pub, l_returnflag AS flag, l_orderkey AS file_ord, rn,
  CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'unwrap' ELSE 'expect' END WHEN 'R' THEN 'std :: fs :: read' END AS callee FROM l)
"""
_CALL = "path, fn AS enclosing_fn, pub AS enclosing_public, callee"


def _g3(spark, sf_dir, *relations: str):
    return corpus(spark, sf_dir, "orders", relations=list(relations))


def _calls(df: DataFrame) -> DataFrame:
    return df.select(F.col("location.path").alias("path"), "enclosing_fn", "enclosing_public", "callee")


@query(_G3 + f"SELECT {_CALL} FROM x WHERE callee = 'unwrap'")
def calls_unwrap(spark, sf_dir):
    return _calls(_g3(spark, sf_dir, "calls").finder().unwrap_calls())


@query(_G3 + f"SELECT {_CALL} FROM x WHERE callee = 'expect'")
def calls_expect(spark, sf_dir):
    return _calls(_g3(spark, sf_dir, "calls").finder().expect_calls())


@query(_G3 + f"SELECT {_CALL} FROM x WHERE callee LIKE '%fs :: read%'")
def calls_contains(spark, sf_dir):
    return _calls(_g3(spark, sf_dir, "calls").finder().calls_containing("fs :: read"))


@query(_G3 + "SELECT 'std::fs::read' AS occurrence, fn AS enclosing_fn, pub AS enclosing_public FROM x WHERE flag = 'R'")
def paths_eq(spark, sf_dir):
    return _g3(spark, sf_dir, "paths").finder().paths_eq("std::fs::read").select(F.col("path").alias("occurrence"), "enclosing_fn", "enclosing_public")


@query(_G3 + "SELECT 'panic' AS name, 'expr' AS position, fn AS enclosing_fn, pub AS enclosing_public FROM x WHERE flag = 'N'")
def macro_invocations(spark, sf_dir):
    return _g3(spark, sf_dir, "macros_inv").finder().macros("panic").select("name", "position", "enclosing_fn", "enclosing_public")


@query("SELECT DISTINCT 'm' || o_orderkey AS name, 'src/o' || o_orderkey || '.rs' AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def macro_defs(spark, sf_dir):
    return _g3(spark, sf_dir, "macros_def").macros_def.select("name", F.col("location.path").alias("path"))


@query(_G3 + "SELECT 'std::fs::read' AS occurrence, path FROM x WHERE flag = 'R' UNION ALL SELECT 'q', path FROM x WHERE flag = 'A' UNION ALL SELECT 'x', path FROM x WHERE flag = 'R' UNION ALL SELECT 'panic', path FROM x WHERE flag = 'N' UNION ALL SELECT 'macro_rules', path FROM x WHERE rn = 1")
def paths_v1(spark, sf_dir):
    return _g3(spark, sf_dir, "paths").paths_v1().select(F.col("path").alias("occurrence"), F.col("location.path").alias("path"))


@query(_G3 + "SELECT path, CAST(2 + rn AS BIGINT) AS line, CAST(2 AS BIGINT) AS col, callee, fn AS enclosing_fq, pub AS enclosing_is_public FROM x WHERE callee IS NOT NULL")
def enclosing_fn(spark, sf_dir):
    k = corpus(spark, sf_dir, "orders", span_locations=True, relations=["calls", "fn_spans"])
    at = k.calls.select(F.col("location.path").alias("path"), F.col("location.line").alias("line"), F.col("location.column").alias("column"), "callee")
    found = containment.enclosing(at, k.fn_spans, key=["path", "line", "column"])
    return found.select("path", "line", F.col("column").alias("col"), "callee", "enclosing_fq", "enclosing_is_public")


@query(_G3 + "SELECT fn AS fq_name, max(pub) AS is_public, CAST(2 AS BIGINT) AS start_line, CAST(0 AS BIGINT) AS start_col, CAST(3 + max(rn) AS BIGINT) AS end_line, CAST(1 AS BIGINT) AS end_col FROM x GROUP BY fn")
def fn_spans(spark, sf_dir):
    return corpus(spark, sf_dir, "orders", span_locations=True, relations=["fn_spans"]).fn_spans.select("fq_name", "is_public", "start_line", "start_col", "end_line", "end_col")


# -- use sites

_SITES_G2 = "SELECT root AS dep, full_path AS path, head, 'UseStmt' AS kind, 'file' AS scope FROM i"


def _sites(df: DataFrame) -> DataFrame:
    return df.select("dep", "path", "head", "kind", "scope")


def _two(spark, sf_dir) -> DataFrame:
    deps, read = ["std", "serde-json"], ["imports", "paths", "macros_inv"]
    return corpus(spark, sf_dir, "customers", relations=read).dep_use_sites(deps).unionByName(_g3(spark, sf_dir, *read).dep_use_sites(deps))


_TWO = _G2 + ", " + _G3.replace("WITH ", "", 1) + f", s AS ({_SITES_G2} WHERE root IN ('std', 'serde_json') UNION ALL SELECT 'std', 'std::fs::read', 'fs', 'Path', fn FROM x WHERE flag = 'R')\n"


@query(_TWO + "SELECT * FROM s")
def dep_use_sites(spark, sf_dir):
    return _sites(_two(spark, sf_dir))


@query(_TWO + "SELECT dep, path, count(*) AS n FROM s GROUP BY dep, path")
def use_site_counts(spark, sf_dir):
    return use_sites.counts(_two(spark, sf_dir))


@query(_G2 + _SITES_G2 + " WHERE root = 'crate'")
def internal_use_sites(spark, sf_dir):
    return _sites(_g2(spark, sf_dir).internal_use_sites())


# -- rules and reports

_API001 = f"""SELECT 'Warn' AS severity, 'API001' AS code, 'public function missing docs: k::part_' || p_partkey AS message, 'src/p' || p_partkey || '.rs' AS path,
  '{{"signature":"' || {_SIGNATURE} || '"}}' AS extra FROM part WHERE p_size % 2 = 0 AND p_size % 3 <> 0"""
_API001_ORDERS = """SELECT 'Warn' AS severity, 'API001' AS code, 'public function missing docs: ' || fn AS message, path, '{"signature":"fn ' || fn[4:] || ' ()"}' AS extra FROM x WHERE pub AND rn = 1"""
_API002 = """SELECT 'Warn' AS severity, 'API002' AS code, 'panic-ish call inside public fn ' || fn || ': ' || callee AS message, path, '{"callee":"' || callee || '","enclosing_fn":"' || fn || '"}' AS extra
  FROM x WHERE pub AND callee IN ('unwrap', 'expect')"""
_API003 = """SELECT 'Warn' AS severity, 'API003' AS code, 'macro panic! inside public fn ' || fn AS message, path, '{"enclosing_fn":"' || fn || '","macro":"panic"}' AS extra FROM x WHERE pub AND flag = 'N'"""
_API004 = """SELECT 'Deny' AS severity, 'API004' AS code, 'std import in no_std crate: std::io' AS message, 'src/n' || n_nationkey || '.rs' AS path, '{"import":"std::io"}' AS extra FROM nation
  UNION ALL SELECT 'Deny', 'API004', 'std path in no_std crate: std::fs::read', path, '{"module":"","path":"std::fs::read"}' FROM x WHERE flag = 'R'"""


def _findings(df: DataFrame) -> DataFrame:
    return df.select("severity", "code", "message", F.col("location.path").alias("path"), "extra")


def _all(spark, sf_dir, *relations: str):
    return corpus(spark, sf_dir, "all", relations=list(relations))


def _default(spark, sf_dir) -> DataFrame:
    return _all(spark, sf_dir, "functions", "imports", "macros_inv", "paths", "calls").rules().with_default_rules().run()


@query(_G3 + " UNION ALL ".join([_API001, _API001_ORDERS, _API002, _API003, _API004]))
def findings_default(spark, sf_dir):
    return _findings(_default(spark, sf_dir))


@query(_G3 + f"{_API001} UNION ALL {_API001_ORDERS}")
def findings_api001(spark, sf_dir):
    from ..operators.rules import UndocumentedPublicApi

    return _findings(_all(spark, sf_dir, "functions").rules().add_rule(UndocumentedPublicApi()).run())


@query(_G3 + _API002)
def findings_api002(spark, sf_dir):
    from ..operators.rules import UnwrapInPublicApi

    return _findings(_all(spark, sf_dir, "calls").rules().add_rule(UnwrapInPublicApi()).run())


@query(_G3 + _API003)
def findings_api003(spark, sf_dir):
    from ..operators.rules import PanicMacrosInPublicApi

    return _findings(_all(spark, sf_dir, "macros_inv").rules().add_rule(PanicMacrosInPublicApi()).run())


@query(_G3 + _API004)
def findings_api004(spark, sf_dir):
    from ..operators.rules import StdInNoStdCrate

    return _findings(_all(spark, sf_dir, "imports", "paths").rules().add_rule(StdInNoStdCrate()).run())


@query("SELECT TRUE AS no_std FROM nation LIMIT 1")
def corpus_no_std(spark, sf_dir):
    return corpus(spark, sf_dir, "nations").no_std()


@query(_G3 + f"SELECT printf('%-4s %-7s %-31s  %s', severity, code, path || ':0:0', message) AS line FROM ({_API002} UNION ALL {_API003})")
def report_table(spark, sf_dir):
    return reports.lines(_default(spark, sf_dir).where("code in ('API002', 'API003')"), reports.table_line()).select("line")


@query(_G3 + f"SELECT concat('- **', severity, ' ', code, '**: ', message, ' (`', path, '`:0:0)') AS line FROM ({_API002} UNION ALL {_API003})")
def report_markdown(spark, sf_dir):
    return reports.lines(_default(spark, sf_dir).where("code in ('API002', 'API003')"), reports.markdown_line()).select("line")


# -- snapshots

_G4 = """WITH o AS (SELECT p_partkey AS k, 'fn part_' || p_partkey || ' (n : u8)' AS sig FROM part WHERE p_partkey % 7 <> 0),
n AS (SELECT p_partkey AS k, 'fn part_' || p_partkey || ' (n : ' || CASE WHEN p_size > 25 THEN 'u16' ELSE 'u8' END || ')' AS sig FROM part WHERE p_partkey % 5 <> 0),
j AS (SELECT coalesce(n.k, o.k) AS k, o.sig AS old, n.sig AS new FROM n FULL JOIN o ON n.k = o.k)
"""


def _compared(spark, sf_dir, name: str):
    return corpus(spark, sf_dir, name, relations=["functions", "exports", "imports"])


def _diff(spark, sf_dir, entity: str) -> DataFrame:
    old: Snapshot = _compared(spark, sf_dir, "old").snapshot()
    return _compared(spark, sf_dir, "new").diff_snapshot(old).where(F.col("entity") == entity).drop("entity")


@query(_G4 + "SELECT CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change, 'k::part_' || k AS key, old, new FROM j WHERE old IS DISTINCT FROM new")
def diff_functions(spark, sf_dir):
    return _diff(spark, sf_dir, "function")


_E = "'ext::e' || k"


@query(_G4 + f"SELECT CASE WHEN old IS NULL THEN 'added' ELSE 'removed' END AS change, 'e' || k AS key, CASE WHEN new IS NULL THEN {_E} END AS old, CASE WHEN old IS NULL THEN {_E} END AS new FROM j WHERE old IS NULL OR new IS NULL")
def diff_exports(spark, sf_dir):
    return _diff(spark, sf_dir, "export")


@query(_G4 + f"SELECT CASE WHEN old IS NULL THEN 'added' ELSE 'removed' END AS change, {_E} AS key, CASE WHEN new IS NULL THEN {_E} END AS old, CASE WHEN old IS NULL THEN {_E} END AS new FROM j WHERE old IS NULL OR new IS NULL")
def diff_imports(spark, sf_dir):
    return _diff(spark, sf_dir, "import")


@query("SELECT 'k::part_' || p_partkey AS fq_name, 'fn part_' || p_partkey || ' (n : u8)' AS signature FROM part WHERE p_partkey % 7 <> 0")
def snapshot_functions(spark, sf_dir):
    return _compared(spark, sf_dir, "old").snapshot().functions.select("fq_name", "signature")


# -- listings

_G5 = "WITH f AS (SELECT 'src/n' || n_nationkey || '.rs' AS path, n_nationkey % 5 AS t, CAST(100 * n_regionkey AS BIGINT) AS length, n_nationkey AS k FROM nation) "


@query(_G5 + "SELECT path, length FROM (SELECT * FROM f ORDER BY t DESC, k DESC LIMIT 7)")
def scan_newest(spark, sf_dir):
    return choose(nation_listing(spark, sf_dir), ["**/*.rs"], newest=7).select("path", "length")


@query(_G5 + "SELECT path, length FROM f WHERE path LIKE 'src/n1%' AND NOT regexp_matches(path, '(^|/)n.[.]rs$')")
def scan_globs(spark, sf_dir):
    return choose(nation_listing(spark, sf_dir), ["src/n1*.rs"], ["**/n?.rs"]).select("path", "length")


@query(_G5 + "SELECT path, length FROM (SELECT * FROM f ORDER BY t DESC, k DESC LIMIT 10) WHERE length <= 200")
def scan_max_size(spark, sf_dir):
    return choose(nation_listing(spark, sf_dir), ["**/*.rs"], newest=10, max_size=200).select("path", "length")


@query(_G5 + "SELECT path, length FROM (SELECT * FROM f ORDER BY t DESC, k DESC LIMIT 20) WHERE length <= 200")
def scan_newest_small(spark, sf_dir):
    return choose(nation_listing(spark, sf_dir), ["**/*.rs"], newest=20, max_size=200).select("path", "length")


@query("SELECT 'src/n' || n_nationkey || '.rs' AS path FROM nation WHERE n_nationkey % 4 = 3")
def scan_generated(spark, sf_dir):
    return choose(generated_listing(spark, sf_dir), ["**/*.rs"], GENERATED).select("path")


@query("SELECT 'src/generated/macros/supplier_' || s_suppkey || '.rs' AS path, 'parse' AS kind FROM supplier WHERE s_suppkey % 10 = 7")
def scan_errors(spark, sf_dir):
    """The files that a permissive scan leaves out."""
    return corpus(spark, sf_dir, "macros").errors.select("path", "kind")


# -- cases that the corpora above lack

_G6 = "WITH f AS (SELECT s_suppkey AS k, 'k::f_' || s_suppkey AS scope, 'src/generated/macros/supplier_' || s_suppkey || '.rs' AS path FROM supplier WHERE s_suppkey % 10 <> 7)\n"


@query("SELECT 'k::part_' || p_partkey AS fq_name FROM part WHERE p_partkey % 5 <> 0 AND p_size > 25")
def fn_takes_some_arg(spark, sf_dir):
    return _fn(corpus(spark, sf_dir, "new", relations=["functions"]).functions().takes_arg("u16").df())


@query("SELECT 'src/n' || n_nationkey || '.rs' AS path, n_nationkey = 0 AS no_std FROM nation")
def no_std_files(spark, sf_dir):
    return corpus(spark, sf_dir, "nations").files.select("path", F.col("is_no_std_crate_root").alias("no_std"))


@query("SELECT FALSE AS no_std FROM part LIMIT 1")
def corpus_with_std(spark, sf_dir):
    return corpus(spark, sf_dir, "parts", relations=[]).no_std()


@query(_G6 + """SELECT 'std' AS dep, 'std::println' AS path, 'println' AS head, u.kind AS kind, scope FROM f, (VALUES ('Path'), ('MacroCall')) u(kind) WHERE k % 2 = 0
  UNION ALL SELECT 'serde_json', 'serde_json::json', 'json', u.kind, scope FROM f, (VALUES ('Path'), ('MacroCall')) u(kind) WHERE k % 3 = 0""")
def dep_macro_sites(spark, sf_dir):
    return _sites(corpus(spark, sf_dir, "macros").dep_use_sites(["std", "serde-json"]))


@query(_G6 + "SELECT 'crate' AS dep, 'crate::mine' AS path, 'mine' AS head, u.kind AS kind, scope FROM f, (VALUES ('Path'), ('MacroCall')) u(kind) WHERE k % 5 = 0")
def internal_macro_sites(spark, sf_dir):
    return _sites(corpus(spark, sf_dir, "macros").internal_use_sites())


@query(_G2 + f"SELECT {_I}, CASE WHEN root = 'mystery' THEN 'WorkspaceMember' ELSE origin END AS origin FROM i")
def imports_members(spark, sf_dir):
    return imports.classify(_g2(spark, sf_dir).imports_df, ["mystery"], DEPENDENCIES).select("file_ord", "ord", "full_path", "origin")


@query(_G4 + "SELECT CASE WHEN old IS NULL THEN 'added' ELSE 'changed' END AS change, 'k::part_' || k AS key, old, new FROM j WHERE new IS NOT NULL AND old IS DISTINCT FROM new")
def diff_last_wins(spark, sf_dir):
    """Names that occur twice count by their last function; so nothing is removed."""
    old: Snapshot = _compared(spark, sf_dir, "old").snapshot()
    return _compared(spark, sf_dir, "both").diff_snapshot(old).where("entity = 'function'").drop("entity")


@query(_G4 + "SELECT 'removed' AS change, 'e' || k AS key, 'ext::e' || k AS old, CAST(NULL AS VARCHAR) AS new FROM j, (VALUES (1), (2)) u(x) WHERE new IS NULL")
def diff_repeated_exports(spark, sf_dir):
    """Exports keep their repeats: each old one that is gone counts."""
    once: Snapshot = _compared(spark, sf_dir, "old").snapshot()
    twice = Snapshot(once.crate, once.no_std, once.functions, once.exports.unionAll(once.exports), once.imports)
    return _compared(spark, sf_dir, "new").diff_snapshot(twice).where("entity = 'export' AND change = 'removed'").drop("entity")


@query(_G6 + "SELECT printf('%-4s %-7s %-31s  %s', 'Warn', 'API001', 'src/generated/macros/supplie...', 'public function missing docs: ' || scope) AS line FROM f")
def report_table_truncated(spark, sf_dir):
    found = corpus(spark, sf_dir, "macros").rules().with_default_rules().run()
    return reports.lines(found.where("code = 'API001'"), reports.table_line()).select("line")


@query(_G3 + f"SELECT '{{\"severity\":\"' || severity || '\",\"code\":\"' || code || '\",\"message\":\"' || message || '\",\"location\":{{\"path\":\"' || path || '\",\"line\":null,\"column\":null}},\"extra\":' || extra || '}}' AS line FROM ({_API002} UNION ALL {_API003} UNION ALL {_API004})")
def report_json(spark, sf_dir):
    """A JSON object a finding, as the JSON sink writes them; of the rules after the first."""
    return reports.json_lines(_default(spark, sf_dir).where("code <> 'API001'")).select("line")


@query(_G2 + f"""SELECT {_I}, origin, count(*) OVER (PARTITION BY origin) AS n,
  CAST(list_position(['Internal', 'Std', 'Core', 'Alloc', 'WorkspaceMember', 'Dependency', 'UnknownExternal'], origin) AS BIGINT) AS origin_rank FROM i""")
def imports_rows_by_origin(spark, sf_dir):
    return imports.rows_by_origin(_g2(spark, sf_dir).imports_df).select("file_ord", "ord", "full_path", "origin", "n", "origin_rank")


@query(_G2 + f"SELECT {_I}, root, count(*) OVER (PARTITION BY root) AS n FROM i")
def imports_rows_by_root(spark, sf_dir):
    return imports.rows_by_root(_g2(spark, sf_dir).imports_df).select("file_ord", "ord", "full_path", "root", "n")

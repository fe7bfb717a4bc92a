import json
import os

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as L
from lodestar.operators import imports, reports, use_sites
from lodestar.operators.corpus import Corpus
from lodestar.operators.rules import ordered
from lodestar.operators.snapshot import Snapshot
from lodestar.sources.errors import GlobFailure, IoFailure, ManifestFailure, ParseFailure
from lodestar.sources.globs import glob_regex
from lodestar.sources.scan import SourceScan, Workspace, choose


def corpus(spark, *texts, **options):
    rows = [(f"{chr(97 + i)}.rs", None, i, t) for i, t in enumerate(texts)]
    files = spark.createDataFrame(rows, "path string, modified timestamp, file_ord bigint, source string")
    return Corpus.from_sources(files, "k", **options)


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


USES = """use std::{self, collections::HashMap as Map, fmt::*};
pub use ::serde::Serialize;
use crate::x::{self, y};
mod inner { pub use super::z; }"""


def test_queries(spark):
    k = corpus(
        spark,
        """/// doc
pub async fn a(x: &str) -> Result<String, E> { Ok(x.to_string()) }
pub(crate) fn b() {}
#[doc(hidden)] pub const fn c<T: Clone>(t: T) -> T { t }
unsafe fn d() {}""",
    )
    q = k.functions()
    assert len(q.returns("Result<").collect()) == 0 and len(q.returns("Result").collect()) == 1 and len(q.returns("").collect()) == 4
    assert [r["name"] for r in q.public_only().collect()] == ["a", "c"]
    assert [r["name"] for r in q.named("a").named("c").collect()] == ["c"]
    assert [r["name"] for r in q.name_matches("^[ab]$").is_async(False).collect()] == ["b"]
    assert [r["name"] for r in q.filter(lambda r: r["name"] == "d").collect()] == ["d"]
    assert [r["name"] for r in q.filter(F.col("is_unsafe")).collect()] == ["d"]
    assert [r["name"] for r in q.has_attr("doc").is_const().is_generic().collect()] == ["c"]
    assert k.undocumented_public_api().collect() == []
    assert tuple(k.doc_coverage().first()) == (2, 2, 100.0)
    assert tuple(corpus(spark, "fn x() {}").doc_coverage().first()) == (0, 0, 100.0)
    assert k.functions_df.select("location.line").first()[0] is None


def test_import_operators(spark):
    k = corpus(spark, USES, dependencies=["serde"])
    assert [r["origin"] for r in k.imports().collect()] == ["Std", "Std", "Std", "Dependency", "Internal", "Internal", "Internal"]
    assert k.imports().full_path_starts_with("serde").collect() == [] and len(k.imports().stdish_only().collect()) == 3
    s = imports.summary(k.imports_df).first()
    assert (s["total"], s["pub_use"], s["glob"], s["rename"], s["absolute"]) == (7, 2, 1, 1, 1)
    assert s["by_root"] == {"crate": 2, "serde": 1, "std": 3, "super": 1} and s["by_origin"] == {"Internal": 3, "Std": 3, "Dependency": 1}
    quirky = corpus(spark, USES, dependencies=["serde"], reference_quirks=True)
    assert imports.summary(quirky.imports_df).first()["by_origin"] == {"UnknownExternal": 7}
    assert len(quirky.imports().stdish_only().collect()) == 7
    by = values(imports.group_by_origin(k.imports_df).orderBy("origin_rank"), "origin", "n")
    assert by == [("Internal", 3), ("Std", 3), ("Dependency", 1)]
    many = imports.classify(k.imports_df, spark.createDataFrame([("serde",)], "n string"), [f"d{i}" for i in range(2000)])
    assert [r["origin"] for r in many.orderBy("ord").collect()][3] == "WorkspaceMember"
    assert values(k.imports_v1().orderBy("ord"), "full_path")[0:5] == [("std::self",), ("std::collections::HashMap",), ("std::fmt::*",), ("serde::Serialize",), ("crate::x::self",)]
    empty = imports.summary(corpus(spark, "").imports_df).first()
    assert empty["total"] == 0 and empty["by_root"] == {}


def test_dedup(spark):
    df = corpus(spark, "use a::b;\npub use a::b;\nuse a::b;\nuse a::b as c;").imports_df
    once = imports.unique(df)
    assert values(imports.in_order(once), "ord") == [(0,), (1,), (3,)]
    assert values(imports.in_order(imports.unique(once)), "ord") == [(0,), (1,), (3,)]
    assert values(imports.in_order(imports.unique_prefer_pub_use(df)), "ord", "first_ord") == [(1, 0), (3, 3)]


def test_use_sites(spark):
    k = corpus(spark, 'use std_x::{self, y};\nfn g() { let v = std::vec![1]; let a: Vec<std::sync::Arc<u8>>; std::println!("x"); }', "mod m { use crate::a; fn f() { k::h(); self::x(); } }")
    got = values(k.dep_use_sites(["std"]).orderBy("branch_ord", "file_ord", "ord"), "path", "head", "kind", "scope")
    assert got == [("std::vec", "vec", "Path", "k::g"), ("std::sync::Arc", "sync", "Path", "k::g"), ("std::println", "println", "Path", "k::g"), ("std::vec", "vec", "MacroCall", "k::g"), ("std::println", "println", "MacroCall", "k::g")]
    assert values(k.dep_use_sites(["std-x"]).orderBy("ord"), "dep", "path", "head", "scope") == [("std_x", "std_x", "*", "file"), ("std_x", "std_x::y", "y", "file")]
    assert values(k.internal_use_sites().orderBy("branch_ord", "ord"), "path", "scope") == [("crate::a", "crate::m"), ("k::h", "k::m::f"), ("self::x", "k::m::f")]
    assert dict(values(use_sites.by_dependency(k.dep_use_sites(["std"])), "dep", "paths"))["std"]["std::vec"] == 2


def test_rules_and_reports(spark):
    k = corpus(spark, "#![no_std]\nuse std::io;\nfn f() { std::mem::drop(1); }", 'pub fn g() { x.unwrap_or(1); todo!(); }\n/// d\npub fn h() { assert!(true) }')
    found = ordered(k.rules().with_default_rules().run())
    assert values(found, "code", "severity", "message") == [
        ("API001", "Warn", "public function missing docs: k::g"),
        ("API002", "Warn", "panic-ish call inside public fn k::g: unwrap_or"),
        ("API004", "Deny", "std import in no_std crate: std::io"),
        ("API004", "Deny", "std path in no_std crate: std::mem::drop"),
        ("API003", "Warn", "macro todo! inside public fn k::g"),
    ]
    table = reports.to_table(found)
    assert table.splitlines()[2] == "Warn API001  b.rs:0:0                         public function missing docs: k::g"
    assert reports.to_table(found.limit(0)) == reports.HEADER
    assert reports.to_markdown(found).splitlines()[2] == "- **Warn API001**: public function missing docs: k::g (`b.rs`:0:0)"
    assert json.loads(reports.to_json(found))[3]["extra"] == {"module": "", "path": "std::mem::drop"}
    assert corpus(spark, "#![cfg_attr(test, no_std)]\nuse std::io;").rules().with_default_rules().run().count() == 0
    quirky = corpus(spark, "pub fn g() { todo!(); }", reference_quirks=True)
    assert [r["code"] for r in quirky.rules().with_default_rules().run().collect()] == ["API001"]

    class Own:
        code, name = "OWN1", "short names"

        def run(self, c):
            from lodestar.operators.rules import finding

            return finding(c.functions_df.where(F.length("name") < 2), "Warn", self.code, F.col("name"), {"n": F.lit(None).cast("string")})

    own = k.rules().add_rule(Own()).run()
    assert {r["message"] for r in own.collect()} == {"f", "g", "h"} and own.first()["extra"] == '{"n":null}'
    assert k.rules().run().count() == 0


def test_scalar_functions(spark):
    df = spark.createDataFrame([(" ::a::b::c ",), ("println",), ("x" * 40,)], "p string")
    got = values(df, L.split_dep_path(F.col("p")), L.truncate(F.col("p")))
    assert tuple(got[0][0]) == ("a", "b", "a::b::c") and got[1][0] is None and got[2][1] == "x" * 28 + "..."
    assert L.norm_crate(F.lit("a-b")) is not None
    fq = L.fq_name("k", F.array(F.lit("m")), F.struct(F.lit(None).cast("string").alias("trait_name"), F.lit("S").alias("self_ty")), F.lit("f"))
    assert df.select(fq).first()[0] == "k::m::S::f"


def test_containment(spark):
    k = corpus(spark, "pub fn o() {\n  fn i() {\n    x();\n  }\n}", "fn z() {\n" + "\n" * 2000 + "}", span_locations=True)
    at = [("a.rs", 3, 4, "k::i"), ("a.rs", 2, 2, "k::i"), ("a.rs", 4, 3, "k::i"), ("a.rs", 4, 4, "k::o"), ("a.rs", 5, 1, "k::o"), ("a.rs", 5, 2, None), ("q.rs", 3, 4, None), ("a.rs", None, 4, None), ("b.rs", 1500, 0, "k::z")]
    df = spark.createDataFrame(at, "path string, line bigint, column bigint, want string")
    got = k.enclosing(df).collect()
    assert len(got) == len(at) and all(r["want"] == r["enclosing_fq"] for r in got)
    assert corpus(spark, "fn a() {}").enclosing(df).where("enclosing_fq is not null").count() == 0


def test_snapshot_and_diff(spark, tmp_path):
    old = corpus(spark, "pub fn a(x: u8) {} pub fn b() {} pub use p::q; use m::n;").snapshot()
    new = corpus(spark, "pub fn a(x: u16) {} pub fn c() {} pub use p::r; use m::n;").snapshot()
    want = {("function", "changed", "k::a"), ("function", "added", "k::c"), ("function", "removed", "k::b"), ("export", "added", "r"), ("export", "removed", "q"), ("import", "added", "p::r"), ("import", "removed", "p::q")}
    assert set(values(new.diff(old), "entity", "change", "key")) == want
    mirror = {"added": "removed", "removed": "added", "changed": "changed"}
    assert set(values(old.diff(new), "entity", "change", "key")) == {(e, mirror[c], k) for e, c, k in want}
    assert new.diff(new).count() == 0
    twice = corpus(spark, "fn f(a: u8) {}", "fn f(b: u8) {}").snapshot()
    assert values(corpus(spark, "fn f(b: u8) {}").snapshot().diff(twice), "change") == []
    assert len(values(corpus(spark, "fn f(b: u8) {}").snapshot().diff(twice, key=("path", "fq_name")), "change")) == 2
    path = str(tmp_path / "s.json")
    new.write(path)
    back = Snapshot.read(spark, path)
    assert back.crate == "k" and new.diff(back).count() == 0 and set(values(back.diff(old), "entity", "change", "key")) == want


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("**/*.rs", "a.rs", True), ("**/*.rs", "x/y/a.rs", True), ("**/target/**", "x/target/y.rs", True), ("**/target/**", "target/y.rs", True), ("**/target/**", "x/targets/y.rs", False),
        ("*.rs", "x/a.rs", True), ("a?c", "a/c", True), ("[a-c].rs", "b.rs", True), ("[!a].rs", "a.rs", False), ("{a,b*}.rs", "bcd.rs", True), ("\\*.rs", "*.rs", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("**/*pb*.rs", "/pbx/a.rs", True),
    ],
)
def test_globs(pattern, path, hit):
    import re

    assert bool(re.match(glob_regex(pattern), path)) is hit


def test_bad_globs():
    for bad in ("[a", "{a", "a}", "a\\"):
        with pytest.raises(GlobFailure):
            SourceScan("k").include_glob(bad)


@pytest.fixture
def tree(tmp_path):
    for i, (name, size) in enumerate([("_d.rs", 10), ("c.rs", 10), ("b.rs", 999), ("a.rs", 10), ("n.txt", 1)]):
        p = tmp_path / "t" / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(("fn f() {}" + " " * size)[:size])
        os.utime(p, (i, i))
    return str(tmp_path / "t")


def test_listing(spark, tree):
    name = lambda scan: [os.path.basename(r["path"]) for r in scan.chosen(scan.listing(spark)).orderBy("discovery_ord").collect()]
    scan = SourceScan("k").scan_in_folder(tree).scan_in_folder("/no/such/folder")
    assert name(scan) == ["_d.rs", "a.rs", "b.rs", "c.rs"]
    assert name(scan.only_newest(2).max_file_size(100)) == ["a.rs"] == name(scan.max_file_size(100).only_newest(2))
    assert name(scan.default_include(False)) == [] and name(scan.default_include(False).include_glob("**/c*")) == ["c.rs"]
    assert name(scan.exclude_glob("**/_*")) == ["a.rs", "b.rs", "c.rs"]
    assert name(scan.scan_file(tree + "/a.rs")) == ["_d.rs", "a.rs", "b.rs", "c.rs"]
    assert sorted(name(scan.reference_quirks().scan_file(tree + "/a.rs"))) == ["_d.rs", "a.rs", "a.rs", "b.rs", "c.rs"]
    rows = [(p, None, 1, i) for i, p in enumerate(["x/target/y.rs", "src/bindings.rs", "src/pb.rs", ".rs", "x.RS", "src/ok.rs"])]
    df = spark.createDataFrame(rows, "path string, modified timestamp, length bigint, discovery_ord bigint")
    from lodestar.sources.globs import GENERATED

    assert values(choose(df, ["**/*.rs"], GENERATED), "path") == [("src/ok.rs",)]
    assert values(choose(df, ["**/*.rs"], newest=2), "path") == [("src/ok.rs",), ("src/pb.rs",)]


def test_links(spark, tree, tmp_path):
    os.symlink(tree, str(tmp_path / "u"))
    os.symlink(str(tmp_path), tree + "/loop")
    scan = SourceScan("k").scan_in_folder(tree)
    assert scan.listing(spark).count() == 5
    assert scan.follow_links().listing(spark).count() >= 5


def test_errors(spark, tmp_path):
    (tmp_path / "good.rs").write_text("pub fn a() {}")
    (tmp_path / "bad.rs").write_text("fn (")
    scan = SourceScan("k").scan_in_folder(str(tmp_path))
    with pytest.raises(ParseFailure, match="bad.rs"):
        scan.parse(spark)
    k = scan.ignore_parse_errors().parse(spark)
    assert [r["kind"] for r in k.errors.collect()] == ["parse"] and k.functions_df.count() == 1
    with pytest.raises(ParseFailure):
        scan.ignore_parse_errors().reference_quirks().parse(spark)
    (tmp_path / "bad.rs").write_bytes(b"fn a() {} // \xff")
    with pytest.raises(IoFailure):
        scan.parse(spark)


def test_workspace(spark, tmp_path):
    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("Cargo.toml", '[workspace]\nmembers = ["m/*"]\nexclude = ["m/skip"]\n[workspace.dependencies]\nshared = { version = "1", package = "shared-real" }')
    put("m/one/Cargo.toml", '[package]\nname = "one-a"\n[dependencies]\nserde-json = "1"\nal = { package = "real-name", version = "1" }\nshared = { workspace = true }\n[target."cfg(unix)".dev-dependencies]\nlibc = "1"')
    put("m/two/Cargo.toml", '[package]\nname = "two"\n[build-dependencies]\ncc = "1"')
    put("m/skip/Cargo.toml", '[package]\nname = "skip"')
    put("m/one/src/lib.rs", "use serde_json::x; use two::y;")
    put("m/one/tests/t.rs", "fn t() {}")
    put("m/two/src/lib.rs", "fn two() {}")
    scan = SourceScan("k").scan_workspace_root(str(tmp_path))
    assert scan.resolve()[1:] == (["one_a", "two"], ["cc", "libc", "real_name", "serde_json", "shared_real"])
    k = scan.parse(spark)
    assert [r["origin"] for r in k.imports().collect()] == ["Dependency", "WorkspaceMember"]
    assert scan.only_members(["two"]).listing(spark).count() == 1 and scan.include_tests().listing(spark).count() == 3
    with pytest.raises(ManifestFailure):
        Workspace.read(str(tmp_path / "none"))


def test_views(spark):
    corpus(spark, USES).create_views("t_")
    assert spark.sql("SELECT count(*) FROM t_imports WHERE is_public_use").first()[0] == 2


def test_command_line(spark, tmp_path, capsys):
    from lodestar.__main__ import main

    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("pub fn a() { b.unwrap(); }")
    root, saved = str(tmp_path / "src"), str(tmp_path / "s.json")
    main(["scan", root])
    assert "functions: 1" in capsys.readouterr().out
    main(["findings", root, "--format", "json"])
    assert [f["code"] for f in json.loads(capsys.readouterr().out)] == ["API001", "API002"]
    main(["snapshot", root, saved])
    (tmp_path / "src/a.rs").write_text("pub fn c() {}")
    main(["diff", root, saved])
    assert capsys.readouterr().out.splitlines() == ["function added: crate::c", "function removed: crate::a"]


def test_stream(spark, tmp_path):
    from lodestar.streaming.landing import on_each_batch, read_landing

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.rs").write_text("pub fn a() {}")
    seen = []
    act = lambda k, i: seen.extend(r["message"] for r in k.rules().with_default_rules().run().collect())
    for text in (None, "pub fn b() {}"):
        if text:
            (tmp_path / "in/b.rs").write_text(text)
        on_each_batch(read_landing(spark, str(tmp_path / "in"), "k"), "k", str(tmp_path / "ck"), act, once=True).awaitTermination()
    assert seen == ["public function missing docs: k::a", "public function missing docs: k::b"]


def test_uris_are_read_by_spark(spark, tmp_path):
    for i in range(4):
        p = tmp_path / "t" / f"d{i % 2}" / f"f{i}.rs"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"fn f{i}() {{}}")
        os.utime(p, (1000 + i, 1000 + i))
    root = tmp_path / "t"
    found = SourceScan("k").scan_in_folder(root.as_uri()).exclude_glob("**/f1*").parse(spark)
    assert values(found.functions_df.orderBy("file_ord"), "fq_name") == [("k::f0",), ("k::f2",), ("k::f3",)]
    newest = SourceScan("k").scan_in_folder(root.as_uri()).only_newest(1).parse(spark)
    assert values(newest.functions_df, "fq_name") == [("k::f3",)]


def test_snapshot_at_a_uri(spark, tmp_path):
    k = corpus(spark, "pub fn a() {} pub use b::c;")
    k.snapshot().write((tmp_path / "s.json").as_uri())
    assert k.diff_snapshot(Snapshot.read(spark, str(tmp_path / "s.json"))).count() == 0


def test_stream_goes_on_after_bad_bytes(spark, tmp_path):
    from lodestar.streaming.landing import on_each_batch, read_landing

    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "bad.rs").write_bytes(b"fn a() {} // \xff")
    (landing / "good.rs").write_text("fn b() {}")
    seen = []
    on_each_batch(read_landing(spark, str(landing), "k"), "k", str(tmp_path / "state"), lambda k, i: seen.append((values(k.functions_df, "fq_name"), values(k.errors, "kind"))), once=True).awaitTermination()
    assert seen == [([("k::b",)], [("io",)])]

import random

import pytest

from lodestar.rust.lexer import SourceError
from lodestar.rust.parser import parse
from lodestar.rust.shapes import SEEN
from lodestar.rust.templates import RELATIONS, Templates

#: # is a number; single lines that are whole, open or close something, or look like it.
LINES = """fn f#() {
pub fn g#(x: &str, n: u8) -> Result<T#, E> { k(n) }
pub unsafe fn h#<'a>(x: &'a S#) {
  q.unwrap();
  a#::b::<u8>(1 ..= 2 << #); c();
  let x# = "lit #
  # lit";
  let c = '#';
  let c = '\\x4#'; y(c);
  let f = 0x#E + 1e# - #.0.#; z#(f)
  if a { b#() } else { panic!("x#") }
  std::fs::read(x) }
}
};
;
/// doc # d
#[inline]
// note # "
/* open
*/ use b#::c;
impl S# { fn m(&self) { self.x.expect("#") } }
impl fmt::Display for S# {
mod m# { pub fn i() {} }
macro_rules! m# { () => {} }
pub use e#::{a, b as c#, d::*};
//! inner #
#![allow(x)]
fn e#() {}
fn e#() {};
} fn t#() {
  "a :: b"; r#"raw # "#;
  {
  todo!()
  fn n#() { w#() }
const F#: fn() = g;""".split("\n")


def facts_of(parser, text):
    try:
        found = parser(text)
    except SourceError as e:
        return str(e)
    return found.no_std, {n: [{k: v for k, v in r.items() if k[0] != "_"} for r in getattr(found, n)] for n in RELATIONS}


def filled(line, rng):
    for word in ("#[", "#!", 'r#"', '"#'):
        line = line.replace(word, word.replace("#", "\1"))
    return "".join(str(rng.randrange(10 ** rng.randint(1, 6))) if c == "#" else c for c in line).replace("\1", "#")


def test_templates_give_the_facts_of_a_parse():
    rng, templates = random.Random(1), Templates("k")
    good = [["fn f#() {", "}"], ["/// doc # d", "#[inline]", LINES[1]], ["fn f#() {", *LINES[5:7], "}"], ["fn f#() {", LINES[9], "}"], [LINES[0], LINES[10], LINES[11]], ["/* open", "*/ use b#::c;"], ["fn e#() {}", "fn e#() {}"]]
    good += [["impl S# {", "  fn m(&self) {", LINES[3], "  }", "}"], ["fn a#() {", "  {", "  todo!()", "  }", "  fn n#() { w#() }", ";", "}"], ["mod m# { pub fn i() {} }"], ["pub use e#::{a, b as c#, d::*};"], ["const F#: fn() = g;"], ["macro_rules! m# { () => {} }"]]
    for i in range(SEEN * 100):
        if i % 4:
            lines = [x for _ in range(rng.randint(1, 3)) for x in rng.choice(good)]
        else:
            lines = [rng.choice(LINES) for _ in range(rng.randint(1, 6))]
        text = "\n".join(filled(x, rng) for x in lines) + "\n" * rng.randint(0, 2)
        assert facts_of(templates.parse, text) == facts_of(lambda t: parse(t, "k"), text), text
    assert templates.filled > 500
    assert sum(e.__class__ is tuple for known in templates.known for e in known.values()) > 15


def test_known_templates_are_not_lexed(monkeypatch):
    from lodestar.rust import lexer

    templates, calls = Templates("k", ("calls", "fn_spans")), []
    lex = lexer.Source._lex
    monkeypatch.setattr(lexer.Source, "_lex", lambda self: (calls.append(1), lex(self)))
    for i in range(200):
        found = templates.parse(f"macro_rules! m{i} {{ () => {{}} }}\npub fn order_{i}() {{\n" + f"  q{i}.unwrap();\n" * (1 + i % 9) + "}\n")
        assert [(c["enclosing_fn"], c["line"], c["column"]) for c in found.calls] == [(f"k::order_{i}", 3 + n, 2) for n in range(1 + i % 9)]
        assert [(s["start_line"], s["end_line"], s["end_col"]) for s in found.fn_spans] == [(2, 4 + i % 9, 1)]
    assert len(calls) < 150


def test_texts_that_do_not_repeat_are_seldom_tried(monkeypatch):
    templates, tried = Templates("k"), []
    filled_ = templates._filled
    monkeypatch.setattr(templates, "_filled", lambda t: (tried.append(1), filled_(t))[1])
    names = ["".join(random.Random(i).choices("abcdefgh", k=9)) for i in range(3_000)]
    for n in names:
        templates.parse(f"fn {n}() {{}}")
    assert len(tried) < 1_300
    assert max(map(len, templates.known)) <= 16_384


def test_errors_and_bytes_keep_their_rows(spark):
    from lodestar.sources.scan import facts

    rows = [("a.rs", None, 0, "fn f() { g() }"), ("b.rs", None, 1, "fn f( {"), ("none/c.rs", None, 2, None), ("d.rs", None, 3, "use std::io as x;\nuse a::{b, c};")]
    found = facts(spark.createDataFrame(rows, "path string, modified timestamp, file_ord long, source string"), "k", ["imports", "calls"]).orderBy("file_ord").collect()
    assert [r["_error"] and r["_error"]["kind"] for r in found] == [None, "parse", "io", None]
    assert [c["callee"] for c in found[0]["calls"]] == ["g"] and found[1]["calls"] == [] == found[1]["imports"]
    assert [(i["ord"], i["full_path"], i["kind"]["alias"]) for i in found[3]["imports"] if i["listed"]] == [(0, "std::io", "x"), (1, "a::b", None), (2, "a::c", None)]


def test_an_order_of_many_items_is_not_sorted_as_objects(spark, capsys, tmp_path):
    from lodestar.plans import synth

    spark.sql("select id o_orderkey, if(id % 2 = 0, 'F', 'O') o_orderstatus from range(3)").write.parquet(f"{tmp_path}/orders.parquet")
    items = "select id % 2 l_orderkey, 9 - id l_partkey, element_at(array('A', 'N', 'R'), int(id % 3) + 1) l_returnflag, 'F' l_linestatus from range(10)"
    spark.sql(items).write.parquet(f"{tmp_path}/lineitem.parquet")
    files = synth.orders_files(spark, str(tmp_path))
    files.explain()
    assert "ObjectHashAggregate" not in capsys.readouterr().out
    found = {r["path"]: r["source"].split("\n") for r in files.collect()}
    assert sorted(found) == ["src/o0.rs", "src/o1.rs"]
    line = {0: "  q.unwrap();", 1: '  let _ = panic!("x");', 2: "  std::fs::read(x);"}
    assert found["src/o0.rs"] == ["macro_rules! m0 { () => {} }", "pub fn order_0() {", *(line[i % 3] for i in (8, 6, 4, 2, 0)), "}", ""]


def test_the_innermost_function_takes_one_join(spark, capsys):
    from lodestar.operators.containment import enclosing

    spans = "values ('a', 'f', true, 1L, 0L, 2000L, 1L, 0L), ('a', 'g', false, 600L, 0L, 700L, 1L, 1L), ('a', 'h', false, 650L, 0L, 750L, 1L, 2L), ('a', 'h', false, 650L, 0L, 750L, 1L, 2L) t(file, fq_name, is_public, start_line, start_col, end_line, end_col, ord)"
    spans = spark.sql(f"select * from {spans}")
    at = spark.createDataFrame([("a", 650, 5, "x"), ("a", 650, 5, "x"), ("a", 710, 0, "y"), ("a", 3000, 0, "z"), ("b", 1, 0, "z"), ("a", None, None, "n")], "path string, line long, column long, what string")
    found = enclosing(at, spans)
    found.explain()
    assert capsys.readouterr().out.count("Join") == 1
    rows = sorted((r["what"], r["path"], r["enclosing_fq"] or "", r["start_line"]) for r in found.collect())
    assert rows == [("n", "a", "", None), ("x", "a", "g", 600), ("x", "a", "g", 600), ("y", "a", "h", 650), ("z", "a", "", None), ("z", "b", "", None)]
    assert found.columns == ["path", "line", "column", "what", "enclosing_fq", "enclosing_is_public", "start_line", "end_line"]


def test_what_one_query_reads_is_kept_once(spark):
    from lodestar.operators.corpus import Corpus

    files = spark.createDataFrame([("a.rs", None, 0, "fn f() { g() }")], "path string, modified timestamp, file_ord long, source string")
    kept = Corpus.from_sources(files, "k", relations=["calls"]).persist(flat=False)
    assert kept.calls.count() == 1 and kept.facts.is_cached and not kept.calls.is_cached
    assert Corpus.from_sources(files, "k").persist().calls.is_cached


def test_whole_templates_give_the_rows_of_a_parse(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from lodestar.rust import templates as module
    from lodestar.rust.templates import Whole
    from lodestar.sources import scan
    from lodestar.sources.schema import facts_schema

    monkeypatch.setattr(module, "WHOLES", 60)  # so that they are forgotten, too
    rng = random.Random(2)
    good = [["/// doc # d", "#[inline]", LINES[1]], ["fn f#() {", *LINES[3:5], "}"], ["pub fn s#() {", '  q#.expect("x#");', "  std::fs::read(x#);", '  let _ = panic!("x");', LINES[9], "}"], ["impl S# {", "  fn m(&self) {", LINES[3], "  }", "}"]]
    good += [["mod m# { pub fn i() {} }"], ["pub use e#::{a, b as c#, d::*};"], ["macro_rules! m# { () => {} }"], ["fn a#() { a#::b#(1, #); c#_!() }"]]
    for relations in (RELATIONS, ("calls", "functions", "macros_inv", "paths"), ("imports", "fn_spans")):
        templates = Templates("k", relations)
        schema = to_arrow_schema(facts_schema(list(relations)))
        columns, used, forgotten = scan.WholeColumns(templates, schema), 0, 0
        for _ in range(30):
            texts = ["\n".join(filled(x, rng) for _ in range(rng.randint(1, 2)) for x in rng.choice(good)) for _ in range(100)] + ["fn f( {"]
            rng.shuffle(texts)
            files = pa.RecordBatch.from_pydict({"path": [f"{i}.rs" for i in range(len(texts))], "modified": pa.array([None] * len(texts), pa.timestamp("us", "UTC")), "file_ord": list(range(len(texts)))})
            found = [scan._file(f"{i}.rs", t, templates) for i, t in enumerate(texts)]
            used += sum(f.__class__ is tuple and f[0].__class__ is Whole for f in found)
            got = sorted((r for b in scan._batches(files, found, columns) for r in b.to_pylist()), key=lambda r: r["file_ord"])
            plain = [parse(t, "k") if t != "fn f( {" else f for t, f in zip(texts, found)]
            assert got == scan._batch(files, plain, schema).to_pylist()
            if templates.full():
                templates.forget()
                forgotten += 1
        assert used > 800 and forgotten


def test_a_known_whole_text_is_neither_cut_nor_run(monkeypatch):
    templates = Templates("k", ("calls",))
    text = "pub fn order_{0}() {{\n  q.unwrap();\n  q.expect({0});\n}}\n"
    for i in range(SEEN * 6):
        templates.read(text.format(i))
    monkeypatch.setattr(templates, "_plan", None)
    whole, runs = templates.read(text.format(12345))
    assert whole.texts(runs) == ["k::order_12345"] and whole.numbers is None
    assert len(templates.rows["calls"]) == 2


def test_one_relation_is_not_kept(spark):
    import os

    from lodestar.plans import registry, synth

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    registry.QUERIES["calls_contains"](spark, "/root/testdata/sf0.001")
    assert not synth.corpus(spark, "/root/testdata/sf0.001", "orders", relations=["calls"]).facts.is_cached
    assert synth.corpus(spark, "/root/testdata/sf0.001", "orders", relations=["calls", "paths"]).facts.is_cached


@pytest.mark.parametrize("text", ["﻿fn a() {}", "#!/bin/x\nfn a() {}", "fn a() {}\0"])
def test_odd_starts(text):
    templates = Templates("k")
    for _ in range(SEEN + 3):
        assert facts_of(templates.parse, text) == facts_of(lambda t: parse(t, "k"), text)

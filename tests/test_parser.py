import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.rust.lexer import Source, SourceError, token_text
from lodestar.rust.parser import parse


def names(rows, key):
    return [r[key] for r in rows]


def kept(facts):
    return [p["path"] for p in facts.paths if p["keep"]]


def test_functions_and_flags():
    f = parse(
        """/// doc
pub async fn a(x: &str) -> Result<String, E> { Ok(x.to_string()) }
pub(crate) fn b() {}
#[doc(hidden)] pub const fn c<T: Clone>(t: T) -> T { t }
unsafe fn d() {}""",
        "k",
    )
    a, b, c, d = f.functions
    assert a["signature"] == "async fn a (x : & str) -> Result < String , E >" and a["args"] == ["x : & str"] and a["return_ty"] == "Result < String , E >"
    assert a["is_public"] and a["has_docs"] and a["is_async"] and not a["is_generic"] and a["attrs"] == ["doc"]
    assert not b["is_public"] and b["return_ty"] is None and b["signature"] == "fn b ()"
    assert c["has_docs"] and c["is_const"] and c["is_generic"] and c["signature"] == "const fn c < T : Clone > (t : T) -> T"
    assert d["is_unsafe"] and d["signature"] == "unsafe fn d ()"
    assert names(f.calls, "callee") == ["Ok", "to_string"] and all(x["enclosing_fn"] == "k::a" and x["enclosing_public"] for x in f.calls)
    assert kept(f) == ["crate"] and f.paths[[p["path"] for p in f.paths].index("crate")]["enclosing_fn"] == "k::b"


def test_impls_and_traits():
    f = parse(
        """mod m {
    pub trait T { fn p(&self) { self.q().unwrap(); } }
    impl<'a> T for &'a str { fn p(&self) {} }
    impl std::fmt::Display for Foo<u8> { fn fmt(&self) -> R { panic!("x") } }
}""",
        "k",
    )
    assert names(f.functions, "fq_name") == ["k::m::T::p", "k::m::& 'a str::p", "k::m::Foo::fmt"]
    assert [x["kind"]["kind"] for x in f.functions] == ["TraitMethod", "ImplMethod", "ImplMethod"]
    assert f.functions[2]["kind"]["trait_ty"] == "std::fmt::Display" and names(f.functions, "is_public") == [True, False, False]
    assert names(f.calls, "callee") == ["unwrap", "q"]
    assert kept(f) == ["self", "std::fmt::Display"]
    assert [(m["name"], m["position"], m["enclosing_public"]) for m in f.macros_inv] == [("panic", "expr", False)]


def test_imports_and_exports():
    f = parse(
        """use std::{self, collections::HashMap as Map, fmt::*};
pub use ::serde::Serialize;
use crate::x::{self, y};
mod inner { pub use super::z; }
fn f() { use std::io; }""",
        "k",
    )
    assert [(i["root"], i["segments"], i["kind"]["kind"], i["kind"]["alias"], i["full_path"], i["is_absolute"], i["is_public_use"]) for i in f.imports] == [
        ("std", [], "Name", None, "std", False, False),
        ("std", ["collections", "HashMap"], "Rename", "Map", "std::collections::HashMap", False, False),
        ("std", ["fmt", "*"], "Glob", None, "std::fmt::*", False, False),
        ("serde", ["Serialize"], "Name", None, "::serde::Serialize", True, True),
        ("crate", ["x"], "Name", None, "crate::x", False, False),
        ("crate", ["x", "y"], "Name", None, "crate::x::y", False, False),
        ("super", ["z"], "Name", None, "super::z", False, True),
    ]
    assert [(e["exported_as"], e["source_path"], e["module_path"]) for e in f.exports] == [("Serialize", "serde::Serialize", []), ("z", "super::z", ["inner"])]
    assert parse("pub use x::{self};", "k").exports[0]["source_path"] == "x::self"


def test_macros():
    f = parse(
        """macro_rules! mm { () => {} }
thread_local! { static A: u8 = 1; }
pub fn h(x: u8) -> u8 { match x { 0 => todo!(), 1 => x::unreachable!(), _ => { println!("{}", y.unwrap()); 2 } } }""",
        "k",
    )
    assert names(f.macros_def, "name") == ["mm"]
    assert [(m["name"], m["path"], m["position"], m["enclosing_fn"]) for m in f.macros_inv] == [
        ("thread_local", "thread_local", "item", None),
        ("todo", "todo", "expr", "k::h"),
        ("unreachable", "x::unreachable", "expr", "k::h"),
        ("println", "println", "stmt", "k::h"),
    ]
    assert not f.calls and kept(f) == ["x::unreachable"]
    g = parse('fn g() { let v = std::vec![1]; let a: Vec<std::sync::Arc<u8>>; std::println!("x"); }', "k")
    assert kept(g) == ["std::vec", "std::sync::Arc", "std::println"]
    assert [(m["path"], m["position"]) for m in g.macros_inv] == [("std::vec", "expr"), ("std::println", "stmt")]


def test_nesting_and_spans():
    f = parse("pub fn outer() { fn inner() { x.unwrap(); } inner(); }", "k")
    assert names(f.functions, "fq_name") == ["k::outer"] and names(f.fn_spans, "fq_name") == ["k::outer", "k::inner"]
    assert [(c["callee"], c["enclosing_fn"], c["enclosing_public"]) for c in f.calls] == [("unwrap", "k::inner", False), ("inner", "k::outer", True)]
    g = parse("pub fn o() {\n  fn i() {\n    x();\n  }\n}", "k")
    assert [tuple(s[c] for c in ("start_line", "start_col", "end_line", "end_col")) for s in g.fn_spans] == [(1, 0, 5, 1), (2, 2, 4, 3)]
    h = parse("trait T { fn a() { fn b() {} } }", "k").fn_spans
    assert h[1]["fq_name"] == "k::T::b" and h[1]["is_public"]


def test_calls_and_patterns():
    f = parse("fn p(o: Option<u8>) { if let Some(n) = o { k(n); } (o.f)(1); }", "k")
    assert names(f.calls, "callee") == ["k", "(o . f)"]
    assert names(parse("fn f() { x.a().b(c(1))(2)?.await; }", "k").calls, "callee") == ["x . a () . b (c (1))", "b", "a", "c"]
    assert names(parse("fn f() { std::mem::drop(1); Vec::<Vec<u8>>::new(); }", "k").calls, "callee") == ["std :: mem :: drop", "Vec :: < Vec < u8 > > :: new"]


def test_no_std():
    assert parse("#![no_std]\nuse std::io;", "k").no_std and not parse("#![cfg_attr(test, no_std)]", "k").no_std


MANY = """
//! Crate docs
#![allow(dead_code)]
extern crate alloc as a;
pub(in crate::x) static mut N: [u8; 3] = [1, 2, 3];
const F: fn(u8, &mut dyn Fn(i32) -> bool) -> ! = f;
type A<T> where T: Copy = Box<dyn Iterator<Item = (T, [u8; 2 + 1])> + Send + 'static>;
union U { a: u32, b: f32 }
pub struct P<'a, T: ?Sized + 'a, const N: usize = 3>(pub &'a T, [u8; N]) where T: core::fmt::Debug;
enum E { A = 1 << 3, B { x: u8 }, C(std::io::Error), #[default] D }
unsafe extern "C" { pub fn ext(x: *const u8, ...) -> i32; static S: u8; }
impl<T> !Send for P<'_, T, 2> {}
unsafe impl<T: Tr<Out = u8>> Tr for Vec<T> where T: Clone { type Out = u8; const C: u8 = { 1 }; default fn m(self: Box<Self>, (a, b): (u8, u8)) -> impl Sized + '_ { self } mac!(); }
auto trait Auto {}
trait Super: Sized + for<'x> Fn(&'x u8) -> u8 { type G<'a>: Clone where Self: 'a; fn d(&mut self) -> Self::G<'_>; }
async unsafe fn z<'a, T, F>(x: &'a mut dyn Fn(u8) -> std::io::Result<()>, mut y: [u8; 3], _: F) -> impl Iterator<Item = Vec<Vec<u8>>> + 'a where T: core::fmt::Debug, F: FnOnce() {
    let c = move |a: u8, (b, _): (u8, u8)| -> u8 { a + b };
    let s = S { a, b: f::g(1), 0: 2, ..Default::default() };
    if a < b && c > d || !e { return; } else if let Some(q) | Ok(q) = w && q == 1 {} else {}
    match x { A::B { x, ref mut y, z: 1..=2, .. } if y => 1..=2, 'a'..='z' | Q::R(-1, ..) => {} m @ (1 | 2) => break, &[first, .., last] => (), <T as Tr>::C => continue 'o, _ => return }
    let Some(q) = w else { return; };
    x.0.1.foo::<Vec<u8>>()?.await; x.0 .1; 1.0.max(2.); 1..2; ..; a[..n]; &&x; &raw const y; *p = -1; a <<= 2; x as *const u8 as usize >> 3;
    'o: for (i, _) in (0..n).rev() { while let Some(x) = it.next() { loop { break 'o } } }
    let v = unsafe { <[u8]>::len(&x) } + if a { 1 } else { 2 };
    let f = async move { r#"raw "string" "#; b"x\\n"; c"c"; br##"a"#b"##; 'x'; b'\\''; '\\u{1F600}' };
    match y { 1 => foo(), 2 => { bar() } 3 => if a { b } else { c } _ => (|| 1)() }
    r#type(); const { 1 }; #[cfg(x)] { y }; vec![1, 2].iter().map(|&x| x + 1).collect::<Vec<_>>(); m! { a => b }
    if let X { a } = (X { a: 1 }) {} struct Local; impl Local { fn l() {} }
    match () { () if let Some(x) = y => (), _ => {} }
    return Foo::<{ N + 1 }>::new(|x| x);
}
/* nested /* block */ comment */
macro_rules! q { ($($x:expr),* $(,)?) => { $(f($x);)* }; }
fn generic<const N: usize, T = u8>(_: [T; N]) -> Result<(), Box<dyn std::error::Error>> { Ok(()) }
"""


def test_wide_grammar():
    f = parse(MANY, "k")
    assert {"z", "m", "d", "generic"} <= {x["name"] for x in f.functions} and "l" not in {x["name"] for x in f.functions}
    assert "generic" in {x["name"] for x in f.functions}
    z = next(x for x in f.functions if x["name"] == "z")
    assert z["is_async"] and z["is_unsafe"] and z["is_generic"] and z["args"][0] == "x : & 'a mut dyn Fn (u8) -> std :: io :: Result < () >"
    # the where clause belongs to the generics, so its paths come before those of the arguments
    own = [p["path"] for p in f.paths if p["keep"] and p["enclosing_fn"] == "k::z"]
    assert own[:2] == ["core::fmt::Debug", "std::io::Result"]
    callees = names(f.calls, "callee")
    assert {"f :: g", "foo", "max", "< [u8] > :: len", "rev", "next", "collect", "map", "iter"} <= set(callees)
    assert "Some" not in callees and "ext" not in callees


@pytest.mark.parametrize("text", ["fn (", "fn f() {", "fn f() { 1 2 }", "struct", "use a::;", "let x = 1;", "fn f( { }", "}", '"', "fn f() { x.; }", "impl {", "/* open"])
def test_bad_sources(text):
    with pytest.raises(SourceError):
        parse(text, "k")


def test_lexer():
    s = Source("#!/usr/bin/x\n// c\nfn é() { 1..2; 'a; 'a'; x.0.1 }")
    assert [t.text for t in s.tokens] == ["fn", "é", "(", ")", "{", "1", ".", ".", "2", ";", "'a", ";", "'a'", ";", "x", ".", "0.1", "}"]
    assert s.position(s.tokens[1].start) == (3, 3)
    assert token_text(Source("{ } { a } ( b ) [ ]").tokens, set(), 0, 10) == "{ } { a } (b) []"
    assert parse("﻿fn a() {}", "k").functions[0]["name"] == "a"


ident = st.from_regex(r"[a-z][a-z0-9_]{0,6}", fullmatch=True).filter(lambda s: s not in {"as", "fn", "if", "in", "do", "for", "let", "mod", "mut", "pub", "ref", "use", "dyn", "box", "impl", "loop", "move", "self", "else", "enum", "type", "async", "await", "break", "const", "crate", "match", "super", "trait", "while", "union", "auto", "safe", "gen", "try", "extern", "static", "struct", "unsafe", "return", "where", "yield", "macro", "become", "default", "raw"})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(ident, st.booleans(), st.booleans(), st.lists(st.tuples(ident, st.sampled_from(["u8", "&str", "Vec<u8>"])), max_size=3)), max_size=6))
def test_functions_round_trip(items):
    text = "\n".join(f"{'pub ' if p else ''}{'async ' if a else ''}fn {n}({', '.join(f'{x}: {t}' for x, t in args)}) {{}}" for n, p, a, args in items)
    shown = {"u8": "u8", "&str": "& str", "Vec<u8>": "Vec < u8 >"}
    got = [(f["name"], f["is_public"], f["is_async"], f["args"]) for f in parse(text, "k").functions]
    assert got == [(n, p, a, [f"{x} : {shown[t]}" for x, t in args]) for n, p, a, args in items]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(ident, min_size=1, max_size=4), st.booleans(), st.booleans(), st.sampled_from(["", "::*", " as q"])), max_size=6))
def test_imports_round_trip(items):
    text = "\n".join(f"{'pub ' if p else ''}use {'::' if a else ''}{'::'.join(path)}{end};" for path, p, a, end in items)
    got = [(i["full_path"], i["is_public_use"], i["is_absolute"], i["kind"]["kind"]) for i in parse(text, "k").imports]
    kind = {"": "Name", "::*": "Glob", " as q": "Rename"}
    assert got == [(("::" if a else "") + "::".join(path) + (end if end == "::*" else ""), p, a, kind[end]) for path, p, a, end in items]


def test_declarative_macro_items_are_opaque():
    found = parse("pub macro m($a:expr) { $a }\nmacro n { (x::y) => { std::z } }\npub fn after() {}\n", "k")
    assert [f["fq_name"] for f in found.functions] == ["k::after"] and not [p for p in found.paths if p["keep"]]

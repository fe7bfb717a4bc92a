import re

import pytest

from lodestar.rust.lexer import SourceError
from lodestar.rust.parser import parse

SHAPED = """/// d :
#[inline] pub async fn f{0}<T: Tr{0}>(x: &str, [a, b]: [u8; {{ 3 }}], g: impl Fn(T{0}) -> u8) -> Result<S{0}, E> where T: Q::R{0} {{
  let n{0} = k{0}(n, "lit{0}")?; std::fs::read{0}(x); q.unwrap(); a::b::<u8>(1 ..= 2 << {0}); panic!("x {0}"); if a {{ b{0}() }} c();
  match x {{ A{0}::B(y) if y > 1 => z!(), _ => {{ fn inner{0}() {{ w() }} }} }}
  (|v{0}| v + 1)(2); S{0} {{ a, ..d }}.e(); todo!() }}
macro_rules! m{0} {{ ($a:tt) => {{}} }}
use a{0}::{{b, c as d, self, super::e::*}};
pub use std::io{0};
impl Tr{0} for S {{ fn m(&self) {{ self.x.unwrap() }} const C: u8 = h(); }}
pub mod in{0} {{ use std::fs; pub fn g() {{ y::z() }} trait T {{ fn t(); }} }}
const F{0}: fn() = g;
static G: S = S {{ a: b{0}::c }};
extern "C" {{ fn c{0}(a: u8); }}
mac{0}! {{ a }} n::mac!(b);
"""


def test_shapes_give_the_facts_of_a_parse():
    from lodestar.rust.shapes import RELATIONS, SEEN, Shapes

    def rows(facts):
        return facts.no_std, {n: [{k: v for k, v in r.items() if k[0] != "_"} for r in getattr(facts, n)] for n in RELATIONS}

    shapes = Shapes("k")
    texts = [SHAPED.replace("{{", "{").replace("}}", "}").replace("{0}", "xyz"[i % 3] * (i % 7) + str(i)) for i in range(SEEN * 4)]
    for t in texts:
        assert rows(shapes.parse(t)) == rows(parse(t, "k"))
    assert sum(map(callable, shapes.seen.values())) > 15  # most pieces no longer reach the parser
    for t in ["", "#![no_std]\nuse std::io;", "//! d\nfn a() {}", "fn a() {};", 'fn a() { "x :: y"(1) }', "fn f() -> A<{ 3 }> { g() }", "fn a() { b::c(1) d }", "fn", "static F: fn() = { g };", "fn f() { /// d\n g(); }"]:
        for _ in range(SEEN + 3):
            try:
                wanted = rows(parse(t, "k"))
            except SourceError as e:
                with pytest.raises(SourceError, match=re.escape(str(e))):
                    shapes.parse(t)
                continue
            assert rows(shapes.parse(t)) == wanted


def test_repeated_pieces_are_parsed_once(monkeypatch):
    from lodestar.rust import shapes as module

    shapes, calls = module.Shapes("k", ("calls",)), []
    statement = module.Parser.statement
    monkeypatch.setattr(module.Parser, "statement", lambda self, close: (calls.append(1), statement(self, close)))
    for i in range(100):
        found = shapes.parse(f"fn f{i}() {{ " + f"q{i}.unwrap(); " * (1 + i % 9) + "}")
        assert [c["enclosing_fn"] for c in found.calls] == [f"k::f{i}"] * (1 + i % 9)
    assert len(calls) < 150  # of 496

"""Extraction from Rust, TypeScript and Java: what line rules get wrong."""

import random

import pytest

from tessera.sources import scopes


def found(language, text, kind):
    rows = [r for r in scopes.GRAMMARS[language](text) if r[0] == kind]
    return rows if kind == "error" else [(r[1], r[2]) if kind == "import" else (r[1], r[6], r[3], r[4]) if kind == "symbol" else r[1] for r in rows]


@pytest.mark.parametrize("text,want", [
    ("use a;", [("a", None)]),
    ("use a::b;", [("a", ["b"])]),
    ("pub(crate) use a::b as c;", [("a", ["b as c"])]),
    ("use a::{b, c as d, self};", [("a", ["b", "c as d", "self"])]),
    ("use a::*;", [("a", ["*"])]),
    ("use a::{\n    b::{C, D},\n    e as f, // note }\n};", [("a", ["e as f"]), ("a::b", ["C", "D"])]),
    ("use {a::b, c};", [("", ["c"]), ("a", ["b"])]),
    ("use a::{b::c::{d::{E}, F}};", [("a::b::c", ["F"]), ("a::b::c::d", ["E"])]),
    ("use r#type::r#fn;", [("type", ["fn"])]),
    ("// use no::way;\nlet s = \"use no::way;\";", []),
])
def test_use_trees(text, want):
    assert found("rust", text, "import") == want


def test_rust_items_and_their_lines():
    text = """#[derive(Debug)]
pub struct S<T>
where
    T: Fn(u32) -> u8,
{
    x: u8, // }
}
struct Unit;
struct Pair(u32, Box<dyn Fn(i32)>);
pub enum E { A(u32), B { x: i32 } }
pub trait T { type Item; fn sig(&self); fn body(&self) { one() } }
mod inner { pub(crate) mod deep; }
type Alias<T> = Vec<T>;
const LIMIT: usize = 3;
const _: () = ();
static mut G: &str = r#"not " closed } "#;
pub async unsafe extern "C" fn long<
    const N: usize,
>(a: &'static str) -> Result<(), E> {
    let c = '{'; let d = b'}'; let e = '\\''; let s = "fn no() { \\" }";
    /* outer /* fn no() { */ } */
}
impl S { const fn r#type(p: *const u8) {} }
"""
    assert found("rust", text, "error") == []
    assert found("rust", text, "symbol") == [("S", "struct", 2, 7), ("Unit", "struct", 8, 8), ("Pair", "struct", 9, 9), ("E", "enum", 10, 10), ("T", "trait", 11, 11), ("body", "function", 11, 11), ("inner", "module", 12, 12), ("deep", "module", 12, 12), ("Alias", "type", 13, 13), ("LIMIT", "constant", 14, 14), ("G", "constant", 16, 16), ("long", "function", 17, 22), ("type", "function", 23, 23)]
    signature = next(r[5] for r in scopes.rust(text) if r[1] == "long")
    assert signature == "pub async unsafe extern \"C\" fn long< const N: usize, >(a: &'static str) -> Result<(), E>"


def test_rust_calls():
    text = """fn f(x: Option<u8>) {
    a(b(1)); m.n(2)?.o(); p::q::r(3); if s(4) {} vec![hidden(5)]; println!("{}", hidden(6));
    match x { Some(v) => t(v), Ok(Some(w)) if u(w) => {}, _ => {} }
    if let Some(y) = z(7) {}
    let g: Box<dyn Fn(i32)> = Box::new(|k| h(k));
}
macro_rules! m { ($e:expr) => { fn gone() { hidden(8) } } }
"""
    assert found("rust", text, "reference") == ["a", "b", "n", "o", "r", "s", "t", "u", "z", "new", "h"]
    assert [s[0] for s in found("rust", text, "symbol")] == ["f"]


def test_typescript():
    text = """import { a, type B } from "./a";
import def, * as ns from './b'
import 'side';
import {
  c,
} from 'c';
export * from './no';
const lazy = import('./lazy');
// import x from 'no'
/* } */
export default async function load<T extends { a: string }>(x: { b: number }): Promise<{ c: T }> {
  const t = `a ${fn(`inner ${deep({ k: 1 })}`)} }`;
  return await fetchIt<T>(x, /[}/"]/g.test(y));
}
function over(a: string): void;
declare function sig(): void;
export abstract class C<T> extends Base<T> {
  private m(a: number): string { return this.other(a) }
  constructor(x) { super(x); this.y = new Foo(x.make()); }
}
interface I { call(x: string): void; }
export type U<T> = { [K in keyof T]: T[K] } | ((a: string) => void);
const enum Color { Red, Blue }
export const arrow = async <T,>(
  x: T,
): Promise<T> => {
  go(x)
};
const one = x => x + 1
let two: Fn = (a) => helper(a), three = function () { four() };
const plain = compute(1);
const obj = { meth(a) { return f(a) } };
const el = <div>Don't { call(1) }</div>;
"""
    assert found("typescript", text, "error") == []
    assert [n for n, _ in found("typescript", text, "import")] == ["./a", "./b", "side", "c"]
    assert found("typescript", text, "symbol") == [("load", "function", 11, 14), ("C", "class", 17, 20), ("I", "interface", 21, 21), ("U", "type", 22, 22), ("Color", "enum", 23, 23), ("arrow", "function", 24, 28), ("one", "function", 29, 29), ("two", "function", 30, 30)]
    assert found("typescript", text, "reference") == ["fn", "deep", "fetchIt", "test", "other", "make", "go", "helper", "four", "compute", "f", "call"]


def test_java():
    text = """package a.b;
import java.util.*;
import static org.junit.Assert.assertEquals;
import java.util.List;
/** class Fake { } */
@Service("x{")
public final class D<T extends Comparable<T>> extends Base {
  private static final String S = "class X { \\" }";
  String block = \"\"\"
     void no() { "quoted" }
  \"\"\";
  char c = '{', d = '\\'';
  public D(int a) throws E { super(a); this.x = new Foo<>(a); }
  @Override
  @Deprecated(since = "1")
  public <R> Map<String, List<R>> size(
      int a, final String... more) throws IOException {
    return list.stream().map(x -> call(x));
  }
  abstract int[] later(int a);
  enum Kind { A(1), B(2) { int z() { return q(1); } }; Kind(int v) { use(v); } }
  record P(int x, int y) { P { check(x); } }
  interface Inner { void act(int a); }
  @interface Ann { int value() default 1; }
  Runnable r = new Runnable() { public void run() { new a.b.Bar(1); } };
}
"""
    assert found("java", text, "error") == []
    assert found("java", text, "import") == [("java.util", None), ("org.junit.Assert", ["assertEquals"]), ("java.util", ["List"])]
    assert found("java", text, "symbol") == [("D", "class", 7, 26), ("D", "method", 13, 13), ("size", "method", 16, 19), ("later", "method", 20, 20), ("Kind", "enum", 21, 21), ("z", "method", 21, 21), ("Kind", "method", 21, 21), ("P", "class", 22, 22), ("Inner", "interface", 23, 23), ("act", "method", 23, 23), ("run", "method", 25, 25)]
    assert found("java", text, "reference") == ["Foo", "stream", "map", "call", "q", "use", "check", "Runnable"]


@pytest.mark.parametrize("language,text,line,message", [
    ("rust", "fn a() {\n  b(;\n}\n", 2, "( is not closed"),
    ("rust", "fn a() {}\n/* /* */\n", 2, "a comment does not end"),
    ("rust", 'let s = "x;\n', 1, "a text does not end"),
    ("typescript", "f();\nconst a = `x ${y", 2, "a template does not end"),
    ("typescript", "if (a) {\n", 1, "{ is not closed"),
    ("java", "class A { ) }", 1, ") without ("),
])
def test_unbalanced_files_have_error_rows(language, text, line, message):
    rows = found(language, text, "error")
    assert any((r[3], r[6]) == (line, message) for r in rows), rows
    if text.startswith(("fn a() {}", "f()")):
        assert found(language, text, "symbol") or found(language, text, "reference")  # the rest counts


@pytest.mark.parametrize("language", list(scopes.GRAMMARS))
def test_any_text_ends_and_keeps_its_lines(language):
    rng = random.Random(language)
    bits = ["fn", "use", "class", "const", "function", "import", "type", "struct", "a", "b", "::", "=>", "=", "<", ">", "(", ")", "{", "}", "[", "]", ";", ",", "`", "${", "'", '"', "/*", "*/", "//", "\n", "#", "!", "\\", "é", "1.5", "@", "new", "|", ":", "."]
    for _ in range(400):
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(60)))
        lines = text.count("\n") + 1
        for row in scopes.GRAMMARS[language](text):
            assert 1 <= row[3] <= lines and (row[4] is None or row[3] <= row[4] <= lines), (text, row)

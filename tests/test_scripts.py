"""The script lexer: one fixture per form, and nothing from comments, strings, templates or patterns."""

import time

import pytest

from attesta.functions.codecs import script_symbols, script_tokens
from attesta.operators import extract_code


def found(text):
    return {(r["kind"], r["name"], r["form"]) for r in script_symbols(text)["rows"]}


def test_names_in_texts_do_not_count():
    text = r"""
// function a() {}
/* class B {} require('b')
   import x from 'c' */
const s = "function d() {}", t = 'it("x")';
const u = `class E {} ${ f(`function g() {}`) } import 'h'`;
const v = /function i\(\) {['"`]/g, w = 4 / 2 / 1;
describe_it.test('x'); a.require('k');
const z = `a ${ (() => { function inside() {} })() } b`;
"""
    assert found(text) == {("function", "inside", "declaration")}
    assert script_symbols(text)["tests"] is False


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("function a() {}", {("function", "a", "declaration")}),
        ("async function* a<T>(x: T): Promise<{ b: 1 }> { }", {("function", "a", "declaration")}),
        ("export default function a() {}", {("function", "a", "declaration")}),
        ("x(function a() {}); const b = function c() {};", {("function", "b", "expression")}),
        ("const a = (x) => x", {("function", "a", "arrow")}),
        ("const a: Fn<number> = async (x: { y: 1 } = { y: 1 }): Promise<void> => {}", {("function", "a", "arrow")}),
        ("let a = x => ({ b: 1 })", {("function", "a", "arrow")}),
        ("const a = <T,>(x: T) => x", {("function", "a", "arrow")}),
        ("const a = (1 + 2); var b = c;", set()),
        ("class A extends B.C<D> implements E { m() {} }", {("class", "A", "class")}),
        ("export abstract class A {}", {("class", "A", "class")}),
        ("import a, { b as c } from 'x'", {("import", "x", "import")}),
        ("import type { A } from \"./y\";\nimport './z'\nimport * as q from '../w'", {("import", "./y", "import"), ("import", "./z", "import"), ("import", "../w", "import")}),
        ("const { a } = require('x'); import('y'); import.meta.url", {("import", "x", "require")}),
        ("return /class A {}/.test(x)", set()),
        ("<p>don't</p>; function a() {}\n// it's", {("function", "a", "declaration")}),
        ("function outer() { function inner() {} }", {("function", "outer", "declaration"), ("function", "inner", "declaration")}),
        ("function broken( { class A {", {("function", "broken", "declaration"), ("class", "A", "class")}),
        ("", set()),
    ],
)
def test_forms(text, rows):
    assert found(text) == rows


def test_lines_bases_and_exports():
    text = "import 'x';\n\nexport class A extends ns.Base {\n  m() {\n  }\n}\n\nconst f = async (\n  x,\n) => {\n  return x;\n};\nfunction g() {\n}\nexport { f, g as h };\nexport default A;\ntest('x', () => { expect(1); });\n"
    got = script_symbols(text)
    rows = {r["name"]: (r["line"], r["last"], r["extends"], r["exported"]) for r in got["rows"]}
    assert rows == {"x": (1, 1, None, False), "A": (3, 6, "ns.Base", True), "f": (8, 12, None, True), "g": (13, 14, None, True)}
    assert got["tests"] and got["default"]


def test_the_first_form_of_a_name_wins(spark):
    files = spark.createDataFrame([("r", "a.ts", "const a = () => 1;\nfunction a() {}\nimport 'x';\nimport 'x';"), ("r", "b.js", None), ("r", "c.js", "// nothing")], "repo_id string, path string, content string")
    rows = sorted((r["path"], r["language"], r["kind"], r["name"], r["form"]) for r in extract_code.js_symbols(files).collect())
    assert rows == [("a.ts", "typescript", "function", "a", "declaration"), ("a.ts", "typescript", "import", "x", "import"), ("a.ts", "typescript", "import", "x", "import")]


@pytest.mark.parametrize("text", ["(" * 200_000, "`${" * 100_000, "/*" + "*" * 300_000, "'" * 200_000, "a" * 300_000, "const a: " * 50_000, "import " * 100_000, "class A extends " * 40_000, "function a" * 60_000, "/" * 200_000])
def test_hostile_texts_take_linear_time(text):
    started = time.time()
    script_symbols(text)
    script_tokens(text)
    assert time.time() - started < 20

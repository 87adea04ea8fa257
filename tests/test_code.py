"""Definitions, flows inside functions, and flows between them, with known values."""

import time

import pytest

from cairn.functions import code as code_
from cairn.functions import conventions, flows, scan
from cairn.operators import taint

TS = """import { a } from './helper';
import 'side';
/* class Nope {} */
export default class Svc extends Base<T> {
  private n: number = 3;
  constructor(private db: Db) { super(); }
  async findAll(q: string, { a, b }: Opts): Promise<{ x: number }> {
    const r = /[/}]+/g.test(q) ? `a ${q + fn({k: 1})} } b` : "}";
    return this.db.query(r);
  }
  delete(id) { }
}
interface Foo { bar(): void }
type U = { a: string } | null;
export const go = async (x: string, y = 3): Promise<void> => { await run(x); };
const lim = 5, other = 6;
const sq = x => x * x
function plain(a, ...rest) { return go(a) / 2; }
export async function* gen() { yield 1 }
function plain(again) {}
function open(a { call(
"""
GO = """package main
import (
    "os/exec"
    h "net/http"
)
import "fmt"
type S struct { a int }
type I interface { F() }
const Max = 3
var x = 1
// func no() {}
func (s *S) Do(a, b string, c ...int) (map[string]struct{}, error) {
	q := `raw } {`
	return s.run(q), nil
}
func handle(w http.ResponseWriter, r *http.Request) { doIt(r.FormValue("q")) }
func Gen[T any](x T) T { return x }
"""


def test_typescript_definitions():
    got = {r[1]: (r[2], r[3], r[4], r[5], r[7]) for r in scan.symbols("a.ts", TS)}
    assert got == {
        "Svc": ("class", 4, 12, None, ["test", "fn", "query"]),
        "findAll": ("method", 7, 10, "Svc", ["test", "fn", "query"]),
        "delete": ("method", 11, 11, "Svc", []),
        "Foo": ("interface", 13, 13, None, []),
        "U": ("type", 14, 14, None, []),
        "go": ("function", 15, 15, None, ["run"]),
        "lim": ("const", 16, 16, None, []),
        "sq": ("function", 17, 17, None, []),
        "plain": ("function", 18, 18, None, ["go"]),
        "gen": ("function", 19, 19, None, []),
        "open": ("function", 21, 21, None, [])  # its parameters never end,
    }
    src = scan.Source(TS, "ts")
    assert scan.imports(src) == [("./helper", "./helper"), ("side", "side")]
    assert {d.name: d.params for d in scan.definitions(src)}["findAll"] == [["q"], ["a", "b"]]


def test_go_definitions():
    got = {r[1]: (r[2], r[3], r[4], r[5], r[7]) for r in scan.symbols("a.go", GO)}
    assert got == {
        "S": ("class", 7, 7, None, []),
        "I": ("interface", 8, 8, None, []),
        "Max": ("const", 9, 9, None, []),
        "x": ("variable", 10, 10, None, []),
        "Do": ("method", 12, 15, "S", ["run"]),
        "handle": ("function", 16, 16, None, ["doIt", "FormValue"]),
        "Gen": ("function", 17, 17, None, []),
    }
    assert scan.imports(scan.Source(GO, "go")) == [("exec", "os/exec"), ("h", "net/http"), ("fmt", "fmt")]


def test_scanner_is_linear_and_takes_any_text():
    def took(part, lang, n):
        began = time.process_time()
        scan.symbols(f"a.{lang}", part * (n // len(part)))
        return time.process_time() - began

    for part in ("{", "(/", "`${", "a(b)=>{", "x = /[a", "import ", "class A {", "func f(", "'\\", "type a = ", "const a = (", "f(a, ", "}", "\x00\udcff"):
        for lang in ("ts", "go"):
            assert took(part, lang, 160_000) < 24 * max(took(part, lang, 20_000), 0.04), part
    assert scan.symbols("a.ts", "") == scan.symbols("a.go", "}}}") == []


def ends(path, code, kind="sink"):
    """(function, origin, callee, line) of the facts of a kind."""
    return {(r[3], r[6] if r[6] is None or r[6][0] != "r" else "r", r[8], r[11]) for r in flows.facts(path, code) if r[0] == kind}


@pytest.mark.parametrize(
    "path, code, want",
    [
        ("a.go", "package main\nfunc ProcessInput(userInput string) {\n\tcmdName := userInput\n\texec.Command(cmdName)\n}\n", {("ProcessInput", "p:0", "exec.Command", 4)}),
        ("a.go", "func f(s string) {\n\ts = \"x\"\n\texec.Command(s)\n}\n", set()),
        ("a.go", "func f(a, b string) {\n\tx, y := b, 1\n\texec.Command(y, x)\n}\n", {("f", "p:1", "exec.Command", 3)}),
        ("a.go", "func f(r *http.Request) {\n\tif q := r.FormValue(\"q\"); q != \"\" {\n\t\tdb.Query(q)\n\t}\n}\n", {("f", "source", "db.Query", 3), ("f", "p:0", "db.Query", 3), ("f", "r", "db.Query", 3)}),
        ("a.ts", "function processData(reqInput: string) {\n  const payload = reqInput;\n  eval(payload);\n}\n", {("processData", "p:0", "eval", 3)}),
        ("a.ts", "function f(x) {\n  let y = x\n  eval(y); y = 1; eval(y)\n}\n", {("f", "p:0", "eval", 3)}),
        ("a.ts", "function f({ a, b }) {\n  const { c } = b, d = 1\n  eval(d, c)\n}\n", {("f", "p:0", "eval", 3)}),
        ("a.js", "app.use((req, res) => { eval(req.query.x) })\n", {("(module)", "source", "eval", 1)}),
        ("a.py", "def f(p):\n    with wrap(1) as h, p as g:\n        eval(g)\n    eval(h)\n", {("f", "p:0", "eval", 3), ("f", "r", "eval", 4)}),
        ("a.py", "def f(p):\n    for a, b in p:\n        exec(b)\n", {("f", "p:0", "exec", 3)}),
        ("a.py", "def f(p):\n    if (n := p):\n        exec(n)\n", {("f", "p:0", "exec", 3)}),
        ("a.py", "def f(p):\n    z = ''\n    while p:\n        y = z\n        z = p\n    exec(y)\n", {("f", "p:0", "exec", 6)}),
        ("a.py", "def f(request):\n    eval([x for x in request.args])\n", {("f", "source", "eval", 2)}),
        ("a.py", "def f(p, q):\n    a, b = p, q\n    p = 1\n    eval(b + p)\n", {("f", "p:1", "eval", 4)}),
        ("a.py", "def f(:\n", set()),
        ("a.txt", "eval(request.x)", set()),
    ],
)
def test_flows_inside_a_function(path, code, want):
    assert ends(path, code) == want


def test_checks_that_functions_begin_with():
    go = "func (s *S) A(x []int) { if len(x) == 0 { return } }\nfunc B() error { return fmt.Errorf(\"x\") }\nfunc C() { if ok { go() } }\n"
    assert [g[3] for g in conventions.guards("a.go", go)] == [True, True, False]
    ts = "function a() { if (x) {} }\nconst b = async (x) => { throw new Error('no') }\nfunction c() { return 'if (x)' }"
    assert [(g[1], g[3]) for g in conventions.guards("a.tsx", ts)] == [("a", True), ("b", True), ("c", False)]


def test_python_flows_through_with_for_while_and_walrus():
    body = "def f(p):\n    with p as h:\n        eval(h)\n    for x in p:\n        eval(x)\n    if (n := p):\n        eval(n)\n    while go():\n        eval(y)\n        y = p\n"
    assert [(v, line) for _, _, v, _, line in code_.taint("a.py", body)] == [("h", 3), ("x", 5), ("n", 7), ("y", 9)]


FILES = [
    ("web/client.ts", "function send(request) {\n  const p = clean(request.query.q);\n  relay(p, 1);\n}\nfunction clean(x) { return x.trim(); }\nfunction drop(x) { return 'k'; }\nfunction safe(request) { relay(drop(request.query.z), 2); }\n"),
    ("svc/relay.go", "package svc\nfunc relay(s string, n int) {\n\tt := s\n\tif n > 0 { relay(t, n-1) }\n\tbackend(n, t)\n}\nfunc never(s string) { s = \"x\"; exec.Command(s) }\n"),
    ("srv/main.py", "class Job:\n    def work(self, cmd):\n        with wrap(cmd) as c:\n            os.system(c)\n\ndef backend(n, data=None):\n    for part in data.split():\n        Job().work(cmd=part)\n\ndef ask():\n    return input()\n\ndef main():\n    eval(ask())\n"),
    ("bad.py", "def (:"),
]


def test_three_files_two_boundaries_recursion_and_returns(spark):
    files = spark.createDataFrame(FILES, "path string, code string")
    got = {tuple(r) for r in taint.taint_flows(files).collect()}
    assert got == {
        ("web/client.ts", "send", "srv/main.py", "work", "system", 4, 3, "send>relay>backend>work"),
        ("srv/main.py", "main", "srv/main.py", "main", "eval", 14, 0, "main"),
    }
    assert {r["source_function"] for r in taint.taint_flows(files, depth=3).collect()} == {"main"}
    assert taint.taint_flows(files.limit(0)).count() == 0


def test_a_name_of_several_files_is_looked_up_in_its_own_first(spark):
    files = [("a.py", "def go(x):\n    return 1\n\ndef start(request):\n    go(request.args['q'])\n"), ("b.go", "func go1(x string) { exec.Command(x) }\n"), ("c.ts", "function go(x) { eval(x) }\n"), ("d.ts", "function other(request) { go(request.query.q) }\n")]
    got = {(r["source_path"], r["sink_path"], r["hops"]) for r in taint.taint_flows(spark.createDataFrame(files, "path string, code string")).collect()}
    assert got == {("d.ts", "c.ts", 1)}

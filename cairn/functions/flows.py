"""Facts about where values go inside each function of Python, TypeScript, JavaScript and Go files, in Arrow batches.

A fact says that a value of some origin reaches a target. Origins: `source` (outside input), `p:<k>` (what parameter k is
given), `r:<c>` (the result of call c). Targets: `return`, `sink` (an argument of a dangerous call), `arg` (argument of
call c, by place or name). Besides, each function has a `def` row with its parameters, and each call a `call` row. Whether a
call hands on what it is given isn't decided here: cairn.operators.taint joins the facts of all files.

Inside a function, names are followed in the order of statements. In Python branches merge by union, loops are gone through
twice, and names are bound by assignments, `with`, `for`, comprehensions and the walrus; in the other languages an
assignment ends what a name held before, as statements stand. Code outside functions is the function `(module)`. State
starts afresh in each function. Files with errors give no rows in Python; the scanner of the others reads any text.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame

from cairn.functions import scan
from cairn.functions.code import READERS, REQUESTS, SINKS, _dotted, _rows
from cairn.functions.code import symbols as python_symbols

# Lower-case parts of names that read outside input, and of calls that it must not reach.
TS_SOURCES = ("query", "body", "cookie", "request", "header", "params")
TS_SINKS = ("eval", "exec", "execsync", "spawn", "spawnsync", "run", "query", "execute")
GO_SOURCES = ("formvalue", "formfile", "query", "get", "cookie", "request", "header")
GO_SINKS = ("command", "exec", "query", "startprocess", "system", "eval", "rawsql")

SPEC = "kind string, path string, lang string, function string, start long, params array<string>, origin string, call string, callee string, arg long, name string, line long"
SOURCE = "source"
Origins = frozenset[str]
NONE: Origins = frozenset()


class _Function:
    """Collects the rows of one function, each once."""

    def __init__(self, path: str, lang: str, name: str, start: int, params: list[str]):
        self.head = (path, lang, name, start)
        self.rows = {("def", *self.head, tuple(params), None, None, None, None, None, start): None}

    def add(self, kind: str, origin=None, call=None, callee=None, arg=None, name=None, line=None) -> None:
        self.rows[(kind, *self.head, None, origin, call, callee, arg, name, line)] = None

    def called(self, call: str, callee: str, line: int, sink: bool, args) -> None:
        """args: place, name and origins of each argument."""
        self.add("call", call=call, callee=callee, line=line)
        for place, name, origins in args:
            for o in origins:
                if sink:
                    self.add("sink", o, call, callee, place, name, line)
                else:
                    self.add("arg", o, call, callee, place, name, line)


# ---- Python


class _Python(ast.NodeVisitor):
    """Statements in order; env holds the origins of each name and dotted name."""

    def __init__(self, into: _Function, env: dict[str, Origins]):
        self.into, self.env = into, env

    def origins(self, node: ast.AST | None) -> Origins:
        if node is None or isinstance(node, ast.Constant):
            return NONE
        if isinstance(node, ast.Name):
            return self.env.get(node.id, NONE)
        if isinstance(node, (ast.Attribute, ast.Subscript)):
            base = _dotted(node.value).lower()
            outside = base in REQUESTS or base.endswith((".request", ".req")) or base in ("sys.argv", "os.environ") or _dotted(node) in ("sys.argv", "os.environ")
            own = self.env.get(_dotted(node), NONE) | self.origins(node.value)
            return own | self.origins(getattr(node, "slice", None)) | (frozenset([SOURCE]) if outside else NONE)
        if isinstance(node, ast.Call):
            name = _dotted(node.func).rsplit(".", 1)[-1]
            args = [(k, None, self.origins(a)) for k, a in enumerate(node.args)] + [(None, a.arg, self.origins(a.value)) for a in node.keywords]
            call = f"{node.lineno}:{node.col_offset}:{node.end_col_offset}"
            self.into.called(call, name, node.lineno, name in SINKS, args)
            holder = self.origins(node.func.value) if isinstance(node.func, ast.Attribute) else NONE if isinstance(node.func, ast.Name) else self.origins(node.func)
            return holder | frozenset([f"r:{call}"]) | (frozenset([SOURCE]) if _dotted(node.func) in READERS else NONE)
        if isinstance(node, ast.NamedExpr):
            got = self.origins(node.value)
            self.bind(node.target, got)
            return got
        if isinstance(node, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            outer = dict(self.env)
            for g in node.generators:
                self.bind(g.target, self.origins(g.iter))
                for test in g.ifs:
                    self.origins(test)
            got = self.origins(node.key) | self.origins(node.value) if isinstance(node, ast.DictComp) else self.origins(node.elt)
            self.env = outer
            return got
        if isinstance(node, ast.Lambda):
            return NONE
        return NONE.union(*(self.origins(x) for x in ast.iter_child_nodes(node)))

    def bind(self, target: ast.AST, got: Origins, weak: bool = False) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            for x in target.elts:
                self.bind(x, got, weak)
        elif isinstance(target, ast.Starred):
            self.bind(target.value, got, weak)
        else:
            if isinstance(target, ast.Subscript):
                target, weak = target.value, True  # other items stay
            name = _dotted(target)
            if name:
                self.env[name] = got | (self.env.get(name, NONE) if weak else NONE)

    def visit_Assign(self, node):
        parts = [t for t in node.targets if isinstance(t, ast.Tuple)]
        if parts and isinstance(node.value, ast.Tuple) and all(len(t.elts) == len(node.value.elts) for t in parts) and len(parts) == len(node.targets):
            each = [self.origins(v) for v in node.value.elts]
            for t in parts:
                for x, got in zip(t.elts, each, strict=True):
                    self.bind(x, got)
            return
        got = self.origins(node.value)
        for t in node.targets:
            self.bind(t, got)

    def visit_AnnAssign(self, node):
        if node.value:
            self.bind(node.target, self.origins(node.value))

    def visit_AugAssign(self, node):
        self.bind(node.target, self.origins(node.value), weak=True)

    def visit_Expr(self, node):
        self.origins(node.value)

    def visit_Return(self, node):
        for o in self.origins(node.value):
            self.into.add("return", o, line=node.lineno)

    def _merge(self, *bodies: list[ast.stmt]) -> None:
        before, after = self.env, {}
        for body in bodies:
            self.env = dict(before)
            for n in body:
                self.visit(n)
            for k, v in self.env.items():
                after[k] = after.get(k, NONE) | v
        self.env = after

    def visit_If(self, node):
        self.origins(node.test)
        self._merge(node.body, node.orelse)

    def visit_Try(self, node):
        self._merge(node.body + node.orelse, *(h.body for h in node.handlers))
        for n in node.finalbody:
            self.visit(n)

    visit_TryStar = visit_Try

    def _loop(self, node, before) -> None:
        for _ in range(2):  # what one turn leaves, the next may use
            before()
            self._merge(node.body, [])
        for n in node.orelse:
            self.visit(n)

    def visit_While(self, node):
        self._loop(node, lambda: self.origins(node.test))

    def visit_For(self, node):
        self._loop(node, lambda: self.bind(node.target, self.origins(node.iter)))

    visit_AsyncFor = visit_For

    def visit_With(self, node):
        for item in node.items:
            got = self.origins(item.context_expr)
            if item.optional_vars:
                self.bind(item.optional_vars, got)
        for n in node.body:
            self.visit(n)

    visit_AsyncWith = visit_With

    def visit_Match(self, node):
        got = self.origins(node.subject)
        for case in node.cases:
            for x in ast.walk(case.pattern):
                name = getattr(x, "name", None) or getattr(x, "rest", None)
                if isinstance(name, str):
                    self.env[name] = got
        self._merge(*(case.body for case in node.cases), [])

    def visit_FunctionDef(self, node):  # a function of its own
        pass

    visit_AsyncFunctionDef = visit_ClassDef = visit_FunctionDef

    def generic_visit(self, node):
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.stmt):
                self.visit(x)
            else:
                self.origins(x)


def _python(path: str, code: str) -> list[tuple]:
    tree = ast.parse(code)
    out: list[tuple] = []
    module = _Function(path, "py", "(module)", 1, [])
    walk = _Python(module, {})
    for n in tree.body:
        walk.visit(n)
    out += module.rows
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = f.args
            names = [x.arg for x in [*a.posonlyargs, *a.args]]
            names += [a.vararg.arg] if a.vararg else []
            names += [x.arg for x in a.kwonlyargs] + ([a.kwarg.arg] if a.kwarg else [])
            into = _Function(path, "py", f.name, f.lineno, names)
            flow = _Python(into, {n: frozenset([f"p:{k}"]) for k, n in enumerate(names) if n not in ("self", "cls", *REQUESTS)})
            for n in f.body:
                flow.visit(n)
            out += into.rows
    return out


# ---- TypeScript, JavaScript, Go


class _Tokens:
    """One function's tokens in order."""

    def __init__(self, src: scan.Source, into: _Function, env: dict[str, Origins]):
        self.src, self.into, self.env = src, into, env
        self.ts = src.lang == "ts"
        self.sources, self.sinks = (TS_SOURCES, TS_SINKS) if self.ts else (GO_SOURCES, GO_SINKS)

    def _chain(self, i: int) -> tuple[list[str], int]:
        """Names of the dotted chain that begins at place i, and its last place."""
        names = [self.src.text(i)]
        while self.src.text(i + 1) in (".", "?.") and i + 2 < self.src.end and self.src.tokens[i + 2].kind == "id":
            i += 2
            names.append(self.src.text(i))
        return names, i

    def origins(self, lo: int, hi: int) -> Origins:
        src, out, i = self.src, set(), lo
        while i < hi:
            t = src.tokens[i]
            if t.kind != "id" or t.text in src.words:
                i += 1
                continue
            tail = src.text(i - 1) in (".", "?.") and i > lo  # of a call's result or the like
            names, last = self._chain(i)
            if not tail:
                for k in range(1, len(names) + 1):
                    out |= self.env.get(".".join(names[:k]), NONE)
            text, called = ".".join(names).lower(), src.text(last + 1) == "("
            if (called or (self.ts and (len(names) > 1 or tail))) and any(w in text for w in (*self.sources, *(("get",) if called and self.ts else ()))):
                out.add(SOURCE)
            if called:
                out.add(f"r:{last}")
                i = src.partner(last + 1)
            else:
                i = last
            i += 1
        return frozenset(out)

    def run(self, lo: int, hi: int, skip: dict[int, int]) -> None:
        """The statements between two places; skip: where a place begins another function, its end."""
        src, i, start = self.src, lo, lo
        pending: list[tuple[int, list[str], Origins, bool]] = []
        while i < hi or pending:
            while pending and pending[-1][0] <= i:
                _, names, got, weak = pending.pop()
                for n in names:
                    self.env[n] = got | (self.env.get(n, NONE) if weak else NONE)
            if i >= hi:
                if pending:
                    i = max(i, pending[-1][0])
                    continue
                break
            if i in skip:
                i = start = skip[i] + 1
                continue
            t = src.tokens[i]
            if i > lo and t.line > src.tokens[i - 1].line and src.text(i - 1) not in (",", "(", "=", ":="):
                start = i
            if t.kind == "op":
                if t.text in (";", "{", "}"):
                    start = i + 1
                elif t.text in ("=", ":=", "+="):
                    end = scan.statement_end(src, i + 1, hi)
                    while not self.ts and src.text(end) == "," and end < hi:
                        end = scan.statement_end(src, end + 1, hi)
                    names = self._targets(start, i)
                    made = self.ts and (src.text(i + 1) == "function" or any(src.text(k) == "=>" for k in range(i + 1, min(end, i + 2 + max(0, src.partner(i + 1) - i)))))
                    if names and not made:
                        pending.append((end, names, self.origins(i + 1, end), t.text == "+="))
                        pending.sort(key=lambda p: -p[0])
                    if self.ts and src.text(end) == ",":  # the next name that is declared
                        start = end + 1
            elif t.text in ("const", "let", "var") and src.text(i + 1) in ("{", "["):  # a pattern
                start, i = i, src.partner(i + 1)
            elif t.kind == "id" and t.text == "return":
                for o in self.origins(i + 1, self._value_end(i + 1, hi)):
                    self.into.add("return", o, line=t.line)
            elif scan.is_call(src, i):
                self._call(i)
            i += 1

    def _value_end(self, i: int, hi: int) -> int:
        end = scan.statement_end(self.src, i, hi)
        while self.src.text(end) == "," and end < hi:  # Go returns several values
            end = scan.statement_end(self.src, end + 1, hi)
        return end

    def _targets(self, lo: int, hi: int) -> list[str]:
        """What an assignment binds: names, dotted names, or all names of a pattern."""
        src = self.src
        while lo < hi and src.text(lo) in ("const", "let", "var", "if", "for", "switch", "(", "else"):
            lo += 1
        if src.text(lo) in ("{", "["):
            return [t.text for t in src.tokens[lo:hi] if t.kind == "id"]
        out = []
        for a, b in src.parts(lo, hi):
            if a < b and src.tokens[a].kind == "id":
                out.append(".".join(self._chain(a)[0]))
        return out

    def _call(self, i: int) -> None:
        src, first = self.src, i
        while src.text(first - 1) in (".", "?.") and first >= 2 and src.tokens[first - 2].kind == "id":
            first -= 2
        text = ".".join(t.text for t in src.tokens[first : i + 1] if t.kind == "id")
        sink = any(w in text.lower() for w in self.sinks)
        args = [(k, None, self.origins(lo, hi)) for k, (lo, hi) in enumerate(src.parts(i + 2, src.partner(i + 1)))]
        self.into.called(str(i), text if sink else src.text(i), src.line(i), sink, args)


def _tokens(path: str, code: str, lang: str) -> list[tuple]:
    src = scan.Source(code, lang)
    found = scan.definitions(src)
    bodies = [d for d in found if d.kind in ("function", "method") and d.body[0] < d.body[1]]
    skip = {d.start: d.end for d in found if d.kind != "const" and d.kind != "variable"}
    module = _Function(path, lang, "(module)", 1, [])
    _Tokens(src, module, {}).run(0, src.end, skip)
    out = [*module.rows]
    for d in bodies:
        into = _Function(path, lang, d.name, src.line(d.start), [",".join(names) for names in d.params])
        env = {n: frozenset([f"p:{k}"]) for k, names in enumerate(d.params) for n in names}
        _Tokens(src, into, env).run(d.body[0], d.body[1], {})
        if lang == "ts" and src.text(d.body[0] - 1) == "=>":  # an arrow's expression is what it returns
            for o in _Tokens(src, into, env).origins(*d.body):
                into.add("return", o, line=src.line(d.body[0]))
        out += into.rows
    return out


def facts(path: str, code: str) -> list[tuple]:
    """The rows of one file; none for other suffixes and for Python with errors."""
    lang = scan.language(path)
    if lang is None:
        return []
    if lang != "py":
        return _tokens(path, code, lang)
    try:
        return _python(path, code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def flow_facts(files: DataFrame) -> DataFrame:
    """files(path, code) → the facts of all files."""
    return _rows(files, facts, SPEC)


def symbols(path: str, code: str) -> list[tuple]:
    """(path, name, kind, start, end, parent, signature, calls) of a file's definitions, whatever its language."""
    lang = scan.language(path)
    if lang is None:
        return []
    if lang != "py":
        return scan.symbols(path, code)
    lines = code.split("\n")
    return [(p, name, kind, start, end, parent, lines[start - 1].strip()[:200], calls) for p, name, kind, start, end, parent, _, calls in python_symbols(path, code)]


def file_symbols(files: DataFrame) -> DataFrame:
    """files(path, code) → the definitions of all files."""
    return _rows(files, symbols, "path string, name string, kind string, start long, end long, parent string, signature string, calls array<string>")


def file_imports(files: DataFrame) -> DataFrame:
    """files(path, code) → path, alias, module of TypeScript, JavaScript and Go files."""

    def one(path: str, code: str) -> list[tuple]:
        lang = scan.language(path)
        return [(path, *r) for r in scan.imports(scan.Source(code, lang))] if lang in ("ts", "go") else []

    return _rows(files, one, "path string, alias string, module string")

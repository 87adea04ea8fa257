"""Python sources: symbols, taint flows and skeletons, a file at a time with the standard parser, in Arrow batches."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame

# Calls that taint must not reach, and names of requests.
SINKS = frozenset("eval exec execute system popen subprocess pickle yaml dumps loads serialize deserialize sql order_by explain StringAgg Trunc Extract KeyTransform RawSQL".split())
REQUESTS = ("request", "req")
READERS = ("input", "open")


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    return ""


def is_source(node: ast.AST) -> bool:
    """Whether an expression reads outside input: a request's attribute or item, argv, the environment, input or a file."""
    for x in ast.walk(node):
        base = _dotted(x.value).lower() if isinstance(x, (ast.Attribute, ast.Subscript)) else ""
        if base in REQUESTS or base.endswith((".request", ".req")) or base in ("sys.argv", "os.environ"):
            return True
        if isinstance(x, ast.Attribute) and _dotted(x) in ("sys.argv", "os.environ"):
            return True
        if isinstance(x, ast.Call) and _dotted(x.func) in READERS:
            return True
    return False


def symbols(path: str, code: str) -> list[tuple]:
    """(path, name, kind, start, end, parent, is_source, calls) of a file's classes and functions; none if it has errors."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    todo: list[tuple[ast.AST, str | None, bool]] = [(n, None, False) for n in tree.body]
    while todo:
        node, parent, in_class = todo.pop(0)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            calls = sorted({_dotted(c.func).rsplit(".", 1)[-1] for c in ast.walk(node) if isinstance(c, ast.Call)} - {""})
            out.append((path, node.name, "method" if in_class else "function", node.lineno, node.end_lineno, parent, is_source(node), calls))
            todo += [(n, node.name, False) for n in node.body]
        elif isinstance(node, ast.ClassDef):
            out.append((path, node.name, "class", node.lineno, node.end_lineno, parent, False, []))
            todo += [(n, node.name, True) for n in node.body]
        elif isinstance(node, (ast.If, ast.Try, ast.With)):
            todo += [(n, parent, in_class) for n in ast.iter_child_nodes(node) if isinstance(n, ast.stmt)]
    return out


class _Flow(ast.NodeVisitor):
    """Names that hold outside input, in the order of statements; branches merge by union."""

    def __init__(self, tainted: set[str]):
        self.tainted, self.hits = tainted, []

    def dirty(self, node: ast.AST) -> str | None:
        if is_source(node):
            return _dotted(node) or "input"
        for x in ast.walk(node):
            if isinstance(x, ast.Name) and x.id in self.tainted:
                return x.id
        return None

    def _assign(self, targets, value) -> None:
        self.visit(value)
        bad = self.dirty(value)
        for t in targets:
            for x in ast.walk(t):
                if isinstance(x, ast.Name):
                    (self.tainted.add if bad else self.tainted.discard)(x.id)

    def visit_Assign(self, node):
        self._assign(node.targets, node.value)

    def visit_AnnAssign(self, node):
        if node.value:
            self._assign([node.target], node.value)

    def visit_AugAssign(self, node):
        self.visit(node.value)
        if self.dirty(node.value) and isinstance(node.target, ast.Name):
            self.tainted.add(node.target.id)

    def _branches(self, *bodies) -> None:
        before, after = set(self.tainted), set()
        for body in bodies:
            self.tainted = set(before)
            for n in body:
                self.visit(n)
            after |= self.tainted
        self.tainted = after

    def visit_If(self, node):
        self.visit(node.test)
        self._branches(node.body, node.orelse)

    def visit_Try(self, node):
        self._branches(node.body + node.orelse, *[h.body for h in node.handlers])
        for n in node.finalbody:
            self.visit(n)

    def visit_NamedExpr(self, node):
        self._assign([node.target], node.value)

    def visit_With(self, node):
        for item in node.items:
            if item.optional_vars is None:
                self.visit(item.context_expr)
            else:
                self._assign([item.optional_vars], item.context_expr)
        for n in node.body:
            self.visit(n)

    visit_AsyncWith = visit_With

    def _loop(self, node, before) -> None:
        for _ in range(2):  # what one turn leaves, the next may use
            before()
            self._branches(node.body, [])
        for n in node.orelse:
            self.visit(n)

    def visit_While(self, node):
        self._loop(node, lambda: self.visit(node.test))

    def visit_For(self, node):
        self._loop(node, lambda: self._assign([node.target], node.iter))

    visit_AsyncFor = visit_For

    def visit_Call(self, node):
        name = _dotted(node.func).rsplit(".", 1)[-1]
        if name in SINKS:
            for a in [*node.args, *(k.value for k in node.keywords)]:
                bad = self.dirty(a)
                if bad:
                    self.hits.append((bad, name, node.lineno))
        self.generic_visit(node)

    def visit_FunctionDef(self, node):  # nested functions are traced on their own
        pass

    visit_AsyncFunctionDef = visit_FunctionDef


def taint(path: str, code: str, parameters: bool = True) -> list[tuple]:
    """(path, function, variable, sink, line) where outside input, or a parameter, reaches a sink. State starts afresh in
    each function."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            names = [a.arg for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]]
            flow = _Flow(set(names) - {"self", "cls", *REQUESTS} if parameters else set())
            for n in f.body:
                flow.visit(n)
            out += [(path, f.name, v, s, line) for v, s, line in dict.fromkeys(flow.hits)]
    return out


def names_used(path: str, code: str) -> list[tuple]:
    """(path, name, used) of a file's functions, classes and assigned names at the top level, for each name that they read;
    used is null in a row of its own for each definition. Of equal names the last definition counts; none if the file has
    errors."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    defined: dict[str, ast.AST] = {}
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            defined[node.name] = node
        elif isinstance(node, ast.Assign):
            defined |= {t.id: node for t in node.targets if isinstance(t, ast.Name)}
    out = []
    for name, node in defined.items():
        read = sorted({x.id for x in ast.walk(node) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)})
        out += [(path, name, used) for used in [None, *read]]
    return out


def skeleton(code: str) -> str:
    """The file with function bodies reduced to their docstring and `...`; unchanged if it has errors."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return code
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            doc = f.body[:1] if ast.get_docstring(f, clean=False) is not None else []
            f.body = [*doc, ast.Expr(ast.Constant(...))]
    return ast.unparse(tree)


def _rows(files: DataFrame, of, spec: str) -> DataFrame:
    """files(path, code) through a function of one file."""
    names = [s.split()[0] for s in spec.split(", ")]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [r for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in of(p, c or "")]
            if rows:
                kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[s.split()[1]]) for c, s in zip(zip(*rows, strict=True), spec.split(", "), strict=True)], names)

    return files.select("path", "code").mapInArrow(run, spec)


def extract_symbols(files: DataFrame) -> DataFrame:
    return _rows(files, symbols, "path string, name string, kind string, start long, end long, parent string, is_source boolean, calls array<string>")


def python_taint(files: DataFrame) -> DataFrame:
    return _rows(files, taint, "path string, function string, variable string, sink string, line long")


def name_uses(files: DataFrame) -> DataFrame:
    return _rows(files, names_used, "path string, name string, used string")


def skeletonize(files: DataFrame) -> DataFrame:
    return _rows(files, lambda p, c: [(p, skeleton(c))], "path string, code string")

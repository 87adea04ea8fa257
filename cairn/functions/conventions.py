"""What a file's functions have in common, assets of language models, and diffs applied to texts."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import scan
from cairn.functions.code import _rows

# Module prefixes of model libraries, words of human gates and of prompts.
FRAMEWORKS = ("openai", "anthropic", "langchain", "llama_index", "transformers", "vllm", "ollama", "google.generativeai", "litellm")
GATES = ("confirm", "approve", "review", "human_override", "manual_approval", "wait_for_user", "ask_user", "ask_permission", "user_confirmation", "hitl", "human_in_the_loop", "override_gate")
PROMPTS = ("prompt", "system_message", "instruction")

#: Tokens of a body in which a check counts as one that the function begins with.
OPENING = 80


def _checked(src: scan.Source, lo: int, hi: int) -> bool:
    """Whether a body's opening tests what it is given: in Go an `if` on nil or a length, or an error that is made; in
    TypeScript an `if`, or an error that is thrown."""
    words = [src.text(i) for i in range(lo, min(hi, lo + OPENING))]
    after = list(zip(words, words[1:]))
    if src.lang == "ts":
        return ("if", "(") in after or ("throw", "new") in after
    tests = [words[k + 1 : next((j for j in range(k, len(words)) if words[j] == "{"), len(words))] for k, w in enumerate(words) if w == "if"]
    return any("nil" in t or ("len" in t and "(" in t) for t in tests) or ("errors", "New") in zip(words, words[2:]) or ("fmt", "Errorf") in zip(words, words[2:])


def guards(path: str, code: str) -> list[tuple]:
    """(path, name, prefix, guarded) of a file's functions: whether one begins by checking what it is given."""
    out = []
    if path.endswith(".py"):
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        for f in ast.walk(tree):
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                checks = (n for s in f.body if isinstance(s, (ast.Assert, ast.If)) for n in ast.walk(s.test))
                out.append((f.name, any(isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "isinstance" for n in checks)))
    else:
        lang = scan.language(path)
        src = scan.Source(code, lang if lang == "go" else "ts")
        kinds = ("function", "method") if lang == "go" else ("function",)
        out = [(d.name, _checked(src, *d.body)) for d in scan.definitions(src) if d.kind in kinds]
    return [(path, n, re.split(r"_|(?<=[a-z])(?=[A-Z])", n.lstrip("_"))[0].lower(), g) for n, g in out]


def unguarded(files: DataFrame, least: int = 3, share: float = 0.7) -> DataFrame:
    """files(path, code) → path, name of functions without the guard that most of the file, or of their prefix, has."""
    rows = _rows(files, guards, "path string, name string, prefix string, guarded boolean")
    file, group = Window.partitionBy("path"), Window.partitionBy("path", "prefix")
    most = lambda w: (F.count("*").over(w) >= least) & (F.avg(F.col("guarded").cast("int")).over(w) >= share)
    return rows.withColumn("usual", most(file) | most(group)).where("usual AND NOT guarded").select("path", "name")


def assets(path: str, code: str) -> list[tuple]:
    """(path, kind, name): model libraries, prompts and human gates of a Python file."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = set()
    for n in ast.walk(tree):
        modules = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module] if isinstance(n, ast.ImportFrom) and n.module else []
        out |= {("framework", f) for m in modules for f in FRAMEWORKS if m == f or m.startswith(f + ".")}
        if isinstance(n, ast.Assign):
            out |= {("prompt", t.id) for t in n.targets if isinstance(t, ast.Name) and any(w in t.id.lower() for w in PROMPTS)}
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and any(w in n.name.lower() for w in GATES):
            out.add(("gate", n.name))
        if isinstance(n, ast.Call):
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else ""
            if any(w in name.lower() for w in GATES):
                out.add(("gate", name))
    return [(path, k, v) for k, v in sorted(out)]


def ai_assets(files: DataFrame) -> DataFrame:
    return _rows(files, assets, "path string, kind string, name string")


def apply_diff(text: str, diff: str) -> str:
    """text with the hunks of a unified diff applied from the last to the first; context isn't compared."""
    lines, hunks = text.split("\n"), []
    for row in diff.split("\n"):
        m = re.match(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@", row)
        if m:
            hunks.append((int(m[1]), 1 if m[2] is None else int(m[2]), []))
        elif hunks and row[:1] in ("+", " ") and not row.startswith("+++"):
            hunks[-1][2].append(row[1:])
    for start, n, new in reversed(hunks):
        at = start - 1 if n else start
        lines[at : at + n] = new
    return "\n".join(lines)


def patched(files: DataFrame) -> DataFrame:
    """files(path, code, diff) → path, code."""
    both = files.select("path", F.to_json(F.struct("code", "diff")).alias("code"))

    def one(path: str, packed: str) -> list[tuple]:
        import json

        x = json.loads(packed)
        return [(path, apply_diff(x.get("code") or "", x.get("diff") or ""))]

    return _rows(both, one, "path string, code string")


def import_chase(scored: DataFrame, imports: DataFrame, lift: float = 1.3) -> DataFrame:
    """scored(id, name, file, is_test, score), imports(file, name) → id, score: what tests import is raised, to 1 at most."""
    wanted = scored.where("is_test").select("file").distinct().join(imports, "file").select("name").distinct().withColumn("up", F.lit(True))
    raised = F.when(F.col("up"), F.least(F.lit(1.0), lift * F.col("score"))).otherwise(F.col("score"))
    return scored.join(wanted, "name", "left").select("id", F.round(raised, 6).alias("score"))

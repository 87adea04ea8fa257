"""Hunks, blame, containment and mentions against plain replays."""

import random

from cairn.operators import audit, blame, contain
from cairn.sources import history


def replay(hunks):
    """Lines as lists, a commit after the other: {file: [commit of each line]}."""
    files = {}
    for file, _, commit, changes in hunks:
        lines = files.setdefault(file, [])
        for start, gone, new in sorted(changes, reverse=True):
            first = start - 1 if gone else start
            lines[first : first + gone] = [commit] * new
    return files


def runs(files):
    out = set()
    for file, lines in files.items():
        at = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or lines[i] != lines[at]:
                out.add((file, at + 1, i, lines[at]))
                at = i
    return out


def made(rnd, files, commits):
    length, out = dict.fromkeys(files, 0), []
    for c in range(commits):
        for file in rnd.sample(files, min(len(files), rnd.randint(1, 2))):
            changes, at = [], 0
            for _ in range(rnd.randint(1, 4)):
                start = rnd.randint(at, max(at, length[file]))
                gone = rnd.randint(0, min(4, length[file] - start)) if start < length[file] else 0
                new = rnd.randint(0 if gone else 1, 5)
                changes.append((start + 1 if gone else start, gone, new))
                at = start + gone + 1
                if at > length[file]:
                    break
            length[file] += sum(n - g for _, g, n in changes)
            out.append((file, c, f"c{c}", changes))
    return out


def test_patches_compose_in_any_grouping():
    rnd = random.Random(1)
    for _ in range(150):
        hunks = made(rnd, ["f"], 12)
        patches = [blame.patch(c, changes) for _, _, c, changes in hunks]
        while len(patches) > 1:
            k = rnd.randrange(len(patches) - 1)
            patches[k : k + 2] = [blame.compose(patches[k], patches[k + 1])]
        lines = [c for c, _, n in patches[0] if c is not None for _ in range(n)]
        assert lines == replay(hunks).get("f", [])


def test_blame_like_a_replay(spark):
    rnd = random.Random(2)
    hunks = made(rnd, ["hot", "a", "b", "c"], 120) + [("hot", 200 + k, f"h{k}", [(k % 3, 0, 1)]) for k in range(150)]
    rows = [(f, at, c, *h) for f, at, c, changes in hunks for h in changes]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows + rows[:3], "file string, at int, commit string, old_start int, old_lines int, new_lines int")
    got = {tuple(r) for r in blame.blame(df).collect()}
    want = runs(replay(hunks))
    assert got == want
    assert blame.blame(df.limit(0)).count() == 0
    symbols = spark.createDataFrame([("hot", "s", 2, 40), ("a", "t", 1, 1), ("zzz", "u", 1, 9)], "file string, symbol string, start long, end long")
    lines = replay(hunks)
    near = {("hot", "s", c) for c in lines["hot"][1:16]} | {("a", "t", c) for c in lines["a"][:1]}
    assert {tuple(r) for r in blame.commits_of(blame.blame(df), symbols).collect()} == near
    before = spark.createDataFrame([("old", 1, "x", 10, 2, 1)], "file string, at int, commit string, old_start int, old_lines int, new_lines int")
    assert [tuple(r) for r in blame.blame(before).collect()] == [("old", 10, 10, "x")]


def test_blame_composes_patches_where_it_makes_them(spark):
    df = spark.createDataFrame([("f", 1, "x", 0, 0, 3), ("f", 2, "y", 2, 1, 1)], "file string, at int, commit string, old_start int, old_lines int, new_lines int")
    made = blame.blame(df)
    # the range's sample and its exchange carry hunks, no patches
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert {tuple(r) for r in made.collect()} == {("f", 1, 1, "x"), ("f", 2, 2, "y"), ("f", 3, 3, "x")}


def test_hunk_log(spark):
    text = "ab1|2024-01-02|Ann|Fix: a | b\n\ndiff --git a/x.py b/y.py\nrename to y.py\n--- a/x.py\n+++ b/y.py\n@@ -3 +3,2 @@ def f\n-+++ b/no.py\n+@@ -9 +9 @@\n@@ -7,0 +9 @@\n+x\ndiff --git a/z b/z\ndeleted file\n--- a/z\n+++ /dev/null\n@@ -1,4 +0,0 @@\n-a\ndiff --git a/i.png b/i.png\nBinary files differ\n"
    got = [tuple(r) for r in history.hunk_log(spark.createDataFrame([(text,), ("cd2|2024-01-03|Bo|empty",), (None,)], "value string")).collect()]
    head = ("ab1", "2024-01-02", "Ann", "Fix: a | b")
    assert got == [(*head, "y.py", 3, 1, 3, 2), (*head, "y.py", 7, 0, 9, 1), (*head, "z", 1, 4, 0, 0)]


def test_containment_like_brute_force(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcÀé/.") for _ in range(n))
    texts = [word(rnd.randint(0, 30)) for _ in range(200)] + ["ABCabc", None, "", "%_\\"]
    needles = [word(rnd.randint(1, 6)) for _ in range(60)] + ["CAB", "", None, "_\\", "%", "zzzzzz", texts[3] * 2 or "q"]
    t, n = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in needles], "needle string")
    for fold in (False, True):
        shape = str.lower if fold else str
        want = {(a, b) for a in texts if a for b in needles if b and shape(b) in shape(a)}
        got = contain.contains_join(t, n, fold)
        assert {tuple(r) for r in got.collect()} == want
        assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert contain.contains_join(t.limit(0), n).count() == contain.contains_join(t, n.limit(0)).count() == 0


def test_mentions(spark):
    code = "# see ADR-12\n\ndef f():  # hotspot\n    pass\nclass C:\n    x = 1\n    y = 'do not  touch'\n\n\n# decision:no-cache for all\nz = 1\n\ndef g():\n    pass\n"
    files = spark.createDataFrame([("a.py", code), ("b.go", "// ADR-3 and adr-4\n"), ("bad.py", "# ADR-9\ndef (")], "path string, code string")
    found = [tuple(r) for r in audit.mentions(files).orderBy("path", "line").collect()]
    assert found == [("a.py", 1, "ADR-12", "see ADR-12"), ("a.py", 3, "HOTSPOT", "hotspot"), ("a.py", 7, "DO NOT TOUCH", "y = 'do not  touch'"), ("a.py", 10, "DECISION:NO-CACHE", "decision:no-cache for all"), ("b.go", 1, "ADR-3", "ADR-3 and adr-4"), ("bad.py", 1, "ADR-9", "ADR-9")]
    symbols = spark.createDataFrame([("a.py", "f", "function", 3, 4), ("a.py", "C", "class", 5, 7), ("a.py", "g", "function", 13, 14), ("b.go", "h", "function", 2, 3)], "path string, symbol string, kind string, start long, end long")
    links = audit.mention_links(files, symbols)
    assert {tuple(r)[:3] for r in links.collect()} == {("f", "mention", "ADR-12"), ("f", "mention", "HOTSPOT"), ("C", "mention", "DO NOT TOUCH"), ("g", "mention", "DECISION:NO-CACHE"), ("b.go", "mention", "ADR-3"), ("bad.py", "mention", "ADR-9")}
    old = spark.createDataFrame([("gone", "mention", "ADR-1", 0.95, ""), ("f", "commit", "ab", 0.8, "")], links.schema)
    assert audit.rebuilt(old, links).where("symbol = 'gone'").count() == 0 and audit.rebuilt(old, links).count() == 7


def test_imports(spark):
    from cairn.operators import imports

    files = ["web/a.ts", "web/b/index.tsx", "web/b/c.js", "web/types.d.ts", "lib/x/util.py", "app/x/util.py", "app/x/__init__.py", "app/main.py", "app/x/deep/m.py", "go/pkg/auth.go", "x.ts"]
    asked = [("web/a.ts", "./b"), ("web/a.ts", "./b/c.js"), ("web/b/c.js", "../a"), ("web/b/c.js", ".."), ("web/a.ts", "./types"), ("web/a.ts", "./gone"), ("web/a.ts", "react"), ("app/main.py", "x.util"), ("lib/x/util.py", "util"), ("app/x/deep/m.py", "..util"), ("app/x/deep/m.py", "x"), ("x.ts", "@/web/a"), ("x.ts", "../../x"), ("go/main.go", "pkg/auth"), ("x.ts", None), ("x.ts", "")]
    got = imports.resolve(spark.createDataFrame(asked + asked[:1], "path string, module string"), spark.createDataFrame([(f,) for f in files] + [("x.ts",), (None,)], "path string"))
    assert {tuple(r) for r in got.collect()} == {
        ("web/a.ts", "./b", "web/b/index.tsx"), ("web/a.ts", "./b/c.js", "web/b/c.js"), ("web/b/c.js", "../a", "web/a.ts"), ("web/a.ts", "./types", "web/types.d.ts"), ("app/main.py", "x.util", "app/x/util.py"),
        ("lib/x/util.py", "util", "app/x/util.py"), ("app/x/deep/m.py", "..util", "app/x/util.py"), ("app/x/deep/m.py", "x", "app/x/__init__.py"), ("x.ts", "@/web/a", "web/a.ts"), ("go/main.go", "pkg/auth", "go/pkg/auth.go"),
    }
    assert imports.resolve(spark.createDataFrame(asked, "path string, module string").limit(0), spark.createDataFrame([(f,) for f in files], "path string")).count() == 0


def test_tree_skips_folders_below_its_root_only(spark, tmp_path):
    root = tmp_path / "build" / "repo"
    for name in ("a.py", "vendor/b.py", "src/target/c.go", "src/d.ts", "docs/e.py", "src/f.min.js", "src/g.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x\n")
    got = {r["path"].split("/repo/")[1] for r in history.source_tree(spark, str(root)).collect()}
    assert got == {"a.py", "src/d.ts"}


def test_scoped_context_keeps_the_most_confident_of_a_ref(spark):
    links = spark.createDataFrame([("s", "f", "r", 0.5, "low"), ("s", "f", "r", 0.9, "z"), ("s", "f", "r", 0.9, "a"), ("t", "g", "r", 1.0, "")], "symbol string, file string, ref string, confidence double, description string")
    got = audit.scoped_context(links, spark.createDataFrame([("f",)], "file string")).collect()
    assert [tuple(r) for r in got] == [("s", "f", "r", 0.9, "a")]

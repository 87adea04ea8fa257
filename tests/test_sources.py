"""Git history as a data source, dependency closure and quantised links against plain versions."""

import random
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import code
from cairn.operators import closure, quantise
from cairn.sources.git import GitHistory


def run(repo, *args, at="2024-01-01T00:00:00Z"):
    env = {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at, "HOME": str(repo), "PATH": "/usr/bin:/bin:/usr/local/bin"}
    own = ["-c", "user.name=A B", "-c", "user.email=a@example.org", "-c", "commit.gpgsign=false"]
    return subprocess.run(["git", "-C", str(repo), *own, *args], check=True, capture_output=True, text=True, env=env).stdout.strip()


def commit(repo, message, day, **files):
    for name, text in files.items():
        (repo / f"{name}.py").write_text(text)
    run(repo, "add", "-A")
    run(repo, "commit", "-q", "--allow-empty", "-m", message, at=f"2024-01-{day:02d}T10:00:00Z")
    return run(repo, "rev-parse", "HEAD")


@pytest.fixture
def repo(tmp_path, spark):
    spark.dataSource.register(GitHistory)
    run(tmp_path, "init", "-q")
    commit(tmp_path, "first | bar\n\nwhy: because\n\ntwo", 1, a="1\n2\n3\n", b="x\n")
    commit(tmp_path, "second", 2, a="1\n+++ b/zzz\n@@ -9 +9 @@\n3\n")
    (tmp_path / "b.py").rename(tmp_path / "c d.py")
    commit(tmp_path, "moved", 3)
    (tmp_path / "c d.py").unlink()
    commit(tmp_path, "gone", 4)
    return tmp_path


def load(spark, repo, **options):
    return spark.read.format("git_history").options(**{"repo": str(repo), "now": "2024-01-05"} | options).load()


def test_commits_in_ranges(spark, repo):
    want = ["first | bar", "gone", "moved", "second"]
    for size in (1, 3, 100):
        found = load(spark, repo, rangesize=size)
        assert sorted(r.subject for r in found.collect()) == want
        assert found.rdd.getNumPartitions() == -(-4 // size)
    first = found.where("subject LIKE 'first%'").collect()[0]
    assert first.body == "first | bar\n\nwhy: because\n\ntwo" and first.author == "A B" and len(first.hash) == 40
    assert load(spark, repo).where("at < '2024-01-02'").count() == 1


def test_windows(spark, repo):
    assert load(spark, repo, days=2).count() == 2
    assert load(spark, repo, now="2030-01-01", days=90, most=3).count() == 3  # no commit in those days: the newest
    assert load(spark, repo, rows="hunks", days=2).count() == 4  # hunks ask for ten commits
    assert load(spark, repo, revisions="HEAD~2..HEAD").count() == 2


def test_hunks_are_those_of_headers_only(spark, repo):
    rows = load(spark, repo, rows="hunks").select("subject", "file", "old_start", "old_lines", "start", "lines").collect()
    assert {tuple(r) for r in rows} == {
        ("first | bar", "a.py", 0, 0, 1, 3), ("first | bar", "b.py", 0, 0, 1, 1), ("second", "a.py", 2, 1, 2, 2), ("gone", "c d.py", 1, 1, 0, 0)
    } and len(rows) == 4


def test_files_and_changes(spark, repo):
    rows = load(spark, repo, rows="files").select(F.dayofmonth("at").alias("d"), "file").collect()
    assert {(1, "a.py"), (1, "b.py"), (2, "a.py"), (3, "c d.py"), (4, "c d.py")} <= {tuple(r) for r in rows}
    assert {r.path for r in load(spark, repo, rows="changed", revisions="HEAD~3..HEAD").collect()} == {"a.py", "b.py"}
    assert {r.subject for r in load(spark, repo, file="c d.py", revisions="HEAD~1").collect()} == {"moved", "first | bar"}


def test_errors_are_raised(spark, repo):
    with pytest.raises(Exception, match="nowhere"):
        load(spark, repo, revisions="nowhere").collect()


def test_stream_goes_on_from_its_last_commit(spark, repo):
    def batch():
        rows = spark.readStream.format("git_history").option("repo", str(repo)).load()
        q = rows.writeStream.format("parquet").option("path", f"{repo}.out").option("checkpointLocation", f"{repo}.check").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.subject for r in spark.read.parquet(f"{repo}.out").collect())

    assert batch() == ["first | bar", "gone", "moved", "second"]
    commit(repo, "later", 6, a="9\n")
    assert batch() == ["first | bar", "gone", "later", "moved", "second"]
    assert batch() == ["first | bar", "gone", "later", "moved", "second"]


def walked(edges, initial):
    out = set(initial)
    todo = list(initial)
    while todo:
        path, name = todo.pop()
        for p, a, b in edges:
            if (p, a) == (path, name) and (p, b) not in out:
                out.add((p, b))
                todo.append((p, b))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closure_is_that_of_a_walk(spark, seed):
    rnd = random.Random(seed)
    edges = {(p, f"n{rnd.randrange(18)}", f"n{rnd.randrange(18)}") for p in "xyz" for _ in range(8 + 9 * seed)}
    edges |= {("chain", f"n{k:02d}", f"n{k + 1:02d}") for k in range(20)} | {("ring", f"n{k:02d}", f"n{(k + 1) % 13:02d}") for k in range(13)}
    names = {(p, n, None) for p, a, b in edges for n in (a, b)}
    initial = [("x", "n1"), ("x", "n1"), ("y", "n2"), ("y", "n3"), ("chain", "n05"), ("ring", "n07"), ("none", "n1"), ("x", None), (None, "n1")]
    uses = spark.createDataFrame([*edges, *names, ("x", "n1", "undefined"), ("x", "self", None), ("x", "n1", "self")], "path string, name string, used string")
    got = closure.dependency_closure(uses, spark.createDataFrame(initial, "path string, name string")).collect()
    assert {tuple(r) for r in got} == walked(edges, {i for i in initial if None not in i}) and len(got) == len(set(got))


def test_closure_of_nothing(spark):
    uses = spark.createDataFrame([], "path string, name string, used string")
    assert closure.dependency_closure(uses, uses.select("path", "name")).count() == 0


def test_names_used():
    text = "A = 1\nB = A\ndef f(x):\n    return g(x) + B\nasync def g(y):\n    y = 2\nclass K(Base):\n    z = f\ndef A():\n    return K\n"
    assert [r[1:] for r in code.names_used("p", text)] == [
        ("A", None), ("A", "K"), ("B", None), ("B", "A"), ("f", None), ("f", "B"), ("f", "g"), ("f", "x"), ("g", None), ("K", None), ("K", "Base"), ("K", "f")
    ]
    assert code.names_used("p", "def (") == []


@pytest.fixture(scope="module")
def close(spark):
    """Forty groups of vectors around a direction each, one of them with a third of all."""
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(40, 32))
    group = np.where(rnd.random(1500) < 0.33, 0, rnd.integers(0, 40, 1500))
    m = base[group] + rnd.normal(size=(1500, 32)) * rnd.choice([0.2, 0.45, 0.7], 1500)[:, None]
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    cos = m[::20].astype(float) @ m.T.astype(float)
    want = {(q * 20, v): round(float(c), 6) for q, r in enumerate(cos) for v, c in enumerate(r) if round(float(c), 6) >= 0.72}
    return spark.createDataFrame([*rows, (9999, None)], "id long, embedding array<float>").repartition(4), want


@pytest.mark.parametrize("lot", [2048, 7])
def test_quantised_links_lose_nothing_without_probes(spark, close, lot, monkeypatch):
    monkeypatch.setattr(quantise, "LOT", lot)
    vectors, want = close
    chunks = vectors.where("id % 20 = 0").selectExpr("id AS chunk", "embedding AS c")
    for cells in (1, 60)[: 1 + (lot > 7)]:
        got = quantise.semantic_links(chunks, vectors, cells=cells).collect()
        assert {(r.chunk, r.id) for r in got} == set(want) and len(got) == len(want)
        assert all(abs(r.confidence - min(0.75, max(0.55, 0.85 * want[r.chunk, r.id]))) < 2e-5 for r in got)


def test_probes_keep_nine_links_of_ten(spark, close):
    vectors, want = close
    chunks = vectors.where("id % 20 = 0").selectExpr("id AS chunk", "embedding AS c")
    links = quantise.semantic_links(chunks, vectors, cells=60, probes=12)
    got = {(r.chunk, r.id) for r in links.collect()}
    assert got <= set(want)
    print("recall", len(got) / len(want), len(want))
    assert len(got) >= 0.9 * len(want)
    assert "NestedLoop" not in links._jdf.queryExecution().toString()


def test_links_of_nothing(spark, close):
    vectors, _ = close
    none = vectors.limit(0)
    chunks = vectors.selectExpr("id AS chunk", "embedding AS c")
    assert quantise.semantic_links(chunks, none).count() == 0
    assert quantise.semantic_links(chunks.limit(0), vectors).count() == 0

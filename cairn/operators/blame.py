"""The commit that each line of a file has last been written by, from the hunks of its history alone.

A commit changes a file by a patch: which of the old lines stay, and what stands between them. Patches compose, and the
composition is associative: a run of a file's commits becomes one patch from the state before it to the state after it. So
a file's history need not be in one task: rows are ranged over tasks by file and time, each task composes the runs that it
holds, and a second pass composes the runs of each file, of which there are at most as many as tasks. Memory is one patch:
a segment for each piece of the file that one commit wrote, not its history.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The last line that a patch speaks of.
END = 1 << 40
#: A segment: (commit, first line, lines); without a commit they are lines of the state before.
Segment = tuple[str | None, int, int]


def patch(commit: str, hunks: list[tuple[int, int, int]]) -> list[Segment]:
    """The patch of a commit's hunks (old start, old lines, new lines), as a diff without context numbers them."""
    out: list[Segment] = []
    at = 1
    for start, gone, new in sorted(hunks):
        first = start if gone else start + 1  # what takes no line away stands after its line
        if first > at:
            out.append((None, at, first - at))
        if new:
            out.append((commit, 1, new))
        at = max(at, first + gone)
    return [*out, (None, at, END - at)]


def compose(before: list[Segment], after: list[Segment]) -> list[Segment]:
    """One patch for two that follow each other; linear in both, since what stays keeps its order."""
    out: list[Segment] = []

    def add(commit: str | None, first: int, n: int) -> None:
        if out and out[-1][0] == commit and (commit is not None or out[-1][1] + out[-1][2] == first):
            out[-1] = (commit, out[-1][1], out[-1][2] + n)
        elif n > 0:
            out.append((commit, first, n))

    k, done = 0, 1  # segment k of before begins at line `done` of the state between
    for commit, first, n in after:
        if commit is not None:
            add(commit, 1, n)
            continue
        to = first + n
        while k < len(before):
            c, a, m = before[k]
            lo, hi = max(first, done), min(to, done + m)
            if lo < hi:
                add(c, 1 if c is not None else a + lo - done, hi - lo)
            if done + m > to:
                break
            done += m
            k += 1
    return out


def _tuples(column) -> Iterator[list[tuple]]:
    """The lists of structs of an Arrow column as lists of tuples."""
    flat, at = list(zip(*(c.to_pylist() for c in column.flatten().flatten()), strict=True)), 0
    for n in column.value_lengths().to_pylist():
        yield flat[at : at + n]
        at += n


def _composed(rows: Iterable[tuple[tuple, list[Segment]]]) -> Iterator[tuple[tuple, list[Segment]]]:
    """Consecutive patches ((file, ...), segments) of a file composed to one, with the first head."""
    held, made = None, []
    for head, segments in rows:
        if held is not None and held[0] == head[0]:
            made = compose(made, segments)
            continue
        if held is not None:
            yield held, made
        held, made = head, segments
    if held is not None:
        yield held, made


def blame(hunks: DataFrame) -> DataFrame:
    """hunks(file, at, commit, old_start, old_lines, new_lines) → file, start, end, commit: maximal runs of lines that one
    commit wrote. at orders commits, of equal ones their names do. Lines from before the history have no row; nor have
    files that end empty. Rows with a null file or commit are left out; equal hunk rows count once."""
    one = hunks.where("file IS NOT NULL AND commit IS NOT NULL").select("file", "at", "commit", F.struct("old_start", "old_lines", "new_lines").alias("h"))
    each = one.groupBy("file", "at", "commit").agg(F.collect_set("h").alias("hunks"))  # a commit's own hunks
    kinds = {f.name: f.dataType.simpleString() for f in each.schema}

    def runs(batches):
        """Patches are made and composed in one go, so that only composed ones leave the task."""
        import pyarrow as pa

        kind = None

        def patches():
            nonlocal kind
            for b in batches:
                kind = b.schema
                for *head, hunks in zip(*(b.column(k).to_pylist() for k in range(3)), _tuples(b.column(3)), strict=True):
                    yield head, patch(head[2], hunks)

        parts = _composed(patches())
        while some := list(islice(parts, 1024)):
            heads = [pa.array([h[k] for h, _ in some], kind.field(k).type) for k in range(3)]
            segments = pa.array([[{"c": c, "a": a, "n": n} for c, a, n in made] for _, made in some], pa.list_(pa.struct([("c", pa.string()), ("a", pa.int64()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*heads, segments], ["file", "at", "commit", "segments"])

    def lines(batches):
        import pyarrow as pa

        kind = None

        def patches():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield from zip(zip(b.column(0).to_pylist()), _tuples(b.column(3)), strict=True)

        def found():
            for (file,), segments in _composed(patches()):
                at = 1
                for c, _, n in segments:
                    if c is not None:
                        yield file, at, at + n - 1, c
                    at += n

        out = found()
        while some := list(islice(out, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (kind, pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "start", "end", "commit"])

    order = ("file", "at", "commit")
    rows = each.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.mapInArrow(runs, f"file {kinds['file']}, at {kinds['at']}, commit {kinds['commit']}, segments array<struct<c: string, a: bigint, n: bigint>>")
    return rows.repartition("file").sortWithinPartitions(*order).mapInArrow(lines, f"file {kinds['file']}, start long, end long, commit string")


def commits_of(blamed: DataFrame, symbols: DataFrame, most: int = 15, bin_lines: int = 1000) -> DataFrame:
    """blamed(file, start, end, commit), symbols(file, symbol, start, end) → file, symbol, commit: the commits of each
    symbol's first `most` lines. A range join by bins; a pair counts in the first bin of both."""
    cut = lambda c: F.floor(F.col(c) / bin_lines).cast("long")
    bins = F.explode(F.sequence(cut("start"), cut("end"))).alias("bin")
    s = symbols.withColumn("end", F.least("end", F.col("start") + most - 1)).where("start <= end").select("file", "symbol", F.col("start").alias("s"), F.col("end").alias("e"), bins)
    met = blamed.select("file", "start", "end", "commit", bins).join(s, ["file", "bin"])
    met = met.where((F.col("end") >= F.col("s")) & (F.col("start") <= F.col("e")) & (F.col("bin") == F.floor(F.greatest("start", "s") / bin_lines)))
    return met.select("file", "symbol", "commit").distinct()

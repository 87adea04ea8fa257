"""Git history as a Spark data source, in batch and in streams, read by git itself in as many tasks as there are ranges.

    spark.dataSource.register(GitHistory)
    spark.read.format("git_history").option("repo", path).option("rows", "hunks").load()

The repository lies in a folder that the driver and all executors see. Ranges are cut from a pinned commit, so all tasks
read one history, also if one runs again. Output is parsed as it comes: a task holds one commit's header or one line.
"""

from __future__ import annotations

import datetime
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMAS = {
    "commits": "hash string, author string, at timestamp, subject string, body string",
    "files": "commit string, at timestamp, file string",
    "hunks": "commit string, at timestamp, author string, subject string, file string, old_start long, old_lines long, start long, lines long",
    "changed": "path string",
}
# Days that are read, commits that are read where those days have fewer than the third number.
WINDOWS = {"commits": (90, 1000, 1), "files": (2000, 5000, 1), "hunks": (2000, 5000, 10)}
HEADER = "%x1e%H%x1f%aI%x1f%an%x1f%s%x1f"
HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def git(repo: str, *args: str) -> Iterator[str]:
    """Output lines without their ends, a carriage return being no end; an error of git raises."""
    command = ["git", "-C", repo, "-c", "core.quotePath=false", *args]
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
        try:
            for line in run.stdout:
                yield line.removesuffix(b"\n").decode("utf-8", "replace")
            said = run.stderr.read().decode("utf-8", "replace")
        except GeneratorExit:
            run.kill()
            raise
    if run.returncode:
        raise RuntimeError(f"git {' '.join(args)} in {repo}: {said.strip()[:500]}")


def _named(line: str) -> str:
    """The file of a `--- a/x` or `+++ b/x` line."""
    name = line[4:].removesuffix("\t").removesuffix("\r").strip('"')
    return name if name == "/dev/null" else name[2:]


def _commits(lines: Iterator[str]) -> Iterator[tuple]:
    head, body = None, []
    for line in lines:
        if line.startswith("\x1e"):
            if head:
                yield (*head, "\n".join(body).rstrip())
            commit, at, author, subject, first = line[1:].split("\x1f", 4)
            head, body = (commit, author, datetime.datetime.fromisoformat(at), subject), [first]
        elif head:
            body.append(line)
    if head:
        yield (*head, "\n".join(body).rstrip())


def _files(lines: Iterator[str]) -> Iterator[tuple]:
    for line in lines:
        if line.startswith("\x1e"):
            commit, at = line[1:].split("\x1f", 2)[:2]
            when = datetime.datetime.fromisoformat(at)
        elif line:
            yield commit, when, line.strip('"')


def _hunks(lines: Iterator[str]) -> Iterator[tuple]:
    body = 0  # lines of a hunk's text that are still to come: they may look like headers
    for line in lines:
        if body and line[:1] in "+-":
            body -= 1
        elif line.startswith("\x1e"):
            commit, at, author, subject = line[1:].split("\x1f", 4)[:4]
            when = datetime.datetime.fromisoformat(at)
        elif line.startswith("--- "):
            old = _named(line)
        elif line.startswith("+++ "):
            new = _named(line)
        elif m := HUNK.match(line):
            first, gone, start, made = (1 if g is None else int(g) for g in m.groups())
            body = gone + made
            yield commit, when, author, subject, old if new == "/dev/null" else new, first, gone, start, made


class Range(InputPartition):
    """`count` commits of `revisions`, newest first, after the first `skip`."""

    def __init__(self, revisions: str, skip: int, count: int, after: str | None):
        self.revisions, self.skip, self.count, self.after = revisions, skip, count, after


class _Reader:
    def __init__(self, options: dict):
        self.repo, self.rows = options["repo"], options.get("rows", "commits")
        days, most, least = WINDOWS.get(self.rows, (0, 0, 0))
        self.days, self.most, self.least = int(options.get("days", days)), int(options.get("most", most)), least
        self.now, self.file, self.size = options.get("now"), options.get("file"), int(options.get("rangesize", 2000))
        self.revisions = options.get("revisions", "HEAD")

    def counted(self, revisions: str, after: str | None = None, most: int | None = None) -> int:
        window = ([f"--after={after}"] if after else []) + ([f"--max-count={most}"] if most is not None else [])
        return int(next(git(self.repo, "rev-list", "--count", "--no-merges", *window, revisions, "--")))

    def ranges(self, revisions: str, total: int, after: str | None = None) -> list[Range]:
        return [Range(revisions, k, min(self.size, total - k), after) for k in range(0, total, self.size)]

    def read(self, part: Range) -> Iterator[tuple]:
        if self.rows == "changed":
            yield from ((line.strip('"').replace("\\", "/"),) for line in git(self.repo, "diff", "--name-only", part.revisions, "--") if line)
            return
        window = [f"--skip={part.skip}", f"--max-count={part.count}"] + ([f"--after={part.after}"] if part.after else [])
        shape = {"commits": ["--no-patch", f"--format={HEADER}%B"], "files": ["--name-only", f"--format={HEADER}"], "hunks": ["-U0", "--no-color", "--no-ext-diff", "--src-prefix=a/", "--dst-prefix=b/", f"--format={HEADER}"]}
        file = ["--follow", "--", self.file] if self.file else ["--"]
        lines = git(self.repo, "log", "--no-merges", *window, *shape[self.rows], part.revisions, *file)
        yield from {"commits": _commits, "files": _files, "hunks": _hunks}[self.rows](lines)


class HistoryReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Range]:
        if self.rows == "changed":
            return [Range(self.revisions, 0, 1, None)]
        if ".." in self.revisions:
            return self.ranges(self.revisions, self.counted(self.revisions))
        head = next(git(self.repo, "rev-parse", "--verify", f"{self.revisions}^{{commit}}"))
        if self.file:  # a file is followed through its renames from the newest commit, which can't be cut
            return [Range(head, 0, self.counted(head), None)]
        now = datetime.datetime.fromisoformat(self.now) if self.now else datetime.datetime.now()
        after = (now - datetime.timedelta(days=self.days)).strftime("%Y-%m-%dT00:00:00")
        recent = self.counted(head, after)
        if recent >= self.least:
            return self.ranges(head, recent, after)
        return self.ranges(head, self.counted(head, most=self.most))


class HistoryStream(_Reader, DataSourceStreamReader):
    """A batch holds the commits that the end of its range reaches and the start doesn't; the first, all."""

    def initialOffset(self) -> dict:
        return {"head": ""}

    def latestOffset(self) -> dict:
        return {"head": next(git(self.repo, "rev-parse", "--verify", f"{self.revisions}^{{commit}}"))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        revisions = f"{start['head']}..{end['head']}" if start["head"] else end["head"]
        return self.ranges(revisions, self.counted(revisions))


class GitHistory(DataSource):
    """Options: repo; rows: commits, files, hunks or changed; revisions: a commit (HEAD) or a range a..b; days, most: the
    window in days, and the number of commits read where it has too few; now: the end of the window; file: a file whose
    history is followed through renames, whole; rangesize: commits a task. Ranges, streams and files have no window. Merges
    are left out. A file of a deletion keeps its name; renames without a change and binary files have no hunks."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        rows = self.options.get("rows", "commits")
        if rows not in SCHEMAS:
            raise ValueError(f"rows: one of {', '.join(SCHEMAS)}, not {rows}")
        return SCHEMAS[rows]

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)

    def streamReader(self, schema) -> HistoryStream:
        if self.options.get("rows") == "changed":
            raise ValueError("changed files are of a range, not of a stream")
        return HistoryStream(self.options)

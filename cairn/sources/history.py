"""Sources: source trees, git logs, diffs, chat and tracker exports, decision documents; and the report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Suffixes of sources, names of generated files, directories that are skipped.
SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx", ".go")
GENERATED = r"min\.js|min\.css|\.min\.|autogen|generated"
SKIPPED = (
    ".git", "__pycache__", "venv", ".venv", "node_modules", ".pytest_cache", ".next", "dist", "build", "target", "out", ".svelte-kit",
    ".nuxt", ".docusaurus", "package", "vendor", ".idea", ".vscode", "docs", "doc", "locale", "locales",
)
MOST_BYTES = 1_048_576


def source_tree(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """path, code, lines of the source files under root: no large, generated or excluded ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    ok = F.lit(False)
    for s in SUFFIXES:
        ok = ok | name.endswith(s)
    below = F.element_at(F.split("path", rf"\Q{root.rstrip('/')}\E/", 2), -1)  # where the tree itself lies doesn't matter
    skip = F.arrays_overlap(F.split(below, "/"), F.array(*map(F.lit, SKIPPED + tuple(excluded))))
    kept = files.where((F.col("length") <= MOST_BYTES) & ok & ~name.rlike(GENERATED) & ~skip)
    code = F.decode(F.col("content"), "UTF-8")
    return kept.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), code.alias("code"), (F.size(F.split(code, "\n")) - 1).alias("lines"))


def rescan(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """old rows without those of the changed paths, and the new rows of them; deleted files have no new rows."""
    return old.join(changed.select("path"), "path", "left_anti").unionByName(new.join(changed.select("path"), "path", "left_semi"))


def git_log(log: DataFrame, end: str = "--END--") -> DataFrame:
    """log(value: the whole text) of `%H|%an|%ai|%B` records → hash, author, at, subject, body."""
    rec = F.explode(F.filter(F.split("value", end), lambda x: F.trim(F.regexp_replace(x, r"^\s+", "")) != "")).alias("r")
    parts = log.select(rec).select(F.split(F.regexp_replace("r", r"^\s+", ""), r"\|", 4).alias("p")).where(F.size("p") == 4)
    body = F.regexp_replace(F.col("p")[3], r"\s+$", "")
    return parts.select(F.col("p")[0].alias("hash"), F.col("p")[1].alias("author"), F.try_to_timestamp(F.col("p")[2], F.lit("yyyy-MM-dd HH:mm:ss Z")).alias("at"), F.split(body, "\n")[0].alias("subject"), body.alias("body"))


def name_only(log: DataFrame) -> DataFrame:
    """log(value) of `commit|date` lines, each followed by file names → commit, at, file. A file belongs to the commit
    line above it."""
    entry = F.explode(F.filter(F.split("value", r"(?m)^(?=[0-9a-f]{7,40}\|)"), lambda x: F.trim(x) != "")).alias("e")
    rows = log.select(entry).select(F.split("e", "\n").alias("l"))
    head = F.split(F.col("l")[0], r"\|", 2)
    return rows.select(head[0].alias("commit"), head[1].alias("at"), F.explode(F.filter(F.slice("l", 2, F.size("l")), lambda x: F.trim(x) != "")).alias("file"))


def hunk_log(commits: DataFrame) -> DataFrame:
    """commits(value: `hash|date|author|subject`, and below it the diff without context, -U0) → commit, at, author, subject,
    file, old_start, old_lines, start, lines: a row for each hunk. A log is read a commit a row with the reader's lineSep.

    A deleted file keeps its old name; a hunk without a count has one line, and one of no lines stands after its start."""
    parts = F.split("value", r"(?m)^diff --git ")
    head = F.split(F.element_at(F.split(parts[0], "\n"), 1), r"\|", 4)
    rows = commits.select(head[0].alias("commit"), head[1].alias("at"), head[2].alias("author"), head[3].alias("subject"), F.explode(F.slice(parts, 2, F.size(parts))).alias("part"))
    new, old = (F.regexp_extract("part", rf"(?m)^{sign} (?:[ab]/)?(.+?)\r?$", 1) for sign in (r"\+\+\+", "---"))
    found = F.regexp_extract_all("part", F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"), F.lit(0))
    # one pass over the text; the file is found once for each part, and the part isn't repeated for each hunk
    rows = rows.select("commit", "at", "author", "subject", F.when(new == "/dev/null", old).otherwise(new).alias("file"), found.alias("found"))
    rows = rows.select("commit", "at", "author", "subject", "file", F.explode(F.transform("found", lambda x: F.split(x, " "))).alias("h"))
    number = lambda side, k: F.get(F.split(F.substr(F.col("h")[side], F.lit(2)), ","), F.lit(k))
    whole = lambda side, k, n: F.when(number(side, k).isNull(), 1).otherwise(number(side, k).try_cast("long")).cast("long").alias(n)
    return rows.select("commit", "at", "author", "subject", "file", whole(1, 0, "old_start"), whole(1, 1, "old_lines"), whole(2, 0, "start"), whole(2, 1, "lines"))


def unified_diff(lines: DataFrame) -> DataFrame:
    """lines(diff, n, text), n in order → file, line, sign, text, new_line: added and removed lines with their file.

    The file and hunk carry forward within a diff."""
    by = Window.partitionBy("diff").orderBy("n")
    name = F.regexp_extract("text", r"^\+\+\+ (?:b/)?(.+)$", 1)
    hunk = F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    rows = lines.withColumn("file", F.last(F.when(name != "", name), True).over(by)).withColumn("h", F.when(hunk != "", hunk.cast("long")))
    rows = rows.withColumn("base", F.last("h", True).over(by)).withColumn("block", F.count("h").over(by))
    inside = (F.col("block") > 0) & F.col("h").isNull() & ~F.col("text").rlike(r"^(\+\+\+|---|diff |index )")
    in_block = Window.partitionBy("diff", "block").orderBy("n")
    step = F.sum(F.when(F.col("text").startswith("-"), 0).otherwise(1)).over(in_block)
    rows = rows.where(inside).withColumn("new_line", F.col("base") + step - 1)
    sign = F.substring("text", 1, 1)
    return rows.where(sign.isin("+", "-")).select("file", F.col("n").alias("line"), sign.alias("sign"), F.expr("substring(text, 2)").alias("text"), "new_line")


def merged_prs(prs: DataFrame) -> DataFrame:
    """Closed pull requests as JSON rows → number, title, body, url, merged_at of merged ones."""
    return prs.where(F.col("merged_at").isNotNull()).select("number", "title", F.coalesce("body", F.lit("")).alias("body"), F.col("html_url").alias("url"), F.to_timestamp("merged_at").alias("merged_at"))


def chat_chunks(messages: DataFrame, size: int = 20) -> DataFrame:
    """messages(channel, ts, user, text, bot_id) → channel, chunk, text: human messages in order, `size` to a chunk."""
    by = Window.partitionBy("channel").orderBy("ts")
    rows = messages.where("bot_id is null").withColumn("k", F.row_number().over(by) - 1).withColumn("chunk", F.floor(F.col("k") / size))
    line = F.struct("k", F.concat_ws(": ", "user", "text").alias("t"))
    return rows.groupBy("channel", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "\n").alias("text"))


def last_session(messages: DataFrame, project: str, most: int = 5000) -> DataFrame:
    """messages(sessionId, project, timestamp, display) → n, display of the project's latest session, in order."""
    own = messages.where(F.col("project") == project)
    latest = own.agg(F.max_by("sessionId", "timestamp").alias("sessionId"))
    rows = own.join(F.broadcast(latest), "sessionId").orderBy(F.desc("timestamp")).limit(most)
    return rows.withColumn("n", F.row_number().over(Window.orderBy("timestamp"))).select("n", "display")


def decision_docs(docs: DataFrame, least: int = 50, most: int = 20) -> DataFrame:
    """docs(path, text) → path, idx, content: paragraphs of over `least` characters, the first `most` of each document."""
    paras = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.trim(x)), lambda x: F.length(x) > least)
    return docs.select("path", F.posexplode(F.slice(paras, 1, most)).alias("idx", "content"))


def sarif(findings: DataFrame) -> DataFrame:
    """findings(rule, file, line, message) → value: each result as a SARIF 2.1.0 JSON object."""
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), F.col("line")).alias("startLine")).alias("region")).alias("physicalLocation")))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))).alias("value"))

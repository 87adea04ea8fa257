"""Text and diff rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tags that keep a comment, leak patterns, message words, guard tokens, operators.
KEEP_TAGS = ("ADR-", "[L4:", "[L5:", "noqa")
LEAKS = (
    r"(?i)\bCVE-\d{4}-\d{4,7}\b",
    r"(?i)\bGHSA-[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4}\b",
    r"(?i)\bvulnerab\w*\b",
    r"(?i)\bsecurity\s+(?:patch|fix|issue|flaw)\b",
    r"(?i)\bexploit\w*\b",
    r"(?i)Fixes\s+#\d+",
)
SEMANTIC = ("feat", "fix(security", "refactor", "breaking", "revert")
NOISE = ("wip", "update", "fix typo", "cleanup", "misc", "minor", "temp", "tmp", "test", "merge")
SECURITY = ("auth", "jwt", "token", "security", "permission", "encrypt", "bypass", "credentials", "vulnerability")
GUARDS = ("isinstance", "assert ", "if self._", "is None", "raise TypeError", "if err != nil", "if (!", "if (typeof")
COMPARISON = r"(\b[\w\.]+\b)\s*(>=|<=|==|!=|>|<)\s*(\b[\w\.]+\b)"


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def prune_comments(code: Column, mark: str = "#", more_tags: tuple[str, ...] = ("type: ignore",)) -> Column:
    """Code without whole-line comments and trailing ones after two spaces, but for tagged ones; runs of blank lines
    become one. mark is `#`, or `//` for the C family (whose extra tag is `nocheck`)."""
    tail = f"  {mark}"

    white = F.lit(" \t\n\x0b\f\r")
    strip = lambda x: F.btrim(x, white)

    def line(x: Column) -> Column:
        at = F.locate(tail, x) if isinstance(x, str) else F.instr(x, F.lit(tail))
        rest = F.substring(x, at + len(tail), F.length(x))
        cut = (at > 0) & ~F.startswith(strip(x), F.lit(mark)) & ~_any(rest, KEEP_TAGS if mark == "#" else KEEP_TAGS[:3])
        return F.when(strip(x) == "", "").when(cut, F.rtrim(F.substring(x, F.lit(1), at - 1), white)).otherwise(x)

    tags = KEEP_TAGS + more_tags if mark == "#" else KEEP_TAGS[:3] + ("nocheck",)
    kept = F.filter(F.split(code, "\n"), lambda x: ~F.startswith(strip(x), F.lit(mark)) | _any(x, tags))
    joined = F.regexp_replace(F.array_join(F.transform(kept, line), "\n"), "\n\n\n+", "\n\n")
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def sanitize_leaks(text: Column) -> tuple[Column, Column]:
    """Text with each leak replaced by [SANITIZED], and the number of replacements."""
    # most texts have none: one search decides whether the patterns are tried in turn
    some = text.rlike("|".join(LEAKS))
    clean, n = text, F.lit(0)
    for p in LEAKS:
        n = n + F.regexp_count(clean, F.lit(p))
        clean = F.regexp_replace(clean, p, "[SANITIZED]")
    return F.when(some, clean).otherwise(text), F.when(some, n).otherwise(F.when(text.isNotNull(), 0))


def message_quality(subject: Column, body: Column) -> Column:
    """LOW, SUSPICIOUS, HIGH or MEDIUM: how far a commit message can be trusted."""
    s, b = F.lower(subject), F.lower(body)
    has_body = F.length(F.trim(b)) > 20
    semantic = F.lit(False)
    for p in SEMANTIC:
        semantic = semantic | F.startswith(s, F.lit(p))
    low = _any(s, NOISE) & ~has_body
    suspicious = _any(F.concat(s, b), SECURITY) & ~has_body
    return F.when(low, "LOW").when(suspicious, "SUSPICIOUS").when(semantic & has_body, "HIGH").otherwise("MEDIUM")


def doc_class(path: Column) -> Column:
    p = F.lower(path)
    return F.when(_any(p, ["adr"]), "adr").when(_any(p, ["spec"]), "spec").when(_any(p, ["design", "arch"]), "design").when(_any(p, ["rfc", "proposal"]), "proposal").otherwise("decision")


def boundary_mutations(diff: DataFrame) -> DataFrame:
    """diff(file, sign, text) → file, old_op, new_op, left, right where a comparison changed but for its operator: one
    operand is the same. Each side is joined by operand, and a pair that matches by both counts once."""
    found = F.explode(F.regexp_extract_all("text", F.lit(COMPARISON), F.lit(0))).alias("c")
    rows = diff.select("file", "sign", "line", found)
    parts = rows.select("file", "sign", "line", *[F.regexp_extract("c", COMPARISON, k).alias(n) for k, n in enumerate(("left", "op", "right"), 1)])
    a = parts.where("sign = '-'").select("file", F.col("line").alias("al"), F.col("left").alias("a_left"), F.col("op").alias("old_op"), F.col("right").alias("a_right"))
    b = parts.where("sign = '+'").select("file", F.col("line").alias("bl"), F.col("left").alias("b_left"), F.col("op").alias("new_op"), F.col("right").alias("b_right"))
    by_left = a.join(b, (a["file"] == b["file"]) & (F.col("a_left") == F.col("b_left"))).drop(b["file"])
    by_right = a.join(b, (a["file"] == b["file"]) & (F.col("a_right") == F.col("b_right")) & (F.col("a_left") != F.col("b_left"))).drop(b["file"])
    return by_left.unionByName(by_right).where("old_op != new_op").select("file", "old_op", "new_op", F.col("a_left").alias("left"), F.col("a_right").alias("right"))


def guard_removals(diff: DataFrame, per_file: int = 3) -> DataFrame:
    """diff(file, line, sign, text) → file, guard: removed lines that hold a guard, the first few of each file."""
    rows = diff.where(F.col("sign") == "-").withColumn("guard", F.trim("text")).where(_any(F.col("guard"), GUARDS))
    by = Window.partitionBy("file").orderBy("line")
    return rows.withColumn("k", F.row_number().over(by)).where(F.col("k") <= per_file).select("file", "guard")


def amnesia_risk(n: Column, links: Column) -> tuple[Column, ...]:
    """prior, posterior and 95 % interval of the risk that a file of n changes with so many links is forgotten."""
    prior = 1 / (1 + F.exp(-(n / 15 - 1.5)))
    post = F.when(links > 0, prior * F.pow(F.lit(0.2), links)).otherwise(F.least(F.lit(1.0), 1.5 * prior))
    half = 1.96 * F.sqrt(F.greatest(F.lit(0.0), post * (1 - post) / F.greatest(F.lit(1), n)))
    return tuple(F.round(x, 6) for x in (prior, post, F.greatest(F.lit(0.0), post - half), F.least(F.lit(1.0), post + half)))


def path_risk(base: Column, is_source: Column, length: Column, sanitising: Column) -> Column:
    shorter = F.greatest(F.lit(0.5), 1 - 0.05 * (length - 1))
    raw = (base + F.when(is_source, 0.1).otherwise(0.0)) * shorter - 0.2 * sanitising
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), raw)), 6)


def fingerprint(path: Column) -> Column:
    """SHA-256 of a path's files, joined by commas."""
    return F.sha2(F.concat_ws(",", path), 256)


def graph_line(name: Column, base: Column, kind: Column, start: Column, end: Column, fragility: Column, callers: Column, partners: Column, rule: Column) -> Column:
    """One symbol in the compact graph notation."""
    head = F.format_string("@SYM:%s#%s [%s, L%d-%d] (fragility:%.2f)", base, name, kind, start, end, fragility)
    part = lambda label, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"  {label}: "), F.array_join(xs, ", ")))
    note = F.when(rule.isNotNull(), F.concat(F.lit("  RULE: "), F.substring(rule, 1, 60)))
    return F.concat_ws("\n", head, part("CALLERS", callers), part("CO_CHG", F.slice(partners, 1, 5)), note)


def when_parsed(text: Column) -> Column:
    """A time in one of several formats, else the epoch."""
    formats = ("yyyy-MM-dd HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], F.timestamp_seconds(F.lit(0)))

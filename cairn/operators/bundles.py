"""What a question's reader is given: bundles of symbols under a budget of tokens.

`best_first` follows dependencies from the most similar symbol on, as a priority queue does, for all questions at once. A
question's queue is folded, in sorted partitions that hold one question's rows, as far as the symbols go whose dependencies are
known; those that it then needs are joined with the graph in the next round, for all questions that aren't done yet. Similarities are computed for these pairs alone.

`two_pass` fills a budget in a fixed order and degrades what doesn't fit instead of dropping it: each item has sizes at
several levels of detail, and gets the first that fits.
"""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import stored

#: Symbols at the head of a question's queue whose dependencies are fetched together.
AHEAD = 64


def _queue(seeds: list[tuple], known: dict[str, list[tuple]], budget: int) -> tuple[list[tuple], list[str]]:
    """Takes (id, sim, rank, spent) of one question, and the ids whose dependencies are missing before it can go on.
    seeds and known, the dependencies of each id as far as fetched: (-sim, id, tokens)."""
    heap = list(seeds)
    heapq.heapify(heap)
    seen, taken, spent = set(), [], 0
    while heap and spent < budget:
        sim, node, tokens = heap[0]
        if node in seen or spent + tokens > budget:
            heapq.heappop(heap)
            seen.add(node)
            continue
        if node not in known:
            missing = [n for _, n, t in heapq.nsmallest(AHEAD, heap) if n not in known and n not in seen and spent + t <= budget]
            return taken, list(dict.fromkeys(missing))
        heapq.heappop(heap)
        seen.add(node)
        spent += tokens
        taken.append((node, -sim, len(taken) + 1, spent))
        for d in known[node]:
            if d[1] not in seen:
                heapq.heappush(heap, d)
    return taken, []


def best_first(seeds: DataFrame, deps: DataFrame, questions: DataFrame, symbols: DataFrame, budget: int, least: float = 0.4, targets: DataFrame | None = None) -> DataFrame:
    """seeds(question, id), deps(src, dst), questions(question, vector), symbols(id, vector, tokens[, file]) → question, id,
    rank, spent: from the most similar symbol on (of equals the least id), each that still fits, and after it its
    dependencies whose similarity is above `least`, or, with targets(question, file), those in a target file. Symbols
    without a row in symbols are never taken; a symbol that doesn't fit isn't followed."""
    q = questions.select("question", F.col("vector").alias("qv"))
    cos = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = lambda pairs: pairs.join(q, "question").join(symbols, "id").withColumn("sim", F.round(cos("qv", "vector"), 6)).where("sim IS NOT NULL")
    if symbols.schema["id"].dataType.simpleString() != "string":
        raise ValueError("ids are strings")
    # src: whose dependency id is, null for a seed. A null id says that src's dependencies are fetched, in results that src's are wanted.
    kinds = f"question {questions.schema['question'].dataType.simpleString()}, src string, id string, sim double, tokens long"
    columns = ["question", "src", "id", "sim", "tokens"]

    def fold(batches):
        import pyarrow as pa

        schema, size = None, 0
        rows: list[list] = [[] for _ in range(7)]

        def close(question, lines):
            seeds, known = [], {}
            for src, node, sim, tokens in lines:
                if src is not None:
                    of = known.setdefault(src, [])
                    if node is not None:
                        of.append((-sim, node, tokens))
                else:
                    seeds.append((-sim, node, tokens))
            taken, missing = _queue(seeds, known, budget)
            if missing:
                made = [(question, *x, None, None) for x in lines] + [(question, i, None, None, None, 0, None) for i in missing]
            else:
                made = [(question, None, node, sim, None, rank, spent) for node, sim, rank, spent in taken]
            for column, values in zip(rows, zip(*made, strict=True), strict=False):
                column.extend(values)

        def full():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema, strict=True)], [*columns, "rank", "spent"])
            for c in rows:
                c.clear()
            return out

        asked, lines = None, []
        for b in batches:
            schema = schema or [*(f.type for f in b.schema), pa.int64(), pa.int64()]
            for question, *line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if lines and question != asked:
                    close(asked, lines)
                    lines = []
                    if len(rows[0]) >= 10_000:
                        yield full()
                asked = question
                lines.append(line)
        if lines:
            close(asked, lines)
        if rows[0]:
            yield full()

    done = []
    open_ = scored(seeds.select("question", "id").distinct()).select("question", F.lit(None).cast("string").alias("src"), "id", "sim", F.col("tokens").cast("long").alias("tokens"))
    edges = None
    while True:
        out = stored(open_.repartition("question").sortWithinPartitions("question").mapInArrow(fold, f"{kinds}, rank long, spent long"), "bundle-round")
        done.append(out.where("rank > 0").select("question", "id", "rank", "spent"))
        wanted = out.where("rank = 0").select("question", "src")
        if wanted.isEmpty():
            return reduce(DataFrame.unionByName, done)
        edges = edges if edges is not None else stored(deps.select("src", "dst").distinct(), "bundle-edges")
        near = scored(wanted.join(edges, "src").select("question", "src", F.col("dst").alias("id")))
        if targets is None:
            near = near.where(F.col("sim") > least)
        else:
            near = near.join(targets.select("question", "file").distinct(), ["question", "file"], "left_semi")
        fetched = wanted.select("question", "src", F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("sim"), F.lit(None).cast("long").alias("tokens"))
        # of a question that is done nothing is carried on
        open_ = out.where("rank IS NULL").select(columns).unionByName(fetched).unionByName(near.select("question", "src", "id", "sim", F.col("tokens").cast("long").alias("tokens")))


def reading_order(ranked: DataFrame, deps: DataFrame, top: int = 2) -> DataFrame:
    """ranked(question, id, rank), deps(src, dst) → question, id, turn, must: the first `top`, then what they depend on (in
    their order, of one by id), then the rest; each once, at its first turn."""
    first = ranked.where(F.col("rank") <= top)
    rows = first.select("question", "id", F.struct(F.lit(0).alias("a"), F.col("rank").cast("long").alias("b"), F.lit("").alias("c")).alias("turn"))
    near = first.join(deps.select("src", "dst").distinct(), F.col("id") == F.col("src")).select("question", F.col("dst").alias("id"), F.struct(F.lit(1).alias("a"), F.col("rank").cast("long").alias("b"), F.col("dst").alias("c")).alias("turn"))
    rest = ranked.where(F.col("rank") > top).select("question", "id", F.struct(F.lit(2).alias("a"), F.col("rank").cast("long").alias("b"), F.lit("").alias("c")).alias("turn"))
    return rows.unionByName(near).unionByName(rest).groupBy("question", "id").agg(F.min("turn").alias("turn")).withColumn("must", F.col("turn.a") == 0)


def two_pass(order: DataFrame, sizes: DataFrame, budget: int, slack: float = 1.5) -> DataFrame:
    """order(question, id, turn, must), sizes(id, sizes: tokens at each level of detail, the full one first) → question,
    id, level (from 0), tokens, spent. In order of turns, an item gets the first level that still fits, none if none does.
    One that must be there gets its full level, or beyond `slack` budgets its next, whether it fits or not. Equal turns go
    by id. The rows of a question come sorted and are folded as a stream."""
    kinds = order.schema["question"].dataType.simpleString()
    rows = order.join(sizes, "id").select("question", "turn", "id", "must", "sizes")

    def run(batches):
        import pyarrow as pa

        asked, spent, begun = None, 0, False
        for b in batches:
            keep, level, tokens, total = [], [], [], []
            for question, must, sizes_ in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not begun or question != asked:
                    asked, spent, begun = question, 0, True
                if must:
                    got = 0 if sizes_[0] <= slack * budget or len(sizes_) == 1 else 1
                else:
                    got = next((k for k, n in enumerate(sizes_) if spent + n <= budget), None)
                keep.append(got is not None)
                spent += 0 if got is None else sizes_[got]
                level.append(got)
                tokens.append(None if got is None else sizes_[got])
                total.append(spent)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(level, pa.int64()), pa.array(tokens, pa.int64()), pa.array(total, pa.int64())], ["question", "id", "level", "tokens", "spent"])
            yield out.filter(pa.array(keep, pa.bool_()))

    ordered = rows.repartition("question").sortWithinPartitions("question", "turn", "id").select("question", "id", "must", F.col("sizes").cast("array<bigint>").alias("sizes"))
    return ordered.mapInArrow(run, f"question {kinds}, id {order.schema['id'].dataType.simpleString()}, level long, tokens long, spent long")


def low_confidence(ranked: DataFrame, least: float = 0.005) -> DataFrame:
    """ranked(question, id, score, semantic) → question, low: whether the best item has no semantic score and less than
    `least`; of equal scores the greatest id is the best."""
    best = ranked.groupBy("question").agg(F.max(F.struct("score", "id", F.coalesce("semantic", F.lit(0.0)).alias("semantic"))).alias("b"))
    return best.select("question", ((F.col("b.semantic") == 0) & (F.col("b.score") < least)).alias("low"))


def pooled(lists: DataFrame, near: DataFrame, k: int = 60, each: int = 20, most: int = 50, weight: float = 0.6) -> DataFrame:
    """lists(question, query, id, rank), near(question, id, rank) → question, id, score: reciprocal ranks of a question's
    word queries, the first `each` of every one, and of its nearest vectors, the first `most`, at a lower weight."""
    words = lists.where(F.col("rank") <= each).select("question", "id", (1 / (k + F.col("rank"))).alias("s"))
    vectors = near.where(F.col("rank") <= most).select("question", "id", (weight / (k + F.col("rank"))).alias("s"))
    return words.unionByName(vectors).groupBy("question", "id").agg(F.round(F.sum("s"), 9).alias("score"))


def in_detail(code: Column, skeleton: Column, line: Column) -> Column:
    """Sizes in tokens (a quarter of the characters) of an item's levels: its code, its skeleton, one line."""
    return F.array(*(F.floor(F.length(c) / 4).cast("long") for c in (code, skeleton, line)))

"""Change mining: which things change together, where risk gathers, who owns what, and how it moves over time.

Inputs are narrow DataFrames with the column names of each docstring; gates are parameters. No operator collects to the
driver, and global ranks come from histograms, so that no step sorts everything in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: words of a commit that mends something.
FIX = r"\b(fix(es|ed|ing)?|bug(fix)?|regression)\b"


def baskets(touch: DataFrame, max_items: int | None, partitions: int | None = None) -> DataFrame:
    """touch(basket, item, ts) → basket, items (sorted, distinct) and ts (latest), without baskets of over max_items.

    One exchange by basket serves the distinct, the cap and the list; a large basket is dropped before it is listed. It has
    `partitions` partitions (none is made if touch already has as many by basket); without, adaptive plans merge them until
    there are as few as cores, and the pairs of a task grow with the table.
    """
    by = Window.partitionBy("basket")
    rows = (touch.repartition(partitions, "basket") if partitions else touch.repartition("basket")).groupBy("basket", "item").agg(F.max("ts").alias("ts"))
    if max_items is not None:
        rows = rows.withColumn("n", F.count("*").over(by)).where(F.col("n") <= max_items)
    return rows.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"), F.max("ts").alias("ts"))


def _pairs() -> Column:
    """All (a, b) with a before b in the sorted items."""
    rest = lambda i: F.slice("items", i + 2, F.size("items"))
    return F.flatten(F.transform("items", lambda x, i: F.transform(rest(i), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def pair_counts(touch: DataFrame, max_items: int | None, partitions: int | None = None) -> DataFrame:
    """item_a < item_b, support, last_seen of items in one basket."""
    return baskets(touch, max_items, partitions).select("ts", F.explode(_pairs()).alias("p")).groupBy(F.col("p.a").alias("item_a"), F.col("p.b").alias("item_b")).agg(F.count("*").alias("support"), F.max("ts").alias("last_seen"))


def co_change(touch: DataFrame, max_items: int = 15, min_support: int = 3, partitions: int | None = None) -> DataFrame:
    """touch(basket, item, ts) → item_a, item_b, support, last_seen. last_seen is the basket's own time."""
    return pair_counts(touch, max_items, partitions).where(F.col("support") >= min_support)


def item_totals(touch: DataFrame) -> DataFrame:
    """touch(basket, item) → item, freq: its baskets."""
    return touch.select("basket", "item").distinct().groupBy("item").agg(F.count("*").alias("freq"))


def virtual_edges(pairs: DataFrame, totals: DataFrame, min_support: int = 5, min_rate: float = 0.40) -> DataFrame:
    """co_change rows with the rate at which the rarer one brings the other, and a depth that falls with it."""
    a, b = (totals.select(F.col("item").alias(f"item_{k}"), F.col("freq").alias(f"n_{k}")) for k in "ab")
    rate = F.least(F.lit(1.0), F.col("support") / F.greatest(F.lit(1), F.least("n_a", "n_b")))
    rows = pairs.where(F.col("support") >= min_support).join(a, "item_a").join(b, "item_b").withColumn("rate", rate)
    return rows.where(F.col("rate") > min_rate).select("item_a", "item_b", "rate", (2 - F.col("rate")).alias("depth"), "support")


def symbol_co_change(touch: DataFrame, min_support: int = 3, min_conf: float = 0.40, max_items: int | None = None, partitions: int | None = None) -> DataFrame:
    """Directed rules src → dst with confidence support / baskets of src."""
    pairs = pair_counts(touch, max_items, partitions).where(F.col("support") >= min_support)
    both = F.explode(F.array(F.struct(F.col("item_a").alias("src"), F.col("item_b").alias("dst")), F.struct(F.col("item_b").alias("src"), F.col("item_a").alias("dst"))))
    rules = pairs.select(both.alias("r"), "support", "last_seen").select("r.src", "r.dst", "support", "last_seen")
    totals = item_totals(touch).select(F.col("item").alias("src"), F.col("freq").alias("total_src"))
    return rules.join(totals, "src").withColumn("confidence", F.round(F.col("support") / F.col("total_src"), 4)).where(F.col("support") / F.col("total_src") >= min_conf).select("src", "dst", "support", "total_src", "confidence", "last_seen")


def hotspots(totals: DataFrame, min_freq: int = 5, top: float = 0.2) -> DataFrame:
    """item, freq, risk of the most frequent share, ties kept; the threshold comes from a histogram of frequencies."""
    eligible = totals.where(F.col("freq") >= min_freq)
    levels = eligible.groupBy("freq").agg(F.count("*").alias("n"))
    upto = Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    place = F.greatest(F.lit(0), F.floor(F.sum("n").over(whole) * F.lit(top)) - 1)
    ranked = levels.select("freq", F.sum("n").over(upto).alias("upto"), place.alias("place"), F.max("freq").over(whole).alias("most"))
    cut = ranked.where(F.col("upto") > F.col("place")).agg(F.max("freq").alias("cut"), F.max("most").alias("most"))
    return eligible.join(F.broadcast(cut), F.col("freq") >= F.col("cut")).select("item", "freq", F.least(F.lit(1.0), F.col("freq") / F.col("most")).alias("risk"))


def cold_hotspots(rows: DataFrame, gate: int = 2, top: float = 0.3) -> DataFrame:
    """rows(item, callers, loc) → the riskiest share by callers and size, when there is no history."""
    gated = rows.where(F.col("callers") >= gate)
    most = gated.agg(F.max("callers").alias("mc"), F.max("loc").alias("ml"))
    risk = F.round(0.6 * F.col("callers") / F.col("mc") + 0.4 * F.col("loc") / F.greatest("ml", F.lit(1)), 4)
    scored = gated.join(F.broadcast(most), F.lit(True)).select("item", "callers", "loc", risk.alias("risk"))
    # risks have four digits: the histogram has at most 10,001 rows
    levels = scored.groupBy("risk").agg(F.count("*").alias("n"))
    upto = Window.orderBy(F.desc("risk")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = levels.select("risk", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.greatest(F.lit(1), F.floor(top * F.sum("n").over(whole))).alias("take")).where("before < take")
    within = Window.partitionBy("risk").orderBy("item")
    return scored.join(levels, "risk").withColumn("k", F.row_number().over(within)).where("before + k <= take").select("item", "callers", "loc", "risk")


def overlap_counts(hunks: DataFrame, symbols: DataFrame, bin_lines: int = 1000) -> DataFrame:
    """hunks(file, start, end), symbols(file, symbol, start, end) → file, symbol, score: hunks that overlap it.

    A range join by bins: both sides meet in the bins that they touch, and a pair counts in the first bin of both.
    """
    cut = lambda c: F.floor(F.col(c) / bin_lines).cast("long")
    bins = F.explode(F.sequence(cut("start"), cut("end"))).alias("bin")
    h = hunks.where("start <= end").select("file", F.col("start").alias("hs"), F.col("end").alias("he"), bins)
    s = symbols.where("start <= end").select("file", "symbol", F.col("start").alias("ss"), F.col("end").alias("se"), bins)
    first = F.floor(F.greatest("hs", "ss") / bin_lines)
    met = h.join(s, ["file", "bin"]).where((F.col("he") >= F.col("ss")) & (F.col("hs") <= F.col("se")) & (F.col("bin") == first))
    return met.groupBy("file", "symbol").agg(F.count("*").alias("score"))


def fix_hunks(hunks: DataFrame) -> DataFrame:
    """hunks(..., body: message) of commits that name a fix, a bug or a regression."""
    return hunks.where(F.lower("body").rlike(FIX))


def fragility(hunks: DataFrame, symbols: DataFrame, min_score: int = 2, per_file: int = 5) -> DataFrame:
    """The symbols of each file that fixes touch most."""
    by = Window.partitionBy("file").orderBy(F.desc("score"), "symbol")
    return overlap_counts(hunks, symbols).where(F.col("score") >= min_score).withColumn("k", F.row_number().over(by)).where(F.col("k") <= per_file).drop("k")


def bus_factor(touch: DataFrame, min_share: float = 0.70, min_total: int = 3) -> DataFrame:
    """touch(item, author) → item, author, share, total where one author dominates."""
    counts = touch.groupBy("item", "author").agg(F.count("*").alias("n"))
    rows = counts.withColumn("total", F.sum("n").over(Window.partitionBy("item"))).withColumn("share", F.col("n") / F.col("total"))
    return rows.where((F.col("share") >= min_share) & (F.col("total") >= min_total)).select("item", "author", "share", "total")


def author_summary(touch: DataFrame, k: int = 10) -> DataFrame:
    """The k authors with most touches."""
    return touch.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(k)


def fan(edges: DataFrame, least: int, k: int = 15) -> DataFrame:
    """edges(item, other) → the k items with most distinct others, `least` at least (fan-in or fan-out)."""
    counts = edges.select("item", "other").distinct().groupBy("item").agg(F.count("*").alias("n_distinct"))
    return counts.where(F.col("n_distinct") >= least).orderBy(F.desc("n_distinct"), "item").limit(k)


def jaccard_coupling(edges: DataFrame, min_degree: int = 2, min_shared: int = 2, gate: float = 0.30, cap: float = 0.65) -> DataFrame:
    """edges(item, other) → a, b, jaccard, rate, depth of items with similar others, as edges before there is history."""
    edges = edges.select("item", "other").distinct()
    degree = edges.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= min_degree)
    live = edges.join(degree, "item")
    a, b = live.select("other", F.col("item").alias("a"), F.col("n").alias("na")), live.select("other", F.col("item").alias("b"), F.col("n").alias("nb"))
    both = a.join(b, "other").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    rate = F.round(F.least(F.lit(cap), F.col("jaccard")), 4)
    return both.withColumn("jaccard", j).where(F.col("jaccard") >= gate).select("a", "b", "jaccard", rate.alias("rate"), (2 - rate).alias("depth"))


def sparsify(pairs: DataFrame, fragile: DataFrame) -> DataFrame:
    """pairs(item_a, item_b, support), fragile(item_a, fragility) → the strongest 1, 3 or 6 partners by fragility band."""
    by = Window.partitionBy("item_a").orderBy(F.desc("support"), "item_b")
    keep = F.when(F.col("fragility") < 0.3, 1).when(F.col("fragility") < 0.7, 3).otherwise(6)
    rows = pairs.join(fragile, "item_a").withColumn("rank", F.row_number().over(by))
    return rows.where(F.col("rank") <= keep).select("item_a", "item_b", "support", "rank")


def macro_change(events: DataFrame, hours: float = 48) -> DataFrame:
    """events(key, author, ts) → key, author, group, first_ts, last_ts, n.

    Newest first, an event joins the open group if its author is the group's and it is at most `hours` before the group's
    newest event; otherwise it opens the next one. The window is anchored, so chains of gaps don't merge, and another
    author between two events splits them. Rows of a key come sorted and are folded as a stream: no group is held.
    """
    spec = f"key {events.schema['key'].dataType.simpleString()}, author {events.schema['author'].dataType.simpleString()}, group long, first_ts timestamp_ntz, last_ts timestamp_ntz, n long"
    span = int(hours * 3600 * 1_000_000)

    def run(batches):
        import pyarrow as pa

        names = ["key", "author", "group", "first_ts", "last_ts", "n"]
        open_ = None  # key, author, group, oldest, newest, n
        kinds = None

        def table(rows):
            cols = list(zip(*rows, strict=True))
            kinds_ = [kinds[0], kinds[1], pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds_, strict=True)]
            arrays[3:5] = [a.cast(pa.timestamp("us")) for a in arrays[3:5]]
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            kinds = b.schema.field(0).type, b.schema.field(1).type
            done = []
            for key, author, ts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist(), strict=True):
                if open_ and open_[0] == key and open_[1] == author and open_[4] - ts <= span:
                    open_[3], open_[5] = ts, open_[5] + 1
                    continue
                if open_:
                    done.append(open_)
                open_ = [key, author, open_[2] + 1 if open_ and open_[0] == key else 1, ts, ts, 1]
            if done:
                yield table(done)
        if open_:
            yield table([open_])

    rows = events.where("ts is not null").select("key", "author", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return rows.repartition("key").sortWithinPartitions("key", F.desc("ts"), "author").mapInArrow(run, spec)


def integrity_trend(history: DataFrame, drop: float = 0.20) -> DataFrame:
    """history(item, at, score) → item, at, before, after, drop_pct, alert for each move from one score to the next."""
    by = Window.partitionBy("item").orderBy("at")
    rows = history.select("item", "at", F.lag("score").over(by).alias("before"), F.col("score").alias("after")).where("before is not null")
    pct = F.try_divide(F.col("before") - F.col("after"), F.col("before"))
    return rows.select("item", "at", "before", "after", pct.alias("drop_pct"), F.coalesce(pct > drop, F.lit(False)).alias("alert"))


def temporal_cluster(signals: DataFrame, months: int = 36, least: int = 2) -> DataFrame:
    """signals(key, at) → key, days between first and last, and whether they cluster."""
    rows = signals.groupBy("key").agg(F.date_diff(F.max("at"), F.min("at")).alias("days"), F.count_distinct(F.to_date("at")).alias("n"))
    return rows.select("key", "days", ((F.col("n") >= least) & (F.col("days") / 30.44 <= months)).alias("flag"))

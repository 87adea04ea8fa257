"""Streams: new files and events as they come, upserted by key so that a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old with the batch's rows in place of those with equal keys; of several, the last by `order`."""
    by = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    both = old.unionByName(batch.select(*old.columns))
    return both.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def _versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """Bucket to its versions, the oldest first: the folders `v=<batch>/b=<bucket>` under target that were finished."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for done in fs.globStatus(jvm.Path(f"{target}/v=*/_SUCCESS")) or ():
        v = done.getPath().getParent()
        for b in fs.globStatus(jvm.Path(v, "b=*")) or ():
            found.setdefault(int(b.getPath().getName()[2:]), []).append(int(v.getName()[2:]))
    return {b: sorted(vs) for b, vs in found.items()}


def read_latest(spark: SparkSession, target: str, schema, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The newest version of each bucket (of `buckets`), of versions earlier than `before` where that is given."""
    paths = []
    for b, vs in _versions(spark, target).items():
        old = [v for v in vs if before is None or v < before]
        if old and (buckets is None or b in buckets):
            paths.append(f"{target}/v={old[-1]}/b={b}")
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def prune(spark: SparkSession, target: str, keep: int = 2) -> None:
    """Delete all but the newest `keep` versions of each bucket: a repeated last batch still needs the one before. A
    version that holds no bucket any more goes whole, so listing the versions doesn't grow with the batches."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    held = _versions(spark, target)
    left: dict[int, int] = {}
    for vs in held.values():
        for v in vs:
            left[v] = left.get(v, 0) + 1
    for b, vs in held.items():
        for v in vs[:-keep]:
            left[v] -= 1
            fs.delete(jvm.Path(f"{target}/v={v}/b={b}"), True)
    for v, n in left.items():
        if not n:
            fs.delete(jvm.Path(f"{target}/v={v}"), True)


def _same_buckets(spark: SparkSession, target: str, buckets: int) -> None:
    """Note the number of buckets beside the table; a table that was begun with another can't be continued."""
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    noted = [int(f.getPath().getName()[9:]) for f in fs.globStatus(jvm.Path(f"{target}/_buckets=*")) or ()]
    if noted and noted != [buckets]:
        raise ValueError(f"{target} has {noted[0]} buckets, not {buckets}")
    if not noted:
        fs.mkdirs(path)
        fs.create(jvm.Path(f"{target}/_buckets={buckets}")).close()


def stream_ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: list[str], order: list[str], form: str = "json", buckets: int = 64) -> StreamingQuery:
    """Read the files that are new in `source`, and keep the latest row of each key under `target`; `read_latest` reads it.

    Keys are dealt to a fixed number of buckets by hash. A batch rewrites only the buckets that it touches, as version
    `v=<batch>`, from their newest earlier version, so a batch that runs again writes the same, and older versions go. The number of
    buckets is noted beside the table, which can't be continued with another."""

    def write(batch: DataFrame, n: int) -> None:
        b = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        batch = batch.persist()
        try:
            touched = {r[0] for r in batch.select(b.alias("b")).distinct().collect()}  # at most `buckets` rows
            if touched:
                kept = read_latest(spark, target, batch.schema, n, touched)
                upsert(kept, batch, keys, order).withColumn("b", b).repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{target}/v={n}")
                prune(spark, target)
        finally:
            batch.unpersist()

    _same_buckets(spark, target, buckets)
    rows = spark.readStream.schema(schema).format(form).load(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_events(events: DataFrame) -> DataFrame:
    """Webhook rows (action, pull_request, event): closed and merged requests, and messages that no bot wrote."""
    pr = (F.col("action") == "closed") & F.col("pull_request.merged")
    talk = (F.col("event.type") == "message") & F.col("event.bot_id").isNull()
    return events.where(F.coalesce(pr, F.lit(False)) | F.coalesce(talk, F.lit(False)))


def rules(judged: DataFrame) -> DataFrame:
    """judged(id, at, answer: what a model made of a merged event, with a JSON object in it) → symbol, source_type, ref,
    confidence, text, file, rule: a decision link for each of the answer's rules that has a description. The same event
    gives the same refs, so a repeated batch adds nothing when links are upserted by ref."""
    kind = "rules array<struct<target_file: string, symbol_name: string, rule_title: string, rule_description: string>>"
    found = F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), kind)
    rows = judged.select("id", "at", F.posexplode(found["rules"]).alias("n", "r")).where("length(r.rule_description) > 0")
    ref = F.concat(F.lit("adr/webhook_"), F.date_format("at", "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("n").cast("string"))), 1, 8), F.lit(".md"))
    named = lambda c, other: F.coalesce(F.col(f"r.{c}"), F.lit(other))
    return rows.select(named("symbol_name", "global").alias("symbol"), F.lit("webhook_adr").alias("source_type"), ref.alias("ref"), F.lit(1.0).alias("confidence"), named("rule_title", "Design Rule").alias("text"), named("target_file", "global").alias("file"), F.col("r.rule_description").alias("rule"))


def consolidate(intents: DataFrame, activity: DataFrame, judged: DataFrame, now, days: int = 30, weak: float = 0.2, change: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """intents(file, score), activity(file, at, commits: of each session), judged(file, score, weakening) and a time →
    history(file, score, sessions, commits), alerts(file, before, after, drop) and the intents as they are then.

    Files with sessions in the last `days` days and a judgement are taken; the others stay as they were. An intent without
    a score counts as 0.7. An alert is a fall by more than `weak` of the score, or a judgement that says so; an intent's
    score is replaced if it moved by more than `change`. Run again for the same time, all three are the same."""
    since = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    live = activity.where((F.col("at") >= F.date_trunc("day", since)) & (F.col("at") <= F.lit(now))).groupBy("file").agg(F.count("*").alias("sessions"), F.sum("commits").alias("commits"))
    seen = judged.groupBy("file").agg(F.max_by(F.struct(F.col("score").alias("after"), F.coalesce("weakening", F.lit(False)).alias("weakening")), F.struct("score", "weakening")).alias("j"))
    before = F.coalesce("score", F.lit(0.7))
    rows = intents.select("file", before.alias("before")).join(live, "file").join(seen, "file").select("file", "before", F.coalesce("j.after", "before").alias("after"), "j.weakening", "sessions", "commits")
    drop = F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before")).otherwise(0.0)
    history = rows.select("file", F.col("after").alias("score"), "sessions", "commits")
    alerts = rows.withColumn("drop", drop).where((F.col("drop") > weak) | F.col("weakening")).select("file", "before", "after", F.round(100 * F.col("drop"), 1).alias("drop"))
    moved = rows.where(F.abs(F.col("after") - F.col("before")) > change).select("file", F.col("after").alias("_new"))
    return history, alerts, intents.join(moved, "file", "left").select(*(F.coalesce("_new", "score").alias("score") if c == "score" else F.col(c) for c in intents.columns))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events(ts, key) → window start, key, n. An addition of this engine: event-time windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "key", "n")

"""Session settings that the engine wants; a caller's own session works, too."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition where its number is given, so that a task needs as much memory on a large table as on a small one.
PART_ROWS = 250_000


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with adaptive plans and skew joins on, in UTC; conf overrides."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.master(master).config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame, rows: int = PART_ROWS) -> int:
    """How many partitions of at most about `rows` rows hold df, one for each core at least. Parquet tables are counted
    from their footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if all tasks run on this machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written once to the shared folder and read back, so that its lineage ends there; and its path."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table of `kept`."""
    return kept(df, name)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes kept tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

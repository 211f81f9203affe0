"""Session helpers shared by every operator: lineage cutting, dense ids, size checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bound, in rows, of a table that an operator may hand to `broadcast()` or pull to the driver.
BROADCAST_ROWS = 200_000
#: The same bound in bytes, for rows that hold arrays or long strings.
BROADCAST_BYTES = 64 << 20


def local_session(cpus: int | str = 8, app: str = "vectorloom", **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; invent one only on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="vectorloom-checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and continue from the written copy.

    Used where a plan is read more than once and must not be recomputed, and between the steps of
    iterative jobs. The copy is on shared storage, so a lost executor costs a re-read only.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Kept:
    """Parquet copies of a table that a loop rewrites; `put` writes the next one, continues from it and removes the one before the last.

    A copy's size estimate comes from its files. That of a checkpointed plan is inherited from the plan, and joins multiply it with
    each step, so that after some twenty steps planning takes longer than the work.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.turn = spark, scratch_dir(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{self.turn}")
        if self.turn >= 2:
            remove_folder(self.spark, f"{self.folder}/{self.turn - 2}")
        self.turn += 1
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.turn - 1}")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def dense_ids(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """Number the rows of `df` 0,1,2,... in `order` without a single-task sort.

    A range-partitioned sort is written once; each row then has (partition, offset in partition), and
    a table of partition sizes, one row per partition, supplies the running start of each partition.
    """
    ordered = cut(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_slot", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select(
        "_part",
        (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n"))
        .alias("_start"))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # one row per sort partition
        .withColumn(name, (F.col("_start") + F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)) + start).cast("long"))
        .drop("_slot", "_part", "_start")
    )


def running_total(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Inclusive prefix sum of `value` in `order`, two-level so that no task sees all rows."""
    ordered = cut(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftrightunsigned("_slot", 33))
    sums = ordered.groupBy("_part").agg(F.sum(value).alias("_s"))
    starts = sums.select(
        "_part",
        (F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_s"))
        .alias("_start"))
    inside = F.sum(value).over(
        W.partitionBy("_part").orderBy("_slot").rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        ordered.withColumn("_in", inside)
        .join(F.broadcast(starts), "_part")  # one row per sort partition
        .withColumn(name, F.col("_start") + F.col("_in"))
        .drop("_slot", "_part", "_in", "_start")
    )


def _width(value) -> int:
    return 16 + sum(map(_width, value)) if isinstance(value, (list, tuple)) else 16 + len(value) if isinstance(value, (str, bytes)) else 8


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when `df` has at most `rows` rows that take at most `size` bytes if they are as wide as the first; counts no further."""
    first = df.first()
    if first is None:
        return True
    most = min(rows, size // _width(tuple(first)))
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting; beyond the bound the join falls back to a shuffle."""
    return F.broadcast(df) if fits(df, rows) else df


def draw48(*cols, seed: int = 0):
    """Deterministic whole number in [0, 2^48) of the given columns: the first digits of an MD5 sum, which any SQL engine can repeat."""
    keys = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys, F.lit(str(seed)))), 1, 12), 16, 10).cast("long")


def hash01(*cols, seed: int = 0):
    """Deterministic uniform value in [0,1) from the given columns, stable under recomputation."""
    return draw48(*cols, seed=seed).cast("double") / float(1 << 48)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, reachable by every executor, for files a job writes and reads back."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that Arrow functions can import it anywhere."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_vectorloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='vectorloom-package-')}/vectorloom", "zip", here.parent, here.name)
    sc.addPyFile(archive)
    sc._vectorloom_shipped = True

"""Session helpers shared by every layer: shared storage, lineage cuts, batch bounds."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CREATED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see, as a URI.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and one machine
    does all the work is a folder of our own chosen, and then set for the whole context.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="evigraph-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/evigraph/{label}-{uuid.uuid4().hex}"
    _CREATED[path] = spark
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Hadoop's file system layer, wherever it lives."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _CREATED.pop(path, None)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, wherever it lives."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


@atexit.register
def _clean_up() -> None:
    for path, spark in list(_CREATED.items()):
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                delete_path(spark, path)
            elif path.startswith("file:"):
                import shutil

                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        except Exception:  # the gateway may be gone at exit; nothing else depends on it
            continue


def materialize(df: DataFrame, label: str = "step", compact: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage like ``checkpoint()`` but runs the plan only once, keeps the data
    columnar and compressed, gives later joins real sizes, and survives the loss of
    any executor. ``compact`` deals narrow rows to one file per core first: stages of many
    small partitions otherwise leave as many small files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if compact:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    # what reads this path knows that the job is over: no marker file
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.evigraph_path = path  # for release()
    return out


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; the frame is unusable afterwards."""
    path = getattr(df, "evigraph_path", None)
    if path:
        delete_path(df.sparkSession, path)


def bound_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small enough for very long texts to fit a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    current = int(spark.conf.get(key))
    if current <= 0 or current > rows:
        spark.conf.set(key, str(rows))


def hash_sample(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows, those of the smallest hashes of ``keys``.

    The choice does not depend on the layout of ``df``. A first cut by hash leaves a few
    times ``limit`` rows in all, so partitions send little to the final selection.
    """
    slots = 1 << 30
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots))
    total = max(1, count_rows(df.select(*keys)))
    some = df.where(slot < min(slots, slots * 4 * limit // total + 1))
    return some.orderBy(slot, F.xxhash64(F.lit(1), *keys), *keys).limit(limit)


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], times: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has each key once and in ``times`` how many rows hold it.

    Keys with more than their share of a partition never meet in one task: they are at most
    ``4 * shuffle_width`` by count, so their facts are broadcast and their rows stay where they
    are. Both frames are read twice and should be materialized.
    """
    total = count_rows(rows) if total is None else total
    share = max(1, total // (4 * shuffle_width(rows.sparkSession)))
    hot = F.broadcast(facts.where(F.col(times) > share).drop(times))
    cold = rows.join(F.broadcast(facts.where(F.col(times) > share).select(*keys)), keys, "left_anti").join(facts.where(F.col(times) <= share).drop(times), keys)
    return cold.unionByName(rows.join(hot, keys))


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the given order, without a single task for all rows.

    Rows are range-sorted; each partition's rows are numbered where they are and start at
    the count of the partitions before (one number per partition reaches the driver).
    """
    spark = df.sparkSession
    ranked = materialize(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", 33)
    sizes = sorted((r.p, r.n) for r in ranked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    begin = spark.createDataFrame(starts, "__p long, __begin long")
    return (
        ranked.withColumn("__p", part)
        .join(F.broadcast(begin), "__p")
        .withColumn(name, F.col("__begin") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__id", "__p", "__begin")
    )


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder (local or any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for laptops, tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evigraph")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("EVIGRAPH_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

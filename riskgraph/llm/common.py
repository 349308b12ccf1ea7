"""What the operators share: column picking, tables in the shared folder, connected components."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only; a column whose name differs just in case doesn't clash, of equal names the first counts."""
    unique = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return unique.select(*(F.col(f"c{df.columns.index(name)}").alias(name) for name in names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*names: str) -> Column:
    """128 bits that tell rows apart by the named columns; a null counts as what it is."""
    nulls = [F.col(n).isNull() for n in names]
    return F.struct(*(F.xxhash64(F.lit(k), *nulls, *names).alias(f"key{k}") for k in (1, 2)))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where none is set a folder of this machine, if Spark runs in this process alone."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("riskgraph.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="riskgraph-")
        spark.conf.set("riskgraph.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and the table outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table made by cut(), once nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/llm-", 1)[0] + "/llm-" + f.rsplit("/llm-", 1)[1].split("/")[0] for f in df.inputFiles() if "/llm-" in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the machine, which allocators else keep for the process."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(work: Callable) -> Callable:
    """work, a function of batches or of one group's table, that leaves no freed memory behind: a worker process lives on, idle,
    beside the JVM of its executor through stages that run no Python."""
    if inspect.isgeneratorfunction(work):

        def stream(batches: Iterator) -> Iterator:
            yield from work(batches)
            give_back()

        return stream

    def once(group):
        out = work(group)
        give_back()
        return out

    return once


def shuffle_width(df: DataFrame, least: int = 8) -> int:
    """Partitions for what a scan hands on: as many as it has itself, or the session's number if that is more."""
    scanned = df._jdf.queryExecution().toRdd().getNumPartitions()
    return max(least, scanned, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def components(edges: DataFrame, kind: T.DataType | None = None) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

    edges: two columns of one comparable type, a and b. Returns (node, component) for every node of an edge,
    component being the least node reachable. Each round is joins and combinable minima, so no group is gathered;
    rounds grow with the logarithm of the component size. Empty input gives an empty table.
    """
    links = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select("m", "u")).where("a <> b").distinct()
        after = cut(small)
        drop_table(links)
        links = after
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(links.select("a", "a").distinct())

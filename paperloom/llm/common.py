"""Table access, shared storage, batches bounded by bytes, and joins and components that hold against hot keys."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A portion of a batch that a Python stage works on at a time.
PORTION_BYTES = 1 << 20
PORTION_ROWS = 1000
#: At most so many keys count as hot and are broadcast.
HOT_KEYS = 10_000
#: A table of at most so many bytes on disk may be broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="paperloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one serves a
    session that runs in one process (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _local_folder()
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Scratch:
    """The tables that a computation writes on its way, in a folder of its own below the shared one. A table is written
    once and read back, which cuts its lineage and survives lost executors. ``free`` deletes tables that nothing needs any
    more; the rest goes when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/paperloom/{name}-{uuid.uuid4().hex}"
        fs, path = _path(spark, self.folder)
        fs.deleteOnExit(path)
        self.paths: dict[str, str] = {}

    def place(self, name: str) -> str:
        """A path for a new table or folder, which replaces what the name stood for."""
        self.paths[name] = f"{self.folder}/{name}-{len(self.paths)}-{uuid.uuid4().hex[:6]}"
        return self.paths[name]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.place(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def size(self, name: str) -> int:
        """Bytes that a kept table takes, as measured on the file system."""
        fs, path = _path(self.spark, self.paths[name])
        return int(fs.getContentSummary(path).getLength())

    def small(self, name: str, df: DataFrame) -> DataFrame:
        """df, columns of a kept table, marked for broadcast if the table was measured to be small; a join shuffles otherwise."""
        return F.broadcast(df) if self.size(name) <= BROADCAST_BYTES else df

    def free(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                fs, path = _path(self.spark, self.paths.pop(name))
                fs.delete(path, True)

    def clear(self) -> None:
        """Deletes all tables, those too that others of their name have replaced."""
        fs, path = _path(self.spark, self.folder)
        fs.delete(path, True)
        self.paths.clear()


def partitions_for(spark: SparkSession, size: int, target_bytes: int) -> int:
    """Partitions for a shuffle of a measured number of bytes; never under the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // target_bytes + 1)


def portions(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = PORTION_BYTES, max_rows: int = PORTION_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a portion have at most max_bytes, but for a single longer one. Spark bounds a
    batch by bytes as well (spark.sql.execution.arrow.maxBytesPerBatch); nothing is copied here. An empty batch stays."""
    for rows in batches:
        sizes = pc.fill_null(pc.binary_length(rows.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > max_bytes or i - start >= max_rows):
                yield rows.slice(start, i - start)
                start, held = i, 0
            held += size
        yield rows.slice(start)


def release() -> None:
    """Give memory that a task has freed back to the system, before its worker waits for the next one."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def spread_join(big: DataFrame, small: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of big with small, which has one row a key and the key's number of rows in big as ``weight``, out of
    ``total``. The rows of hot keys stay where they are: at most HOT_KEYS keys can have a HOT_KEYS-th of all rows, and those
    rows of small are broadcast. The other keys are shuffled, and none of them fills a task."""
    least = max(64, total // HOT_KEYS)
    hot, rest = small.where(F.col(weight) >= least).drop(weight), small.where(F.col(weight) < least).drop(weight)
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return big.join(F.broadcast(hot), key).unionByName(cold)


def connected_components(edges: DataFrame, scratch: Scratch, name: str, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges (a long, b long): root is the smallest node reachable.

    Alternates the large-star and small-star steps until all that is left are stars around their smallest node. A step
    groups by a node with a map-side minimum; the minima are joined back by ``spread_join``, so the edges of a node of
    huge degree are never gathered. Null ends are dropped; self loops keep their node in the result.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = scratch.keep(pairs, f"{name}-current")
    for _ in range(max_rounds):
        ends = current.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("up")).withColumn("down", F.lit(False))
        ends = ends.union(current.select(F.col("b").alias("node")).distinct().select("node", F.lit(0).cast("long"), F.lit(True)))
        odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down)")
        if odd.isEmpty():
            break
        before = scratch.paths.pop(f"{name}-current")
        n = current.count()
        # large star: every larger neighbour of u points to the smallest of u and its neighbours
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("w")).select("a", F.least("a", "m").alias("m"), "w")
        large = spread_join(both, low, "a", "w", 2 * n).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.distinct(), f"{name}-large")
        # small star: u and its smaller neighbours point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("w"))
        small = spread_join(large, low, "a", "w", large.count()).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = scratch.keep(small.union(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}-current")
        scratch.free(f"{name}-large")
        scratch.paths["before"] = before
        scratch.free("before")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(current.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))

"""Shared-folder materialisation and connected components used by several operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a maximal run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables written below spark.checkpoint.dir, which every executor can read; a lost executor costs no rerun of
    what was cut. Where the setting is absent a local session (tests) gets a temporary folder; a cluster is refused."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="terncube-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/terncube/{uuid.uuid4().hex}"
        self.made: dict[int, str] = {}

    def cut(self, df: DataFrame, free: bool = True) -> DataFrame:
        """Write df and return the table that was written: the lineage ends here. free: have the cleaner delete the shuffle
        files that led to it; else they stay until the next such call."""
        path = f"{self.root}/{len(self.made)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if free:  # shuffle files go once the driver drops what led to the table
            gc.collect()
            self.spark._jvm.System.gc()
        self.made[id(out)] = path
        self._keep = [*getattr(self, "_keep", []), out]
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that cut() made and nothing reads any more."""
        for df in tables:
            path = self.made.get(id(df)) if df is not None else None
            if path:
                jvm = self.spark._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def sieve(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key is among wanted's one column, distinct and of integers, and a few others: for a table too
    wide to be dealt out for an exact join. A table of bits is broadcast, 16 or more for each of wanted's rows up to a
    million words of 64; beyond that more of the others pass."""
    words = 64
    n = wanted.count()
    while 4 * words < n and words < 1 << 20:
        words *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * words))
    marks = wanted.select(place(wanted.columns[0]).alias("p")).select(F.shiftright("p", 6).alias("__w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("m"))
    marks = marks.groupBy("__w").agg(F.bit_or("m").alias("__bits"))
    at = df.withColumn("__p", place(key)).withColumn("__w", F.shiftright("__p", 6))
    some = at.join(F.broadcast(marks), "__w").where("(shiftrightunsigned(__bits, cast(__p & 63 as int)) & 1L) = 1L")
    return some.select(*[F.col(f"`{c}`") for c in df.columns])


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """Connected components of undirected edges (a, b), of any orderable type: (node, component), component the
    smallest node. Nulls and self-links are no edges. Large-star and small-star rounds, every one written to the shared
    folder; only a row count and a checksum of the edges reach the driver."""
    e = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    last = state(e)
    for _ in range(max_rounds if last[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.cut(small.unionByName(roots.select("u", F.col("m").alias("v"))).distinct(), free=False)
        now = state(new)
        scratch.drop(e)
        e = new
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

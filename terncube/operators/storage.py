"""Packed probabilities, stamps, digests, readiness and fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 30000
#: Fixed order of ensemble members.
MEMBERS = ["brt", "glm", "gam", "rf", "nn"]
DEFAULT_MEMBERS = ["brt", "glm", "gam", "rf"]


def pack(p: Column) -> Column:
    """16-bit form: half-even p * 30000, -1 for null."""
    return F.coalesce(F.rint(p * SCALE), F.lit(-1.0)).cast("smallint")


def unpack(v: Column) -> Column:
    return F.when(v >= 0, v / SCALE)


def replicate_stamp(cube: DataFrame) -> DataFrame:
    """The sorted non-zero replicate ids of each species and year, as text; a new replicate changes it."""
    ids = cube.where("replicate <> 0").groupBy("species", "year").agg(F.array_sort(F.collect_set("replicate")).alias("ids"))
    return ids.select("species", "year", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("stamp"))


def digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free digest of columns: row count, and the sum and exclusive or of row hashes."""
    h = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("sum"), F.bit_xor(h).alias("xor"))


def missing(required: DataFrame, present: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """Required partitions that are not there, in order; most: the length of the report."""
    out = required.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti").orderBy(*keys)
    return out if most is None else out.limit(most)


def readiness(required: DataFrame, present: DataFrame, key: str, keys: Sequence[str]) -> DataFrame:
    """(key, ready): whether all that a key requires is present."""
    have = present.select(*keys).distinct().withColumn("__have", F.lit(1))
    return required.join(have, list(keys), "left").groupBy(key).agg((F.count("__have") == F.count("*")).alias("ready"))


def resolve(wanted: DataFrame, overrides: DataFrame, keys: Sequence[str], value: str, default: Column) -> DataFrame:
    """The override of a key, or the default where it is missing or null."""
    return wanted.join(overrides.select(*keys, F.col(value).alias("__v")), list(keys), "left").select(*wanted.columns, F.coalesce("__v", default).alias(value))


def member_tag(members: Column) -> Column:
    """Tag of a member set in canonical order; the default set is ens."""
    known = F.array(*map(F.lit, MEMBERS))
    ordered = F.filter(known, lambda m: F.array_contains(members, m))
    return F.when(F.size(ordered) == 0, F.raise_error(F.lit("no members"))).when(ordered == F.array(*map(F.lit, DEFAULT_MEMBERS)), "ens").otherwise(F.concat(F.lit("ens_"), F.array_join(ordered, "-")))


def scale_label(resolution: Column) -> Column:
    """scale_<km> without the point; not unique, so tables are keyed by the resolution."""
    km = F.regexp_replace((resolution / 1000).cast("decimal(20,3)").cast("string"), r"\.?0+$|\.", "")
    return F.concat(F.lit("scale_"), km)


def shared_folder(spark, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor reaches. Where that is not set a local session gets a
    temporary folder; a cluster is refused."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="terncube-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def two_layers(cells: DataFrame, threshold: float, value: str = "prob", out: str = "mean_prob") -> DataFrame:
    """A probability layer and whether it reaches the threshold, null where there is no probability."""
    rest = [c for c in cells.columns if c != value]
    return cells.select(*rest, F.col(value).alias(out), (F.col(value) >= threshold).alias("is_present"))


def combine(layers: Sequence[DataFrame], keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """One table with the columns of several on the same cells; a cell that one lacks has nulls there."""
    out = layers[0]
    for df in layers[1:]:
        out = out.join(df, list(keys), "full_outer")
    return out


def assert_same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """a, which raises when read if one of the two has key values that the other lacks."""
    one = a.select(*keys, F.lit(1).alias("__a")).distinct().join(b.select(*keys, F.lit(1).alias("__b")).distinct(), list(keys), "full_outer")
    odd = one.agg(F.count(F.when(F.col("__a").isNull() | F.col("__b").isNull(), 1)).alias("__odd"))
    fault = F.when(F.col("__odd") > 0, F.raise_error(F.concat(F.col("__odd").cast("string"), F.lit(" keys differ"))).cast("string"))
    return odd.select(fault.alias("__f")).join(a, F.lit(True), "left").where("__f is null").select(*a.columns)


def write_cube(df: DataFrame, path: str, keys: Sequence[str] = ("species", "year")) -> None:
    """Write packed probabilities partitioned by keys; only the partitions that df has are replaced."""
    out = df.withColumn("prob", pack(F.col("prob"))).repartition(*keys)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_cube(spark, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("prob", unpack(F.col("prob")))


def union_runs(runs: Sequence[DataFrame], zero: bool = False) -> DataFrame:
    """Replicates of several runs; an id that two runs have raises when the result is read. Replicate 0 only if asked for."""
    tagged = [r.withColumn("__run", F.lit(i)) for i, r in enumerate(runs)]
    out = tagged[0]
    for r in tagged[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    clash = out.where("replicate <> 0").groupBy("replicate").agg(F.count_distinct("__run").alias("n")).where("n > 1").agg(F.array_sort(F.collect_list("replicate")).alias("ids"))
    checked = out.join(clash).withColumn("replicate", F.when(F.size("ids") > 0, F.raise_error(F.concat(F.lit("replicates in two runs: "), F.array_join(F.col("ids").cast("array<string>"), ",")))).otherwise(F.col("replicate")))
    checked = checked.drop("__run", "ids")
    return checked if zero else checked.where("replicate <> 0")

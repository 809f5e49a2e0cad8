"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are lifted to the unit sphere so that the largest inner product is the smallest angle, rotated by fast Hadamard
pseudo-rotations and assigned to the nearest signed axis. A table joins two such hashes, the second over few axes so that
the number of buckets follows the number of vectors; a query probes the cheapest buckets of every table and its
candidates are ranked exactly, in double precision. How many buckets is measured on each table: the exact neighbours of a
sample of its queries tell how many probes find them. Where that would visit half the table or more, all of it is
compared.

Defined results: vectors that are null, zero, of another dimension than the most frequent one, or that hold null or
non-finite components take no part, nor do rows without an id; equal vectors are found as one class and told apart by id;
an empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terncube.llm.runtime import Scratch


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised transform of every row, in steps of up to four butterfly levels at once."""
    n, width, h = *x.shape, 1
    while h < width:
        r = min(16, width // h)
        small = np.ones((1, 1))
        while len(small) < r:
            small = np.block([[small, small], [small, -small]])
        x = np.matmul(small, x.reshape(n, width // (r * h), r, h)).reshape(n, width)
        h *= r
    return x / np.sqrt(width)


#: Rotations of up to DENSE components, which a worker keeps.
DENSE = 256
_SPUN: dict[tuple, np.ndarray] = {}


@dataclass
class CrossPolytope:
    """tables hash tables over vectors of dim components whose largest norm is norm; the second hash of a table has
    2 * axes values."""

    dim: int
    norm: float
    tables: int
    axes: int
    seed: int = 1

    @property
    def padded(self) -> int:
        return 1 << self.dim.bit_length()

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors of padded components; the norm that a vector lacks is its last one (0 for queries)."""
        out = np.zeros((len(x), self.padded))
        if query:
            out[:, : self.dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
        else:
            out[:, : self.dim] = x / self.norm
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (out[:, : self.dim] ** 2).sum(1)))
        return out

    def rotate(self, x: np.ndarray, number: int) -> np.ndarray:
        """Three times random signs and the fast Hadamard transform; up to DENSE components as one product."""
        if self.padded > DENSE:
            return self.spun(x, number)
        key = (self.seed, self.padded, self.axes, number)
        if key not in _SPUN:
            _SPUN[key] = self.spun(np.eye(self.padded), number)[:, : self.axes if number % 2 else self.padded].copy()
        return x @ _SPUN[key]

    def spun(self, x: np.ndarray, number: int) -> np.ndarray:
        signs = np.random.default_rng([self.seed, number]).integers(0, 2, (3, self.padded)) * 2.0 - 1
        for s in signs:
            x = hadamard(x * s)
        return x

    def scores(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """How well each signed axis fits, for the two hashes of a table: a bucket is a pair of axes."""
        a, b = self.rotate(x, 2 * table), self.rotate(x, 2 * table + 1)[:, : self.axes]
        return np.concatenate([a, -a], 1), np.concatenate([b, -b], 1) if self.axes else np.zeros((len(x), 1))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        lifted = self.lift(x, False)
        pairs = [self.scores(lifted, t) for t in range(self.tables)]
        return np.stack([a.argmax(1) * b.shape[1] + b.argmax(1) for a, b in pairs], 1).astype(np.int32)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n buckets of each table that lose least against the best one, by the squares of the lost heights."""
        lifted, out = self.lift(x, True), []
        for t in range(self.tables):
            found = []
            for s in self.scores(lifted, t):
                order = np.argsort(-s, axis=1)[:, : min(n, s.shape[1])]
                best = np.take_along_axis(s, order, 1)
                found.append((order, (best[:, :1] - best) ** 2))
            (i, u), (j, v) = found
            a, b = np.nonzero(np.outer(np.arange(1, u.shape[1] + 1), np.arange(1, v.shape[1] + 1)) <= n)  # others have n before them
            loss, pair = u[:, a] + v[:, b], i[:, a] * max(1, 2 * self.axes) + j[:, b]
            if n < len(a):
                pair = np.take_along_axis(pair, np.argpartition(loss, n - 1, axis=1)[:, :n], 1)
            out.append(pair)
        return np.stack(out, 1).astype(np.int32)

    def needed(self, query: np.ndarray, other: np.ndarray) -> np.ndarray:
        """For each pair of rows the least number of probes with which some table finds other for query."""
        asks, held, out = self.lift(query, True), self.lift(other, False), np.full(len(query), 1 << 30)
        for t in range(self.tables):
            (a, b), (c, d) = self.scores(asks, t), self.scores(held, t)
            u, v = ((s.max(1, keepdims=True) - s) ** 2 for s in (a, b))
            rows = np.arange(len(u))
            loss, v = u[rows, c.argmax(1)] + v[rows, d.argmax(1)], np.sort(v, 1)
            ranks = [np.searchsorted(y, z + 1e-12 - x, side="right").sum() for x, y, z in zip(u, v, loss, strict=True)]
            out = np.minimum(out, ranks)
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(query: np.ndarray, other: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of each query's n best others, nearest first, ties to the smaller id; an other counts once."""
    order = np.lexsort((other, -score, query))
    q, o = query[order], other[order]
    again = np.zeros(len(q), bool)
    again[1:] = (q[1:] == q[:-1]) & (o[1:] == o[:-1])
    order, q = order[~again], q[~again]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < n]


def _probes_for(classes: DataFrame, hashes: CrossPolytope, n: int, recall: float, sample: int) -> int:
    """How many probes a table find the recall-th part of the n best classes of sample asking classes, those with the
    smallest hashes. The sample travels to every task, which sends back its n best for each; only a number returns."""
    asking = classes.where("asks").select("class", "v").orderBy(F.xxhash64("class"), "class").limit(sample).collect()
    if not asking:
        return 0
    names, asks, dim = np.array([r["class"] for r in asking]), np.array([r["v"] for r in asking]), hashes.dim

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # (query, class, score, vector) of the best so far
        for b in batches:
            for lo in range(0, b.num_rows, 8192):
                part = b.slice(lo, 8192)
                ids, v = part.column("class").to_numpy(), _matrix(part.column("v"), dim)
                score = asks @ v.T
                m = min(n + 1, len(ids))
                top = np.argpartition(-score, m - 1, axis=1)[:, :m]
                at = top.reshape(-1)
                held.append((np.repeat(np.arange(len(asks)), m), ids[at], np.take_along_axis(score, top, 1).reshape(-1), v[at]))
                q, o, s, w = (np.concatenate(c) for c in zip(*held, strict=True))
                best = _best(q, o, s, n + 1)
                held = [(q[best], o[best], s[best], w[best])]
        if held:
            q, o, s, w = held[0]
            vectors = pa.ListArray.from_arrays(np.arange(0, w.size + 1, dim, dtype=np.int32), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(o), pa.array(s), vectors], names=["query", "class", "score", "v"])

    @F.pandas_udf("int")
    def needed(query: pd.Series, v: pd.Series) -> pd.Series:
        out = [hashes.needed(asks[query.iloc[lo : lo + 512].to_numpy()], np.stack(v.iloc[lo : lo + 512].to_numpy())) for lo in range(0, len(v), 512)]
        return pd.Series(np.concatenate(out) if out else [], dtype="int32")

    met = classes.select("class", "v").mapInArrow(rank, "query int, class long, score double, v array<double>")
    own = F.col("class") == F.element_at(F.array(*map(F.lit, names.tolist())), F.col("query") + 1)
    true = met.where(~own).withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))).where(F.col("n") < n)
    found = true.select(needed("query", "v").alias("needed")).agg(F.percentile("needed", F.lit(recall)).alias("p")).first()["p"]
    return int(np.ceil(found)) if found is not None else 0


def nearest(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", tables: int = 16, probes: int = 32, per_bucket: int = 20, block: int = 8192, recall: float = 0.95, sample: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which is_query holds, its k nearest other rows by inner product.

    Equal vectors are one class that lists its k + 1 smallest ids: no answer needs more. Every table is one shuffle of the
    classes; a bucket of more than block classes is dealt out over several tasks, which its queries visit all. A task
    keeps the k + 1 best classes of each query it has met, so what leaves it is bounded by its queries.

    probes is the least number a table; it is raised until that share (recall) of the exact neighbours of sample queries is
    found. If the candidates are then half of the classes or more, every query is compared with every class."""
    spark, scratch, keep = vectors.sparkSession, Scratch(vectors.sparkSession), k + 1
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == dims["d"])
    hashed = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = hashed.withColumn("n", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).where(F.col("n") <= keep)
    ids = some.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids"))
    asking = hashed.groupBy("v").agg(F.max("asks").alias("asks"))
    classes = scratch.cut(ids.join(asking, "v").select(F.element_at("ids", 1).alias("class"), "v", "ids", "asks", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")))
    whole = classes.agg(F.count("*").alias("n"), F.max("norm").alias("norm")).first()
    padded = 1 << dims["d"].bit_length()
    more = whole["n"] // (per_bucket * 2 * padded)
    hashes = CrossPolytope(dims["d"], whole["norm"], tables, min(padded, 1 << (more.bit_length() - 1)) if more else 0)
    dim, most = hashes.dim, float(whole["norm"]) ** 2
    probes = max(probes, _probes_for(classes, hashes, keep, recall, sample))
    width = 2 * padded * max(1, 2 * hashes.axes)
    scan = probes >= width or 2 * tables * probes >= width

    def places(df: DataFrame, ask: bool) -> DataFrame:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = max(16, min(1024, (1 << 22) // (min(probes, 2 * padded) * min(probes, max(1, 2 * hashes.axes))))) if ask else 1024
            for b in batches:
                for lo in range(0, b.num_rows, rows):
                    part = b.slice(lo, rows)
                    x = _matrix(part.column("v"), dim)
                    found = (hashes.probes(x, probes) if ask else hashes.buckets(x)[:, :, None]).astype(np.int32)
                    n, t, m = found.shape
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n * t + 1, dtype=np.int32) * m), pa.array(found.reshape(-1)))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * t), lists)
                    yield pa.RecordBatch.from_arrays([part.column("class"), part.column("v"), lists], names=["class", "v", "places"])

        return df.select("class", "v").mapInArrow(of, "class long, v array<double>, places array<array<int>>")

    def spread(df: DataFrame, ask: bool) -> DataFrame:
        if scan:
            return df.select("class", "v", F.lit(0).alias("table"), F.lit(0).alias("bucket"))
        by_table = places(df, ask).select("class", "v", F.posexplode("places").alias("table", "buckets"))
        return by_table.select("class", "v", "table", F.explode("buckets").alias("bucket"))

    index = spread(classes, False)
    full = index.groupBy("table", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > block).select("table", "bucket", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    full = scratch.cut(full)
    stored = index.join(full, ["table", "bucket"], "left").select("table", "bucket", F.pmod(F.xxhash64("class"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(0).alias("kind"), "class", "v")
    asked = spread(classes.where("asks"), True).join(full, ["table", "bucket"], "left").select("table", "bucket", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(1).alias("kind"), "class", "v")
    met = stored.unionByName(asked).repartition("table", "bucket", "part").sortWithinPartitions("table", "bucket", "part", "kind")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query", "class", "score"]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, now, ids, vs = 0, None, [], []
        sure = (np.zeros(0, np.int64), np.zeros(0))  # queries with enough found, and the score that a better one must reach

        def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, o, s = (np.concatenate(c) for c in zip(*held, strict=True))
            at = _best(q, o, s, keep)
            return q[at], o[at], s[at]

        def reach(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            last = np.flatnonzero(np.append(found[0][1:] != found[0][:-1], True))
            full = np.diff(last, prepend=-1) == keep
            return found[0][last[full]], found[2][last[full]]

        def batch(found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names)

        for b in batches:
            place = np.stack([b.column(c).to_numpy() for c in ("table", "bucket", "part", "kind")], 1)
            klass, v = b.column("class").to_numpy(), _matrix(b.column("v"), dim)
            cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(1)])) if len(place) else []
            for lo, hi in zip(cut, np.append(cut[1:], len(place)), strict=True):
                here = tuple(place[lo, :3])
                if here != now:
                    now, ids, vs = here, [], []
                if place[lo, 3] == 0:
                    ids.append(klass[lo:hi])
                    vs.append(v[lo:hi])
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, vs = [np.concatenate(ids)], [np.concatenate(vs)]
                for at in range(lo, hi, 512):
                    q = v[at : min(hi, at + 512)]
                    rough = q @ vs[0].T
                    n = min(keep + 8, rough.shape[1])
                    top = np.argpartition(-rough, n - 1, axis=1)[:, :n] if n < rough.shape[1] else np.broadcast_to(np.arange(n), rough.shape)
                    own = klass[at : at + len(q)]
                    least = np.full(len(q), -np.inf)
                    if len(sure[0]):
                        spot = np.minimum(np.searchsorted(sure[0], own), len(sure[0]) - 1)
                        least = np.where(sure[0][spot] == own, sure[1][spot], -np.inf)
                    # far below any error of summation: what may reach its place is summed anew, in one order for every block
                    close = np.take_along_axis(rough, top, 1) >= (least - 1e-6 * (np.abs(least) + most))[:, None]
                    one, other = np.nonzero(close)
                    other = top[one, other]
                    held.append((own[one], ids[0][other], (q[one] * vs[0][other]).sum(1)))
                    size += len(one)
                if size > 1 << 18:
                    held = [reduced()]
                    size, sure = len(held[0][0]), reach(held[0])
                    if size > 1 << 17:
                        yield batch(held[0])
                        held, size = [], 0
        if held:
            yield batch(reduced())

    near = met.mapInArrow(rank, "query long, class long, score double")
    once = near.groupBy("query", "class").agg(F.max("score").alias("score"))
    best = once.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))).where(F.col("n") <= keep)
    members = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("id"))
    lists = members.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("n") <= keep)
    answer = lists.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("found"))
    queries = rows.where("asks").select("id", "v").join(classes.select("v", "class"), "v").select("id", F.col("class").alias("query"))
    out = queries.join(answer, "query").select("id", F.posexplode(F.expr(f"slice(filter(found, x -> x.id <> id), 1, {k})")).alias("at", "hit"))
    return out.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)

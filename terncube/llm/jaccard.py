"""Exact n-gram Jaccard join by rare-first prefix filtering, as connected components of its links.

Two documents link when their sets of k-word shingles have den * |intersection| >= num * |union|. Sets are ordered by one
total order, rare shingles first, and two that link share a shingle of their prefixes. What shares a prefix shingle is
compared with one leader first; only members that are in another component than their leader are then paired with the
others, so that a group of copies costs a pair each, and still every two linked texts end in one component.

Defined results: a null or empty text, or one of white space, has no shingles and links with nothing; a text of fewer than
k words is one shingle; equal sets link; repeated rows share their component; a null id is never the smallest unless a
component has no other. Sets are named by 64-bit hashes. Columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terncube.llm.runtime import Scratch, components
from terncube.llm.shingles import mix, shingle_sets

COUNT_BITS, COUNT_PARTS = 24, 256
BINS = 32
CHUNK = 1 << 22


@dataclass(frozen=True)
class Measure:
    """k words a shingle and the least Jaccard similarity, num / den."""

    k: int = 3
    num: int = 90
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-n * self.num // self.den) + 1 if n else 0

    def overlap_sql(self, a: str, b: str) -> str:
        """The least intersection of two sets of sizes a and b that link."""
        return f"ceil(({a} + {b}) * {self.num} / {self.num + self.den} - 1e-9)"


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about CHUNK bytes of text."""
    for batch in batches:
        lo, size, held = 0, 0, []
        for i, x in enumerate(batch.column(column)):
            held.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
            size += len(held[-1])
            if size >= CHUNK:
                yield batch.slice(lo, i + 1 - lo), held
                lo, size, held = i + 1, 0, []
        if held:
            yield batch.slice(lo), held


def _name(s: np.ndarray) -> int:
    """64 bits for a set; 0 for the empty one."""
    return int(mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else 0


def _describe(rows: DataFrame, m: Measure) -> DataFrame:
    """Of rows (key, text, digest): a row each (key, digest, sid, n, bins), bins counting the set by hash range, and rows
    (part, counts) that count all shingles by the first COUNT_BITS bits of their hash."""
    schema = "key long, digest binary, sid long, n int, bins array<int>, part int, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.binary()]

    def made(columns: list) -> pa.RecordBatch:
        size = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch, raw in _texts(batches, "text"):
            sets = shingle_sets(raw, m.k)
            at, times = np.unique((np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)).astype(np.uint32), return_counts=True)
            total[at] += times.astype(np.uint32)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            bins = np.bincount(owner * BINS + (np.concatenate(sets) & np.uint64(BINS - 1)).astype(np.int64), minlength=len(sets) * BINS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BINS, pa.int32()), pa.array(bins, pa.int32()))
            yield made([batch.column("key"), batch.column("digest"), [_name(s) for s in sets], [len(s) for s in sets], lists, None, None])
        if total.any():
            yield made([None] * 5 + [list(range(COUNT_PARTS)), [zlib.compress(p.astype("<u4").tobytes(), 1) for p in total.reshape(COUNT_PARTS, -1)]])

    return rows.select("key", "text", "digest").mapInArrow(run, schema)


def _levels(counts: DataFrame) -> np.ndarray:
    """For each hash range how many shingles it has, on a scale of eighths of a doubling (0: none): one byte a range, so
    2^COUNT_BITS bytes reach the driver, whatever the corpus."""
    size = (1 << COUNT_BITS) // COUNT_PARTS

    def add(key, frame):
        total = np.zeros(size, np.int64)
        for blob in frame["counts"]:
            total += np.frombuffer(zlib.decompress(blob), "<u4")
        level = np.where(total > 0, 1 + np.floor(8 * np.log2(np.maximum(total, 1))), 0)
        return pd.DataFrame({"part": [int(key[0])], "levels": [zlib.compress(np.minimum(level, 255).astype(np.uint8).tobytes(), 1)]})

    out = np.zeros(1 << COUNT_BITS, np.uint8)
    for r in counts.groupBy("part").applyInPandas(add, "part int, levels binary").collect():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return out


def _postings(rows: DataFrame, m: Measure, levels) -> DataFrame:
    """(shingle, sid, n, pos) of every prefix; a task names an equal set once while it remembers it."""
    names = ["shingle", "sid", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen, order = levels.value, set(), deque()
        for _, raw in _texts(batches, "text"):
            out, sids, sizes, lengths = [], [], [], []
            for s in shingle_sets(raw, m.k):
                sid = _name(s)
                if not len(s) or sid in seen:
                    continue
                seen.add(sid)
                order.append(sid)
                if len(order) > 200_000:
                    seen.discard(order.popleft())
                p = m.prefix(len(s))
                out.append(s[np.argsort(often[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], kind="stable")[:p]])
                sids.append(sid)
                sizes.append(len(s))
                lengths.append(p)
            if out:
                reps = np.array(lengths)
                pos = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(np.array(sids, np.int64), reps)), pa.array(np.repeat(np.array(sizes, np.int32), reps)), pa.array(pos.astype(np.int32))], names=names)

    return rows.select("text").mapInArrow(run, "shingle long, sid long, n int, pos int")


def _shared(postings: DataFrame) -> DataFrame:
    """The postings of prefix shingles that several sets have, each with the leader of its shingle: the set with the fewest
    rarer shingles. many: whether more than two sets have it. One shuffle; the sorted rows are only passed along, whatever
    the size of a group."""
    names = ["shingle", "sid", "n", "pos", "lead", "lead_n", "lead_pos", "many"]
    sorted_rows = postings.repartition("shingle").sortWithinPartitions("shingle", "pos", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)
        lead, seen = None, 0  # of a group that began in an earlier batch, and its rows there

        def emit(rows: np.ndarray, after: np.ndarray):
            nonlocal lead, seen
            key = rows[0]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            head, known = rows[:, start].copy(), size.copy()
            if lead is not None and lead[0] == key[0]:
                head[:, 0] = lead
                known[0] += seen
            lead, seen = head[:, -1].copy(), int(known[-1])
            known[-1] += (after == key[-1]).sum()
            full, many = np.repeat(head, size, axis=1), np.repeat(known > 2, size)
            group = np.repeat(known > 1, size)
            full, rows = full[:, group], rows[:, group]
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32)), pa.array(rows[3].astype(np.int32)), pa.array(full[1]), pa.array(full[2].astype(np.int32)), pa.array(full[3].astype(np.int32)), pa.array(many[group])], names=names)

        for b in batches:
            rows = np.concatenate([held, np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)])], axis=1)
            cut = max(0, rows.shape[1] - 2)  # the last two wait: whether others share their shingle shows in the next batch
            if cut:
                yield emit(rows[:, :cut], rows[0, cut:])
            held = rows[:, cut:]
        if held.shape[1]:
            yield emit(held, held[0, :0])

    return sorted_rows.mapInArrow(run, "shingle long, sid long, n int, pos int, lead long, lead_n int, lead_pos int, many boolean")


def _may_link(m: Measure, a: str, b: str) -> str:
    """Length and positional filters, for sets a and b (prefixes of the names of n and pos)."""
    need = m.overlap_sql(f"{a}n", f"{b}n")
    return f"least({a}n, {b}n) * {m.den} >= greatest({a}n, {b}n) * {m.num} and 1 + least({a}n - {a}pos, {b}n - {b}pos) - 1 >= {need}"


def _may_overlap(m: Measure, a: str, b: str) -> str:
    """Suffix filter: how differently two sets spread over hash ranges bounds how much they differ."""
    apart = f"aggregate(zip_with({a}bins, {b}bins, (x, y) -> abs(x - y)), 0, (s, x) -> s + x)"
    return f"{apart} * {m.num + m.den} <= ({a}n + {b}n) * {m.den - m.num}"


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, m: Measure) -> DataFrame:
    """Those of the distinct pairs (a, b) of sids that link: first the suffix filter, on how the two sets spread over hash
    ranges, then the sets themselves."""
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("digest").alias(f"{c}_digest"), F.col("n").alias(f"{c}_n"), F.col("bins").alias(f"{c}_bins"))
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(_may_overlap(m, "a_", "b_"))
    near = near.select("a", "b", "a_digest", "b_digest")
    text = lambda c: texts.select(F.col("digest").alias(f"{c}_digest"), F.col("text").alias(f"{c}_text"))
    whole = near.join(text("b"), "b_digest").join(text("a"), "a_digest").select("a", "a_text", "b", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                named: dict[int, bytes] = {}
                for c in ("a", "b"):
                    for sid, x in zip(part.column(c).to_pylist(), part.column(f"{c}_text"), strict=True):
                        if sid not in named:
                            named[sid] = x.as_buffer().to_pybytes()
                sets = dict(zip(named, shingle_sets(list(named.values()), m.k), strict=True))
                keep = []
                for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                    both = np.concatenate([sets[a], sets[b]])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(common * m.den >= (len(both) - common) * m.num)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return whole.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, measure: Measure = Measure(), key: str = "doc_id", text: str = "text", sets: bool = False) -> DataFrame:
    """(key, n_shingles, component): a row per row of docs; component is the smallest key in its component of links. sets:
    also digest, the MD5 of the text, and link_set, a name of the component that is null only where there are no shingles.

    Shingles are ordered by the count of their hash range, to an eighth of a doubling, then by hash: what a group of copies
    or a template repeats comes after what a text has for itself. The 2^COUNT_BITS counts alone are broadcast."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    told = scratch.cut(_describe(rows, measure))
    members = told.where("part is null").select("key", "digest", "sid", "n")
    known = scratch.cut(told.where("part is null and n > 0").groupBy("sid").agg(F.min(F.struct("digest", "n", "bins")).alias("x"), F.min("key").alias("first")).select("sid", "x.*", "first"))
    levels = spark.sparkContext.broadcast(_levels(told.where("part is not null").select("part", "counts")))
    shared = scratch.cut(_shared(_postings(rows, measure, levels)))
    texts = rows.select("digest", "text")
    # two sets that share a shingle with no third are a leader and its only mate: their pair is compared here or cannot link
    star = shared.where("sid <> lead").where(_may_link(measure, "", "lead_")).select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    wanted = lambda pairs: texts.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(known, "sid").select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    star = scratch.cut(star.distinct())
    links = scratch.cut(_verified(star, known, wanted(star), measure))
    comp = scratch.cut(components(links, scratch))
    label = lambda c, out: comp.select(F.col("node").alias(c), F.col("component").alias(out))
    placed = shared.where("many").join(label("sid", "own"), "sid", "left").join(label("lead", "lead_own"), "lead", "left").withColumns({"own": F.coalesce("own", "sid"), "lead_own": F.coalesce("lead_own", "lead")})
    spread = known.select("sid", "bins")
    out_rows = placed.where("own <> lead_own").join(spread, "sid").select("shingle", *[F.col(c).alias(f"o_{c}") for c in ("sid", "n", "pos", "own", "bins")])
    met = placed.join(placed.where("own <> lead_own").select("shingle").distinct(), "shingle", "left_semi").join(spread, "sid")
    all_rows = met.select("shingle", *[F.col(c).alias(f"m_{c}") for c in ("sid", "n", "pos", "own", "lead_own", "bins")])
    near = f"{_may_link(measure, 'o_', 'm_')} and {_may_overlap(measure, 'o_', 'm_')}"
    cross = out_rows.join(all_rows, "shingle").where("o_own <> m_own and (m_own = m_lead_own or o_sid < m_sid)").where(near)
    cross = scratch.cut(cross.select(F.least("o_sid", "m_sid").alias("a"), F.greatest("o_sid", "m_sid").alias("b")).distinct().join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti"))
    more = scratch.cut(_verified(cross, known, wanted(cross), measure))
    final = scratch.cut(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b")), scratch))
    by_set = known.join(final.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    smallest = by_set.groupBy("component").agg(F.min("first").alias("smallest"))
    named = by_set.join(smallest, "component").select("sid", "smallest", F.col("component").alias("link_set"))
    out = members.join(named, "sid", "left")
    own = F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("smallest"))
    scratch.drop(shared, links, star, cross, more)
    return out.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), own.alias("component"), *(["digest", "link_set"] if sets else []))


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("component", "component_id")

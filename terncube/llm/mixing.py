"""Mix sources to target weights: hash-random order within each source, distributed prefix sums, exact budgets.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, ordered last;
an empty table gives an empty result; repeated rows are rows of their own; rows that agree in id, size and text are
interchangeable. Only the named columns are read, so clashing extra columns do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from terncube.llm.runtime import Scratch

WEIGHTS = (3, 1, 2)
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


@F.pandas_udf(LongType())
def n_words(text: pd.Series) -> pd.Series:
    """Words of each text; bytes.split() parts at the six ASCII white space characters only."""
    return text.map(lambda t: len(t.encode("utf-8", "surrogatepass").split()) if t else 0).astype("int64")


@F.pandas_udf(StringType())
def first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    """Each text up to the end of its n-th word; all of it if it has no more words."""
    return pd.Series([t if t is None or (last := next(islice(WORD_BYTES.finditer(t.encode("utf-8", "surrogatepass")), k, None), None)) is None else t.encode("utf-8", "surrogatepass")[: last.start()].rstrip(b" \t\n\x0b\x0c\r").decode("utf-8", "surrogatepass") for t, k in zip(text, n, strict=True)], dtype=object)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target) from sizes (source, size). The sources share percent % of all sizes by weight, the
    weights repeating over the sources by code point, null last; a target stops at most times its source's size and the
    excess is reshared by weight. Such targets are min(most * size, w * level) for one level, found by ordering the
    sources by the level at which they fill: one row a source from here on."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    i = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (i % len(weights) + 1).cast("int"))
    full = by.withColumn("w", w.cast("long")).withColumn("room", F.col("source_size") * most)
    order = Window.orderBy((F.col("room") / F.col("w")).asc(), "w", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * percent / 100 - F.coalesce(F.sum("room").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    tried = full.withColumn("level", level).withColumn("fills", F.col("level") * F.col("w") >= F.col("room"))
    found = tried.withColumn("level", F.min(F.when(~F.col("fills"), F.struct((F.col("room") / F.col("w")).alias("at"), F.col("w").alias("w1"), "level"))).over(everything)["level"])
    return found.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("level") * F.col("w") >= F.col("room")), F.col("room").cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2, key: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = (), bucket_rows: int = 4096) -> DataFrame:
    """One row per document: (key, size, source, source_size, target, taken, *keep).

    A source's budget is its target, rounded half up. Its documents stand in the order of a hash of their key; each whole
    epoch takes every document, the last takes them in order until the budget is used, the last document in part. Where that
    is, is found on ids and sizes alone: sums by ranges of the hash of about bucket_rows rows, prefix sums over ranges, and
    running sums inside the one range of a source in which its budget ends. That place, one row a source, then meets the
    documents, which do not move: those before it are taken once more, those after it are not."""
    scratch = Scratch(docs.sparkSession)
    rank = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(text), F.lit("null"))))
    sized = scratch.cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), rank.alias("rank"), *[F.col(c).alias(f"keep_{c}") for c in keep]))
    targets = scratch.cut(source_targets(sized, weights, percent, most))
    bits = max(0, (sized.count() // bucket_rows).bit_length())
    at = F.conv(F.substring("rank", 1, 8), 16, 10).cast("long")
    ranged = sized.select("key", "source", "size", "rank", F.shiftright(at, 32 - bits).alias("range"))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    asked = targets.select(F.col("source").alias("s"), "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("in_range").over(before), F.lit(0))).join(asked, F.col("source").eqNullSafe(F.col("s")))
    ends = starts.where("start <= rest and rest < start + in_range").select("s", F.col("range").alias("r"), "start", "rest")
    alike = ranged.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).groupBy("s", "start", "rest", "rank", "key", "size").agg(F.count("*").alias("copies"))
    inside = Window.partitionBy("s").orderBy("rank", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("rank", "key", "size")
    left = F.col("rest") - F.col("start") - F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))
    last = alike.withColumn("left", left).where("left >= 0 and left < size * copies").select(F.col("s").alias("s1"), place.alias("last"), "left", "copies")
    cuts = scratch.cut(asked.join(last, F.col("s").eqNullSafe(F.col("s1")), "left").drop("s1", "rest"))
    both = sized.join(cuts, F.col("source").eqNullSafe(F.col("s"))).withColumn("place", F.struct("rank", "key", "size"))
    part = F.when(F.col("place") < F.col("last"), F.col("size")).when(F.col("place") == F.col("last"), F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))).otherwise(F.lit(0))

    def laid(rows: DataFrame) -> DataFrame:
        taken = F.col("epochs") * F.col("size") + part
        return rows.select(F.col("key").alias(key), "size", F.col("source").alias(source), "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"keep_{c}").alias(c) for c in keep])

    if cuts.where("copies > 1").isEmpty():
        return laid(both.withColumn("before", F.lit(0)))
    repeated = F.coalesce(F.col("place").eqNullSafe(F.col("last")) & (F.col("copies") > 1), F.lit(False))  # equal rows at the end of a budget take turns
    turn = F.row_number().over(Window.partitionBy("source", "place").orderBy("rank")) - 1
    return laid(both.where(~repeated).withColumn("before", F.lit(0))).unionByName(laid(both.where(repeated).withColumn("before", turn * F.col("size"))))


def op6_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(table: str = "documents") -> str:
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS rnk FROM {table}),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 2 * source_size AS room,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM by_source),
tried AS (
  SELECT *, ((SELECT sum(source_size) FROM by_source) * 150 / 100.0
     - coalesce(sum(room) OVER (ORDER BY CAST(room AS DOUBLE) / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
     / ((SELECT sum(w) FROM weighted) - coalesce(sum(w) OVER (ORDER BY CAST(room AS DOUBLE) / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lvl
  FROM weighted),
level AS (SELECT min_by(lvl, (CAST(room AS DOUBLE) / w, w)) AS lvl FROM tried WHERE lvl * w < room),
targets AS (
  SELECT source, source_size, CASE WHEN l.lvl IS NULL OR l.lvl * w >= room THEN CAST(room AS DOUBLE) ELSE l.lvl * w END AS target
  FROM weighted, level l),
laid AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.rnk, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(budget / source_size) ELSE 0 END AS e FROM laid)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(e * size + greatest(0, least(size, budget - e * source_size - before)) AS BIGINT) AS taken FROM epochs
"""


OP6_SQL = mix_sql()

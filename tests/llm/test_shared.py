"""Postings of shingles that several sets share, whatever the batches they come in."""

from collections import Counter

import numpy as np
import pytest

from terncube.llm import jaccard


@pytest.mark.parametrize("batch", [1, 2, 3, 7, 10_000])
def test_shingles_of_two_sets_are_told_from_those_of_more(spark, batch):
    rng = np.random.default_rng(4)
    rows = sorted({(int(s), int(i)) for s, i in zip(rng.integers(0, 90, 200), rng.integers(0, 60, 200), strict=True)} | {(99, i) for i in range(40)})
    df = spark.createDataFrame([(s, i, 20, (s * 7 + i) % 11) for s, i in rows], "shingle long, sid long, n int, pos int")
    times = Counter(s for s, _ in rows)
    first = {s: min(((s * 7 + i) % 11, i) for t, i in rows if t == s)[1] for s in times}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = jaccard._shared(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted((r["shingle"], r["sid"]) for r in got) == [x for x in rows if times[x[0]] > 1]
    assert {2, 3} <= set(times.values())
    assert all(r["many"] == (times[r["shingle"]] > 2) and r["lead"] == first[r["shingle"]] for r in got)

"""The stages of corpus_pipeline.py against brute force, with odd rows, and the queries' names and types."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from terncube.llm import langid, packing, queries
from tests.llm.test_llm import brute_lines, sentence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of():
    rng = random.Random(21)
    long = sentence(200, 31).split()
    rows = [(i, " ".join("zz" if rng.random() < 0.01 else w for w in long), "en", "a", 0) for i in range(6)]
    rows += [(10 + i, sentence(80, 50 + i), "en", "b" if i % 3 else None, 0) for i in range(12)]
    rows += [(10, sentence(90, 91), None, "a", 0), (None, " ".join(long), "en", "a", 0), (None, sentence(70, 92), "en", "a", 0), (None, sentence(70, 92), "en", "a", 0)]
    return [*rows, (40, None, "en", "a", 0), (41, "", "en", "a", 0), (42, "12 34", "en", "a", 0), (43, "one", "en", "b", 0), (10, sentence(90, 91), None, "a", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).withColumn("component", F.lit(1)).withColumn("digest", F.lit("x"))


def found(df):
    assert df.columns == P.COLUMNS
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_identify(spark, docs):
    got = P.identify(spark, docs, "")
    assert found(got) == sorted(((r[0], r[1]) for r in rows_of() if r[1] and any(c.isalpha() for c in r[1])), key=repr)
    model = langid.fit(docs.where(langid.fold() != 2))
    assert {r["lang"] for r in got.collect()} <= set(model.languages)


def test_dedup(spark, docs):
    rows = [r for r in rows_of() if r[0] is not None]
    seen, want, left = set(), brute_lines([r[:2] for r in rows if r[1] is not None]), []
    for r in rows:
        if r[1] is None:
            continue
        text = want(r[0], r[1]) if (r[0], r[1]) not in seen else ""
        seen.add((r[0], r[1]))
        if text.strip():
            left.append((r[0], text))
    assert found(P.dedup(spark, docs.where("doc_id is not null"), "")) == sorted(left, key=repr)


def test_near_duplicates(spark, docs):
    rows, sets = rows_of(), []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for i, r in enumerate(rows):
        place = (r[0] is None, r[0] or 0)
        if sets[i]:
            best[group[i]] = min(best.get(group[i], (place, i)), (place, i))
    kept = [rows[i][:2] for _, i in best.values()] + list({rows[i][:2] for i, s in enumerate(sets) if not s})
    assert found(P.near_duplicates(spark, docs, "")) == sorted(kept, key=repr)


def test_mix_and_pack(spark, docs):
    mixed = P.mix_sources(spark, docs.where("text is not null"), "")
    words, whole = defaultdict(int), Counter()
    for r in rows_of():
        if r[1] is not None:
            whole[r[3]] += len(r[1].split())
    for r in mixed.collect():
        words[r["source"]] += len((r["text"] or "").split())
        assert any((r["text"] or "") == (x[1] or "")[: len(r["text"] or "")] for x in rows_of())
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(whole, key=lambda s: (s is None, s or "")))}
    total, capped = 1.5 * sum(whole.values()), set()
    while True:
        rest = total - sum(2 * whole[s] for s in capped)
        target = {s: 2 * whole[s] if s in capped else rest * weights[s] / sum(w for t, w in weights.items() if t not in capped) for s in whole}
        over = {s for s in whole if s not in capped and target[s] > 2 * whole[s]}
        if not over:
            break
        capped |= over
    for s in whole:
        assert abs(words[s] - target[s]) <= 1
    packed = P.pack(spark, mixed, "").collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.token_file())
    assert sum(r["length"] for r in packed) == sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, none, "").count() == 0


def test_queries_against_sql(spark, sf, duck):
    for name, sql in queries.SQL.items():
        df, table = queries.QUERIES[name](spark, sf), duck.execute(sql)
        columns = sorted(c[0] for c in table.description)
        assert sorted(df.columns) == columns
        mine = Counter(tuple(str(r[c]) for c in columns) for r in df.collect())
        names = [c[0] for c in table.description]
        theirs = Counter(tuple(str(r[names.index(c)]) for c in columns) for r in table.fetchall())
        assert mine == theirs, name


TYPES = {
    "op2_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op5_pack": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op8_line_dedup": {"doc_id": "bigint"},
    "op9_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op10_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", sorted(TYPES))
def test_query_types(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in TYPES[name]} == TYPES[name]
    assert df.count() > 0

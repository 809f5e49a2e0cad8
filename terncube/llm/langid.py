"""Language identification by cross-parsing: how few phrases of a language's labelled text a document falls into.

A suffix automaton of each language's text gives the longest match from any position; a document is parsed greedily into
such matches and the language with the fewest phrases a character wins. Texts are cut into windows of WINDOW characters
that are parsed side by side in numpy, so a text of any length costs the same a character and a cut adds one phrase to
every language alike.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing was learned;
ties go to the smaller language name; equal texts get equal results; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 256
MISS = np.int32(1 << 30)
STATE = np.int32((1 << 30) - 1)
#: Codes of bytes: those that a language's texts do not have, then those that they have, then what follows a text's end.
OTHER, FIRST = 0, 1


@dataclass
class Model:
    """languages in order, and for each: codes, the code of every byte; tables, for state * width + code the next state *
    width, with MISS set if a new phrase begins there."""

    languages: list[str]
    codes: list[np.ndarray]
    tables: list[np.ndarray]


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is its start."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        here = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = here
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    return step


def _table(step: list[dict[int, int]], width: int) -> np.ndarray:
    to = np.zeros((len(step), width), np.int32)
    for s, moves in enumerate(step):
        for c, t in moves.items():
            to[s, c] = t * width
    start = to[0].copy()
    out = np.where(to > 0, to, start[None, :] | MISS).astype(np.int32)
    out[:, width - 1] = np.arange(len(step), dtype=np.int32) * width  # the code behind a text's end stays where it is
    return out.reshape(-1)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def encode(text: str) -> np.ndarray:
    """The text in lower case as UTF-8 bytes, everything but letters a blank: any script, with at most 256 symbols."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.frombuffer(np.where(_letters()[points], points, 32).astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = 200, chars: int = 30_000) -> Model:
    """Learn from labelled rows (text and lang not null). For each language at most rows rows in the order of their keys'
    hashes, whole texts, as long as they have chars characters together; a language whose texts are all longer learns from
    the first chars characters of one. Only counts by language and that sample reach the driver: rows and chars bound what
    a language takes there and in every worker."""
    pool = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null and key is not null")
    counts = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], [], [])
    at = (F.xxhash64(F.col("key").cast("string"), F.lit("sample")).cast("double") / float(1 << 63) + 1) / 2
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, 3.0 * rows / n)]), F.col("lang"))
    near = pool.withColumn("at", at).where(F.col("at") < share).select("lang", "at", "key", F.length("text").alias("n"), F.left("text", F.lit(chars)).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.col("n") > chars, "at", "key", "text")
    ranked = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows)
    total = F.sum("n").over(Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    picked = ranked.withColumn("total", total).where(f"k = 1 or total <= {chars}").select("lang", "k", "text").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["k"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    model = Model(sorted(texts), [], [])
    for name in model.languages:
        learned = encode(" ".join(texts[name]))
        seen = np.unique(learned)
        codes = np.full(256, OTHER, np.uint8)
        codes[seen] = FIRST + np.arange(len(seen))
        model.codes.append(codes)
        model.tables.append(_table(automaton(codes[learned].tolist()), FIRST + len(seen) + 1))
    return model


def phrases(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Phrases of each encoded text (rows) by language (columns)."""
    n = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    if not n.sum():
        return out
    flat, past = np.zeros(int(n.sum()) * WINDOW, np.uint8), np.ones(int(n.sum()) * WINDOW, bool)
    for t, at in zip(texts, np.concatenate([[0], np.cumsum(n)[:-1]]) * WINDOW, strict=True):
        flat[at : at + len(t)] = t
        past[at : at + len(t)] = False
    lanes, past = flat.reshape(-1, WINDOW), past.reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), n)
    for lo in range(0, len(lanes), 1 << 14):
        columns, ended = (np.ascontiguousarray(x[lo : lo + (1 << 14)].T) for x in (lanes, past))
        for k, (codes, table) in enumerate(zip(model.codes, model.tables, strict=True)):
            coded = codes[columns]
            coded[ended] = int(codes.max()) + 1
            state, count = np.zeros(columns.shape[1], np.int32), np.ones(columns.shape[1], np.int32)
            for c in coded:
                state += c
                state = table.take(state)
                count += state >> 30
                state &= STATE
            out[:, k] += np.bincount(owner[lo : lo + (1 << 14)], count, len(texts)).astype(np.int64)
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", rate: str | None = None) -> DataFrame:
    """docs with lang and score added (and the phrases a byte, if rate names a column). The score is the share
    r2 / (r1 + r2) of the best and the second best language's phrases a byte; 1 where one language was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    added = [(lang, pa.string(), "string"), (score, pa.float64(), "double"), *([(rate, pa.float64(), "double")] if rate else [])]
    at = docs.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            lo = 0
            while lo < whole.num_rows:
                codes, size, hi = [], 0, lo
                while hi < whole.num_rows and size < 1 << 22:
                    t = whole.column(at)[hi].as_py()
                    codes.append(encode(t or ""))
                    size, hi = size + len(codes[-1]), hi + 1
                found = phrases(codes, model) / np.maximum([len(c) for c in codes], 1)[:, None]
                known = np.array([bool((c != 32).any()) for c in codes]) & bool(model.languages)
                names, marks, rates = [], [], []
                for ok, row in zip(known, found, strict=True):
                    best = np.argsort(row, kind="stable")[:2] if ok else []
                    names.append(model.languages[best[0]] if ok else "und")
                    marks.append(0.0 if not ok else 1.0 if len(best) == 1 else float(row[best[1]] / (row[best[0]] + row[best[1]])))
                    rates.append(float(row[best[0]]) if ok else None)
                part = whole.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(v, t) for v, (_, t, _) in zip((names, marks, rates), added, strict=False)]], names=[*part.schema.names, *[a for a, _, _ in added]])
                lo = hi

    plain = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    schema = ", ".join([*[f"c{i} {kinds[c]}" for i, c in enumerate(docs.columns)], *[f"{a} {t}" for a, _, t in added]])
    out = plain.mapInArrow(judge, schema)
    return out.toDF(*docs.columns, *[a for a, _, _ in added])


def fold(key: str = "doc_id"):
    """crc32 of the key as text, modulo 4."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(fold() != 2))
    rows = docs.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")

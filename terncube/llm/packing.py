"""Packing documents into token sequences by cutting-stock column generation.

A document of n tokens gives floor(n / size) full pieces and one remainder; the remainders are packed whole. Their length
histogram, at most size - 1 numbers whatever the input, is all that the driver sees: a linear program over patterns
(multisets of lengths that share a sequence) is solved by column generation, a knapsack over the lengths pricing the next
pattern; the rounded patterns are given to the pieces by their rank among the pieces of their length.

Defined results: a null or empty text is the closing id alone; an empty table gives an empty result; repeated rows are
packed each on their own; columns other than those named are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terncube.llm.runtime import Scratch

#: White space by Unicode's White_Space property, as the tokenizer's own pattern sees it.
_WS = "".join(["\\t-\\r \\x85\\xa0", "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"])
#: Parts of a text that byte-level BPE encodes independently: a run of letters and digits or of other signs, with a blank
#: before it, an English contraction, or white space.
PART = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[^\W_]+| ?(?:[^\w{_WS}]|_)+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
CACHE = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of texts as little-endian 32-bit bytes. The tokenizer's result for a part is kept, so that frequent words cost
    one lookup; once CACHE parts are kept, others live as long as their batch, in the same table, so that every lookup costs
    the same."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = list(accumulate(map(len, ids), initial=0))
        return [flat[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [None if any(a in t for a in self.added) else PART.findall(t) for t in texts]  # added tokens cut across parts
        every = list(filter(None, parts))
        new = list(set(chain.from_iterable(every)).difference(self.kept))
        room = max(0, CACHE - len(self.kept))
        for lo in range(0, len(new), 20_000):
            self.kept.update(zip(new[lo : lo + 20_000], self._ids(new[lo : lo + 20_000]), strict=True))
        out = [self._ids([t])[0] if ps is None else b"".join(map(self.kept.__getitem__, ps)) for t, ps in zip(texts, parts, strict=True)]
        for part in islice(new, room, None):
            del self.kept[part]
        return out


@lru_cache(1)
def worker_encoder(path: str) -> Encoder:
    """The encoder that a worker's tasks share, so that only its first task loads the tokenizer and meets all parts anew."""
    return Encoder(path)


def cut_pieces(docs: DataFrame, path: str, size: int = 1024, key: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """PIECES: full pieces from the start of every document and the remainder; each piece's ids only as their CRC-32."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    close = int(end).to_bytes(4, "little")
    names = [x.split()[0] for x in PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_encoder(path)
        for whole in batches:
            keys, texts = whole.column(0), whole.column(1)
            lo = 0
            while lo < whole.num_rows:
                some, held, hi = [], 0, lo
                while hi < whole.num_rows and held < 1 << 21:
                    some.append(texts[hi].as_py())
                    held, hi = held + len(some[-1]), hi + 1
                out: list[tuple] = []
                for key, ids in zip(keys.slice(lo, hi - lo).to_pylist(), encoder(some), strict=True):
                    ids += close
                    n = len(ids) // 4
                    out += [(key, s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                lo = hi

    return rows.mapInArrow(cut, PIECES)


def padded_length(total: int, size: int) -> int:
    """A sequence is padded to size unless its length is a power of two."""
    return total if total & (total - 1) == 0 else size


def _best_patterns(lengths: np.ndarray, value: np.ndarray, cost: np.ndarray, size: int, most: int = 64) -> np.ndarray:
    """Knapsack by dynamic programming over totals: of the best pattern of every total and the best full pattern with each
    length, up to most that are worth more than they cost, largest gain first."""
    best, last = np.full(size + 1, -np.inf), np.full(size + 1, -1, np.int64)
    best[0] = 0.0
    upto = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for t in range(1, size + 1):
        m = upto[t]
        if m:
            tried = best[t - lengths[:m]] + value[:m]
            k = int(tried.argmax())
            best[t], last[t] = tried[k], k
    gain = np.concatenate([best[1:] - cost[1:], value + best[size - lengths] - cost[size]])
    worth = [i for i in np.argsort(-gain, kind="stable")[:most].tolist() if gain[i] > 1e-6]
    found = np.zeros((len(worth), len(lengths)), np.int16)
    for row, i in zip(found, worth, strict=True):
        t = i + 1
        if i >= size:
            row[i - size] += 1
            t = size - int(lengths[i - size])
        while t > 0:
            row[last[t]] += 1
            t -= int(lengths[last[t]])
    return np.unique(found, axis=0)


def _fill(lengths: np.ndarray, copies: np.ndarray, size: int) -> np.ndarray:
    """The longest available length and, of the others, the longest possible sum beside it (subset sums as bit sets, equal
    lengths in chunks of 1, 2, 4, ...)."""
    top = int(np.flatnonzero(copies)[-1])
    pattern = np.zeros(len(lengths), np.int64)
    pattern[top], room = 1, size - int(lengths[top])
    items = []
    for k in np.flatnonzero(copies[: top + 1]).tolist():
        left, chunk = min(int(copies[k]) - (k == top), room // int(lengths[k])), 1
        while left > 0:
            items.append((k, min(chunk, left)))
            left, chunk = left - chunk, 2 * chunk
    reach, mask = [1], (1 << (room + 1)) - 1
    for k, n in items:
        reach.append((reach[-1] | reach[-1] << n * int(lengths[k])) & mask)
    total = reach[-1].bit_length() - 1
    for (k, n), before in zip(reversed(items), reversed(reach[:-1]), strict=True):
        long = n * int(lengths[k])
        if not before >> total & 1:
            pattern[k] += n
            total -= long
    return pattern


def _filled(lengths: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Patterns filled from the longest length on, each used until one of its lengths is used up, and the index of that
    length, which is in no later pattern."""
    rest, out = demand.astype(float), []
    while (rest > 1e-9).any():
        pattern = _fill(lengths, np.where(rest > 1e-9, np.maximum(rest, 1), 0).astype(np.int64), size)
        on = np.flatnonzero(pattern)
        ratio = rest[on] / pattern[on]
        rest = np.maximum(rest - ratio.min() * pattern, 0)
        rest[on[int(ratio.argmin())]] = 0
        out.append((pattern, int(on[int(ratio.argmin())])))
    return out


@dataclass
class Solution:
    """Patterns, their fractional uses, the columns that pricing made, and the gap that the bound proves."""

    columns: np.ndarray
    uses: np.ndarray
    generated: int
    gap: float


def solve(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = 1e-4, rounds: int = 4000, pool: int = 3000, inner: float = 0.9) -> Solution:
    """The linear program by column generation and the revised simplex method.

    The first basis is as many copies of each length as fit a sequence; patterns of a greedy filling take their places, one
    after the other. Then the best priced pattern of a pool enters, and where none there gains any more the knapsack makes
    new ones, at least once, so that it is the prices that say how good the result is. It prices between the present duals
    and the best feasible ones known, at first the lengths themselves, as no pattern holds more tokens than it costs: a
    pattern that gains there gains at the present duals too, and if none does those are feasible and bound the optimum.
    Stops once the bound is within gap, or after rounds columns: any basis is feasible.

    The products are einsum's, not those of the linear algebra library: its threads can hang in a process that has forked."""
    m = len(lengths)
    cost = np.array([np.inf, *[padded_length(t, size) for t in range(1, size + 1)]], float)
    d = demand.astype(float)
    copies = size // lengths
    columns, price = np.diag(copies).astype(np.int16), cost[copies * lengths]
    inverse = np.diag(1.0 / copies)

    def enter(r: int, w: np.ndarray, column: np.ndarray) -> None:
        row, some = inverse[r] / w[r], np.flatnonzero(w)
        inverse[some] -= w[some, None] * row
        inverse[r], columns[r], price[r] = row, column, cost[int((column * lengths).sum())]

    for pattern, ended in _filled(lengths, demand, size):
        enter(ended, pattern / copies, pattern)  # it has none of the lengths that ended before: their places have no part in it
    x = np.maximum(np.einsum("ij,j->i", inverse, d), 0)
    known, known_cost = np.zeros((0, m)), np.zeros(0)
    feasible, generated, priced = lengths.astype(float), 0, False
    for _ in range(rounds):
        if priced and float((price * x).sum()) <= (1 + gap) * float((feasible * d).sum()):
            break
        dual = np.einsum("i,ij->j", price, inverse)
        gains = np.einsum("ij,j->i", known, dual) - known_cost
        while not len(gains) or gains.max() <= 1e-6:
            priced, between = True, inner * feasible + (1 - inner) * dual
            found = _best_patterns(lengths, between, cost, size)
            if len(found):
                generated += len(found)
                known = np.concatenate([found, known[: pool - len(found)]])
                known_cost = cost[np.einsum("ij,j->i", known, lengths).astype(np.int64)]
                gains = np.einsum("ij,j->i", known, dual) - known_cost
            elif float((price * x).sum()) <= (1 + gap) * float((between * d).sum()) or np.abs(between - dual).max() <= 1e-7 * size:
                return Solution(columns.astype(np.int64), x, generated, float((price * x).sum() / (between * d).sum()) - 1)
            else:
                feasible = between
        enters = int(gains.argmax())
        column = known[enters]
        w = np.einsum("ij,j->i", inverse, column)
        up = w > 1e-9
        if not up.any():
            break
        steps = np.where(up, x / np.where(up, w, 1), np.inf)
        r = int(steps.argmin())
        x = np.maximum(x - steps[r] * w, 0)
        x[r] = steps[r]
        enter(r, w, column)
    return Solution(columns.astype(np.int64), x, generated, float((price * x).sum() / (feasible * d).sum()) - 1)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: pieces}, uses) that use up the histogram exactly: the program's, rounded down, then patterns
    filled from the longest remaining length on."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return []
    rest = np.array([histogram[int(k)] for k in lengths], np.int64)
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: np.ndarray, most: int) -> None:
        on = pattern > 0
        n = min(most, int((rest[on] // pattern[on]).min()))
        if n > 0:
            rest[on] -= n * pattern[on]
            out.append(({int(a): int(b) for a, b in zip(lengths[on], pattern[on], strict=True)}, n))

    found = solve(lengths, rest.copy(), size)
    for k in np.argsort(-found.uses, kind="stable"):
        use(found.columns[k], int(found.uses[k] + 1e-6))
    while rest.any():
        use(_fill(lengths, rest, size), int(rest.max()))
    return out


def pack(pieces: DataFrame, scratch: Scratch, size: int = 1024, bucket_rows: int = 50_000) -> DataFrame:
    """pieces, which must be a written table, with sequence_id and offset. Ranks within a length come from counts by
    hashed bucket, prefix sums over buckets and a row number inside each bucket, so a frequent length has many tasks."""
    n = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = {r["length"]: r["n"] for r in n}
    slots, base = [], 0
    used: dict[int, int] = {}
    for pattern, uses in patterns({k: v for k, v in counts.items() if k < size}, size):
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            lo = used.get(length, 0)
            used[length] = lo + copies * uses
            slots.append((length, lo, used[length], copies, base, offset))
            offset += copies * length
        base += uses
    if counts.get(size):
        slots.append((size, 0, counts[size], 1, base, 0))
    laid = pieces.sparkSession.createDataFrame(slots, "slot_length long, lo long, hi long, copies long, base long, at long")
    buckets = max(1, sum(counts.values()) // bucket_rows)
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = spread.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("length").alias("l"), F.col("bucket").alias("b"), "first")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = spread.withColumn("k", F.row_number().over(inside) - 1).join(firsts, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("k") + F.col("first"))
    put = ranked.join(laid, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return put.select(*pieces.columns, (F.col("base") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("copies") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, size: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of every document."""
    scratch = Scratch(docs.sparkSession)
    return pack(scratch.cut(cut_pieces(docs, path or token_file(), size, key, text)), scratch, size)


def op5_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

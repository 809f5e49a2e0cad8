"""Ridges on resampled rows, by passes over the rows where they lie. A draw of n rows with replacement is a multinomial: over
blocks of rows first, which the driver draws, then inside each block, which every pass draws anew from the same seed.

Equal rows are one kind with a number. The models of all draws, folds and penalties start from those of all rows, which one
product of weights and rows brings to their next step: to the quadratic about the start. Where a start is far from a
step's end (FAR), the draw's models are brought to their end by passes instead."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terncube.operators import spread as S
from terncube.operators.storage import shared_folder

#: Kinds of a block, tasks that blocks are dealt over at least, draws that a product takes at once.
KINDS, TASKS, DRAWS = 4096, 96, 40
#: The largest step in spreads of a predictor for which the quadratic stands.
FAR = 0.05
FOLDS = 5


def _blocks(training: DataFrame, predictors: Sequence[str], response: str) -> DataFrame:
    """(block, data): a row a block, its kinds as numbers (predictors, response, year, rows); a null is not a number."""
    columns = [*predictors, response, "year"]
    plain = training.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns])
    kinds = plain.groupBy(*columns).agg(F.count("*").cast("double").alias("n"))
    path = shared_folder(training.sparkSession, "kinds")
    kinds.write.parquet(f"{path}/rows")
    kinds = training.sparkSession.read.parquet(f"{path}/rows")
    blocks = max(1, -(-kinds.count() // KINDS))
    placed = kinds.withColumn("block", F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int"))

    def packed(table: pa.Table) -> pa.Table:
        numbers = np.column_stack([table.column(c).to_numpy() for c in [*columns, "n"]])
        numbers = numbers[np.lexsort(numbers.T)]  # one order, whatever the rows' way here
        return pa.table({"block": table.column("block").slice(0, 1), "data": pa.array([numbers.tobytes()], pa.binary())})

    placed.repartition(max(TASKS, blocks // 16), "block").groupBy("block").applyInArrow(packed, "block int, data binary").write.parquet(f"{path}/blocks")
    return training.sparkSession.read.parquet(f"{path}/blocks")


def _each(blocks: DataFrame, width: int, work: Callable, schema: str) -> DataFrame:
    """What work makes of a task's blocks (number, kinds), given as an iterator."""

    def run(batches):
        def parts():
            for b in batches:
                for block, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                    yield block, np.frombuffer(data.as_buffer()).reshape(-1, width)

        yield from work(parts())

    return blocks.mapInArrow(run, schema)


def _added(found: DataFrame) -> dict:
    """Sums of the rows (key, s) by key."""

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"key": table.column("key").slice(0, 1), "s": pa.array([_total(table).tobytes()], pa.binary())})

    return {r["key"]: np.frombuffer(r["s"]) for r in found.groupBy("key").applyInArrow(add, "key int, s binary").collect()}


def _total(table: pa.Table) -> np.ndarray:
    total = 0.0
    for s in table.column("s"):
        total = total + np.frombuffer(s.as_buffer())
    return total


def _rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": pa.array(list(sums), pa.int32()), "s": pa.array([s.tobytes() for s in sums.values()], pa.binary())})


class Resampled:
    """Draws of the rows of blocks; d predictors."""

    def __init__(self, blocks: DataFrame, d: int, draws: int, seed: int, path: np.ndarray = S.PATH):
        self.blocks, self.d, self.draws, self.seed, self.path = blocks, d, draws, seed, path
        self.pairs = np.triu_indices(d + 1)

        def facts(parts):
            out = {}
            for block, kinds in parts:
                x, y, n = train(kinds, d)
                if not len(y):
                    continue
                out[block] = np.array([n.sum(), n @ y, *(n @ x), *(n @ x**2)])
            yield _rows(out)

        found = _added(_each(blocks, d + 3, facts, "key int, s binary"))
        names = sorted(found)
        all_ = np.sum([found[b] for b in names], axis=0) if names else np.zeros(2 + 2 * d)
        self.n, self.y = int(all_[0]), int(all_[1])
        self.fine = 0 < self.y < self.n
        if not self.fine:
            return
        self.mean = all_[2 : 2 + d] / self.n
        self.sd = np.sqrt(np.maximum(all_[2 + d :] / self.n - self.mean**2, 0))
        self.sd = np.where(self.sd > 1e-9 * np.abs(self.mean), self.sd, 1)
        part = np.array([found[b][0] for b in names]) / self.n
        self.sizes = np.array([len(range(k, self.n, FOLDS)) for k in range(FOLDS)])
        drawn = np.array([np.random.default_rng([seed, r, 0]).multinomial(self.sizes, part) for r in range(draws)], np.int32)
        self.drawn = blocks.sparkSession.sparkContext.broadcast((drawn, {b: i for i, b in enumerate(names)}))

    def sums(self, work: Callable) -> dict[int, np.ndarray]:
        """Sums by key of what work(z, y, n, weights) makes of the blocks' training rows: a dict of arrays; weights(r) are
        the numbers (folds, kinds) of draw r."""
        d, seed, scaled, known = self.d, self.seed, self.scaled_by(), self.drawn

        def run(parts):
            out: dict[int, np.ndarray] = {}
            drawn, names = known.value
            for block, kinds in parts:
                x, y, n = train(kinds, d)
                if len(y):
                    for key, s in work(scaled(x), y, n, lambda r, block=block, n=n: weights(drawn[r, :, names[block]], n, [seed, r, 1, block])).items():
                        out[key] = out[key] + s if key in out else s
            yield _rows(out)

        return _added(_each(self.blocks, d + 3, run, "key int, s binary"))

    def scaled_by(self) -> Callable:
        mean, sd = self.mean, self.sd
        return lambda x: np.column_stack([np.ones(len(x)), (x - mean) / sd])

    def whole_path(self) -> np.ndarray:
        """Coefficients of all rows at every penalty, in scaled predictors."""
        d, path, (i, j) = self.d + 1, self.path, self.pairs
        b, pen = np.zeros((len(path), d)), np.array([[0.0, *[v * self.n] * self.d] for v in path])
        for _ in range(50):
            at = b.copy()

            def work(z, y, n, _, at=at):
                p = S._probability(z, at)
                grad = (n[:, None] * (y[:, None] - p)).T @ z
                return {0: np.concatenate([grad, (n[:, None] * np.maximum(p * (1 - p), 1e-9)).T @ (z[:, i] * z[:, j])], 1).reshape(-1)}

            s = self.sums(work)[0].reshape(len(path), -1)
            for k in range(len(path)):
                b[k] = S._step(b[k], s[k, :d], self.square(s[k, d:]), pen[k], True, np.ones(d, bool))
            if np.abs(b - at).max() < 1e-9:
                break
        return b

    def square(self, s: np.ndarray) -> np.ndarray:
        (i, j), h = self.pairs, np.zeros((self.d + 1, self.d + 1))
        h[i, j] = h[j, i] = s
        return h

    def started(self, b: np.ndarray) -> dict[int, np.ndarray]:
        """For each draw, by folds: for each of the coefficients b gradient, Hessian and deviance; presences, sums and sums of
        squares of the scaled predictors."""
        draws, (i, j), d = self.draws, self.pairs, self.d + 1

        def work(z, y, n, weights):
            p = S._probability(z, b)
            zz = z[:, i] * z[:, j]
            loss = -2 * np.log(np.clip(np.where(y[:, None] > 0.5, p, 1 - p), 1e-9, 1))
            grad, h = (y[:, None] - p)[:, :, None] * z[:, None, :], np.maximum(p * (1 - p), 1e-9)[:, :, None] * zz[:, None, :]
            parts = np.concatenate([np.concatenate([grad, h, loss[:, :, None]], 2).reshape(len(y), -1), y[:, None], z[:, 1:], z[:, 1:] ** 2], 1)
            out = {}
            for lo in range(0, draws, DRAWS):
                some = range(lo, min(lo + DRAWS, draws))
                got = np.concatenate([weights(r) for r in some]) @ parts
                out |= {r: got[at * FOLDS : (at + 1) * FOLDS].reshape(-1) for at, r in enumerate(some)}
            return out

        width = len(b) * (d + len(i) + 1) + 1 + 2 * (d - 1)
        return {r: s.reshape(FOLDS, width) for r, s in self.sums(work).items()}

    def exact(self, r: np.ndarray, out: np.ndarray, b: np.ndarray, pen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of models, each on draw r without fold out (none: -1), and deviances of those folds, by passes."""
        (i, j), d, left = self.pairs, self.d + 1, np.arange(len(r))
        b, deviance = b.copy(), np.zeros(len(r))
        for _ in range(50):
            if not len(left):
                break
            own, fold, at = r[left], out[left], b[left].copy()

            def work(z, y, n, weights, own=own, fold=fold, at=at):
                zz, found = z[:, i] * z[:, j], {}
                for draw in np.unique(own):
                    m = np.flatnonzero(own == draw)
                    w = weights(draw)
                    held = np.where((fold[m] >= 0)[:, None], w[fold[m]], 0)
                    p = S._probability(z, at[m]).T
                    rest = w.sum(0) - held
                    loss = -2 * np.log(np.clip(np.where(y > 0.5, p, 1 - p), 1e-9, 1))
                    found[int(draw)] = np.concatenate([(rest * (y - p)) @ z, (rest * np.maximum(p * (1 - p), 1e-9)) @ zz, (held * loss).sum(1)[:, None]], 1).reshape(-1)
                return found

            got, still = self.sums(work), []
            for draw in np.unique(own):
                s = got[int(draw)].reshape(-1, d + len(i) + 1)
                for row, k in zip(s, left[own == draw], strict=True):
                    deviance[k] = row[-1]
                    new = S._step(b[k], row[:d], self.square(row[d:-1]), pen[k], True, np.ones(d, bool))
                    if np.abs(new - b[k]).max() >= 1e-9:
                        still.append(k)
                    b[k] = new
            left = np.array(sorted(still), int)
        return b, deviance

    def quadratic(self, start: np.ndarray, s: np.ndarray, pen: np.ndarray) -> np.ndarray:
        """The coefficients at the end of the quadratic about the start, of which s are gradient and Hessian."""
        d = self.d + 1
        h, b = self.square(s[d:]), start
        for _ in range(50):
            new = S._step(b, s[:d] - h @ (b - start), h, pen, True, np.ones(d, bool))
            if np.abs(new - b).max() < 1e-10:
                return new
            b = new
        return b

    def ridges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(draws, coefficients in scaled predictors, penalties) of the draws of both classes: fitters.fit_ridge with FOLDS
        folds, the fold of a drawn row its own."""
        start, d, path = self.whole_path(), self.d + 1, self.path
        size = d + len(self.pairs[0]) + 1
        fine, first, scale, far, errors = [], [], [], [], []
        for r, s in sorted(self.started(start).items()):
            more = s[:, len(path) * size :].sum(0)
            if not 0 < more[0] < self.n:
                continue
            var = more[d:] / self.n - (more[1:d] / self.n) ** 2
            scale.append(np.where(var > 0, var, 1))
            s = s[:, : len(path) * size].reshape(FOLDS, len(path), size)
            loss, steps, ends = np.zeros((len(path), FOLDS)), 0.0, []
            for v, lam in enumerate(path):
                whole = s[:, v].sum(0)
                pen = np.array([0.0, *(lam * scale[-1])])
                ends.append(self.quadratic(start[v], whole[:-1], pen * self.n))
                for k in range(FOLDS):
                    step = self.quadratic(start[v], (whole - s[k, v])[:-1], pen * (self.n - self.sizes[k])) - start[v]
                    loss[v, k] = (s[k, v, -1] - 2 * s[k, v, :d] @ step + step @ self.square(s[k, v, d:-1]) @ step) / self.sizes[k]
                    steps = max(steps, np.abs(step).max())
            fine.append(r)
            first.append(ends)
            errors.append(loss)
            far.append(steps > FAR)
        again = np.flatnonzero(far)
        if len(again):
            models = [(fine[a], k, v, a) for a in again for v in range(len(path)) for k in range(FOLDS)]
            pen = np.array([[0.0, *(path[v] * scale[a] * (self.n - self.sizes[k]))] for _, k, v, a in models])
            _, deviance = self.exact(np.array([m[0] for m in models]), np.array([m[1] for m in models]), np.array([first[m[3]][m[2]] for m in models]), pen)
            for a, loss in zip(again, deviance.reshape(len(again), len(path), FOLDS), strict=True):
                errors[a] = loss / self.sizes
        chosen = []
        for loss in errors:
            mean, se = loss.mean(1), loss.std(1, ddof=1) / np.sqrt(FOLDS)
            chosen.append(int(np.flatnonzero(mean <= mean.min() + se[mean.argmin()])[0]))
        if not fine:
            return np.zeros(0, int), np.zeros((0, d)), np.zeros(0)
        pen = np.array([[0.0, *(path[v] * s * self.n)] for v, s in zip(chosen, scale, strict=True)])
        b, _ = self.exact(np.array(fine), np.full(len(fine), -1), np.array([e[v] for e, v in zip(first, chosen, strict=True)]), pen)
        return np.array(fine), b, path[chosen]

    def yearly(self, b: np.ndarray) -> list[tuple[int, float]]:
        """(year, mean probability) of the rows without a null predictor, for each row of b."""
        d, scaled = self.d, self.scaled_by()

        def work(parts):
            out: dict[int, np.ndarray] = {}
            for _, kinds in parts:
                kinds = kinds[~np.isnan(kinds[:, :d]).any(1) & ~np.isnan(kinds[:, d + 1])]
                for year in np.unique(kinds[:, d + 1]):
                    k = kinds[kinds[:, d + 1] == year]
                    s = np.append(k[:, d + 2] @ S._probability(scaled(k[:, :d]), b), k[:, d + 2].sum())
                    out[int(year)] = out[int(year)] + s if int(year) in out else s
            yield _rows(out)

        return [(year, float(p)) for year, s in _added(_each(self.blocks, d + 3, work, "key int, s binary")).items() for p in s[:-1] / s[-1]]


def train(kinds: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predictors, response and number of rows of the kinds without a null in either."""
    kinds = kinds[~np.isnan(kinds[:, : d + 1]).any(1)]
    return kinds[:, :d], kinds[:, d], kinds[:, d + 2]


def weights(drawn: np.ndarray, n: np.ndarray, seed: Sequence[int]) -> np.ndarray:
    """(folds, kinds): how often each kind is drawn into each fold, drawn rows a fold of the n of each kind."""
    rng, owner = np.random.default_rng(seed), np.repeat(np.arange(len(n)), n.astype(np.int64))
    return np.array([np.bincount(owner[rng.integers(0, len(owner), m)], minlength=len(n)) for m in drawn], float)


def yearly_means(training: DataFrame, predictors: Sequence[str], draws: int, seed: int, response: str) -> DataFrame:
    """(year, p) of every draw whose ridge could be fitted."""
    S.one_thread(training)
    found = Resampled(_blocks(training, predictors, response), len(predictors), draws, seed)
    rows = []
    if found.fine:
        b = found.ridges()[1]
        rows = found.yearly(b) if len(b) else []
    return training.sparkSession.createDataFrame(rows, "year int, p double")

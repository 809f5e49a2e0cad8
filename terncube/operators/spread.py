"""Logistic models of keys whose rows do not fit one task. Every Newton round is one pass over the rows where they lie, for
all models at once; only sums of gradients and Hessians travel, as many as there are keys and models, whatever the rows.

A row has a group __g (its key) and a code __c; a model weighs the rows of its group by a table over the codes, such as
0 for the fold that it leaves out and 1 for the others, or the number of times that a replicate drew a block.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more rows are fitted by passes, smaller ones in a task each.
LARGE = 200_000
#: Rows that a task takes at once, and cells of the largest array of a step (a processor's cache holds it).
ROWS, CELLS = 60_000, 100_000
FOLDS = 10
#: The largest step of a scaled coefficient for which a held-out fold's quadratic stands.
FAR = 0.02
PATH = np.exp(np.linspace(np.log(10), np.log(1e-4), 25))


@dataclass
class Models:
    """Models of one group: scaling, weights (codes, models), penalties and coefficients (models, columns)."""

    mean: np.ndarray
    sd: np.ndarray
    weight: np.ndarray
    penalty: np.ndarray
    b: np.ndarray
    judged: np.ndarray | None = None
    positive: bool = False
    mask: np.ndarray | None = None
    deviance: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def linear(self, m: int) -> np.ndarray:
        """Intercept and weights of model m on unscaled columns."""
        w = self.b[m][1:] / self.sd
        return np.array([self.b[m][0] - (w * self.mean).sum(), *w])


def whole(columns: Sequence[str]) -> Column:
    """Whether a row has a number in each column."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


def one_thread(df: DataFrame) -> None:
    """Workers run side by side, so none of them needs threads of its own for products."""
    own = df.sparkSession.sparkContext.environment
    for name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
        own.setdefault(name, "1")


def _sums(x: np.ndarray, y: np.ndarray, code: np.ndarray, m: Models) -> np.ndarray:
    """(models, columns + pairs of columns + 1): gradient, Hessian and deviance of the judged rows. Rows of one code have one
    weight in a model, so sums by code are weighed, not rows; a model meets only the codes that it weighs or is judged on."""
    z = np.column_stack([np.ones(len(x)), (x - m.mean) / m.sd])
    d = z.shape[1]
    i, j = np.triu_indices(d)
    total = np.zeros((len(m.b), d + len(i) + 1))
    for c, part in _parts(code, len(m.weight)):
        if len(c) == 1:  # one code: unweighted sums
            at = c[0]
            use = np.flatnonzero(m.weight[at])
            rest = np.zeros(0, int) if m.judged is None else np.flatnonzero(m.judged[at])
            for lo in range(0, len(part), step := max(64, CELLS // max(len(use), len(i)))):
                k = part[lo : lo + step]
                a, t = z[k], y[k]
                p = _probability(a, m.b[use])
                total[use, :d] += m.weight[at, use, None] * (t @ a - p.T @ a)
                p -= p * p
                total[use, d:-1] += m.weight[at, use, None] * (np.maximum(p, 1e-9, out=p).T @ (a[:, i] * a[:, j]))
                if len(rest):
                    p = _probability(a, m.b[rest])
                    total[rest, -1] -= 2 * m.judged[at, rest] * np.log(np.clip(np.where(t[:, None] > 0.5, p, 1 - p), 1e-9, 1)).sum(0)
            continue
        for lo in range(0, len(part), step := max(64, CELLS // max(len(m.b), len(i)))):
            k = part[lo : lo + step]
            a, t = z[k], y[k, None]
            p, w = _probability(a, m.b), m.weight[code[k]]
            total[:, :d] += (w * (t - p)).T @ a
            total[:, d:-1] += (w * np.maximum(p * (1 - p), 1e-9)).T @ (a[:, i] * a[:, j])
            if m.judged is not None:
                total[:, -1] -= 2 * (m.judged[code[k]] * np.log(np.clip(np.where(t > 0.5, p, 1 - p), 1e-9, 1))).sum(0)
    return total


def _probability(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p = a @ b.T
    np.clip(p, -35, 35, out=p)
    np.exp(np.negative(p, out=p), out=p)
    p += 1
    return np.reciprocal(p, out=p)


def _parts(code: np.ndarray, codes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, positions): by code where codes are few, else all rows at once."""
    if codes > 16:
        return [(np.arange(codes), np.arange(len(code)))]
    return [(np.array([c]), np.flatnonzero(code == c)) for c in np.unique(code)]


def _pass(rows: DataFrame, state: dict[int, Models], predictors: Sequence[str], response: str) -> dict[int, np.ndarray]:
    columns = [*predictors, response]

    def run(batches):
        found: dict[int, np.ndarray] = {}
        waiting, n = [], 0

        def flush():
            table = pa.Table.from_batches(waiting)
            g, c = (table.column(n).to_numpy() for n in ("__g", "__c"))
            x = np.column_stack([table.column(n).to_numpy().astype(float) for n in columns])
            for k in np.unique(g):
                if int(k) in state:
                    at = g == k
                    s = _sums(x[at, :-1], x[at, -1], c[at], state[int(k)])
                    found[int(k)] = found[int(k)] + s if int(k) in found else s

        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                flush()
                waiting, n = [], 0
        if n:
            flush()
        yield pa.RecordBatch.from_pydict({"g": pa.array(list(found), pa.int32()), "s": pa.array([s.tobytes() for s in found.values()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(b.as_py()) for b in table.column("s"))
        return pa.table({"g": table.column("g").slice(0, 1), "s": pa.array([s.tobytes()], pa.binary())})

    got = rows.select("__g", "__c", *columns).mapInArrow(run, "g int, s binary").groupBy("g").applyInArrow(add, "g int, s binary")
    return {r["g"]: np.frombuffer(r["s"]).reshape(len(state[r["g"]].b), -1) for r in got.collect()}


def _step(b: np.ndarray, grad: np.ndarray, h: np.ndarray, pen: np.ndarray, positive: bool, mask: np.ndarray) -> np.ndarray:
    floor = np.array([-np.inf, *[0.0 if positive else -np.inf] * (len(b) - 1)])
    grad = grad - pen * b
    free = mask & ~((b <= floor) & (grad < 0))
    step = np.zeros(len(b))
    step[free] = np.linalg.solve(h[np.ix_(free, free)] + np.diag(pen[free] + 1e-9), grad[free])
    return np.maximum(b + step, floor)


def newton(rows: DataFrame, state: dict[int, Models], predictors: Sequence[str], response: str, rounds: int = 50) -> None:
    """Coefficients and judged deviances of all models, in place; those that have converged leave the passes."""
    left = {g: np.arange(len(m.b)) for g, m in state.items()}
    for m in state.values():
        m.deviance = np.zeros(len(m.b))
    for _ in range(rounds):
        part = {g: Models(m.mean, m.sd, m.weight[:, left[g]], m.penalty[left[g]], m.b[left[g]], None if m.judged is None else m.judged[:, left[g]]) for g, m in state.items() if len(left[g])}
        if not part:
            return
        got = _pass(rows, part, predictors, response)
        for g in part:
            m, still = state[g], []
            d = m.b.shape[1]
            i, j = np.triu_indices(d)
            for row, k in enumerate(left[g]):
                if g not in got:
                    continue
                s, h = got[g][row], np.zeros((d, d))
                h[i, j] = h[j, i] = s[d:-1]
                m.deviance[k] = s[-1]
                new = _step(m.b[k], s[:d], h, m.penalty[k], m.positive, np.ones(d, bool) if m.mask is None else m.mask[k])
                if np.abs(new - m.b[k]).max() >= 1e-9:
                    still.append(k)
                m.b[k] = new
            left[g] = np.array(still, int)


@dataclass
class Facts:
    """Of a group: rows and presences by code, and each column's mean and spread."""

    n: np.ndarray
    y: np.ndarray
    mean: np.ndarray
    sd: np.ndarray


def facts(rows: DataFrame, predictors: Sequence[str], response: str, codes: int) -> dict[int, Facts]:
    one = lambda c: F.col(c).cast("double")
    moments = [f(one(p)).alias(f"{n}{i}") for i, p in enumerate(predictors) for f, n in ((F.avg, "m"), (F.var_pop, "v"))]
    by: dict[int, list] = {}
    for r in rows.groupBy("__g", "__c").agg(F.count("*").alias("n"), F.sum(one(response)).alias("y"), *moments).collect():
        by.setdefault(r["__g"], []).append(r)
    out = {}
    for g, parts in by.items():
        n, y = np.zeros(codes), np.zeros(codes)
        for r in parts:
            n[r["__c"]], y[r["__c"]] = r["n"], r["y"]
        w = np.array([r["n"] for r in parts], float)[:, None]
        m, v = (np.array([[r[f"{c}{i}"] for i in range(len(predictors))] for r in parts]) for c in "mv")
        mean = (w * m).sum(0) / w.sum()
        sd = np.sqrt((w * (v + (m - mean) ** 2)).sum(0) / w.sum())
        out[g] = Facts(n, y, mean, np.where(sd > 0, sd, 1))
    return out


def with_fold(rows: DataFrame, predictors: Sequence[str], response: str, seed: int = 42, folds: int = FOLDS) -> DataFrame:
    """Rows with __c, a fold by hash, the same at every pass; equal rows may share one."""
    return rows.withColumn("__c", F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns]), F.lit(folds)).cast("int"))


def ridges(rows: DataFrame, predictors: Sequence[str], response: str, folds: int = FOLDS, lam: float | None = None, seed: int = 42) -> tuple[dict[int, Models], dict[int, float], dict[int, Facts]]:
    """For each group the ridge of fitters.fit_ridge (one model), its penalty and the group's facts: the path over all rows
    first, then the held-out folds of every penalty, which start from it. One pass gives their quadratics about the start,
    which stand where no step is longer than FAR (a deviance's error is then of the third order); else they take passes to
    the end."""
    one_thread(rows)
    rows = with_fold(rows.select("__g", *predictors, response, *[c for c in rows.columns if c in ("row_id", "__copy")]), predictors, response, seed, folds)
    known, d = facts(rows, predictors, response, folds), len(predictors) + 1
    path = PATH if lam is None else np.array([lam])
    pen = lambda v, n: np.array([0.0, *[v * n] * (d - 1)])
    every = {g: Models(k.mean, k.sd, np.ones((folds, len(path))), np.array([pen(v, k.n.sum()) for v in path]), np.zeros((len(path), d)), positive=True) for g, k in known.items() if 0 < k.y.sum() < k.n.sum()}
    newton(rows, every, predictors, response)
    lams = {g: float(path[0]) for g in every}
    if lam is None:
        held = {g: np.flatnonzero(k.n) for g, k in known.items()}
        state, errors = {}, _near_errors(rows, every, held, known, predictors, response)
        for g, m in every.items():
            if g in errors:
                continue
            k = known[g]
            out = np.repeat(held[g], len(path))
            weight = (np.arange(folds)[:, None] != out[None, :]).astype(float)
            state[g] = Models(m.mean, m.sd, weight, np.array([pen(v, k.n.sum() - k.n[f]) for f in held[g] for v in path]), np.tile(m.b, (len(held[g]), 1)), 1 - weight, positive=True)
        newton(rows, state, predictors, response)
        errors |= {g: m.deviance.reshape(len(held[g]), len(path)).T / known[g].n[held[g]] for g, m in state.items()}
        for g, e in errors.items():
            mean, se = e.mean(1), e.std(1, ddof=1) / np.sqrt(e.shape[1])
            lams[g] = float(path[np.flatnonzero(mean <= mean.min() + se[mean.argmin()])[0]])
    for g, m in every.items():
        at = [int(np.argmin(np.abs(path - lams[g])))]
        every[g] = Models(m.mean, m.sd, m.weight[:, at], m.penalty[at], m.b[at], positive=True)
    return every, lams, known


def _near_errors(rows: DataFrame, every: dict[int, Models], held: dict[int, np.ndarray], known: dict[int, Facts], predictors: Sequence[str], response: str) -> dict[int, np.ndarray]:
    """(penalties, folds) for each group: the deviance a row of a held-out fold by the model of the others, from gradients,
    Hessians and deviances by fold at the models of all rows; groups with a step longer than FAR are left out."""
    state = {}
    for g, m in every.items():
        own = np.repeat(np.eye(len(m.weight)), len(m.b), axis=1)
        state[g] = Models(m.mean, m.sd, own, np.tile(m.penalty, (len(own), 1)), np.tile(m.b, (len(own), 1)), own)
    out = {}
    for g, got in _pass(rows, state, predictors, response).items():
        m, n = every[g], known[g].n
        d = m.b.shape[1]
        i, j = np.triu_indices(d)
        s, h = got.reshape(len(n), len(m.b), -1), np.zeros((len(n), len(m.b), d, d))
        h[..., i, j] = h[..., j, i] = s[..., d:-1]
        loss, far = np.zeros((len(m.b), len(held[g]))), 0.0
        for v, start in enumerate(m.b):
            for at, f in enumerate(held[g]):
                grad, curve, pen = s[:, v, :d].sum(0) - s[f, v, :d], h[:, v].sum(0) - h[f, v], m.penalty[v] * (1 - n[f] / n.sum())
                b = start
                for _ in range(50):
                    new = _step(b, grad - curve @ (b - start), curve, pen, True, np.ones(d, bool))
                    same, b = np.abs(new - b).max() < 1e-10, new
                    if same:
                        break
                step = b - start
                far = max(far, np.abs(step).max())
                loss[v, at] = (s[f, v, -1] - 2 * s[f, v, :d] @ step + step @ h[f, v] @ step) / n[f]
        if far <= FAR:
            out[g] = loss
    return out


def logistics(rows: DataFrame, predictors: Sequence[str], response: str, weights: dict[int, np.ndarray] | None = None, codes: int = 1) -> tuple[dict[int, Models], dict[int, Facts]]:
    """For each group the plain logistic models (fitters.fit_logistic) of its weights (codes, models); one of all rows if none
    are given."""
    one_thread(rows)
    rows = rows if "__c" in rows.columns else rows.withColumn("__c", F.lit(0))
    known, d = facts(rows, predictors, response, codes), len(predictors) + 1
    state = {}
    for g, k in known.items():
        w = np.ones((codes, 1)) if weights is None else weights[g]
        state[g] = Models(k.mean, k.sd, w, np.tile([0.0, *[1e-9] * (d - 1)], (w.shape[1], 1)), np.zeros((w.shape[1], d)))
    newton(rows, state, predictors, response)
    return state, known


def large_keys(rows: DataFrame, keys: Sequence[str], limit: int | None = None) -> list:
    """Values of the keys that have more than limit rows."""
    by = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    return by.where(F.col("__n") > (LARGE if limit is None else limit)).orderBy(*keys).collect()


def numbered(rows: DataFrame, keys: Sequence[str], found: Sequence, inside: bool = True) -> DataFrame:
    """The rows of the found keys, numbered by __g as found is; or those of no found key. The keys are few and broadcast."""
    spark = rows.sparkSession
    kinds = ", ".join([*(f"__k{i} {rows.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)), "__g int"])
    table = F.broadcast(spark.createDataFrame([(*[r[k] for k in keys], g) for g, r in enumerate(found)], kinds))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(table, on).drop(*[f"__k{i}" for i in range(len(keys))]) if inside else rows.join(table, on, "left_anti")


def dumped(m: Models, k: int = 0, lam: float = 0.0) -> bytes:
    """Model k as fitters.predict takes it."""
    return pickle.dumps({"family": "ridge", "b": m.linear(k), "lambda": lam})


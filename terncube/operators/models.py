"""Models: fitted per key with numpy inside applyInPandas, applied as expressions or batch functions."""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terncube.functions.fitters import FITTERS, deviance, fit_ridge, predict
from terncube.operators import spread as S
from terncube.operators.resampled import yearly_means
from terncube.operators.storage import shared_folder

#: Groups a model's cells are dealt into, and tasks that fits are dealt out over: adaptive plans would join small ones.
PARTS, TASKS = 8, 96
#: Families that are fitted by passes over the rows where a key has many.
LINEAR = ("ridge", "logistic")
#: Families whose fits take equal rows once, with their number.
COUNTED = ("glm", "gam", "rf", "nn", "brt", "brt_search")


def ridge_probability(coefficients: Sequence[float], columns: Sequence[str]) -> Column:
    """Logistic of intercept and weighted columns; null if a column is."""
    total = F.lit(coefficients[0])
    for b, c in zip(coefficients[1:], columns, strict=True):
        total = total + F.lit(b) * F.col(c)
    return 1 / (1 + F.exp(-total))


def _arrays(frame: pd.DataFrame, predictors: Sequence[str], response: str) -> tuple[np.ndarray, np.ndarray]:
    whole = frame.dropna(subset=[*predictors, response])
    return whole[list(predictors)].to_numpy(float), whole[response].to_numpy(float)


def fit(training: DataFrame, keys: Sequence[str], family: str, predictors: Sequence[str], response: str = "occurrence", least: int = 10, **settings) -> DataFrame:
    """Registry rows (keys, family, model, presences, absences, note): one fit per key, in parallel over keys. A key with
    fewer than least presences or absences has no model, nor has one whose fit fails; the note says why. Ridge and plain
    logistic models of keys with many rows are fitted by passes over the rows (spread.py); in other families a key's
    training table must fit one task, as the models need all its rows; equal rows travel once to all others."""
    kinds = dict(training.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "family string, model binary, presences long, absences long, note string"])
    if family in LINEAR and not settings:
        found = S.large_keys(training, keys)
        if found:
            big = training.sparkSession.createDataFrame(_spread_fits(training, keys, found, family, predictors, response, least), schema)
            rest = S.numbered(training, keys, found, inside=False)
            return big if rest.isEmpty() else big.unionByName(fit(rest, keys, family, predictors, response, least))

    rows = training.select(*keys, *predictors, response)
    if family in COUNTED:
        S.one_thread(training)
        number = F.sum("__n") if "__n" in training.columns else F.count("*")
        rows = training.groupBy(*rows.columns).agg(number.alias("__n"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = _arrays(frame, predictors, response)
        n, more = np.ones(len(y), int), {}
        if family in COUNTED:
            n = frame.dropna(subset=[*predictors, response])["__n"].to_numpy()
            more = {"n": n}
        presences, absences = int((n * y).sum()), int((n * (1 - y)).sum())
        model, note = None, ""
        if min(presences, absences) < least:
            note = "too few presences or absences"
        else:
            try:
                found = FITTERS[family](x, y, **settings, **more)
                model, note = (pickle.dumps(found), "") if found else (None, "no learning rate found")
            except (np.linalg.LinAlgError, ValueError) as error:
                note = f"fit failed: {error}"
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in keys}, "family": family, "model": model, "presences": presences, "absences": absences, "note": note}])

    return rows.repartition(TASKS, *keys).groupBy(*keys).applyInPandas(run, schema)


def _spread_fits(training: DataFrame, keys: Sequence[str], found: Sequence, family: str, predictors: Sequence[str], response: str, least: int) -> list[tuple]:
    """Registry rows of the found keys, fitted by passes over their rows."""
    rows = S.numbered(training, keys, found).where(S.whole([*predictors, response]))
    if family == "ridge":
        models, lams, known = S.ridges(rows, predictors, response)
    else:
        models, known = S.logistics(rows, predictors, response)
        lams = dict.fromkeys(models, 0.0)
    out = []
    for g, r in enumerate(found):
        n, y = (int(known[g].n.sum()), int(known[g].y.sum())) if g in known else (0, 0)
        few = min(y, n - y) < least or g not in models
        model, note = (None, "too few presences or absences") if few else (S.dumped(models[g], 0, lams[g]), "")
        out.append((*[r[k] for k in keys], family, model, y, n - y, note))
    return out


def with_linear(rows: DataFrame, weights: DataFrame, keys: Sequence[str], predictors: Sequence[str], out: str) -> DataFrame:
    """rows with the probability by their key's linear model, from weights (keys, b): few, so they are broadcast; null where
    a predictor is or there is no model."""
    own = weights.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("b").alias("__b"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    total = F.get("__b", F.lit(0))
    for i, p in enumerate(predictors, 1):
        total = total + F.get("__b", F.lit(i)) * F.col(p).cast("double")
    p = F.when(S.whole(predictors) & F.col("__b").isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), total)))))
    return rows.join(F.broadcast(own), on, "left").withColumn(out, p).drop("__b", *[f"__k{i}" for i in range(len(keys))])


def predict_linear(cells: DataFrame, models: DataFrame, keys: Sequence[str], predictors: Sequence[str], out: str = "prob") -> DataFrame:
    """predict_with for ridge and logistic models, without moving the cells."""
    kinds = dict(models.dtypes)

    def run(frames):
        for frame in frames:
            yield frame[list(keys)].assign(b=[list(pickle.loads(m)["b"]) for m in frame["model"]])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "b array<double>"])
    return with_linear(cells, models.where("model is not null").select(*keys, "model").mapInPandas(run, schema), keys, predictors, out)


def predict_with(cells: DataFrame, models: DataFrame, keys: Sequence[str], predictors: Sequence[str], out: str = "prob", gaps: bool = False) -> DataFrame:
    """cells with the probability of their key's model, null where a predictor is null (gaps: trees judge it on their right)
    or there is no model. A model meets its cells in PARTS groups by key and hash, so that it travels once a group and not
    once a row."""
    part = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in cells.columns]), F.lit(PARTS)).cast("int")
    left = cells.withColumn("__part", part)
    right = models.where("model is not null").select(*keys, "model", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["__part"])
        x = np.column_stack([rows.column(c).cast(pa.float64()).to_numpy() for c in predictors])
        p = np.full(rows.num_rows, np.nan)
        whole = np.full(len(x), True) if gaps else ~np.isnan(x).any(1)
        if found.num_rows and whole.any() and all(found.column(k)[0].is_valid for k in keys):
            p[whole] = predict(pickle.loads(found.column("model")[0].as_py()), x[whole])
        return rows.append_column(out, pa.array(p, pa.float64(), mask=np.isnan(p)))

    schema = StructType([*cells.schema.fields, StructField(out, DoubleType())])
    return left.groupBy(*keys, "__part").cogroup(right.groupBy(*keys, "__part")).applyInArrow(run, schema)


def block_cv(training: DataFrame, keys: Sequence[str], family: str, predictors: Sequence[str], response: str = "occurrence", fold: str = "fold_id", row: str = "row_id", keep: Sequence[str] = (), **settings) -> DataFrame:
    """Out-of-fold probabilities (keys, row, fold, y, p, keep): for each fold a fit on the others. Every (key, held-out fold)
    is a task of its own; a null fold is on neither side. p is null where no model was found. Linear models of keys with
    many rows are fitted by passes, and their rows do not move. keep: more columns of the rows."""
    kinds = dict(training.dtypes)
    rows = training.where(F.col(fold).isNotNull())
    if family in LINEAR and not settings:
        found = S.large_keys(rows, keys)
        if found:
            big = _spread_cv(rows, keys, found, family, predictors, response, fold).select(*keys, row, fold, F.col(response).cast("int").alias("y"), "p", *keep)
            rest = S.numbered(rows, keys, found, inside=False)
            return big if rest.isEmpty() else big.unionByName(block_cv(rest, keys, family, predictors, response, fold, row, keep))
    if family == "brt_search":
        return _searched_cv(rows, keys, predictors, response, fold, **settings).select(*keys, row, fold, F.col(response).cast("int").alias("y"), "p", *keep)
    held = rows.select(*keys, F.col(fold).alias("held")).distinct()
    rows = rows.select(*dict.fromkeys([*keys, row, fold, response, *predictors, *keep]))
    spread = rows.join(held, list(keys)) if keys else rows.join(held)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        k = frame["held"].iloc[0]
        train, test = frame[frame[fold] != k], frame[frame[fold] == k]
        x, y = _arrays(train, predictors, response)
        out = test[[*keys, row, fold]].copy()
        out["y"] = test[response].astype("int32")
        model = FITTERS[family](x, y, **settings) if len(np.unique(y)) == 2 and len(test) else None
        out["p"] = predict(model, test[list(predictors)].to_numpy(float)) if model else None
        for c in keep:
            out[c] = test[c]
        return out

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{row} {kinds[row]}", f"{fold} {kinds[fold]}", "y int, p double", *(f"{c} {kinds[c]}" for c in keep)])
    return spread.repartition(TASKS, *keys, "held").groupBy(*keys, "held").applyInPandas(run, schema)


def _searched_cv(rows: DataFrame, keys: Sequence[str], predictors: Sequence[str], response: str, fold: str, **settings) -> DataFrame:
    """The rows with p by a search for each key and held-out fold. Equal rows travel once to a search, with their number; a
    model meets the rows of its fold in groups."""
    own = [*keys, fold]
    kinds = rows.select(*own, *predictors, response).groupBy(*own, *predictors, response).agg(F.count("*").alias("__n"))
    held = rows.select(*keys, F.col(fold).alias("__held")).distinct()
    train = (kinds.join(F.broadcast(held), list(keys)) if keys else kinds.join(F.broadcast(held))).where(F.col("__held") != F.col(fold))
    models = fit(train.drop(fold).withColumnRenamed("__held", fold), own, "brt_search", predictors, response, least=1, **settings)
    path = shared_folder(rows.sparkSession, "searched")
    models.write.parquet(path)  # however often the result is read, a search runs once
    models = rows.sparkSession.read.parquet(path)
    return predict_with(rows, models, own, predictors, "p", gaps=True)


def member_cv(training: DataFrame, keys: Sequence[str], families: Sequence[str], predictors: Sequence[str], response: str = "occurrence", fold: str = "fold_id", row: str = "row_id") -> DataFrame:
    """block_cv by several families (keys, row, fold, y, a column a family). Equal rows of a key travel once, with their
    number in each fold, and once more to each held-out fold's fits, a task each; the models, few and small, come to the
    rows, which do not move."""
    spark, kinds = training.sparkSession, dict(training.dtypes)
    S.one_thread(training)  # before the first worker: other settings later would start a second set of them
    rows = training.where(F.col(fold).isNotNull()).select(*dict.fromkeys([*keys, row, fold, response, *predictors]))
    own = [tuple(r) for r in rows.select(*keys, fold).distinct().collect()]
    names = sorted({r[-1] for r in own})
    alike = rows.where(S.whole([*predictors, response])).groupBy(*keys, *predictors, response).agg(*[F.count_if(F.col(fold) == F.lit(f)).alias(f"__n{i}") for i, f in enumerate(names)])
    total = sum((F.col(f"__n{i}") for i in range(len(names))), F.lit(0))
    others = F.explode(F.array(*[F.struct(F.lit(f).cast(kinds[fold]).alias("held"), (total - F.col(f"__n{i}")).alias("n")) for i, f in enumerate(names)])).alias("__of")
    train = alike.select(*keys, *predictors, response, others).select(*keys, *predictors, response, F.col("__of.held").alias(fold), F.col("__of.n").alias("__n")).where("__n > 0")
    number = {k: i for i, k in enumerate(own)}
    path = shared_folder(spark, "train")
    train.write.parquet(path)  # each family reads it
    train, models = spark.read.schema(train.schema).parquet(path), {}
    each = train.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).drop("__n")
    for family in families:
        for r in fit(train if family in COUNTED else each, [*keys, fold], family, predictors, response, least=1).where("model is not null").collect():
            at = number.get(tuple(r[k] for k in [*keys, fold]))
            if at is not None:
                models[family, at] = bytes(r["model"])
    table = F.broadcast(spark.createDataFrame([(*k, i) for k, i in number.items()], ", ".join([*(f"__k{i} {kinds[k]}" for i, k in enumerate([*keys, fold])), "__own int"])))
    on = F.lit(True)
    for i, k in enumerate([*keys, fold]):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    given = rows.join(table, on).select(*keys, row, fold, F.col(response).cast("int").alias("y"), *[F.col(p).cast("double").alias(f"__x{i}") for i, p in enumerate(predictors)], "__own")
    kept = [*keys, row, fold, "y"]

    def run(batches):
        found = {k: pickle.loads(m) for k, m in models.items()}
        for batch in batches:
            x = np.column_stack([batch.column(f"__x{i}").to_numpy(zero_copy_only=False) for i in range(len(predictors))]).astype(float)
            at, out = batch.column("__own").to_numpy(), []
            for family in families:
                p = np.full(len(at), np.nan)
                for k in np.unique(at):
                    if (family, int(k)) in found:
                        m = at == k
                        p[m] = predict(found[family, int(k)], x[m])
                out.append(pa.array(p, pa.float64(), mask=np.isnan(p)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out], [*kept, *families])

    schema = StructType([*given.select(*kept).schema.fields, *[StructField(f, DoubleType()) for f in families]])
    return given.mapInArrow(run, schema)


def _spread_cv(rows: DataFrame, keys: Sequence[str], found: Sequence, family: str, predictors: Sequence[str], response: str, fold: str) -> DataFrame:
    """The rows of the found keys with p, by passes: one model a key and held-out fold."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)[fold]
    rows = S.numbered(rows, keys, found).withColumnRenamed("__g", "__key_no")
    pairs = [tuple(r) for r in rows.select("__key_no", fold).distinct().orderBy("__key_no", fold).collect()]
    own = F.broadcast(spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], f"__key_no int, {fold} {kind}, __own int"))
    rows = rows.join(own, ["__key_no", fold])
    train = rows.where(S.whole([*predictors, response]))
    if family == "ridge":  # each with a penalty of its own, chosen on its rows alone
        others = [[j for j, q in enumerate(pairs) if q[0] == p[0] and j != i] for i, p in enumerate(pairs)]
        table = F.broadcast(spark.createDataFrame([(i, j) for i, js in enumerate(others) for j in js], "__own int, __g int"))
        models = {g: m.linear(0) for g, m in S.ridges(train.join(table, "__own"), predictors, response)[0].items()}
    else:
        of = {g: [i for i, p in enumerate(pairs) if p[0] == g] for g in {p[0] for p in pairs}}
        weights = {}
        for g, own_of in of.items():
            weights[g] = np.zeros((len(pairs), len(own_of)))
            for m, i in enumerate(own_of):
                weights[g][[j for j in own_of if j != i], m] = 1
        fits, known = S.logistics(train.withColumnsRenamed({"__key_no": "__g", "__own": "__c"}), predictors, response, weights, len(pairs))
        models = {}
        for g, m in fits.items():
            n, y = known[g].n @ weights[g], known[g].y @ weights[g]
            models |= {i: m.linear(k) for k, i in enumerate(of[g]) if 0 < y[k] < n[k]}
    table = spark.createDataFrame([(g, [float(v) for v in b]) for g, b in models.items()], "__own int, b array<double>")
    return with_linear(rows, table, ["__own"], predictors, "p").drop("__own", "__key_no")


def importance(training: DataFrame, predictors: Sequence[str], response: str = "occurrence") -> DataFrame:
    """(predictor, importance): loss of explained deviance of a ridge without it, floored at 0 and summing to 1. Many rows
    are fitted by passes, all models at once."""
    training = training.select(*[c for c in training.columns if c in ("row_id", response, *predictors)])
    if S.large_keys(training.withColumn("__all", F.lit(1)), ["__all"]):
        return _spread_importance(training.withColumn("__g", F.lit(0)).where(S.whole([*predictors, response])), predictors, response)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = _arrays(frame, predictors, response)
        null = deviance(y, np.full(len(y), y.mean()))
        full = fit_ridge(x, y)
        ratio = lambda cols: 1 - deviance(y, predict(fit_ridge(x[:, cols], y, lam=full["lambda"]), x[:, cols])) / null
        every = list(range(len(predictors)))
        loss = np.maximum(0, [ratio(every) - ratio([c for c in every if c != j]) for j in every])
        return pd.DataFrame({"predictor": list(predictors), "importance": loss / loss.sum() if loss.sum() > 0 else None})

    return training.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(run, "predictor string, importance double")


def _spread_importance(rows: DataFrame, predictors: Sequence[str], response: str) -> DataFrame:
    models, lams, known = S.ridges(rows, predictors, response)
    schema = "predictor string, importance double"
    if not models:
        return rows.sparkSession.createDataFrame([(p, None) for p in predictors], schema)
    full, d = models[0], len(predictors) + 1
    mask = np.array([[j == 0 or j != out for j in range(d)] for out in range(d)])  # the first leaves out nothing
    n, y, one = known[0].n.sum(), known[0].y.sum(), np.ones((1, d))
    models = S.Models(full.mean, full.sd, one, np.tile(full.penalty[0], (d, 1)), np.where(mask, full.b[0], 0.0), one, True, mask)
    S.newton(rows.withColumn("__c", F.lit(0)), {0: models}, predictors, response)
    null = -2 * (y * np.log(y / n) + (n - y) * np.log(1 - y / n))
    loss = np.maximum(0, (models.deviance[1:] - models.deviance[0]) / null)
    return rows.sparkSession.createDataFrame([(p, float(v / loss.sum()) if loss.sum() > 0 else None) for p, v in zip(predictors, loss, strict=True)], schema)


def trend_bootstrap(training: DataFrame, predictors: Sequence[str], n: int = 200, seed: int = 42, response: str = "occurrence") -> DataFrame:
    """(year, bootMean, bootSE, lwr95, upr95, nBootOK): ridge refits on resampled rows, one task a draw, each with its own
    five-fold one-standard-error penalty; a year's value is the mean prediction of its rows without a null predictor. A draw
    of one class, or whose fit fails, is left out. Of many rows the draws are made and fitted by passes (resampled.py)."""
    if training.where(S.whole([*predictors, response])).count() > S.LARGE:
        return _interval(yearly_means(training, predictors, n, seed, response))
    draws = training.sparkSession.range(n).select(F.col("id").cast("int").alias("draw")).repartition(n)
    spread = draws.join(training.select("row_id", "year", *predictors, response))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, draw = frame.sort_values("row_id"), int(frame["draw"].iloc[0])
        rng = np.random.default_rng([seed, draw])
        x, y = _arrays(frame, predictors, response)
        at = rng.integers(0, len(y), len(y)) if len(y) else np.zeros(0, int)
        cells = frame.dropna(subset=["year", *predictors])
        p = np.full(len(cells), np.nan)
        if len(np.unique(y[at])) == 2:
            try:
                p = predict(fit_ridge(x[at], y[at], seed=[seed, draw, 1], folds=5), cells[list(predictors)].to_numpy(float))
            except (np.linalg.LinAlgError, ValueError):
                pass
        yearly = pd.Series(p).groupby(cells["year"].to_numpy()).mean()
        return pd.DataFrame({"year": yearly.index.to_numpy(), "p": yearly.to_numpy()})

    got = spread.repartition(n, "draw").groupBy("draw").applyInPandas(run, "year int, p double").where("p is not null and not isnan(p)")
    return _interval(got)


def _interval(got: DataFrame) -> DataFrame:
    return got.groupBy("year").agg(F.avg("p").alias("bootMean"), F.stddev_samp("p").alias("bootSE"), F.percentile("p", F.lit(0.025)).alias("lwr95"), F.percentile("p", F.lit(0.975)).alias("upr95"), F.count("*").alias("nBootOK"))

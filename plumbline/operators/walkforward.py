"""Embargoed walk-forward evaluation.

Folds are a small table; rows meet their fold by an equi-join on symbol and a range
of positions, never by copying arrays. Baseline models are columns; fitted
models run in a grouped map over (symbol, model, fold).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import TuningConfig, WalkForwardConfig, describe_params
from plumbline.functions.core import by_symbol, full, trailing
from plumbline.operators import metrics as m
from plumbline.operators.models import Model, factory_of
from plumbline.sources.scratch import kept


def fold_table(sizes: DataFrame, config: WalkForwardConfig | None = None, horizon: int = 1) -> DataFrame:
    """symbol, n -> symbol, fold, train_start, train_end, test_start, test_end (ends exclusive); raises if a symbol is too short."""
    c = config or WalkForwardConfig()
    gap, step = c.resolved_embargo(horizon), c.resolved_step()
    n = F.col("n").cast("int")
    least = c.train_size + gap + 1
    checked = F.when(n < least, F.raise_error(F.concat(F.lit(f"a walk-forward split needs {least} bars, got "), n.cast("string"))).cast("int")).otherwise(n)
    # fold i is the last whose test reaches n: starts lie below n, and the first test that ends at n or beyond closes the list
    last = F.least(F.floor((n - 1 - c.train_size - gap) / step), F.ceil(F.greatest(n - c.test_size - c.train_size - gap, F.lit(0)) / step)).cast("int")
    out = sizes.select("symbol", checked.alias("n")).select("symbol", "n", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    out = out.withColumn("train_end", F.lit(c.train_size) + F.col("i") * step)
    out = out.withColumn("train_start", F.lit(0) if c.expanding else F.greatest(F.col("train_end") - c.train_size, F.lit(0)))
    out = out.where(F.col("train_end") - F.col("train_start") >= c.resolved_min_train_size())
    out = out.withColumn("test_start", F.col("train_end") + gap)
    fold = (F.row_number().over(Window.partitionBy("symbol").orderBy("i")) - 1).alias("fold")
    return out.select("symbol", fold, "train_start", "train_end", "test_start", F.least(F.col("test_start") + c.test_size, F.col("n")).alias("test_end"))


def folds_of(dataset: DataFrame, config: WalkForwardConfig | None = None, horizon: int = 1) -> DataFrame:
    return fold_table(dataset.groupBy("symbol").agg(F.count("*").alias("n")), config, horizon)


def fold_count(folds: DataFrame) -> DataFrame:
    return folds.groupBy("symbol").agg(F.count("*").alias("n_folds"))


def rows_of(dataset: DataFrame, folds: DataFrame, part: str) -> DataFrame:
    """Rows of the train or test range of each fold."""
    inside = (F.col("d.symbol") == F.col("f.symbol")) & (F.col("d.pos") >= F.col(f"f.{part}_start")) & (F.col("d.pos") < F.col(f"f.{part}_end"))
    return dataset.alias("d").join(folds.alias("f"), inside).select("d.*", "f.fold")


def baseline_predictions(dataset: DataFrame, folds: DataFrame) -> DataFrame:
    """Predictions of the four models that need no fit: zero, train_mean, momentum, reversion."""
    test = rows_of(dataset, folds, "test")
    means = rows_of(dataset, folds, "train").groupBy("symbol", "fold").agg(F.avg("forward_return").alias("__mean"))
    joined = test.join(means, ["symbol", "fold"])
    signals = F.array(
        *[F.struct(F.lit(k).alias("model"), v.alias("signal")) for k, v in (("zero", F.lit(0.0)), ("train_mean", F.col("__mean")), ("momentum", F.col("ret_1d")), ("reversion", -F.col("ret_1d")))]
    )
    return joined.select("symbol", "fold", "date", "pos", F.inline(signals), "forward_return", "direction", "close")


Chooser = str | Callable[..., Model]


def _named(model: Chooser) -> tuple[str, Callable[..., Model]]:
    """A model's name and factory, looked up on the driver so that workers need no registry."""
    return (model, factory_of(model)) if isinstance(model, str) else (getattr(model, "__name__", type(model).__name__), model)


def _fitted(factory: Callable[..., Model], params: dict, train: pd.DataFrame, names: list[str]) -> Model | None:
    """A model fitted on the labelled rows; None where fewer than two have a label."""
    estimator = factory(**params)
    label = "direction" if estimator.is_classifier else "forward_return"
    known = train[train[label].notna()]
    if len(known) < 2:
        return None
    estimator.fit(known[names].to_numpy(float), known[label].to_numpy(float), names)
    return estimator


PREDICTION = "symbol string, model string, fold int, date date, pos int, signal double, forward_return double, direction double, close double"


def fit_predict(dataset: DataFrame, folds: DataFrame, model: Chooser, features: Sequence[str], params: dict | None = None, records: DataFrame | None = None, grid: Sequence[dict] = ()) -> DataFrame:
    """Fit a model (a registered name or a factory) for each fold on its labelled training rows and predict its test rows.

    records (symbol, fold, candidate, chosen) and grid: each fold is fitted with the
    parameters chosen for it; a fold without a choice keeps the defaults.
    """
    both = rows_of(dataset, folds, "train").withColumn("part", F.lit(0)).unionByName(rows_of(dataset, folds, "test").withColumn("part", F.lit(1)))
    if records is not None:
        both = both.join(records.where("chosen").select("symbol", "fold", "candidate"), ["symbol", "fold"], "left")
    else:
        both = both.withColumn("candidate", F.lit(None).cast("int"))
    names, own, choices = list(features), dict(params or {}), [dict(g) for g in grid]
    called, factory = _named(model)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        train, test = pdf[pdf["part"] == 0], pdf[pdf["part"] == 1]
        at = pdf["candidate"].iloc[0]
        estimator = _fitted(factory, own | (choices[int(at)] if pd.notna(at) else {}), train, names) if len(test) else None
        columns = ["symbol", "model", "fold", "date", "pos", "signal", "forward_return", "direction", "close"]
        if estimator is None:
            return pd.DataFrame(columns=columns)
        out = test[["symbol", "fold", "date", "pos", "forward_return", "direction", "close"]].copy()
        out["signal"] = estimator.predict(test[names].to_numpy(float))
        out["model"] = called
        return out[columns]

    return both.groupBy("symbol", "fold").applyInPandas(run, PREDICTION)


def importances(dataset: DataFrame, folds: DataFrame, model: Chooser, features: Sequence[str], params: dict | None = None) -> DataFrame:
    """symbol, fold, feature, importance of each fold's fit."""
    names, own = list(features), dict(params or {})
    _, factory = _named(model)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        estimator = _fitted(factory, own, pdf.sort_values("pos"), names)
        weights = None if estimator is None else estimator.feature_importance()
        if weights is None:
            return pd.DataFrame(columns=["symbol", "fold", "feature", "importance"])
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "fold": int(pdf["fold"].iloc[0]), "feature": names, "importance": weights})

    return rows_of(dataset, folds, "train").groupBy("symbol", "fold").applyInPandas(run, "symbol string, fold int, feature string, importance double")


def importance_stability(weights: DataFrame) -> DataFrame:
    """mean, sample deviation and their ratio for each feature."""
    out = weights.groupBy("symbol", "feature").agg(F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("std"))
    return out.withColumn("cv", F.try_divide("std", F.abs("mean")))


def pooled(predictions: DataFrame) -> DataFrame:
    """One row for each (symbol, model, date); overlapping folds are averaged."""
    return predictions.groupBy("symbol", "model", "date").agg(F.avg("signal").alias("signal"), F.max("forward_return").alias("forward_return"), F.max("direction").alias("direction"), F.max("close").alias("close"))


KEYS = ("symbol", "model")


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """One row for each fold: dates, size and both families of metrics."""
    keys = [*KEYS, "fold"]
    spans = predictions.groupBy(*keys).agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.count("*").alias("test_size"))
    reg = m.regression_metrics(predictions, "forward_return", "signal", keys)
    cls = m.classification_metrics(predictions, "direction", "signal", keys).drop("n")
    return spans.join(reg, keys).join(cls, keys, "left")


def independent_folds(predictions: DataFrame, horizon: int) -> DataFrame:
    """symbol, model, independent_folds: union of the folds' outcome windows over their mean width, on the pooled calendar."""
    calendar = predictions.select(*KEYS, "date").distinct().withColumn("rn", F.row_number().over(Window.partitionBy(*KEYS).orderBy("date")) - 1)
    rows = predictions.join(calendar, [*KEYS, "date"]).groupBy(*KEYS, "fold").agg(F.min("rn").alias("start"), (F.max("rn") + max(horizon, 1)).alias("end"))
    return m.covered_ratio(rows, "start", "end", KEYS).withColumnRenamed("ratio", "independent_folds")


def fold_summary(predictions: DataFrame, horizon: int) -> DataFrame:
    """Mean, deviation, effective count, t-values and share of positive fold ICs."""
    folds = m.regression_metrics(predictions, "forward_return", "signal", [*KEYS, "fold"])
    sums = folds.groupBy(*KEYS).agg(F.avg("ic_pearson").alias("ic_fold_mean"), F.stddev_samp("ic_pearson").alias("ic_fold_std"), F.count("ic_pearson").alias("__k"), F.count("*").alias("__n"), F.avg(F.when(F.col("ic_pearson").isNotNull(), (F.col("ic_pearson") > 0).cast("double"))).alias("ic_fold_positive_rate"))
    out = sums.join(independent_folds(predictions, horizon), list(KEYS)).withColumn("ic_fold_n_eff", F.when(F.col("__k") > 0, F.col("independent_folds") * F.col("__k") / F.col("__n")))
    per = F.when(F.col("ic_fold_std") > 1e-12, F.col("ic_fold_mean") / F.nullif(F.col("ic_fold_std"), F.lit(0.0)))
    out = out.withColumn("ic_fold_t", per * F.sqrt("ic_fold_n_eff")).withColumn("ic_fold_t_naive", per * F.sqrt("__k"))
    return out.select(*KEYS, F.col("__n").cast("double").alias("n_folds"), "ic_fold_mean", "ic_fold_std", "ic_fold_n_eff", "ic_fold_t", "ic_fold_t_naive", "ic_fold_positive_rate")


def walk_forward_metrics(predictions: DataFrame, horizon: int) -> DataFrame:
    rows = pooled(predictions)
    reg = m.regression_metrics(rows, "forward_return", "signal", KEYS)
    cls = m.classification_metrics(rows, "direction", "signal", KEYS).drop("n")
    return reg.join(cls, list(KEYS)).join(fold_summary(predictions, horizon), list(KEYS))


def regime_labels(n: str = "n_bins", bin_: str = "bin", names: Sequence[str] = ("low_vol", "mid_vol", "high_vol"), prefix: str = "vol"):
    return F.when(F.col(n) == 3, F.get(F.array(*[F.lit(x) for x in names]), F.col(bin_))).otherwise(F.concat(F.lit(f"{prefix}_q"), (F.col(bin_) + 1).cast("string"), F.lit("_of_"), F.col(n).cast("string")))


def regime_metrics(predictions: DataFrame, volatility: DataFrame, n_bins: int = 3) -> DataFrame:
    """Metrics by quantile bin of trailing volatility (symbol, date, volatility)."""
    rows = pooled(predictions).join(volatility, ["symbol", "date"]).where("volatility is not null")
    binned = m.quantile_bins(rows, "volatility", n_bins, KEYS).withColumn("regime", regime_labels())
    keys = [*KEYS, "regime"]
    reg = m.regression_metrics(binned, "forward_return", "signal", keys)
    cls = m.classification_metrics(binned, "direction", "signal", keys).drop("n")
    return reg.join(cls, keys, "left").join(binned.groupBy(*keys).agg(F.avg("volatility").alias("realised_vol_mean")), keys)


def trailing_volatility(bars: DataFrame, window: int = 20) -> DataFrame:
    r = bars.withColumn("__r", F.col("close") / F.lag("close").over(by_symbol()) - 1)
    return r.select("symbol", "date", (full(F.stddev_samp("__r"), "__r", window, trailing(window)) * 252**0.5).alias("volatility"))


def inner_schedule(n: str | Column, embargo: int, config: TuningConfig) -> tuple[Column, Column]:
    """(rows before the first validation window, rows of each) for n training rows; both NULL where the rows do not suffice.

    The last window ends with the training rows: first + embargo + folds * window = n.
    """
    rows, folds = (F.col(n) if isinstance(n, str) else n).cast("int"), config.n_inner_folds
    window = F.greatest(F.floor(F.floor(rows * config.inner_fraction) / folds), F.lit(1)).cast("int")
    first = rows - embargo - window * folds
    enough = (rows - embargo >= 2 * folds) & (first >= F.greatest(window, F.lit(config.min_inner_train)))
    return F.when(enough, first), F.when(enough, window)


def inner_folds(folds: DataFrame, embargo: int, config: TuningConfig) -> DataFrame:
    """symbol, fold (of the outer walk-forward), inner and its train and test ranges, all within the outer training rows."""
    first, window = inner_schedule(F.col("train_end") - F.col("train_start"), embargo, config)
    out = folds.select("symbol", "fold", F.col("train_start").alias("start"), first.alias("first"), window.alias("window")).where("window is not null")
    out = out.withColumn("inner", F.explode(F.sequence(F.lit(0), F.lit(config.n_inner_folds - 1))))
    out = out.withColumn("train_end", F.col("start") + F.col("first") + F.col("inner") * F.col("window")).withColumn("test_start", F.col("train_end") + embargo)
    return out.select("symbol", "fold", "inner", F.col("start").alias("train_start"), "train_end", "test_start", (F.col("test_start") + F.col("window")).alias("test_end"))


def candidate_scores(dataset: DataFrame, folds: DataFrame, model: Chooser, features: Sequence[str], tuning: TuningConfig, embargo: int = 1) -> DataFrame:
    """symbol, fold, candidate, score: each candidate's mean finite metric over the inner folds of the training rows; NULL where a fit is refused (ValueError) or nothing is finite."""
    names, grid = list(features), tuning.candidates()
    _, factory = _named(model)
    plan = inner_folds(folds, embargo, tuning).withColumn("key", F.concat_ws(":", "fold", "inner"))
    parts = [rows_of(dataset, plan.withColumn("fold", F.col("key")), kind).withColumn("part", F.lit(i)) for i, kind in enumerate(("train", "test"))]
    columns = ["symbol", "key", "candidate", "signal", "forward_return", "direction"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        train, test = pdf[pdf["part"] == 0], pdf[pdf["part"] == 1]
        out = []
        for i, params in enumerate(grid):
            rows = test[["symbol", "forward_return", "direction"]].assign(key=pdf["fold"].iloc[0], candidate=i, signal=float("nan"))
            try:
                estimator = _fitted(factory, params, train, names)
                if estimator is not None:
                    rows["signal"] = estimator.predict(test[names].to_numpy(float))
            except ValueError:
                pass  # a grid may hold combinations that a model refuses
            out.append(rows)
        return pd.concat(out)[columns]

    tried = parts[0].unionByName(parts[1]).groupBy("symbol", "fold").applyInPandas(run, "symbol string, key string, candidate int, signal double, forward_return double, direction double")
    tried = kept(tried.withColumn("signal", F.when(~F.isnan("signal"), F.col("signal"))), "candidates")  # fitted once, read by three groups of figures
    keys = ["symbol", "key", "candidate"]
    measured = m.regression_metrics(tried, "forward_return", "signal", keys).join(m.classification_metrics(tried, "direction", "signal", keys).drop("n"), keys, "left")
    value = F.col(tuning.metric) if tuning.metric in measured.columns else F.lit(None).cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    refused = tried.groupBy(*keys).agg((F.count("signal") == 0).alias("refused"))
    each = refused.join(measured.select(*keys, finite.alias("value")), keys, "left").withColumn("fold", F.substring_index("key", ":", 1).cast("int"))
    return each.groupBy("symbol", "fold", "candidate").agg(F.when(~F.bool_or("refused"), F.avg("value")).alias("score"))


def choose(scores: DataFrame, higher_is_better: bool = True, keys: Sequence[str] = ("symbol", "fold")) -> DataFrame:
    """scores with `chosen`: the best finite score of each key, the first candidate of equal ones; keys without one are left out."""
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    w = Window.partitionBy(*keys)
    best = F.row_number().over(w.orderBy(F.when(finite, F.col("score") * (-1 if higher_is_better else 1)).asc_nulls_last(), "candidate"))
    out = scores.withColumn("chosen", (best == 1) & finite).withColumn("any_chosen", F.bool_or("chosen").over(w))
    return out.where("any_chosen").drop("any_chosen")


def select_params(dataset: DataFrame, folds: DataFrame, model: Chooser, features: Sequence[str], tuning: TuningConfig, embargo: int = 1) -> DataFrame:
    """symbol, fold, candidate, params, score, chosen, from training rows alone; folds where nothing could be chosen have no rows."""
    labels = F.array(*[F.lit(describe_params(p)) for p in tuning.candidates()])
    scores = candidate_scores(dataset, folds, model, features, tuning, embargo)
    return choose(scores, tuning.higher_is_better).select("symbol", "fold", "candidate", F.get(labels, F.col("candidate")).alias("params"), "score", "chosen")


def tuned_predictions(dataset: DataFrame, folds: DataFrame, model: Chooser, features: Sequence[str], tuning: TuningConfig, embargo: int = 1, params: dict | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(predictions, selection records): every fold fitted with the parameters that its own training rows chose; the records are None where there is nothing to choose."""
    if not tuning.enabled:
        return fit_predict(dataset, folds, model, features, params), None
    records = select_params(dataset, folds, model, features, tuning, embargo)
    return fit_predict(dataset, folds, model, features, params, records, tuning.candidates()), records


def selected_params(records: DataFrame) -> DataFrame:
    """fold x parameter: the chosen values as text."""
    pairs = records.where("chosen").select("symbol", "fold", F.explode(F.split("params", ", ")).alias("pair"))
    return pairs.select("symbol", "fold", F.substring_index("pair", "=", 1).alias("parameter"), F.substring_index("pair", "=", -1).alias("value"))


def selection_stability(chosen: DataFrame) -> DataFrame:
    """For each parameter the number of distinct values, the most frequent one (the least of equals) and its share."""
    counts = chosen.groupBy("symbol", "parameter", "value").agg(F.count("*").alias("k"))
    return counts.groupBy("symbol", "parameter").agg(F.count("*").alias("n_distinct"), F.min_by("value", F.struct(-F.col("k"), F.col("value"))).alias("modal_value"), (F.max("k") / F.sum("k")).alias("modal_share"))


def selection_spread(records: DataFrame) -> DataFrame:
    """Mean over folds of the gap between the best and the worst finite score."""
    finite = records.where(F.col("score").isNotNull() & ~F.isnan("score"))
    per = finite.groupBy("symbol", "fold").agg(F.count("*").alias("k"), (F.max("score") - F.min("score")).alias("gap")).where("k >= 2")
    return per.groupBy("symbol").agg(F.avg("gap").alias("spread"))

"""WF, MOD, AGG-01..03 and AGG-15..25 queries over price-path bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.config import TuningConfig, WalkForwardConfig
from plumbline.functions import indicators as ind
from plumbline.functions.core import by_symbol, guarded_corr, average_rank
from plumbline.operators import features as fea
from plumbline.operators import metrics as m
from plumbline.operators import models as mod
from plumbline.operators import walkforward as wf
from plumbline.queries.base import ANNUAL, PATH, W, add, rolled, rounded
from plumbline.sources.adapters import price_path
from plumbline.sources.scratch import kept

H = 5


def light(spark, sf_dir):
    """The data set with one feature, ret_1d, and a five-bar target."""
    bars = fea.build_targets(price_path(spark, sf_dir), H).withColumn("ret_1d", F.round(ind.log_return("close", 1), 9)).withColumn("forward_return", F.round("forward_return", 9))
    rows = bars.where("ret_1d is not null and forward_return is not null")
    return rows.select("symbol", "date", (F.row_number().over(by_symbol()) - 1).alias("pos"), "ret_1d", "forward_return", "direction", "close")


DS = PATH + f""",
tt as (select symbol, date, close, round(ln(close) - ln(lag(close) over {W}), 9) as ret_1d, round(ln(lead(close, {H}) over {W}) - ln(close), 9) as forward_return,
              ln(lead(close, {H}) over {W}) - ln(close) as fr from bars),
ds as (select symbol, date, (row_number() over {W} - 1)::int as pos, ret_1d, forward_return, case when fr > 0 then 1.0::double else 0.0::double end as direction, close
       from tt where ret_1d is not null and forward_return is not null),
sz as (select symbol, count(*)::int as n from ds group by symbol),
fi as (select symbol, n, unnest(range(0, 100))::int as i from sz),
fo as (select symbol, i as fold, 0 as train_start, 750 + 125 * i as train_end, 750 + {H} + 125 * i as test_start, least(750 + {H} + 125 * (i + 1), n)::int as test_end
       from fi where 750 + {H} + 125 * i < n and (i = 0 or 750 + {H} + 125 * i < n)),
mu as (select f.symbol, f.fold, avg(d.forward_return) as mean from fo f join ds d on d.symbol = f.symbol and d.pos >= f.train_start and d.pos < f.train_end group by 1, 2),
te as (select d.*, f.fold, mu.mean from fo f join ds d on d.symbol = f.symbol and d.pos >= f.test_start and d.pos < f.test_end join mu on mu.symbol = f.symbol and mu.fold = f.fold),
pr as (select symbol, 'zero' as model, fold, date, pos, 0.0::double as signal, forward_return, direction, close from te
       union all select symbol, 'train_mean', fold, date, pos, mean, forward_return, direction, close from te
       union all select symbol, 'momentum', fold, date, pos, ret_1d, forward_return, direction, close from te
       union all select symbol, 'reversion', fold, date, pos, -ret_1d, forward_return, direction, close from te)
"""


def predictions(spark, sf_dir):
    ds = light(spark, sf_dir)
    return wf.baseline_predictions(ds, wf.folds_of(ds, None, H))


@add("wf_01_fold_table", DS + "select symbol, fold, train_start, train_end, test_start, test_end from fo")
def fold_table(spark, sf_dir):
    return wf.folds_of(light(spark, sf_dir), None, H)


@add("wf_02_fold_count", DS + "select symbol, count(*)::bigint as n_folds from fo group by symbol")
def fold_count(spark, sf_dir):
    return wf.fold_count(wf.folds_of(light(spark, sf_dir), None, H))


def _model(name: str, key: str, sql_name: str | None = None):
    @add(key, DS + f"select symbol, fold, date, round(signal, 9) as signal from pr where model = '{name}'")
    def run(spark, sf_dir):
        return rounded(predictions(spark, sf_dir).where(F.col("model") == name).select("symbol", "fold", "date", "signal"), 9)


for _n, _k in (("zero", "mod_02_zero"), ("train_mean", "mod_03_train_mean"), ("momentum", "mod_04_momentum"), ("reversion", "mod_05_mean_reversion")):
    _model(_n, _k)


def corr_sql(a: str, b: str) -> str:
    return f"case when count({a}) >= 3 and stddev_pop({a}) >= 1e-12 and stddev_pop({b}) >= 1e-12 then covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) end"


def ranks_sql(src: str, keys: str, fields: dict[str, str]) -> str:
    return "select *, " + ", ".join(f"rank() over (partition by {keys} order by {v}) + (count(*) over (partition by {keys}, {v}) - 1) / 2.0 as {k}" for k, v in fields.items()) + f" from {src}"


REG = [
    ("n", "count(*)::double"),
    ("mae", "avg(abs(forward_return - signal))"),
    ("rmse", "sqrt(avg((forward_return - signal) * (forward_return - signal)))"),
    ("r2", "1 - sum((forward_return - signal) * (forward_return - signal)) / nullif(var_pop(forward_return) * count(*), 0)"),
    ("ic_pearson", corr_sql("forward_return", "signal")),
    ("ic_spearman", corr_sql("rt", "rp")),
    ("directional_accuracy", "avg(case when signal <> 0 then (sign(signal) = sign(forward_return))::int::double end)"),
]
CLS = [
    ("accuracy", "avg(((signal > 0) = (direction > 0))::int::double)"),
    ("precision", "coalesce(sum((signal > 0 and direction > 0)::int) / nullif(sum((signal > 0)::int), 0)::double, 0.0)"),
    ("recall", "coalesce(sum((signal > 0 and direction > 0)::int) / nullif(sum((direction > 0)::int), 0)::double, 0.0)"),
    ("f1", "coalesce(2.0::double * sum((signal > 0 and direction > 0)::int) / nullif(sum((signal > 0)::int) + sum((direction > 0)::int), 0), 0.0)"),
    ("roc_auc", "(sum(case when direction > 0 then rp end) - sum((direction > 0)::int) * (sum((direction > 0)::int) + 1) / 2.0) / nullif(sum((direction > 0)::int)::double * (count(*) - sum((direction > 0)::int)), 0)"),
    ("base_rate", "avg((direction > 0)::int::double)"),
]


def _cols(parts) -> str:
    return ", ".join(f"round({s}, 6) as {n}" for n, s in parts)


def _ranked(keys: str, src: str = "pr") -> str:
    return f", rk as ({ranks_sql(src, keys, {'rt': 'forward_return', 'rp': 'signal'})})"


K2, K3 = "symbol, model", "symbol, model, fold"


@add("agg_01_information_coefficient", DS + _ranked(K2) + f" select {K2}, round({corr_sql('forward_return', 'signal')}, 6) as pearson, round({corr_sql('rt', 'rp')}, 6) as spearman from rk group by {K2}")
def information_coefficient(spark, sf_dir):
    p = predictions(spark, sf_dir)
    p = p.withColumn("rt", average_rank("forward_return", wf.KEYS)).withColumn("rp", average_rank("signal", wf.KEYS))
    return rounded(p.groupBy(*wf.KEYS).agg(guarded_corr("forward_return", "signal").alias("pearson"), guarded_corr("rt", "rp").alias("spearman")))


@add("agg_02_regression_metrics", DS + _ranked(K2) + f" select {K2}, {_cols(REG)} from rk group by {K2}")
def regression(spark, sf_dir):
    return rounded(m.regression_metrics(predictions(spark, sf_dir), "forward_return", "signal", wf.KEYS))


@add("agg_03_classification_metrics", DS + _ranked(K2) + f" select {K2}, count(*)::double as n, {_cols(CLS)} from rk group by {K2}")
def classification(spark, sf_dir):
    return rounded(m.classification_metrics(predictions(spark, sf_dir), "direction", "signal", wf.KEYS))


@add("agg_17_fold_metrics", DS + _ranked(K3) + f" select {K3}, min(date) as test_start, max(date) as test_end, count(*)::bigint as test_size, {_cols(REG + CLS)} from rk group by {K3}")
def fold_metrics(spark, sf_dir):
    return rounded(wf.fold_metrics(predictions(spark, sf_dir)))


RATIO = f""", cal as (select {K2}, date, row_number() over (partition by {K2} order by date) - 1 as rn from (select distinct {K2}, date from pr)),
iv as (select {', '.join('p.' + k for k in K3.split(', '))}, min(rn) as a, max(rn) + {H} as b from pr p join cal c on p.symbol = c.symbol and p.model = c.model and p.date = c.date group by 1, 2, 3),
il as (select *, case when a > coalesce(max(b) over (partition by {K2} order by a, b rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as fresh from iv),
ig as (select *, sum(fresh) over (partition by {K2} order by a, b rows unbounded preceding) as g from il),
isl as (select {K2}, g, max(b) - min(a) as covered, sum(b - a) as width, count(*) as k from ig group by {K2}, g),
ratio as (select {K2}, sum(covered) * sum(k)::double / sum(width) as independent_folds from isl group by {K2})
"""
SUMMARY = RATIO + _ranked(K3) + f""", fm as (select {K3}, {corr_sql('forward_return', 'signal')} as ic from rk group by {K3}),
fs as (select {K2}, count(*)::double as n_folds, avg(ic) as mean, stddev_samp(ic) as sd, count(ic) as k, avg((ic > 0)::int::double) as pos from fm group by {K2}),
fz as (select fs.*, case when k > 0 then independent_folds * k / n_folds end as n_eff from fs join ratio using (symbol, model))
"""
FOLD_SUMMARY = "round(mean, 6) as ic_fold_mean, round(sd, 6) as ic_fold_std, round(n_eff, 6) as ic_fold_n_eff, round(case when sd > 1e-12 then mean / sd * sqrt(n_eff) end, 6) as ic_fold_t, round(case when sd > 1e-12 then mean / sd * sqrt(k) end, 6) as ic_fold_t_naive, round(pos, 6) as ic_fold_positive_rate"


@add("agg_18_interval_union_ratio", DS + RATIO + "select symbol, model, round(independent_folds, 6) as ratio from ratio")
def interval_union(spark, sf_dir):
    return rounded(wf.independent_folds(predictions(spark, sf_dir), H).withColumnRenamed("independent_folds", "ratio"))


@add("agg_19_independent_folds", DS + RATIO + "select symbol, model, round(independent_folds, 6) as independent_folds from ratio")
def independent_folds(spark, sf_dir):
    return rounded(wf.independent_folds(predictions(spark, sf_dir), H))


@add("agg_15_fold_summary", DS + SUMMARY + f"select symbol, model, n_folds, {FOLD_SUMMARY} from fz")
def fold_summary(spark, sf_dir):
    return rounded(wf.fold_summary(predictions(spark, sf_dir), H))


@add("agg_16_walk_forward_metrics", DS + SUMMARY + f", rq as ({ranks_sql('pr', K2, {'rt': 'forward_return', 'rp': 'signal'})}), wm as (select {K2}, {_cols(REG + CLS)} from rq group by {K2}) select wm.*, n_folds, {FOLD_SUMMARY} from wm join fz using (symbol, model)")
def walk_forward_metrics(spark, sf_dir):
    return rounded(wf.walk_forward_metrics(predictions(spark, sf_dir), H))


REGIME = f""", vr as (select symbol, date, close / lag(close) over {W} - 1 as r from bars),
vo as (select symbol, date, ({rolled('stddev_samp', 'r', 20)}) * {ANNUAL} as volatility from vr),
pv as (select p.*, v.volatility from pr p join vo v on p.symbol = v.symbol and p.date = v.date where v.volatility is not null),
ed as (select {K2}, quantile_cont(volatility, 1.0 / 3) as q1, quantile_cont(volatility, 2.0 / 3) as q2 from pv group by {K2}),
rb as (select pv.*, case when volatility <= q1 then 'low_vol' when volatility <= q2 then 'mid_vol' else 'high_vol' end as regime from pv join ed using (symbol, model))
"""


@add("agg_20_regime_metrics", DS + REGIME + f", rk as ({ranks_sql('rb', K2 + ', regime', {'rt': 'forward_return', 'rp': 'signal'})}) select {K2}, regime, {_cols(REG + CLS)}, round(avg(volatility), 6) as realised_vol_mean from rk group by {K2}, regime")
def regime_metrics(spark, sf_dir):
    return rounded(wf.regime_metrics(predictions(spark, sf_dir), wf.trailing_volatility(price_path(spark, sf_dir))))


@add("aux_08_regime_labels", DS + REGIME + "select regime, count(*)::bigint as n from rb group by regime")
def regime_labels(spark, sf_dir):
    rows = wf.pooled(predictions(spark, sf_dir)).join(wf.trailing_volatility(price_path(spark, sf_dir)), ["symbol", "date"]).where("volatility is not null")
    return m.quantile_bins(rows, "volatility", 3, wf.KEYS).withColumn("regime", wf.regime_labels()).groupBy("regime").agg(F.count("*").alias("n"))


OVERLAP = ", fo2 as (select symbol, i as fold, 750 + 60 * i as train_end, 755 + 60 * i as test_start, least(755 + 60 * i + 125, n) as test_end from fi where 755 + 60 * i < n and (i = 0 or 755 + 60 * (i - 1) + 125 < n)), pp as (select d.symbol, d.date, f.fold, d.ret_1d * (f.fold + 1) as signal from fo2 f join ds d on d.symbol = f.symbol and d.pos >= f.test_start and d.pos < f.test_end)"


@add("join_10_pooled_predictions", DS + OVERLAP + " select symbol, date, round(avg(signal), 10) as signal from pp group by symbol, date")
def pooled(spark, sf_dir):
    ds = light(spark, sf_dir)
    rows = wf.rows_of(ds, wf.folds_of(ds, WalkForwardConfig(step=60), H), "test").withColumn("model", F.lit("m")).withColumn("signal", F.col("ret_1d") * (F.col("fold") + 1))
    return rounded(wf.pooled(rows).select("symbol", "date", "signal"), 10)


RIDGE_SQL = DS + """, tr as (select d.*, f.fold from fo f join ds d on d.symbol = f.symbol and d.pos >= f.train_start and d.pos < f.train_end),
st as (select symbol, fold, avg(ret_1d) as mx, stddev_pop(ret_1d) as sx, avg(forward_return) as my, stddev_pop(forward_return) as sy, covar_pop(ret_1d, forward_return) as c, count(*) as n from tr group by 1, 2)
select t.symbol, t.fold, t.date, round(my + sy * ((t.ret_1d - mx) / sx) * (n * c / (sx * sy)) / (n + 50.0), 8) as signal from te t join st on t.symbol = st.symbol and t.fold = st.fold
"""


@add("wf_03_fit_one_fold", RIDGE_SQL)
def fit_one_fold(spark, sf_dir):
    ds = light(spark, sf_dir)
    return rounded(wf.fit_predict(ds, wf.folds_of(ds, None, H), "ridge", ["ret_1d"]).select("symbol", "fold", "date", "signal"), 8)


FULL = fea.feature_names()


def full_dataset(spark, sf_dir):
    return kept(fea.build_dataset(price_path(spark, sf_dir)), "dataset")


@add("wf_04_walk_forward_run")
def walk_forward(spark, sf_dir):
    ds = full_dataset(spark, sf_dir)
    return wf.walk_forward_metrics(kept(wf.fit_predict(ds, wf.folds_of(ds), "ridge", FULL), "predictions"), 1)


@add("mod_09_feature_importance")
def feature_importance(spark, sf_dir):
    ds = full_dataset(spark, sf_dir)
    return wf.importances(ds, wf.folds_of(ds), "ridge", FULL)


@add("agg_21_importance_stability")
def importance_stability(spark, sf_dir):
    return wf.importance_stability(feature_importance(spark, sf_dir))


@add("mod_06_estimators")
def estimators(spark, sf_dir):
    """Each estimator over all symbols and folds, with its default sizes."""
    ds = full_dataset(spark, sf_dir)
    folds = wf.folds_of(ds)
    out = None
    for name in mod.available_models()[4:]:
        one = wf.fit_predict(ds, folds, name, FULL)
        out = one if out is None else out.unionByName(one)
    return out


@add("mod_07_regressor_wrapper", RIDGE_SQL.replace("round(my + sy", "round(1.0 * (my + sy").replace("(n + 50.0), 8)", "(n + 50.0)), 8)"))
def regressor(spark, sf_dir):
    return fit_one_fold(spark, sf_dir)


@add("mod_08_classifier_wrapper")
def classifier(spark, sf_dir):
    ds = light(spark, sf_dir)
    rows = wf.fit_predict(ds, wf.folds_of(ds, None, H), "logistic", ["ret_1d"])
    return rows.withColumn("probability_up", mod.probability_of_up(F.col("signal")))


@add("aux_24_probability_up", DS + "select symbol, fold, date, round((signal + 1) / 2, 10) as probability_up from pr where model = 'momentum'")
def probability_up(spark, sf_dir):
    p = predictions(spark, sf_dir).where("model = 'momentum'")
    return rounded(p.select("symbol", "fold", "date", mod.probability_of_up(F.col("signal")).alias("probability_up")), 10)


@add("mod_12_available_models", "select * from (values " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(mod.available_models())) + ") t(position, model)")
def available(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(mod.available_models())), "position int, model string")


#: Ridge on one feature, by the error of the forecasts: the penalty shrinks the slope, so candidates differ.
ALPHAS = (0.1, 100.0, 1000.0, 100000.0)
TUNING = TuningConfig(grid={"alpha": ALPHAS}, metric="rmse", higher_is_better=False)
NAMES = ", ".join(f"({i}, {a!r}::double, 'alpha={a}')" for i, a in enumerate(ALPHAS))
TUNED = DS + f""",
ca as (select * from (values {NAMES}) c(candidate, alpha, params)),
sh as (select symbol, fold, train_end as n, greatest((train_end * 3 // 10) // 3, 1) as w from fo),
inn as (select symbol, fold, j, n - {H} - 3 * w + j * w as stop, w from sh, (select unnest(range(0, 3))::int as j) where n - {H} - 3 * w >= greatest(w, 60)),
ist as (select i.symbol, i.fold, j, avg(ret_1d) as mx, stddev_pop(ret_1d) as sx, avg(forward_return) as my, stddev_pop(forward_return) as sy, covar_pop(ret_1d, forward_return) as c, count(*) as n
        from inn i join ds d on d.symbol = i.symbol and d.pos < i.stop group by 1, 2, 3),
ier as (select i.symbol, i.fold, i.j, candidate, sqrt(avg(pow(d.forward_return - (my + sy * ((d.ret_1d - mx) / sx) * (n * c / (sx * sy)) / (n + alpha)), 2))) as rmse
        from inn i join ist s on s.symbol = i.symbol and s.fold = i.fold and s.j = i.j join ds d on d.symbol = i.symbol and d.pos >= i.stop + {H} and d.pos < i.stop + {H} + i.w, ca group by 1, 2, 3, 4),
sco as (select symbol, fold, candidate, avg(rmse) as score from ier group by 1, 2, 3),
rec as (select *, row_number() over (partition by symbol, fold order by score, candidate) = 1 as chosen from sco join ca using (candidate))
"""


def records(spark, sf_dir):
    ds = light(spark, sf_dir)
    return wf.select_params(ds, wf.folds_of(ds, None, H), "ridge", ["ret_1d"], TUNING, H)


@add("wf_05_candidate_scores", TUNED + "select symbol, fold, candidate, round(score, 9) as score from rec")
def candidate_scores(spark, sf_dir):
    ds = light(spark, sf_dir)
    return rounded(wf.candidate_scores(ds, wf.folds_of(ds, None, H), "ridge", ["ret_1d"], TUNING, H), 9)


@add("wf_06_selected_candidates", TUNED + "select symbol, fold, candidate, params from rec where chosen")
def selected(spark, sf_dir):
    return records(spark, sf_dir).where("chosen").select("symbol", "fold", "candidate", "params")


@add("agg_25_selection_scores", TUNED + "select symbol, fold, candidate, params, round(score, 9) as score, chosen from rec")
def selection_scores(spark, sf_dir):
    return rounded(records(spark, sf_dir), 9)


@add("wf_04b_tuned_run", TUNED + """, tr as (select d.*, f.fold from fo f join ds d on d.symbol = f.symbol and d.pos >= f.train_start and d.pos < f.train_end),
st as (select symbol, fold, avg(ret_1d) as mx, stddev_pop(ret_1d) as sx, avg(forward_return) as my, stddev_pop(forward_return) as sy, covar_pop(ret_1d, forward_return) as c, count(*) as n from tr group by 1, 2)
select t.symbol, t.fold, t.date, round(my + sy * ((t.ret_1d - mx) / sx) * (n * c / (sx * sy)) / (n + coalesce(r.alpha, 50.0)), 8) as signal
from te t join st on t.symbol = st.symbol and t.fold = st.fold left join (select * from rec where chosen) r on r.symbol = t.symbol and r.fold = t.fold""")
def tuned_run(spark, sf_dir):
    ds = light(spark, sf_dir)
    predictions, _ = wf.tuned_predictions(ds, wf.folds_of(ds, None, H), "ridge", ["ret_1d"], TUNING, H)
    return rounded(predictions.select("symbol", "fold", "date", "signal"), 8)


#: A stand-in for selection records that SQL can build too: scores from fold and candidate.
REC = DS + ", rec as (select symbol, fold, c::int as candidate, case when (fold + c) % 4 = 3 then null else round(((fold * 7 + c * 3) % 11) / 10.0::double, 6) end as score from fo, (select unnest(range(0, 4)) as c)), best as (select *, row_number() over (partition by symbol, fold order by score desc nulls last, candidate) = 1 as chosen from rec)"


def fake_records(spark, sf_dir):
    folds = wf.folds_of(light(spark, sf_dir), None, H)
    rows = folds.select("symbol", "fold", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("candidate"))
    score = F.when((F.col("fold") + F.col("candidate")) % 4 == 3, None).otherwise(F.round(((F.col("fold") * 7 + F.col("candidate") * 3) % 11) / 10.0, 6))
    rows = rows.withColumn("score", score)
    return wf.choose(rows).withColumn("params", F.concat(F.lit("alpha="), F.col("candidate").cast("string")))


@add("wf_08_better_rule", REC + " select symbol, fold, candidate, score from best where chosen")
def better(spark, sf_dir):
    return fake_records(spark, sf_dir).where("chosen").select("symbol", "fold", "candidate", "score")


@add("agg_24_selected_params", REC + " select symbol, fold, 'alpha' as parameter, candidate::varchar as value from best where chosen")
def selected_params(spark, sf_dir):
    return wf.selected_params(fake_records(spark, sf_dir))


@add("agg_22_selection_stability", REC + ", cn as (select symbol, candidate::varchar as value, count(*) as k from best where chosen group by 1, 2) select symbol, 'alpha' as parameter, count(*)::bigint as n_distinct, min_by(value, (-k, value)) as modal_value, round(max(k) / sum(k)::double, 6) as modal_share from cn group by symbol")
def selection_stability(spark, sf_dir):
    return rounded(wf.selection_stability(wf.selected_params(fake_records(spark, sf_dir))))


@add("agg_23_selection_spread", REC + ", g as (select symbol, fold, max(score) - min(score) as gap from rec where score is not null group by 1, 2 having count(*) >= 2) select symbol, round(avg(gap), 6) as spread from g group by symbol")
def selection_spread(spark, sf_dir):
    return rounded(wf.selection_spread(fake_records(spark, sf_dir)))


SIZES = (300, 750, 1500, 20)


@add("wf_07_inner_schedule", "select n_train, case when n_train - 5 >= 6 and n_train - 5 - 3 * t >= greatest(t, 60) then n_train - 5 - 3 * t end as train_size, case when n_train - 5 >= 6 and n_train - 5 - 3 * t >= greatest(t, 60) then t end as test_size from (select n_train, greatest(1, (n_train * 3 // 10) // 3)::int as t from (values (300), (750), (1500), (20)) v(n_train))")
def schedule(spark, sf_dir):
    first, window = wf.inner_schedule("n_train", 5, TuningConfig())
    return spark.createDataFrame([(n,) for n in SIZES], "n_train int").select("n_train", first.alias("train_size"), window.alias("test_size"))


@add("mod_10_registry_lookup", "select * from (values ('ridge', 'found'), ('no_such_model', 'ValueError')) t(model, outcome)")
def lookup(spark, sf_dir):
    out = []
    for name in ("ridge", "no_such_model"):
        try:
            mod.create_model(name)
            out.append((name, "found"))
        except ValueError:
            out.append((name, "ValueError"))
    return spark.createDataFrame(out, "model string, outcome string")


class DoubleMomentum(mod.Model):
    """A model of one's own, for mod_11."""

    def fit(self, x, y, names):
        self.check(x, y)
        return self

    def predict(self, x):
        return 2 * x[:, 0]


@add("mod_11_registered_model", DS + "select symbol, fold, date, round(2 * ret_1d, 9) as signal from te")
def registered(spark, sf_dir):
    """A registered model in the walk-forward: its factory travels to the workers."""
    mod.register_model("double_momentum_of_query", DoubleMomentum, overwrite=True)
    try:
        ds = light(spark, sf_dir)
        return rounded(wf.fit_predict(ds, wf.folds_of(ds, None, H), "double_momentum_of_query", ["ret_1d"]).select("symbol", "fold", "date", "signal"), 9)
    finally:
        mod.unregister_model("double_momentum_of_query")


@add("mod_01_model_interface", "select * from (values " + ", ".join(f"('{n}', {str(c).lower()}, '{u}')" for n, c, u in (("zero", False, "return"), ("train_mean", False, "return"), ("momentum", False, "return"), ("reversion", False, "return"), ("ridge", False, "return"), ("logistic", True, "probability"))) + ") t(model, is_classifier, signal_units)")
def interface(spark, sf_dir):
    made = [(n, mod.create_model(n)) for n in ("zero", "train_mean", "momentum", "reversion", "ridge", "logistic")]
    return spark.createDataFrame([(n, bool(x.is_classifier), x.signal_units) for n, x in made], "model string, is_classifier boolean, signal_units string")


@add("aux_23_fit_input_guard", "select * from (values ('no rows', 'ValueError'), ('missing label', 'ValueError'), ('uneven', 'ValueError'), ('fine', 'fitted')) t(\"case\", outcome)")
def fit_guard(spark, sf_dir):
    import numpy as np

    cases = {"no rows": (np.zeros((0, 1)), np.zeros(0)), "missing label": (np.ones((2, 1)), np.array([1.0, np.nan])), "uneven": (np.ones((3, 1)), np.ones(2)), "fine": (np.ones((3, 1)), np.ones(3))}
    out = []
    for name, (x, y) in cases.items():
        try:
            mod.create_model("train_mean").fit(x, y, ["a"])
            out.append((name, "fitted"))
        except ValueError:
            out.append((name, "ValueError"))
    return spark.createDataFrame(out, "case string, outcome string")


@add("aux_01_walk_forward_defaults", "select * from (values ('embargo', 5), ('embargo given', 2), ('step', 125), ('step given', 60), ('min_train', 750), ('min_train given', 300)) t(setting, resolved)")
def defaults(spark, sf_dir):
    c, given = WalkForwardConfig(), WalkForwardConfig(step=60, embargo=2, min_train_size=300)
    rows = [("embargo", c.resolved_embargo(H)), ("embargo given", given.resolved_embargo(H)), ("step", c.resolved_step()), ("step given", given.resolved_step()), ("min_train", c.resolved_min_train_size()), ("min_train given", given.resolved_min_train_size())]
    return spark.createDataFrame(rows, "setting string, resolved int")


@add("aux_06_tuning_enabled", "select * from (values ('no grid', false, 1), ('one value', false, 1), ('two values', true, 2), ('two by three', true, 6)) t(grid, enabled, candidates)")
def tuning_enabled(spark, sf_dir):
    grids = {"no grid": {}, "one value": {"alpha": (1.0,)}, "two values": {"alpha": (1.0, 2.0)}, "two by three": {"a": (1, 2), "b": (1, 2, 3)}}
    return spark.createDataFrame([(k, TuningConfig(grid=g).enabled, len(TuningConfig(grid=g).candidates())) for k, g in grids.items()], "grid string, enabled boolean, candidates int")


@add("fn_13_describe_params", "select * from (values (0, 'alpha=1.0, kind=' || chr(39) || 'a' || chr(39)), (1, 'defaults'), (2, 'n=3')) t(i, label)")
def described(spark, sf_dir):
    from plumbline.config import describe_params

    return spark.createDataFrame([(i, describe_params(p)) for i, p in enumerate(({"alpha": 1.0, "kind": "a"}, {}, {"n": 3}))], "i int, label string")


@add("agg_21b_ridge_importance", RIDGE_SQL.split("select t.symbol")[0] + "select symbol, 'ret_1d' as feature, round(avg(b), 8) as mean, round(stddev_samp(b), 8) as std from (select symbol, fold, (n * c / (sx * sy)) / (n + 50.0) as b from st) group by symbol")
def ridge_importance(spark, sf_dir):
    ds = light(spark, sf_dir)
    return rounded(wf.importance_stability(wf.importances(ds, wf.folds_of(ds, None, H), "ridge", ["ret_1d"])).drop("cv"), 8)

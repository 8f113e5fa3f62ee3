"""Hand-computed values, invariants and degenerate inputs."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import config as cfg
from plumbline.functions import core
from plumbline.functions import indicators as ind
from plumbline.operators import backtest as bt
from plumbline.operators import features as fea
from plumbline.operators import journal as jr
from plumbline.operators import metrics as m
from plumbline.operators import models as mod
from plumbline.operators import portfolio as pf
from plumbline.operators import reporting as rep
from plumbline.operators import simulation as sim
from plumbline.operators import walkforward as wf
from plumbline.plans import studies
from plumbline.sources import ingest, synthetic

BARS = "symbol string, date date, open double, high double, low double, close double, volume double"


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def bars(spark, closes, symbol="X"):
    return spark.createDataFrame([(symbol, day(i), c, c * 1.01, c * 0.99, c, 1000.0) for i, c in enumerate(closes)], BARS)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def values(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def market(spark, days=700, **options):
    return synthetic.generate_ohlcv(spark, cfg.SyntheticConfig(n_days=days, **options))


def test_log_return(spark):
    got = values(bars(spark, [100.0, 110.0, 121.0]).withColumn("v", ind.log_return()), "v")
    assert got[0] is None and got[1] == pytest.approx(0.09531, abs=1e-5) and got[2] == pytest.approx(got[1])
    with pytest.raises(ValueError):
        ind.log_return("close", 0)


def test_sma_waits_for_its_window(spark):
    got = values(bars(spark, [10.0, 11.0, 12.0, 11.0, 13.0, 14.0, 13.5, 15.0]).withColumn("v", ind.sma("close", 3)), "v")
    assert got[:2] == [None, None] and got[2] == pytest.approx(11) and got[-1] == pytest.approx((14 + 13.5 + 15) / 3)


def test_flat_prices(spark):
    b = fea.base_columns(spark.createDataFrame([("X", day(i), 50.0, 50.0, 50.0, 50.0, 1000.0) for i in range(60)], BARS))
    r = b.select("date", ind.rsi("__change").alias("rsi"), ind.stochastic_k().alias("k"), ind.donchian_position().alias("d"), ind.bollinger()["bb_percent_b"].alias("b")).orderBy(F.desc("date")).first()
    assert (r["rsi"], r["k"], r["d"], r["b"]) == (50.0, 50.0, 0.5, None)


def test_ema_equals_recursion(spark):
    x = np.random.default_rng(0).uniform(50, 60, 40)
    e = [x[0]]
    for v in x[1:]:
        e.append(e[-1] * (1 - 2 / 6) + v * 2 / 6)
    got = values(bars(spark, [float(v) for v in x]).withColumn("v", ind.ema("close", 5)), "v")
    assert got[:4] == [None] * 4 and got[4:] == pytest.approx(e[4:])


def test_features_do_not_look_ahead(spark):
    b = market(spark, 260)
    cut = sorted(r["date"] for r in b.select("date").collect())[200]
    whole = {r["date"]: r for r in fea.build_features(b).where(F.col("date") <= cut).collect()}
    part = fea.build_features(b.where(F.col("date") <= cut)).collect()
    for r in part:
        for n in fea.feature_names():
            a, c = r[n], whole[r["date"]][n]
            assert (a is None and c is None) or a == pytest.approx(c, rel=1e-9, abs=1e-12)
    assert len(fea.feature_names()) == 29


def test_positions_lag_and_costs(spark):
    rows = bars(spark, [100.0, 110.0, 99.0, 108.9]).select("symbol", "date", "close", F.lit(1.0).alias("signal"))
    got = bt.run_backtest(rows, cfg.BacktestConfig(cost_bps=5, slippage_bps=5)).orderBy("date").collect()
    assert [r["position"] for r in got] == [0, 1, 1, 1]
    assert [r["cost"] for r in got] == pytest.approx([0, 0.001, 0, 0])
    assert got[1]["strategy_return"] == pytest.approx(0.1 - 0.001) and got[0]["benchmark_return"] == pytest.approx(-0.001)
    assert got[-1]["equity"] == pytest.approx(1e5 * 1.099 * 0.9 * 1.1)


def test_null_volatility_target_is_flat(spark):
    c = cfg.BacktestConfig(vol_target=0.1)
    assert one(spark, bt.target_position(F.lit(1.0), c, F.lit(None).cast("double"))) == 0.0
    with pytest.raises(ValueError):
        bt.target_position(F.lit(1.0), c)


@pytest.mark.parametrize("x", [-8.0, -3.1, -1.0, 0.0, 0.3, 2.4, 2.6, 5.0])
def test_normal_distribution(spark, x):
    assert one(spark, core.normal_cdf(F.lit(x))) == pytest.approx(0.5 * math.erfc(-x / 2**0.5), abs=1e-11)
    p = 0.5 * math.erfc(-x / 2**0.5)
    if 1e-9 < p < 1 - 1e-9:
        assert one(spark, core.normal_ppf(F.lit(p))) == pytest.approx(x, abs=1e-6)


def test_small_numbers(spark):
    assert one(spark, m.expected_max_sharpe(F.lit(100), F.lit(0.1))) == pytest.approx(0.2531, abs=1e-4)
    assert one(spark, core.fisher_z(F.lit(0.5), F.lit(0.0), F.lit(28))) == pytest.approx(2.7465, abs=1e-4)
    assert m.bonferroni_threshold(10) == pytest.approx(0.005) and m.expected_false_positives(20) == pytest.approx(1.0)
    first, window = wf.inner_schedule("n", 5, cfg.TuningConfig())
    assert [tuple(r) for r in spark.createDataFrame([(750,), (40,), (5,)], "n int").select(first, window).collect()] == [(520, 75), (None, None), (None, None)]
    assert [one(spark, core.horizon_label(F.lit(d))) for d in (504, 42, 10, 7)] == ["2y", "2mo", "2w", "7d"]
    assert one(spark, core.format_value(F.lit(None).cast("double"))) == "n/a"


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.9, None])], "i int, p_value double")
    assert values(m.benjamini_hochberg(rows), "q_value", "i") == pytest.approx([0.04, 0.04, 0.04, 0.9, None])
    with pytest.raises(Exception, match="between 0 and 1"):
        m.benjamini_hochberg(rows.withColumn("p_value", F.lit(2.0))).collect()


def test_covered_ratio(spark):
    apart = spark.createDataFrame([(0, 0, 10), (0, 10, 20), (0, 20, 30)], "k int, a int, b int")
    assert m.covered_ratio(apart, "a", "b", ["k"]).first()["ratio"] == pytest.approx(3.0)


def test_metrics_without_spread_are_null(spark):
    rows = bt.run_backtest(bars(spark, [100.0] * 12).select("symbol", "date", "close", F.lit(0.0).alias("signal")))
    r = m.financial_metrics(rows, "strategy_return", "equity", "position").first()
    assert r["sharpe"] is None and r["profit_factor"] is None and r["total_return"] == 0 and r["calmar"] is None


def test_fold_table(spark):
    c = cfg.WalkForwardConfig(train_size=10, test_size=4)
    sizes = spark.createDataFrame([("a", 20), ("b", 12)], "symbol string, n int")
    got = [tuple(r) for r in wf.fold_table(sizes, c).orderBy("symbol", "fold").collect()]
    assert got == [("a", 0, 0, 10, 11, 15), ("a", 1, 0, 14, 15, 19), ("a", 2, 0, 18, 19, 20), ("b", 0, 0, 10, 11, 12)]
    with pytest.raises(Exception, match="needs 12 bars"):
        wf.fold_table(spark.createDataFrame([("c", 11)], "symbol string, n int"), c).collect()


@pytest.mark.parametrize("name", mod.available_models())
def test_models_fit_and_predict(name):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = x[:, 0] + 0.1 * rng.normal(size=300)
    small = {"random_forest": {"n_estimators": 10}, "random_forest_classifier": {"n_estimators": 10}, "gradient_boosting": {"max_iter": 30}, "gradient_boosting_classifier": {"max_iter": 30}}
    e = mod.create_model(name, **small.get(name, {}))
    p = e.fit(x, (y > 0).astype(float) if e.is_classifier else y, ["ret_1d", "b", "c", "d"]).predict(x)
    assert p.shape == (300,) and np.isfinite(p).all()
    if name not in ("zero", "train_mean", "reversion"):
        assert np.corrcoef(p, y)[0, 1] > 0.6
    if e.is_classifier:
        assert np.abs(p).max() <= 1


def test_registry():
    with pytest.raises(ValueError):
        mod.create_model("nothing")
    with pytest.raises(ValueError):
        mod.register_model("ridge", mod.Ridge)
    mod.register_model("mine", mod.Zero, overwrite=True)
    assert "mine" in mod.available_models()
    del mod._REGISTRY["mine"]


def test_equal_sleeves_have_the_closed_form(spark):
    rng = np.random.default_rng(0)
    common = rng.normal(0, 0.01, 500)
    rows = [(day(i), s, float(0.6**0.5 * common[i] + 0.4**0.5 * rng.normal(0, 0.01))) for s in "abcd" for i in range(500)]
    s = spark.createDataFrame(rows, "date date, symbol string, ret double")
    bets = pf.diversification(pf.covariance(s), pf.sleeve_weights(s)).first()["effective_bets"]
    assert bets == pytest.approx(4 / (1 + 3 * 0.6), rel=0.15)
    assert pf.risk_contributions(pf.covariance(s), pf.sleeve_weights(s)).agg(F.sum("risk_contribution")).first()[0] == pytest.approx(1)


def test_weekly_compounding(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=7 * w + d), "a", 0.01) for w in range(2) for d in range(5)]
    got = pf.weekly(spark.createDataFrame(rows, "date date, symbol string, ret double")).collect()
    assert [r["ret"] for r in got] == pytest.approx([1.01**5 - 1] * 2)


JOURNAL = "asof_date date, symbol string, model string, horizon int, signal double, position double, close double"


def test_blocks_follow_sessions_not_rows(spark):
    b = bars(spark, [100.0 + i for i in range(30)])
    j = spark.createDataFrame([(day(2), "X", "m", 5, 1.0, 1.0, 102.0), (day(11), "X", "m", 5, 1.0, 1.0, 111.0)], JOURNAL)
    scored = jr.score(j, b)
    assert jr.independent_blocks(jr.scored_rows(scored), jr.trading_calendar(b)).first()[0] == 2
    assert [r["sessions_held"] for r in scored.orderBy("asof_date").collect()] == [1.0, 9.0]


def test_pending_until_the_horizon_has_elapsed(spark):
    b = bars(spark, [100.0 + i for i in range(10)])
    j = spark.createDataFrame([(day(d), "X", "m", 5, 1.0, 1.0, 0.0) for d in (4, 5, 20)], JOURNAL)
    s = jr.score(j, b)
    assert jr.scored_rows(s).count() == 1 and jr.pending_rows(s).count() == 2


def test_append_twice_changes_nothing(spark):
    j = spark.createDataFrame([(day(1), "X", "m", 5, 1.0, 1.0, 0.0)], JOURNAL)
    again = jr.append(jr.append(j.limit(0), j), j)
    assert again.count() == 1 and jr.is_append_only(j, again) and not jr.is_append_only(again, j.limit(0))


def test_freshness(spark):
    b = bars(spark, [1.0]).withColumn("date", F.lit("2026-01-06").cast("date"))
    r = jr.data_freshness(b, "2026-01-13").first()
    assert (r["age_days"], r["missed_sessions"], r["stale"]) == (7, 4, True)


def test_sessions(spark):
    rows = spark.createDataFrame([("2337.TW", dt.date(2026, 10, 1)), ("MU", dt.date(2026, 10, 2)), ("A.ZZ", dt.date(2026, 10, 2))], "symbol string, date date")
    got = {r["symbol"]: r["c"] for r in rows.select("symbol", ingest.next_session_close("symbol", "date").cast("string").alias("c")).collect()}
    assert got == {"2337.TW": "2026-10-02 05:30:00", "MU": "2026-10-05 20:00:00", "A.ZZ": None}


def test_contract(spark):
    good = bars(spark, [10.0, 11.0])
    assert ingest.validate(good).count() == 2
    for bad, text in ((good.withColumn("close", F.lit(-1.0)), "positive"), (good.union(good), "duplicate"), (good.drop("volume"), "missing"), (good.limit(0), "no bars"), (good.withColumn("high", F.lit(1.0)), "high below body")):
        with pytest.raises(ValueError, match=text):
            ingest.validate(bad)
    with pytest.raises(ValueError, match="misses"):
        ingest.clamp_extremes(good.withColumn("high", F.lit(1.0)))
    with pytest.raises(ValueError, match="no price"):
        ingest.drop_untraded(good.withColumn("open", F.lit(None).cast("double")))


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Open,High,Low,Close,Adj Close,Vol\n2024-01-02,1,2,0.5,1.5,1.4,10\n2024-01-03,1.5,2,1,1.2,1.1,20\n")
    got = ingest.load_universe(spark, str(tmp_path))
    assert {"symbol", "date", "adj_close", "volume"} <= set(got.columns) and got.first()["symbol"] == "AAA" and got.count() == 2
    ingest.save_csv(got, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_vendor_data_source(spark):
    rows = [(dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 5.0)]
    spark.dataSource.register(ingest.vendor_source(lambda ticker: rows))
    got = spark.read.format("vendor_bars").option("tickers", "AAA, BBB").load().collect()
    assert sorted(r["symbol"] for r in got) == ["AAA", "BBB"]
    tries = []

    def flaky(t):
        tries.append(t)
        raise OSError("down")

    with pytest.raises(OSError):
        ingest.fetch_with_retry(flaky, "AAA", 2)
    assert len(tries) == 3 and ingest.fetch_all(flaky, ["AAA"], skip_errors=True) == (None, {"AAA": "down"})


def test_planted_edge_is_found_and_none_invented(spark):
    market_ = synthetic.generate_market(spark, cfg.SyntheticConfig(n_days=2000, ar1=0.5, reversion=0.0))
    assert synthetic.theoretical_ic(market_).first()["ic"] > 0.2
    b = market_.select("symbol", "date", "close", F.lit(0.0).alias("open"))
    r = b.select("symbol", "date", "close", F.coalesce(F.log("close") - F.log(F.lag("close").over(core.by_symbol())), F.lit(0.0)).alias("signal"))
    p = sim.significance(sim.null_distribution(r, list(range(11, 400, 13)))).first()
    assert p["p_value"] < 0.1
    flat = sim.significance(sim.null_distribution(r.withColumn("signal", F.sin(F.hash("date").cast("double"))), list(range(11, 400, 13)))).first()
    assert 0 < flat["p_value"] <= 1


def test_screen_isolates_short_symbols(spark):
    b = bars(spark, [100 + math.sin(i) for i in range(60)], "A").union(bars(spark, [100.0, 101.0], "B"))
    s = b.select("symbol", "date", "close", F.lit(1.0).alias("signal"))
    got = {r["symbol"]: r for r in studies.screen(s, [3, 5, 7]).collect()}
    assert got["B"]["error"] == "too few bars" and got["B"]["rank"] == 2 and got["A"]["q_value"] is not None


def test_rendering():
    t = rep.markdown_table(["a", "b"], [[1, "x"]])
    assert t.splitlines() == ["| a | b |", "|---|---|", "| 1 | x |"] and len(rep.sparkline(range(100), 10)) == 10 and rep.sparkline([1, 2, 3, 4], 4) == "▁▃▆█"
    assert rep.number(float("nan")) == "n/a" and rep.number(1234.5) == "1,234.5" and rep.number(0.5, percent=True) == "50.00%"
    assert "+" in rep.bar_chart(["x"], [1.0]) and "#" in rep.line_chart({"a": [1, 2, 3]}) and rep.line_chart({"a": []}) == "_no data_"
    drawn = rep.histogram_chart([1, 1, 2, 3, None], 2, 10, marker=9).splitlines()
    assert [x.count("#") for x in drawn] == [10, 10, 0] and "<== observed (9.0000)" in drawn[1] and drawn[2].endswith("above the null range")
    with pytest.raises(ValueError):
        rep.bar_chart(["a"], [])
    assert rep.Report("T").heading("H").bullets(["b"]).code("c").render().startswith("# T")
    assert "metric" in rep.metrics_table({"run": {"sharpe": 1.0}}) and rep.signed_percent(None) == "—"


def test_config_checks():
    for make in (lambda: cfg.BacktestConfig(sizing="x"), lambda: cfg.WalkForwardConfig(train_size=0), lambda: cfg.SimulationConfig(method="x"), lambda: cfg.SyntheticConfig(garch_alpha=0.9), lambda: cfg.expand_grid({"a": ()})):
        with pytest.raises(ValueError):
            make()
    assert cfg.expand_grid({}) == [{}] and cfg.ExperimentConfig().with_horizon(5).features.horizon == 5
    t = cfg.TuningConfig(grid={"a": (1, 2)})
    assert t.enabled and t.higher_is_better and cfg.TuningConfig().min_inner_train == 60
    assert cfg.describe_params({"a": "x", "b": 1}) == "a='x', b=1" and cfg.describe_params({}) == "defaults"


@pytest.mark.parametrize("argv, code", [(["models"], 0), (["data"], 2), (["watch", "--days", "400"], 0), (["compare", "--days", "620", "--train-size", "400", "--models", "zero,momentum"], 0), (["backtest", "--days", "620", "--train-size", "400"], 0)])
def test_command_line(spark, tmp_path, capsys, argv, code):
    from plumbline.cli import main

    assert main([*argv, *(["--out", str(tmp_path / "o")] if argv[0] not in ("data", "models") else [])], spark) == code
    assert capsys.readouterr()


def test_journal_command_alarms_on_stale_prices(spark, tmp_path):
    from plumbline.cli import main

    argv = ["journal", "--days", "620", "--train-size", "400", "--journal", str(tmp_path / "j"), "--asof", "2010-01-01"]
    assert main(argv, spark) in (0, 3)
    first = spark.read.parquet(str(tmp_path / "j")).count()
    assert main([*argv[:-1], "2030-01-01"], spark) == 3
    assert spark.read.parquet(str(tmp_path / "j")).count() >= first


def test_stream_of_bars(spark, tmp_path):
    from plumbline.streaming import bars as sb

    rows = [(i, dt.datetime(2024, 1, 1, h, 5 * (i % 10)), 1, "click", float(i + 1), "{}") for h in range(6) for i in range(10)]
    spark.createDataFrame(rows, sb.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sb.hourly_bars(sb.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("bars_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from bars_out order by hour").collect()
    assert got and got[0]["volume"] == 10 and got[0]["high"] == 10
    sink = sb.append_forecasts(str(tmp_path / "j"))
    j = spark.createDataFrame([(day(1), "X", "m", 5, 1.0, 1.0, 0.0)], JOURNAL)
    sink(j, 0)
    sink(j, 0)
    assert spark.read.parquet(str(tmp_path / "j")).count() == 1


@pytest.mark.parametrize("higher, want", [(True, [(0, 1), (2, 0)]), (False, [(0, 0), (2, 0)])])
def test_choices_ignore_what_is_not_finite(spark, higher, want):
    """Fold 0: two finite scores; fold 1: none; fold 2: a tie, which the first wins."""
    rows = [("A", 0, 0, 0.1), ("A", 0, 1, 0.2), ("A", 0, 2, float("inf")), ("A", 1, 0, None), ("A", 1, 1, float("nan")), ("A", 2, 0, 0.5), ("A", 2, 1, 0.5)]
    got = wf.choose(spark.createDataFrame(rows, "symbol string, fold int, candidate int, score double"), higher).where("chosen").collect()
    assert sorted((r["fold"], r["candidate"]) for r in got) == want


def walk(spark, n=220):
    rows = [("A", day(1) + dt.timedelta(days=i), i, math.sin(i * 1.7), 0.5 * math.sin(i * 1.7) + 0.1 * math.sin(i * 0.9), float(math.sin(i * 1.7) > 0), 100.0) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, date date, pos int, x double, forward_return double, direction double, close double")


def slope():
    """A factory that only this test knows: it must travel to the workers. Forecasts k times the first feature; k = 0 is refused."""

    class Slope(mod.Model):
        def __init__(self, k=1.0):
            if k == 0:
                raise ValueError("k must not be zero")
            self.k = k

        def fit(self, x, y, names):
            self.check(x, y)
            return self

        def predict(self, x):
            return self.k * x[:, 0]

    return Slope


@pytest.mark.parametrize("metric, higher, k", [("rmse", False, 0.5), ("mae", False, 0.5), ("ic_pearson", True, 0.5), ("no_such_metric", True, 1.0)])
def test_folds_are_fitted_with_their_own_choice(spark, metric, higher, k):
    """Any metric may choose; a refused candidate never wins; without a choice the defaults stay."""
    ds, names = walk(spark), ["x"]
    folds = wf.folds_of(ds, cfg.WalkForwardConfig(train_size=120, test_size=40), 1)
    tuning = cfg.TuningConfig(grid={"k": (0, -1.0, 0.5, 2.0)}, metric=metric, higher_is_better=higher, min_inner_train=30)
    predictions, records = wf.tuned_predictions(ds, folds, slope(), names, tuning)
    chosen = records.where("chosen").collect()
    assert len(chosen) == (0 if metric == "no_such_metric" else folds.count()) and all(r["params"] == f"k={k}" for r in chosen)
    got = predictions.join(ds.select("pos", "x"), "pos").selectExpr(f"max(abs(signal - x * {k}D)) as off", "count(*) as n").first()
    assert got["off"] < 1e-12 and got["n"] == 99


def test_a_universe_of_files_folders_and_tickers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,10,12,9,11,5\n")
    (tmp_path / "in" / "B.csv").write_text("Date,Close,Open,Low,High,Volume,Note\n2024-01-02,11,10,9,12,5,split of 2:1\n")
    (tmp_path / "C.csv").write_text("timestamp,o,h,l,c,v\n2024-01-02,10,12,9,11,5\n")
    tries = []

    def fetch(ticker):
        tries.append(ticker)
        if ticker == "GONE":
            raise ConnectionError("no such ticker")
        return bars(spark, [10.0, 11.0], ticker)

    paths = [str(tmp_path / "in"), str(tmp_path / "C.csv")]
    for _ in range(2):
        got = ingest.load_universe(spark, paths, ["T", "GONE"], fetch, str(tmp_path / "cache"), skip_errors=True)
        rows = {r["symbol"]: r for r in got.where("symbol <> 'T'").collect()}
        assert {tuple(r[c] for c in ("open", "high", "low", "close")) for r in rows.values()} == {(10.0, 12.0, 9.0, 11.0)} and set(rows) == {"A", "B", "C"}
        assert rows["B"]["note"] == "split of 2:1" and got.where("symbol = 'T'").count() == 2
    assert tries == ["T", "GONE", "GONE"]
    for bad in (lambda: ingest.load_universe(spark), lambda: ingest.load_universe(spark, paths + paths), lambda: ingest.load_universe(spark, paths, ["A"], fetch)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ConnectionError):
        ingest.load_universe(spark, None, ["GONE"], fetch)


def test_windows_of_one_bar(spark):
    got = bars(spark, [1.0, 3.0, 2.0]).select(ind.ema("close", 1).alias("e"), ind.wilder("close", 1).alias("w"), "close").collect()
    assert all(r["e"] == r["w"] == r["close"] for r in got)
    with pytest.raises(ValueError):
        ind.ema("close", 0)


def test_daily_loop(spark, tmp_path):
    from plumbline.cli import main

    market_ = synthetic.generate_ohlcv(spark, cfg.SyntheticConfig(n_days=620), ("AAA", "BBB")).cache()

    def fetch(ticker):
        if ticker == "GONE":
            raise ConnectionError("no such ticker")
        return market_.where(F.col("symbol") == ticker).drop("symbol")

    argv = ["daily", "--tickers", "AAA,GONE", "--cache-dir", str(tmp_path / "c"), "--journal", str(tmp_path / "j"), "--train-size", "400", "--no-compare", "--quiet", "--fail-if-stale", "100000"]
    assert main([*argv, "--asof", "2012-06-01"], spark, fetch) == 4
    assert spark.read.parquet(str(tmp_path / "j")).count() <= 1
    assert main(["daily", "--tickers", "AAA", "--journal", str(tmp_path / "j"), "--quiet"], spark) == 2

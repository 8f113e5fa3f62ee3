"""SIM queries. Draws are MD5 hashes of seed, symbol, path and block, so SQL can draw them too."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.config import SimulationConfig
from plumbline.operators import simulation as sim
from plumbline.queries.backtest import BACKTEST_SQL, backtest, signals
from plumbline.queries.base import ANNUAL, add, rounded

SHIFTS = tuple(range(7, 407, 20))
DEFAULTS = SimulationConfig()


def returns(spark, sf_dir):
    return backtest(spark, sf_dir).select("symbol", "date", F.col("strategy_return").alias("ret"))


SIGNALS = BACKTEST_SQL + """,
q as (select symbol, asset_return, signal, (rn - 1)::int as pos, count(*) over (partition by symbol)::int as n from b)"""
FIXED = f""",
ps as (select * from (values (0, 0), {', '.join(f'({i + 1}, {k})' for i, k in enumerate(SHIFTS))}) v(perm, shift)),
mv as (select symbol, perm, (pos + shift) % n as pos, signal from q, ps)"""
JUDGED = f""",
m1 as (select mv.*, q.asset_return from mv join q on q.symbol = mv.symbol and q.pos = mv.pos),
m2 as (select *, coalesce(lag(signal) over (partition by symbol, perm order by pos), 0.0) as p from m1),
m3 as (select *, p * asset_return - abs(p - coalesce(lag(p) over (partition by symbol, perm order by pos), 0.0)) * 0.0002 as r from m2),
nu as (select symbol, perm, avg(r) / stddev_samp(r) * {ANNUAL} as value, product(1 + r) - 1 as total_return, case when product(1 + r) <= 0 then -1.0 else pow(product(1 + r), 252.0 / count(*)) - 1 end as annualised_return from m3 group by 1, 2),
su as (select n.symbol, o.value as observed, avg(n.value) as null_mean, stddev_samp(n.value) as null_std, quantile_cont(n.value, 0.95) as null_q95, 100 * avg((n.value <= o.value)::int::double) as percentile_of_observed, (1 + sum((n.value >= o.value)::int)) / (1.0::double + count(*)) as p_value, count(*)::double as n_permutations
       from nu n join nu o on o.symbol = n.symbol and o.perm = 0 where n.perm > 0 group by 1, 2)
"""
NULL = SIGNALS + FIXED + JUDGED


def uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5({DEFAULTS.seed} || '|' || {" || '|' || ".join(parts)}), 1, 13))::bigint / 4503599627370496.0::double)"


def drawn_sql(horizon: str) -> str:
    """SQL of the default block bootstrap: the common tables up to dr (symbol, path, step, ret)."""
    return BACKTEST_SQL + f""",
q as (select symbol, strategy_return as ret, (rn - 1)::int as pos, count(*) over (partition by symbol)::int as n from b),
sz as (select symbol, max(n) as n, {horizon}::bigint as h from q group by symbol),
pa as (select symbol, n, h, unnest(range(0, {DEFAULTS.n_paths})) as path from sz),
bl as (select symbol, n, h, path, unnest(range(0, (h - 1) // 20 + 1)) as block from pa),
st as (select symbol, n, h, path, block, floor({uniform('symbol', 'path', 'block')} * n)::bigint as start, unnest(range(0, 20)) as i from bl),
dr as (select st.symbol, path, block * 20 + i as step, ret from st join q on q.symbol = st.symbol and q.pos = (start + i) % st.n where block * 20 + i < h)
"""


PATHS = drawn_sql("252") + """,
pv as (select *, greatest(product(1 + ret) over (partition by symbol, path order by step rows unbounded preceding), 0.0) as value from dr),
pk as (select *, max(value) over (partition by symbol, path order by step rows unbounded preceding) as peak from pv),
pt as (select symbol, path, max_by(value, step) as terminal, min(case when peak > 0 then value / peak - 1 else -1.0 end) as max_drawdown from pk group by 1, 2)
"""
QUANTILES = ", ".join(f"round(quantile_cont(r, {x}), 8) as terminal_return_q{round(x * 100):02d}" for x in DEFAULTS.quantiles)
PATH_COLUMNS = f"count(*)::double as n_paths, 252.0::double as horizon_days, round(median(terminal), 8) as median_terminal_value, round(avg(r), 8) as mean_terminal_return, round(median(r), 8) as median_terminal_return, avg((terminal < 1)::int::double) as probability_of_loss, round(max(v), 8) as value_at_risk_95, round(coalesce(avg(case when r <= v then r end), max(v)), 8) as conditional_value_at_risk_95, round(median(max_drawdown), 8) as median_max_drawdown, round(min(max_drawdown), 8) as worst_max_drawdown, {QUANTILES}"
PATH_ROWS = "(select pr.*, v from (select *, terminal - 1 as r from pt) pr join (select symbol, quantile_cont(terminal - 1, 0.05) as v from pt group by symbol) using (symbol))"
BOOT = drawn_sql("max(n)") + f""",
bo as (select symbol, path, case when stddev_samp(ret) >= 1e-12 then avg(ret) / nullif(stddev_samp(ret), 0) * {ANNUAL} end as value from dr group by 1, 2)
"""
BOOT_COLUMNS = "round(avg(value), 8) as bootstrap_mean, round(quantile_cont(value, 0.05), 8) as ci_low, round(quantile_cont(value, 0.95), 8) as ci_high, 0.9::double as confidence, avg((value > 0)::int::double) as fraction_above_zero"
POINT = f"(select symbol, round(avg(ret) / stddev_samp(ret) * {ANNUAL}, 8) as point_estimate from q group by symbol)"
ROTATED = f""",
mv as (select symbol, perm, (pos + case when perm = 0 then 0 else 1 + floor({uniform('symbol', 'perm')} * (n - 1))::int end) % n as pos, signal from q, (select unnest(range(0, {DEFAULTS.n_permutations + 1})) as perm))"""
SHUFFLED = f""",
mv as (select symbol, perm, row_number() over (partition by symbol, perm order by case when perm > 0 then md5({DEFAULTS.seed} || '|' || symbol || '|' || perm || '|' || pos) end, pos) - 1 as pos, signal from q, (select unnest(range(0, {DEFAULTS.n_permutations + 1})) as perm))"""


def null(spark, sf_dir, name="sharpe"):
    return sim.null_distribution(signals(spark, sf_dir), SHIFTS, name=name)


@add("sim_04_significance_test", NULL + "select symbol, perm, round(value, 6) as value from nu")
def test(spark, sf_dir):
    return rounded(null(spark, sf_dir))


COLS = ("observed", "null_mean", "null_std", "null_q95", "percentile_of_observed", "p_value", "n_permutations")


@add("sim_05_null_summary", NULL + f"select symbol, {', '.join(f'round({c}, 6) as {c}' for c in COLS)} from su")
def null_summary(spark, sf_dir):
    return rounded(sim.significance(null(spark, sf_dir)))


def _pick(name: str, column: str, alias: str):
    @add(name, NULL + f"select symbol, round({column}, 6) as {alias} from su")
    def run(spark, sf_dir):
        return rounded(sim.significance(null(spark, sf_dir)).select("symbol", F.col(column).alias(alias)))


_pick("sim_06_percentile_of_observed", "percentile_of_observed", "percentile")
_pick("aux_16_null_mean", "null_mean", "null_mean")
_pick("aux_17_null_std", "null_std", "null_std")


@add("sim_09_net_returns", BACKTEST_SQL + "select symbol, date, round(position * asset_return - trade * 0.0005, 8) as ret from b")
def net_returns(spark, sf_dir):
    b = backtest(spark, sf_dir)
    return rounded(b.select("symbol", "date", sim.net_return(F.col("asset_return"), F.col("position"), F.col("trade"), 5e-4).alias("ret")), 8)


@add("sim_10_statistics", BACKTEST_SQL + f"select symbol, round(avg(strategy_return) / stddev_samp(strategy_return) * {ANNUAL}, 6) as sharpe, round(product(1 + strategy_return) - 1, 6) as total_return, round(case when product(1 + strategy_return) <= 0 then -1.0 else pow(product(1 + strategy_return), 252.0 / count(*)) - 1 end, 6) as annualised_return from b group by symbol")
def statistics(spark, sf_dir):
    return rounded(returns(spark, sf_dir).groupBy("symbol").agg(*[sim.statistic(n).alias(n) for n in ("sharpe", "total_return", "annualised_return")]))


@add("aux_15_return_cleaning", BACKTEST_SQL + "select symbol, count(strategy_return)::bigint as n from b group by symbol")
def cleaned(spark, sf_dir):
    return sim.positioned(returns(spark, sf_dir)).groupBy("symbol").agg(F.max("n").alias("n"))


@add("sim_01_return_sampler", drawn_sql("252") + "select symbol, path, step, round(ret, 9) as ret from dr")
def sampler(spark, sf_dir):
    return rounded(sim.sample_returns(returns(spark, sf_dir)), 9)


@add("sim_02_path_simulation", PATHS + "select symbol, path, round(terminal, 8) as terminal, round(max_drawdown, 8) as max_drawdown from pt")
def paths(spark, sf_dir):
    return rounded(sim.price_paths(sim.sample_returns(returns(spark, sf_dir))), 8)


@add("sim_03_path_summary", PATHS + f"select symbol, {PATH_COLUMNS} from {PATH_ROWS} group by symbol")
def path_summary(spark, sf_dir):
    return rounded(sim.path_summary(sim.price_paths(sim.sample_returns(returns(spark, sf_dir)))), 8)


@add("sim_07_bootstrap", BOOT + "select symbol, path, round(value, 8) as value from bo")
def bootstrap(spark, sf_dir):
    return rounded(sim.bootstrap(returns(spark, sf_dir)), 8)


@add("sim_08_bootstrap_summary", BOOT + f"select symbol, max(point_estimate) as point_estimate, {BOOT_COLUMNS} from bo join {POINT} using (symbol) group by symbol")
def bootstrap_summary(spark, sf_dir):
    r = returns(spark, sf_dir)
    return rounded(sim.bootstrap_summary(sim.bootstrap(r), r), 8)


@add("sim_11_drawdown_distribution", PATHS + "select symbol, path, round(max_drawdown, 8) as max_drawdown from pt")
def drawdowns(spark, sf_dir):
    return rounded(sim.drawdown_distribution(sim.sample_returns(returns(spark, sf_dir))), 8)


@add("sim_04b_shuffle_null", SIGNALS + SHUFFLED + JUDGED + f"select symbol, {', '.join(f'round({c}, 6) as {c}' for c in COLS)} from su")
def shuffled(spark, sf_dir):
    return rounded(sim.significance(sim.null_distribution(signals(spark, sf_dir), None, method="shuffle")))


@add("sim_04c_rotation_null", SIGNALS + ROTATED + JUDGED + f"select symbol, {', '.join(f'round({c}, 6) as {c}' for c in COLS)} from su")
def rotated(spark, sf_dir):
    return rounded(sim.significance(sim.null_distribution(signals(spark, sf_dir))))

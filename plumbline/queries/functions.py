"""FN queries: scalar functions over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.config import expand_grid
from plumbline.functions import core
from plumbline.queries.backtest import CDF_SQL, ppf_sql
from plumbline.queries.base import PATH, W, add, rounded
from plumbline.queries.walkforward import corr_sql
from plumbline.sources.adapters import price_path, read


@add("fn_01_safe_divide", "select c_custkey, round(c_acctbal / nullif(c_nationkey, 0), 6) as value from customer")
def safe_divide(spark, sf_dir):
    return rounded(read(spark, sf_dir, "customer").select("c_custkey", core.safe_divide("c_acctbal", "c_nationkey").alias("value")))


@add("fn_02_normal_cdf", f"select c_custkey, round({CDF_SQL}, 6) as value from (select c_custkey, c_acctbal / 4000.0 as z from customer)")
def cdf(spark, sf_dir):
    return rounded(read(spark, sf_dir, "customer").select("c_custkey", core.normal_cdf(F.col("c_acctbal") / 4000.0).alias("value")))


@add("fn_03_normal_ppf", f"select c_custkey, round({ppf_sql('p')}, 6) as value from (select c_custkey, (c_custkey + 1) / 16001.0::double as p from customer)")
def ppf(spark, sf_dir):
    return rounded(read(spark, sf_dir, "customer").select("c_custkey", core.normal_ppf((F.col("c_custkey") + 1) / 16001.0).alias("value")))


@add("fn_04_horner", "select p_partkey, round(2.0 * p_size * p_size * p_size - 3.0 * p_size * p_size + 0.5 * p_size + 7.0, 6)::double as value from part")
def horner(spark, sf_dir):
    return rounded(read(spark, sf_dir, "part").select("p_partkey", core.horner((2.0, -3.0, 0.5, 7.0), F.col("p_size").cast("double")).alias("value")))


@add("fn_05_fisher_z", "select p_partkey, round(case when p_size >= 4 and abs(r) < 1 then (atanh(r) - atanh(0.1)) * sqrt(p_size - 3) end, 6) as value from (select p_partkey, p_size, (p_partkey % 21 - 10) / 10.0::double as r from part)")
def fisher(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("r", (F.col("p_partkey") % 21 - 10) / 10.0)
    return rounded(rows.select("p_partkey", core.fisher_z("r", F.lit(0.1), "p_size").alias("value")))


SYM = "case c_nationkey % 4 when 0 then '2330.TW' when 1 then 'mu' when 2 then '3105.two' else 'X.TWX' end"


@add("fn_06_market_of", f"select c_custkey, s, case when upper(s) like '%.TW' or upper(s) like '%.TWO' then 'TW' else 'US' end as market from (select c_custkey, {SYM} as s from customer)")
def market(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.expr(SYM).alias("s")).withColumn("market", core.market_of("s"))


@add("fn_07_horizon_label", "select p_partkey, case when d % 252 = 0 then (d // 252)::varchar || 'y' when d % 21 = 0 then (d // 21)::varchar || 'mo' when d % 5 = 0 then (d // 5)::varchar || 'w' else d::varchar || 'd' end as label from (select p_partkey, (p_partkey % 600 + 1)::int as d from part)")
def horizon(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", core.horizon_label((F.col("p_partkey") % 600 + 1).cast("int")).alias("label"))


@add("fn_09_format_number", "select c_custkey, case when abs(v) >= 1000 then format('{:,.1f}', v) else format('{:.2f}', v) end as text from (select c_custkey, c_acctbal::double as v from customer)")
def format_number(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", core.format_value(F.col("c_acctbal"), 2).alias("text"))


@add("fn_12_symbol_label", "select c_custkey, case when n_name is null then c_nationkey::varchar else n_name || ' ' || c_nationkey::varchar end as label from customer left join (select * from nation where n_nationkey < 20) on n_nationkey = c_nationkey")
def label(spark, sf_dir):
    names = read(spark, sf_dir, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
    joined = read(spark, sf_dir, "customer").join(names, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("c_custkey", F.concat_ws(" ", "n_name", F.col("c_nationkey").cast("string")).alias("label"))


GRID = {"alpha": (0.1, 1.0, 10.0), "depth": (2, 3)}


@add("fn_14_expand_grid", "select (row_number() over (order by i, depth) - 1)::int as candidate, alpha, depth from (values (0, 0.1::double), (1, 1.0), (2, 10.0)) a(i, alpha), (values (2), (3)) d(depth)")
def grid(spark, sf_dir):
    return spark.createDataFrame([(i, p["alpha"], p["depth"]) for i, p in enumerate(expand_grid(GRID))], "candidate int, alpha double, depth int")


@add("fn_16_alignment", PATH + f", a as (select symbol, date, lag(close) over {W} as x from bars), b as (select symbol, date, lead(close) over {W} as y from bars) select a.symbol, a.date, x, y from a join b on a.symbol = b.symbol and a.date = b.date where x is not null and y is not null")
def alignment(spark, sf_dir):
    w = core.by_symbol()
    bars = price_path(spark, sf_dir)
    return core.aligned(bars.select("symbol", "date", F.lag("close").over(w).alias("x")), bars.select("symbol", "date", F.lead("close").over(w).alias("y")), ["symbol", "date"])


@add("fn_17_guarded_corr", f"select l_returnflag, l_linestatus, round({corr_sql('l_quantity', 'l_extendedprice')}, 6) as corr, round({corr_sql('l_quantity', 'one')}, 6) as none from (select *, 1.0::double as one from lineitem) group by 1, 2")
def corr(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0))
    return rounded(rows.groupBy("l_returnflag", "l_linestatus").agg(core.guarded_corr("l_quantity", "l_extendedprice").alias("corr"), core.guarded_corr("l_quantity", "one").alias("none")))


@add("fn_18_watch_corr", f"select l_returnflag, round({corr_sql('l_discount', 'l_tax')}, 6) as corr from lineitem group by 1")
def watch_corr(spark, sf_dir):
    return rounded(read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(core.guarded_corr("l_discount", "l_tax", 2).alias("corr")))

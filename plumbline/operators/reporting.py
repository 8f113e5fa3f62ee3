"""Verdicts and small tables as expressions, and rendering of collected rows as Markdown."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import ExperimentConfig

MIN_FORECASTS, MIN_BLOCKS = 30, 10


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def significance_verdict(p_value: str | Column) -> Column:
    p = _c(p_value)
    return F.when(p.isNull() | F.isnan(p), "no verdict").when(p <= 0.01, "strong").when(p <= 0.05, "moderate").when(p <= 0.20, "weak").otherwise("none")


def decay_verdict(n: str | Column, blocks: str | Column, z: str | Column) -> Column:
    n, blocks, z = _c(n), _c(blocks), _c(z)
    return F.when(n < MIN_FORECASTS, "too few forecasts").when(blocks < MIN_BLOCKS, "too few blocks").when(z.isNull(), "no claim").when(z <= -2, "below the claim").when(z >= 2, "above the claim").otherwise("consistent")


def freshness_verdict(freshness: DataFrame) -> DataFrame:
    """One row: current, within tolerance or behind."""
    s = freshness.agg(F.max(F.col("stale").cast("int")).alias("stale"), F.max("missed_sessions").alias("missed"))
    return s.select(F.when(F.col("stale") == 1, "behind").when(F.col("missed") <= 0, "current").otherwise("within tolerance").alias("verdict"))


def selection_verdict(modal_share: str | Column, spread: str | Column) -> Column:
    share, s = _c(modal_share), _c(spread)
    return F.when(share < 0.5, "unstable").when(s < 0.01, "flat").otherwise("stable")


def sleeve_vs_asset_verdict(sleeve: str | Column, asset: str | Column) -> Column:
    a, b = _c(sleeve), _c(asset)
    return F.when(b.isNull() | F.isnan(b), "no assets").when(a < b - 0.1, "sleeves less correlated").when(a > b + 0.1, "sleeves more correlated").otherwise("alike")


def freshness_line(freshness: DataFrame) -> DataFrame:
    tail = F.when(F.col("stale"), F.concat(F.lit(" STALE ("), F.col("missed_sessions").cast("int").cast("string"), F.lit(" sessions missed)"))).otherwise("")
    return freshness.select("symbol", F.concat(F.lit("newest bar "), F.col("last_bar").cast("string"), tail).alias("line"))


def downsample(rows: DataFrame, value: str, width: int, keys: Sequence[str] = ("symbol",), order: str = "date") -> DataFrame:
    """The last value of each of at most `width` runs of equal length."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    return r.withColumn("bucket", F.floor(F.col("__i") * F.least(F.lit(width), F.col("__n")) / F.col("__n"))).groupBy(*keys, "bucket").agg(F.max_by(value, order).alias(value))


def histogram(rows: DataFrame, value: str, bins: int = 20, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Counts of equal-width bins between the least and the largest value; the last bin holds the largest."""
    ends = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("__lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(0)
    return rows.where(F.col(value).isNotNull()).join(ends, list(keys)).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- rendering of collected rows

#: The metrics shown as percentages, blocks of a sparkline, marks of a chart's series, and the columns of a ranking (metric, heading, percent).
PERCENT_METRICS = {
    "accuracy", "annualised_return", "annualised_volatility", "avg_exposure", "base_rate", "conditional_value_at_risk_95", "directional_accuracy", "hit_rate", "ic_fold_positive_rate", "max_drawdown",
    "median_max_drawdown", "probability_of_loss", "time_in_market", "total_return", "value_at_risk_95", "worst_max_drawdown",
}
BLOCKS, MARKS = "▁▂▃▄▅▆▇█", "#*+.:"
RANKING = (
    ("sharpe", "Sharpe", False), ("excess_sharpe", "vs B&H", False), ("annualised_return", "ann. return", True), ("max_drawdown", "max DD", True), ("ic_fold_mean", "fold IC", False), ("ic_fold_t", "IC t-stat", False),
    ("directional_accuracy", "dir. acc.", True), ("annual_turnover", "turnover", False), ("deflated_sharpe", "deflated", False),
)
NO_DATA = "_no data_"


def number(value: object, digits: int = 4, percent: bool = False) -> str:
    """A figure as text: n/a where there is none, thousands with one digit, text as it is."""
    if value is None or isinstance(value, str):
        return "n/a" if value is None else value
    try:
        x = float(value)
    except (TypeError, ValueError):
        return str(value)
    if not math.isfinite(x):
        return "n/a" if math.isnan(x) else f"{x:+}"
    if percent:
        return f"{x:.2%}"
    return f"{x:,.1f}" if abs(x) >= 1000 else f"{x:.{digits}f}"


def signed_percent(value: float | None, digits: int = 1, signed: bool = True) -> str:
    if value is None or not math.isfinite(value):
        return "—"
    return f"{value:{'+' if signed else ''}.{digits}%}"


def cell(value: object, digits: int = 4) -> str:
    """A table's cell: whole numbers with thousands marks, others by number()."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return f"{value:,}" if isinstance(value, int) else number(value, digits)


def markdown_table(headers: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    n = len(headers)
    lines = [[str(x) for x in r][:n] for r in (headers, *rows)]
    size = [max(len(r[i]) for r in lines if i < len(r)) for i in range(n)]
    drawn = ["| " + " | ".join(x.ljust(k) for x, k in zip(r, size)) + " |" for r in lines]
    return "\n".join([drawn[0], "|" + "|".join("-" * (k + 2) for k in size) + "|", *drawn[1:]])


def metrics_table(named: Mapping[str, Mapping[str, float]], keys: Sequence[str] | None = None, label: str = "metric", percent_keys: Sequence[str] | None = None) -> str:
    """A row for each metric, in the order in which they first occur, and a column for each run."""
    if not named:
        return "_no metrics_"
    keys = list(dict.fromkeys(k for v in named.values() for k in v)) if keys is None else keys
    percent = PERCENT_METRICS if percent_keys is None else set(percent_keys)
    return markdown_table([label, *named], [[k, *(number(v.get(k), percent=k in percent) for v in named.values())] for k in keys])


def thinned(values: Sequence[float], width: int) -> list[float]:
    """The last value of each of `width` runs of about equal length."""
    n = len(values)
    if n <= width:
        return list(values)
    return [values[max(i * n // width, (i + 1) * n // width - 1)] for i in range(width)]


def sparkline(values: Sequence[float], width: int = 60) -> str:
    points = thinned([x for x in values if x is not None and not math.isnan(x)], max(1, width))
    if not points:
        return ""
    low, span = min(points), max(points) - min(points)
    return "".join(BLOCKS[round((x - low) / span * (len(BLOCKS) - 1)) if span >= 1e-12 else 0] for x in points)


def line_chart(series: Mapping[str, Sequence[float]], width: int = 72, height: int = 14, title: str | None = None) -> str:
    """Series over one another, the first on top, with the value axis on the left."""
    width, height = max(8, width), max(3, height)
    lines = {n: thinned([math.nan if x is None else float(x) for x in v], width) for n, v in series.items() if len(v)}
    finite = [x for v in lines.values() for x in v if math.isfinite(x)]
    if not finite:
        return NO_DATA
    low, high = min(finite), max(finite)
    high = high if high - low >= 1e-12 else low + 1
    columns = max(map(len, lines.values()))
    canvas = {}
    for mark, values in reversed(list(zip(MARKS * len(lines), lines.values()))):
        canvas |= {(round((x - low) / (high - low) * (height - 1)), i): mark for i, x in enumerate(values) if math.isfinite(x)}
    ends = {height - 1: number(high), 0: number(low)}
    left = max(map(len, ends.values()))
    rows = [f"{ends.get(y, ''):>{left}} | " + "".join(canvas.get((y, i), " ") for i in range(columns)) for y in reversed(range(height))]
    legend = "  ".join(f"{mark} {name}" for mark, name in zip(MARKS * len(lines), lines))
    return "\n".join([*([title] if title else []), *rows, " " * left + " +" + "-" * columns, " " * left + "   " + legend])


def histogram_chart(values: Sequence[float], bins: int = 20, width: int = 40, marker: float | None = None, marker_label: str = "observed") -> str:
    """Counts of equal-width bins as bars; the marker points at its bin, or says on which side of all bins it lies."""
    x = [v for v in values if v is not None and math.isfinite(v)]
    if not x:
        return NO_DATA
    bins, low, high = max(1, bins), min(x), max(x)
    if high == low:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    at = lambda v: min(max(int((v - low) / step), 0), bins - 1)
    counts = [0] * bins
    for v in x:
        counts[at(v)] += 1
    most, marked = max(counts), marker is not None and math.isfinite(marker)
    out = []
    for i, k in enumerate(counts):
        note = f"  <== {marker_label} ({number(marker)})" if marked and at(marker) == i else ""
        out.append(f"{low + i * step:+8.3f} | {'#' * round(k / most * width):<{width}} {k:>5d}{note}")
    if marked and not low <= marker <= high:
        out.append(f"{'':8} | {'':<{width}} {'':>5}  <== {marker_label} {'above' if marker > high else 'below'} the null range")
    return "\n".join(out)


def bar_chart(labels: Sequence[str], values: Sequence[float | None], width: int = 40, unit: str = "") -> str:
    """Signed bars on both sides of an axis."""
    if len(labels) != len(values):
        raise ValueError(f"{len(labels)} labels for {len(values)} values")
    known = [None if v is None or math.isnan(v) else float(v) for v in values]
    if all(v is None for v in known):
        return NO_DATA
    span, half, left = max(abs(v) for v in known if v is not None) or 1.0, max(4, width // 2), max(len(str(x)) for x in labels)
    out = []
    for name, v in zip(labels, known):
        bar = "#" * (0 if v is None else round(abs(v) / span * half))
        sides = (bar.rjust(half) if v is not None and v < 0 else " " * half, bar.ljust(half) if v is not None and v >= 0 else " " * half)
        out.append(f"{name!s:<{left}} {sides[0]}|{sides[1]}  " + ("n/a" if v is None else f"{v:+.3f}{unit}"))
    return "\n".join(out)


class Report:
    """A Markdown document, section by section."""

    def __init__(self, title: str, subtitle: str | None = None):
        self.parts = [f"# {title}", *([f"_{subtitle}_"] if subtitle else [])]

    def heading(self, text: str, level: int = 2) -> Report:
        return self.text(f"{'#' * min(max(level, 1), 6)} {text}")

    def text(self, text: str) -> Report:
        self.parts.append(text)
        return self

    def bullets(self, items: Sequence[str]) -> Report:
        return self.text("\n".join(f"- {x}" for x in items))

    def table(self, headers: Sequence[str], rows: Sequence[Sequence[object]]) -> Report:
        return self.text(markdown_table(headers, rows))

    def frame(self, df: DataFrame, digits: int = 4) -> Report:
        """All rows of a DataFrame that is small by its meaning (folds, symbols, models)."""
        rows = df.collect()
        return self.table(df.columns, [[cell(x, digits) for x in r] for r in rows]) if rows else self.text("_empty table_")

    def code(self, text: str, language: str = "") -> Report:
        return self.text(f"```{language}\n{text}\n```")

    def render(self) -> str:
        return "\n\n".join(x for x in self.parts if x) + "\n"


# ---------------------------------------------------------------- reports

READING = (
    "**fold IC** is the mean over folds of the correlation of forecast and outcome; **IC t-stat** counts overlapping folds once. Trust them before the pooled IC, which mixes calm and wild folds.",
    "**dir. acc.** above one half is needed and far from enough: many small hits do not pay for a few large misses.",
    "**turnover** is traded notional a year; times the cost in basis points it is the yearly drag.",
    "**vs B&H** is the Sharpe ratio less that of holding the asset.",
)
CAVEATS = (
    "The folds are out of sample, but features, models and grids were chosen by people who had seen the data.",
    "Costs are a flat spread on what is traded: no impact, no borrowing, no gap through a stop.",
    "A synthetic market holds an edge that was put there; finding it tests the machinery alone.",
    "Nothing here is investment advice.",
)


def setup_lines(config: ExperimentConfig, first: object, last: object, n_bars: int) -> list[str]:
    w, b = config.walk_forward, config.backtest
    h = config.features.horizon
    return [
        f"Data: {n_bars} bars, {first} to {last}",
        f"Horizon: {h} session(s)",
        f"Walk-forward: {w.train_size} bars to train, {w.test_size} to test, step {w.resolved_step()}, {'expanding' if w.expanding else 'rolling'}, embargo {w.resolved_embargo(h)}",
        f"Positions: {b.sizing}, at most {b.max_leverage:g} times, threshold {b.threshold:g}, {'with' if b.allow_short else 'without'} shorts",
        f"Costs: {b.cost_bps:g} + {b.slippage_bps:g} = {b.total_cost_bps:g} basis points of what is traded",
    ]


def ranking_row(name: str, metrics: Mapping[str, float]) -> list[str]:
    """One row of a ranking: the run's name and its nine figures."""
    return [name, *(number(metrics.get(k), percent=p) for k, _, p in RANKING)]


def _ranking(out: Report, rows: Sequence[Mapping[str, object]], label: str = "model") -> Report:
    return out.table([label, *(h for _, h, _ in RANKING)], [ranking_row(str(r[label]), r) for r in rows])


def _figures(df: DataFrame, name: str) -> str:
    """A table of a one-row DataFrame's figures."""
    row = df.first()
    return "_nothing scored yet_" if row is None else metrics_table({name: row.asDict()})


def _by_run(df: DataFrame, keys: Sequence[str] = ("symbol", "model")) -> dict[str, dict]:
    return {"/".join(str(r[k]) for k in keys if k in r): r for r in (x.asDict() for x in df.orderBy(*[k for k in keys if k in df.columns]).collect())}


def _equity(out: Report, rows: DataFrame, width: int = 76) -> Report:
    """A chart for each symbol: equity of each model, and of holding the asset."""
    keys = ["symbol", "model"] if "model" in rows.columns else ["symbol"]
    thin = downsample(rows, "equity", width, keys).join(downsample(rows, "benchmark_equity", width, keys), [*keys, "bucket"]).orderBy(*keys, "bucket").collect()
    for symbol in dict.fromkeys(r["symbol"] for r in thin):
        own = [r for r in thin if r["symbol"] == symbol]
        series = {}
        for r in own:
            series.setdefault(r["model"] if "model" in keys else "strategy", []).append(r["equity"])
        lead = next(iter(series))
        series["buy & hold"] = [r["benchmark_equity"] for r in own if "model" not in keys or r["model"] == lead]
        out.code(line_chart(series, width, 16, str(symbol)))
    return out


def selection_section(out: Report, records: DataFrame | None, n_folds: int) -> Report:
    """What each fold chose, how stable that is, and how far the candidates differ."""
    from plumbline.operators import walkforward as wf

    if records is None:
        return out
    chosen = wf.selected_params(records)
    stable = wf.selection_stability(chosen)
    rows = stable.collect()
    if not rows:
        return out
    out.heading("Parameters, chosen inside each fold").text("Each fold chose by an inner walk-forward over its own training bars, with the same embargo; nothing later was read.")
    n = records.where("chosen").count()
    if n < n_folds:
        out.text(f"**{n_folds - n} of {n_folds} folds chose nothing** and kept the defaults: too few training bars, or no finite score. Shares are of the {n} folds that chose.")
    out.table(["symbol", "parameter", "distinct", "most frequent", "share"], [[r["symbol"], r["parameter"], r["n_distinct"], r["modal_value"], number(r["modal_share"], percent=True)] for r in rows])
    verdicts = stable.groupBy("symbol").agg(F.min("modal_share").alias("share")).join(wf.selection_spread(records), "symbol", "left")
    for r in verdicts.withColumn("verdict", selection_verdict("share", "spread")).orderBy("symbol").collect():
        out.text(f"{r['symbol']}: the choice is **{r['verdict']}** (held by {r['share']:.0%} of folds at least; best less worst candidate {number(r['spread'])}). A stable choice is consistent with a real difference and proves none.")
    return out.heading("Choices", 3).frame(chosen.orderBy("symbol", "fold", "parameter"))


def backtest_report(metrics: DataFrame, folds: DataFrame, equity: DataFrame, setup: Sequence[str], records: DataFrame | None = None, regimes: DataFrame | None = None, importance: DataFrame | None = None) -> str:
    out = Report("Backtest", "walk-forward, out of sample").heading("Setup").bullets(setup)
    out.heading("Result").text(metrics_table({k: {n: v for n, v in r.items() if n not in ("symbol", "model")} for k, r in _by_run(metrics).items()}))
    _equity(out.heading("Equity"), equity)
    per = folds.orderBy("symbol", "fold")
    out.heading("Folds").frame(per.select(*[c for c in ("symbol", "fold", "test_start", "test_end", "test_size", "ic_pearson", "ic_spearman", "directional_accuracy", "rmse") if c in per.columns]))
    ics = per.collect()
    out.code(bar_chart([f"{r['symbol']} {r['fold']}" for r in ics], [r["ic_pearson"] for r in ics]))
    selection_section(out, records, len(ics))
    if regimes is not None:
        out.heading("By volatility").frame(regimes.orderBy("symbol", "regime"))
    if importance is not None:
        top = importance.orderBy("symbol", F.desc(F.abs("mean"))).collect()
        out.heading("Features").code(bar_chart([f"{r['symbol']} {r['feature']}" for r in top], [r["mean"] for r in top]))
    return out.heading("How to read this").bullets(READING).heading("Caveats").bullets(CAVEATS).render()


def comparison_report(ranking: DataFrame, setup: Sequence[str], equity: DataFrame | None = None) -> str:
    out = Report("Comparison", "the same folds for every model").heading("Setup").bullets(setup).heading("Ranking")
    rows = [r.asDict() for r in ranking.orderBy("symbol", "rank" if "rank" in ranking.columns else "model").collect()]
    for symbol in dict.fromkeys(r["symbol"] for r in rows):
        _ranking(out.heading(str(symbol), 3), [r for r in rows if r["symbol"] == symbol])
    if equity is not None:
        _equity(out.heading("Equity"), equity)
    out.heading("All figures").text(metrics_table({f"{r['symbol']}/{r['model']}": {k: v for k, v in r.items() if k not in ("symbol", "model")} for r in rows}))
    return out.heading("How to read this").bullets(READING).heading("Caveats").bullets(CAVEATS).render()


def simulation_report(summary: DataFrame, null: DataFrame, interval: DataFrame, draws: DataFrame | None = None, setup: Sequence[str] = ()) -> str:
    """null: observed and p_value by symbol; draws: symbol and stat of each permutation."""
    out = Report("Simulation", "skill against luck").heading("Setup").bullets(setup or ["defaults"])
    judged = null.withColumn("verdict", significance_verdict("p_value"))
    out.heading("Permutation test").text("The same positions, moved against the returns: how often does luck do as well?").frame(judged)
    if draws is not None:
        stat = next(c for c in ("stat", "value", "statistic", "sharpe") if c in draws.columns)
        seen = {r["symbol"]: r for r in judged.collect()}
        for symbol, r in sorted(seen.items()):
            values = [x[0] for x in draws.where(F.col("symbol") == symbol).select(stat).collect()]  # as many as permutations
            out.code(f"{symbol}\n" + histogram_chart(values, marker=r["observed"] if "observed" in judged.columns else None))
    out.heading("Bootstrap").text("The spread that the same history, drawn again in blocks, would give.").frame(interval)
    return out.heading("Paths ahead").frame(summary).heading("Caveats").bullets(CAVEATS).render()


def screen_report(ranking: DataFrame, portfolio: DataFrame | None, tested: int, alpha: float, failed: DataFrame | None = None, setup: Sequence[str] = ()) -> str:
    out = Report("Screen", f"{tested} symbols tested").heading("Setup").bullets(setup or ["defaults"])
    out.text(f"{tested} symbols tested; {tested * alpha:.2f} false positives are expected without correction at {alpha:g}.").heading("Ranking").frame(ranking)
    rows = ranking.collect()
    if rows and "excess_sharpe" in ranking.columns:
        out.code(bar_chart([r["symbol"] for r in rows], [r["excess_sharpe"] for r in rows]))
    if "q_value" in ranking.columns:
        kept = [r["symbol"] for r in rows if r["q_value"] is not None and r["q_value"] <= alpha and (r["excess_sharpe"] or 0) > 0]
        out.heading("Survivors").text(", ".join(kept) if kept else "None beats holding after correction for the number of symbols.")
    if failed is not None:
        lost = failed.collect()
        if lost:
            out.heading("Not tested").bullets([f"{r['symbol']}: {r['error']}" for r in lost])
    if portfolio is not None:
        held = {r["metric"]: r["value"] for r in portfolio.collect()}
        out.heading("Held together").text(metrics_table({"portfolio": held}))
        n = held.get("n_sleeves")
        if n and held.get("effective_bets"):
            out.text(f"{n:.0f} sleeves move like {held['effective_bets']:.2f} independent ones.")
    return out.heading("Caveats").bullets(CAVEATS).render()


def journal_report(live: DataFrame, comparison: DataFrame | None, always_long: DataFrame, freshness: DataFrame, waiting: DataFrame, by_symbol: DataFrame | None = None, rolling: DataFrame | None = None, omitted: int = 0) -> str:
    out = Report("Forecast journal").heading("Data").text(f"The data are **{freshness_verdict(freshness).first()[0]}**.").frame(freshness)
    out.heading("Live").text(_figures(live, "live"))
    if by_symbol is not None:
        out.heading("By symbol", 3).frame(by_symbol)
    if comparison is not None:
        verdict = comparison.select(decay_verdict("n_scored", "n_independent", "hit_rate_z")).first()
        out.heading("Against the backtest").text(f"Verdict: **{verdict[0] if verdict else 'too few forecasts'}**. z-values count forecasts that share sessions once; naive ones count every row.").text(_figures(comparison, "live against claim"))
    out.heading("Against always long").text(_figures(always_long, "model against always long"))
    if rolling is not None:
        points = [r["hit_rate_z"] for r in rolling.orderBy("asof_date").collect()]
        known = [x for x in points if x is not None]
        if known:
            out.heading("Over time").code(f"{sparkline(known)}  {number(known[0], 2)} to {number(known[-1], 2)}")
    out.heading("In flight").frame(waiting)
    return (out.text(f"{omitted} more are waiting.") if omitted else out).render()


def watch_report(snapshots: DataFrame, flagged: DataFrame, links: DataFrame | None = None, followups: DataFrame | None = None, names: Mapping[str, str] | None = None) -> str:
    label = lambda s: f"{s} ({names[s]})" if names and s in names else str(s)
    rows = snapshots.orderBy("symbol").collect()
    out = Report("Market watch", "what happened; no forecasts")
    marks = {}
    for r in flagged.orderBy("symbol", "flag").collect():
        marks.setdefault(r["symbol"], []).append(r["flag"].replace("_", " "))
    out.heading("Out of the ordinary").bullets([f"{label(s)}: {', '.join(f)}" for s, f in marks.items()] or ["nothing"])
    returns = [c for c in snapshots.columns if c.startswith("ret_")]
    out.heading("Latest session").table(["symbol", "date", "close", *(f"{c[4:]} bars" for c in returns), "this year"], [[label(r["symbol"]), r["date"], number(r["close"], 2), *(signed_percent(r[c]) for c in returns), signed_percent(r["ytd"])] for r in rows])
    out.heading("Range and volatility").table(["symbol", "52-week range", "position", "volatility", "percentile", "volume"], [[label(r["symbol"]), f"{number(r['low_52w'], 2)} to {number(r['high_52w'], 2)}", signed_percent(r["range_position"], 0, False), signed_percent(r["volatility"], 1, False), signed_percent(r["volatility_percentile"], 0, False), "—" if r["volume_ratio"] is None else f"{r['volume_ratio']:.1f}x"] for r in rows])
    odd = [r for r in rows if r["move_z"] is not None]
    if odd:
        out.heading("How unusual").bullets([f"{label(r['symbol'])}: {signed_percent(r['ret_1'])}, {r['move_z']:+.1f} deviations; {r['similar_moves']} moves as large in the year before" for r in odd])
    if links is not None:
        found = links.orderBy("leader", "follower").collect()
        out.heading("Overnight").bullets([f"{label(r['follower'])} after {label(r['leader'])}: gap {signed_percent(r['gap'], 2)}, usual for {signed_percent(r['leader_return'], 2)} is {signed_percent(r['expected_gap'], 2)} (correlation {number(r['correlation'], 2)}, {r['n']} sessions)" for r in found] or ["no pairs"])
    if followups is not None:
        out.heading("Notes").bullets([f"{r['date']} {label(r['symbol'])} [{r['category']}] {r['note']}: {signed_percent(r['ret_5'])} after 5 bars, {signed_percent(r['ret_20'])} after 20" for r in followups.orderBy(F.desc("date"), "symbol").collect()] or ["none"])
    return out.render()

"""The named queries of the panel engine and the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.functions import exprs as X
from sigframe.functions import ranks as R
from sigframe.operators import evaluate as E
from sigframe.operators import features as W
from sigframe.operators import labels as L
from sigframe.operators import metrics as M
from sigframe.operators import quality as Q
from sigframe.operators import relational as J
from sigframe.operators import scoring as S
from sigframe.operators import temporal as T
from sigframe.operators import text as TX
from sigframe.plans import inputs as I
from sigframe.schema import WINDOWS
from sigframe.session import table
from sigframe.streaming import archive as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Parts of the SQL side.
_BARS = """fills AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT) AS u,
    CAST(l_quantity AS BIGINT) AS q, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem),
  bars AS (SELECT entity, date, CAST(first(u ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS DOUBLE) AS open,
    CAST(max(u) AS DOUBLE) AS high, CAST(min(u) AS DOUBLE) AS low,
    CAST(last(u ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS DOUBLE) AS close, CAST(sum(q) AS DOUBLE) AS volume
    FROM fills GROUP BY entity, date)"""
_SNAPS = f"{_BARS}, snaps AS (SELECT CAST(date + 2 AS DATE) AS date, entity, close AS last_price FROM bars)"
_LABELED = f"""{_SNAPS},
  entered AS (SELECT s.*, CASE WHEN s.date - b.date <= 4 THEN b.close ELSE s.last_price END AS entry_price
    FROM snaps s ASOF LEFT JOIN bars b ON s.entity = b.entity AND s.date >= b.date),
  labeled AS (SELECT * EXCLUDE (k), exit_price / entry_price - 1 AS fwd_ret FROM (
    SELECT e.*, b.close AS exit_price, row_number() OVER (PARTITION BY e.entity, e.date ORDER BY abs(b.date - e.date - 63), b.date) AS k
    FROM entered e JOIN bars b ON b.entity = e.entity AND b.date > e.date AND b.date BETWEEN e.date + 56 AND e.date + 70 WHERE entry_price > 0) WHERE k = 1)"""
_MOVES = f"""{_BARS}, moves AS (SELECT *, row_number() OVER w AS i, close - lag(close) OVER w AS step, (close - lag(close) OVER w) / lag(close) OVER w AS ret
    FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date))"""
_SIGNALS = f"""{_MOVES}, feats AS (SELECT *, close / lag(close, 5) OVER w - 1 AS ret_5d, close / lag(close, 21) OVER w - 1 AS ret_21d, close / lag(close, 63) OVER w - 1 AS ret_63d,
    CASE WHEN open > 0 THEN (close - open) / open END AS "KMID",
    avg(volume) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / nullif(CASE WHEN i > 65 THEN avg(volume) OVER (w ROWS BETWEEN 59 PRECEDING AND 5 PRECEDING)
      ELSE avg(volume) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END, 0) AS volume_spike_ratio
    FROM moves WINDOW w AS (PARTITION BY entity ORDER BY date)),
  signals AS (SELECT * EXCLUDE (k, later), later / close - 1 AS fwd_ret FROM (
    SELECT f.*, b.close AS later, row_number() OVER (PARTITION BY f.entity, f.date ORDER BY abs(b.date - f.date - 63), b.date) AS k
    FROM feats f JOIN bars b ON b.entity = f.entity AND b.date BETWEEN f.date + 56 AND f.date + 70) WHERE k = 1)"""


def _long(names: list[str], source: str = "signals", extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS signal, date, entity, fwd_ret, \"{n}\" AS value{extra} FROM {source}" for n in names)


def _ic(source: str, by: str, x: str, y: str = "fwd_ret") -> str:
    """Rank correlation per group, by raw moments of average ranks."""
    return f"""SELECT {by}, count(*) AS n, CASE WHEN count(*) >= 3 THEN (count(*) * sum(rx * ry) - sum(rx) * sum(ry)) / nullif(sqrt((count(*) * sum(rx * rx) - sum(rx) * sum(rx)) * (count(*) * sum(ry * ry) - sum(ry) * sum(ry))), 0) END AS ic
    FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE AS rx,
      rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2.0::DOUBLE AS ry
      FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {by}"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


# Temporal joins and labels.


@query("q_spearman_ic_by_date", f"WITH {_SIGNALS}, ics AS ({_ic('signals', 'date', 'ret_5d')}) SELECT * FROM ics WHERE n >= 5")
def _(spark, d):
    return M.spearman(I.signals(spark, d), ["date"], "ret_5d", "fwd_ret").where("n >= 5")


@query("q_ic_summary", f"""WITH {_SIGNALS}, ics AS ({_ic('signals', 'date', 'ret_5d')}) SELECT count(ic) AS n_dates, round(avg(ic), 6) AS mean_ic, round(coalesce(stddev_samp(ic), 0), 6) AS std_ic,
  round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS ir, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)), 6) AS t_stat FROM ics WHERE n >= 5""")  # fmt: skip
def _(spark, d):
    ics = M.spearman(I.signals(spark, d), ["date"], "ret_5d", "fwd_ret").where("n >= 5")
    return M.ic_summary(ics, []).select("n_dates", *[r6(c, c) for c in ("mean_ic", "std_ic", "ir", "t_stat")])


@query("q_asof_backward", f"""WITH {_SNAPS} SELECT s.entity, s.date, s.last_price, CASE WHEN s.date - b.date <= 4 THEN b.date END AS matched_date, CASE WHEN s.date - b.date <= 4 THEN b.close END AS matched
  FROM snaps s ASOF LEFT JOIN bars b ON s.entity = b.entity AND s.date >= b.date""")  # fmt: skip
def _(spark, d):
    return T.asof_backward(I.snapshots(spark, d), I.bars(spark, d))


@query("q_forward_nearest", f"""WITH {_SNAPS} SELECT s.entity, s.date, s.last_price, x.d AS matched_date, x.c AS matched FROM snaps s LEFT JOIN (
  SELECT s.entity AS e, s.date AS sd, b.date AS d, b.close AS c, row_number() OVER (PARTITION BY s.entity, s.date ORDER BY abs(b.date - s.date - 63), b.date) AS k
  FROM snaps s JOIN bars b ON b.entity = s.entity AND b.date BETWEEN s.date + 56 AND s.date + 70) x ON x.e = s.entity AND x.sd = s.date AND x.k = 1""")  # fmt: skip
def _(spark, d):
    return T.nearest_ahead(I.snapshots(spark, d), I.bars(spark, d), 63)


@query("q_labeled_dataset", f"WITH {_LABELED} SELECT date, entity, last_price, entry_price, exit_price, fwd_ret, 63 AS horizon_days FROM labeled")
def _(spark, d):
    return I.labeled(spark, d)


_USER_DAYS = "days AS (SELECT user_id AS entity, CAST(ts AS DATE) AS date, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS last_price FROM events GROUP BY 1, 2)"


@query("q_self_forward_label", f"""WITH {_USER_DAYS} SELECT entity, date, last_price, later / last_price - 1 AS fwd_ret FROM (
  SELECT a.*, b.last_price AS later, row_number() OVER (PARTITION BY a.entity, a.date ORDER BY abs(b.date - a.date - 7), b.date) AS k
  FROM days a JOIN days b ON b.entity = a.entity AND b.date BETWEEN a.date + 5 AND a.date + 9 WHERE a.last_price > 0) WHERE k = 1""")  # fmt: skip
def _(spark, d):
    return L.label_from_snapshots(I.user_days(spark, d), 7, 2)


@query("q_bar_forward_label", f"""WITH {_BARS} SELECT entity, date, close, ahead / close - 1 AS fwd_ret FROM (
  SELECT *, lead(close, 20) OVER w AS ahead, row_number() OVER w - 1 AS i FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)) WHERE i >= 30 AND (i - 30) % 5 = 0 AND ahead IS NOT NULL AND close > 0""")  # fmt: skip
def _(spark, d):
    return T.row_offset_label(I.bars(spark, d), 20, 5, 30).select("entity", "date", "close", "fwd_ret")


@query("q_relative_return", f"""WITH {_LABELED}, m AS (SELECT date, list_sort(list(fwd_ret))[count(*) // 2 + 1] AS median FROM labeled GROUP BY date)
  SELECT l.date, l.entity, l.fwd_ret, m.median, l.fwd_ret - m.median AS rel_ret FROM labeled l JOIN m USING (date)""")  # fmt: skip
def _(spark, d):
    return L.relative_return(I.labeled(spark, d)).select("date", "entity", "fwd_ret", "median", "rel_ret")


@query("q_upper_median", f"WITH {_BARS} SELECT date, count(*) AS n, list_sort(list(close))[count(*) // 2 + 1] AS median FROM bars GROUP BY date")
def _(spark, d):
    return R.upper_median(I.bars(spark, d), ["date"], "close")


_URGENT = "have AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), gaps AS (SELECT x.date FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM have), (SELECT max(date) FROM have), INTERVAL 1 DAY)) AS DATE) AS date) x WHERE isodow(x.date) < 6 AND x.date NOT IN (SELECT date FROM have))"


def _gaps(spark, d):
    have = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("date"))
    return T.missing_business_days(have, F.min("date"), F.max("date"))


@query("q_missing_business_days", f"WITH {_URGENT} SELECT date FROM gaps")
def _(spark, d):
    return _gaps(spark, d)


@query("q_universe_carry", f"""WITH {_URGENT}, snaps AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS entity FROM orders WHERE o_orderstatus = 'P'),
  src AS (SELECT g.date, coalesce((SELECT max(s.date) FROM snaps s WHERE s.date < g.date), (SELECT max(date) FROM snaps)) AS src FROM gaps g)
  SELECT src.date, s.entity FROM src JOIN snaps s ON s.date = src.src""")  # fmt: skip
def _(spark, d):
    snaps = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("entity"))
    return T.universe_carry(_gaps(spark, d), snaps)


@query("q_big_move_label", f"WITH {_LABELED} SELECT date, entity, CASE WHEN fwd_ret >= 0.30::DOUBLE THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM labeled")
def _(spark, d):
    return I.labeled(spark, d).select("date", "entity", L.big_move().alias("label"))


@query("q_top_quantile_label", f"""WITH {_LABELED} SELECT date, entity, CASE WHEN count(*) OVER (PARTITION BY date) >= 5 AND fwd_ret >= quantile_cont(fwd_ret, 0.8) OVER (PARTITION BY date) THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM labeled""")
def _(spark, d):
    return L.top_quantile(I.labeled(spark, d)).select("date", "entity", "label")


@query("q_purged_split", f"WITH {_LABELED} SELECT date, entity FROM labeled WHERE date + 63 < DATE '1999-01-04' - 2")
def _(spark, d):
    return L.purged(I.labeled(spark, d), F.lit("1999-01-04").cast("date"), 2).select("date", "entity")


@query("q_walk_forward_folds", f"""WITH {_LABELED}, p AS (SELECT date, entity, row_number() OVER (ORDER BY date, entity) - 1 AS pos, count(*) OVER () // 5 AS size FROM labeled)
  SELECT date, entity, pos, CASE WHEN pos // size <= 4 THEN CAST(pos // size AS INTEGER) END AS fold FROM p""")  # fmt: skip
def _(spark, d):
    return L.walk_forward_folds(I.labeled(spark, d)).select("date", "entity", "pos", "fold")


# Features.

_W = "(PARTITION BY entity ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _feature(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], rounded: tuple[str, ...] = ()) -> None:
    """rounded: beginnings of the names whose last bits depend on the order of summing."""
    shown = ", ".join(f'round({v}, 6) AS "{k}"' if k.startswith(rounded) and rounded else f'{v} AS "{k}"' for k, v in sql.items())

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = W.with_moves(I.bars(spark, d))
        return rows.select("entity", "date", *[(F.round(v, 6) if k.startswith(rounded) and rounded else v).alias(k) for k, v in columns().items()])

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {_MOVES} SELECT entity, date, {shown} FROM moves WINDOW w AS (PARTITION BY entity ORDER BY date)"


_feature("q_returns", lambda: {f"ret_{n}d": W.past_return(n) for n in (5, 21, 63)}, {f"ret_{n}d": f"CASE WHEN lag(close, {n}) OVER w > 0 THEN close / lag(close, {n}) OVER w - 1 END" for n in (5, 21, 63)})
_feature("q_rsi", lambda: {"rsi_14": W.rsi()}, {"rsi_14": f"CASE WHEN i > 14 THEN 100 - 100 / (1 + avg(greatest(step, 0)) OVER {_W.format(13)} / nullif(avg(greatest(-step, 0)) OVER {_W.format(13)}, 0)) END"})
_feature("q_volume_spike", lambda: {"volume_spike_ratio": W.volume_spike()}, {"volume_spike_ratio": f"avg(volume) OVER {_W.format(4)} / nullif(CASE WHEN i > 65 THEN avg(volume) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 59 PRECEDING AND 5 PRECEDING) ELSE avg(volume) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END, 0)"})
_feature("q_range_position", lambda: {"pct_off_52w_high": W.off_high(), "pct_above_52w_low": W.above_low()}, {"pct_off_52w_high": f"close / max(close) OVER {_W.format(125)} - 1", "pct_above_52w_low": f"close / min(close) OVER {_W.format(125)} - 1"})
_feature("q_annualized_vol", lambda: {"annualized_vol": W.annualized_vol()}, {"annualized_vol": f"CASE WHEN count(ret) OVER {_W.format(125)} >= 2 THEN stddev_samp(ret) OVER {_W.format(125)} * sqrt(252) END"}, ("annualized_vol",))
_feature(
    "q_kbar",
    W.candles,
    {
        "KMID": "CASE WHEN open > 0 THEN (close - open) / open END",
        "KLEN": "CASE WHEN open > 0 THEN (high - low) / open END",
        "KUP": "CASE WHEN open > 0 THEN (high - greatest(open, close)) / open END",
        "KLOW": "CASE WHEN open > 0 THEN (least(open, close) - low) / open END",
        "KSFT": "CASE WHEN open > 0 THEN (2 * close - high - low) / open END",
        "KMID2": "CASE WHEN high > low THEN (close - open) / (high - low) END",
    },
)
_feature(
    "q_rolling_price",
    lambda: {k: v for w in WINDOWS for k, v in W.rolling_price(w).items()},
    {
        f"{k}_{w}": f"CASE WHEN i > {w} THEN {v} END"
        for w in WINDOWS
        for k, v in {
            "ROC": f"lag(close, {w}) OVER w / nullif(close, 0)",
            "MA": f"avg(close) OVER {_W.format(w - 1)} / nullif(close, 0)",
            "STD": f"stddev_pop(close) OVER {_W.format(w - 1)} / nullif(close, 0)",
            "MAX": f"max(high) OVER {_W.format(w - 1)} / nullif(close, 0)",
            "MIN": f"min(low) OVER {_W.format(w - 1)} / nullif(close, 0)",
            "RSV": f"(close - min(low) OVER {_W.format(w - 1)}) / nullif(max(high) OVER {_W.format(w - 1)} - min(low) OVER {_W.format(w - 1)}, 0)",
        }.items()
    },
    ("STD",),
)
_feature("q_rolling_corr", lambda: {k: v for w in WINDOWS for k, v in W.rolling_corr(w).items()}, {f"CORR_{w}": f"CASE WHEN i > {w} THEN covar_pop(close, ln(1 + volume)) OVER {_W.format(w - 1)} / nullif(stddev_pop(close) OVER {_W.format(w - 1)} * stddev_pop(ln(1 + volume)) OVER {_W.format(w - 1)}, 0) END" for w in WINDOWS}, ("CORR",))
_feature("q_rolling_strength", lambda: {k: v for w in WINDOWS for k, v in W.rolling_strength(w).items()}, {k: v for w in WINDOWS for k, v in {f"CNTP_{w}": f"CASE WHEN i > {w} THEN avg(CASE WHEN step > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER {_W.format(w - 1)} END", f"SUMP_{w}": f"CASE WHEN i > {w} THEN sum(greatest(step, 0)) OVER {_W.format(w - 1)} / nullif(sum(abs(step)) OVER {_W.format(w - 1)}, 0) END"}.items()})
_feature("q_rolling_volume", lambda: {k: v for w in WINDOWS for k, v in W.rolling_volume(w).items()}, {f"VMA_{w}": f"CASE WHEN i > {w} AND volume > 0 THEN avg(volume) OVER {_W.format(w - 1)} / volume END" for w in WINDOWS})


@query("q_tail", f"WITH {_BARS} SELECT entity, date, close FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS k FROM bars) WHERE k <= 10")
def _(spark, d):
    return W.last_rows(I.bars(spark, d), 10).select("entity", "date", "close")


# Ranks and cross-sections.


@query("q_avg_rank", f"WITH {_BARS} SELECT date, entity, rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0::DOUBLE AS r FROM bars")
def _(spark, d):
    return I.bars(spark, d).select("date", "entity", R.avg_rank(["date"], "close").alias("r"))


@query("q_percentile_rank", f"WITH {_MOVES} SELECT date, entity, CASE WHEN step IS NULL THEN 0.5::DOUBLE ELSE cume_dist() OVER (PARTITION BY date, step IS NULL ORDER BY step) END AS p FROM moves")
def _(spark, d):
    return W.with_moves(I.bars(spark, d)).select("date", "entity", R.pct_rank_or_half(["date"], "step").alias("p"))


@query("q_rank_average", f"""WITH {_BARS}, r AS (SELECT date, entity, (rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0::DOUBLE - 1) / greatest(count(*) OVER (PARTITION BY date) - 1, 1) AS a,
  (rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0::DOUBLE - 1) / greatest(count(*) OVER (PARTITION BY date) - 1, 1) AS b FROM bars) SELECT date, entity, (a + b) / 2 AS score FROM r""")  # fmt: skip
def _(spark, d):
    return I.bars(spark, d).select("date", "entity", ((R.rank01(["date"], "close") + R.rank01(["date"], "volume")) / 2).alias("score"))


@query("q_decile_spread", f"""WITH {_SIGNALS}, p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret_5d, entity) AS k, count(*) OVER (PARTITION BY date) AS c FROM signals WHERE ret_5d IS NOT NULL)
  SELECT date, count(*) AS n, round(avg(fwd_ret) FILTER (k > c - greatest(1, c // 10)), 6) AS top, round(avg(fwd_ret) FILTER (k <= greatest(1, c // 10)), 6) AS bottom,
    round(avg(fwd_ret) FILTER (k > c - greatest(1, c // 10)) - avg(fwd_ret) FILTER (k <= greatest(1, c // 10)), 6) AS spread FROM p WHERE c >= 20 GROUP BY date""")  # fmt: skip
def _(spark, d):
    out = M.quantile_spread(I.signals(spark, d), ["date"], "ret_5d", "fwd_ret", ties=("entity",))
    return out.select("date", "n", *[r6(c, c) for c in ("top", "bottom", "spread")])


@query("q_hit_rate", f"""WITH {_SIGNALS}, p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret_5d, entity) AS k, count(*) OVER (PARTITION BY date) AS c FROM signals WHERE ret_5d IS NOT NULL)
  SELECT date, count(*) AS n, avg(CASE WHEN fwd_ret > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (k > c - greatest(1, round_even(c * 0.2::DOUBLE, 0))) AS hit_rate FROM p GROUP BY date""")  # fmt: skip
def _(spark, d):
    return M.hit_rate(I.signals(spark, d), ["date"], "ret_5d", "fwd_ret", ties=("entity",))


@query("q_neutralized_ic", f"""WITH {_SIGNALS}, res AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY date) >= 3 THEN ret_5d - coalesce(covar_pop(ret_5d, ret_21d) OVER (PARTITION BY date) / nullif(var_pop(ret_21d) OVER (PARTITION BY date), 0), 0) * ret_21d END AS residual
  FROM signals WHERE ret_5d IS NOT NULL AND ret_21d IS NOT NULL), ics AS ({_ic('res', 'date', 'residual')}) SELECT date, n, round(ic, 6) AS ic FROM ics WHERE n >= 5""")  # fmt: skip
def _(spark, d):
    rows = M.residuals(I.signals(spark, d), ["date"], "ret_5d", "ret_21d")
    return M.spearman(rows, ["date"], "residual", "fwd_ret").where("n >= 5").select("date", "n", r6("ic", "ic"))


def _turnover_sql(source: str) -> str:
    return f"""top AS (SELECT signal, date, entity FROM (SELECT *, row_number() OVER (PARTITION BY signal, date ORDER BY value, entity) AS k, count(*) OVER (PARTITION BY signal, date) AS c FROM {source} WHERE value IS NOT NULL)
    WHERE c >= 5 AND k > c - greatest(1, round_even(c * 0.2::DOUBLE, 0))),
  pairs AS (SELECT signal, date, lag(date) OVER (PARTITION BY signal ORDER BY date) AS before FROM (SELECT DISTINCT signal, date FROM top)),
  shares AS (SELECT t.signal, t.date, 1 - count(o.entity) / count(*)::DOUBLE AS share FROM top t JOIN pairs p ON p.signal = t.signal AND p.date = t.date AND p.before IS NOT NULL
    LEFT JOIN top o ON o.signal = t.signal AND o.date = p.before AND o.entity = t.entity GROUP BY 1, 2),
  moved AS (SELECT signal, count(*) AS n_pairs, avg(share) AS turnover FROM shares GROUP BY signal)"""


_NAMES = ["ret_5d", "ret_21d", "KMID", "volume_spike_ratio"]


@query("q_signal_turnover", f"WITH {_SIGNALS}, long AS ({_long(_NAMES)}), {_turnover_sql('long')} SELECT signal, n_pairs, round(turnover, 6) AS turnover FROM moved")
def _(spark, d):
    long = E.long_signals(I.signals(spark, d), _NAMES, ["date", "entity", "fwd_ret"])
    return M.turnover(long, ["signal"], "value").select("signal", "n_pairs", r6("turnover", "turnover"))


@query("q_signal_leaderboard", f"""WITH {_SIGNALS}, crowd AS (SELECT *, ret_21d AS base FROM (SELECT *, count(*) OVER (PARTITION BY date) AS c FROM signals) WHERE c >= 5), long AS ({_long(_NAMES, 'crowd', ', base')}),
  ics AS ({_ic('long', 'signal, date', 'value')}), s AS (SELECT signal, count(ic) AS n_dates, avg(ic) AS mean_ic, stddev_samp(ic) AS sd FROM ics WHERE ic IS NOT NULL GROUP BY signal),
  p AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY value, date, entity) AS k, count(*) OVER (PARTITION BY signal) AS c FROM long WHERE value IS NOT NULL),
  q AS (SELECT signal, avg(fwd_ret) FILTER (k > c - c // 10) - avg(fwd_ret) FILTER (k <= c // 10) AS spread, avg(CASE WHEN fwd_ret > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (k > c - greatest(1, round_even(c * 0.2::DOUBLE, 0))) AS hit_rate FROM p GROUP BY signal),
  res AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY signal, date) >= 3 THEN value - coalesce(covar_pop(value, base) OVER (PARTITION BY signal, date) / nullif(var_pop(base) OVER (PARTITION BY signal, date), 0), 0) * base END AS residual FROM long WHERE value IS NOT NULL AND base IS NOT NULL AND signal <> 'ret_21d'),
  nics AS ({_ic('res', 'signal, date', 'residual')}), neutral AS (SELECT signal, avg(ic) AS neutral_ic FROM nics GROUP BY signal), {_turnover_sql('long')}
  SELECT s.signal, n_dates, round(mean_ic, 6) AS mean_ic, round(sd, 6) AS std_ic, round(mean_ic / sd, 6) AS ir, round(mean_ic / sd * sqrt(n_dates), 6) AS t_stat, round(spread, 6) AS spread, round(hit_rate, 6) AS hit_rate, round(turnover, 6) AS turnover, round(neutral_ic, 6) AS neutral_ic
  FROM s JOIN q USING (signal) JOIN moved USING (signal) LEFT JOIN neutral USING (signal)""")  # fmt: skip
def _(spark, d):
    board = E.leaderboard(I.signals(spark, d), _NAMES, base="ret_21d")
    # what is left of a signal after taking out itself is rounding alone
    board = board.withColumn("neutral_ic", F.when(F.col("signal") != "ret_21d", F.col("neutral_ic")))
    return board.select("signal", "n_dates", *[r6(c, c) for c in ("mean_ic", "std_ic", "ir", "t_stat", "spread", "hit_rate", "turnover", "neutral_ic")])


@query("q_ic_decay", f"""WITH {_SIGNALS}, each AS (SELECT f.*, h.h FROM feats f, (VALUES (21), (63), (126)) h(h)),
  lab AS (SELECT *, later / close - 1 AS fwd_ret FROM (SELECT e.*, b.close AS later, row_number() OVER (PARTITION BY e.entity, e.date, e.h ORDER BY abs(b.date - e.date - e.h), b.date) AS k FROM each e JOIN bars b ON b.entity = e.entity AND b.date > e.date AND b.date BETWEEN e.date + e.h - 7 AND e.date + e.h + 7) WHERE k = 1),
  long AS ({_long(['ret_5d', 'ret_21d', 'KMID'], 'lab', ', h')}), crowd AS (SELECT *, count(*) OVER (PARTITION BY signal, h, date) AS c FROM long),
  ics AS ({_ic('(SELECT * FROM crowd WHERE c >= 5)', 'signal, h, date', 'value')}), m AS (SELECT signal, h, avg(ic) AS ic FROM ics GROUP BY 1, 2),
  w AS (SELECT signal, max(ic) FILTER (h = 21) AS h21, max(ic) FILTER (h = 63) AS h63, max(ic) FILTER (h = 126) AS h126 FROM m GROUP BY signal)
  SELECT signal, round(h21, 6) AS h21, round(h63, 6) AS h63, round(h126, 6) AS h126, round(greatest(abs(h21), abs(h63), abs(h126)), 6) AS best FROM w""")  # fmt: skip
def _(spark, d):
    b = W.with_moves(I.bars(spark, d)).select("entity", "date", F.col("close").alias("last_price"), W.past_return(5).alias("ret_5d"), W.past_return(21).alias("ret_21d"), W.candles()["KMID"].alias("KMID"))
    out = E.ic_decay(b, I.bars(spark, d), ["ret_5d", "ret_21d", "KMID"])
    return out.select("signal", *[r6(c, c) for c in ("h21", "h63", "h126", "best")])


_SCORED = "s AS (SELECT d.lang, d.n_chars / (SELECT max(n_chars) FROM documents)::DOUBLE AS p, l.quality::DOUBLE AS y FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    most = docs.agg(F.max("n_chars").alias("m"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").join(F.broadcast(most))
    return rows.select("lang", (F.col("n_chars") / F.col("m")).alias("p"), F.col("quality").cast("double").alias("y"))


@query("q_brier", f"WITH {_SCORED} SELECT lang, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier FROM s GROUP BY lang")
def _(spark, d):
    return M.brier(_scored(spark, d), ["lang"], "p", "y").select("lang", "n", r6("brier", "brier"))


@query("q_auc", f"""WITH {_SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0::DOUBLE AS r FROM s)
  SELECT lang, count(*) FILTER (y > 0.5) AS n_pos, count(*) FILTER (y <= 0.5) AS n_neg, (sum(CASE WHEN y > 0.5 THEN r ELSE 0 END) - count(*) FILTER (y > 0.5) * (count(*) FILTER (y > 0.5) + 1) / 2) / nullif(count(*) FILTER (y > 0.5) * count(*) FILTER (y <= 0.5), 0) AS auc FROM r GROUP BY lang""")  # fmt: skip
def _(spark, d):
    return M.auc(_scored(spark, d), ["lang"], "p", "y")


@query("q_calibration_table", f"""WITH {_SCORED}, e AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS e FROM s)
  SELECT CAST((p >= e[1])::INT + (p >= e[2])::INT + (p >= e[3])::INT + (p >= e[4])::INT AS INTEGER) AS bucket, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM s, e GROUP BY 1""")  # fmt: skip
def _(spark, d):
    return M.calibration_table(_scored(spark, d), "p", "y").select("bucket", "n", r6("mean_p", "mean_p"), r6("mean_y", "mean_y"))


@query("q_standardize", """SELECT p_partkey, round(coalesce((p_size - avg(p_size) OVER ()) / coalesce(nullif(stddev_pop(p_size) OVER (), 0), 1), 0), 6) AS p_size, round(coalesce((p_retailprice - avg(p_retailprice) OVER ()) / coalesce(nullif(stddev_pop(p_retailprice) OVER (), 0), 1), 0), 6) AS p_retailprice FROM part""")
def _(spark, d):
    out = M.standardized(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return out.select("p_partkey", r6("p_size", "p_size"), r6("p_retailprice", "p_retailprice"))


@query("q_composite_score", f"""WITH {_SIGNALS}, raw AS (SELECT date, entity, "KMID" AS news_sentiment, CASE WHEN ret_21d IS NULL AND ret_63d IS NULL THEN NULL ELSE (coalesce(ret_21d, 0) + coalesce(ret_63d, 0)) / ((ret_21d IS NOT NULL)::INT + (ret_63d IS NOT NULL)::INT) END AS m,
    volume_spike_ratio AS v, volume AS nb, high AS rb, floor(volume / 10) AS sec, low AS st, close AS wiki FROM feats),
  pr AS (SELECT date, entity, news_sentiment, CASE WHEN m IS NULL THEN 0.5 ELSE cume_dist() OVER (PARTITION BY date, m IS NULL ORDER BY m) END AS pm, CASE WHEN v IS NULL THEN 0.5 ELSE cume_dist() OVER (PARTITION BY date, v IS NULL ORDER BY v) END AS pv,
    cume_dist() OVER (PARTITION BY date ORDER BY nb) AS pn, cume_dist() OVER (PARTITION BY date ORDER BY rb) AS prb, cume_dist() OVER (PARTITION BY date ORDER BY sec) AS psec, cume_dist() OVER (PARTITION BY date ORDER BY st) AS pst, cume_dist() OVER (PARTITION BY date ORDER BY wiki) AS pw FROM raw)
  SELECT date, entity, round(100 * (0.25 * pm + 0.15 * pv + 0.12 * pn + 0.08 * (coalesce(news_sentiment, 0) + 1) / 2 + 0.12 * prb + 0.05 * 0.5 + 0.05 * psec + 0.08 * pst + 0.05 * pw + 0.05 * 0.5)::DOUBLE, 6) AS score FROM pr""")  # fmt: skip
def _(spark, d):
    b = W.with_moves(I.bars(spark, d)).select("*", W.past_return(21).alias("ret_21d"), W.past_return(63).alias("ret_63d"), W.volume_spike().alias("volume_spike_ratio"), W.candles()["KMID"].alias("news_sentiment"))
    none = F.lit(None).cast("double")
    rows = b.withColumns({"news_count": F.col("volume"), "reddit_mentions": F.col("high"), "reddit_sentiment": none, "sec_form4_recent": F.floor(F.col("volume") / 10), "sec_8k_recent": none, "st_trending": none, "st_msg_count": F.col("low"), "wiki_spike_ratio": F.col("close"), "short_vol_ratio": none})
    return S.composite_score(rows).select("date", "entity", r6("score", "score"))


@query("q_top_rankings", f"WITH {_BARS}, m AS (SELECT max(date) AS date FROM bars) SELECT entity, close AS score FROM bars JOIN m USING (date) ORDER BY close DESC, entity LIMIT 25")
def _(spark, d):
    latest = J.on_latest_date(I.bars(spark, d))
    return S.ranked(latest.select(F.col("entity"), F.col("close").alias("score")))


# Quality.


@query("q_manifest", f'WITH {_BARS} SELECT count(*) AS "rows", count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date, count(DISTINCT entity) AS entities FROM bars')
def _(spark, d):
    return Q.manifest(I.bars(spark, d))


@query("q_tracked_entities", "SELECT l_suppkey AS entity FROM lineitem UNION SELECT s_suppkey FROM supplier")
def _(spark, d):
    return Q.tracked_entities(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity")))


@query("q_missingness", f"WITH {_SIGNALS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (\"{c}\" IS NULL) * 100.0::DOUBLE / count(*) AS missing_pct FROM feats" for c in ("ret_5d", "ret_21d", "ret_63d", "KMID")))
def _(spark, d):
    b = W.with_moves(I.bars(spark, d)).select(W.past_return(5).alias("ret_5d"), W.past_return(21).alias("ret_21d"), W.past_return(63).alias("ret_63d"), W.candles()["KMID"].alias("KMID"))
    return Q.missingness(b, ["ret_5d", "ret_21d", "ret_63d", "KMID"])


@query("q_label_quality", f"WITH {_LABELED} SELECT count(*) AS examples, count(DISTINCT date) AS dates, count(DISTINCT entity) AS entities, avg((fwd_ret > 0)::INT) AS positive_rate, round(avg(fwd_ret), 6) AS mean_ret FROM labeled")
def _(spark, d):
    return Q.label_quality(I.labeled(spark, d)).withColumn("mean_ret", F.round("mean_ret", 6))


_GATE = {"view": ("value", "positive", 0.9), "click": ("value", "positive", 0.5), "purchase": ("value", "positive", 0.2), "error": ("value", "positive", 0.99), "signup": ("value", "positive", 0.6)}


@query("q_quality_gate", f"""WITH s AS (SELECT CAST(ts AS DATE) AS date, event_type AS family, avg(CASE WHEN value > 5 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM events GROUP BY 1, 2),
  t AS (SELECT *, CASE family {' '.join(f"WHEN '{k}' THEN {v[2]}::DOUBLE" for k, v in _GATE.items())} END AS floor, avg(share) OVER (PARTITION BY family ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before FROM s),
  u AS (SELECT *, CASE WHEN coalesce(before >= floor AND share < before * 0.4, false) THEN 'COLLAPSED' WHEN share >= floor THEN 'OK' ELSE 'DEAD' END AS st FROM t)
  SELECT date, family, round(share, 6) AS share, floor, round(before, 6) AS "trailing", CASE WHEN st <> 'OK' AND family = 'signup' THEN 'EXPECTED-DOWN' ELSE st END AS status FROM u""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("family"), (F.col("value") > 5).alias("alive"))
    out = Q.gate_from_long(e, _GATE, ("signup",))
    return out.select("date", "family", r6("share", "share"), "floor", r6("trailing", "trailing"), "status")


# Relational.


@query("q_multi_source_merge", """WITH a AS (SELECT l_suppkey AS e, count(*)::DOUBLE AS lines, max(l_quantity) AS most FROM lineitem GROUP BY 1), u AS (SELECT s_suppkey AS e, s_acctbal AS b FROM supplier)
  SELECT CAST(u.e AS VARCHAR) AS entity, x.name, x.value FROM u LEFT JOIN a USING (e), LATERAL (SELECT unnest(['lines', 'most', 'balance']) AS name, unnest([CASE WHEN b > 0 THEN b ELSE lines END, most, CASE WHEN b > 0 THEN b END]) AS value) x WHERE x.value IS NOT NULL""")  # fmt: skip
def _(spark, d):
    sup = table(spark, d, "supplier")
    universe = sup.select(F.col("s_suppkey").cast("string").alias("entity"))
    counted = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("entity")).agg(F.create_map(F.lit("lines"), F.count("*").cast("double"), F.lit("most"), F.max("l_quantity")).alias("features"))
    rich = sup.where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("entity"), F.create_map(F.lit("lines"), F.col("s_acctbal"), F.lit("balance"), F.col("s_acctbal")).alias("features"))
    merged = J.merge_sources(universe, [counted, rich])
    return merged.select("entity", F.explode("features").alias("name", "value"))


def _norm_sql(c: str) -> str:
    from sigframe.schema import NAME_NOISE

    noise = NAME_NOISE.removeprefix("(?i)")
    return f"upper(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '\\s+-\\s+.*$', ''), '[^A-Za-z0-9 ]+', ' ', 'g'), '{noise}', ' ', 'gi'), '\\s+', ' ', 'g')))"


_PART_NAME = "p_brand || ' The ' || p_name || ' Holdings, Inc. - Class A'"


@query("q_name_join_unambiguous", f"""WITH n AS (SELECT DISTINCT {_PART_NAME} AS name FROM part), k AS (SELECT {_norm_sql(_PART_NAME)} AS key, count(DISTINCT p_partkey) AS c, min(p_partkey) AS p_partkey FROM part GROUP BY 1)
  SELECT n.name, k.p_partkey FROM n JOIN k ON k.key = {_norm_sql('n.name')} WHERE k.c = 1""")  # fmt: skip
def _(spark, d):
    named = table(spark, d, "part").select("p_partkey", F.expr(_PART_NAME).alias("name"))
    return J.join_by_name(named.select("name").distinct(), named.withColumnRenamed("name", "own"), "name", "own", "p_partkey").select("name", "p_partkey")


@query("q_normalize_name", f"SELECT p_partkey, {_norm_sql(_PART_NAME)} AS name FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normalize_name(F.expr(_PART_NAME)).alias("name"))


@query("q_clean_name", "SELECT p_partkey, p_brand || ' ' || p_name AS name FROM part")
def _(spark, d):
    full = F.concat_ws(" ", "p_brand", "p_name", F.lit("Holdings, Inc. Class A Common Stock"))
    return table(spark, d, "part").select("p_partkey", X.clean_name(full).alias("name"))


@query("q_broadcast_lookup", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return J.lookup(table(spark, d, "supplier"), n, "s_nationkey").select("s_suppkey", "s_name", "n_name")


@query("q_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("q_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("q_priority_cap", """WITH f AS (SELECT DISTINCT p_name AS entity FROM part WHERE p_size >= 49), s AS (SELECT DISTINCT p_brand || p_name AS entity FROM part WHERE p_size < 10), r AS (SELECT entity, row_number() OVER (ORDER BY entity) AS k FROM s WHERE entity NOT IN (SELECT entity FROM f))
  SELECT entity, 0 AS source FROM f UNION ALL SELECT entity, 1 FROM r WHERE k <= greatest(0, 100 - (SELECT count(*) FROM f))""")  # fmt: skip
def _(spark, d):
    p = table(spark, d, "part")
    return J.priority_cap(p.where("p_size >= 49").select(F.col("p_name").alias("entity")), p.where("p_size < 10").select(F.concat("p_brand", "p_name").alias("entity")), 100)


@query("q_first_seen", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def _(spark, d):
    return J.first_seen(table(spark, d, "part"), "p_partkey", "p_name").select("p_name", "p_partkey")


@query("q_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("q_except", "SELECT p_name FROM part WHERE p_size > 40 EXCEPT SELECT p_name FROM part WHERE p_size < 2")
def _(spark, d):
    p = table(spark, d, "part")
    return p.where("p_size > 40").select("p_name").subtract(p.where("p_size < 2").select("p_name"))


@query("q_intersect", "SELECT p_name FROM part WHERE p_size > 40 INTERSECT SELECT p_name FROM part WHERE p_size < 5")
def _(spark, d):
    p = table(spark, d, "part")
    return p.where("p_size > 40").select("p_name").intersect(p.where("p_size < 5").select("p_name"))


@query("q_union_by_name", "SELECT s_suppkey AS k, s_acctbal AS bal, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"), F.col("c_custkey").alias("k"))
    return J.union_by_name([s, c])


# Scalars, text, aggregates over items.


@query("q_business_days", "SELECT o_orderkey, CAST((SELECT count(*) FROM range(1, 31) t(i) WHERE isodow(CAST(o_orderdate AS DATE) + CAST(t.i AS INTEGER)) < 6) AS INTEGER) AS n, CAST(CAST(o_orderdate AS DATE) - CAST(greatest(isodow(o_orderdate) - 5, 0) AS INTEGER) AS DATE) AS last_day FROM orders")
def _(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", X.business_days_between(day, F.date_add(day, 30)).alias("n"), X.last_business_day(day).alias("last_day"))


_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_AGE = f"greatest((epoch_us({_NOW}) - epoch_us(ts)) / 86400000000.0::DOUBLE, 0)"


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


@query("q_recency_weight", f"SELECT event_id, round(CASE WHEN {_AGE} > 7 THEN 0 ELSE power(0.5::DOUBLE, {_AGE} / 2) END, 6) AS w FROM events")
def _(spark, d):
    age = X.age_days(F.col("ts").cast("timestamp"), _now())
    return table(spark, d, "events").select("event_id", r6(X.recency_weight(age, 2.0, 7.0), "w"))


@query("q_recency_weighted", f"""WITH w AS (SELECT event_type, value, CASE WHEN {_AGE} > 7 THEN 0 ELSE power(0.5::DOUBLE, {_AGE} / 2) END AS w FROM events)
  SELECT event_type, round(sum(w), 6) AS weight, round(coalesce(sum(w * value) / nullif(sum(w), 0), 0), 6) AS mean FROM w GROUP BY event_type""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return TX.recency_stats(e, ["event_type"], "ts", "value", _now(), 2.0, 7.0).select("event_type", r6("weight", "weight"), r6("mean", "mean"))


@query("q_signed_change", "SELECT c_custkey, (c_acctbal - 1000) / nullif(abs(c_acctbal), 0) AS back FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.ratio(F.col("c_acctbal") - 1000, F.abs("c_acctbal")).alias("back"))


@query("q_breadth", "SELECT l_suppkey, CASE WHEN count(*) FILTER (l_returnflag = 'A') + count(*) FILTER (l_returnflag = 'R') > 0 THEN (count(*) FILTER (l_returnflag = 'A') - count(*) FILTER (l_returnflag = 'R')) / (count(*) FILTER (l_returnflag = 'A') + count(*) FILTER (l_returnflag = 'R'))::DOUBLE END AS breadth FROM lineitem GROUP BY 1")
def _(spark, d):
    up, down = F.count_if(F.col("l_returnflag") == "A"), F.count_if(F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(X.breadth(up, down).alias("breadth"))


@query("q_conditional_counts", "SELECT user_id AS entity, count(*) FILTER (event_type = '4') AS form4, count(*) FILTER (event_type LIKE 'c%') AS c_events FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 20 GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events").where(F.to_date("ts") >= F.date_sub(F.lit("2024-01-31").cast("date"), 20))
    return e.groupBy(F.col("user_id").alias("entity")).agg(F.count_if(F.col("event_type") == "4").alias("form4"), F.count_if(F.col("event_type").startswith("c")).alias("c_events"))


@query("q_spike_ratio", """WITH n AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM n)
  SELECT event_type, sum(n) FILTER (k <= 7) AS recent_sum, avg(n) FILTER (k <= 7) / nullif(avg(n) FILTER (k > 7), 0) AS spike FROM k GROUP BY event_type""")  # fmt: skip
def _(spark, d):
    n = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    return TX.spike(n, ["event_type"], "day", "n")


_VOCABULARY = ("THE", "AND", "OF", "TO", "IN", "THAT", "IT")


@query("q_mentions", f"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b[A-Z][A-Z.\\-]{{0,6}}\\b'))) AS entity FROM documents) SELECT entity, count(*)::DOUBLE AS mentions FROM t WHERE entity IN ({', '.join(f"'{v}'" for v in _VOCABULARY if v not in ('IT',))}) GROUP BY entity""")
def _(spark, d):
    return TX.mentions(table(spark, d, "documents"), spark.createDataFrame([(v,) for v in _VOCABULARY], "entity string"))


@query("q_json_features", "SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.try_element_at(F.from_json("props", "map<string,double>"), F.lit("k")).alias("k"))


@query("q_event_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return A.windowed_counts(e, "ts", ["event_type"], "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("q_event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
  SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, s""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = A.sessions(e, "ts", ["user_id"], "12 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


def _polarity(lexicon: dict, negations: tuple) -> str:
    edge = """[.,;:!?"''()]+"""
    values = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in lexicon.items())
    return f"""WITH lexicon(word, worth) AS (VALUES {values}),
  pieces AS (SELECT doc_id, string_split_regex(trim(lower(coalesce(text, ''))), '[ \\t\\n\\x0B\\f\\r]+') AS p FROM documents),
  words AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS k FROM pieces),
  plain AS (SELECT doc_id, k, regexp_replace(raw, '^{edge}|{edge}$', '', 'g') AS word FROM words),
  turned AS (SELECT doc_id, word, coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY k) IN ({", ".join(f"'{w}'" for w in negations)}), false) AS turned FROM plain),
  sums AS (SELECT doc_id, sum(coalesce(worth, 0) * 4 * CASE WHEN turned THEN {TX.TURN}::DOUBLE ELSE 1 END) AS s FROM turned LEFT JOIN lexicon USING (word) GROUP BY doc_id)
  SELECT doc_id, round(s / sqrt(s * s + {TX.SPREAD}::DOUBLE), 6) + 0.0 AS sentiment FROM sums"""


@query("q_sentiment", _polarity(TX.LEXICON, TX.NEGATIONS))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.round(TX.sentiment(), 6) + 0.0).alias("sentiment"))


#: A lexicon and negations that the tables' texts do have.
_FREQUENT, _TURNS = {"of": -0.11, "to": 0.13, "that": -0.29, "it": 0.31, "was": -0.37, "la": 0.05, "que": -0.07, "und": 0.17, "be": 0.23}, ("the", "de", "der", "is")


@query("q_sentiment_lexicon", _polarity(_FREQUENT, _TURNS))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.round(TX.sentiment("text", _FREQUENT, _TURNS), 6) + 0.0).alias("sentiment"))


# Learning.


@query("q_walk_forward_model")
def _(spark, d):
    from sigframe.operators import model

    rows = L.top_quantile(I.signals(spark, d).select("date", "entity", "ret_5d", "ret_21d", "KMID", "fwd_ret", F.lit(63).alias("horizon_days")))
    oos = model.walk_forward(rows, ["ret_5d", "ret_21d", "KMID"])
    return M.auc(oos, ["fold"], "score", "label")


@query("q_calibrated_ensemble")
def _(spark, d):
    from sigframe.operators import model

    rows = L.top_quantile(I.signals(spark, d).select("date", "entity", "ret_5d", "ret_21d", "KMID", "fwd_ret", F.lit(63).alias("horizon_days")))
    return model.evaluate_calibration(model.walk_forward(rows, ["ret_5d", "ret_21d", "KMID"], trees=True))


# SQL surface: the same text in both engines but for a few names.


def _sql(name: str, text: str, oracle: str | None = "", tables: tuple = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events")) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in tables:
            if t in text:
                table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(text)

    QUERIES[name] = run
    if oracle is not None:
        ORACLE_SQL[name] = oracle or text


_sql("q_sql_group_count", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
_sql("q_sql_joins", "SELECT r_name, count(c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 FULL JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name")
_sql("q_sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("q_sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("q_sql_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
_sql("q_sql_filter_agg", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS big, max(l_shipdate) FILTER (WHERE l_returnflag = 'A') AS last_a FROM lineitem GROUP BY l_linestatus")
_sql("q_sql_approx", "SELECT l_returnflag, approx_count_distinct(l_orderkey) AS orders_about, approx_percentile(l_quantity, 0.5) AS median_about FROM lineitem GROUP BY l_returnflag", None)
_sql("q_sql_window", "SELECT o_orderkey, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_sql("q_sql_setops", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
_sql("q_sql_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
_sql("q_sql_pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (count(l_quantity) FOR l_linestatus IN ('F' AS f, 'O' AS o))", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag")
_sql("q_sql_subquery", "SELECT s_suppkey, s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s.s_nationkey AND n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'B')) AND s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
_sql("q_sql_group_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
_sql("q_sql_lateral_alias", "SELECT p_partkey, p_size * 2 AS twice, twice + 1 AS more FROM part")
_sql("q_sql_qualify", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
_sql("q_sql_frame_exclude", "SELECT o_orderkey, (count(*) OVER (PARTITION BY o_custkey)) - 1 AS others, (sum(o_orderkey) OVER (PARTITION BY o_custkey)) - o_orderkey AS other_keys FROM orders", "SELECT o_orderkey, count(*) OVER w AS others, coalesce(sum(o_orderkey) OVER w, 0)::BIGINT AS other_keys FROM orders WINDOW w AS (PARTITION BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)")
_sql("q_sql_except_columns", "SELECT * EXCEPT (p_name, p_retailprice) FROM part WHERE p_size = 7", "SELECT * EXCLUDE (p_name, p_retailprice) FROM part WHERE p_size = 7")
_sql("q_sql_renamed", "SELECT p_brand, min_by(p_partkey, struct(p_size, p_partkey)) AS least, percentile_cont(0.25) WITHIN GROUP (ORDER BY p_size) AS lower FROM part GROUP BY p_brand", "SELECT p_brand, arg_min(p_partkey, (p_size, p_partkey)) AS least, quantile_cont(p_size, 0.25) AS lower FROM part GROUP BY p_brand")
_sql("q_sql_dates", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS month FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
_sql("q_sql_try_cast", "SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_size AS STRING) END AS INT) AS n FROM part", "SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_size::VARCHAR END AS INTEGER) AS n FROM part")
_sql("q_sql_unpivot", "SELECT l_orderkey, l_linenumber, l_partkey, name, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_quantity, l_tax))")
_sql("q_sql_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS last90 FROM orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS last90 FROM orders")
_sql("q_sql_setops_all", "(SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation)")
_sql("q_sql_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, percentile_cont(0.5) WITHIN GROUP (ORDER BY n_nationkey) AS middle FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, quantile_cont(n_nationkey, 0.5) AS middle FROM nation GROUP BY n_regionkey")

from sigframe.plans import landed  # noqa: E402, F401  adds its queries

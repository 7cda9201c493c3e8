"""SQL checks of queries that other modules register: recursive backtests and breakers, features, packs, reports and news."""

from __future__ import annotations

from marketlake.queries.base import BE, BO, W, last_n, sma_sql
from marketlake.queries.portfolio import _H, _R, _Z
from marketlake.queries.text import _D, ORACLE as TEXT, TOPICS

ORACLE: dict[str, str] = {}


# factors and signals
def _mean_from(name: str, view: str, n: int, alpha: float, x: str = "close", first: int | None = None) -> str:
    """An exponential mean of ``view`` (symbol, i, x, m_x) from row ``first`` on, where it is the mean of the n rows up to there."""
    return f"""{name} AS (SELECT symbol, ts, i, m{n}_{x} AS v FROM {view} WHERE i = {first or n} UNION ALL SELECT o.symbol, o.ts, o.i, {alpha!r} * o.{x} + (1 - {alpha!r}) * y.v FROM {name} y JOIN {view} o ON o.symbol = y.symbol AND o.i = y.i + 1)"""


_O = f"""o AS (SELECT *, row_number() OVER ({W}) AS i, close - lag(close) OVER ({W}) AS d, avg(close) OVER {last_n(10)} AS m10_close, avg(close) OVER {last_n(30)} AS m30_close FROM be),
 g AS (SELECT symbol, ts, i, close, greatest(d, 0) AS g, greatest(-d, 0) AS l, avg(greatest(d, 0)) OVER {last_n(14)} AS m14_g, avg(greatest(-d, 0)) OVER {last_n(14)} AS m14_l FROM o)"""
_RSI14 = f"{_mean_from('ag', 'g', 14, 1 / 14, 'g', 15)}, {_mean_from('al', 'g', 14, 1 / 14, 'l', 15)}, rsi AS (SELECT ag.symbol, ag.ts, CASE WHEN al.v = 0 THEN 100 ELSE 100 - 100 / (1 + ag.v / al.v) END AS rsi FROM ag JOIN al ON ag.symbol = al.symbol AND ag.i = al.i)"
_SMAS = " UNION ALL ".join(f"SELECT symbol, 'sma_{n}', {sma_sql('close', n)} FROM be" for n in (5, 10, 20, 60))
ORACLE["ts25_factor_pack"] = f"WITH RECURSIVE {BE}, {_O}, {_mean_from('e10', 'o', 10, 2 / 11)}, {_mean_from('e30', 'o', 30, 2 / 31)}, {_RSI14}, u(symbol, factor, value) AS (SELECT symbol, 'ema_10', v FROM e10 UNION ALL SELECT symbol, 'ema_30', v FROM e30 UNION ALL SELECT symbol, 'rsi_14', rsi FROM rsi UNION ALL {_SMAS}) SELECT symbol, factor, count(*) AS n, round(avg(value), 3) AS mean FROM u WHERE value IS NOT NULL GROUP BY 1, 2"
_CROSS = f"m AS (SELECT symbol, ts, close, {sma_sql('close', 5)} AS f, {sma_sql('close', 20)} AS s FROM be), x AS (SELECT *, lag(f) OVER ({W}) AS pf, lag(s) OVER ({W}) AS p FROM m), c AS (SELECT symbol, ts, close, CASE WHEN pf <= p AND f > s THEN 1 WHEN pf >= p AND f < s THEN -1 ELSE 0 END AS sig FROM x)"
ORACLE["sg15_rsi_ma_combo"] = f"WITH RECURSIVE {BE}, {_O}, {_RSI14}, {_CROSS}, z AS (SELECT c.symbol, c.ts, CASE WHEN sig = 1 AND rsi < 70 THEN 1.0::DOUBLE WHEN sig = -1 AND rsi > 30 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS signal FROM c LEFT JOIN rsi ON c.symbol = rsi.symbol AND c.ts = rsi.ts) SELECT * FROM z WHERE signal <> 0"

# quality
ORACLE["dq05_report"] = _H + _Z.format(v="h").replace("volume", "open") + """, r AS (SELECT symbol, count(*) AS rows, CAST(sum((NOT coalesce(high >= low, false))::INT + (NOT coalesce(high >= open, false))::INT + (NOT coalesce(high >= close, false))::INT + (NOT coalesce(low <= open, false))::INT + (NOT coalesce(low <= close, false))::INT) AS BIGINT) AS bad_ohlc,
 greatest(avg((open IS NULL)::INT), avg((close IS NULL)::INT)) AS m, count(*) FILTER (z > 3) AS outliers FROM z GROUP BY 1)
 SELECT symbol, rows, bad_ohlc, round(m, 6) AS max_null_ratio, outliers, CASE WHEN bad_ohlc > 0 OR m > 0.2 THEN 'ERROR' WHEN m > 0.05 OR outliers > 0.01 * rows THEN 'WARNING' ELSE 'PASS' END AS level FROM r"""


# backtests: signal rows are numbered within their keys and folded one by one
def nav_sql(view: str, keys: list[str], cash: str = "1e6::DOUBLE") -> str:
    """CTEs that end in nav (keys, ts, cash, position, total_value) of ``view`` (keys, ts, close, sig)."""
    k, on = ", ".join(keys), " AND ".join(f"e.{x} = st.{x}" for x in keys)
    at = ", ".join(f"g.{x}" for x in keys)
    back, of = " AND ".join(f"g.{x} = e.{x}" for x in keys), " AND ".join(f"n.{x} = st.{x}" for x in keys)
    return f"""e AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ts) AS i FROM {view} WHERE sig <> 0 AND close > 0),
 st AS (SELECT DISTINCT {k}, CAST(0 AS BIGINT) AS i, {cash} AS cash, 0::BIGINT AS pos FROM {view} UNION ALL SELECT {', '.join(f'e.{x}' for x in keys)}, e.i, CASE WHEN e.sig > 0 THEN st.cash - floor(st.cash * 0.95 / e.close) * e.close ELSE st.cash + st.pos * e.close END, CASE WHEN e.sig > 0 THEN st.pos + CAST(floor(st.cash * 0.95 / e.close) AS BIGINT) ELSE 0 END FROM st JOIN e ON {on} AND e.i = st.i + 1),
 n AS (SELECT {at}, g.ts, g.close, count(e.i) OVER (PARTITION BY {at} ORDER BY g.ts) AS k FROM {view} g LEFT JOIN e ON {back} AND g.ts = e.ts),
 nav AS (SELECT {', '.join(f'n.{x}' for x in keys)}, n.ts, st.cash, st.pos AS position, st.cash + st.pos * n.close AS total_value FROM n JOIN st ON {of} AND n.k = st.i)"""


def report_sql(nav: str, keys: list[str]) -> str:
    """A CTE report (keys, n, tr, ar, sd, mean, mdd, down, win, gain, loss) of net asset values."""
    k = ", ".join(keys)
    return f"""rr AS (SELECT {k}, ts, total_value AS v, total_value / lag(total_value) OVER w - 1 AS r, total_value / max(total_value) OVER (PARTITION BY {k} ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM {nav} WINDOW w AS (PARTITION BY {k} ORDER BY ts)),
 ra AS (SELECT {k}, count(r) AS n, arg_max(v, ts) / arg_min(v, ts) - 1 AS tr, stddev_samp(r) AS sd, avg(r) AS mean, min(dd) AS mdd, stddev_samp(CASE WHEN r < 0 THEN r END) AS down, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE WHEN r IS NOT NULL THEN 0.0::DOUBLE END) AS win, avg(CASE WHEN r > 0 THEN r END) AS gain, abs(avg(CASE WHEN r < 0 THEN r END)) AS loss FROM rr GROUP BY {k}),
 report AS (SELECT *, pow(1 + tr, 252.0::DOUBLE / n) - 1 AS ar, CASE WHEN sd < 1e-10 THEN 0 ELSE (mean - 0.03::DOUBLE / 252) / sd * sqrt(252) END AS sharpe FROM ra WHERE n >= 2)"""


ORACLE["bt11_backtest_summary"] = f"WITH RECURSIVE {BE}, {_CROSS}, {nav_sql('c', ['symbol'])}, {report_sql('nav', ['symbol'])}" + """ SELECT symbol AS strategy, n, round(tr, 6) AS total_return, round(ar, 6) AS annual_return, round(sd * sqrt(252), 6) AS annual_volatility, round(mdd, 6) AS max_drawdown, round(sharpe, 6) AS sharpe,
 round((ar - 0.03) / coalesce(nullif(down * sqrt(252), 0), 1), 6) AS sortino, round(CASE WHEN mdd = 0 THEN 0 ELSE ar / abs(mdd) END, 6) AS calmar, round(win, 6) AS win_rate, round(coalesce(gain, 0) / coalesce(loss, 1), 6) AS profit_loss_ratio, 0.0::DOUBLE AS turnover, 0::BIGINT AS total_trades, round(win * n / 252, 6) AS avg_holding_days FROM report"""
ORACLE["bt10_batch_backtest"] = f"""WITH RECURSIVE {BE}, m AS (SELECT symbol, ts, close, {', '.join(f"{sma_sql('close', n)} AS m{n}" for n in (5, 10, 20))} FROM be), l AS (SELECT symbol, ts, close, 'cross_5_20' AS strategy, m5 AS f, m20 AS s FROM m UNION ALL SELECT symbol, ts, close, 'cross_10_20', m10, m20 FROM m),
 x AS (SELECT *, lag(f) OVER w AS pf, lag(s) OVER w AS p FROM l WINDOW w AS (PARTITION BY strategy, symbol ORDER BY ts)), c AS (SELECT strategy, symbol, ts, close, CASE WHEN pf <= p AND f > s THEN 1 WHEN pf >= p AND f < s THEN -1 ELSE 0 END AS sig FROM x),
 {nav_sql('c', ['strategy', 'symbol'])} SELECT strategy, symbol, round(arg_max(total_value, ts), 3) AS final_value, count(*) AS n FROM nav GROUP BY 1, 2"""

# a portfolio that shares its cash over the symbols: one row at a time, with what each symbol holds in a column of its own
_SLOTS = range(1, 6)
_HELD = "CASE e.k " + " ".join(f"WHEN {j} THEN st.h{j}" for j in _SLOTS) + " END"
_QTY = "CAST(floor(CASE WHEN e.ts = st.ts THEN st.begin ELSE st.cash END * 0.95 * e.strength / e.close) AS BIGINT)"
_BUY, _SELL = f"(e.d = 'LONG' AND {_HELD} = 0 AND e.close > 0 AND {_QTY} > 0)", f"(e.d = 'EXIT' AND {_HELD} > 0)"
_PORTFOLIO = f"""WITH RECURSIVE {BE}, {_CROSS}, sy AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM (SELECT DISTINCT symbol FROM be)), s2(strategy, strength) AS (VALUES ('full', 1.0::DOUBLE), ('half', 0.5::DOUBLE)),
 e AS (SELECT s2.*, c.symbol, sy.k, c.ts, c.close, CASE WHEN sig > 0 THEN 'LONG' ELSE 'EXIT' END AS d, row_number() OVER (PARTITION BY strategy ORDER BY ts, c.symbol) AS i FROM c JOIN sy ON c.symbol = sy.symbol CROSS JOIN s2 WHERE sig <> 0),
 st AS (SELECT strategy, CAST(0 AS BIGINT) AS i, NULL::TIMESTAMP AS ts, 1e6::DOUBLE AS begin, 1e6::DOUBLE AS cash, {', '.join(f'0::BIGINT AS h{j}' for j in _SLOTS)}, NULL::VARCHAR AS symbol, NULL::VARCHAR AS side, 0::BIGINT AS quantity, 0.0::DOUBLE AS price FROM s2
 UNION ALL SELECT e.strategy, e.i, e.ts, CASE WHEN e.ts = st.ts THEN st.begin ELSE st.cash END, CASE WHEN {_BUY} THEN st.cash - {_QTY} * e.close WHEN {_SELL} THEN st.cash + {_HELD} * e.close ELSE st.cash END, {', '.join(f'CASE WHEN e.k <> {j} THEN st.h{j} WHEN {_BUY} THEN {_QTY} WHEN {_SELL} THEN 0 ELSE st.h{j} END' for j in _SLOTS)},
  e.symbol, CASE WHEN {_BUY} THEN 'BUY' WHEN {_SELL} THEN 'SELL' END, CASE WHEN {_BUY} THEN {_QTY} WHEN {_SELL} THEN {_HELD} ELSE 0 END, e.close FROM st JOIN e ON e.strategy = st.strategy AND e.i = st.i + 1),
 t AS (SELECT strategy, ts, symbol, side, quantity, price, cash FROM st WHERE side IS NOT NULL)"""
ORACLE["bt07_backtest_portfolio"] = _PORTFOLIO + " SELECT strategy, ts, symbol, side, quantity, round(price, 4) AS price, round(cash, 4) AS cash FROM t"
ORACLE["bt08_mark_to_market"] = _PORTFOLIO + """, q AS (SELECT strategy, symbol, ts, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS dq, CASE WHEN side = 'BUY' THEN -quantity ELSE quantity END * price AS dc FROM t),
 gr AS (SELECT p.strategy, p.symbol, be.ts, be.close, coalesce(dc, 0) AS dc, coalesce(sum(dq) OVER (PARTITION BY p.strategy, p.symbol ORDER BY be.ts), 0) AS q FROM be JOIN (SELECT DISTINCT strategy, symbol FROM q) p ON be.symbol = p.symbol LEFT JOIN q ON q.strategy = p.strategy AND q.symbol = p.symbol AND q.ts = be.ts),
 b AS (SELECT strategy, ts, sum(q * close) AS pv, count(*) FILTER (q <> 0) AS pc, sum(dc) AS dc FROM gr GROUP BY 1, 2), f AS (SELECT *, 1e6 + sum(dc) OVER (PARTITION BY strategy ORDER BY ts) AS cash FROM b)
 SELECT strategy, ts, round(cash, 3) AS cash, round(pv, 3) AS positions_value, pc AS positions_count, round(cash + pv, 3) AS total_value FROM f"""


# breakers: streak and time until which all is rejected, order by order
def _breaker_sql(view: str, cooldown: str) -> str:
    """A CTE done (account, broken, final) of ``view`` (account, i, ts, ok)."""
    broken = "(st.until IS NOT NULL AND e.ts < st.until)"
    return f"""st AS (SELECT DISTINCT account, CAST(0 AS BIGINT) AS i, 0 AS streak, NULL::TIMESTAMP AS until, NULL::BOOLEAN AS broken, NULL::BOOLEAN AS final FROM {view} UNION ALL SELECT e.account, e.i, CASE WHEN {broken} THEN st.streak WHEN e.ok OR st.streak + 1 >= 3 THEN 0 ELSE st.streak + 1 END,
 CASE WHEN NOT {broken} AND NOT e.ok AND st.streak + 1 >= 3 THEN e.ts + {cooldown} ELSE st.until END, {broken}, e.ok AND NOT {broken} FROM st JOIN {view} e ON e.account = st.account AND e.i = st.i + 1), done AS (SELECT * FROM st WHERE i > 0)"""


_COUNTED = " SELECT account, count(*) FILTER (broken) AS broken, count(*) FILTER (final) AS approved FROM done GROUP BY 1"
ORACLE["rk13_circuit_breaker"] = _R.replace("WITH x", "WITH RECURSIVE x") + f", o AS (SELECT r.account, CAST(o_orderdate AS TIMESTAMP) AS ts, NOT (r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS ok, row_number() OVER (PARTITION BY account ORDER BY o_orderdate, order_id) AS i FROM r JOIN orders ON order_id = o_orderkey), {_breaker_sql('o', 'INTERVAL 30 DAY')}" + _COUNTED
ORACLE["st08_circuit_breaker"] = f"WITH RECURSIVE o AS (SELECT user_id AS account, ts, value < 60 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), {_breaker_sql('o', 'INTERVAL 1 DAY')}" + _COUNTED
ORACLE["st07_order_rates"] = "WITH w AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(10 * k) AS start FROM events, (SELECT unnest(range(6)) AS k)) SELECT 1 AS account, start, count(*) AS n FROM w WHERE start + INTERVAL 2 MINUTE <= (SELECT max(ts) FROM events) GROUP BY 2 HAVING count(*) > 1"


# news
def _counted(topics: dict[str, list[str]], text: str) -> str:
    """CTEs that end in ty (news_id, k, o, c): each type of a text with its number of keywords."""
    counts = ", ".join("(" + " + ".join(f"contains(t, '{k}')::INT" for k in ks) + f") AS \"{n}\"" for n, ks in topics.items())
    each = " UNION ALL ".join(f"SELECT news_id, '{n}' AS k, {o} AS o, \"{n}\" AS c FROM ct" for o, n in enumerate(topics))
    return f"lo AS (SELECT news_id, lower(coalesce({text}, '')) AS t FROM n), ct AS (SELECT news_id, {counts} FROM lo), ty AS ({each})"


def _importance(first: str) -> str:
    return f"CASE {first} WHEN 'macro' THEN 0.85::DOUBLE WHEN 'other' THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END"


ORACLE["nw03_labels_importance"] = f"{_D}, {_counted(TOPICS | {'macro': ['est']}, 'content')}, fi AS (SELECT news_id, coalesce(first(k ORDER BY c DESC, o) FILTER (c > 0), 'other') AS k FROM ty GROUP BY 1) SELECT news_id, {_importance('k')} AS importance FROM fi"
_SENTIMENT = TEXT["nw02_sentiment"].rsplit("SELECT news_id, round(score", 1)[0]
ORACLE["nw04_daily_sentiment"] = _SENTIMENT.rstrip() + """, d AS (SELECT source AS symbol, CAST(published_at AS DATE) AS date, avg(score) AS s, avg(m) AS m, count(*) AS c FROM f JOIN n USING (news_id) GROUP BY 1, 2), days AS (SELECT CAST(x AS DATE) AS date FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(x) WHERE isodow(x) <= 5)
 SELECT g.symbol, days.date, round(coalesce(s, 0), 5) AS sentiment, round(coalesce(m, 0), 5) AS magnitude, coalesce(c, 0) AS news_count FROM (SELECT DISTINCT symbol FROM d) g CROSS JOIN days LEFT JOIN d ON d.symbol = g.symbol AND d.date = days.date"""


def _codes(text: str, names: dict[str, str]) -> str:
    """CTEs that end in sy (news_id, s): the sorted distinct codes of a text, written or named."""
    named = " UNION ALL ".join(f"SELECT news_id, '{c}' FROM n WHERE contains(coalesce({text}, ''), '{w}')" for w, c in names.items() if c)
    found = r"(\d{6})(?:\.(SH|SZ|BJ))?"
    return f"""rc AS (SELECT news_id, unnest(regexp_extract_all(coalesce({text}, ''), '{found}', 1)) AS c, unnest(regexp_extract_all(coalesce({text}, ''), '{found}', 2)) AS e FROM n),
 co(news_id, s) AS (SELECT news_id, c || '.' || coalesce(nullif(e, ''), CASE WHEN left(c, 1) IN ('6', '9') THEN 'SH' WHEN left(c, 1) IN ('0', '3', '2') THEN 'SZ' WHEN left(c, 1) = '4' THEN 'BJ' END) FROM rc UNION ALL {named}),
 sy AS (SELECT n.news_id, list_sort(list(DISTINCT s) FILTER (s IS NOT NULL)) AS s FROM n LEFT JOIN co USING (news_id) GROUP BY 1)"""


ORACLE["nw08_names"] = f"{_D}, {_codes('content', {'the': '600001.SH', 'und': '000002.SZ', 'que': ''})} SELECT news_id, coalesce(array_to_string(s, ','), '') AS symbols FROM sy"
_BOTH = "concat_ws(' ', title, content)"
ORACLE["nw10_tagged"] = f"{_D}, {_counted(TOPICS, _BOTH)}, {_codes(_BOTH, {'the': '600001.SH'})}, tg AS (SELECT news_id, coalesce(string_agg(k, ',' ORDER BY c DESC, o) FILTER (c > 0), 'other') AS tags FROM ty GROUP BY 1) SELECT news_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_symbols, tags, {_importance('split_part(tags, chr(44), 1)')} AS importance FROM tg JOIN sy USING (news_id)"

# machine learning
_NAMES = ["return_1d", "return_5d", "volatility_20", "turnover_ratio_20", "ma_ratio_20", "volume_price_corr_20"]
_FEATURES = f"""WITH {BO}, b1 AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM bo), b2 AS (SELECT symbol, ts, r AS return_1d, close / lag(close, 5) OVER ({W}) - 1 AS return_5d, CASE WHEN count(r) OVER {last_n(20)} >= 20 THEN stddev_samp(r) OVER {last_n(20)} END AS volatility_20,
 volume / ({sma_sql('volume', 20)}) - 1 AS turnover_ratio_20, close / ({sma_sql('close', 20)}) AS q, CASE WHEN count(r) OVER {last_n(20)} >= 20 THEN nullif(corr(r, CASE WHEN r IS NOT NULL THEN CAST(volume AS DOUBLE) END) OVER {last_n(20)}, 'nan'::DOUBLE) END AS volume_price_corr_20, lead(close, 5) OVER ({W}) / close - 1 AS label FROM b1),
 b3 AS (SELECT *, (q - avg(q) OVER s) / CASE WHEN stddev_samp(q) OVER s > 0 THEN stddev_samp(q) OVER s ELSE 1 END AS ma_ratio_20 FROM b2 WINDOW s AS (PARTITION BY symbol)), b4 AS (SELECT * FROM b3 WHERE coalesce({', '.join(_NAMES)}) IS NOT NULL),
 ft AS (SELECT symbol, CAST(ts AS DATE) AS date, {', '.join(f'coalesce({c}, (SELECT avg({c}) FROM b4)) AS {c}' for c in _NAMES)}, label FROM b4)"""
ORACLE["ml01_features"] = _FEATURES + f" SELECT symbol, date, {', '.join(f'round({c}, 5) AS {c}' for c in [*_NAMES, 'label'])} FROM ft"
ORACLE["ml02_split"] = _FEATURES + """, dn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ft)), cu AS (SELECT max(date) FILTER (i = floor(n * 0.7::DOUBLE)) AS t1, max(date) FILTER (i = floor(n * (0.7::DOUBLE + 0.15::DOUBLE))) AS t2 FROM dn)
 SELECT CASE WHEN date <= t1 THEN 'train' WHEN date <= t2 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, min(date) AS first, max(date) AS last FROM ft, cu GROUP BY 1"""
ORACLE["ml05_deciles"] = _FEATURES + ", dt AS (SELECT label, ntile(10) OVER (PARTITION BY date ORDER BY return_5d, label) AS decile FROM ft WHERE return_5d IS NOT NULL AND label IS NOT NULL) SELECT CAST(decile AS INTEGER) AS decile, round(avg(label), 5) AS mean_return, count(*) AS n FROM dt GROUP BY 1"


# search: every parameter pair, part and symbol is a backtest of its own
def _search(bars: str, parts: str) -> str:
    """CTEs that end in sc (window_id, trial, fast, slow, train, validation, test): mean Sharpe ratios over the symbols."""
    periods = [(f, s) for f in (3, 5, 7) for s in (10, 20)]
    means = ", ".join(f"{sma_sql('close', n)} AS m{n}" for n in (3, 5, 7, 10, 20))
    grid = " UNION ALL ".join(f"SELECT {t} AS trial, symbol, ts, close, m{f} AS f, m{s} AS s FROM m" for t, (f, s) in enumerate(periods))
    values = ", ".join(f"({t}, {f}.0::DOUBLE, {s}.0::DOUBLE)" for t, (f, s) in enumerate(periods))
    keys = ["window_id", "part", "trial", "symbol"]
    scores = ", ".join(f"avg(sharpe) FILTER (part = '{p}') AS {p}_score" for p in ("train", "validation", "test"))
    return f"""m AS (SELECT symbol, ts, close, {means} FROM {bars}), l AS ({grid}), x AS (SELECT *, lag(f) OVER w AS pf, lag(s) OVER w AS p FROM l WINDOW w AS (PARTITION BY trial, symbol ORDER BY ts)), {parts},
 c AS (SELECT window_id, part, trial, symbol, ts, close, CASE WHEN pf <= p AND f > s THEN 1 WHEN pf >= p AND f < s THEN -1 ELSE 0 END AS sig FROM x JOIN parts ON CAST(x.ts AS DATE) BETWEEN pb AND pe), {nav_sql('c', keys)}, {report_sql('nav', keys)},
 sc AS (SELECT window_id, trial, {scores} FROM report GROUP BY 1, 2), pv(trial, fast, slow) AS (VALUES {values})"""


_WHOLE = "sp AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM be), cu AS (SELECT a, b, a + CAST(floor((b - a) * 0.7::DOUBLE) AS INT) AS t FROM sp), parts AS (SELECT 0 AS window_id, 'train' AS part, a AS pb, t AS pe FROM cu UNION ALL SELECT 0, 'test', CAST(t + 1 AS DATE), b FROM cu)"
ORACLE["opt03_grid_search"] = f"WITH RECURSIVE {BE}, {_search('be', _WHOLE)} SELECT CAST(trial AS INTEGER) AS trial, fast, slow, round(train_score, 3) AS train_score, round(test_score, 3) AS test_score FROM sc JOIN pv USING (trial) WHERE train_score IS NOT NULL ORDER BY sc.train_score DESC, trial LIMIT 1"

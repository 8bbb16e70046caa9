"""SQL that gives the same rows as the registered queries, for another engine."""

from __future__ import annotations

from ..operators.regime import R2_NULL

_ORDER = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"

SUPPLY = """
supply AS (SELECT s_suppkey, n_name AS ticker, r_name AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
BARS = f"""{SUPPLY},
line AS (SELECT ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, * EXCLUDE (ticker) FROM lineitem JOIN supply ON l_suppkey = s_suppkey),
bars AS (SELECT ticker, date, first(px {_ORDER}) AS open, max(px) AS high, min(px) AS low, last(px {_ORDER}) AS close,
                last(px {_ORDER}) * (1 + dayofyear(date) / 10000.0::DOUBLE) AS adj_close, sum(l_quantity)::BIGINT AS volume FROM line GROUP BY ticker, date)
"""
GROUPS = """
members AS (SELECT DISTINCT ticker, grp FROM supply),
grps AS (SELECT ticker, grp, CASE WHEN grp <> (SELECT min(grp) FROM members) THEN min(ticker) OVER (PARTITION BY grp) END AS proxy FROM members)
"""
PANEL = f"""{BARS},
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars QUALIFY count(*) OVER (PARTITION BY ticker) >= 260)
"""


def _ema(c: str, x: str, n: int, at: int, seed: str) -> str:
    return f"CASE WHEN q.i = {at} THEN {seed} WHEN q.i > {at} THEN {x} * (2.0::DOUBLE / {n + 1}) + r.{c} * (1 - 2.0::DOUBLE / {n + 1}) END AS {c}"


def _wilder(c: str, x: str) -> str:
    return f"CASE WHEN q.i = 14 THEN s_{c} WHEN q.i > 14 THEN (r.{c} * 13 + {x}) / 14 END AS {c}"


_W = "OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def w(k: int) -> str:
    return _W.format(k - 1)


_LAG = "OVER (PARTITION BY ticker ORDER BY i)"
_STATES = ["e12", "e26", "e20", "e50", "e200", "ag", "al", "atr", "v12", "v26"]
IND = f"""{PANEL},
q0 AS (SELECT *, (high + low + close) / 3.0 AS tp, lag(close) {_LAG} AS pc,
              sqrt((pow(high - (high+low+close+open)/4, 2) + pow(low - (high+low+close+open)/4, 2) + pow(close - (high+low+close+open)/4, 2) + pow(open - (high+low+close+open)/4, 2)) / 3.0) AS dv FROM p),
q1 AS (SELECT *, greatest(close - pc, 0.0) AS g, greatest(pc - close, 0.0) AS l, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, lag(tp) {_LAG} AS ptp,
              coalesce(sum(tp * volume) {w(12)} / nullif(sum(volume) {w(12)}, 0), tp) * dv AS x12, coalesce(sum(tp * volume) {w(26)} / nullif(sum(volume) {w(26)}, 0), tp) * dv AS x26 FROM q0),
q AS MATERIALIZED (SELECT *, avg(close) {w(12)} AS s12, avg(close) {w(26)} AS s26, avg(close) {w(20)} AS s20, avg(close) {w(50)} AS s50, avg(close) {w(200)} AS s200,
              avg(g) {w(14)} AS s_ag, avg(l) {w(14)} AS s_al, avg(tr) {w(14)} AS s_atr, avg(x12) {w(12)} AS sv12, avg(x26) {w(26)} AS sv26,
              CASE WHEN i >= 14 THEN sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) {w(14)} END AS mp, CASE WHEN i >= 14 THEN sum(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END) {w(14)} END AS mn FROM q1),
rec AS (
  SELECT ticker, i, {', '.join(f'NULL::DOUBLE AS {c}' for c in _STATES)}, NULL::DOUBLE AS sig, 0.0::DOUBLE AS ls FROM q WHERE i = 0
  UNION ALL
  SELECT ticker, i, {', '.join(_STATES)},
         CASE WHEN i = 33 THEN (pls + e12 - e26) / 9 WHEN i > 33 THEN (e12 - e26) * 0.2::DOUBLE + psig * 0.8::DOUBLE END, CASE WHEN i BETWEEN 25 AND 33 THEN pls + e12 - e26 ELSE pls END
  FROM (SELECT q.ticker, q.i, {_ema('e12', 'close', 12, 11, 's12')}, {_ema('e26', 'close', 26, 25, 's26')}, {_ema('e20', 'close', 20, 19, 's20')}, {_ema('e50', 'close', 50, 49, 's50')},
               {_ema('e200', 'close', 200, 199, 's200')}, {_wilder('ag', 'g')}, {_wilder('al', 'l')}, {_wilder('atr', 'tr')}, {_ema('v12', 'x12', 12, 36, 'sv12')}, {_ema('v26', 'x26', 26, 50, 'sv26')},
               r.sig AS psig, r.ls AS pls
        FROM rec r JOIN q ON q.ticker = r.ticker AND q.i = r.i + 1)),
ind AS MATERIALIZED (SELECT q.ticker, q.date, q.i, q.n, open, high, low, close, adj_close, volume, pc,
        CASE WHEN q.i >= 19 THEN s20 END AS sma20, CASE WHEN q.i >= 49 THEN s50 END AS sma50, CASE WHEN q.i >= 199 THEN s200 END AS sma200,
        e20, e50, e200, e12 - e26 AS macd, sig AS macd_signal, e12 - e26 - sig AS macd_hist,
        CASE WHEN q.i >= 14 THEN CASE WHEN al = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1 + ag / al) END END AS rsi,
        CASE WHEN q.i >= 14 THEN CASE WHEN mn = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1 + mp / mn) END END AS mfi,
        v12 - v26 AS vpvma, CASE WHEN q.i >= 58 THEN avg(v12 - v26) OVER (PARTITION BY q.ticker ORDER BY q.i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) END AS vpvma_signal,
        atr / nullif(close, 0) * 100 AS atr_pct
      FROM q JOIN rec ON q.ticker = rec.ticker AND q.i = rec.i)
"""
_IND_COLUMNS = ["sma20", "sma50", "sma200", "e20", "e50", "e200", "macd", "macd_signal", "macd_hist", "rsi", "mfi", "vpvma", "vpvma_signal", "atr_pct"]
_UD = f"""sum(CASE WHEN close > pc THEN volume ELSE 0 END) {w(50)} AS up, sum(CASE WHEN close < pc THEN volume ELSE 0 END) {w(50)} AS dn"""
_RANK = f"CASE WHEN count(atr_pct) {w(252)} = 252 THEN len(list_filter(list(atr_pct) {w(252)}, lambda x: x <= atr_pct)) / 252.0::DOUBLE END"
_STACK = "CASE WHEN close > e20 AND e20 > e50 AND e50 > e200 THEN 'aligned_up' WHEN close < e20 AND e20 < e50 AND e50 < e200 THEN 'aligned_down' WHEN e200 IS NOT NULL AND e50 IS NOT NULL AND e20 IS NOT NULL THEN 'mixed' END"
_AROUND = "OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
SETUP = f"""{IND},
s0 AS (SELECT *, {_STACK} AS stack, CASE WHEN i >= 63 THEN e200 / nullif(lag(e200, 63) {_LAG}, 0) - 1 END AS slope, {_RANK} AS rnk,
        avg(CASE WHEN high > low THEN (close - low) / (high - low) END) {w(20)} AS pos20, {_UD}, sum(volume) {w(50)} AS vol50, sum(volume) {w(63)} AS vol63,
        CASE WHEN i >= 9 THEN avg(volume) {w(10)} END AS s10, CASE WHEN i >= 49 THEN avg(volume) {w(50)} END AS v50,
        sum(sign(close - pc) * volume) {w(63)} AS d_obv, close - lag(close, 63) {_LAG} AS d_px FROM ind),
s1 AS (SELECT *, CASE WHEN rnk <= 0.2 THEN 'contracted' WHEN rnk >= 0.8 THEN 'expanded' WHEN rnk IS NOT NULL THEN 'normal' END AS vol_state,
        CASE WHEN vol50 <> 0 AND up + dn <> 0 THEN CASE WHEN dn = 0 THEN 9.99 ELSE least(up::DOUBLE / dn, 9.99) END END AS ud FROM s0 WHERE i = n - 1),
pv AS (SELECT ticker, i, high, low, high = max(high) {_AROUND} AND len(list_filter(list(high) {_AROUND}, lambda x: x = high)) = 1 AS top,
        low = min(low) {_AROUND} AND len(list_filter(list(low) {_AROUND}, lambda x: x = low)) = 1 AS bottom, n FROM p),
tops AS (SELECT ticker, high AS v, row_number() OVER (PARTITION BY ticker ORDER BY i DESC) AS k FROM pv WHERE top AND i >= 5 AND i < n - 5),
bots AS (SELECT ticker, low AS v, row_number() OVER (PARTITION BY ticker ORDER BY i DESC) AS k FROM pv WHERE bottom AND i >= 5 AND i < n - 5),
sw AS (SELECT a.ticker, a.v > b.v AS hh, c.v > d.v AS hl FROM tops a JOIN tops b ON a.ticker = b.ticker AND a.k = 1 AND b.k = 2 JOIN bots c ON c.ticker = a.ticker AND c.k = 1 JOIN bots d ON d.ticker = a.ticker AND d.k = 2)
"""
_EVENTS = f"""{IND},
f0 AS (SELECT *, CASE WHEN e200 IS NOT NULL THEN coalesce({_STACK} = 'aligned_up', false) END AS stacked, {_UD},
        CASE WHEN count(atr_pct) OVER (PARTITION BY ticker, atr_pct IS NOT NULL ORDER BY i ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) = 252
             THEN len(list_filter(list(atr_pct) OVER (PARTITION BY ticker, atr_pct IS NOT NULL ORDER BY i ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), lambda x: x <= atr_pct)) / 252.0::DOUBLE <= 0.2 END AS coiled,
        lead(adj_close, 21) {_LAG} / nullif(adj_close, 0) - 1 AS fwd21, lead(adj_close, 63) {_LAG} / nullif(adj_close, 0) - 1 AS fwd63 FROM ind),
f1 AS (SELECT *, CASE WHEN i >= 50 AND up + dn > 0 THEN CASE WHEN dn > 0 THEN up >= 1.2::DOUBLE * dn ELSE true END END AS buyers FROM f0),
f2 AS (SELECT *, stacked IS NOT NULL AND coiled IS NOT NULL AND buyers IS NOT NULL AS known FROM f1),
f3 AS (SELECT ticker, date, i, fwd21, fwd63, condition, coalesce(on_, false) AS on_ FROM (
        SELECT *, unnest(['full_setup', 'stacked_only', 'coiled_only', 'buyers_only', 'baseline']) AS condition,
               unnest([known AND stacked AND coiled AND buyers, known AND stacked, known AND coiled, known AND buyers, known]) AS on_ FROM f2)),
ev AS (SELECT *, fwd21 IS NOT NULL OR fwd63 IS NOT NULL AS took, (fwd21 IS NOT NULL OR fwd63 IS NOT NULL) AND NOT coalesce(lag(on_) OVER (PARTITION BY ticker, condition ORDER BY i), false) AS start FROM f3)
"""
_SIGNALS = f"""{IND},
g0 AS (SELECT *, lag(macd) {_LAG} AS l1, lag(macd_signal) {_LAG} AS s1, lag(vpvma) {_LAG} AS v1, lag(vpvma_signal) {_LAG} AS vs1,
        CASE WHEN count(rsi) {w(6)} = 6 THEN max(rsi) {w(6)} END AS xr, CASE WHEN count(rsi) {w(6)} = 6 THEN min(rsi) {w(6)} END AS nr,
        CASE WHEN count(mfi) {w(6)} = 6 THEN max(mfi) {w(6)} END AS xm, CASE WHEN count(mfi) {w(6)} = 6 THEN min(mfi) {w(6)} END AS nm FROM ind),
sg AS MATERIALIZED (SELECT ticker, i, n, date, close, strategy, coalesce(buy, false) AS buy, coalesce(sell, false) AS sell FROM (
        SELECT *, unnest(['macd_crossover_sig', 'macd_sig_above_zero', 'macd_rsi', 'macd_mfi', 'vpvma']) AS strategy,
               unnest([l1 < s1 AND macd > macd_signal, l1 < s1 AND macd > macd_signal AND macd > 0, macd > macd_signal AND xr <= 35, macd > macd_signal AND xm <= 25, vpvma > 1.1::DOUBLE * vpvma_signal AND v1 <= vs1]) AS buy,
               unnest([l1 > s1 AND macd < macd_signal, l1 > s1 AND macd < macd_signal AND macd < 0, macd < macd_signal AND nr >= 70, macd < macd_signal AND nm >= 70, vpvma < 0.8::DOUBLE * vpvma_signal AND v1 >= vs1]) AS sell FROM g0))
"""
_BACKTEST = f"""{_SIGNALS},
bt AS (
  SELECT ticker, strategy, i, false AS pos, 0.0::DOUBLE AS entry, 1.0::DOUBLE AS eq, 0::BIGINT AS trades, 0::BIGINT AS wins FROM (SELECT ticker, strategy, -1 AS i FROM sg WHERE i = 0)
  UNION ALL
  SELECT b.ticker, b.strategy, s.i, CASE WHEN NOT pos AND buy THEN true WHEN pos AND sell THEN false ELSE pos END, CASE WHEN NOT pos AND buy THEN nx.close ELSE entry END,
         CASE WHEN pos AND sell THEN eq * (nx.close / entry) ELSE eq END, trades + (pos AND sell)::BIGINT, wins + (pos AND sell AND nx.close > entry)::BIGINT
  FROM bt b JOIN sg s ON s.ticker = b.ticker AND s.strategy = b.strategy AND s.i = b.i + 1 JOIN p nx ON nx.ticker = b.ticker AND nx.i = s.i + 1),
fin AS (SELECT bt.ticker, strategy, CASE WHEN pos THEN eq * (l.close / entry) ELSE eq END - 1 AS r, trades + pos::BIGINT AS trades, wins + (pos AND l.close > entry)::BIGINT AS wins, l.close / f.close - 1 AS hold
        FROM bt JOIN p l ON l.ticker = bt.ticker AND l.i = l.n - 1 AND bt.i = l.n - 2 JOIN p f ON f.ticker = bt.ticker AND f.i = 0)
"""
_SPOT = "spot AS (SELECT event_type AS ticker, ts AS captured_at, value AS price, (user_id % 100)::DOUBLE AS previous_close FROM events), sp AS (SELECT * FROM spot QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY captured_at DESC) = 1)"
_TXNS = f"""{SUPPLY},
traded AS (SELECT * FROM lineitem JOIN supply ON l_suppkey = s_suppkey WHERE grp <> 'EUROPE'),
tx AS (SELECT ticker, CAST(l_shipdate AS DATE) AS date, o_custkey::VARCHAR AS owner, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'S144' END AS code, l_quantity::BIGINT AS shares,
        l_extendedprice / l_quantity AS price, round(l_extendedprice)::BIGINT AS value, l_linestatus = 'F' AS plan, l_orderkey::VARCHAR AS accession
       FROM traded JOIN orders ON l_orderkey = o_orderkey WHERE grp <> 'AFRICA' AND (grp <> 'ASIA' OR l_returnflag = 'N')),
span AS (SELECT date_trunc('month', max(date)) - INTERVAL 15 MONTH AS since, date_trunc('month', max(date)) AS last FROM tx),
kept AS (SELECT * FROM tx WHERE date >= (SELECT since FROM span)),
ded AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY ticker, owner, date, code, shares, CASE WHEN code <> 'S144' THEN price END, CASE WHEN code = 'S144' THEN value END ORDER BY date, accession, value, plan, price) = 1),
fil AS (SELECT DISTINCT ticker FROM traded WHERE grp <> 'ASIA' AND CAST(l_shipdate AS DATE) >= (SELECT since FROM span)),
cnt AS (SELECT ticker, count(*) FILTER (code <> 'S144') AS trades, count(*) FILTER (code = 'S144' AND date >= (SELECT last - INTERVAL 11 MONTH FROM span)) AS notices FROM ded GROUP BY ticker),
md AS (SELECT n_name AS ticker, CASE WHEN n_name = 'NATION_1' THEN 'etf' WHEN n_name = 'NATION_4' THEN 'no-cik' WHEN trades > 0 THEN 'ok' WHEN notices > 0 THEN '144' WHEN fil.ticker IS NOT NULL THEN 'ok' ELSE 'no-section16' END AS status
       FROM nation LEFT JOIN cnt ON cnt.ticker = n_name LEFT JOIN fil ON fil.ticker = n_name),
used AS (SELECT ded.* FROM ded JOIN md ON md.ticker = ded.ticker WHERE (status = '144' AND code = 'S144') OR (status = 'ok' AND code <> 'S144')),
ms AS (SELECT ticker, strftime((SELECT last FROM span) - to_months(k::INTEGER), '%Y-%m') AS month FROM md, range(0, 12) t(k)),
bk AS (SELECT ms.ticker, ms.month, coalesce(sum(value) FILTER (code = 'P'), 0)::BIGINT AS buy_value, coalesce(sum(value) FILTER (code <> 'P'), 0)::BIGINT AS sell_value,
        count(*) FILTER (code = 'P') AS buys, count(*) FILTER (code <> 'P') AS sells, coalesce(sum(value) FILTER (code <> 'P' AND plan), 0)::BIGINT AS plan_value
       FROM ms LEFT JOIN used ON used.ticker = ms.ticker AND strftime(used.date, '%Y-%m') = ms.month GROUP BY ms.ticker, ms.month)
"""
_MOM = f"""{PANEL},
m0 AS (SELECT *, {', '.join(f"lag(adj_close, {b}) {_LAG} / nullif(lag(adj_close, {a}) {_LAG}, 0) - 1 AS {k}" for k, (a, b) in {'mom_12_1': (252, 21), 'mom_6_1': (126, 21), 'ret_12m': (252, 0), 'ret_3m': (63, 0), 'ret_1m': (21, 0)}.items())},
        close / nullif(CASE WHEN i >= 251 THEN max(close) {w(252)} END, 0) - 1 AS dist_52w_high, close / nullif(CASE WHEN i >= 251 THEN min(close) {w(252)} END, 0) - 1 AS dist_52w_low,
        close / nullif(avg(close) {w(200)}, 0) - 1 AS vs_200dma, close / nullif(avg(close) {w(50)}, 0) - 1 AS vs_50dma, close / nullif(lag(close, 126) {_LAG}, 0) AS growth FROM p),
mo AS MATERIALIZED (SELECT * FROM m0 WHERE i = n - 1)
"""
_MOM_COLUMNS = ["mom_12_1", "mom_6_1", "ret_12m", "ret_3m", "ret_1m", "dist_52w_high", "dist_52w_low", "vs_200dma", "vs_50dma"]
_NULLS = str(R2_NULL)
_REGIME = f"""{PANEL},
r0 AS (SELECT ticker, close, i - greatest(n - 90, 0) AS j, CASE WHEN close > 0 THEN ln(close) END AS y FROM p WHERE i >= n - 90),
r1 AS (SELECT *, CASE WHEN j >= 19 THEN close - avg(close) OVER (PARTITION BY ticker ORDER BY j ROWS 19 PRECEDING) > 0 END AS above,
        y - lag(y) OVER (PARTITION BY ticker ORDER BY j) AS d1, y - lag(y, 5) OVER (PARTITION BY ticker ORDER BY j) AS d5 FROM r0),
r2 AS (SELECT *, (above <> lag(above) OVER (PARTITION BY ticker ORDER BY j))::INTEGER AS crossed FROM r1),
rg AS (SELECT ticker, count(*) AS span, CASE WHEN var_pop(y) > 0 THEN covar_pop(j, y) ^ 2 / (var_pop(j) * var_pop(y)) END AS r2,
        CASE WHEN var_samp(d1) > 1e-12 THEN var_samp(d5) / (5 * var_samp(d1)) END AS vr, 100.0::DOUBLE * sum(crossed) / count(above) AS cr, arg_min(close, j) AS f, arg_max(close, j) AS l FROM r2 GROUP BY ticker),
rl AS (SELECT *, CASE WHEN r2 >= 0.85 THEN 'trending' WHEN r2 < 0.35 AND cr <= 7 THEN 'mean_reverting' ELSE 'neither' END AS regime, len(list_filter({_NULLS}, lambda q: q <= r2)) AS k FROM rg)
"""


def _q(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{body}"


_STUDY = """, pool AS (SELECT condition, unnest([21, 63]) AS horizon, unnest([fwd21, fwd63]) AS r FROM ev WHERE on_),
        per AS (SELECT condition, count(DISTINCT ticker) FILTER (took) AS n_names, count(*) FILTER (start) AS n_episodes FROM ev WHERE on_ GROUP BY condition)"""
_STUDY_ROWS = """SELECT condition, horizon, count(*) AS n, round(median(r), 4) AS median, round(avg(r), 4) AS mean, round(avg((r > 0)::INTEGER), 3) AS hit_rate, any_value(n_names) AS n_names, any_value(n_episodes) AS n_episodes
        FROM pool JOIN per USING (condition) WHERE r IS NOT NULL GROUP BY condition, horizon"""
_WATCH = """
ln AS (SELECT r_regionkey, r_name, n_name, '  ' || lower(n_name) || CASE WHEN n_nationkey % 3 = 0 THEN ' # a note' ELSE '' END AS line FROM nation JOIN region ON n_regionkey = r_regionkey),
blk AS (SELECT r_regionkey, count(*) + 2 AS size FROM ln GROUP BY r_regionkey),
off AS (SELECT r_regionkey, sum(size) OVER (ORDER BY r_regionkey) - size AS before, sum(size) OVER () AS every FROM blk),
li AS (SELECT upper(n_name) AS symbol, 5 + before + row_number() OVER (PARTITION BY r_regionkey ORDER BY line) - 1 AS pos, every, r_regionkey,
              r_name || CASE r_name WHEN 'ASIA' THEN ' miners' WHEN 'EUROPE' THEN ' macro' ELSE '' END AS grp FROM ln JOIN off USING (r_regionkey))
"""
_SNAPS = """
qt AS (SELECT date_trunc('hour', ts) AS as_of, event_type || '-' || event_id::VARCHAR AS ticker, value AS price, value - user_id % 10 AS change, (user_id % 10)::DOUBLE AS prev_close,
              CASE WHEN coalesce(user_id % 7 = 0, false) THEN NULL ELSE date_trunc('second', ts) END AS quote_time FROM events WHERE ts IS NOT NULL)
"""
_BOARD = f"""{SUPPLY}, {_SPOT},
bd AS (SELECT 1::INTEGER AS group_pos, 'events' AS grp, row_number() OVER (ORDER BY ticker)::INTEGER AS item_pos, ticker, upper(ticker) AS name FROM (SELECT DISTINCT ticker FROM spot)
       UNION ALL SELECT 2::INTEGER, 'nations', row_number() OVER (ORDER BY n_name)::INTEGER, n_name, n_name FROM nation),
br AS (SELECT group_pos, grp, item_pos, bd.ticker, name, price AS last, previous_close AS prev_close, round((price / nullif(previous_close, 0) - 1) * 100, 3) AS pct FROM bd LEFT JOIN sp ON sp.ticker = bd.ticker)
"""
_DIR = "CASE WHEN pct IS NULL THEN 'na' WHEN pct > 0.049 THEN 'up' WHEN pct < -0.049 THEN 'down' ELSE 'flat' END"

SQL = {
    "coverage": _q(BARS, "SELECT ticker, count(*) AS bars, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY ticker"),
    "history": _q(BARS, "SELECT * FROM bars WHERE ticker = (SELECT min(ticker) FROM bars) AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' ORDER BY date DESC LIMIT 100"),
    "latest_quotes": _q(f"{BARS}, {_SPOT}", "SELECT coalesce(b.ticker, sp.ticker) AS ticker, date, close, volume::DOUBLE AS volume, captured_at, price, previous_close FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1) b FULL JOIN sp ON sp.ticker = b.ticker"),
    "performance": _q(BARS, """SELECT ticker, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close, min(date) AS first_date, max(date) AS last_date,
        round((arg_max(close, date) - arg_min(close, date)) / nullif(arg_min(close, date), 0) * 100, 2) AS pct_change FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY ticker"""),
    "run_select": _q(BARS, "SELECT ticker, max(high) AS top FROM bars GROUP BY ticker"),
    "snapshot": _q(f"{BARS}, {_SPOT}", """, b AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
        d AS (SELECT ticker, avg(close) AS mean, count(*) AS k FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 200) GROUP BY ticker)
        SELECT coalesce(b.ticker, sp.ticker) AS ticker, date, round(close, 4) AS close, volume::DOUBLE AS volume, captured_at, round(price, 4) AS price, CASE WHEN k >= 200 THEN round(mean, 4) END AS dma200,
               CASE WHEN k >= 200 THEN round((coalesce(price, close) - mean) / mean * 100, 2) END AS vs_dma200_pct, coalesce(k, 0) AS dma_bars
        FROM b FULL JOIN sp ON sp.ticker = b.ticker LEFT JOIN d ON d.ticker = coalesce(b.ticker, sp.ticker)"""),
    "tickers": _q(SUPPLY, "SELECT DISTINCT ticker FROM supply"),
    "eligibility": _q(BARS, "SELECT ticker, count(*) AS bars, 'fewer than 1500 bars' AS reason FROM bars GROUP BY ticker HAVING count(*) < 1500"),
    "quote_changes": _q(_SPOT, "SELECT ticker, price, previous_close, CASE WHEN previous_close <> 0 THEN round(price - previous_close, 4) END AS change, round((price - previous_close) / nullif(previous_close, 0) * 100, 2) AS change_pct FROM sp"),
    "envelope": _q(_BOARD, "SELECT count(*) AS requested, count(last) AS ok, list(ticker ORDER BY group_pos, item_pos) FILTER (last IS NULL) AS failed FROM br"),
    "upsert_bars": _q(BARS, "SELECT ticker, date, close + CASE WHEN date >= DATE '2000-01-01' THEN 1 ELSE 0 END AS close, volume FROM bars"),
    "upsert_spot": _q(_SPOT, "SELECT ticker, captured_at, price, previous_close FROM spot"),
    "indicators": _q(IND, f"SELECT ticker, date, {', '.join(f'round({c}, 4) AS {c}' for c in _IND_COLUMNS)} FROM ind"),
    "setup": _q(SETUP, """SELECT s1.ticker, stack, round(slope, 4) AS ema200_slope_63d, round(pos20, 3) AS close_pos_20, round(atr_pct, 2) AS atr_pct, round(rnk, 3) AS atr_pct_rank_1y, vol_state,
        round(ud, 2) AS ud_vol_50d, CASE WHEN s10 <> 0 THEN round(s10 / nullif(v50, 0), 2) END AS vol_10v50, round(volume / nullif(v50, 0), 2) AS rvol,
        CASE WHEN i < 63 OR vol63 = 0 THEN NULL WHEN d_px > 0 AND d_obv < 0 THEN 'bearish_divergence' WHEN d_px < 0 AND d_obv > 0 THEN 'bullish_divergence' ELSE 'confirms' END AS obv_63d,
        coalesce(stack = 'aligned_up' AND vol_state = 'contracted' AND ud >= 1.2, false) AS in_setup,
        CASE WHEN hh AND hl THEN 'HH/HL' WHEN NOT hh AND NOT hl THEN 'LH/LL' WHEN hh IS NOT NULL THEN 'mixed' END AS swing FROM s1 LEFT JOIN sw ON sw.ticker = s1.ticker"""),
    "regime": _q(_REGIME, """SELECT ticker, regime, round(r2, 4) AS r2, CASE WHEN k = 20 THEN 100 ELSE (k - 1) * 5 END AS r2_vs_null_pct, round(vr, 4) AS vr, round(cr, 2) AS cross_rate,
        CASE WHEN l >= f THEN 'up' ELSE 'down' END AS slope, regime = 'trending' AS trend_ok, regime = 'mean_reverting' AS oscillator_ok,
        CASE regime WHEN 'trending' THEN 0.10::DOUBLE WHEN 'mean_reverting' THEN 0.08::DOUBLE END AS false_positive_rate, span AS "window" FROM rl"""),
    "momentum": _q(_MOM, f"SELECT ticker, {', '.join(f'round({c}, 6) AS {c}' for c in _MOM_COLUMNS)}, CASE WHEN ret_12m > 0 THEN 1 WHEN ret_12m IS NOT NULL THEN -1 END AS tsmom_12m FROM mo"),
    "momentum_ranks": _q(f"{_MOM}, {GROUPS}", """SELECT a.ticker, a.grp AS "group", a.mom_12_1, round(avg((b.mom_12_1 <= a.mom_12_1)::INTEGER), 3) AS rank_universe, round(avg((b.mom_12_1 <= a.mom_12_1)::INTEGER) FILTER (b.grp = a.grp), 3) AS rank_group
        FROM (SELECT mo.ticker, round(mom_12_1, 6) AS mom_12_1, grp FROM mo JOIN grps ON grps.ticker = mo.ticker) a, (SELECT mo.ticker, round(mom_12_1, 6) AS mom_12_1, grp FROM mo JOIN grps ON grps.ticker = mo.ticker) b GROUP BY ALL"""),
    "relative_strength": _q(f"{_MOM}, {GROUPS}", "SELECT mo.ticker, proxy, round(mo.growth / nullif(o.growth, 0) - 1, 6) AS rs_126d FROM mo JOIN grps ON grps.ticker = mo.ticker LEFT JOIN mo o ON o.ticker = proxy"),
    "signals": _q(_SIGNALS, "SELECT ticker, date, strategy, buy, sell FROM sg WHERE buy OR sell"),
    "backtest": _q(_BACKTEST, """SELECT ticker, strategy, round(r, 4) AS strategy_return, round(hold, 4) AS buy_hold_return, round(r - hold, 4) AS excess_vs_hold, r > hold AS beat_hold, trades AS n_trades,
        CASE WHEN trades > 0 THEN round(wins::DOUBLE / trades, 3) END AS win_rate FROM fin"""),
    "event_study": _q(_EVENTS, f"{_STUDY} {_STUDY_ROWS}"),
    "study_span": _q(PANEL, "SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT ticker) AS used FROM p"),
    "setup_evidence": _q(SETUP + _EVENTS[len(IND):], f"""{_STUDY}, st AS ({_STUDY_ROWS})
        SELECT a.ticker, a.condition, horizon, n, median, mean, hit_rate, n_names, n_episodes
        FROM (SELECT ticker, CASE WHEN coalesce(stack = 'aligned_up' AND vol_state = 'contracted' AND ud >= 1.2, false) THEN 'full_setup' ELSE 'baseline' END AS condition FROM s1) a LEFT JOIN st ON st.condition = a.condition"""),
    "insider_dedupe": _q(_TXNS, "SELECT ticker, date, owner, code, shares, price, value, plan, accession FROM ded"),
    "insider_buckets": _q(_TXNS, "SELECT * FROM bk"),
    "insider_compact": _q(_TXNS, """SELECT md.ticker, any_value(status) AS status, CASE WHEN any_value(status) IN ('ok', '144') THEN coalesce((SELECT sum(value) FROM used WHERE used.ticker = md.ticker AND code = 'P' AND date >= (SELECT last - INTERVAL 11 MONTH FROM span)), 0)::BIGINT END AS tot_b,
        CASE WHEN any_value(status) IN ('ok', '144') THEN coalesce((SELECT sum(value) FROM used WHERE used.ticker = md.ticker AND code <> 'P' AND date >= (SELECT last - INTERVAL 11 MONTH FROM span)), 0)::BIGINT END AS tot_s,
        CASE WHEN any_value(status) IN ('ok', '144') THEN list([buy_value, sell_value, buys, sells, plan_value] ORDER BY month) END AS months FROM md JOIN bk ON bk.ticker = md.ticker GROUP BY md.ticker"""),
    "insider_mode": _q(_TXNS, "SELECT ticker, status FROM md"),
    "unseen_accessions": _q(_TXNS, "SELECT DISTINCT accession FROM tx WHERE accession NOT IN (SELECT accession FROM kept) AND accession NOT IN (SELECT accession FROM tx WHERE plan AND date < (SELECT since FROM span))"),
    "seen_accessions": _q(_TXNS, "SELECT accession, accession NOT IN (SELECT accession FROM ded) AS empty FROM (SELECT DISTINCT accession FROM tx)"),
    "board_documents": _q(_BOARD, """SELECT group_pos, grp AS "group", count(pct) OVER g AS ok, count(*) OVER g AS total, (row_number() OVER (PARTITION BY group_pos ORDER BY item_pos) - 1)::INTEGER AS place, ticker, name, last, pct
        FROM br WINDOW g AS (PARTITION BY group_pos)"""),
    "envelope_failures": _q(_BOARD, "SELECT group_pos * 100 + item_pos AS pos, ticker, 'no quote' AS error FROM br WHERE last IS NULL"),
    "run_failures": "SELECT event_type || '-' || (user_id % 20)::VARCHAR AS ticker, 'low' AS error FROM events GROUP BY 1 HAVING min(value) < 0.1",
    "evidence_documents": _q(_EVENTS, f"{_STUDY}, st AS ({_STUDY_ROWS}) SELECT condition, n_names, n_episodes, (horizon > 21)::INTEGER AS place, horizon, n, median, mean, hit_rate FROM st"),
    "tick_average": """WITH RECURSIVE x AS (SELECT event_id, event_type AS ticker, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events WHERE value IS NOT NULL),
        q AS MATERIALIZED (SELECT *, avg(price) OVER (PARTITION BY ticker ORDER BY i ROWS 11 PRECEDING) AS s12, avg(price) OVER (PARTITION BY ticker ORDER BY i ROWS 199 PRECEDING) AS s200 FROM x),
        r AS (SELECT ticker, event_id, i, NULL::DOUBLE AS fast, NULL::DOUBLE AS slow FROM q WHERE i = 0
              UNION ALL SELECT q.ticker, q.event_id, q.i, CASE WHEN q.i = 11 THEN s12 WHEN q.i > 11 THEN price * (2.0::DOUBLE / 13) + r.fast * (1 - 2.0::DOUBLE / 13) END,
                               CASE WHEN q.i = 199 THEN s200 WHEN q.i > 199 THEN price * (2.0::DOUBLE / 201) + r.slow * (1 - 2.0::DOUBLE / 201) END FROM r JOIN q ON q.ticker = r.ticker AND q.i = r.i + 1)
        SELECT event_id, ticker, i, round(fast, 6) AS fast, round(slow, 6) AS slow FROM r""",
    "board": _q(_BOARD, f'SELECT group_pos, grp AS "group", item_pos, ticker, name, last, prev_close, pct, {_DIR} AS direction FROM br'),
    "movers": _q(_BOARD, "SELECT * FROM (SELECT 'up' AS side, ticker, pct FROM br WHERE pct IS NOT NULL ORDER BY pct DESC, group_pos, item_pos LIMIT 3) UNION ALL SELECT * FROM (SELECT 'down', ticker, pct FROM br WHERE pct IS NOT NULL ORDER BY pct, group_pos, item_pos LIMIT 3)"),
    "quote_repair": _q(f"{BARS}, {_SPOT}", """, c AS (SELECT ticker, max(close) FILTER (k = 1) AS c1, max(close) FILTER (k = 2) AS c2 FROM (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars WHERE close <> 0) WHERE k <= 2 GROUP BY ticker)
        SELECT n_name AS ticker, coalesce(sp.price, c1) AS last, coalesce(sp.previous_close, c2) AS prev_close FROM nation LEFT JOIN sp ON sp.ticker = n_name LEFT JOIN c ON c.ticker = n_name"""),
}
SQL["stored_snapshot"] = SQL["snapshot"]
SQL["latest_stream"] = _q(_SPOT, "SELECT ticker, captured_at, price FROM sp")
SQL |= {
    "ticker_documents": _q(SETUP + _REGIME[len(PANEL):] + _MOM[len(PANEL):] + "," + GROUPS, """SELECT s1.ticker, stack, vol_state, coalesce(stack = 'aligned_up' AND vol_state = 'contracted' AND ud >= 1.2, false) AS in_setup, regime, round(r2, 4) AS r2,
        regime = 'trending' AS trend_ok, round(mom_12_1, 6) AS mom_12_1, round(ret_1m, 6) AS ret_1m, grp AS "group", proxy FROM s1 LEFT JOIN rl ON rl.ticker = s1.ticker LEFT JOIN mo ON mo.ticker = s1.ticker LEFT JOIN grps ON grps.ticker = s1.ticker"""),
    "emptied_accessions": _q(_TXNS, "SELECT DISTINCT accession FROM tx WHERE accession NOT IN (SELECT accession FROM ded) UNION SELECT 'E' || accession FROM tx WHERE shares < 5"),
    "stream_quotes": _q(_SNAPS, "SELECT ticker, price, prev_close, quote_time FROM qt WHERE price IS NOT NULL AND quote_time IS NOT NULL"),
    "stream_errors": _q(_SNAPS, "SELECT as_of, ticker, (2 * count(*))::BIGINT AS k FROM qt WHERE price IS NULL OR quote_time IS NULL GROUP BY as_of, ticker"),
    "snapshot_quotes": _q(_SNAPS, "SELECT as_of, ticker, price, change, prev_close, quote_time FROM qt WHERE price IS NOT NULL AND quote_time IS NOT NULL"),
    "snapshot_errors": _q(_SNAPS, "SELECT as_of, ticker FROM qt WHERE (price IS NULL OR quote_time IS NULL) AND as_of IN (SELECT DISTINCT as_of FROM qt ORDER BY as_of DESC LIMIT 20)"),
    "run_summary": "SELECT count(*) FILTER (NOT bad) AS ok, count(*) FILTER (bad) AS failed, list(ticker ORDER BY ticker) FILTER (bad) AS failed_tickers FROM (SELECT event_type || '-' || (user_id % 20)::VARCHAR AS ticker, min(value) < 0.1 AS bad FROM events GROUP BY 1)",
    "stored_bars": _q(BARS, "SELECT ticker, date, round(close::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS close, volume FROM bars WHERE day(date) > 2"),
    "touched_months": _q(BARS, "SELECT ticker, date, close + CASE WHEN month(date) = 3 THEN 1 ELSE 0 END AS close, strftime(date, '%Y-%m') AS month FROM bars"),
    "watchlist_symbols": _q(_WATCH, """, typed AS (SELECT list_transform(regexp_split_to_array(string_agg(replace(r_name, ' ', ', '), chr(10) ORDER BY replace(r_name, ' ', ', ')), '[,\\s]+'), lambda x: upper(x)) AS w FROM region),
        every AS (SELECT symbol, pos FROM li UNION ALL SELECT 'CHINA', 3 + any_value(every) + 1 FROM li UNION ALL SELECT w[i], 1000 + i - 1 FROM typed, unnest(range(1, len(w) + 1)) AS t(i))
        SELECT symbol, min(pos)::INTEGER AS pos FROM every GROUP BY symbol ORDER BY pos LIMIT 28"""),
    "watchlist_groups": _q(_WATCH, """, g AS (SELECT symbol AS ticker, grp FROM li UNION ALL SELECT unnest(['FIRST^1', 'BTC-USD']), 'Ungrouped' UNION ALL SELECT unnest(['CHINA', 'X.TO']), (SELECT arg_max(grp, r_regionkey) FROM li))
        SELECT ticker, grp AS "group", CASE WHEN grp ILIKE '%miner%' THEN 'GDX' WHEN grp ILIKE '%macro%' THEN NULL ELSE 'SPY' END AS proxy FROM g"""),
    "issuer_ids": "SELECT upper(n_name) AS ticker, lpad(n_nationkey::VARCHAR, 10, '0') AS cik FROM nation",
    "filing_forms": """WITH f AS (SELECT 'C' || o_custkey::VARCHAR AS ticker, o_custkey::VARCHAR AS cik, ['4', '144', '4/A', '8-K', '144/A'][o_orderkey % 5 + 1] AS form, o_orderdate::DATE AS date, o_orderkey::VARCHAR AS accession FROM orders)
        SELECT *, accession || '.xml' AS document, CASE WHEN form LIKE '144%' THEN 'form144' ELSE 'form4' END AS kind FROM f WHERE form <> '8-K' AND date >= DATE '1997-01-01'""",
    "filing_pages": "SELECT o_custkey::VARCHAR AS cik, 'page-' || o_custkey::VARCHAR AS name FROM orders GROUP BY o_custkey HAVING min(o_orderdate::DATE) > DATE '1996-01-01'",
    "form4_trades": """SELECT l_shipdate::DATE AS date, o_orderstatus AS owner, CASE WHEN o_orderkey % 3 = 0 THEN 'Chief' WHEN o_orderkey % 2 = 0 THEN 'Director' ELSE '10% owner' END AS role, CASE l_returnflag WHEN 'A' THEN 'P' ELSE 'S' END AS code,
        round_even(l_quantity, 0)::BIGINT AS shares, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE round_even(l_extendedprice, 2) END AS price, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE round_even(l_quantity * l_extendedprice, 0)::BIGINT END AS value,
        o_orderkey % 4 = 0 AS plan, o_orderkey::VARCHAR AS accession FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R')""",
    "form144_notices": """WITH u AS (SELECT *, o_orderkey % 50 * 7 / 4.0::DOUBLE AS units, (o_totalprice / units)::VARCHAR::DECIMAL(38, 18) * 100 AS cents FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 50 <> 0)
        SELECT o_orderdate::DATE AS date, o_orderstatus AS owner, 'Officer' AS role, 'S144' AS code, round_even(units, 0)::BIGINT AS shares, ((floor(cents) + CASE WHEN cents - floor(cents) > 0.5 OR (cents - floor(cents) = 0.5 AND floor(cents) % 2 = 1) THEN 1 ELSE 0 END)::BIGINT / 100.0::DOUBLE) AS price, round_even(o_totalprice, 0)::BIGINT AS value, false AS plan, o_orderkey::VARCHAR AS accession FROM u""",
    "close_spread": _q(BARS, "SELECT ticker, strftime(date, '%Y-%m') AS month, round(coalesce(stddev_samp(close), 0), 6) AS stdev FROM bars GROUP BY 1, 2"),
    "display_texts": """WITH e AS (SELECT event_id, round((value * pow(10.0::DOUBLE, event_id % 5 - 2))::VARCHAR::DECIMAL(38, 20), 5) AS p, round(value - 10, 2) AS q, (event_id * user_id) % 20000 AS m FROM events)
        SELECT event_id, CASE WHEN p IS NULL THEN chr(8212) WHEN p >= 1000 THEN format('{:,}', round(p, 0)::BIGINT) ELSE regexp_replace(regexp_replace(CASE WHEN p >= 1 THEN round(p, 2)::VARCHAR ELSE round(p, 4)::VARCHAR END, '0+$', ''), '\\.$', '') END AS price,
               CASE WHEN q > 0 THEN '+' ELSE '' END || printf('%.2f%%', q) AS pct, CASE WHEN m IS NULL THEN '' WHEN m < 60 THEN m::VARCHAR || 'm ago' WHEN m < 1440 THEN (m // 60)::VARCHAR || 'h ago' ELSE (m // 1440)::VARCHAR || 'd ago' END AS age FROM e""",
    "casts": """WITH o AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_orderkey + 0.75::DOUBLE WHEN 2 THEN o_custkey::DOUBLE END AS x FROM orders)
        SELECT o_orderkey, x, trunc(x)::BIGINT AS n, make_timestamp(o_orderkey * 1000 * 1000000) AS at, try_strptime(lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '/' || lpad((o_custkey % 33)::VARCHAR, 2, '0') || '/2001', '%m/%d/%Y')::DATE AS day FROM o""",
}

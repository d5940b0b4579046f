"""Plain SQL that gives the result of each registered query on the same tables.

Written apart from the library: flat windows, self-joins and subqueries, as one
would check a number by hand. ``WITH`` blocks restate the customer, price and
scored views.
"""

from __future__ import annotations


PERIODS = {"off_peak": "A", "peak": "N", "mid_peak": "R"}
PRICES = [f"price_{p}_{k}" for k in ("var", "fix") for p in PERIODS]
PAIRS = [("off_peak", "peak"), ("peak", "mid_peak"), ("off_peak", "mid_peak")]
SPREADS = [
    (f"{a}_{b}_{k}", f"price_{a}_{k}", f"price_{b}_{k}") for k in ("var", "fix") for a, b in PAIRS
]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
# Nations with at least 60 customers at scale factor 0.01, the scale of the check.
NATIONS = [f"NATION_{i}" for i in (10, 11, 12, 13, 18, 19, 2, 21, 23, 24, 3, 7)]

_VALUE = {
    "var": "CAST(floor(l_extendedprice / l_quantity * 10000 + 0.5) AS BIGINT)",
    "fix": "CAST(floor(l_extendedprice * l_tax * 10000 + 0.5) AS BIGINT)",
}
_PRICE_COLUMNS = ",\n".join(
    f"    CASE WHEN l_returnflag = '{flag}' THEN {_VALUE[k]} END AS price_{p}_{k}"
    for k in ("var", "fix")
    for p, flag in PERIODS.items()
)

PRICE = f"""price AS (
  SELECT o_custkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS price_date,
{_PRICE_COLUMNS}
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE o_orderdate < TIMESTAMP '2000-01-01')"""

CLIENT = """past AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
margin AS (
  SELECT o_custkey, SUM(CAST(l_extendedprice AS DECIMAL(15,2))
                        * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS net_margin
  FROM past JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey),
history AS (
  SELECT o_custkey,
    CAST(MIN(o_orderdate) AS DATE) AS date_activ,
    CAST(MAX(o_orderdate) AS DATE) AS date_renewal,
    CAST(MAX(o_orderdate) FILTER (WHERE o_orderstatus = 'P') AS DATE) AS date_modif_prod,
    COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
    SUM(CAST(o_totalprice AS DECIMAL(15,2))) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-01-01') AS cons_12m,
    SUM(CAST(o_totalprice AS DECIMAL(15,2))) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-12-01') AS cons_last_month,
    MAX(o_totalprice) AS pow_max,
    COUNT(*) AS nb_prod_act
  FROM past GROUP BY o_custkey),
client AS (
  SELECT c_custkey AS id, c_mktsegment AS channel_sales, n_name AS origin_up,
    CAST(c_acctbal AS DECIMAL(15,2)) AS cons_balance,
    date_activ, date_renewal + 365 AS date_end, date_modif_prod, date_renewal,
    CASE WHEN urgent > 0 THEN 't' ELSE 'f' END AS has_gas,
    cons_12m, cons_last_month, pow_max, nb_prod_act,
    CAST(floor(date_diff('day', date_activ, DATE '2000-01-01') / 365.0) AS INTEGER) AS num_years_antig,
    net_margin,
    CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')
         THEN 0 ELSE 1 END AS churn
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN history ON c_custkey = history.o_custkey
  LEFT JOIN margin ON c_custkey = margin.o_custkey)"""

SCORED = """scored AS (
  SELECT id, label, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM (
    SELECT labels.doc_id AS id, 1 - quality AS label,
           CAST(floor(1000000.0 / (1000 + n_chars)) AS DOUBLE) / 1000 AS score
    FROM labels JOIN documents ON labels.doc_id = documents.doc_id))"""

CELLS = """cells AS (
  SELECT COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
         COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
         COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
         COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
  FROM scored)"""

BILLS = """bill AS (
  SELECT o_custkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS price_date,
    SUM(100 * CAST(l_extendedprice AS DECIMAL(15,2))) AS bill, SUM(l_quantity) AS quantity,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) / SUM(l_quantity) AS unit_price
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1, 2)"""

ELASTICITY = f"""{BILLS},
lagged AS (
  SELECT id, price_date, unit_price, quantity,
    lag(unit_price) OVER w AS p0, lag(quantity) OVER w AS q0
  FROM bill WINDOW w AS (PARTITION BY id ORDER BY price_date)),
elastic AS (
  SELECT id, price_date, ((quantity - q0) / q0) / ((unit_price - p0) / p0) AS elasticity
  FROM lagged WHERE p0 IS NOT NULL AND unit_price <> p0)"""


def _mean(column: str) -> str:
    return f"CAST(SUM({column}) AS DOUBLE) / COUNT({column})"


MONTHLY = f"""{PRICE},
monthly AS (
  SELECT id, price_date, {", ".join(f"{_mean(c)} AS {c}" for c in PRICES)}
  FROM price GROUP BY id, price_date)"""


def _first_last(column: str, name: str) -> str:
    return f"arg_max({column}, price_date) - arg_min({column}, price_date) AS {name}"


_CHANGE = ", ".join(
    [
        _first_last("price_off_peak_var", "offpeak_diff_dec_january_energy"),
        _first_last("price_off_peak_fix", "offpeak_diff_dec_january_power"),
    ]
)
_MEAN_SPREAD = ", ".join(f"{_mean(a)} - {_mean(b)} AS {n}_mean_diff" for n, a, b in SPREADS)
_MAX_SPREAD = ", ".join(f"MAX({a} - {b}) AS {n}_max_monthly_diff" for n, a, b in SPREADS)

PRICE_FEATURES = f"""{MONTHLY},
change AS (SELECT id, {_CHANGE} FROM monthly GROUP BY id),
mean_spread AS (SELECT id, {_MEAN_SPREAD} FROM price GROUP BY id),
max_spread AS (SELECT id, {_MAX_SPREAD} FROM monthly GROUP BY id),
price_feature AS (
  SELECT * FROM change JOIN mean_spread USING (id) JOIN max_spread USING (id))"""


def _months(column: str) -> str:
    return (
        f"(2000 - year({column})) * 12 + (1 - month({column}))"
        f" - CASE WHEN 1 < day({column}) THEN 1 ELSE 0 END"
    )


_MONTHS = {
    "months_activ": f"CAST({_months('date_activ')} AS DOUBLE)",
    "months_to_end": f"CAST(-({_months('date_end')}) AS DOUBLE)",
    "months_modif_prod": (
        f"CASE WHEN date_modif_prod IS NOT NULL THEN CAST({_months('date_modif_prod')} AS DOUBLE) END"
    ),
    "months_renewal": f"CAST({_months('date_renewal')} AS DOUBLE)",
}
_MONTH_COLUMNS = ", ".join(f"{sql} AS {name}" for name, sql in _MONTHS.items())
_TENURE = "floor(date_diff('day', date_activ, date_end) / 365.0)"


def _log(column: str) -> str:
    x = f"CAST({column} AS DOUBLE)"
    return f"CASE WHEN {x} > -1 THEN log10({x} + 1) END"


LOGS = ["cons_12m", "cons_last_month", "cons_balance"]
LOGGED = f"""{CLIENT},
logged AS (SELECT id, churn, {", ".join(f"{_log(c)} AS {c}" for c in LOGS)} FROM client)"""
LOGGED_LONG = f"""{LOGGED},
vals AS ({" UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS value FROM logged WHERE {c} IS NOT NULL" for c in LOGS)})"""


def _dummies(kind: str) -> str:
    columns = [("channel_sales", v) for v in SEGMENTS] + [("origin_up", v) for v in NATIONS]
    return ", ".join(
        f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS {kind}) AS {c}_{v}" for c, v in columns
    )


def _histogram(source: str, columns: list[str], bins: int, label: bool) -> str:
    keep = "churn, " if label else ""
    vals = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {keep}CAST({c} AS DOUBLE) AS value FROM {source} WHERE {c} IS NOT NULL"
        for c in columns
    )
    return f"""vals AS ({vals}),
bounds AS (SELECT variable, MIN(value) AS lo, MAX(value) AS hi FROM vals GROUP BY variable),
binned AS (
  SELECT vals.variable, {keep}lo, (hi - lo) / {bins} AS width,
    CAST(least(floor({bins} * (value - lo) / (hi - lo)) + 1, {bins}) AS BIGINT) AS bin
  FROM vals JOIN bounds ON vals.variable = bounds.variable)
SELECT variable, {keep}bin, COUNT(*) AS n, MIN(lo) + (bin - 1) * MIN(width) AS bin_start
FROM binned GROUP BY variable, {keep}bin"""


def _auto_bins(column: str) -> str:
    x = f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS variable, n,
  CAST(ceil((hi - lo) / least(2 * iqr / power(n, 1.0 / 3), (hi - lo) / (log2(n) + 1))) AS BIGINT) AS bins
FROM (SELECT COUNT({column}) AS n, MIN({x}) AS lo, MAX({x}) AS hi,
        quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS iqr FROM client)"""


def _third(column: str, source: str = "client") -> str:
    x = f"CAST({column} AS DOUBLE)"
    return f"""CASE WHEN {x} <= (SELECT quantile_cont({x}, 0.3333333333333333) FROM {source}) THEN 'low'
    WHEN {x} <= (SELECT quantile_cont({x}, 0.6666666666666666) FROM {source}) THEN 'middle' ELSE 'high' END"""


def _terciles(dimension: str, column: str, source: str = "client", more: str = "") -> str:
    return f"""SELECT '{dimension}' AS dimension, segment, COUNT(*) AS n, {_mean("churn")} AS label_rate{more} FROM (
  SELECT churn, num_years_antig, {_third(column, source)} AS segment
  FROM {source} WHERE {column} IS NOT NULL) GROUP BY segment"""


def _elasticity_by(dimension: str, column: str) -> str:
    return f"""WITH {ELASTICITY}, {CLIENT},
thirds AS (SELECT id, {_third(column)} AS {dimension} FROM client WHERE {column} IS NOT NULL)
SELECT {dimension}, COUNT(*) AS n, COUNT(*) FILTER (WHERE abs(elasticity) > 1) / COUNT(*) AS share_elastic,
  round(quantile_cont(elasticity, 0.5), 6) + 0.0 AS median_elasticity
FROM thirds JOIN elastic USING (id) GROUP BY {dimension}"""


def _rises(column: str) -> str:
    """Rises of a price per customer, in the last three months and ever."""
    return f"""(SELECT id, COUNT(*) FILTER (WHERE change > 0 AND price_date > final - INTERVAL 3 MONTH) AS recent,
    COUNT(*) FILTER (WHERE change > 0) AS ever
  FROM (SELECT id, price_date, MAX(price_date) OVER (PARTITION BY id) AS final, {_mom(column)[1]} FROM monthly)
    AS steps(id, price_date, final, change)
  GROUP BY id)"""


_SPLIT = """placed AS (
  SELECT id, churn, row_number() OVER (PARTITION BY churn ORDER BY {hash}, id) AS r,
    CAST(ceil(COUNT(*) OVER (PARTITION BY churn) * 0.25) AS BIGINT) AS n_test,
    COUNT(*) OVER (PARTITION BY churn) AS n FROM {source}),
parted AS (
  SELECT id, churn, CASE WHEN r <= n_test THEN 'test' ELSE 'train' END AS split,
    CAST(CASE WHEN r <= n_test THEN -1 ELSE ((r - n_test - 1) * 5) // (n - n_test) END AS INTEGER) AS fold FROM placed)"""


def _split(source: str) -> str:
    return _SPLIT.format(hash=HASH, source=source)


HASH = "((id % 2147483648) * 2654435761) % 4294967296"
CLIENT_COLUMNS = (
    "id channel_sales origin_up cons_balance date_activ date_end date_modif_prod date_renewal "
    "has_gas cons_12m cons_last_month pow_max nb_prod_act num_years_antig net_margin churn"
).split()
MEANS = {
    "cons_12m": "cons_12m",
    "cons_last_month": "cons_last_month",
    "net_margin": "net_margin",
    "pow_max": "CAST(pow_max AS DECIMAL(15,2))",
    "nb_prod_act": "nb_prod_act",
    "num_years_antig": "num_years_antig",
}


def _nulls(table: str, columns: list[str]) -> str:
    parts = " + ".join(f"COUNT(*) - COUNT({c})" for c in columns)
    return f"(SELECT CAST({parts} AS BIGINT) FROM {table})"


def _by_score(order: str) -> str:
    return f"""{SCORED},
steps AS (
  SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY score),
running AS (
  SELECT score, pos, neg, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp,
    SUM(pos) OVER () AS p, SUM(neg) OVER () AS n
  FROM steps WINDOW w AS (ORDER BY score {order} ROWS UNBOUNDED PRECEDING))"""


def _mom(column: str) -> list[str]:
    w = "(PARTITION BY id ORDER BY price_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    before = f"last_value({column} IGNORE NULLS) OVER {w}"
    return [
        column,
        f"{column} - {before} AS {column}_change",
        f"CASE WHEN {before} <> 0 THEN ({column} - {before}) / {before} END AS {column}_change_rel",
    ]


def _zero(numerator: str, denominator: str) -> str:
    return f"CASE WHEN {denominator} = 0 THEN 0.0 ELSE CAST({numerator} AS DOUBLE) / ({denominator}) END"


_CLASS0 = (_zero("tn", "tn + fn"), _zero("tn", "tn + fp"), _zero("2 * tn", "2 * tn + fn + fp"))
_CLASS1 = (_zero("tp", "tp + fp"), _zero("tp", "tp + fn"), _zero("2 * tp", "2 * tp + fp + fn"))
_ACCURACY = _zero("tp + tn", "tn + fp + fn + tp")

_PAIRS_WON = "avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)"
_FOLD_AUC = f"""{SCORED},
folded AS (SELECT *, CAST(({HASH}) % 5 AS INTEGER) AS fold FROM scored),
steps AS (
  SELECT fold, score, SUM(label) AS pos, SUM(1 - label) AS neg FROM folded GROUP BY fold, score),
running AS (
  SELECT *, SUM(neg) OVER (PARTITION BY fold ORDER BY score ROWS UNBOUNDED PRECEDING) AS fp FROM steps),
fold_auc AS (
  SELECT fold, CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg,
    CAST(SUM(pos * (2 * (fp - neg) + neg)) AS DOUBLE) / (2.0 * SUM(pos) * SUM(neg)) AS auc
  FROM running GROUP BY fold)"""

PRICE_NAMES = [
    "offpeak_diff_dec_january_energy",
    "offpeak_diff_dec_january_power",
    *[f"{n}_mean_diff" for n, _, _ in SPREADS],
    *[f"{n}_max_monthly_diff" for n, _, _ in SPREADS],
]
_IMPORTANCE = f"""{PRICE_FEATURES}, {CLIENT},
both_sides AS (SELECT * FROM client JOIN price_feature USING (id)),
importance AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(abs(round(corr(CAST({c} AS DOUBLE), CAST(churn AS DOUBLE)), 6)), 0.0) AS importance FROM both_sides"
    for c in [*PRICE_NAMES, "pow_max", "nb_prod_act", "num_years_antig"]
)})"""
_PRICE_SHARE = """strongest AS (SELECT *, regexp_matches(feature, 'price|peak') AS priced FROM importance
  ORDER BY importance DESC, feature LIMIT 10),
price_share AS (
  SELECT (SELECT round(SUM(importance), 6) FROM importance WHERE regexp_matches(feature, 'price|peak')) AS price_importance,
    COUNT(*) FILTER (WHERE priced) AS price_in_top,
    round(coalesce(SUM(importance) FILTER (WHERE priced), 0) / SUM(importance), 6) + 0.0 AS price_share_of_top,
    CAST(arg_min(priced, (-importance, feature)) AS INTEGER) AS price_first
  FROM strongest)"""
_N_FEATURES = (
    f"14 + 1 + 4 + 1 + 3 + 2 + 1 + {len(SEGMENTS)} + "
    "(SELECT COUNT(*) FROM (SELECT origin_up FROM client GROUP BY 1 HAVING COUNT(*) >= 60))"
)

_KDE = f"""WITH {LOGGED_LONG},
stats AS (
  SELECT variable, COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi,
    stddev_samp(value) * power(COUNT(*), -0.2) AS h
  FROM vals GROUP BY variable),
grid AS (
  SELECT variable, CAST(point AS INTEGER) AS point, lo + point * ((hi - lo) / 199) AS x, n, h
  FROM stats, range(200) AS t(point))
SELECT grid.variable, point, round(MIN(x), 6) AS x,
  round(SUM(exp(-((x - value) / h) * ((x - value) / h) / 2)) / (MIN(n) * MIN(h) * sqrt(2 * pi())), 6)
    + 0.0 AS density
FROM grid JOIN vals ON grid.variable = vals.variable GROUP BY grid.variable, point"""

ORACLE: dict[str, str] = {
    "dataset_profile": f"""WITH {PRICE}, {CLIENT}
SELECT 'client' AS table_name, COUNT(*) AS n_rows, CAST(16 AS BIGINT) AS n_columns,
  {_nulls("client", CLIENT_COLUMNS)} AS null_cells, {_mean("churn")} AS label_rate FROM client
UNION ALL
SELECT 'price', COUNT(*), CAST(8 AS BIGINT), {_nulls("price", ["id", "price_date", *PRICES])}, NULL FROM price""",
    "column_gaps": f"WITH {CLIENT} "
    + " UNION ALL ".join(
        f"SELECT COUNT(*) AS rows, '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS nulls FROM client"
        for c in CLIENT_COLUMNS
    ),
    "class_share": f"""WITH {CLIENT}
SELECT churn, COUNT(*) AS n, COUNT(*) / (SELECT COUNT(*) FROM client) * 100 AS pct FROM client GROUP BY churn""",
    "price_by_churn": f"WITH {PRICE}, {CLIENT}, joined AS (SELECT churn, price.* FROM client JOIN price USING (id)) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, retained, churned,
  round_even((churned - retained) / retained * 100, 2) + 0.0 AS diff_pct FROM (
  SELECT CAST(SUM({c}) FILTER (WHERE churn = 0) AS DOUBLE) / COUNT({c}) FILTER (WHERE churn = 0) AS retained,
         CAST(SUM({c}) FILTER (WHERE churn = 1) AS DOUBLE) / COUNT({c}) FILTER (WHERE churn = 1) AS churned
  FROM joined)"""
        for c in PRICES
    ),
    "group_means": f"WITH {CLIENT} "
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS variable,
  CAST(SUM({c}) FILTER (WHERE churn = 0) AS DOUBLE) / COUNT({c}) FILTER (WHERE churn = 0) AS retained,
  CAST(SUM({c}) FILTER (WHERE churn = 1) AS DOUBLE) / COUNT({c}) FILTER (WHERE churn = 1) AS churned
FROM client"""
        for name, c in MEANS.items()
    ),
    "rate_by_channel": f"""WITH {CLIENT}
SELECT channel_sales, COUNT(*) AS n, {_mean("churn")} AS label_rate FROM client
GROUP BY channel_sales ORDER BY label_rate DESC, channel_sales""",
    "rate_by_gas": f"""WITH {CLIENT}
SELECT has_gas, COUNT(*) AS n, {_mean("churn")} AS label_rate FROM client GROUP BY has_gas""",
    "rate_by_gas_encoded": f"""WITH {CLIENT}
SELECT CASE has_gas WHEN 't' THEN 1 ELSE 0 END AS has_gas, COUNT(*) AS n, {_mean("churn")} AS label_rate
FROM client GROUP BY 1""",
    "rate_by_tenure_top5": f"""WITH {CLIENT}
SELECT CAST({_TENURE} AS INTEGER) AS tenure, COUNT(*) AS n, {_mean("churn")} AS label_rate
FROM client GROUP BY 1 ORDER BY label_rate DESC, tenure LIMIT 5""",
    "monthly_price": f"""WITH {MONTHLY}
SELECT id, CAST(price_date AS VARCHAR) AS price_date, {", ".join(PRICES)} FROM monthly""",
    "price_change_first_last": f"WITH {MONTHLY} SELECT id, {_CHANGE} FROM monthly GROUP BY id",
    "price_mean_spread": f"WITH {PRICE} SELECT id, {_MEAN_SPREAD} FROM price GROUP BY id",
    "price_max_spread": f"WITH {MONTHLY} SELECT id, {_MAX_SPREAD} FROM monthly GROUP BY id",
    "price_features": f"WITH {PRICE_FEATURES} SELECT * FROM price_feature",
    "price_volatility": f"""WITH {MONTHLY},
level AS (SELECT id, {", ".join(f"{_mean(c)} AS {c}_level" for c in PRICES)} FROM price GROUP BY id),
deviation AS (
  SELECT id, {", ".join(f"round(stddev_samp({c}), 1) + 0.0 AS {c}_volatility" for c in PRICES)}
  FROM monthly GROUP BY id)
SELECT * FROM level JOIN deviation USING (id)""",
    "price_mom": f"""WITH {MONTHLY}
SELECT id, CAST(price_date AS VARCHAR) AS price_date,
  {", ".join(part for c in PRICES for part in _mom(c))} FROM monthly""",
    "rise_before_churn": f"WITH {MONTHLY}, {CLIENT} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, churn, COUNT(*) AS n,
  COUNT(*) FILTER (WHERE recent > 0) / COUNT(*) AS share_recent_rise,
  CAST(SUM(ever) AS DOUBLE) / COUNT(*) AS mean_rises
FROM client JOIN {_rises(c)} AS rise USING (id) GROUP BY churn"""
        for c in PRICES
    ),
    "churn_after_rise": f"WITH {MONTHLY}, {CLIENT} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, recent AS rises, COUNT(*) AS n, {_mean("churn")} AS label_rate
FROM client JOIN {_rises(c)} AS rise USING (id) GROUP BY recent"""
        for c in PRICES
    ),
    "churn_by_volatility": f"""WITH {MONTHLY}, {CLIENT},
deviation AS (
  SELECT id, {", ".join(f"round(stddev_samp({c}), 1) + 0.0 AS {c}" for c in PRICES)} FROM monthly GROUP BY id),
moved AS (SELECT churn, num_years_antig, deviation.* FROM client JOIN deviation USING (id)) """
    + " UNION ALL ".join(
        _terciles(c, c, "moved", f", {_mean('num_years_antig')} AS mean_num_years_antig") for c in PRICES
    ),
    "elasticity_by_size": _elasticity_by("size", "pow_max"),
    "elasticity_by_usage": _elasticity_by("usage", "cons_12m"),
    "elasticity_by_age": _elasticity_by("age", "num_years_antig"),
    "elasticity_monthly": f"""WITH {ELASTICITY}
SELECT id, CAST(price_date AS VARCHAR) AS price_date, round(elasticity, 6) + 0.0 AS elasticity FROM elastic""",
    "elasticity": f"""WITH {ELASTICITY}, {CLIENT}
SELECT channel_sales, COUNT(*) AS n, COUNT(*) FILTER (WHERE abs(elasticity) > 1) / COUNT(*) AS share_elastic,
  round(quantile_cont(elasticity, 0.5), 6) + 0.0 AS median_elasticity
FROM client JOIN elastic USING (id) GROUP BY channel_sales""",
    "tenure": f"WITH {CLIENT} SELECT id, CAST({_TENURE} AS INTEGER) AS tenure FROM client",
    "months_to_ref": f"WITH {CLIENT} SELECT id, {_MONTH_COLUMNS} FROM client",
    "bool_encode": f"WITH {CLIENT} SELECT id, CASE has_gas WHEN 't' THEN 1 WHEN 'f' THEN 0 END AS has_gas FROM client",
    "category_frequency": f"""WITH {CLIENT}
SELECT * FROM (
  SELECT 'channel_sales' AS "column", channel_sales AS value, COUNT(*) AS n FROM client GROUP BY channel_sales
  UNION ALL SELECT 'origin_up', origin_up, COUNT(*) FROM client GROUP BY origin_up) WHERE n >= 60""",
    "one_hot_long": f"""WITH {CLIENT}
SELECT id, 'channel_sales_' || channel_sales AS feature FROM client WHERE channel_sales IN
  (SELECT channel_sales FROM client GROUP BY channel_sales HAVING COUNT(*) >= 60)
UNION ALL
SELECT id, 'origin_up_' || origin_up FROM client WHERE origin_up IN
  (SELECT origin_up FROM client GROUP BY origin_up HAVING COUNT(*) >= 60)""",
    "one_hot_wide": f"WITH {CLIENT} SELECT id, {_dummies('INTEGER')} FROM client",
    "log10p1": f"""WITH {CLIENT}
SELECT id, {", ".join(f"round({_log(c)}, 6) + 0.0 AS {c}" for c in LOGS)} FROM client""",
    "log_invalid": f"WITH {CLIENT} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, COUNT({c}) AS n, COUNT(*) FILTER (WHERE {c} <= -1) AS n_invalid FROM client"
        for c in LOGS
    ),
    "feature_table": f"""WITH {PRICE_FEATURES}, {CLIENT}
SELECT price_feature.*, churn, {_TENURE} AS tenure, {_MONTH_COLUMNS},
  CASE has_gas WHEN 't' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_gas,
  {", ".join(f"round({_log(c)}, 6) + 0.0 AS {c}" for c in LOGS)},
  pow_max, CAST(nb_prod_act AS DOUBLE) AS nb_prod_act, CAST(net_margin AS DOUBLE) AS net_margin,
  {_dummies("DOUBLE")}
FROM client JOIN price_feature ON client.id = price_feature.id""",
    "feature_summary": f"""WITH {PRICE}, {CLIENT}
SELECT COUNT(*) AS n_rows, CAST({14 + 1 + 4 + 2 + 1 + 3 + 3 + len(SEGMENTS) + len(NATIONS)} AS BIGINT) AS n_columns,
  CAST(14 AS BIGINT) AS n_price_features, CAST(4 AS BIGINT) AS n_month_features,
  CAST(3 AS BIGINT) AS n_log_features, CAST({len(SEGMENTS) + len(NATIONS)} AS BIGINT) AS n_dummies
FROM client WHERE id IN (SELECT id FROM price)""",
    "category_vectors": f"""WITH {CLIENT}
SELECT id, 'channel_sales_' || channel_sales AS feature FROM client WHERE channel_sales IN
  (SELECT channel_sales FROM client GROUP BY channel_sales HAVING COUNT(*) >= 60)
UNION ALL
SELECT id, 'origin_up_' || origin_up FROM client WHERE origin_up IN
  (SELECT origin_up FROM client GROUP BY origin_up HAVING COUNT(*) >= 60)""",
    "histogram50": f"WITH {CLIENT}, "
    + _histogram("client", ["cons_12m", "cons_last_month", "net_margin", "pow_max"], 50, True),
    "histogram_log": f"SELECT variable, bin, n, round(bin_start, 6) + 0.0 AS bin_start FROM (WITH {LOGGED}, "
    + _histogram("logged", LOGS, 30, False)
    + ")",
    "histogram_bins": f"WITH {CLIENT} " + " UNION ALL ".join(map(_auto_bins, LOGS)),
    "kde_log": _KDE,
    "stratified_split": f"WITH {CLIENT}, {_split('client')} SELECT * FROM parted",
    "class_weights": f"""WITH {CLIENT}
SELECT churn, COUNT(*) AS n, (SELECT COUNT(*) FROM client) / (2 * COUNT(*)) AS weight FROM client GROUP BY churn""",
    "oversample": f"""WITH {CLIENT},
ranked AS (
  SELECT id, churn, row_number() OVER (PARTITION BY churn ORDER BY {HASH}, id) AS r,
    COUNT(*) OVER (PARTITION BY churn) AS size,
    (SELECT COUNT(*) FROM client WHERE churn = 0) AS largest FROM client),
needed AS (
  SELECT id, churn, CASE WHEN churn = 1
    THEN floor(largest / size) + CASE WHEN r <= largest % size THEN 1 ELSE 0 END ELSE 1 END AS times FROM ranked)
SELECT id, churn, CAST(unnest(generate_series(1, CAST(times AS BIGINT))) AS INTEGER) AS copy FROM needed""",
    "confusion": f"""WITH {SCORED}
SELECT actual, predicted, (SELECT COUNT(*) FROM scored WHERE label = actual AND prediction = predicted) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS grid(actual, predicted)""",
    "binary_metrics": f"""WITH {SCORED}, {CELLS}
SELECT tn, fp, fn, tp, {_ACCURACY} AS accuracy, {_CLASS1[0]} AS precision, {_CLASS1[1]} AS recall,
  {_CLASS1[2]} AS f1 FROM cells""",
    "class_report": f"""WITH {SCORED}, {CELLS},
m AS (
  SELECT {_CLASS0[0]} AS p0, {_CLASS0[1]} AS r0, {_CLASS0[2]} AS f0, tn + fp AS s0,
         {_CLASS1[0]} AS p1, {_CLASS1[1]} AS r1, {_CLASS1[2]} AS f1, tp + fn AS s1,
         {_ACCURACY} AS a, tn + fp + fn + tp AS s FROM cells)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM m
UNION ALL SELECT '1', p1, r1, f1, s1 FROM m
UNION ALL SELECT 'accuracy', a, a, a, s FROM m
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s FROM m
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / s, (r0 * s0 + r1 * s1) / s, (f0 * s0 + f1 * s1) / s, s FROM m""",
    "roc_auc": f"""WITH {_by_score("ASC")}
SELECT CAST(MAX(p) AS BIGINT) AS n_pos, CAST(MAX(n) AS BIGINT) AS n_neg,
  CAST(SUM(pos * (2 * (fp - neg) + neg)) AS DOUBLE) / (2.0 * MAX(p) * MAX(n)) AS auc FROM running""",
    "roc_points": f"""WITH {_by_score("DESC")},
shaped AS (
  SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS place
  FROM running WINDOW w AS (ORDER BY score DESC))
SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT score, CAST(fp AS DOUBLE) / n, CAST(tp AS DOUBLE) / p FROM shaped
WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""",
    "pr_points": f"""WITH {_by_score("DESC")}
SELECT score AS threshold, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / p AS recall
FROM running""",
    "threshold_sweep": f"""WITH {SCORED},
counted AS (
  SELECT CAST(t AS DOUBLE) AS threshold,
    COUNT(*) FILTER (WHERE score >= CAST(t AS DOUBLE) AND label = 1) AS tp,
    COUNT(*) FILTER (WHERE score >= CAST(t AS DOUBLE) AND label = 0) AS fp,
    COUNT(*) FILTER (WHERE score < CAST(t AS DOUBLE) AND label = 1) AS fn
  FROM scored, (VALUES (0.2), (0.3), (0.4), (0.5), (0.6)) AS cuts(t) GROUP BY t)
SELECT threshold, {_CLASS1[0]} AS precision, {_CLASS1[1]} AS recall, {_CLASS1[2]} AS f1 FROM counted""",
    "score_deciles": f"""WITH {SCORED},
placed AS (
  SELECT label, score, rank() OVER (ORDER BY score DESC) AS place, COUNT(*) OVER () AS total FROM scored),
parts AS (
  SELECT CAST(floor((place - 1) * 10 / total) + 1 AS INTEGER) AS decile, label, score FROM placed)
SELECT decile, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS n_pos, MIN(score) AS min_score,
  CAST(SUM(label) AS DOUBLE) / COUNT(*) AS label_rate,
  CAST(SUM(label) AS DOUBLE) / COUNT(*) / (SELECT CAST(SUM(label) AS DOUBLE) / COUNT(*) FROM scored) AS lift
FROM parts GROUP BY decile""",
    "retention_list": f"WITH {SCORED} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20",
    "segment_rates": f"""WITH {CLIENT} {_terciles("size", "pow_max")}
UNION ALL {_terciles("usage", "cons_12m")} UNION ALL {_terciles("age", "num_years_antig")}""",
    "bill_burden": f"""WITH {BILLS}, {CLIENT}
SELECT churn, COUNT(DISTINCT client.id) AS n, CAST(SUM(bill) AS DOUBLE) / COUNT(*) AS mean_monthly_bill
FROM client JOIN bill ON client.id = bill.id GROUP BY churn""",
    "discount_rates": f"""WITH {CLIENT},
discount AS (
  SELECT o_custkey AS id, CAST(SUM(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / COUNT(*) AS mean_discount
  FROM past JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey)
SELECT CASE WHEN mean_discount > 0.05 THEN 1 ELSE 0 END AS discounted, COUNT(*) AS n,
  {_mean("churn")} AS label_rate
FROM client JOIN discount USING (id) GROUP BY 1""",
    "at_risk_list": f"""WITH {CLIENT}
SELECT id, CAST(net_margin AS DOUBLE) AS net_margin, num_years_antig,
  CASE WHEN coalesce(CAST(cons_last_month AS DOUBLE), 0.0) < CAST(cons_12m AS DOUBLE) / 12 * 0.5 THEN 1 ELSE 0 END
    AS declining
FROM client
WHERE CAST(net_margin AS DOUBLE) >= (SELECT quantile_cont(CAST(net_margin AS DOUBLE), 0.75) FROM client)
  AND num_years_antig <= (SELECT quantile_cont(CAST(num_years_antig AS DOUBLE), 0.5) FROM client)""",
    "csv_round_trip": """SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer""",
    "csv_undeclared": """SELECT CAST(c_custkey AS VARCHAR) AS id,
  CASE WHEN c_nationkey <> 3 THEN c_acctbal END AS extra_amount FROM customer""",
    "feature_file": f"WITH {PRICE_FEATURES} SELECT * FROM price_feature",
    "report_lines": f"WITH {CLIENT} "
    + " UNION ALL ".join(
        f"""SELECT 'rate_by_{c}' AS "table", {c} AS category, n,
  '  ' || {c} || ': ' || printf('%.1f', round(rate * 100, 1)) || '% of ' || format('{{:,}}', n) AS line
FROM (SELECT {c}, COUNT(*) AS n, {_mean("churn")} AS rate FROM client GROUP BY {c})"""
        for c in ("channel_sales", "origin_up", "has_gas")
    ),
    "fold_auc": f"WITH {_FOLD_AUC} SELECT * FROM fold_auc",
    "fold_summary": f"""WITH {_FOLD_AUC}
SELECT COUNT(auc) AS folds, round(avg(auc), 6) + 0.0 AS auc_mean, round(stddev_pop(auc), 6) + 0.0 AS auc_std FROM fold_auc""",
    "corr_importance_top": f"WITH {_IMPORTANCE} SELECT * FROM importance ORDER BY importance DESC, feature LIMIT 10",
    "corr_price_share": f"WITH {_IMPORTANCE}, {_PRICE_SHARE} SELECT * FROM price_share",
    "corr_report_metrics": f"""WITH {_IMPORTANCE}, {_PRICE_SHARE}, {_FOLD_AUC}, {CELLS},
one AS (
  SELECT {_ACCURACY} AS accuracy, {_CLASS1[0]} AS precision, {_CLASS1[1]} AS recall, {_CLASS1[2]} AS f1,
    (SELECT {_PAIRS_WON} FROM scored AS p JOIN scored AS n ON p.label = 1 AND n.label = 0) AS roc_auc,
    (SELECT avg(auc) FROM fold_auc) AS cv_roc_auc_mean, (SELECT stddev_pop(auc) FROM fold_auc) AS cv_roc_auc_std,
    (SELECT price_importance FROM price_share) AS price_importance,
    (SELECT CAST(price_in_top AS DOUBLE) FROM price_share) AS price_features_in_top,
    (SELECT price_share_of_top FROM price_share) AS price_share_of_top,
    (SELECT CAST(price_first AS DOUBLE) FROM price_share) AS price_feature_is_first
  FROM cells)
SELECT metric, round(value, 6) + 0.0 AS value FROM (UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE value)""",
    "rf_rows": f"""WITH {PRICE}, {CLIENT}, priced AS (SELECT * FROM client WHERE id IN (SELECT id FROM price)), {_split("priced")}
SELECT id, churn AS actual_churn, 1 AS in_range, 1 AS agrees FROM parted WHERE split = 'test'""",
    "cv_folds": f"""WITH {PRICE}, {CLIENT}, priced AS (SELECT * FROM client WHERE id IN (SELECT id FROM price)), {_split("priced")}
SELECT fold, COUNT(*) FILTER (WHERE churn = 1) AS n_pos, COUNT(*) FILTER (WHERE churn = 0) AS n_neg, 1 AS in_range
FROM parted WHERE split = 'train' GROUP BY fold""",
    "importance_total": f"""WITH {CLIENT}
SELECT CAST({_N_FEATURES} AS BIGINT) AS n_features, CAST(1 AS DOUBLE) AS total""",
    "vector_importance_total": f"""WITH {CLIENT}
SELECT CAST({_N_FEATURES} AS BIGINT) AS n_features, CAST(1 AS DOUBLE) AS total""",
    "vector_predictions": f"""WITH {PRICE}, {CLIENT}, priced AS (SELECT * FROM client WHERE id IN (SELECT id FROM price)), {_split("priced")}
SELECT id, channel_sales, origin_up, 1 AS in_range FROM parted JOIN client USING (id) WHERE split = 'test'""",
    "model_classes": f"""WITH {PRICE}, {CLIENT}, priced AS (SELECT * FROM client WHERE id IN (SELECT id FROM price)), {_split("priced")}
SELECT model, COUNT(*) FILTER (WHERE churn = 1) AS n_pos, COUNT(*) FILTER (WHERE churn = 0) AS n_neg
FROM parted, (VALUES ('random_forest'), ('boosted_trees')) AS models(model) WHERE split = 'test' GROUP BY model""",
    "grid_candidates": """SELECT 'maxDepth=' || depth || ', numTrees=' || trees AS params, CAST(5 AS BIGINT) AS folds
FROM (VALUES (3), (5)) AS a(depth), (VALUES (10), (20)) AS b(trees)""",
    "permutation_base": f"""WITH {CLIENT}
SELECT CAST({_N_FEATURES} AS BIGINT) AS n_features, CAST(1 AS BIGINT) AS n_bases""",
    "date_parse": """SELECT o_orderkey,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS lenient,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS strict FROM orders""",
}


ORACLE["corr_matrix"] = f"""WITH features AS MATERIALIZED ({ORACLE["feature_table"]}),
long AS (UNPIVOT (SELECT * EXCLUDE (churn) FROM features) ON COLUMNS(* EXCLUDE (id)) INTO NAME variable VALUE value)
SELECT a.variable AS column_a, b.variable AS column_b, round(corr(a.value, b.value), 6) + 0.0 AS corr
FROM long AS a JOIN long AS b ON a.id = b.id AND a.variable < b.variable GROUP BY a.variable, b.variable"""

FEATURES = sorted(
    [*PRICE_NAMES, "tenure", *_MONTHS, "has_gas", *LOGS, "pow_max", "nb_prod_act", "net_margin"]
    + [f"channel_sales_{v}" for v in SEGMENTS]
    + [f"origin_up_{v}" for v in NATIONS]
)
# Distances in whole steps of 1/1024 deviation, so that no order of sums changes them.
_NEAR = f"""features AS MATERIALIZED (
  SELECT id, churn, {", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in FEATURES)} FROM ({ORACLE["feature_table"]})),
few AS (SELECT * FROM features WHERE churn = 1),
stats AS (SELECT {", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(FEATURES))} FROM few),
steps AS MATERIALIZED (
  SELECT id, {HASH} AS hash, {", ".join(f"CASE WHEN s{i} > 0 THEN CAST(floor(({c} - m{i}) / s{i} * 1024) AS BIGINT) ELSE 0 END AS v{i}" for i, c in enumerate(FEATURES))}
  FROM few, stats),
distances AS (
  SELECT a.id, b.id AS neighbour, b.hash, CAST({" + ".join(f"(a.v{i} - b.v{i}) * (a.v{i} - b.v{i})" for i, _ in enumerate(FEATURES))} AS BIGINT) AS distance
  FROM steps AS a JOIN steps AS b ON a.id <> b.id),
near AS MATERIALIZED (
  SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, hash, neighbour) AS INTEGER) AS rank, neighbour, distance
  FROM distances QUALIFY rank <= 5)"""
ORACLE["minority_neighbours"] = f"WITH {_NEAR} SELECT id, rank, neighbour, distance FROM near"
ORACLE["synthetic_minority"] = f"""WITH {_NEAR},
sized AS (
  SELECT *, row_number() OVER (ORDER BY {HASH}, id) AS r, COUNT(*) OVER () AS total,
    (SELECT COUNT(*) FROM features WHERE churn = 0) AS largest FROM few),
copies AS (
  SELECT *, unnest(generate_series(2, CAST(floor(largest / total) AS BIGINT)
    + CASE WHEN r <= largest % total THEN 1 ELSE 0 END)) AS copy FROM sized),
moved AS (
  SELECT *, (copy - 2) % least(5, total - 1) + 1 AS rank,
    ({HASH}) * (2 * copy + 1) % 4294967296 / 4294967296 AS part FROM copies)
SELECT id, churn, {", ".join(FEATURES)}, CAST(1 AS INTEGER) AS copy FROM features
UNION ALL
SELECT moved.id, 1, {", ".join(f"moved.{c} + part * (few.{c} - moved.{c})" for c in FEATURES)}, CAST(copy AS INTEGER)
FROM moved JOIN near ON near.id = moved.id AND near.rank = moved.rank JOIN few ON few.id = near.neighbour"""

# The same tables, counted in the pass that writes them.
ORACLE["written_gaps"] = ORACLE["column_gaps"]
ORACLE["written_summary"] = ORACLE["feature_summary"]

ORACLE["csv_mixed_headers"] = """SELECT c_custkey, c_nationkey, c_mktsegment,
  CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal FROM customer"""
ORACLE["csv_rejects"] = """SELECT
  CASE c_custkey % 9 WHEN 1 THEN c_custkey || '.5,x,' || c_mktsegment WHEN 2 THEN c_custkey || ',x,' || c_mktsegment
    WHEN 5 THEN CAST(c_custkey AS VARCHAR) ELSE c_custkey || ',' || c_nationkey || ',' || c_mktsegment || ',more' END AS record,
  CASE c_custkey % 9 WHEN 1 THEN 'c_custkey: ' || c_custkey || '.5; c_nationkey: x' WHEN 2 THEN 'c_nationkey: x' ELSE 'number of cells' END AS reason
FROM customer WHERE c_custkey % 9 IN (1, 2, 5, 6)"""

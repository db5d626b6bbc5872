"""Shared SQL building blocks: the same tables written independently, as common table expressions."""

from __future__ import annotations

from .. import fixed
from ..sources.tables import INDICATORS


def _cases(cond: str) -> str:
    return f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def obs(entity: str = "c_mktsegment") -> str:
    source = "orders" if entity == "o_custkey" else "orders JOIN customer ON o_custkey = c_custkey"
    month, quarter = "CAST(date_trunc('month', day) AS DATE)", "CAST(date_trunc('quarter', day) AS DATE)"
    share = "CAST(sum({0}) * 100 AS DOUBLE) / CAST(sum(n) AS DOUBLE)"
    parts = [
        ("FEDFUNDS", month, share.format("urgent")),
        ("UNRATE", month, share.format("finished")),
        ("CPI", month, "CAST(sum(price) AS DOUBLE) / CAST(sum(n) * 1000 AS DOUBLE)"),
        ("GDP", quarter, "CAST(sum(price) AS DOUBLE) / 1000000"),
        ("TREASURY", "day", "CAST(sum(price) AS DOUBLE) / CAST(sum(n) * 10000 AS DOUBLE)"),
        ("VIX", "day", "CAST(sum(n) AS DOUBLE)"),
    ]
    union = " UNION ALL ".join(
        f"SELECT entity, '{s}' AS series, {d} AS date, {v} AS value FROM daily GROUP BY entity, {d}"
        for s, d, v in parts)
    return f"""daily AS (
  SELECT CAST({entity} AS VARCHAR) AS entity, CAST(o_orderdate AS DATE) AS day, count(*) AS n,
         {_cases("o_orderpriority = '1-URGENT'")} AS urgent,
         {_cases("o_orderstatus = 'F'")} AS finished,
         sum(CAST(o_totalprice AS DECIMAL(20, 2))) AS price
  FROM {source} GROUP BY 1, 2),
obs AS ({union})"""


def wide(entity: str = "c_mktsegment") -> str:
    picks = ", ".join(f"max(CASE WHEN series = '{s}' THEN value END) AS {s}" for s in fixed.SERIES)
    return f"{obs(entity)},\nwide AS (SELECT entity, date, {picks} FROM obs GROUP BY entity, date)"


SPINE = """limits AS (SELECT entity, min(date) AS lo, max(date) AS hi FROM wide GROUP BY entity),
spine AS (
  SELECT entity, CAST(unnest(generate_series(
    CASE WHEN lo = date_trunc('month', lo) THEN date_trunc('month', lo)
         ELSE date_trunc('month', lo) + INTERVAL 1 MONTH END,
    date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE) AS date
  FROM limits)"""


def monthly(entity: str = "c_mktsegment") -> str:
    aggs = ", ".join(
        f"arg_max({c}, CASE WHEN {c} IS NOT NULL THEN date END) AS {c}" if rule == "last"
        else f"avg({c}) AS {c}" for c, rule in fixed.MONTHLY_RULES.items())
    fill = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in fixed.SERIES)
    some = " AND ".join(f"{c} IS NOT NULL" for c in fixed.SERIES)
    return f"""{wide(entity)},
resampled AS (
  SELECT entity, CAST(date_trunc('month', date) AS DATE) AS date, {aggs}
  FROM wide GROUP BY 1, 2),
{SPINE},
filled AS (
  SELECT spine.entity, spine.date, {', '.join('resampled.' + c for c in fixed.SERIES)}
  FROM spine LEFT JOIN resampled USING (entity, date)),
carried AS (SELECT entity, date, {fill} FROM filled),
monthly AS (SELECT * FROM carried WHERE {some})"""


def _roll(fn: str, c: str, n: int) -> str:
    frame = f"OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} = {n} THEN {fn}({c}) {frame} END"


W = "OVER (PARTITION BY entity ORDER BY date)"


def features(entity: str = "c_mktsegment") -> str:
    cols = {
        "FED_CHANGE": f"FEDFUNDS - lag(FEDFUNDS) {W}",
        "TREASURY_CHANGE": f"TREASURY - lag(TREASURY) {W}",
        "VIX_CHANGE": f"VIX - lag(VIX) {W}",
        "UNRATE_CHANGE": f"UNRATE - lag(UNRATE) {W}",
        "INFLATION_RATE": f"(CPI / nullif(lag(CPI, 12) {W}, 0) - 1) * 100",
        "GDP_GROWTH": f"(GDP / nullif(lag(GDP, 12) {W}, 0) - 1) * 100",
        "FED_3M_AVG": _roll("avg", "FEDFUNDS", 3),
        "FED_6M_AVG": _roll("avg", "FEDFUNDS", 6),
        "CPI_3M_AVG": _roll("avg", "CPI", 3),
        "GDP_3M_AVG": _roll("avg", "GDP", 3),
        "UNRATE_3M_AVG": _roll("avg", "UNRATE", 3),
        "VIX_3M_AVG": _roll("avg", "VIX", 3),
        "FED_LAG1": f"lag(FEDFUNDS) {W}",
        "GDP_LAG1": f"lag(GDP) {W}",
        "CPI_LAG1": f"lag(CPI) {W}",
        "UNRATE_LAG1": f"lag(UNRATE) {W}",
        "TREASURY_LAG1": f"lag(TREASURY) {W}",
        "VIX_LAG1": f"lag(VIX) {W}",
        "VIX_VOLATILITY": _roll("stddev_samp", "VIX", 6),
        "FED_VOLATILITY": _roll("stddev_samp", "FEDFUNDS", 6),
    }
    momentum = {"FED_MOMENTUM": ("FEDFUNDS", 3), "GDP_MOMENTUM": ("GDP", 3),
                "UNRATE_MOMENTUM": ("UNRATE", 3), "VIX_MOMENTUM": ("VIX", 3)}
    cols.update({k: f"{c} - ({_roll('avg', c, n)})" for k, (c, n) in momentum.items()})
    body = ", ".join(f"{e} AS {k}" for k, e in cols.items())
    return f"{monthly(entity)},\nfeatures AS (SELECT *, {body} FROM monthly)"


def stress(entity: str = "c_mktsegment", min_periods: int = fixed.MIN_PERIODS) -> str:
    frame = "OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    z = ", ".join(
        f"CASE WHEN count({c}) {frame} >= {min_periods} THEN ({c} - avg({c}) {frame}) / "
        f"nullif(stddev_samp({c}) {frame}, 0) END AS {k}" for k, c in fixed.Z_INPUTS.items())
    raw = " + ".join(f"({w}) * {c}" for c, w in fixed.INDEX_WEIGHTS.items())
    s = "ECON_STRESS"
    avg3 = _roll("avg", s, 3)
    return f"""{features(entity)},
zscores AS (SELECT *, {z} FROM features),
raw_index AS (SELECT *, {raw} AS RAW_ECON_STRESS FROM zscores),
indexed AS (SELECT *, 100 / (1 + exp(-RAW_ECON_STRESS)) AS ECON_STRESS FROM raw_index),
stress AS (
  SELECT *, {s} - lag({s}, 1) {W} AS STRESS_CHANGE_1M, {s} - lag({s}, 3) {W} AS STRESS_CHANGE_3M,
         {avg3} AS STRESS_3M_AVG, {s} - ({avg3}) AS STRESS_GAP_3M,
         {_roll("stddev_samp", s, 6)} AS STRESS_VOLATILITY_6M,
         ({s} - lag({s}, 1) {W}) - (lag({s}, 1) {W} - lag({s}, 2) {W}) AS STRESS_ACCELERATION
  FROM indexed)"""


def periods() -> str:
    rows = ", ".join(f"({i}, DATE '{a}', DATE '{b}', '{n}')"
                     for i, (a, b, n) in enumerate(fixed.CRISIS_PERIODS))
    return f'periods AS (SELECT * FROM (VALUES {rows}) AS t(ord, "start", "end", name))'


def labelled(entity: str = "c_mktsegment", min_periods: int = fixed.MIN_PERIODS) -> str:
    inside = 'date BETWEEN p."start" AND p."end"'
    return f"""{stress(entity, min_periods)},
{periods()},
labelled AS (
  SELECT *, CASE WHEN EXISTS (SELECT 1 FROM periods p WHERE {inside}) THEN 1 ELSE 0 END AS CRISIS,
         coalesce((SELECT arg_max(p.name, p.ord) FROM periods p WHERE {inside}), 'None') AS CRISIS_NAME
  FROM stress)"""


def targets(entity: str = "c_mktsegment", min_periods: int = fixed.MIN_PERIODS) -> str:
    return f"""{labelled(entity, min_periods)},
ahead AS (
  SELECT *, lead(ECON_STRESS, 3) {W} AS TARGET_STRESS_3M, lead(CRISIS, 3) {W} AS TARGET_CRISIS_3M
  FROM labelled),
changed AS (SELECT *, TARGET_STRESS_3M - ECON_STRESS AS TARGET_STRESS_CHANGE_3M FROM ahead),
targets AS (
  SELECT *, CASE WHEN TARGET_STRESS_CHANGE_3M IS NULL THEN NULL
                 WHEN TARGET_STRESS_CHANGE_3M >= {fixed.RISE_POINTS} THEN 1 ELSE 0 END
            AS TARGET_RISK_RISING_3M
  FROM changed)"""


def islands() -> str:
    """Runs in `labelled` rows that have an index value, by the difference of row numbers."""
    return f"""{labelled()},
retained AS (SELECT * FROM labelled WHERE ECON_STRESS IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date)
          - row_number() OVER (PARTITION BY entity, CRISIS, CRISIS_NAME ORDER BY date) AS run
  FROM retained),
islands AS (
  SELECT entity, CRISIS_NAME AS name, min(date) AS start_date, max(date) AS end_date
  FROM numbered WHERE CRISIS = 1 GROUP BY entity, CRISIS_NAME, run)"""


def nation_code(c: str) -> str:
    return f"'N' || lpad(CAST({c} AS VARCHAR), 2, '0')"


def indicator_long() -> str:
    d = "CAST({} AS DOUBLE)".format
    values = {
        "ORD.COUNT": d("n"),
        "ORD.REV": f"{d('revenue')} / 1000000",
        "ORD.AVG": f"{d('revenue')} / {d('n')}",
        "ORD.URG": f"{d('urgent')} * 100.0 / {d('n')}",
        "ORD.FIN": f"{d('finished')} * 100.0 / {d('n')}",
        "ORD.BIG": d("biggest"),
        "ORD.TOP": f"{d('top')} / 1000000",
    }
    union = " UNION ALL ".join(
        f"SELECT country_code, country, year, '{c}' AS indicator_code, '{INDICATORS[c]}' AS indicator, "
        f"{v} AS value FROM yearly" for c, v in values.items())
    price = "CAST(o_totalprice AS DECIMAL(20, 2))"
    return f"""yearly AS (
  SELECT {nation_code("n_nationkey")} AS country_code, n_name AS country,
         year(o_orderdate) AS year, count(*) AS n, sum({price}) AS revenue,
         {_cases("o_orderpriority = '1-URGENT'")} AS urgent,
         {_cases("o_orderstatus = 'F'")} AS finished, max({price}) AS biggest,
         sum(CASE WHEN {price} > 495000 THEN {price} END) AS top
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3),
indicator_long AS ({union})"""


def panel() -> str:
    picks = ", ".join(f"min(CASE WHEN indicator = '{n}' THEN value END) AS {n}"
                      for n in INDICATORS.values())
    return f"""{indicator_long()},
grid AS (
  SELECT {nation_code("n_nationkey")} AS country_code, n_name AS country, y.year
  FROM nation CROSS JOIN (
    SELECT unnest(generate_series(min(year(o_orderdate)), max(year(o_orderdate)))) AS year FROM orders) AS y),
cells AS (SELECT country_code, year, {picks} FROM indicator_long GROUP BY country_code, year),
panel AS (SELECT grid.*, {', '.join('cells.' + n for n in INDICATORS.values())}
          FROM grid LEFT JOIN cells USING (country_code, year))"""


SCORED_DOCUMENTS = """scored AS (
  SELECT l.doc_id AS id, d.lang AS grp, l.quality AS actual,
         round(1 / (1 + exp(-(d.n_chars / 1000.0 - 1.0))), 3) AS probability
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

SCORED_LINES = """scored AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id,
         l_linestatus AS grp, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS actual,
         round(1 / (1 + exp(-(l_quantity / 20.0 - l_discount * 10.0 - 1.0))), 4) AS probability
  FROM lineitem)"""


def confusion(by: str = "", threshold: str = str(fixed.ALERT_THRESHOLD), source: str = "scored") -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    warned = f"probability >= {threshold}"
    return f"""counts AS (
  SELECT {lead}{_cases(f"actual = 1 AND {warned}")} AS true_positives,
         {_cases(f"actual = 0 AND {warned}")} AS false_positives,
         {_cases(f"actual = 1 AND NOT ({warned})")} AS false_negatives,
         {_cases(f"actual = 0 AND NOT ({warned})")} AS true_negatives
  FROM {source} {group}),
rates AS (
  SELECT *, coalesce((true_positives + true_negatives) / nullif(CAST(true_positives + true_negatives
                     + false_positives + false_negatives AS DOUBLE), 0), 0) AS accuracy,
         coalesce(true_positives / nullif(CAST(true_positives + false_positives AS DOUBLE), 0), 0)
           AS precision,
         coalesce(true_positives / nullif(CAST(true_positives + false_negatives AS DOUBLE), 0), 0)
           AS recall,
         coalesce(2 * true_positives / nullif(CAST(2 * true_positives + false_positives
                  + false_negatives AS DOUBLE), 0), 0) AS f1
  FROM counts)"""


def ranking(by: str = "", source: str = "scored") -> str:
    """ROC-AUC from average ranks, average precision from running counts."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""ranked AS (
  SELECT *, rank() OVER ({part} ORDER BY probability)
            + (count(*) OVER (PARTITION BY {lead}probability) - 1) / 2.0 AS avg_rank
  FROM {source}),
auc AS (
  SELECT {lead}sum(actual) AS positives, count(*) - sum(actual) AS negatives,
         CASE WHEN sum(actual) > 0 AND sum(actual) < count(*) THEN
           (sum(CASE WHEN actual = 1 THEN avg_rank END)
            - sum(actual) * (sum(actual) + 1) / 2.0)
           / (CAST(sum(actual) AS DOUBLE) * (count(*) - sum(actual))) END AS roc_auc
  FROM ranked {group}),
steps AS (
  SELECT {lead}probability, sum(actual) AS pos, count(*) AS rows_here FROM {source}
  GROUP BY {lead}probability),
running AS (
  SELECT {lead}pos, sum(pos) OVER ({part} ORDER BY probability DESC) AS tp,
         sum(rows_here) OVER ({part} ORDER BY probability DESC) AS seen,
         sum(pos) OVER ({part}) AS all_pos
  FROM steps),
ap AS (
  SELECT {lead}coalesce(sum(CAST(pos AS DOUBLE) * tp / seen) / nullif(max(all_pos), 0), 0) AS pr_auc
  FROM running {group})"""

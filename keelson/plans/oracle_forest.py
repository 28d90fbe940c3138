"""SQL twin of the hash-split forest: the same draws, splits and walks as common table expressions."""

from __future__ import annotations

from keelson.operators.anomaly import ANOMALY_NUMERIC, CONTAMINATION, GRID, N_TREES, PARTS, PSI, SEED, c_factor

_WIDTH = len(ANOMALY_NUMERIC)
_DEPTH = 8   # ceil(log2(PSI))
_X = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in ANOMALY_NUMERIC) + "]"


def _hex(text: str, start: int) -> str:
    return f"('0x' || substr({text}, {start}, 8))::BIGINT"


def _level(d: int) -> str:
    lo = ", ".join(f"min(x[{i + 1}]) OVER w" for i in range(_WIDTH))
    hi = ", ".join(f"max(x[{i + 1}]) OVER w" for i in range(_WIDTH))
    inner = "n > 1" if d < _DEPTH else "false"
    return f""",
lv_w{d} AS MATERIALIZED (SELECT tree, node, x, count(*) OVER w AS n, [{lo}] AS lo, [{hi}] AS hi,
  md5('split|{SEED}|' || tree || '|' || node) AS dg FROM lv_l{d} WINDOW w AS (PARTITION BY tree, node)),
lv_v{d} AS (SELECT *, CASE WHEN {inner} THEN [i for i in range(0, {_WIDTH}) if hi[i + 1] > lo[i + 1]] ELSE [] END AS v FROM lv_w{d}),
lv_f{d} AS (SELECT *, CASE WHEN len(v) > 0 THEN CAST(v[1 + {_hex('dg', 1)} % len(v)] AS INTEGER) ELSE -1 END AS feature,
  CAST({_hex('dg', 9)} AS DOUBLE) / 4294967296e0 AS u FROM lv_v{d}),
lv_s{d} AS MATERIALIZED (SELECT tree, node, x, n, feature, CASE WHEN feature < 0 THEN 0e0
  WHEN lo[feature + 1] + u * (hi[feature + 1] - lo[feature + 1]) >= hi[feature + 1] THEN lo[feature + 1]
  ELSE lo[feature + 1] + u * (hi[feature + 1] - lo[feature + 1]) END AS threshold FROM lv_f{d}),
lv_l{d + 1} AS (SELECT tree, x, 2 * node + CASE WHEN x[feature + 1] <= threshold THEN 0 ELSE 1 END AS node FROM lv_s{d} WHERE feature >= 0)"""


def walk_sql(name: str, source: str) -> str:
    """CTEs down to ``{name}_total`` (Order_ID, len_sum): every row of ``source`` through every tree."""
    out = (f""",
{name}_p0 AS (SELECT Order_ID, {_X} AS x, t.tree, CAST(1 AS BIGINT) AS node FROM {source} CROSS JOIN (SELECT range AS tree FROM range({N_TREES})) t)""")
    for k in range(_DEPTH):
        out += f""",
{name}_p{k + 1} AS (SELECT p.Order_ID, p.x, p.tree, CASE WHEN feature < 0 THEN p.node WHEN p.x[feature + 1] <= threshold THEN 2 * p.node
  ELSE 2 * p.node + 1 END AS node FROM {name}_p{k} p JOIN nodes n ON p.tree = n.tree AND p.node = n.node)"""
    return out + f""",
{name}_total AS (SELECT p.Order_ID, CAST(SUM(length) AS BIGINT) AS len_sum FROM {name}_p{_DEPTH} p JOIN nodes n ON p.tree = n.tree AND p.node = n.node GROUP BY 1)"""


def score_sql(total: str) -> str:
    return f"pow(2e0, -(CAST({total} AS DOUBLE) / ({N_TREES}e0 * {GRID}e0)) / {c_factor(PSI)!r}e0)"


def _forest() -> str:
    length = ("CASE WHEN feature >= 0 THEN 0 ELSE CAST(ROUND((depth + CASE WHEN size > 2 THEN 2e0 * (ln(size - 1e0) + 0.5772156649e0)"
              f" - 2e0 * (size - 1e0) / size WHEN size = 2 THEN 1e0 ELSE 0e0 END) * {GRID}e0) AS BIGINT) END")
    nodes = " UNION ALL ".join(f"SELECT DISTINCT tree, node, feature, threshold, n AS size, {d} AS depth FROM lv_s{d}" for d in range(_DEPTH + 1))
    return f""",
feats AS (SELECT Order_ID, {_X} AS x FROM scored),
digests AS (SELECT Order_ID, x, g, md5(Order_ID || '|forest|{SEED}|' || g) AS dg FROM feats CROSS JOIN (SELECT range AS g FROM range({N_TREES // PARTS}))),
draws AS (SELECT g * {PARTS} + k AS tree, Order_ID, x, substr(dg, CAST(8 * k + 1 AS INTEGER), 8) AS h FROM digests CROSS JOIN (SELECT range AS k FROM range({PARTS}))),
ranked AS (SELECT tree, x, row_number() OVER (PARTITION BY tree ORDER BY h, Order_ID) AS rk FROM draws),
lv_l0 AS (SELECT tree, x, CAST(1 AS BIGINT) AS node FROM ranked WHERE rk <= {PSI})""" + "".join(_level(d) for d in range(_DEPTH + 1)) + f""",
nodes AS MATERIALIZED (SELECT *, {length} AS length FROM ({nodes}))""" + walk_sql("all", "scored") + f""",
iso AS MATERIALIZED (SELECT Order_ID, {score_sql('len_sum')} AS s FROM all_total),
cutoff AS (SELECT quantile_cont(s, {1 - CONTAMINATION}) AS off FROM iso),
anomalies AS (SELECT scored.*, s - off AS Anomaly_Score, s > off AS Is_Anomaly FROM scored JOIN iso USING (Order_ID) CROSS JOIN cutoff)"""


FOREST_CTES = _forest()

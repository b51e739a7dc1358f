"""Independent SQL for the registered queries, run over the same whole tables."""

from __future__ import annotations

from durata.constants import HORIZONS, VALID_RANGES
from durata.sources.events import FEATURES

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

FEATURE_SQL = """
  value * 100 AS dist_min_ci_0_5h, (k - 50) * 10.0::DOUBLE AS closing_speed_m_per_h,
  abs((k - 50) * 10.0::DOUBLE) AS closing_speed_abs_m_per_h,
  (k - 50) * 50.0::DOUBLE AS projected_advance_m, k / 99.0::DOUBLE AS alignment_abs,
  k / 49.5::DOUBLE - 1 AS alignment_cos, greatest(k - 75, 0) * 1.0::DOUBLE AS area_growth_abs_0_5h,
  greatest(k - 75, 0) / 5.0::DOUBLE AS area_growth_rate_ha_per_h,
  hour(ts)::BIGINT AS event_start_hour, (isodow(ts) - 1)::BIGINT AS event_start_dayofweek,
  month(ts)::BIGINT AS event_start_month, (event_type = 'view')::BIGINT AS low_temporal_resolution_0_5h
"""

FEATS = f"""feats AS (
 SELECT event_id, user_id, event_type, {FEATURE_SQL}
 FROM (SELECT *, {K} AS k FROM events))"""

SUBJ = f"""subj AS MATERIALIZED (
 SELECT event_id, user_id, event_type, ts, k, value, least(h, 72.0) AS time_to_hit_hours,
  CASE WHEN next_ts IS NOT NULL AND h <= 72 THEN 1 ELSE 0 END::BIGINT AS event, {FEATURE_SQL}
 FROM (SELECT *, epoch_us(coalesce(next_ts, end_ts) - ts) / 3.6e9 AS h
  FROM (SELECT *, {K} AS k, (SELECT max(ts) FROM events) AS end_ts,
    min(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ts FROM events)))"""

HOLES = """holes AS (SELECT * REPLACE (
   CASE WHEN event_id % 97 <> 0 THEN dist_min_ci_0_5h END AS dist_min_ci_0_5h,
   CASE WHEN event_id % 89 <> 0 THEN alignment_abs END AS alignment_abs) FROM subj)"""


def _probs(scale: str, order=(12, 24, 48, 72)) -> str:
    return ", ".join(
        f"1 - exp(-{h}.0::DOUBLE / ({scale})) AS prob_{n}h"
        for n, h in zip(HORIZONS, order, strict=True)
    )


PRED = f"pred AS MATERIALIZED (SELECT *, {_probs('20.0::DOUBLE + k')} FROM subj)"
MEMB = f"""memb AS MATERIALIZED (
 SELECT event_id, 'a' AS model, time_to_hit_hours, event, {_probs('20.0::DOUBLE + k')} FROM subj
 UNION ALL SELECT event_id, 'b', time_to_hit_hours, event, {_probs('10.0::DOUBLE + value')} FROM subj
 UNION ALL SELECT event_id, 'c', time_to_hit_hours, event, {_probs('20.0::DOUBLE + k', (12, 48, 24, 72))} FROM subj)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


CONT = [
    "dist_min_ci_0_5h", "closing_speed_m_per_h", "projected_advance_m", "alignment_abs",
    "alignment_cos", "area_growth_abs_0_5h", "area_growth_rate_ha_per_h",
]
NONCONST = [c for c in FEATURES if c != "event_start_month"]
LABEL = {h: f"(CASE WHEN event = 1 AND time_to_hit_hours <= {h} THEN 1 ELSE 0 END)" for h in HORIZONS}
KEEP = {h: f"NOT (event = 0 AND time_to_hit_hours < {h})" for h in HORIZONS}
BRIER_CA = {h: f"avg(pow(prob_{h}h - {LABEL[h]}, 2)) FILTER ({KEEP[h]})" for h in HORIZONS}
BRIER = {h: f"avg(pow(prob_{h}h - {LABEL[h]}, 2))" for h in HORIZONS}
EPS = "2.220446049250313e-16"
LOGLOSS = {
    h: f"""CASE WHEN min({LABEL[h]}) <> max({LABEL[h]}) THEN avg(CASE WHEN {LABEL[h]} = 1
      THEN -ln(greatest(least(prob_{h}h, 1 - {EPS}), {EPS}))
      ELSE -ln(1 - greatest(least(prob_{h}h, 1 - {EPS}), {EPS})) END) END"""
    for h in HORIZONS
}
WB = "(0.3 * b24 + 0.4 * b48 + 0.3 * b72)"


def bin_sql(x: str, edges: str) -> str:
    """Right-closed bin over a sorted distinct edge list column."""
    return (
        f"CASE WHEN {x} >= {edges}[1] AND {x} <= {edges}[-1] THEN "
        f"len(list_filter({edges}[2:-2], lambda e: {x} > e))::BIGINT END"
    )


def edge_list(x: str, q: int, src: str, where: str = "TRUE") -> str:
    probs = ", ".join(f"{i}.0::DOUBLE / {q}" for i in range(q + 1))
    return f"(SELECT list_sort(list_distinct(quantile_cont({x}, [{probs}]))) FROM {src} WHERE {where})"


def features_geo(src: str, edges: str) -> str:
    return f"""SELECT event_id, user_id,
  {r6('closing_speed_m_per_h / (dist_min_ci_0_5h + 1)', 'threat_score')},
  {r6('least(greatest(dist_min_ci_0_5h / greatest(closing_speed_m_per_h, 1.0), 0), 200)', 'projected_arrival_h')},
  (closing_speed_m_per_h > 0)::BIGINT AS is_closing,
  {r6('ln(1 + dist_min_ci_0_5h)', 'dist_min_log')},
  {bin_sql('dist_min_ci_0_5h', edges)} AS dist_bin,
  {r6('projected_advance_m / (dist_min_ci_0_5h + 1)', 'advance_ratio')},
  {r6('alignment_abs * closing_speed_m_per_h', 'alignment_x_speed')},
  (area_growth_abs_0_5h > 0)::BIGINT AS is_growing,
  {r6('area_growth_rate_ha_per_h / (dist_min_ci_0_5h + 1)', 'growth_x_proximity')},
  {r6('closing_speed_m_per_h * area_growth_rate_ha_per_h', 'speed_x_growth')} FROM {src}"""


TEMPORAL = f"""
  {r6('sin(2 * pi() * event_start_hour / 24)', 'hour_sin')},
  {r6('cos(2 * pi() * event_start_hour / 24)', 'hour_cos')},
  {r6('sin(2 * pi() * event_start_month / 12)', 'month_sin')},
  {r6('cos(2 * pi() * event_start_month / 12)', 'month_cos')},
  (event_start_hour >= 6 AND event_start_hour < 20)::BIGINT AS is_daytime,
  (event_start_dayofweek >= 5)::BIGINT AS is_weekend"""


def _km(src: str, keys: str = "") -> str:
    """Distinct-time risk table with running survival; ``keys`` is 'g,' or empty."""
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    return f"""rt0 AS (SELECT {keys} time_to_hit_hours AS time, count(*) FILTER (event = 1) AS d,
   count(*) FILTER (event = 0) AS c FROM {src} GROUP BY {keys} time_to_hit_hours),
 rt AS MATERIALIZED (SELECT *, (sum(d + c) OVER ({part} ORDER BY time DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS n FROM rt0),
 km AS MATERIALIZED (SELECT *,
   sum(CASE WHEN d < n THEN ln(1 - d / n::DOUBLE) END) OVER w AS log_s,
   sum(CASE WHEN d < n THEN d / (n::DOUBLE * (n - d)) END) OVER w AS v,
   sum(d / n::DOUBLE) OVER w AS hz, sum(d / (n::DOUBLE * n)) OVER w AS hv
   FROM rt WINDOW w AS ({part} ORDER BY time ROWS UNBOUNDED PRECEDING))"""


def _km_probs(keys: str = "") -> str:
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    cols = ", ".join(
        r6(
            f"CASE WHEN coalesce(bool_or(time <= {h} AND d = n), false) THEN 1.0 ELSE "
            f"1 - exp(coalesce(sum(CASE WHEN time <= {h} AND d < n THEN ln(1 - d / n::DOUBLE) END), 0)) END",
            f"prob_{h}h",
        )
        for h in HORIZONS
    )
    return f"SELECT {keys} sum(d + c)::BIGINT AS n, sum(d)::BIGINT AS hits, {cols} FROM rt {group}"


def _logrank(pairs: list[tuple[str, str]], digits: int, min_side: int) -> str:
    """(name, boolean) splits; risk sets by windows over distinct times."""
    parts = []
    for name, cond in pairs:
        parts.append(
            f"""SELECT '{name}' AS test, sum(a)::BIGINT AS n_a, (sum(m) - sum(a))::BIGINT AS n_b,
   {r6('sum(da - d * na / n)', 'observed_minus_expected', digits)},
   {r6('sum(CASE WHEN n > 1 THEN d * (na / n) * (1 - na / n) * (n - d) / (n - 1) ELSE 0 END)', 'variance', digits)},
   {r6('pow(sum(da - d * na / n), 2) / nullif(sum(CASE WHEN n > 1 THEN d * (na / n) * (1 - na / n) * (n - d) / (n - 1) ELSE 0 END), 0)', 'test_statistic', digits)}
 FROM (SELECT *, (sum(m) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING))::DOUBLE AS n,
        (sum(a) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING))::DOUBLE AS na
   FROM (SELECT time_to_hit_hours AS t, count(*) AS m, count(*) FILTER (g) AS a,
      (count(*) FILTER (event = 1))::DOUBLE AS d, (count(*) FILTER (event = 1 AND g))::DOUBLE AS da
     FROM (SELECT *, {cond} AS g FROM subj) WHERE g IS NOT NULL GROUP BY 1))
 HAVING sum(a) >= {min_side} AND sum(m) - sum(a) >= {min_side}"""
        )
    return union(parts)


def _bins(cols: list[str], bins: int, by: str, src: str) -> str:
    parts = [
        f"""SELECT {by}, '{c}' AS feature, CAST(least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bin,
  lo, (hi - lo) / {bins} AS w FROM (SELECT {by}, {c}::DOUBLE AS x, (SELECT min({c})::DOUBLE FROM {src}) AS lo,
  (SELECT max({c})::DOUBLE FROM {src}) AS hi FROM {src})"""
        for c in cols
    ]
    return f"""SELECT {by}, feature, bin, {r6('any_value(lo) + bin * any_value(w)', 'bin_start')}, count(*) AS n,
 {r6(f'count(*) / (sum(count(*)) OVER (PARTITION BY {by}, feature) * any_value(w))', 'density')}
 FROM ({union(parts)}) GROUP BY {by}, feature, bin"""


def _psi(c: str) -> str:
    inner = f"list_sort(list_distinct(quantile_cont({c}, [{', '.join(f'{i}/10.0::DOUBLE' for i in range(11))}])))"
    return f"""SELECT '{c}' AS feature, {r6('sum((p - q) * ln(p / q))', 'psi')}, sum((p - q) * ln(p / q)) > 0.2 AS alert FROM (
 SELECT greatest(nb / sum(nb) OVER (), 1e-6) AS p, greatest(no / sum(no) OVER (), 1e-6) AS q FROM (
  SELECT bin, (count(*) FILTER (user_id % 10 < 7))::DOUBLE AS nb, (count(*) FILTER (user_id % 10 >= 7))::DOUBLE AS no
  FROM (SELECT user_id, len(list_filter(e[2:-2], lambda z: {c} > z)) AS bin FROM subj,
    (SELECT {inner} AS e FROM subj WHERE user_id % 10 < 7)) GROUP BY bin))"""


def _chi(c: str) -> str:
    return f"""SELECT '{c}' AS feature, {r6('sum(pow(a - (a + b) * ta / (ta + tb), 2) / ((a + b) * ta / (ta + tb)) + pow(b - (a + b) * tb / (ta + tb), 2) / ((a + b) * tb / (ta + tb)))', 'chi_square')},
  count(*) - 1 AS dof FROM (SELECT a, b, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM (
   SELECT (count(*) FILTER (user_id % 10 < 7))::DOUBLE AS a, (count(*) FILTER (user_id % 10 >= 7))::DOUBLE AS b
   FROM subj GROUP BY {c}))"""


def _describe(group: str, src: str, cols: list[str]) -> str:
    return union(
        [
            f"""SELECT {group}, '{c}' AS feature, count({c}) AS count, {r6(f'avg({c})', 'mean')}, {r6(f'stddev_samp({c})', 'std')},
 {r6(f'min({c})', 'min')}, {r6(f'max({c})', 'max')}, {r6(f'quantile_cont({c}, 0.25)', 'q25')},
 {r6(f'quantile_cont({c}, 0.5)', 'q50')}, {r6(f'quantile_cont({c}, 0.75)', 'q75')} FROM {src} GROUP BY 1"""
            for c in cols
        ]
    )


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN least(corr({a}, {b}), 1.0) END"


def _calibration(edges_by_model: bool = True) -> str:
    per_h = []
    for h in HORIZONS:
        probs = ", ".join(f"{i}/8.0::DOUBLE" for i in range(9))
        per_h.append(
            f"""SELECT model, {h} AS horizon, len(list_filter(e[2:-2], lambda z: p > z))::INTEGER AS bin, p, y FROM (
  SELECT m.model, m.prob_{h}h AS p, {LABEL[h]} AS y, e FROM memb m JOIN
   (SELECT model, quantile_cont(prob_{h}h, [{probs}]) AS e FROM memb GROUP BY model) q USING (model))"""
        )
    return f"""cal AS (SELECT model, horizon, bin, count(*) AS n, avg(p) AS mean_pred, avg(y) AS frac_pos
  FROM ({union(per_h)}) GROUP BY ALL)"""


def _auc(src: str = "memb") -> str:
    per_h = [
        f"SELECT model, {h} AS horizon, prob_{h}h AS p, {LABEL[h]} AS y FROM {src}" for h in HORIZONS
    ]
    return f"""auc0 AS (SELECT model, horizon, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM ({union(per_h)}) GROUP BY ALL),
 auc1 AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, horizon ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM auc0),
 auc2 AS (SELECT model, horizon, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM auc1 GROUP BY ALL)"""


def _concordance(src: str, model: str = "model,") -> str:
    """Pairs by self join over distinct (time, status, risk)."""
    on = "i.model = j.model AND" if model else ""
    sel = "i.model," if model else ""
    grp = "GROUP BY i.model" if model else ""
    return f"""cr AS MATERIALIZED (SELECT {model} time_to_hit_hours AS t, event AS e, prob_72h AS r, count(*)::DOUBLE AS n FROM {src} GROUP BY ALL),
 cx AS (SELECT {sel} sum(i.n * j.n * (i.r > j.r)::INT) AS concordant, sum(i.n * j.n * (i.r = j.r)::INT) AS tied,
   sum(i.n * j.n) AS comparable FROM cr i JOIN cr j ON {on} i.e = 1 AND j.t >= i.t AND (j.t > i.t OR j.e = 0) {grp})"""


CINDEX = "(concordant + 0.5 * tied) / nullif(comparable, 0)"

ERR = f"""err AS MATERIALIZED (SELECT *, ({' + '.join(f'pow(prob_{h}h - {LABEL[h]}, 2)' for h in HORIZONS)}) / 4 AS brier_sample,
  {LABEL[72]} AS label_72h, abs(prob_72h - {LABEL[72]}) AS abs_err_72h FROM pred)"""

MONO = ", ".join(
    r6(
        "least(greatest(" + ", ".join(f"prob_{x}h" for x in HORIZONS[: i + 1]) + ", 0), 1)", f"prob_{h}h"
    )
    for i, h in enumerate(HORIZONS)
)


def _folds(seed: int) -> str:
    return f"((row_number() OVER (PARTITION BY event ORDER BY md5(event_id || '|{seed}'), event_id)) - 1) % 5"


def _mi(c: str) -> str:
    probs = ", ".join(f"{i}/16.0::DOUBLE" for i in range(17))
    return f"""SELECT '{c}' AS feature, {r6('sum(n / nt * ln(n * nt / (nx * ny)))', 'mi_score')} FROM (
 SELECT n, sum(n) OVER (PARTITION BY bx) AS nx, sum(n) OVER (PARTITION BY bt) AS ny, sum(n) OVER () AS nt FROM (
  SELECT bx, bt, count(*)::DOUBLE AS n FROM (
   SELECT len(list_filter(ex[2:-2], lambda z: {c} > z)) AS bx, len(list_filter(et[2:-2], lambda z: time_to_hit_hours > z)) AS bt
   FROM subj, (SELECT list_sort(list_distinct(quantile_cont({c}::DOUBLE, [{probs}]))) AS ex,
     list_sort(list_distinct(quantile_cont(time_to_hit_hours, [{probs}]))) AS et FROM subj)) GROUP BY ALL))"""


def oracle_queries() -> dict[str, str]:
    o: dict[str, str] = {}
    ranges = {**VALID_RANGES, "dist_min_ci_0_5h": (100.0, 9000.0), "alignment_abs": (0.05, 0.9)}
    have = [*FEATURES, "time_to_hit_hours", "event"]
    cols = ["event_id", *have]

    edges_all = f"fe AS (SELECT {edge_list('dist_min_ci_0_5h', 3, 'feats')} AS e)"
    o["features_geospatial"] = with_(FEATS, edges_all) + (
        f"SELECT * EXCLUDE (user_id) FROM ({features_geo('feats, fe', 'e')})"
    )
    o["features_temporal"] = with_(FEATS) + f"SELECT event_id, {TEMPORAL} FROM feats"
    base = [c for c in FEATURES if c != "closing_speed_abs_m_per_h"]
    base_sql = ", ".join(
        f"f.{c}" if c.startswith("event_start") or c.startswith("low_") else r6(f"f.{c}", c) for c in base
    )
    o["features_full"] = with_(
        FEATS,
        f"e1 AS (SELECT {edge_list('dist_min_ci_0_5h', 3, 'feats', 'user_id % 10 < 7')} AS e)",
        f"e2 AS (SELECT {edge_list('dist_min_ci_0_5h', 3, 'feats', 'user_id % 10 >= 7')} AS e)",
        f"geo AS ({features_geo('(SELECT * FROM feats WHERE user_id % 10 < 7), e1', 'e')} UNION ALL "
        f"{features_geo('(SELECT * FROM feats WHERE user_id % 10 >= 7), e2', 'e')})",
    ) + f"SELECT f.event_id, {base_sql}, geo.* EXCLUDE (event_id, user_id), {TEMPORAL} FROM feats f JOIN geo USING (event_id)"
    o["quantile_bins"] = with_(
        FEATS, f"fe AS (SELECT {edge_list('dist_min_ci_0_5h', 3, 'feats', 'user_id % 10 < 7')} AS e)"
    ) + f"SELECT {bin_sql('dist_min_ci_0_5h', 'e')} AS bin, count(*) AS n FROM feats, fe GROUP BY 1"
    o["horizon_labels"] = with_(SUBJ) + union(
        [f"SELECT {h} AS horizon, sum({LABEL[h]})::BIGINT AS positives, count(*) FILTER ({KEEP[h]}) AS scored FROM subj" for h in HORIZONS]
    )

    o["validate_nulls"] = with_(SUBJ, HOLES) + union(
        [f"SELECT '{c}' AS column, count(*) FILTER ({c} IS NULL) AS null_count FROM holes" for c in cols]
    )
    o["validate_ranges"] = with_(SUBJ, HOLES) + union(
        [
            f"SELECT '{c}' AS column, {float(lo)}::DOUBLE AS low, {float(hi)}::DOUBLE AS high, count(*) FILTER ({c} < {lo}) AS below_count, count(*) FILTER ({c} > {hi}) AS above_count FROM holes"
            for c, (lo, hi) in ranges.items() if c in have
        ]
    )
    o["validate_row_count"] = union([
        f"SELECT '{name}' AS table, count(*) AS actual, (SELECT count(*) FROM events) AS expected, abs(count(*) - (SELECT count(*) FROM events)) / (SELECT count(*) FROM events) <= 0.01 AS passed FROM events WHERE {rows}"
        for name, rows in (("whole", "true"), ("short", "event_id % 40 <> 0"))
    ])
    o["validate_all"] = with_(SUBJ, HOLES) + union(
        [f"SELECT 'nulls' AS check, '{c}' AS target, count(*) FILTER ({c} IS NULL) AS violations, count(*) FILTER ({c} IS NULL) = 0 AS passed FROM holes" for c in cols]
        + [
            f"SELECT 'ranges', '{c}', count(*) FILTER ({c} < {lo} OR {c} > {hi}), count(*) FILTER ({c} < {lo} OR {c} > {hi}) = 0 FROM holes"
            for c, (lo, hi) in VALID_RANGES.items() if c in have
        ]
        + ["SELECT 'row_count', 'rows', abs(count(*) - (SELECT count(*) FROM events)), abs(count(*) - (SELECT count(*) FROM events)) / (SELECT count(*) FROM events) <= 0.01 FROM holes"]
    )
    drops = " OR ".join(f"prob_{b}h < prob_{a}h - 1e-9" for a, b in ((12, 24), (24, 48), (48, 72)))
    outside = " OR ".join(f"prob_{h}h < 0 OR prob_{h}h > 1" for h in HORIZONS)
    o["submission_contract"] = with_(SUBJ, MEMB) + f"""SELECT count(*) AS n_rows, 0::BIGINT AS null_rows,
 count(*) FILTER ({outside}) AS out_of_range_rows, count(*) FILTER ({drops}) AS non_monotone_rows,
 (SELECT count(*) FROM subj s WHERE NOT EXISTS (SELECT 1 FROM memb m WHERE m.model = 'c' AND m.event_id = s.event_id)) AS missing_ids,
 0::BIGINT AS unknown_ids, (SELECT count(*) FROM subj) AS expected_rows FROM memb WHERE model = 'c'"""
    o["profile"] = with_(SUBJ, HOLES) + union(
        [
            f"""SELECT '{c}' AS column, '{'bigint' if c.startswith(('event', 'low_')) else 'double'}' AS dtype,
 count(*) FILTER ({c} IS NULL) AS null_count, round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct,
 {r6(f'min({c})::DOUBLE', 'min')}, {r6(f'max({c})::DOUBLE', 'max')}, {r6(f'avg({c})', 'mean')}, {r6(f'stddev_samp({c})', 'std')},
 {r6(f'quantile_cont({c}::DOUBLE, 0.5)', 'median')}, {r6(f'count(*) FILTER ({c} = 0) / count(*)::DOUBLE', 'zero_fraction')},
 count(*) FILTER ({c} < 0) AS negative_count, count(DISTINCT {c}) AS n_unique FROM holes"""
            for c in have
        ]
    )
    o["monitoring_profile"] = with_(SUBJ) + union(
        [
            f"""SELECT '{c}' AS column, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers,
 {r6(f'avg({c})', 'mean')}, {r6('any_value(bm)', 'baseline_mean')}, {r6(f'(avg({c}) - any_value(bm)) / nullif(any_value(bs), 0)', 'mean_shift_std')}
 FROM (SELECT * FROM subj WHERE user_id % 10 >= 7),
 (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM subj WHERE user_id % 10 >= 7),
 (SELECT avg({c}) AS bm, stddev_samp({c}) AS bs FROM subj WHERE user_id % 10 < 7)"""
            for c in CONT
        ]
    )
    o["zero_fraction"] = with_(SUBJ) + union(
        [f"SELECT '{c}' AS column, {r6(f'count(*) FILTER ({c} = 0) / count(*)::DOUBLE', 'zero_fraction')}, count(*) FILTER ({c} = 0) / count(*)::DOUBLE > 0.5 AS mostly_zero FROM subj" for c in FEATURES]
    )
    o["negative_counts"] = with_(SUBJ) + union(
        [f"SELECT '{c}' AS column, count(*) FILTER ({c} < 0) AS negative_count, {r6(f'count(*) FILTER ({c} < 0) / count(*)::DOUBLE', 'negative_rate')} FROM subj HAVING count(*) FILTER ({c} < 0) > 0" for c in FEATURES]
    )
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in cols)
    cells = " + ".join(f"(count(*) FILTER ({c} IS NULL) > 0)::INT" for c in cols)
    o["null_totals"] = with_(SUBJ, HOLES) + f"SELECT ({nulls})::BIGINT AS total_nulls, ({cells})::BIGINT AS columns_with_nulls FROM holes"
    o["duplicate_rows"] = with_(FEATS) + """SELECT sum(n)::BIGINT AS n_rows, (sum(n) - count(*))::BIGINT AS duplicate_rows FROM (
 SELECT count(*) AS n FROM feats GROUP BY event_start_hour, alignment_abs, dist_min_ci_0_5h)"""
    o["histograms"] = with_(SUBJ) + _bins([*CONT, "time_to_hit_hours"], 20, "event", "subj")
    o["split_histograms"] = with_(
        SUBJ, "sp AS (SELECT *, CASE WHEN user_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM subj)"
    ) + _bins(CONT, 30, "split", "sp")
    o["psi"] = with_(SUBJ) + union([_psi(c) for c in CONT])
    o["chi_square_drift"] = with_(SUBJ) + union(
        [_chi(c) for c in ("event_start_hour", "event_start_dayofweek", "low_temporal_resolution_0_5h")]
    )

    o["horizon_counts"] = with_(SUBJ) + union(
        [f"SELECT {h} AS horizon, sum({LABEL[h]})::BIGINT AS hits, {r6(f'avg({LABEL[h]})', 'rate')} FROM subj" for h in HORIZONS]
    )
    o["censoring_rate"] = with_(SUBJ) + f"""SELECT count(*) AS n, count(*) FILTER (event = 1) AS n_events, count(*) FILTER (event = 0) AS n_censored,
 {r6('avg((event = 0)::INT)', 'censoring_rate')}, {r6('avg((event = 1)::INT)', 'event_rate')} FROM subj"""
    t = "time_to_hit_hours"
    o["target_stats"] = with_(SUBJ) + f"SELECT {r6(f'min({t})', 'min')}, {r6(f'max({t})', 'max')}, {r6(f'avg({t})', 'mean')}, {r6(f'stddev_samp({t})', 'std')}, {r6(f'quantile_cont({t}, 0.5)', 'median')} FROM subj"
    o["describe_by_event"] = with_(SUBJ) + _describe("event", "subj", CONT)
    for name, c in (("weekday", "event_start_dayofweek"), ("month", "event_start_month")):
        o[f"hit_rate_by_{name}"] = with_(SUBJ) + f"SELECT {c}, {r6('avg(event)', 'hit_rate')}, count(*) AS n FROM subj GROUP BY 1"
    flags = {
        "low_temporal_resolution_0_5h": "low_temporal_resolution_0_5h",
        "is_daytime": "(event_start_hour >= 6 AND event_start_hour < 20)::BIGINT",
        "is_weekend": "(event_start_dayofweek >= 5)::BIGINT",
    }
    o["binary_flag_rates"] = with_(SUBJ) + union(
        [f"SELECT '{n}' AS feature, {e} AS value, {r6('avg(event)', 'hit_rate')}, count(*) AS n FROM subj GROUP BY 2" for n, e in flags.items()]
    )
    bands = f"bd AS (SELECT {edge_list('dist_min_ci_0_5h', 4, 'subj')} AS e)"
    band = f"'Q' || ({bin_sql('dist_min_ci_0_5h', 'e')} + 1)"
    o["quantile_band_rates"] = with_(SUBJ, bands) + f"SELECT {band} AS band, count(*) AS n, {r6('avg(event)', 'hit_rate')} FROM subj, bd GROUP BY 1"
    o["feature_moments"] = with_(SUBJ) + union(
        [f"SELECT '{c}' AS column, {r6(f'avg({c})', 'mean')}, {r6(f'stddev_samp({c})', 'std')} FROM subj" for c in FEATURES]
    )
    o["censored_quantiles"] = with_(SUBJ) + f"SELECT count(*) AS n, {r6(f'avg({t})', 'mean')}, 0.9::DOUBLE AS q, {r6(f'quantile_cont({t}, 0.9)', 'quantile')}, {r6(f'quantile_cont({t}, 0.5)', 'median')} FROM subj WHERE event = 0"
    o["event_timeline"] = with_(SUBJ) + f"SELECT event_id, {r6(t, t)}, event, row_number() OVER (ORDER BY {t}, event_id) AS position FROM (SELECT event_id, {t}, event FROM subj) s0"
    wide = ", ".join(f"{_corr(a, b)} AS c{i}_{j}" for i, a in enumerate(NONCONST) for j, b in enumerate(NONCONST))
    cm = f"cm AS MATERIALIZED (SELECT {wide} FROM subj)"
    o["correlation_matrix"] = with_(SUBJ, cm) + union(
        [f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r6(f'c{i}_{j}', 'r')} FROM cm" for i, a in enumerate(NONCONST) for j, b in enumerate(NONCONST)]
    )
    o["correlated_pairs"] = with_(SUBJ, cm) + union(
        [f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(abs(c{i}_{j}), 4) AS r FROM cm WHERE abs(c{i}_{j}) > 0.85" for i, a in enumerate(NONCONST) for j, b in enumerate(NONCONST) if j > i]
    )
    for name, target in (("target_correlation", t), ("event_correlation", "event")):
        o[name] = with_(SUBJ) + union([f"SELECT '{c}' AS feature, {r6(_corr(c, target), 'r')} FROM subj" for c in NONCONST])

    surv = "CASE WHEN d = n THEN 0.0 ELSE exp(coalesce(log_s, 0)) END"
    o["km_curve"] = with_(SUBJ, _km("subj")) + f"SELECT {r6('time', 'time')}, n, d, c, {r6(surv, 'survival')} FROM km"
    o["km_horizons"] = with_(SUBJ, _km("subj")) + _km_probs()
    o["km_by_group"] = with_(SUBJ, _km("subj", "event_type, ")) + _km_probs("event_type, ")
    o["km_by_flag"] = with_(SUBJ, _km("subj", "low_temporal_resolution_0_5h, ")) + _km_probs("low_temporal_resolution_0_5h, ")
    z = "1.959963984540054 * sqrt(v) / abs(log_s)"
    band_ok = "CASE WHEN d < n AND log_s < 0 THEN "
    o["km_band"] = with_(SUBJ, _km("subj", "event_type, ")) + f"""SELECT event_type, {r6('time', 'time')},
 {r6(f'{band_ok} exp(-exp(ln(-log_s) + {z})) END', 'survival_lower')}, {r6(f'{band_ok} exp(-exp(ln(-log_s) - {z})) END', 'survival_upper')} FROM km"""
    o["km_stratified"] = with_(
        SUBJ, f"sb AS (SELECT {edge_list('dist_min_ci_0_5h', 3, 'subj')} AS e)",
        f'sg AS (SELECT *, \'Q\' || ({bin_sql("dist_min_ci_0_5h", "e")} + 1) AS "group" FROM subj, sb)', _km("sg", '"group", '),
    ) + _km_probs('"group", ')
    o["cumulative_incidence_grid"] = with_(
        SUBJ, _km("subj"), "grid AS (SELECT i::BIGINT AS cell, i * (72.0::DOUBLE / 199) AS time FROM range(200) r(i))",
        f"""st AS (SELECT g.cell, g.time, 1 - coalesce(arg_max({surv}, km.time), 1.0) AS inc
  FROM grid g LEFT JOIN km ON km.time <= g.time GROUP BY ALL)""",
    ) + f"SELECT cell, {r6('time', 'time')}, {r6('inc', 'incidence')} FROM st"
    o["nelson_aalen"] = with_(SUBJ, _km("subj")) + f"SELECT {r6('time', 'time')}, {r6('hz', 'hazard')}, {r6('hv', 'hazard_var')}, {r6('hz * exp(-1.959963984540054 * sqrt(hv) / nullif(hz, 0))', 'hazard_lower')}, {r6('hz * exp(1.959963984540054 * sqrt(hv) / nullif(hz, 0))', 'hazard_upper')} FROM km"
    steps = ", ".join(
        r6(f"coalesce(arg_max({surv}, time) FILTER (time <= {h}), arg_min({surv}, time))", f"survival_{h}h") for h in (12, 24, 48, 72, 96)
    )
    o["survival_at_clamped_times"] = with_(SUBJ, _km("subj", "event_type, ")) + f"SELECT event_type, {steps} FROM km GROUP BY 1"
    o["logrank_two_group"] = with_(SUBJ) + _logrank([("low_resolution", "low_temporal_resolution_0_5h = 1")], 5, 0)
    e3 = edge_list("dist_min_ci_0_5h", 3, "subj")
    o["logrank_stratified"] = with_(SUBJ) + _logrank(
        [("dist_min_ci_0_5h", f"CASE WHEN dist_min_ci_0_5h <= {e3}[2] THEN true WHEN dist_min_ci_0_5h > {e3}[3] THEN false END")], 5, 0
    )
    o["logrank_scan"] = with_(SUBJ) + _logrank(
        [(c, f"{c} <= (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM subj)") for c in FEATURES], 4, 5
    )

    o["brier_censor_aware"] = with_(SUBJ, MEMB) + "SELECT model, " + ", ".join(r6(BRIER_CA[h], f"brier_{h}h_ca") for h in HORIZONS) + " FROM memb GROUP BY 1"
    inner = ", ".join(f"{BRIER_CA[h]} AS b{h}" for h in (24, 48, 72))
    ca_cols = ", ".join(r6(f"b{h}", f"brier_{h}h_ca") for h in (24, 48, 72))
    o["weighted_brier"] = with_(SUBJ, MEMB) + f"SELECT model, {ca_cols}, {r6(WB, 'weighted_brier')} FROM (SELECT model, {inner} FROM memb GROUP BY 1)"
    mean4 = "(" + " + ".join(BRIER[h] for h in HORIZONS) + ") / 4"
    o["brier_naive"] = with_(SUBJ, MEMB) + "SELECT model, " + ", ".join(r6(BRIER[h], f"brier_{h}h_naive") for h in HORIZONS) + f", {r6(mean4, 'brier_mean')} FROM memb GROUP BY 1"
    o["log_loss"] = with_(SUBJ, MEMB) + "SELECT model, " + ", ".join(r6(LOGLOSS[h], f"logloss_{h}h") for h in HORIZONS) + " FROM memb GROUP BY 1"
    o["auc"] = with_(SUBJ, MEMB, _auc()) + f"SELECT model, horizon, {r6('auc', 'auc')} FROM auc2"
    o["c_index"] = with_(SUBJ, MEMB, _concordance("memb")) + f"SELECT model, {r6('concordant', 'concordant')}, {r6('tied', 'tied')}, {r6('comparable', 'comparable')}, {r6(CINDEX, 'c_index')} FROM cx"
    o["hybrid_score"] = with_(SUBJ, PRED, _concordance("pred", "")) + f"""SELECT {ca_cols}, {r6(WB, 'weighted_brier')}, {r6(CINDEX, 'c_index')},
 {r6(f'0.3 * {CINDEX} + 0.7 * (1 - {WB})', 'hybrid_score')} FROM cx, (SELECT {inner} FROM pred)"""
    o["calibration_curve"] = with_(SUBJ, MEMB, _calibration()) + f"SELECT model, horizon, bin, n, {r6('mean_pred', 'mean_pred')}, {r6('frac_pos', 'frac_pos')} FROM cal"
    gap = "CASE WHEN max(frac_pos) > 0 AND min(frac_pos) < 1 AND sum(n) >= 40 THEN avg(abs(frac_pos - mean_pred)) END"
    o["calibration_gap"] = with_(SUBJ, MEMB, _calibration()) + f"SELECT model, {r6(gap, 'calibration_gap_72h')} FROM cal WHERE horizon = 72 GROUP BY 1"
    auc_cols = ", ".join(f"max(auc) FILTER (horizon = {h}) AS a{h}" for h in HORIZONS)
    everything = ", ".join(
        [f"{BRIER[h]} AS n{h}" for h in HORIZONS] + [f"{LOGLOSS[h]} AS l{h}" for h in HORIZONS] + [inner]
    )
    o["all_metrics"] = with_(SUBJ, MEMB, _concordance("memb"), _auc(), _calibration()) + f"""SELECT model, n, {ca_cols},
 {', '.join(r6(f'n{h}', f'brier_{h}h_naive') for h in HORIZONS)}, {', '.join(r6(f'l{h}', f'logloss_{h}h') for h in HORIZONS)},
 {r6(WB, 'weighted_brier')}, {r6('(n12 + n24 + n48 + n72) / 4', 'brier_mean')}, {r6(CINDEX, 'c_index')},
 {', '.join(r6(f'a{h}', f'auc_{h}h') for h in HORIZONS)}, {r6('gap', 'calibration_gap_72h')},
 {r6(f'0.3 * {CINDEX} + 0.7 * (1 - {WB})', 'hybrid_score')}
 FROM (SELECT model, count(*) AS n, {everything} FROM memb GROUP BY 1) JOIN cx USING (model)
 JOIN (SELECT model, {auc_cols} FROM auc2 GROUP BY 1) USING (model)
 JOIN (SELECT model, {gap} AS gap FROM cal WHERE horizon = 72 GROUP BY 1) USING (model)"""
    o["hard_predictions"] = with_(SUBJ, MEMB) + "SELECT model, (prob_72h >= 0.5)::INT AS predicted, count(*) AS n, sum(event)::BIGINT AS events FROM memb GROUP BY 1, 2"

    o["per_sample_brier"] = with_(SUBJ, PRED, ERR) + f"SELECT event_id, {r6('brier_sample', 'brier_sample')}, label_72h, {r6('abs_err_72h', 'abs_err_72h')} FROM err"
    o["error_summary"] = with_(SUBJ, PRED, ERR) + f"SELECT {r6('avg(brier_sample)', 'mean')}, {r6('max(brier_sample)', 'max')}, {r6('quantile_cont(brier_sample, 0.5)', 'median')} FROM err"
    o["worst_k"] = with_(SUBJ, PRED, ERR) + f"SELECT event_id, {r6('brier_sample', 'brier_sample')}, event, {r6(t, t)}, {r6('prob_72h', 'prob_72h')} FROM err ORDER BY err.brier_sample DESC, event_id LIMIT 15"
    o["worst_decile_profile"] = with_(
        SUBJ, PRED, ERR, "wd AS (SELECT *, brier_sample >= (SELECT quantile_cont(brier_sample, 0.9) FROM err) AS worst FROM err)"
    ) + union(
        [
            f"""SELECT '{c}' AS feature, {r6('w', 'worst_mean', 5)}, {r6('r', 'rest_mean', 5)}, {r6('abs(w - r)', 'abs_diff', 5)}, {r6('(w - r) / nullif(s, 0)', 'std_diff', 5)}
 FROM (SELECT avg({c}) FILTER (worst) AS w, avg({c}) FILTER (NOT worst) AS r, stddev_samp({c}) FILTER (NOT worst) AS s FROM wd)"""
            for c in CONT
        ]
    )
    o["error_by_band"] = with_(SUBJ, PRED, ERR, bands) + f"SELECT {band} AS band, count(*) AS n, {r6('avg(event)', 'hit_rate')}, {r6('avg(brier_sample)', 'mean_error')} FROM err, bd GROUP BY 1"
    o["error_by_time"] = with_(SUBJ, PRED, ERR) + union(
        [f"SELECT '{u}' AS unit, {c} AS value, {r6('avg(brier_sample)', 'mean_error')}, count(*) AS n, {r6('avg(event)', 'hit_rate')} FROM err GROUP BY 2" for u, c in (("hour", "event_start_hour"), ("month", "event_start_month"))]
    )
    o["false_negatives"] = with_(SUBJ, PRED) + f"SELECT event_id, {r6(t, t)}, {r6('prob_72h * 0.5', 'prob_72h')} FROM pred WHERE {LABEL[72]} = 1 AND prob_72h * 0.5 < 0.3"
    o["false_positives"] = with_(SUBJ, PRED) + f"SELECT event_id, {r6(t, t)}, {r6('prob_72h', 'prob_72h')} FROM pred WHERE {LABEL[72]} = 0 AND prob_72h > 0.7"
    o["describe_predictions"] = with_(SUBJ, PRED, "pa AS (SELECT *, 'all' AS all_rows FROM pred)") + _describe("all_rows", "pa", [f"prob_{h}h" for h in HORIZONS])

    o["monotone_repair"] = with_(SUBJ, MEMB) + f"SELECT event_id, {MONO} FROM memb WHERE model = 'c'"
    sums = ", ".join(f"sum(CASE model WHEN 'a' THEN 0.6 ELSE 0.2 END::DOUBLE * prob_{h}h) AS prob_{h}h" for h in HORIZONS)
    o["weighted_average_members"] = with_(SUBJ, MEMB) + f"SELECT event_id, {MONO} FROM (SELECT event_id, {sums} FROM memb GROUP BY 1)"
    o["stratified_folds"] = with_(SUBJ) + f"SELECT event_id, event, ({_folds(42)})::INT AS fold FROM subj"
    o["repeated_fold_counts"] = with_(SUBJ) + f"""SELECT repeat, fold, count(*) AS n, sum(event)::BIGINT AS events, sum(event_id)::BIGINT AS id_sum FROM (
 {union([f'SELECT {i} AS repeat, ({_folds(42 + i)})::INT AS fold, event, event_id FROM subj' for i in range(3)])}) GROUP BY 1, 2"""
    o["holdout_split"] = with_(SUBJ) + """SELECT event_id, event, row_number() OVER (PARTITION BY event ORDER BY md5(event_id || '|42'), event_id)
 <= round(0.25 * count(*) OVER (PARTITION BY event)) AS holdout FROM subj"""
    o["km_baseline_predict"] = with_(
        SUBJ, "tr AS (SELECT * FROM subj WHERE user_id % 10 < 7)", _km("tr"), f"pr AS ({_km_probs()})"
    ) + "SELECT s.event_id, prob_12h, prob_24h, prob_48h, prob_72h FROM subj s, pr WHERE s.user_id % 10 >= 7"
    o["submission"] = with_(SUBJ, MEMB) + f"SELECT event_id, {MONO} FROM (SELECT * REPLACE (prob_72h * 1.2::DOUBLE AS prob_72h) FROM memb WHERE model = 'c')"
    o["cv_metric_summary"] = with_(
        SUBJ, PRED, f"fo AS (SELECT *, {_folds(42)} AS fold FROM pred)",
        f"fm AS (SELECT fold, {inner}, {mean4} AS bm FROM fo GROUP BY 1)",
    ) + union(
        [f"SELECT 'closed_form' AS model, '{n}' AS metric, {r6(f'avg({e})', 'mean')}, {r6(f'stddev_pop({e})', 'std')}, count({e}) AS folds FROM fm" for n, e in (("weighted_brier", WB), ("brier_mean", "bm"), ("brier_72h_ca", "b72"))]
    )
    o["binned_mutual_information"] = with_(SUBJ) + union([_mi(c) for c in FEATURES])
    o["stars"] = with_(SUBJ) + """SELECT CASE WHEN k / 1000.0::DOUBLE < 0.001 THEN '***' WHEN k / 1000.0::DOUBLE < 0.01 THEN '**'
 WHEN k / 1000.0::DOUBLE < 0.05 THEN '*' ELSE 'ns' END AS stars, count(*) AS n FROM subj GROUP BY 1"""
    med = {c: f"(SELECT quantile_cont({c}, 0.5) FROM holes WHERE user_id % 10 < 7)" for c in ("dist_min_ci_0_5h", "alignment_abs")}
    o["median_imputation"] = with_(SUBJ, HOLES) + "SELECT event_id, " + ", ".join(r6(f"coalesce({c}, {m})", c) for c, m in med.items()) + " FROM holes"
    o["joint_median_imputation"] = with_(SUBJ, HOLES) + f"""SELECT event_id, CASE WHEN user_id % 10 < 7 THEN 'train' ELSE 'test' END AS split,
 {r6('coalesce(dist_min_ci_0_5h, (SELECT quantile_cont(dist_min_ci_0_5h, 0.5) FROM holes))', 'dist_min_ci_0_5h')} FROM holes"""
    o["factorized_types"] = "SELECT (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS code, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM events GROUP BY event_type"
    o["best_model"] = with_(SUBJ, MEMB) + f"SELECT arg_min(model, {WB}) AS model FROM (SELECT model, {inner} FROM memb GROUP BY 1)"
    return o

"""Registered queries of jobs, sources, models at fixed parameters and held-out schemes.

What a fit iterates to cannot be put in SQL; what it is made of can: likelihoods and
gradients at fixed coefficients, closed-form members inside the same cross-validation,
isotonic fits by the min-max formula. Each has its SQL beside it.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from durata.constants import CORRELATION_THRESHOLD, EVENT, HORIZONS, ID, PROB_COLS, TIME
from durata.functions.columns import bearing_radians, numeric_columns, recode
from durata.functions.impute import Standardizer
from durata.functions.labels import positive_time, survival_pair
from durata.models.aft import AFTModel
from durata.models.cox import TimeSorted
from durata.models.marginal import KaplanMeierModel
from durata.models.stacking import IsotonicCalibrator
from durata.models.validation import cross_validate, holdout_predictions, oof_predictions, refit_and_predict, repeated_cv
from durata.operators import survival as SU
from durata.plans import jobs
from durata.plans.catalog import members, predicted, query, rounded, subject_table
from durata.plans.oracle import (
    BRIER_CA,
    FEATS,
    MEMB,
    PRED,
    SUBJ,
    TEMPORAL,
    WB,
    _concordance,
    _corr,
    _folds,
    _km,
    _km_probs,
    _logrank,
    _mi,
    CINDEX,
    edge_list,
    features_geo,
    r6,
    union,
    with_,
)
from durata.session import shared_folder
from durata.sources import events as EV
from durata.sources import tables as TA

SQL: dict[str, str] = {}
STD = ["dist_min_ci_0_5h", "closing_speed_m_per_h", "alignment_cos"]
BETA = [-0.4, 0.3, 0.1]
PROBS = ", ".join(f"prob_{h}h" for h in HORIZONS)


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


# --- sources and jobs ---


@query
def csv_round_trip(spark, d):
    """Subjects written as CSV, read back with their schema, typed columns summed."""
    df = subject_table(spark, d).select(ID, "event_type", *STD, TIME, EVENT)
    back = TA.read_csv(spark, TA.write_csv(df, scratch(spark)), df.schema)
    return rounded(back.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(ID).alias("id_sum"), F.sum(EVENT).alias("events"),
        *[F.avg(c).alias(c) for c in STD],
    ), 4)


SQL["csv_round_trip"] = with_(SUBJ) + f"""SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS id_sum, sum(event)::BIGINT AS events,
 {', '.join(r6(f'avg({c})', c, 4) for c in STD)} FROM subj GROUP BY 1"""


@query
def parquet_round_trip(spark, d):
    """A partitioned table, of which one partition and three columns are read."""
    df = subject_table(spark, d).select(ID, "event_type", TIME, EVENT, *STD)
    path = TA.write_parquet(df, scratch(spark), ["event_type"])
    back = TA.read_parquet(spark, path, ["event_type", ID, TIME]).where("event_type = 'view'")
    return rounded(back.select(ID, TIME))


SQL["parquet_round_trip"] = with_(SUBJ) + f"SELECT event_id, {r6(TIME, TIME)} FROM subj WHERE event_type = 'view'"


@query
def features_job(spark, d):
    """The features job from Parquet to Parquet, for the training split."""
    folder = scratch(spark)
    TA.write_parquet(EV.train_split(EV.features_only(spark, d)), f"{folder}/in")
    out = jobs.build_features(spark, f"{folder}/in", f"{folder}/out")
    return rounded(out.select(ID, "threat_score", "dist_bin", "advance_ratio", "hour_sin", "is_weekend"))


SQL["features_job"] = with_(
    FEATS, f"e1 AS (SELECT {edge_list('dist_min_ci_0_5h', 3, 'feats', 'user_id % 10 < 7')} AS e)",
    f"geo AS ({features_geo('(SELECT * FROM feats WHERE user_id % 10 < 7), e1', 'e')})",
    f"tem AS (SELECT event_id, {TEMPORAL} FROM feats)",
) + "SELECT event_id, threat_score, dist_bin, advance_ratio, hour_sin, is_weekend FROM geo JOIN tem USING (event_id)"


@query
def batch_scores(spark, d):
    """A fitted model applied to a batch and written, read back."""
    df = subject_table(spark, d)
    model = KaplanMeierModel().fit(EV.train_split(df))
    path = scratch(spark)
    jobs.score_batch(model, EV.test_split(df), path)
    return rounded(spark.read.parquet(path))


SQL["batch_scores"] = with_(
    SUBJ, "tr AS (SELECT * FROM subj WHERE user_id % 10 < 7)", _km("tr"), f"pr AS ({_km_probs()})"
) + f"SELECT event_id, {PROBS} FROM subj, pr WHERE user_id % 10 >= 7"


@query
def evaluate_and_record(spark, d):
    """Metrics of one prediction set appended to a results table, which is read back."""
    path = scratch(spark)
    preds = predicted(spark, d)
    jobs.evaluate_model("closed_form", preds, path)
    kept = ["weighted_brier", "brier_24h_ca", "brier_48h_ca", "brier_72h_ca", "c_index", "hybrid_score"]
    return rounded(spark.read.schema("model string, metric string, value double").json(path).where(F.col("metric").isin(kept)))


INNER = ", ".join(f"{BRIER_CA[h]} AS b{h}" for h in (24, 48, 72))
SQL["evaluate_and_record"] = with_(
    SUBJ, PRED, _concordance("pred", ""), f"m AS (SELECT *, {WB} AS wb, {CINDEX} AS ci FROM cx, (SELECT {INNER} FROM pred))"
) + union([
    f"SELECT 'closed_form' AS model, '{n}' AS metric, {r6(e, 'value')} FROM m"
    for n, e in (("weighted_brier", "wb"), ("brier_24h_ca", "b24"), ("brier_48h_ca", "b48"), ("brier_72h_ca", "b72"),
                 ("c_index", "ci"), ("hybrid_score", "0.3 * ci + 0.7 * (1 - wb)"))
])


# --- row-local operators ---


@query
def standardised(spark, d):
    df = subject_table(spark, d).select(ID, "user_id", *STD, "event_start_month")
    cols = [*STD, "event_start_month"]
    return rounded(Standardizer(cols).fit(EV.train_split(df)).transform(df).select(ID, *cols), 5)


SQL["standardised"] = with_(SUBJ) + "SELECT event_id, " + ", ".join(
    r6(f"({c} - (SELECT avg({c}) FROM subj WHERE user_id % 10 < 7)) / (SELECT CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END FROM subj WHERE user_id % 10 < 7)", c, 5)
    for c in [*STD, "event_start_month"]
) + " FROM subj"


@query
def recoded_bearings(spark, d):
    """Event types recoded (others null), bearings in radians, per group."""
    df = subject_table(spark, d).withColumn("bearing", F.col("k") * 3.6)
    group = recode("event_type", {"view": "look", "click": "act", "purchase": "act"})
    return rounded(df.groupBy(group.alias("kind")).agg(
        F.count("*").alias("n"), F.avg(F.cos(bearing_radians("bearing"))).alias("mean_cos"),
        F.max(bearing_radians("bearing")).alias("widest"),
    ))


SQL["recoded_bearings"] = with_(SUBJ) + f"""SELECT CASE event_type WHEN 'view' THEN 'look' WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'act' END AS kind,
 count(*) AS n, {r6('avg(cos(radians(k * 3.6::DOUBLE)))', 'mean_cos')}, {r6('max(radians(k * 3.6::DOUBLE))', 'widest')} FROM subj GROUP BY 1"""


@query
def numeric_totals(spark, d):
    """Every numeric column that is neither id nor target, with its sum."""
    df = subject_table(spark, d)
    names = numeric_columns(df)
    row = df.select(*[F.sum(F.col(c).cast("double")).alias(c) for c in names])
    return rounded(row.unpivot([], names, "column", "total"), 2)


SQL["numeric_totals"] = with_(SUBJ) + union(
    [f"SELECT '{c}' AS column, {r6(f'sum({c}::DOUBLE)', 'total', 2)} FROM subj" for c in ["user_id", "k", "value", *EV.FEATURES]]
)


@query
def survival_targets(spark, d):
    df = subject_table(spark, d).withColumn("y", survival_pair()).withColumn("shifted", F.col(TIME) - 40)
    return rounded(df.select(
        ID, F.col("y.event").cast("int").alias("hit"), F.col("y.time").alias("time"), positive_time("shifted").alias("positive")
    ))


SQL["survival_targets"] = with_(SUBJ) + f"SELECT event_id, event::INT AS hit, {r6(TIME, 'time')}, {r6(f'greatest({TIME} - 40, 0.001)', 'positive')} FROM subj"


# --- survival ---


@query
def nearest_survival(spark, d):
    curve = SU.km_curve(subject_table(spark, d), ["event_type"])
    return rounded(SU.nearest_step(curve, 30.0, ["event_type"]))


SQL["nearest_survival"] = with_(SUBJ, _km("subj", "event_type, "), """ks AS (SELECT event_type, time,
  CASE WHEN bool_or(d = n) OVER w THEN 0.0 ELSE exp(coalesce(log_s, 0)) END AS s FROM km
  WINDOW w AS (PARTITION BY event_type ORDER BY time ROWS UNBOUNDED PRECEDING))""") + f"""SELECT event_type, {r6('s', 'survival')} FROM ks
 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY abs(time - 30), time) = 1"""

# chi-square tail with one degree of freedom: 1 - erf(sqrt(x / 2)) by a series of positive terms
PVALUE = """CASE WHEN test_statistic > 60 THEN 0.0 WHEN test_statistic = 0 THEN 1.0 ELSE
  1 - 2 / sqrt(pi()) * list_sum(list_transform(range(300), lambda i: exp(2 * i * ln(2) + (2 * i + 1) * ln(sqrt(test_statistic / 2))
    - test_statistic / 2 - lgamma(2 * i + 2) + lgamma(i + 1)))) END"""
TESTS = f"""lr AS ({_logrank([(c, f'{c} <= (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM subj)') for c in EV.FEATURES], 12, 5)}),
 lp AS (SELECT test, test_statistic, {PVALUE} AS p_value FROM lr)"""
STARS = "CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END"
SQL["logrank_pvalues"] = with_(SUBJ, TESTS) + f"""SELECT test, {r6('test_statistic', 'test_statistic', 4)}, {r6('p_value', 'p_value', 4)},
 {STARS} AS stars, p_value < 0.05 AS significant FROM lp"""


@query
def logrank_ranking(spark, d):
    out = SU.logrank_summary(SU.logrank_scan(subject_table(spark, d), EV.FEATURES))
    return rounded(out.select("place", "test", "p_value", "n_significant"), 4)


SQL["logrank_ranking"] = with_(SUBJ, TESTS) + f"""SELECT row_number() OVER (ORDER BY round(p_value, 13), test_statistic DESC, test)::INT AS place, test,
 {r6('p_value', 'p_value', 4)}, (count(*) FILTER (p_value < 0.05) OVER ())::BIGINT AS n_significant FROM lp"""


# --- models at fixed parameters ---


def _z(df):
    z = Standardizer(STD).fit(df).transform(df.select(ID, TIME, EVENT, *STD))
    return z.select(
        *[F.col(c).alias(f"z{i}") for i, c in enumerate(STD)], F.ceil(TIME).cast("double").alias("t"),
        F.col(EVENT).cast("double").alias("e"), F.xxhash64(ID).alias("key"),
    )


Z = "zz AS MATERIALIZED (SELECT ceil(time_to_hit_hours) AS t, event::DOUBLE AS e, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(STD)
) + " FROM subj)"


@query
def cox_likelihood(spark, d):
    """Efron log partial likelihood (mean) and its gradient at fixed coefficients, hours rounded up."""
    rows = _z(subject_table(spark, d))
    n, *events = rows.selectExpr("count(*)", *[f"sum(e * z{i})" for i in range(3)]).first()
    value, grad, _ = TimeSorted(rows, 3).evaluate(np.array(BETA), np.array(events, dtype=float), n)
    out = [("log_likelihood", -value), *[(c, -float(g)) for c, g in zip(STD, grad, strict=True)]]
    return rounded(spark.createDataFrame(out, "term string, value double"), 8)


ETA = " + ".join(f"{b} * z{i}" for i, b in enumerate(BETA))
SQL["cox_likelihood"] = with_(SUBJ, Z, f"""rr AS (SELECT *, {ETA} AS eta, exp({ETA}) AS r FROM zz),
 ct AS (SELECT t, sum(e) AS d, sum(r) AS s, sum(r * e) AS sd, sum(eta * e) AS ed, {', '.join(f'sum(r * z{i}) AS x{i}, sum(r * e * z{i}) AS xd{i}, sum(e * z{i}) AS ez{i}' for i in range(3))} FROM rr GROUP BY t),
 cs AS (SELECT *, sum(s) OVER w AS s0, {', '.join(f'sum(x{i}) OVER w AS s{i + 1}' for i in range(3))} FROM ct WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)),
 ce AS (SELECT *, unnest(range(d::BIGINT)) / d AS q FROM cs WHERE d > 0)""") + union(
    [f"SELECT 'log_likelihood' AS term, {r6('((SELECT sum(ed) FROM ct) - sum(ln(s0 - q * sd))) / (SELECT count(*) FROM zz)', 'value', 8)} FROM ce"]
    + [f"SELECT '{c}' AS term, {r6(f'((SELECT sum(ez{i}) FROM ct) - sum((s{i + 1} - q * xd{i}) / (s0 - q * sd))) / (SELECT count(*) FROM zz)', 'value', 8)} FROM ce" for i, c in enumerate(STD)]
)


@query
def weibull_likelihood(spark, d):
    """Weibull AFT log-likelihood (mean) and gradient at fixed parameters."""
    rows = _z(subject_table(spark, d)).selectExpr("z0", "z1", "z2", "ln(greatest(t, 0.001D)) as lt", "e").persist()
    theta = np.array([4.0, 0.3, -0.2, 0.1, -0.1])
    value, grad, _ = AFTModel("weibull", 0.0)._evaluate(rows, theta, rows.count())
    names = ["log_likelihood", "intercept", *STD, "log_scale"]
    out = [(n, -float(v)) for n, v in zip(names, [value, *grad], strict=True)]
    rows.unpersist()
    return rounded(spark.createDataFrame(out, "term string, value double"), 8)


WEIBULL = """ww AS (SELECT *, (ln(greatest(t, 0.001)) - (4.0 + 0.3 * z0 - 0.2 * z1 + 0.1 * z2)) / exp(-0.1) AS w FROM zz),
 wg AS (SELECT *, (exp(w) - e) / exp(-0.1) AS g FROM ww)"""
SQL["weibull_likelihood"] = with_(SUBJ, Z, WEIBULL) + union(
    [f"SELECT '{n}' AS term, {r6(f'avg({x})', 'value', 8)} FROM wg" for n, x in (
        ("log_likelihood", "e * (w + 0.1) - exp(w)"), ("intercept", "g"), (STD[0], "g * z0"), (STD[1], "g * z1"),
        (STD[2], "g * z2"), ("log_scale", "w * exp(w) - e * (w + 1)"),
    )]
)


@query
def isotonic_blocks(spark, d):
    """Calibrated probabilities of one member, by score in per mille, before the monotone repair."""
    df = members(spark, d).filter("model = 'a'").withColumns({c: F.round(c, 3) for c in PROB_COLS})
    out = IsotonicCalibrator().fit_transform(df.select(ID, TIME, EVENT, *PROB_COLS))
    return rounded(df.select(ID, F.col("prob_12h").alias("score")).join(out.select(ID, "prob_12h"), ID).drop(ID).distinct())


SQL["isotonic_blocks"] = with_(SUBJ, MEMB, """iso AS (SELECT round(prob_12h, 3) AS s, sum(CASE WHEN event = 1 AND time_to_hit_hours <= 12 THEN 1.0 ELSE 0.0 END) AS y,
   count(*)::DOUBLE AS w FROM memb WHERE model = 'a' AND NOT (event = 0 AND time_to_hit_hours < 12) GROUP BY 1),
 run AS (SELECT s, sum(y) OVER (ORDER BY s) - y AS y0, sum(y) OVER (ORDER BY s) AS y1, sum(w) OVER (ORDER BY s) - w AS w0, sum(w) OVER (ORDER BY s) AS w1 FROM iso),
 lowest AS (SELECT a.s AS a, b.s AS b, min((b.y1 - a.y0) / (b.w1 - a.w0)) OVER (PARTITION BY a.s ORDER BY b.s DESC ROWS UNBOUNDED PRECEDING) AS m
   FROM run a JOIN run b ON b.s >= a.s)""") + f"SELECT b AS score, {r6('max(m)', 'prob_12h')} FROM lowest GROUP BY b"


# --- held-out schemes with a closed-form member ---

FOLDED = f"fo AS MATERIALIZED (SELECT *, ({_folds(42)})::INT AS fold FROM subj)"
TRAINED = "tr AS (SELECT k.f, fo.* FROM fo, (SELECT unnest(range(5))::INT AS f) k WHERE fo.fold <> k.f)"


@query
def oof_marginal(spark, d):
    return rounded(oof_predictions(KaplanMeierModel, subject_table(spark, d), STD).select(ID, "fold", *PROB_COLS))


SQL["oof_marginal"] = with_(SUBJ, FOLDED, TRAINED, _km("tr", "f, "), f"pr AS ({_km_probs('f, ')})") + f"SELECT event_id, fold, {PROBS} FROM fo JOIN pr ON pr.f = fo.fold"


@query
def cross_validate_marginal(spark, d):
    out = cross_validate(KaplanMeierModel, subject_table(spark, d), STD, model="marginal")
    return rounded(out.where("metric in ('weighted_brier', 'brier_72h_ca', 'c_index')"))


SCORED = f"pred AS MATERIALIZED (SELECT fo.*, {PROBS} FROM fo JOIN pr ON pr.f = fo.fold)"
SQL["cross_validate_marginal"] = with_(
    SUBJ, FOLDED, TRAINED, _km("tr", "f, "), f"pr AS ({_km_probs('f, ')})", SCORED,
    f"fm AS (SELECT fold, {INNER}, 0.5::DOUBLE AS ci FROM pred GROUP BY fold)",
) + union([
    f"SELECT 'marginal' AS model, '{n}' AS metric, {r6(f'avg({e})', 'mean')}, {r6(f'stddev_pop({e})', 'std')}, count(*) AS folds FROM fm"
    for n, e in (("weighted_brier", WB), ("brier_72h_ca", "b72"), ("c_index", "ci"))
])


@query
def repeated_cv_marginal(spark, d):
    out = repeated_cv(KaplanMeierModel, subject_table(spark, d), STD, k=5, repeats=2)
    return rounded(out.select("repeat", "fold", "weighted_brier"))


def _repeat(r: int) -> str:
    sql = with_(
        FOLDED.replace(_folds(42), _folds(42 + r)), TRAINED, _km("tr", "f, "), f"pr AS ({_km_probs('f, ')})", SCORED
    )
    return f"SELECT * FROM ({sql} SELECT {r} AS repeat, fold, {r6(WB, 'weighted_brier')} FROM (SELECT fold, {INNER} FROM pred GROUP BY fold))"


SQL["repeated_cv_marginal"] = with_(SUBJ) + union([_repeat(0), _repeat(1)])


@query
def holdout_marginal(spark, d):
    return rounded(holdout_predictions(KaplanMeierModel, subject_table(spark, d), STD).select(ID, *PROB_COLS))


HELD = """ho AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY event ORDER BY md5(event_id || '|42'), event_id)
 <= round(0.25 * count(*) OVER (PARTITION BY event)) AS holdout FROM subj)"""
SQL["holdout_marginal"] = with_(
    SUBJ, HELD, "tr AS (SELECT * FROM ho WHERE NOT holdout)", _km("tr"), f"pr AS ({_km_probs()})"
) + f"SELECT event_id, {PROBS} FROM ho, pr WHERE holdout"


@query
def refit_marginal(spark, d):
    df = subject_table(spark, d)
    return rounded(refit_and_predict(KaplanMeierModel, EV.train_split(df), EV.test_split(df), STD)[1])


SQL["refit_marginal"] = SQL["batch_scores"]


# --- selection ---

MI_MIN, CORR_MAX = 0.0005, CORRELATION_THRESHOLD  # as the query of the same name
NAMES = [c for c in EV.FEATURES]
CORRS = ", ".join(
    f"[{', '.join(f'coalesce(abs({_corr(a, b)}), 0)' if a != b else '1.0' for b in NAMES)}]" for a in NAMES
)


SQL["select_features"] = "WITH RECURSIVE " + with_(
    SUBJ, f"mi AS MATERIALIZED ({union([_mi(c).replace(', 6) + 0.0', ', 12) + 0.0') for c in NAMES])})",
    f"cm AS MATERIALIZED (SELECT [{CORRS}] AS m FROM subj)",
    f"rk AS MATERIALIZED (SELECT list_position({NAMES!r}, feature) AS c, row_number() OVER (ORDER BY mi_score DESC, feature) AS i FROM mi WHERE mi_score > {MI_MIN})",
    f"""walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
 SELECT w.i + 1, CASE WHEN len(list_filter(w.kept, lambda x: m[x][rk.c] > {CORR_MAX})) > 0 THEN w.kept ELSE list_append(w.kept, rk.c::BIGINT) END
 FROM walk w JOIN rk ON rk.i = w.i + 1, cm)""",
).removeprefix("WITH ") + f""", fin AS (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)
 SELECT unnest(list_transform(kept, lambda x: ({NAMES!r})[x])) AS feature FROM fin"""

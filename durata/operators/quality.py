"""Data-quality checks, profiles, histograms and drift."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from durata.constants import PROB_COLS, PSI_ALERT, SUBMISSION_COLUMNS
from durata.functions.columns import is_floating, nn
from durata.operators.partials import partition_cells
from durata.operators.quantiles import exact_quantiles

PSI_EPS = 1e-6


def _sql_missing(df: DataFrame, c: str) -> str:
    return f"(`{c}` is null or isnan(`{c}`))" if is_floating(df.schema, c) else f"(`{c}` is null)"


def _sql_value(c: str) -> str:
    """Double with NaN as null."""
    return f"nullif(cast(`{c}` as double), double('NaN'))"


def long_form(one_row: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """One wide row of aggregates to a row per name; ``fields`` maps output to suffix."""
    structs = [
        f"named_struct('column', '{n}', "
        + ", ".join(f"'{out}', c{i}_{suffix}" for out, suffix in fields.items())
        + ")"
        for i, n in enumerate(names)
    ]
    return one_row.selectExpr(f"inline(array({', '.join(structs)}))")


def schema_problems(df: DataFrame, expected: StructType) -> list[tuple[str, str, str, str]]:
    """(column, expected, actual, problem); extra columns are reported as a warning."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in expected.fields}
    out = [(c, t, "", "missing") for c, t in want.items() if c not in have]
    out += [
        (c, t, have[c], "type") for c, t in want.items() if c in have and have[c] != t
    ]
    out += [(c, "", t, "extra") for c, t in have.items() if c not in want]
    return out


def validate_schema(df: DataFrame, expected: StructType) -> bool:
    return all(problem == "extra" for *_, problem in schema_problems(df, expected))


def null_report(df: DataFrame, required: list[str]) -> DataFrame:
    """Missing values per required column that is present."""
    names = [c for c in required if c in df.columns]
    row = df.selectExpr(*[f"count_if({_sql_missing(df, c)}) as c{i}_n" for i, c in enumerate(names)])
    return long_form(row, names, {"null_count": "n"})


def range_report(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values below and above each closed interval; a missing value violates nothing."""
    names = [c for c in ranges if c in df.columns]
    aggs = []
    for i, c in enumerate(names):
        lo, hi = map(float, ranges[c])
        v = _sql_value(c)
        aggs += [
            f"count_if({v} < {lo!r}D) as c{i}_below",
            f"count_if({v} > {hi!r}D) as c{i}_above",
            f"{lo!r}D as c{i}_lo",
            f"{hi!r}D as c{i}_hi",
        ]
    return long_form(
        df.selectExpr(*aggs), names,
        {"low": "lo", "high": "hi", "below_count": "below", "above_count": "above"},
    )


def row_count_ok(actual: int | Column, expected: int, tolerance: float = 0.01):
    if isinstance(actual, Column):
        if expected <= 0:
            return F.lit(True)
        return F.abs(actual - expected) / F.lit(float(expected)) <= tolerance
    return expected <= 0 or abs(actual - expected) / expected <= tolerance


def check_dataset(
    df: DataFrame,
    required: list[str],
    ranges: dict[str, tuple[float, float]],
    expected_rows: int,
    tolerance: float = 0.01,
) -> DataFrame:
    """Null, range and row-count checks from one aggregate: (check, target, violations, passed)."""
    nulls = [c for c in required if c in df.columns]
    bounded = [c for c in ranges if c in df.columns]
    aggs = [f"count_if({_sql_missing(df, c)}) as n{i}" for i, c in enumerate(nulls)]
    for i, c in enumerate(bounded):
        lo, hi = map(float, ranges[c])
        v = _sql_value(c)
        aggs.append(f"count_if({v} < {lo!r}D or {v} > {hi!r}D) as r{i}")
    row = df.selectExpr(*aggs, "count(*) as rows_")
    structs = [
        f"named_struct('check','nulls','target','{c}','violations',n{i},'passed',n{i} = 0)"
        for i, c in enumerate(nulls)
    ] + [
        f"named_struct('check','ranges','target','{c}','violations',r{i},'passed',r{i} = 0)"
        for i, c in enumerate(bounded)
    ]
    ok = "true" if expected_rows <= 0 else (
        f"abs(rows_ - {expected_rows}) / {float(expected_rows)!r}D <= {tolerance!r}D"
    )
    structs.append(
        "named_struct('check','row_count','target','rows','violations',"
        f"abs(rows_ - {expected_rows}),'passed',{ok})"
    )
    return row.selectExpr(f"inline(array({', '.join(structs)}))")


def validate_dataset(
    df: DataFrame,
    schema: StructType,
    required: list[str],
    ranges: dict[str, tuple[float, float]],
    expected_rows: int,
) -> None:
    """Run every check; raise naming the failed ones."""
    report = check_dataset(df, required, ranges, expected_rows)
    rows = report.groupBy("check").agg(F.bool_and("passed").alias("ok")).collect()
    passed = {r["check"]: r["ok"] for r in rows}
    passed["schema"] = validate_schema(df, schema)
    failed = [c for c in ("schema", "nulls", "ranges", "row_count") if not passed.get(c, True)]
    if failed:
        raise ValueError(f"Validation failed: {', '.join(failed)}")


def submission_report(df: DataFrame, expected_ids: DataFrame | None = None) -> DataFrame:
    """Prediction contract as one row of violation counts."""
    cols = PROB_COLS
    value = {c: _sql_value(c) for c in cols}
    any_null = " or ".join(_sql_missing(df, c) for c in df.columns)
    outside = " or ".join(f"({value[c]} < 0 or {value[c]} > 1)" for c in cols)
    drops = " or ".join(
        f"{value[b]} < {value[a]} - 1e-9D" for a, b in zip(cols, cols[1:], strict=False)
    )
    report = df.selectExpr(
        "count(*) as n_rows",
        f"count_if({any_null}) as null_rows",
        f"count_if({outside}) as out_of_range_rows",
        f"count_if({drops}) as non_monotone_rows",
    )
    if expected_ids is not None:
        id_col = df.columns[0]
        absent = expected_ids.join(df, id_col, "left_anti").agg(F.count("*").alias("missing_ids"))
        unknown = df.join(expected_ids, id_col, "left_anti").agg(F.count("*").alias("unknown_ids"))
        wanted = expected_ids.agg(F.count("*").alias("expected_rows"))
        one = [f.withColumn("__one", F.lit(1)) for f in (report, absent, unknown, wanted)]
        report = one[0].join(one[1], "__one").join(one[2], "__one").join(one[3], "__one").drop("__one")
    return report


def validate_submission(df: DataFrame, expected_ids: DataFrame | None = None) -> None:
    if df.columns != SUBMISSION_COLUMNS:
        raise ValueError(f"Expected columns {SUBMISSION_COLUMNS}, got {df.columns}")
    r = submission_report(df, expected_ids).first().asDict()
    if r["null_rows"]:
        raise ValueError(f"Submission contains null values in {r['null_rows']} rows")
    if r["out_of_range_rows"]:
        raise ValueError(f"{r['out_of_range_rows']} rows have values outside [0, 1]")
    if r["non_monotone_rows"]:
        raise ValueError(f"Monotonicity violation in {r['non_monotone_rows']} rows")
    if expected_ids is not None:
        if r["n_rows"] != r["expected_rows"]:
            raise ValueError(f"Expected {r['expected_rows']} rows, got {r['n_rows']}")
        if r["missing_ids"] or r["unknown_ids"]:
            raise ValueError(f"{r['missing_ids']} ids missing, {r['unknown_ids']} ids unknown")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier identical row (repeats collapse before the shuffle)."""
    grouped = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return grouped.agg(
        F.sum("__n").alias("n_rows"), (F.sum("__n") - F.count("*")).alias("duplicate_rows")
    )


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct values per column; each (column, value) is deduplicated map-side."""
    pairs = ", ".join(f"named_struct('column','{c}','v',{_sql_value(c)})" for c in columns)
    values = df.selectExpr(f"inline(array({pairs}))").filter("v is not null").distinct()
    return values.groupBy("column").agg(F.count("*").alias("n_unique"))


def profile(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Per column: type, missing, distinct, min, max, mean, std, median, zeros, negatives."""
    dtypes = dict(df.dtypes)
    medians = exact_quantiles(df, {c: nn(c) for c in columns}, [0.5])
    aggs = []
    for i, c in enumerate(columns):
        v = _sql_value(c)
        med = medians[c][0]
        aggs += [
            f"'{dtypes[c]}' as c{i}_dtype",
            f"count_if({_sql_missing(df, c)}) as c{i}_nulls",
            f"round(100D * count_if({_sql_missing(df, c)}) / nullif(count(*), 0), 2) as c{i}_nullpct",
            f"min({v}) as c{i}_min",
            f"max({v}) as c{i}_max",
            f"avg({v}) as c{i}_mean",
            f"stddev_samp({v}) as c{i}_std",
            f"{'cast(null as double)' if med is None else repr(float(med)) + 'D'} as c{i}_median",
            f"count_if({v} = 0) / nullif(count(*), 0) as c{i}_zero",
            f"count_if({v} < 0) as c{i}_neg",
        ]
        if not exact:
            aggs.append(f"approx_count_distinct({v}) as c{i}_unique")
    fields = {
        "dtype": "dtype", "null_count": "nulls", "null_pct": "nullpct", "min": "min", "max": "max",
        "mean": "mean", "std": "std", "median": "median", "zero_fraction": "zero",
        "negative_count": "neg",
    }
    if not exact:
        fields["n_unique"] = "unique"
    out = long_form(df.selectExpr(*aggs), columns, fields)
    if exact:
        out = out.join(distinct_counts(df, columns), "column", "left").fillna(0, ["n_unique"])
    return out


def outlier_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values further than 1.5 interquartile ranges outside the quartiles."""
    quartiles = exact_quantiles(df, {c: nn(c) for c in columns}, [0.25, 0.75])
    aggs = []
    for i, c in enumerate(columns):
        q1, q3 = (float(q) for q in quartiles[c])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        v = _sql_value(c)
        aggs += [
            f"{lo!r}D as c{i}_lo", f"{hi!r}D as c{i}_hi",
            f"count_if({v} < {lo!r}D or {v} > {hi!r}D) as c{i}_n",
        ]
    return long_form(df.selectExpr(*aggs), columns, {"fence_low": "lo", "fence_high": "hi", "outliers": "n"})


def monitoring_profile(df: DataFrame, columns: list[str], baseline: DataFrame | None = None) -> DataFrame:
    """Profile plus outliers; with a stored baseline profile, its values ride along."""
    current = profile(df, columns).join(outlier_counts(df, columns), "column")
    if baseline is None:
        return current
    kept = ["null_pct", "mean", "std", "median", "zero_fraction"]
    base = baseline.select("column", *[F.col(c).alias(f"baseline_{c}") for c in kept])
    shift = F.try_divide(F.col("mean") - F.col("baseline_mean"), F.nullif("baseline_std", F.lit(0.0)))
    return current.join(base, "column", "left").withColumn("mean_shift_std", shift)


def zero_fraction(df: DataFrame, columns: list[str], flag_above: float = 0.5) -> DataFrame:
    row = df.selectExpr(
        *[f"count_if({_sql_value(c)} = 0) / nullif(count(*), 0) as c{i}_z" for i, c in enumerate(columns)]
    )
    out = long_form(row, columns, {"zero_fraction": "z"})
    flagged = out.withColumn("mostly_zero", F.col("zero_fraction") > flag_above)
    return flagged.orderBy(F.col("zero_fraction").desc(), "column")


def negative_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs = []
    for i, c in enumerate(columns):
        neg = f"count_if({_sql_value(c)} < 0)"
        aggs += [f"{neg} as c{i}_n", f"{neg} / nullif(count(*), 0) as c{i}_r"]
    out = long_form(df.selectExpr(*aggs), columns, {"negative_count": "n", "negative_rate": "r"})
    return out.filter("negative_count > 0")


def null_totals(df: DataFrame) -> DataFrame:
    """Total missing cells and number of columns with any."""
    report = null_report(df, df.columns)
    return report.agg(
        F.sum("null_count").alias("total_nulls"),
        F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"),
    )


def histogram(df: DataFrame, columns: list[str], bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width counts per column and group over the common value range.

    The last bin is closed; ``density`` integrates to one per group. Empty bins are absent.
    """
    by = by or []
    spans = df.selectExpr(
        *[e for i, c in enumerate(columns) for e in (f"min({_sql_value(c)}) as a{i}", f"max({_sql_value(c)}) as b{i}")]
    ).first()
    structs, widths = [], []
    for i, c in enumerate(columns):
        lo, hi = spans[2 * i], spans[2 * i + 1]
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        width = (hi - lo) / bins
        index = f"cast(least(floor(({_sql_value(c)} - {lo!r}D) / {width!r}D), {bins - 1}) as int)"
        structs.append(f"named_struct('feature','{c}','bin',{index})")
        widths.append((c, float(lo), float(width)))
    tall = df.selectExpr(*by, f"inline(array({', '.join(structs)}))").filter("bin is not null")
    counts = tall.groupBy(*by, "feature", "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by, "feature").agg(F.sum("n").alias("__total"))
    info = df.sparkSession.createDataFrame(widths, "feature string, __lo double, __w double")
    return (
        counts.join(totals, [*by, "feature"])
        .join(info, "feature")
        .select(
            *by, "feature", "bin",
            (F.col("__lo") + F.col("bin") * F.col("__w")).alias("bin_start"),
            "n",
            (F.col("n") / (F.col("__total") * F.col("__w"))).alias("density"),
        )
    )


def psi(base: DataFrame, other: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Population stability index on the base side's quantile bins, alert above 0.2."""
    edges = exact_quantiles(base, {c: nn(c) for c in columns}, [i / bins for i in range(bins + 1)])
    inner = [np.array(sorted({float(e) for e in edges[c] if e is not None})[1:-1]) for c in columns]

    def cells(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(columns), bins, 2))
        for j, cut in enumerate(inner):
            # a column without cuts is one bin of all rows
            seen = ~np.isnan(x[:, j]) if len(cut) else np.ones(len(x), dtype=bool)
            cell = 2 * np.searchsorted(cut, x[seen, j], "left") + (x[seen, -1] == 1)
            out[j] = np.bincount(cell, minlength=2 * bins).reshape(bins, 2)
        return out.ravel()

    values = [f"{_sql_value(c)} as `c{i}`" for i, c in enumerate(columns)]
    both = base.selectExpr(*values, "1D as side").unionByName(other.selectExpr(*values, "0D as side"))
    names = F.array(*[F.lit(c) for c in columns])
    counts = (
        partition_cells(both, cells, len(columns) * bins * 2)
        .groupBy(
            names[F.expr(f"pos div {2 * bins}").cast("int")].alias("feature"),
            F.expr(f"pos div 2 % {bins}").alias("bin"),
        )
        .agg(F.sum(F.expr("if(pos % 2 = 1, v, 0)")).alias("nb"), F.sum(F.expr("if(pos % 2 = 0, v, 0)")).alias("no"))
        .filter("nb + no > 0")
    )
    totals = counts.groupBy("feature").agg(F.sum("nb").alias("tb"), F.sum("no").alias("to_"))
    p = f"greatest(nb / tb, {PSI_EPS!r}D)"
    q = f"greatest(no / to_, {PSI_EPS!r}D)"
    return (
        counts.join(totals, "feature")
        .filter("tb > 0 and to_ > 0")
        .groupBy("feature")
        .agg(F.expr(f"sum(({p} - {q}) * ln({p} / {q}))").alias("psi"))
        .withColumn("alert", F.col("psi") > PSI_ALERT)
    )


def _upper_gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma (series below a + 1, continued fraction above)."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * front
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * front


@F.pandas_udf(DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [
            _upper_gamma_q(k / 2.0, s / 2.0) if k > 0 and not np.isnan(s) else float("nan")
            for s, k in zip(stat, dof, strict=True)
        ]
    )


def chi_square_drift(base: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Two-sample chi-square test of discrete columns: statistic and degrees of freedom."""
    structs = ", ".join(f"named_struct('feature','{c}','v',cast(`{c}` as string))" for c in columns)
    tall = (
        base.select(*columns, F.lit(1).alias("__base"))
        .unionByName(other.select(*columns, F.lit(0).alias("__base")))
        .selectExpr("__base", f"inline(array({structs}))")
        .filter("v is not null")
    )
    counts = tall.groupBy("feature", "v").agg(
        F.sum("__base").cast("double").alias("a"), F.sum(1 - F.col("__base")).cast("double").alias("b")
    )
    totals = counts.groupBy("feature").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    cell = "pow(a - (a + b) * ta / (ta + tb), 2) / ((a + b) * ta / (ta + tb)) + " \
        "pow(b - (a + b) * tb / (ta + tb), 2) / ((a + b) * tb / (ta + tb))"
    return (
        counts.join(totals, "feature")
        .filter("ta > 0 and tb > 0")
        .groupBy("feature")
        .agg(F.expr(f"sum({cell})").alias("chi_square"), (F.count("*") - 1).alias("dof"))
    )

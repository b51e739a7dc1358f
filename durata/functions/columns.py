"""Column expressions shared by every operator (row-local, so also valid on streams)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType, StructType

from durata.constants import META, PROB_COLS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing(c: str | Column, floating: bool = True) -> Column:
    """True for null and, on floating point columns, for NaN."""
    c = col(c)
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def nn(c: str | Column) -> Column:
    """Double with NaN turned into null, so aggregates and comparisons skip it."""
    d = col(c).cast("double")
    return F.when(~F.isnan(d), d)


def is_floating(schema: StructType, name: str) -> bool:
    return isinstance(schema[name].dataType, (DoubleType, FloatType))


def clip(c: str | Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(float(lo))), F.lit(float(hi)))


def monotone_probs(cols: list[Column]) -> list[Column]:
    """Running maximum across the horizons of one row, clipped to [0, 1].

    A missing probability makes this and all later horizons null (``greatest`` alone
    would silently skip it).
    """
    out: list[Column] = []
    for i in range(len(cols)):
        seen = cols[: i + 1]
        any_missing = reduce(lambda a, b: a | b, [missing(c) for c in seen])
        top = seen[0] if i == 0 else F.greatest(*seen)
        out.append(F.when(~any_missing, clip(top, 0.0, 1.0)))
    return out


def enforce_monotonicity(df: DataFrame, cols: list[str] = PROB_COLS) -> DataFrame:
    fixed = monotone_probs([F.col(c).cast("double") for c in cols])
    return df.withColumns(dict(zip(cols, fixed, strict=True)))


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = META) -> list[str]:
    """Every column except the id and the two targets."""
    return [c for c in df.columns if c not in exclude]


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = META) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in exclude
    ]


def cast_to_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast the declared columns that are present with another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    changes = {
        f.name: F.col(f.name).cast(f.dataType)
        for f in schema.fields
        if f.name in have and have[f.name] != f.dataType
    }
    return df.withColumns(changes) if changes else df


def recode(c: str | Column, mapping: dict) -> Column:
    """Value recode; values outside the mapping become null."""
    out = None
    for key, label in mapping.items():
        hit = col(c) == F.lit(key)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def bearing_radians(c: str | Column = "spread_bearing_deg") -> Column:
    return F.radians(col(c))


def factorize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """String columns to integer codes in alphabetical order, missing is -1.

    The distinct values of one column are ranked by a string indexer, whose fitted
    vocabulary lives on the driver: meant for category columns.
    """
    from pyspark.ml.feature import StringIndexer

    columns = columns or [
        f.name for f in df.schema.fields if isinstance(f.dataType, StringType)
    ]
    if not columns:
        return df
    tmp = [f"__code_{c}" for c in columns]
    model = StringIndexer(
        inputCols=columns, outputCols=tmp, stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(df)
    coded = model.transform(df)
    return coded.withColumns(
        {
            c: F.when(F.col(c).isNull(), F.lit(-1)).otherwise(F.col(t).cast("int"))
            for c, t in zip(columns, tmp, strict=True)
        }
    ).drop(*tmp)


def significance_stars(p: str | Column) -> Column:
    p = col(p)
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
    )

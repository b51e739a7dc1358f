"""Reading and writing: CSV and Parquet scans, result tables, column metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from durata.constants import FEATURE_GROUPS


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header. A declared schema is bound by name, whatever the file order.

    With a schema nothing is inferred: the header line gives the names, the declared
    types are cast afterwards, columns outside the schema stay as text.
    """
    raw = spark.read.option("header", True).csv(path)
    if schema is None:
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    types = {f.name: f.dataType for f in schema.fields}
    return raw.select(*[F.col(c).cast(types[c]) if c in types else F.col(c) for c in raw.columns])


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """CSV with a header; one file only on request (all rows then pass one task)."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_results(metrics: DataFrame, path: str, mode: str = "append") -> str:
    """Long (model, metric, value) table as JSON lines."""
    metrics.write.mode(mode).json(path)
    return path


def metrics_to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in wide.columns if c not in keys]
    typed = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in values])
    return typed.unpivot(keys, values, "metric", "value")


def best_model(results: DataFrame, score: str = "hybrid_score") -> str | None:
    """Model with the highest score; failed models are left out, missing scores rank last."""
    ok = results.filter(F.col("error").isNull()) if "error" in results.columns else results
    value = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    return ok.agg(F.max_by("model", F.struct(value, F.col("model")))).first()[0]


def default_model(results: DataFrame | None, fallback: str = "random_forest") -> str:
    name = best_model(results) if results is not None else None
    return name or fallback


def column_groups(spark: SparkSession) -> DataFrame:
    """Column metadata: one row per column with its group."""
    rows = [(c, g) for g, cols in FEATURE_GROUPS.items() for c in cols]
    return spark.createDataFrame(rows, "column string, category string")


def group_columns(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Columns present in ``df`` collected by their metadata category."""
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return (
        names.join(metadata, "column")
        .groupBy("category")
        .agg(F.array_sort(F.collect_list("column")).alias("columns"))
    )

"""Libraries and tracker states as versioned tables: saved whole, read back by their newest version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, version: int) -> None:
    """A version of a table beside the earlier ones; an existing version is an error."""
    df.write.parquet(f"{path}/version={version}")


def load(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The given or the newest version by today's schema: columns that an old one lacks are null, others
    that it has are left out."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = dict(c.split(" ", 1) for c in schema.split(", "))
    whole = spark.read.option("mergeSchema", True).parquet(path)
    newest = version if version is not None else whole.agg(F.max("version")).first()[0]
    rows = whole.where(F.col("version") == newest)
    return rows.select(*[(F.col(n).cast(kinds[n]) if n in rows.columns else F.lit(None).cast(kinds[n])).alias(n) for n in names])


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """All tables as JSON lines, one folder for each."""
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")

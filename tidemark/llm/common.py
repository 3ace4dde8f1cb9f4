"""Helpers that the text operators share: inputs, scratch tables, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scratch import scratch

#: Stands for a null doc_id wherever an order or a key is needed: such rows form one last document.
NULL_ID = 2**63 - 1

#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 1_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: The white space of the word and line definitions: space and \t \n \v \f \r.
SPACES = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again; cuts the lineage."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(docs: DataFrame) -> DataFrame:
    """The same rows; the session hands at most TEXT_ROWS of them to Python at a time from now on, as
    a row holds a whole text, and a worker's memory is mostly its batch."""
    conf = docs.sparkSession.conf
    if int(conf.get(_BATCH_ROWS)) > TEXT_ROWS:
        conf.set(_BATCH_ROWS, TEXT_ROWS)
    return docs


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only (null text: empty), so that other columns can't clash."""
    in_small_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name), F.lit(NULL_ID).cast("long"))


def text_key() -> Column:
    """With id_key(), tells rows of a repeated doc_id apart by their text."""
    return F.xxhash64(F.col("text"))


def let(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value, which is evaluated once for a row."""
    return f"transform(array({value}), {name} -> {body})[0]"

"""JSON documents of unknown encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte-order marks, and what the first two bytes of an ASCII character are without one.
_MARKS = (("EFBBBF", "UTF-8", 3), ("FFFE", "UTF-16LE", 2), ("FEFF", "UTF-16BE", 2))


def encoding(content: str = "content") -> Column:
    """The encoding of a document, by its mark or else by where its first two bytes have a zero."""
    head = F.hex(F.substring(content, 1, 3))
    found = F.when(F.lit(False), "")
    for mark, name, _ in _MARKS:
        found = found.when(head.startswith(mark), name)
    low, high = F.substring(head, 1, 2), F.substring(head, 3, 2)
    return found.when((high == "00") & (low != "00"), "UTF-16LE").when((low == "00") & (high != "00"), "UTF-16BE").otherwise("UTF-8")


def decoded(content: str = "content") -> Column:
    """The text of a document without its mark; null where its bytes are not valid in its encoding.

    Empty and null documents are null.
    """
    head, name = F.hex(F.substring(content, 1, 3)), encoding(content)
    skip = F.lit(0)
    for mark, _, size in _MARKS:
        skip = F.when(head.startswith(mark), size).otherwise(skip)
    body = F.substring(F.col(content), skip + 1, F.octet_length(content))
    wide = F.when(F.octet_length(body) % 2 == 0, body)
    text = (
        F.when(name == "UTF-16LE", F.decode(F.when(name == "UTF-16LE", wide), "UTF-16LE"))
        .when(name == "UTF-16BE", F.decode(F.when(name == "UTF-16BE", wide), "UTF-16BE"))
        .otherwise(F.try_validate_utf8(body.cast("string")))
    )
    return F.when(F.octet_length(content) > 0, text)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, encoding, text and document (null where text is no JSON) of every file below a folder;
    Spark lists no file without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.select("path", encoding().alias("encoding"), decoded().alias("text"))
    return found.withColumn("document", F.from_json("text", schema, {"mode": "PERMISSIVE"}))

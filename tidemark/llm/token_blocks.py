"""Token ids in patched frame-of-reference blocks.

The ids of a shard, documents in ascending doc_id order, are cut into blocks of BLOCK ids.  A
block keeps its minimum, and the differences packed at the narrowest width that holds PERCENT
of them; the others (outliers) are packed by their low bits like the rest and their high bits
stand in an exception list.  A segment of the file is a row: the blocks' payload in bytes, with
an index of the byte at which each block starts, so that any block can be read alone, the
documents in it, and how many ids of its shard stand before it.  Spark's Parquet writer is the container, so that the files live on whatever
store the path names, and a lost task is simply written again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import id_key, texts
from tidemark.llm.tokens import END_ID, tokenizer

BLOCK = 128
PERCENT = 90
SEGMENT_IDS = 1 << 16

SEGMENT_SCHEMA = (
    "shard int, segment int, before long, n_ids long, doc_ids array<bigint>, doc_tokens array<bigint>, "
    "minimums binary, widths binary, starts binary, payload binary, exceptions binary, high_bits binary"
)


def _bytes_of(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value of a row, one after the other from the lowest bit of a byte."""
    rows, block = values.shape
    eights = np.zeros((rows, -(-block // 8), 8), np.uint64)  # eight values are `width` whole bytes
    eights.reshape(rows, -1)[:, :block] = values & np.uint32((1 << width) - 1)
    out = np.zeros((*eights.shape[:2], width), np.uint8)
    for i in range(8):
        first, shift = divmod(i * width, 8)
        bits = eights[:, :, i] << np.uint64(shift)
        for b in range(first, (i * width + width + 7) // 8):
            out[:, :, b] |= (bits >> np.uint64(8 * (b - first))).astype(np.uint8)
    return out.reshape(rows, -1)[:, : (width * block + 7) // 8]


def _values_of(packed: np.ndarray, width: int, block: int) -> np.ndarray:
    """The inverse of _bytes_of()."""
    at = np.arange(block) * width
    padded = np.zeros((len(packed), packed.shape[1] + 5), np.uint8)
    padded[:, : packed.shape[1]] = packed
    out = np.zeros((len(packed), block), np.uint64)
    for b in range((width + 14) // 8):
        out |= padded[:, (at >> 3) + b].astype(np.uint64) << np.uint64(8 * b)
    return ((out >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack(ids: np.ndarray, block: int = BLOCK, percent: int = PERCENT) -> dict[str, bytes]:
    """ids (below 2**32) as blocks: minimums u32, widths u8, starts u64, payload, exceptions
    (positions, u64) and their high bits u32."""
    n = len(ids)
    count = -(-n // block)
    grid = np.zeros((count, block), np.uint32)
    grid.reshape(-1)[:n] = ids
    if n % block:
        grid[-1, n % block :] = grid[-1, : n % block].min()
    minimums = grid.min(axis=1) if count else np.zeros(0, np.uint32)
    rest = grid - minimums[:, None]
    chosen = np.partition(rest, min(block - 1, block * percent // 100), axis=1)[:, min(block - 1, block * percent // 100)] if count else minimums
    widths = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.uint8)
    high = rest >> widths[:, None].astype(np.uint32)
    high[widths == 32] = 0
    exceptions = np.flatnonzero(high.reshape(-1)[:n])
    sizes = (widths.astype(np.int64) * block + 7) // 8
    starts = np.concatenate([[0], np.cumsum(sizes)])
    payload = np.zeros(int(starts[-1]), np.uint8)
    for width in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == width)
        packed = _bytes_of(rest[rows], int(width))
        payload[starts[rows][:, None] + np.arange(packed.shape[1])] = packed
    return {
        "minimums": minimums.astype("<u4").tobytes(),
        "widths": widths.tobytes(),
        "starts": starts[:-1].astype("<u8").tobytes(),
        "payload": payload.tobytes(),
        "exceptions": exceptions.astype("<u8").tobytes(),
        "high_bits": high.reshape(-1)[exceptions].astype("<u4").tobytes(),
    }


def unpack(row, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids of pack(), as u32."""
    minimums, widths = np.frombuffer(row["minimums"], "<u4"), np.frombuffer(row["widths"], np.uint8)
    starts, payload = np.frombuffer(row["starts"], "<u8").astype(np.int64), np.frombuffer(row["payload"], np.uint8)
    out = np.zeros((len(minimums), block), np.uint32)
    for width in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == width)
        size = (int(width) * block + 7) // 8
        out[rows] = _values_of(payload[starts[rows][:, None] + np.arange(size)], int(width), block)
    at, high = np.frombuffer(row["exceptions"], "<u8").astype(np.int64), np.frombuffer(row["high_bits"], "<u4")
    out.reshape(-1)[at] |= high << widths[at // block].astype(np.uint32)
    return (out + minimums[:, None]).reshape(-1)[:n]


def write_blocks(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes every whole text and writes the segments below path, in ascending doc_id order.

    Null text is empty and has the end id alone; null doc_ids come last; rows that repeat a
    doc_id stand side by side, ordered by text.  Shards are ranges of doc_id.
    """

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, number, before, held, names, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        encoder = tokenizer(vocabulary)
        end = np.array([end_id], np.uint16)

        def flush() -> pd.DataFrame:
            ids = np.concatenate(held)
            row = {"shard": shard, "segment": number, "before": before, "n_ids": len(ids), "doc_ids": names, "doc_tokens": [len(x) for x in held]}
            return pd.DataFrame([row | pack(ids)])

        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                for name, ids in zip(part["doc_id"], encoder.encode_all(part["text"].tolist()), strict=True):
                    held.append(np.concatenate([ids, end]))
                    names.append(None if pd.isna(name) else int(name))
                    size += len(held[-1])
                    if size >= segment_ids:
                        yield flush()
                        number, before, held, names, size = number + 1, before + size, [], [], 0
        if held:
            yield flush()

    ordered = texts(docs).withColumn("k", id_key()).repartitionByRange("k").sortWithinPartitions("k", "text")
    ordered.select("doc_id", "text").mapInPandas(segments, SEGMENT_SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian u32) of the files below path.

    Only the starts of the shards, a row for each written partition, are sent round; the segments
    are read where they lie.
    """
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                ids = unpack(row, row["n_ids"]).astype("<u4")
                counts = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                parts = [ids[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
                found = {
                    "doc_id": pd.array(list(row["doc_ids"]), dtype="Int64"),
                    "start": row["shard_start"] + row["before"] + ends - counts,
                    "n_tokens": counts,
                    "ids_crc32": [zlib.crc32(p) for p in parts],
                }
                yield pd.DataFrame(found | {"ids": parts} if with_ids else found)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return files.join(F.broadcast(starts), "shard").mapInPandas(documents, kind)

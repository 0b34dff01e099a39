"""A bounded sample of labelled documents, for training on the driver."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_ids: list, modulus: int, remainder: int) -> np.ndarray:
    """Whether crc32(doc_id as text) leaves ``remainder``; rows without doc_id have none."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % modulus == remainder for i in doc_ids], bool)


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of ``rows`` labelled training documents at most, the least by a hash of doc_id.

    Documents whose crc32 leaves ``remainder`` never train. The join's small side has
    ``rows`` rows at most, so it is broadcast whatever the tables' size. Of rows that repeat
    a doc_id the one whose text has the least hash trains.
    """
    trains = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(modulus)) != remainder
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(trains & F.col("label").isin(0, 1))
    order = F.xxhash64("doc_id", F.lit(7))
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(order, "doc_id").limit(rows)
    text = F.col("text").cast("string").alias("text")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(marked), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.graph import components, cut, shared_dir, stored

__all__ = ["batches", "bounded", "components", "crc32", "cut", "fresh", "shared_dir", "sifted", "spread_join", "stored", "table", "with_text", "word_codes"]

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names made of ``names`` that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(rows: DataFrame, facts: DataFrame, by: str, salts: int = 1024) -> DataFrame:
    """``rows`` joined to ``facts``, which has one row for each value of ``by``; a value that many rows have is spread over tasks.

    Rows are salted by a hash of their other columns; a fact goes only to the salts that rows with its value have,
    so there are never more copies of facts than rows, and no group lands in one task.
    """
    (salt,) = fresh(rows, "salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*[c for c in rows.columns if c != by]), F.lit(salts)).cast("int"))
    used = salted.select(by, salt).distinct().groupBy(by).agg(F.collect_list(salt).alias(salt))
    return salted.join(facts.join(used, by).withColumn(salt, F.explode(salt)), [by, salt]).drop(salt)


def sifted(rows: DataFrame, by: str, keys: DataFrame, count: int, most: int = 28) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``by``, a hash (long, not null), may be among the ``count`` ``keys`` (one column), and those that surely are not.

    A bitmap over the low bits of the keys, 32 MB (2 ** ``most`` bits) at most and sixteen bits a key as far as that allows, goes to all tasks. So only
    the first part needs a join, and wide rows that no key asks for are not shuffled.
    """
    bits = min(max(16 * count, 1 << 16).bit_length(), most)
    bucket, marks = fresh(rows, "bucket", "marks")
    at = lambda c: F.col(c).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    key = at(keys.columns[0])
    found = keys.groupBy(F.bitmap_bucket_number(key).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias(marks))
    place = F.bitmap_bit_position(at(by))
    byte = F.conv(F.hex(F.substring(marks, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), place.bitwiseAND(F.lit(7)))), F.lit(2)) == 1, F.lit(False))
    tested = rows.withColumn(bucket, F.bitmap_bucket_number(at(by))).join(F.broadcast(found), bucket, "left")
    return tested.where(held).select(*rows.columns), tested.where(~held).select(*rows.columns)


def bounded(rows: DataFrame, most: int = 4 << 20) -> DataFrame:
    """The same rows; from now on their session sends Python Arrow batches of about ``most`` bytes (one row at least), unless it has a limit of its own.

    Spark's limits are 10,000 rows and 64 MB. Texts come near the second, and every task holds such a batch in Python and, in buffers that double as they
    grow, outside the heap of the JVM. Rows of a few numbers stay in batches of 10,000.
    """
    conf = rows.sparkSession.conf
    if ARROW_BYTES not in conf.getAll:
        conf.set(ARROW_BYTES, str(most))
    return rows


def with_text(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """``keep`` columns of ``docs`` for Python, the text as string after them, and its name; a text that is kept as it is goes there once and not twice."""
    kept = docs.select(*keep)
    if kept.columns.count("text") == 1 and kept.schema["text"].dataType == T.StringType():
        return bounded(kept), "text"
    (text,) = fresh(docs, "whole_text")
    return bounded(docs.select(*keep, F.col("text").cast("string").alias(text))), text


def batches(rows: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text at most (one row at least)."""
    for batch in rows:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of each text, cut at blanks and line ends: codes into an array of different words, that array, and offsets by text.

    Null texts have no words. The splitting and the coding run in Arrow; Python need only see each different word.
    """
    flat = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
    split = pc.split_pattern(flat, " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    offsets = offsets - offsets[0]
    if (blank := pc.index(words, "").as_py()) >= 0:
        keep = codes != blank
        before = np.concatenate([[0], np.cumsum(keep)])
        codes, offsets = codes[keep], before[offsets]
    return codes, words, offsets


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF

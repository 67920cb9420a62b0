"""Saved states of a build: tables with a record of what they belong to."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


@dataclass(frozen=True)
class Meta:
    """What a saved state was made from, and how far it got."""

    source_sha256: str
    name: str
    mode: str
    batches_done: int
    batches_total: int
    version: int = VERSION


def save(spark: SparkSession, folder: str, meta: Meta, tables: dict[str, DataFrame]) -> None:
    """Tables first, the record last: a state without a record was not finished and is not loaded."""
    at = f"{folder}/{meta.batches_done:08d}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}")
    spark.createDataFrame([asdict(meta)]).coalesce(1).write.mode("overwrite").json(f"{at}/_meta")


def load(spark: SparkSession, folder: str, wanted: Meta, batches_done: int, names: list[str]) -> dict[str, DataFrame] | None:
    """The saved tables, or None if version, source, name, mode, total or range do not fit."""
    record = f"{folder}/{batches_done:08d}/_meta"
    row = spark.read.json(record).first() if exists(spark, record) else None
    fits = row is not None and (row["version"], row["source_sha256"], row["name"], row["mode"], row["batches_total"]) == (wanted.version, wanted.source_sha256, wanted.name, wanted.mode, wanted.batches_total) and 0 < row["batches_done"] <= wanted.batches_total
    return {n: spark.read.parquet(f"{folder}/{batches_done:08d}/{n}") for n in names} if fits else None


def guard(spark: SparkSession, folder: str, source: str) -> None:
    """R2: a folder belongs to the source that began it; for another one a ValueError is raised."""
    own = Meta(source, "guard", "hash_only", 1, 1)
    if load(spark, f"{folder}/source", own, 1, []) is None:
        if exists(spark, f"{folder}/source"):
            raise ValueError(f"{folder} belongs to another source")
        save(spark, f"{folder}/source", own, {})


def fingerprint(rows: DataFrame) -> str:
    """Order-free fingerprint of a table: a hash of the number of rows and the sum of their hashes."""
    one = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("s"))
    return one.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.coalesce(F.col("s").cast("string"), F.lit("0"))), 256)).first()[0]


def remove(spark: SparkSession, folder: str) -> bool:
    """Delete a saved state; whether there was one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether there is such a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def finished(spark: SparkSession, folder: str) -> list[str]:
    """Parts below ``folder`` that were written whole, in order of their names."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(str(f.getPath().getParent()) for f in found)


def merged_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The JSON lines of all finished parts (folders with a success mark) below ``folder``."""
    parts = finished(spark, folder)
    return spark.read.schema(schema).json(parts) if parts else spark.createDataFrame([], schema)

"""Dense vectors: normalising, cosines, min-max and score fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12
BLOCK = 16_000  # vectors that a task compares with as many others
TILE = 1_024  # vectors of a matrix product
ROUNDED = 5e-7 + 1e-12  # what rounding to six places can add
SINGLE = 1.2e-7  # the same of single precision, a place of unit vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing or zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def normalise(a: Column) -> Column:
    """Unit vector, with a floor under the norm."""
    length = F.greatest(norm(a), F.lit(FLOOR))
    return F.transform(a, lambda x: x.cast("double") / length)


def min_max(rows: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """``rows`` with each of ``values`` brought to 0..1 inside its group, under its name; a group of one value gets 0.5.

    The bounds of a group are combined before they are shuffled and joined back, so that no group is gathered.
    """
    plain = {f"__{n}": c for n, c in values.items()}
    rows = rows.withColumns(plain)
    groups = {f"__by_{c}": F.col(c) for c in by}
    ends = rows.groupBy(*[c.alias(n) for n, c in groups.items()]).agg(*[f(n).alias(f"{n}_{k}") for n in plain for k, f in (("low", F.min), ("high", F.max))])
    same = F.lit(True)
    for n, c in groups.items():
        same = same & c.eqNullSafe(F.col(n))
    joined = rows.join(ends, same) if by else rows.crossJoin(F.broadcast(ends))  # without groups one row
    scaled = {n: F.when(F.col(f"__{n}_high") > F.col(f"__{n}_low"), (F.col(f"__{n}") - F.col(f"__{n}_low")) / (F.col(f"__{n}_high") - F.col(f"__{n}_low"))).otherwise(F.lit(0.5)) for n in values}
    return joined.withColumns(scaled).drop(*plain, *groups, *[f"{n}_{k}" for n in plain for k in ("low", "high")])


def fuse(rows: DataFrame, by: list[str], text_score: Column, vector_score: Column, weight: float, name: str) -> DataFrame:
    """``rows`` with (1 - weight) of the min-max of one score and weight of that of the other."""
    both = min_max(rows, by, __text=text_score, __vector=vector_score)
    return both.withColumn(name, (1 - weight) * F.col("__text") + weight * F.col("__vector")).drop("__text", "__vector")


def centroid(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean of a group's vectors, normalised again; sums by place are combined before they are shuffled."""
    each = rows.select(*by, F.posexplode(vector).alias("at", "x"))
    mean = each.groupBy(*by, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    gathered = mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))
    return gathered.select(*by, normalise(F.col("mean")).alias("centroid"))


def _matrix(vectors: pa.Array, count: int) -> np.ndarray:
    """Unit rows of ``count`` lists of numbers; a zero vector stays zero."""
    found = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(count, -1)
    return found / np.maximum(np.sqrt(np.einsum("ij,ij->i", found, found))[:, None], FLOOR)


def similar_pairs(rows: DataFrame, key: str, vector: str, least: float, blocks: int) -> DataFrame:
    """Pairs (u, v, weight) of rows with u < v whose cosine, rounded to six places, is ``least`` or more, exactly.

    Rows fall into ``blocks`` blocks; a task multiplies two blocks as matrices, tile by tile, and emits only the pairs above the
    threshold. Single precision leaves out what is clearly below it, the rest is worked out in double precision. Each two rows meet
    once. Work grows with the square of the rows, memory does not. Rows without a vector have no pairs.
    """
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(own, j).alias("low"), F.greatest(own, j).alias("high")))
    sent = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), own.alias("own"), F.explode(meets).alias("p")).select("id", "v", "own", "p.low", "p.high")

    def compare(keys: tuple, group: pa.Table) -> pa.Table:
        low, high = (k.as_py() for k in keys)
        group = group.combine_chunks()
        ids, of = group["id"].to_numpy(), group["own"].to_numpy()
        unit = _matrix(group["v"].combine_chunks(), len(ids))
        one, two = np.flatnonzero(of == low), np.flatnonzero(of == high)
        left, right = unit[one].astype(np.float32), unit[two].astype(np.float32)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a in range(0, len(one), TILE):
            for b in range(a if low == high else 0, len(two), TILE):
                i, j = np.nonzero(left[a : a + TILE] @ right[b : b + TILE].T >= np.float32(least - ROUNDED - (unit.shape[1] + 4) * SINGLE))
                i, j = one[i + a], two[j + b]
                if low == high and a == b:
                    i, j = i[i < j], j[i < j]
                weight = np.einsum("ij,ij->i", unit[i], unit[j])
                keep = weight >= least - ROUNDED
                found.append((np.minimum(ids[i], ids[j])[keep], np.maximum(ids[i], ids[j])[keep], weight[keep]))
        return pa.table([np.concatenate(x) for x in zip(*found)], ["u", "v", "weight"])

    return sent.groupBy("low", "high").applyInArrow(compare, "u bigint, v bigint, weight double").where((F.col("u") < F.col("v")) & (F.round("weight", 6) >= least))


def nearest(asked: DataFrame, rows: DataFrame, key: str, vector: str, blocks: int, asked_blocks: int | None = None) -> DataFrame:
    """(a, b, score): for each row of ``asked`` the most similar row of ``rows``, the least key among equals.

    Both sides fall into blocks, ``asked`` into ``asked_blocks`` where they are few; a task compares one block of each, tile by tile, and
    sends on only the best row it saw for each asked one, so what is shuffled is a row an asked vector and block.
    """
    asking = asked_blocks or blocks
    part = lambda name, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(name)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), part("i", asking), every(blocks).alias("j"), F.lit(True).alias("asks"))
    right = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), part("j", blocks), F.lit(False).alias("asks"), every(asking).alias("i"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, asks = group["id"].to_numpy(), group["asks"].to_numpy(zero_copy_only=False) if len(group) else np.zeros(0, bool)
        unit = _matrix(group["v"].combine_chunks(), len(ids))
        one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
        two = two[np.argsort(ids[two], kind="stable")]
        if not len(one) or not len(two):
            return pa.table([np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], ["a", "b", "score"])
        best, score = np.zeros(len(one), np.int64), np.full(len(one), -np.inf)
        for a in range(0, len(one), TILE):
            for b in range(0, len(two), TILE):
                tile = np.round(unit[one[a : a + TILE]] @ unit[two[b : b + TILE]].T, 6)
                at = tile.argmax(axis=1)
                value = tile[np.arange(len(tile)), at]
                better = np.flatnonzero(value > score[a : a + TILE])  # equals stay with the lower key
                score[a + better], best[a + better] = value[better], two[b + at[better]]
        return pa.table([ids[one], ids[best], score], ["a", "b", "score"])

    met = left.unionByName(right).groupBy("i", "j").applyInArrow(compare, "a bigint, b bigint, score double")
    best = F.max_by(F.struct("b", "score"), F.struct("score", (-F.col("b")).alias("tie")))
    return met.groupBy("a").agg(best.alias("x")).select("a", "x.b", "x.score")


def blocks_for(count: int, block: int = BLOCK, spread: int = 16) -> int:
    """Blocks of ``block`` rows at most; small inputs are dealt to ``spread`` blocks as long as these keep a thousand rows."""
    return max(1, -(-count // block), min(spread, -(-count // 1_000)))

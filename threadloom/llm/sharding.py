"""K-d tree sharding: splits at exact distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import cut, spread_join

BINS = 1024  # bins a node's histogram has in a refinement round
FEW = 2_000  # rows a node's open interval may have when they are sorted on the driver
TIES = ("_group", "_row", "_seq")  # what orders rows of equal dimension: equal texts side by side, then a hash of the id, then a number that no two rows share
NAMES = ("_size", *TIES)


@dataclass
class Node:
    leaves: int
    first: int  # number of its first leaf
    where: list = field(default_factory=list)  # (dimension, cut key) pairs with the side taken


def _points(docs: DataFrame, dims: dict[str, Column], size: Column) -> DataFrame:
    """One narrow row a row of ``docs``: its size, its group (hash of the text) and the group's point in metadata space.

    Rows with equal texts take the point of one of them, the least by its metadata, so copies lie together. The group's
    point comes from a map-side combined minimum, and the join back to a hot group is spread over tasks.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", size.alias("_size"), F.crc32(F.encode(text, "UTF-8")).alias("_crc"), F.xxhash64(text, F.lit(3)).alias("_group"),
        F.xxhash64(F.col("doc_id"), F.lit(5)).alias("_row"), F.struct(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in dims.items()]).alias("_point"),
    )
    rows = cut(rows.withColumn("_seq", F.monotonically_increasing_id()))  # fixed by being written here
    firsts = rows.groupBy("_group").agg(F.min("_point").alias("_first"))
    return cut(spread_join(rows, firsts, "_group").select("doc_id", "_size", "_crc", *TIES, *[F.col(f"_first.{n}").alias(n) for n in dims]))


def _refine(points: DataFrame, todo: dict[int, dict]) -> None:
    """Find the cut key of every node in ``todo``: the least (dimension, group, row) key at which its left part reaches its goal.

    All nodes go through each round together. A round makes a histogram of ``BINS`` bins of the open interval
    of each node (bounded: nodes * BINS numbers), and the bin that holds the goal becomes the next interval.
    An interval that has shrunk to one value goes on with the next part of the key, so ties of any size
    are split exactly; one with few rows is sorted on the driver.
    """
    while open_ := {k: t for k, t in todo.items() if "cut" not in t}:
        parts = []
        for k, t in open_.items():
            at = F.col(t["key"][len(t["fixed"])]).cast("double")
            cond = (F.col("_node") == k) & (at >= t["low"]) & (at <= t["high"])
            for name, value in zip(t["key"], t["fixed"]):
                cond &= F.col(name) == value
            width = (t["high"] - t["low"]) / BINS or 1.0
            parts.append((k, cond, F.least(F.floor((at - t["low"]) / width), F.lit(BINS - 1)).cast("int"), at))
        where, bin_, value = F.lit(False), None, None
        for _, cond, b, at in parts:
            where |= cond
            bin_ = F.when(cond, b) if bin_ is None else bin_.when(cond, b)
            value = F.when(cond, at) if value is None else value.when(cond, at)
        got = points.where(where).groupBy("_node", bin_.alias("bin")).agg(F.sum("_size").alias("w"), F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        few = {}
        for k, t in open_.items():
            weight = t["before"]
            for r in sorted((r for r in got if r["_node"] == k), key=lambda r: r["bin"]):
                if weight + r["w"] >= t["goal"]:
                    break
                weight += r["w"]
            t |= {"before": weight, "low": r["low"], "high": r["high"]}
            if r["n"] <= FEW:
                few[k] = t
            elif r["low"] == r["high"]:
                name = t["key"][len(t["fixed"])]
                exact = r["low"] if len(t["fixed"]) == 0 else None
                if exact is None:  # a hash: doubles may hide several
                    few_or_one = points.where((F.col("_node") == k) & (F.col(name).cast("double") == r["low"])).select(F.min(name), F.max(name)).first()
                    exact = few_or_one[0]
                t["fixed"] = [*t["fixed"], exact]
                if len(t["fixed"]) == len(t["key"]):
                    t["cut"] = tuple(t["fixed"])
                else:
                    t |= {"low": -(2.0**63), "high": 2.0**63}
        if few:
            cond = F.lit(False)
            for k, t in few.items():
                one = (F.col("_node") == k) & F.col(t["key"][len(t["fixed"])]).cast("double").between(t["low"], t["high"])
                for name, value in zip(t["key"], t["fixed"]):
                    one &= F.col(name) == value
                cond |= one
            dims = sorted({t["key"][0] for t in few.values()})
            rows = points.where(cond).select("_node", *dims, *NAMES).collect()  # at most FEW a node
            for k, t in few.items():
                weight, last = t["before"], None
                for key, w in sorted((tuple(r[c] for c in t["key"]), r["_size"]) for r in rows if r["_node"] == k):
                    if last is not None and weight + w / 2 > t["goal"]:
                        break
                    last, weight = key, weight + w
                t["cut"] = last


def shard(docs: DataFrame, dims: dict[str, Column], leaves: int | None = None, target_bytes: int | None = None, size: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``.

    A tree is grown level by level: each node of more than one leaf picks the dimension in which it is widest
    (its range over the whole table's range) and is cut where the summed sizes reach its left children's part,
    until leaves reach ``target_bytes`` (or there are ``leaves`` of them). Cuts are exact: sizes of leaves differ by
    about one row. Equal texts share a point and lie side by side, so a group is only cut where a boundary
    falls inside it. ``slot`` numbers a shard's rows from 0 without gaps.

    Null metadata counts as 0, a null text as size 8, a null doc_id as any other id. Rows that agree in everything,
    with null, equal or no ids, are told apart by their place in the input, so that they too are split evenly. An empty table gives no rows.
    """
    weight = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 8 if size is None else size
    points = _points(docs, dims, weight)
    names = list(dims)
    over = points.agg(F.sum("_size").alias("w"), F.count("*").alias("n"), *[F.min(n).alias(f"l{i}") for i, n in enumerate(names)], *[F.max(n).alias(f"h{i}") for i, n in enumerate(names)]).first()
    if leaves is None:
        leaves = max(1, round((over["w"] or 0) / target_bytes))
    full = [((over[f"h{i}"] or 0) - (over[f"l{i}"] or 0)) or 1.0 for i in range(len(names))]
    nodes = {0: leaves}  # number of a node's first leaf -> its leaves
    points = points.withColumn("_node", F.lit(0))
    while over["n"] and any(n > 1 for n in nodes.values()):
        wide = [k for k, n in nodes.items() if n > 1]
        stats = points.where(F.col("_node").isin(wide)).groupBy("_node").agg(F.sum("_size").alias("w"), *[F.min(n).alias(f"l{i}") for i, n in enumerate(names)], *[F.max(n).alias(f"h{i}") for i, n in enumerate(names)]).collect()
        todo = {}
        for r in stats:
            k = r["_node"]
            i = max(range(len(names)), key=lambda i: ((r[f"h{i}"] - r[f"l{i}"]) / full[i], -i))
            todo[k] = {"key": (names[i], *TIES), "fixed": [], "low": r[f"l{i}"], "high": r[f"h{i}"], "before": 0, "goal": r["w"] * (nodes[k] // 2) / nodes[k]}
        _refine(points, todo)
        moved, grown = F.col("_node"), dict(nodes)
        for k in wide:
            left = nodes[k] // 2
            grown[k], grown[k + left] = left, nodes[k] - left
        step = None
        for k, t in todo.items():
            key = F.struct(*[F.col(c).alias(f"k{j}") for j, c in enumerate(t["key"])])
            edge = F.struct(*[F.lit(v).cast("double" if j == 0 else "long").alias(f"k{j}") for j, v in enumerate(t["cut"])])
            cond = (F.col("_node") == k) & (key > edge)
            step = F.when(cond, k + nodes[k] // 2) if step is None else step.when(cond, k + nodes[k] // 2)
        points, nodes = cut(points.withColumn("_node", step.otherwise(moved).cast("int"))), grown

    # Slots: ranks inside small blocks of a shard plus the sizes of the blocks before.
    blocks = max(1, -(-(over["n"] or 0) // max(1, leaves) // 20_000))
    placed = points.withColumn("_block", F.pmod(F.xxhash64("_row", "_seq"), F.lit(blocks)).cast("int"))
    counted = placed.groupBy("_node", "_block").count()
    before = counted.select("_node", "_block", (F.sum("count").over(Window.partitionBy("_node").orderBy("_block")) - F.col("count")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_node", "_block").orderBy("_row", "_seq")) - 1
    ranked = placed.withColumn("_rank", rank).join(before, ["_node", "_block"])
    return ranked.select("doc_id", F.col("_size").alias("size"), F.col("_crc").cast("long").alias("text_crc32"), F.col("_node").alias("shard"), (F.col("_rank") + F.col("_before")).cast("long").alias("slot"))

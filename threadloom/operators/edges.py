"""Hyperedges, directed and undirected edges, and sweeps over shared labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import stored


def entity_id(owner: Column, instance: Column) -> Column:
    """``class:instance``; null if either is missing or blank."""
    ok = (F.trim(owner) != "") & (F.trim(instance) != "")
    return F.when(ok, F.concat_ws(":", owner, instance))


def entities(connections: Column) -> Column:
    """G1: sorted different ids of a hyperedge."""
    return F.array_sort(F.array_distinct(F.filter(connections, lambda c: c.isNotNull())))


def star(hyper: DataFrame, keep: list[str], members: str = "members") -> DataFrame:
    """The least id of a hyperedge points to each other one; fewer than two ids give no edge."""
    return hyper.where(F.size(members) > 1).select(*keep, F.col(members)[0].alias("src"), F.explode(F.slice(members, 2, F.size(members) - 1)).alias("dst"))


def oriented(hyper: DataFrame, keep: list[str], members: str = "members", pairs: str = "pairs") -> DataFrame:
    """Given pairs of different non-blank ids where there are any, a star otherwise."""
    valid = F.filter(pairs, lambda p: p["src"].isNotNull() & p["dst"].isNotNull() & (p["src"] != "") & (p["dst"] != "") & (p["src"] != p["dst"]))
    hub = F.transform(F.slice(members, 2, F.greatest(F.size(members) - 1, F.lit(0))), lambda d: F.struct(F.col(members)[0].alias("src"), d.alias("dst")))
    arcs = F.when(F.size(F.coalesce(valid, F.array())) > 0, valid).otherwise(hub)
    return hyper.select(*keep, F.explode(arcs).alias("e")).select(*keep, "e.src", "e.dst")


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs in order, once each, without loops."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def merge_weights(edges: DataFrame) -> DataFrame:
    """Parallel undirected edges keep their greatest weight."""
    ordered = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight").where("u <> v")
    return ordered.groupBy("u", "v").agg(F.max("weight").alias("weight"))


def holders(rows: DataFrame, label: str, owner: str, instance: str) -> DataFrame:
    """Members of each label that two instances or more hold, sorted."""
    id_ = entity_id(F.col(owner).cast("string"), F.col(instance).cast("string"))
    held = rows.select(F.col(label).alias("label"), id_.alias("id")).where("id is not null").distinct()
    return held.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("members")).where(F.size("members") > 1)


def cross_class_pairs(rows: DataFrame, label: str, owner: str, instance: str, least: int = 2, known: DataFrame | None = None, block: int = 1_000) -> DataFrame:
    """Pairs of instances of different classes that share ``least`` labels or more, with the first three labels.

    The self-join is on the label; one with more than ``block`` instances is cut into blocks and joined as pairs of blocks, so
    that no task meets it whole. A label held by m instances still makes up to m * (m - 1) / 2 rows, which are what is
    asked for. Counting is combined before the shuffle. Pairs in ``known`` are left out.
    """
    held = rows.select(F.col(label).alias("label"), F.col(owner).alias("c"), F.col(instance).alias("i")).distinct()
    blocks = held.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int")
    halves = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("low"), F.greatest(own, j).alias("high")))
    dealt = held.join(blocks, "label").select("label", "c", "i", own.alias("own"), F.explode(halves).alias("p")).select("label", "p.low", "p.high", "own", "c", "i")
    other = dealt.select("label", "low", "high", F.col("own").alias("own2"), F.col("c").alias("c2"), F.col("i").alias("i2"))
    met = dealt.join(other, ["label", "low", "high"]).where("i < i2 and c <> c2 and (low = high or own <> own2)")
    met = met.select(F.col("i").alias("u"), F.col("i2").alias("v"), "label")
    found, _, _ = stored(met.groupBy("u", "v").agg(F.count("*").alias("shared"), F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("shared") >= least))
    if known is not None:
        found = found.join(known.select("u", "v"), ["u", "v"], "left_anti")
    text = lambda *c: F.array_join(F.array(*[F.col(x).cast("string") for x in c]), ",").alias("label")
    one, two, more = (found.where(w) for w in ("shared = 1", "shared = 2", "shared > 2"))
    # only pairs with more than two labels need a list, and those are few
    labels = met.join(more.select("u", "v"), ["u", "v"], "left_semi").groupBy("u", "v").agg(F.slice(F.array_sort(F.collect_list("label")), 1, 3).alias("labels"))
    listed = more.join(labels, ["u", "v"]).select("u", "v", "shared", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("label"))
    return one.select("u", "v", "shared", text("low")).unionByName(two.select("u", "v", "shared", text("low", "high"))).unionByName(listed)


def adjacency(hyper: DataFrame, members: str = "members") -> DataFrame:
    """Both directions of every pair inside a hyperedge."""
    a = hyper.select(F.explode(members).alias("node"), members)
    return a.select("node", F.explode(members).alias("near")).where("node <> near").distinct()


def differences(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of one edge set that the other lacks, both ways."""
    return left.join(right, on, "left_anti").select(*on), right.join(left, on, "left_anti").select(*on)


def has_label(labels: Column, label: Column) -> Column:
    """whether a list of labels holds one, both compared as trimmed text."""
    return F.array_contains(F.transform(labels, lambda x: F.trim(x.cast("string"))), F.trim(label.cast("string")))


def p_record(label: Column, content: Column, members: Column) -> Column:
    """A record of leg P: its members in order, and the first one's pairs with each other."""
    hub = F.transform(F.slice(members, 2, F.greatest(F.size(members) - 1, F.lit(0))), lambda d: F.struct(members[0].alias("src"), d.alias("dst")))
    return F.struct(F.lit("P").alias("edge_leg"), label.alias("label"), content.alias("content"), members.alias("connections"), hub.alias("pairs"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("string").alias("provenance"))


def a_record(label: Column, members: Column, weight: Column, provenance: Column) -> Column:
    """A record of leg A: two members without direction, their weight and where it comes from."""
    none = F.array().cast("array<struct<src:string,dst:string>>")
    return F.struct(F.lit("A").alias("edge_leg"), label.alias("label"), F.lit("").alias("content"), F.array_sort(members).alias("connections"), none.alias("pairs"), weight.alias("weight"), provenance.alias("provenance"))

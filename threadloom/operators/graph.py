"""Iterative graph operators over edge tables, with lineage cut in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it for checkpoints.

    Where the session names none, a temporary folder is set; that is for local runs and tests only.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.split("[")[0] != "local":  # local-cluster has executors of its own
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, check: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """``df`` written to the shared folder and read again, its number of rows, and a sum over the columns ``check``.

    Unlike a checkpoint the table tells the planner its true size, and the counts come with the write, without a job
    of their own.
    """
    seen = Observation()
    value = F.coalesce(F.bit_xor(F.xxhash64(*check)), F.lit(0).cast("long")) if check else F.count(F.lit(1))
    path = os.path.join(shared_dir(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), value.alias("sum")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"], seen.get["sum"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected edges (u, v), two long columns; root is the least node of the component.

    Direction, repeats and loops do not matter, rows with a null are ignored, nodes without an edge to another node
    are left out. Each round moves the larger neighbours of every node to its least neighbour and then the smaller
    ones, which keeps components whole and makes stars around their least nodes in a logarithmic number of rounds. A
    round is one job. A hub's neighbours are only ever reduced by a minimum with map-side combining or joined,
    never listed.
    """
    a, b = edges.columns[:2]
    e, rows, last = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct(), ("u", "v"))
    while rows:
        arcs = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = arcs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e, rows, now = stored(small.distinct(), ("u", "v"))
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def expand(seeds: DataFrame, near: DataFrame, hops: int) -> DataFrame:
    """(node, hop) of all nodes within ``hops`` steps of the seeds, seeds left out; hop is the least."""
    seen, frontier = seeds.select("node", F.lit(0).cast("long").alias("hop")).distinct(), seeds.select("node").distinct()
    for hop in range(1, hops + 1):
        frontier = cut(frontier.join(near, "node").select(F.col("near").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionAll(frontier.select("node", F.lit(hop).cast("long").alias("hop")))
    return seen.where("hop > 0")


def _chains(e: DataFrame) -> DataFrame | None:
    """(node, end) of every node with one way in and one way out: where its chain ends; None if a chain has no end, which is a cycle.

    Each round a node takes on what its successor points to, so that a chain of n nodes needs log2(n) rounds.
    """
    one = lambda c: e.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node")
    inner = one("src").join(one("dst"), "node")
    hop, n, _ = stored(e.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("end")))
    for _ in range(n.bit_length()):
        further = hop.select(F.col("node").alias("end"), F.col("end").alias("next"))
        hop, _, _ = stored(hop.join(further, "end", "left").select("node", F.coalesce("next", "end").alias("end")))
    return None if hop.join(hop.select(F.col("node").alias("end")), "end", "left_semi").limit(1).count() else hop


def _one_way(edges: DataFrame) -> tuple[bool, bool]:
    """Whether all edges lead up, or all down, in the order of their nodes; and whether one is a loop or has its reverse among the edges."""
    way = F.when(F.col("src") < F.col("dst"), 1).when(F.col("src") > F.col("dst"), 2).otherwise(3)
    both = edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min(way).alias("low"), F.max(way).alias("high"))
    row = both.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max(((F.col("low") != F.col("high")) | (F.col("high") == 3)).cast("int")).alias("closed")).first()
    return row["low"] is None or row["low"] == row["high"] < 3, row["closed"] == 1


def _marked(edges: DataFrame, marks: DataFrame) -> tuple[DataFrame, bool]:
    """``marks`` (node, top) a step further, and whether they prove a cycle: top is the greatest node known to lead to a node.

    An edge from a node whose top is the edge's own end closes a cycle.
    """
    met = edges.join(marks.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "top")
    found = met.unionAll(marks).groupBy("node").agg(F.max("top").alias("top"))
    further, _, _ = stored(found)
    return further, bool(edges.join(further.withColumnRenamed("node", "src"), "src").where("top = dst").limit(1).count())


def acyclic(edges: DataFrame) -> bool:
    """Whether the directed edges (src, dst) have no cycle.

    Edges that all lead up in the order of their nodes have none, an edge and its reverse make one. Else, in turn, chains are drawn
    together into one edge each, however long they are, and edges from nodes without a way in and into nodes without a way out are
    peeled from both ends at once. A cycle ends as a loop or as edges that neither changes. Meanwhile each node learns, a step a round,
    the greatest node that leads to it, which shows a cycle as soon as it has gone round one, however much is left to peel.
    Without a cycle rounds follow the branchings along the longest path, not its length.
    """
    e, rows, _ = stored(edges.select("src", "dst").dropna().distinct())
    if not rows:
        return True
    sorted_, closed = _one_way(e)
    if sorted_ or closed:
        return sorted_
    marks, _, _ = stored(e.select(F.col("src").alias("node")).unionAll(e.select("dst")).distinct().withColumn("top", F.col("node")))
    while rows:
        for _ in range(2):
            marks, closed = _marked(e, marks)
            if closed:
                return False
        hop = _chains(e)
        if hop is None:
            return False
        ends = e.join(hop.select(F.col("node").alias("src")), "src", "left_anti").join(hop.withColumnRenamed("node", "dst"), "dst", "left").select("src", F.coalesce("end", "dst").alias("dst")).distinct()
        inner = ends.join(ends.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(ends.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept, left, _ = stored(inner.select("src", "dst"))
        if left == rows or left and kept.where("src = dst").limit(1).count():
            return False  # every node left has a way in and a way out, and none has but one of each
        e, rows = kept, left
    return True


def pagerank(edges: DataFrame, rounds: int = 10, alpha: float = 0.85, every: int = 5) -> DataFrame:
    """Weighted PageRank on undirected edges (u, v, weight) after ``rounds`` rounds; (node, rank)."""
    arcs = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight").unionAll(edges.select("v", "u", "weight"))
    out = arcs.groupBy("src").agg(F.sum("weight").alias("total"))
    arcs = cut(arcs.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    nodes = cut(arcs.select(F.col("src").alias("node")).distinct())
    n = nodes.count()
    rank = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        flow = arcs.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("flow"))
        rank = nodes.join(flow, "node", "left").select("node", (F.lit((1 - alpha) / max(n, 1)) + alpha * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        if i % every == every - 1:
            rank = cut(rank)
    return rank


def importance(belief: Column, entropy: Column) -> Column:
    """Entropy where it is known, else 1 for unknown, 0.5 for uncertain and 0.1 for settled beliefs."""
    return F.coalesce(entropy, F.when(belief == "unknown", 1.0).when(belief == "uncertain", 0.5).otherwise(0.1))


def node_score(importance_: Column, trend: Column, centrality: Column, a: float = 1.0, b: float = 0.5, c: float = 0.3) -> Column:
    """Linear score."""
    return a * importance_ + b * trend + c * centrality


def neighbour_score(instance_hits: Column, edge_hits: Column, n_keywords: Column) -> Column:
    """Half each for the share of keywords in the instance's text and in its edges' texts."""
    n = F.greatest(n_keywords, F.lit(1))
    return 0.5 * F.least(instance_hits / n, F.lit(1.0)) + 0.5 * F.least(edge_hits / n, F.lit(1.0))



def creates_cycle(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (src, dst) with whether adding each alone would close a cycle in acyclic ``edges``.

    A self-loop does, an edge that is there already does not; others do if the source can be reached from the
    target. Where all edges lead one way in the order of their nodes, a candidate that leads the same way closes none. One exchange brings each pair
    of nodes together with what is asked of it and with the ways of one and two steps between its nodes; only candidates
    that this leaves open are followed, all together, one step a round, until they are back or nothing new is reached.
    """
    e, _, _ = stored(edges.select("src", "dst").dropna().distinct())
    way = F.when(F.col("src") < F.col("dst"), 1).when(F.col("src") > F.col("dst"), 2).otherwise(3)
    row = e.agg(F.min(way).alias("low"), F.max(way).alias("high")).first()
    order = row["low"] or 1 if row["low"] == row["high"] else 3  # 1: all edges lead up, 2: all lead down
    against = {1: F.col("src") > F.col("dst"), 2: F.col("src") < F.col("dst"), 3: F.lit(True)}[order]
    asked, blank = candidates.select("src", "dst").dropna(), candidates.select("src", "dst").where("src is null or dst is null").distinct()
    starts = asked.where(against).select(F.col("dst").alias("src")).distinct()
    two = e.join(starts, "src", "left_semi").select("src", F.col("dst").alias("by")).join(e.select(F.col("src").alias("by"), "dst"), "by")
    # bits of a pair u < v: 1, 2 it is asked up or down, 4, 8 it has an edge, 16, 32 a way of two steps; 64 a loop is asked
    marked = lambda rows, up, down: rows.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.when(F.col("src") < F.col("dst"), up).when(F.col("src") > F.col("dst"), down).otherwise(64 if up == 1 else 0).alias("f"))
    met = marked(asked, 1, 2).unionAll(marked(e, 4, 8)).unionAll(marked(two, 16, 32)).groupBy("u", "v").agg(F.bit_or("f").alias("f"))
    has = lambda bits: F.col("f").bitwiseAND(F.lit(bits)) != 0
    closes = lambda own, back, free: F.when(has(own), False).when(has(back), True).when(F.lit(free), False)
    found = F.array(
        F.when(has(1), F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), closes(4, 8 | 32, order == 1).alias("cycle"))),
        F.when(has(2), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), closes(8, 4 | 16, order == 2).alias("cycle"))),
        F.when(has(64), F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(True).alias("cycle"))),
    )
    out, _, _ = stored(met.where(has(1 | 2 | 64)).select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.*"))
    blank = blank.select("src", "dst", F.lit(False).alias("cycle"))
    frontier, left, _ = stored(out.where("cycle is null").select("src", "dst", F.col("dst").alias("at")))
    if not left:
        return out.unionAll(blank)
    near = e.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    ahead = {1: F.col("next") <= F.col("src"), 2: F.col("next") >= F.col("src"), 3: F.lit(True)}[order]  # what lies beyond the source leads no more to it
    seen, hits = frontier, frontier.select("src", "dst").limit(0)
    while left:  # nothing is reached twice, so this ends
        step = frontier.join(near, "at").where(ahead).select("src", "dst", F.col("next").alias("at")).distinct()
        reached, left, _ = stored(step.join(seen, ["src", "dst", "at"], "left_anti"))
        back, _, _ = stored(reached.where("src = at").select("src", "dst"))
        hits, seen = hits.unionAll(back), seen.unionAll(reached)  # tables that are written already; none is rewritten
        frontier = reached.join(back, ["src", "dst"], "left_anti")  # what has come back is followed no further
    hit = hits.distinct().withColumn("hit", F.lit(True))
    return out.join(hit, ["src", "dst"], "left").select("src", "dst", F.coalesce("cycle", "hit", F.lit(False)).alias("cycle")).unionAll(blank)


def _closed(asked: DataFrame, via: DataFrame) -> DataFrame:
    """n of the edges (src, dst, n) of ``asked`` whose dst leads back to their src over edges of ``via`` with smaller n.

    All are followed together, a step a round; what has come back is followed no further.
    """
    near = via.select(F.col("src").alias("at"), F.col("dst").alias("next"), F.col("n").alias("m"))
    frontier, left = asked.select("n", F.col("src").alias("target"), F.col("dst").alias("at")), 1
    seen, hits = frontier.select("n", "at"), frontier.select("n").limit(0)
    while left:  # no n reaches a node twice, so this ends
        reached = frontier.join(near, "at").where("m < n").select("n", "target", F.col("next").alias("at")).distinct()
        step, left, _ = stored(reached.join(seen, ["n", "at"], "left_anti"))
        back = step.where("at = target").select("n")
        hits, seen = hits.unionAll(back), seen.unionAll(step.select("n", "at"))  # tables that are written already
        frontier = step.join(back, "n", "left_anti")
    return hits.distinct()


def guarded(candidates: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Candidates (src, dst, n) with whether each is kept when they are added one by one by n (different, 0 or more) and none may close a cycle.

    ``edges`` (src, dst), acyclic, are there before. A loop is not kept, a repeat is as its first. The result is that of adding them in
    turn, but rounds decide many at once: an edge is kept once no path of earlier edges, decided or open, leads back, and
    dropped once a path of earlier kept ones does. The earliest open edge is always decided, as are all that have no open
    one before them on a way back. Edges on no cycle at all are peeled first; what peeling leaves over only adds work. Only
    ends of candidates within the rest are followed. Rows with a null are dropped, other columns are left out.
    """
    asked, _, _ = stored(candidates.select("src", "dst", F.col("n").cast("long").alias("n")).dropna())
    known = asked.limit(0) if edges is None else edges.select("src", "dst", F.lit(-1).cast("long").alias("n")).dropna()
    first, left, _ = stored(known.unionAll(asked).where("src <> dst").groupBy("src", "dst").agg(F.min("n").alias("n")))
    core, before = first, 0
    while left and before - left != 0 and (before == 0 or before - left >= before / 10):
        before = left
        ways_in, ways_out = core.select(F.col("dst").alias("src")).distinct(), core.select(F.col("src").alias("dst")).distinct()
        core, left, _ = stored(core.join(ways_in, "src", "left_semi").join(ways_out, "dst", "left_semi").select("src", "dst", "n"))
    sure, _, _ = stored(core.where("n < 0"))
    open_, left, _ = stored(core.where("n >= 0"))
    dropped = asked.select("n").limit(0)
    while left:
        doubtful, _, _ = stored(_closed(open_, sure.unionAll(open_)))
        sure, _, _ = stored(sure.unionAll(open_.join(doubtful, "n", "left_anti").select("src", "dst", "n")))
        open_, left, _ = stored(open_.join(doubtful, "n", "left_semi").select("src", "dst", "n"))
        if left:
            wrong, _, _ = stored(_closed(open_, sure))
            dropped = dropped.unionAll(wrong)
            open_, left, _ = stored(open_.join(wrong, "n", "left_anti").select("src", "dst", "n"))
    bad = first.join(dropped, "n", "left_semi").select("src", "dst", F.lit(True).alias("bad"))
    return asked.join(bad, ["src", "dst"], "left").select("src", "dst", "n", ((F.col("src") != F.col("dst")) & F.col("bad").isNull()).alias("kept"))


def communities(edges: DataFrame, least: float = 1e-4, rounds: int = 20) -> DataFrame:
    """(node, community) by Louvain's method on undirected edges (u, v, weight), communities named by their least node.

    On each level nodes move to the neighbouring community of greatest gain, the least id among equals; those of one half (by
    hash and round) at a time, so that neighbours seldom swap places. Moves go on while two rounds raise the modularity by ``least``
    (``rounds`` pairs of rounds at most), and the best placement counts. Its communities are the nodes of the next level, with what
    lies inside as loops. It ends when a level gains less than ``least``. Work is joins and sums over the edges; no component
    is gathered.
    """
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "weight").unionAll(edges.select("v", "u", "weight"))
    arcs, n, _ = stored(both.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    place, nodes, _ = stored(arcs.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct())
    last = _quality(arcs, place, nodes) if n else 0.0
    level = place
    while n:
        moved, gained = _moved(arcs, level, nodes, last, least, rounds)
        if gained - last < least:
            break
        place, _, _ = stored(place.join(moved.select(F.col("node").alias("community"), F.col("community").alias("to")), "community").select("node", F.col("to").alias("community")))
        names = _sent(moved.withColumnRenamed("node", "a"), nodes)
        lifted = arcs.join(names, "a").select(F.col("community").alias("a"), "b", "weight").join(_sent(moved.select(F.col("node").alias("b"), F.col("community").alias("to")), nodes), "b")
        arcs, n, _ = stored(lifted.groupBy("a", F.col("to").alias("b")).agg(F.sum("weight").alias("weight")))
        (level, nodes, _), last = stored(moved.select(F.col("community").alias("node"), "community").distinct()), gained
    names = place.groupBy("community").agg(F.min("node").alias("name"))
    return place.join(names, "community").select("node", F.col("name").alias("community"))


PLACES = 1 << 21  # nodes whose communities are sent to the arcs (some 100 MB as a table of numbers in memory); more meet them by an exchange


def _sent(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= PLACES else table


def _quality(arcs: DataFrame, place: DataFrame, n: int) -> float:
    """Modularity of a placement of ``n`` nodes over arcs (a, b, weight) in both directions, loops as they are."""
    place = _sent(place, n)
    here = arcs.join(place.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(place.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    by = here.groupBy("ca").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    row = by.agg(F.sum("inside").alias("inside"), F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("squares")).first()
    return row["inside"] / row["m"] - row["squares"] / row["m"] ** 2 if row["m"] else 0.0


def _moved(arcs: DataFrame, start: DataFrame, n: int, quality: float, least: float, rounds: int) -> tuple[DataFrame, float]:
    """The best placement (node, community) that rounds of moves from ``start``, of ``n`` nodes, reach, and its modularity.

    Only arcs of the nodes that may move in a round are summed, and placements go to the arcs as far as PLACES allows.
    """
    degree, _, _ = stored(arcs.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k")))
    total = degree.agg(F.sum("k")).first()[0]
    outer = arcs.where("a <> b")
    place, best, before = start, start, quality
    for i in range(2 * rounds):
        sized = place.join(degree, "node")
        size = sized.groupBy("community").agg(F.sum("k").alias("size"))
        turn = lambda c: F.pmod(F.xxhash64(c, F.lit(i // 2)), F.lit(2)) == i % 2  # noqa: B023, E731
        moving = sized.where(turn("node")).select("node", F.col("community").alias("own"), "k")
        links = outer.where(turn("a")).join(_sent(place.select(F.col("node").alias("b"), "community"), n), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("weight").alias("w"))
        options = moving.join(links, "node").unionByName(moving.select("node", "own", "k", F.col("own").alias("community"), F.lit(0.0).alias("w")))
        options = options.groupBy("node", "own", "k", "community").agg(F.sum("w").alias("w")).join(size, "community")
        rest = F.col("size") - F.when(F.col("own") == F.col("community"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - rest * F.col("k") / total, 9)
        to = options.groupBy("node").agg(F.max_by("community", F.struct(gain, (F.col("own") == F.col("community")).cast("int"), -F.col("community"))).alias("to"))
        place, _, _ = stored(place.join(to, "node", "left").select("node", F.coalesce("to", "community").alias("community")))
        if i % 2:
            now = _quality(arcs, place, n)
            if now > quality:
                best, quality = place, now
            if now - before < least:
                break
            before = now
    return best, quality


def modularity(edges: DataFrame, place: DataFrame) -> DataFrame:
    """Modularity of a placement (node, community), one row."""
    arcs = edges.select(F.col("u").alias("node"), F.col("v").alias("b"), "weight").unionAll(edges.select("v", "u", "weight"))
    here = arcs.join(place, "node").join(place.select(F.col("node").alias("b"), F.col("community").alias("other")), "b")
    by = here.groupBy("community").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("community") == F.col("other"), F.col("weight")).otherwise(0.0)).alias("inside"))
    m = F.sum("k")
    return by.agg(F.coalesce(F.sum("inside") / m - F.sum(F.col("k") * F.col("k")) / (m * m), F.lit(0.0)).alias("modularity"))

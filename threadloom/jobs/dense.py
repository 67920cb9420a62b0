"""Queries over embeddings: cosines, pairs, fusion, and analytics of the graph that similar pairs make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import vectors as vx
from threadloom.jobs.tables import table
from threadloom.operators import edges as ed
from threadloom.operators import graph as gr
from threadloom.operators import ranking

LEAST = 0.4  # cosine from which two vectors are linked here


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar vectors, compared once and written for all that read them."""
    v = _vectors(spark, sf_dir)
    found = vx.similar_pairs(v, "vec_id", "embedding", LEAST, vx.blocks_for(v.count()))
    return gr.stored(found.withColumn("weight", F.round("weight", 6)))[0]


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vx.centroid(_vectors(spark, sf_dir).withColumn("embedding", vx.normalise(F.col("embedding"))), ["label"], "embedding")


def _to_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with the centroid of each class; classes are few."""
    v = _vectors(spark, sf_dir).select("vec_id", "label", "embedding")
    c = _centroids(spark, sf_dir).select(F.col("label").alias("other"), "centroid")
    return v.crossJoin(F.broadcast(c)).select("vec_id", "label", "other", F.round(vx.cosine(F.col("embedding"), F.col("centroid")), 6).alias("score"))  # as many rows as labels


def q_vec_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the one that follows it in its class."""
    v = _vectors(spark, sf_dir)
    following = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    return v.withColumn("next", following).select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


def q_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and first part of each unit vector."""
    u = _vectors(spark, sf_dir).select("vec_id", vx.normalise(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.col("u")[0], 6).alias("first"))


def q_vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty vectors nearest to each class's centroid."""
    out = ranking.top(_to_class(spark, sf_dir), ["other"], 20, ["vec_id"])
    return out.select(F.col("other").alias("class"), F.col("rank").cast("long").alias("rank"), "vec_id", "score")


def q_class_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13."""
    c = _centroids(spark, sf_dir)
    return c.select("label", F.size("centroid").cast("long").alias("dim"), F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.element_at("centroid", -1), 6).alias("last"))


def q_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines with the own class's centroid, from 0 to 1 in each class."""
    own = _to_class(spark, sf_dir).where("label = other")
    return vx.min_max(own, ["label"], scaled=F.col("score")).select("vec_id", "label", F.round("scaled", 6).alias("scaled"))


def q_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pool of 600 best by the own class's score, 0.7 of it and 0.3 of the best other class's; others keep their score."""
    s = _to_class(spark, sf_dir)
    both = s.groupBy("vec_id", "label").agg(F.max(F.when(F.col("label") == F.col("other"), F.col("score"))).alias("own"), F.max(F.when(F.col("label") != F.col("other"), F.col("score"))).alias("far"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("own"), "vec_id"))
    pooled = both.withColumn("pool", place <= 600)
    pooled = vx.fuse(pooled, ["label", "pool"], F.col("own"), F.col("far"), 0.3, "fused")
    return pooled.select("vec_id", "label", F.round(F.when(F.col("pool"), F.col("fused")).otherwise(F.col("own")), 6).alias("score"))


def q_pair_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 most similar pairs; the limit is the operator's cap."""
    return _pairs(spark, sf_dir).orderBy(F.desc("weight"), "u", "v").limit(2000)


def q_semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs that are not linked yet, with where they come from; pairs of one class count as linked."""
    label = _vectors(spark, sf_dir).select("vec_id", "label")
    p = _pairs(spark, sf_dir)
    tagged = p.join(label.select(F.col("vec_id").alias("u"), F.col("label").alias("lu")), "u").join(label.select(F.col("vec_id").alias("v"), F.col("label").alias("lv")), "v")
    known = tagged.where("lu = lv").select("u", "v")
    return p.join(known, ["u", "v"], "left_anti").select(F.lit("A").alias("leg"), "u", "v", "weight", F.substring(F.concat_ws("-", F.lit("cosine"), F.col("u").cast("string"), F.col("v").cast("string")), 1, 200).alias("provenance"))


def q_ga_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel links between classes keep their greatest weight."""
    label = _vectors(spark, sf_dir).select("vec_id", F.col("label").cast("long").alias("label"))
    p = _pairs(spark, sf_dir)
    lifted = p.join(label.select(F.col("vec_id").alias("u"), F.col("label").alias("lu")), "u").join(label.select(F.col("vec_id").alias("v"), F.col("label").alias("lv")), "v")
    return ed.merge_weights(lifted.select(F.col("lu").alias("u"), F.col("lv").alias("v"), "weight"))


def q_min_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest connected vector of each one without a link, whatever its similarity."""
    v, p = _vectors(spark, sf_dir), _pairs(spark, sf_dir)
    linked = gr.cut(p.select(F.col("u").alias("vec_id")).unionAll(p.select("v")).distinct())
    asked, n, _ = gr.stored(v.select("vec_id", "embedding").join(linked, "vec_id", "left_anti"))
    pool = v.join(linked, "vec_id")
    return vx.nearest(asked, pool, "vec_id", "embedding", vx.blocks_for(v.count()), vx.blocks_for(n))


def q_prereq_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 256 most similar pairs those that are no strong link yet, 64 at most."""
    p = _pairs(spark, sf_dir)
    best = p.orderBy(F.desc("weight"), "u", "v").limit(256)
    strong = p.where("weight >= 0.45").select("u", "v")
    return best.join(strong, ["u", "v"], "left_anti").orderBy(F.desc("weight"), "u", "v").limit(64)


def _near(p: DataFrame) -> DataFrame:
    return p.select(F.col("u").alias("node"), F.col("v").alias("near")).unionAll(p.select("v", "u"))


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G24."""
    return gr.components(_pairs(spark, sf_dir).select("u", "v"))


def q_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two steps of the vectors of class 0."""
    near = _near(_pairs(spark, sf_dir))
    seeds = _vectors(spark, sf_dir).where("label = 0").select(F.col("vec_id").alias("node"))
    return gr.expand(seeds, near, 2)


def q_hop_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return q_bfs(spark, sf_dir).groupBy("hop").agg(F.count("*").alias("n_nodes"))


def q_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed nodes (class 0) with those before, after and beside them."""
    near = _near(_pairs(spark, sf_dir))
    changed = _vectors(spark, sf_dir).where("label = 0").select(F.col("vec_id").alias("node"))
    return changed.unionAll(near.join(changed, "node").select(F.col("near").alias("node"))).distinct()


def q_ranked_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each class's vectors by the weight of their best link, 48 at most, one step away."""
    p, label = _pairs(spark, sf_dir), _vectors(spark, sf_dir).select("vec_id", "label")
    arcs = p.select(F.col("u").alias("vec_id"), F.col("v").alias("near"), "weight").unionAll(p.select("v", "u", "weight"))
    seeds = arcs.join(label, "vec_id").select("label", "near", "weight")
    own = label.select(F.col("vec_id").alias("near"), "label")
    outside = seeds.join(own, ["label", "near"], "left_anti").groupBy("label", "near").agg(F.max("weight").alias("score"))
    return ranking.top(outside, ["label"], 48, ["near"]).select("label", F.col("rank").cast("long").alias("rank"), "near", "score")


def q_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds over the similar pairs."""
    return gr.pagerank(_pairs(spark, sf_dir), 10).select("node", F.round("rank", 6).alias("rank"))


def q_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Belief and entropy of an event's user."""
    e = table(spark, sf_dir, "events")
    belief = F.when(F.col("event_type") == "click", "unknown").when(F.col("event_type") == "view", "uncertain").otherwise("settled")
    entropy = F.when(F.col("value") > 50, F.round(F.col("value") / 100, 6))
    return e.select("event_id", F.round(gr.importance(belief, entropy), 6).alias("importance"))


def q_node_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance, trend and centrality (share of links) of each linked vector."""
    near = _near(_pairs(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("degree"))
    label = _vectors(spark, sf_dir).select(F.col("vec_id").alias("node"), F.col("label").cast("double").alias("label"))
    return near.join(label, "node").select("node", F.round(gr.node_score(F.lit(0.5), F.col("label") / 10, F.col("degree").cast("double")), 6).alias("score"))


def q_dag_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs from the smaller to the larger id, both ways, turned by the parity of their sum, and turned where both ids are of the upper half of a hundred: which of these have no cycle."""
    p = _pairs(spark, sf_dir).select("u", "v")
    turned = lambda when: p.select(F.when(when, F.col("v")).otherwise(F.col("u")).alias("src"), F.when(when, F.col("u")).otherwise(F.col("v")).alias("dst"))
    ways = {"forward": turned(F.lit(False)), "both": turned(F.lit(False)).unionAll(turned(F.lit(True))), "parity": turned((F.col("u") + F.col("v")) % 2 == 1), "upper": turned((F.col("u") % 100 >= 50) & (F.col("v") % 100 >= 50))}
    return spark.createDataFrame([(name, gr.acyclic(e)) for name, e in ways.items()], "edges string, acyclic boolean")


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_N = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_P = _N + ", p AS (SELECT a.vec_id AS u, b.vec_id AS v, round(list_cosine_similarity(a.v, b.v), 6) AS weight FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.4)"
_C = _N + """, n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e), m AS (SELECT label, i, avg(v[i]) AS x FROM n, range(1, (SELECT max(len(v)) + 1 FROM n)) r(i) GROUP BY ALL),
  g AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1), c AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM g),
  t AS (SELECT e.vec_id, e.label, c.label AS other, round(list_cosine_similarity(e.v, c.c), 6) AS score FROM e, c)"""
_A = _P + ", near AS (SELECT u AS node, v AS near FROM p UNION ALL SELECT v, u FROM p)"
_RANKS = ", ".join(f"r{i + 1} AS (SELECT nodes.node, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(sum(share * rank), 0) AS rank FROM nodes, size LEFT JOIN (SELECT dst, share, rank FROM arcs JOIN r{i} ON arcs.src = r{i}.node) x ON x.dst = nodes.node GROUP BY nodes.node, n)" for i in range(10))

SQL = {
    "q_vec_cosine": f"WITH {_N}, l AS (SELECT vec_id, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM e) SELECT vec_id, coalesce(round(list_cosine_similarity(v, w), 6), 0) AS cosine FROM l",
    "q_l2_normalize": f"WITH {_N} SELECT vec_id, round(list_sum(v) / sqrt(list_sum(list_transform(v, lambda y: y * y))), 5) AS total, round(v[1] / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS first FROM e",
    "q_vec_topk": f"WITH {_C} SELECT other AS class, row_number() OVER (PARTITION BY other ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM t QUALIFY rank <= 20",
    "q_class_centroid": f"WITH {_C} SELECT label, len(c) AS dim, round(c[1], 6) AS first, round(c[-1], 6) AS last FROM c",
    "q_minmax": f"WITH {_C} SELECT vec_id, label, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.5 END, 6) AS scaled FROM t WHERE label = other WINDOW w AS (PARTITION BY label)",
    "q_fusion": f"""WITH {_C}, b AS (SELECT vec_id, label, max(score) FILTER (label = other) AS own, max(score) FILTER (label <> other) AS far FROM t GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY own DESC, vec_id) <= 600 AS pool FROM b)
      SELECT vec_id, label, round(CASE WHEN NOT pool THEN own ELSE 0.7::DOUBLE * (CASE WHEN max(own) OVER w > min(own) OVER w THEN (own - min(own) OVER w) / (max(own) OVER w - min(own) OVER w) ELSE 0.5 END)
        + 0.3::DOUBLE * (CASE WHEN max(far) OVER w > min(far) OVER w THEN (far - min(far) OVER w) / (max(far) OVER w - min(far) OVER w) ELSE 0.5 END) END, 6) AS score FROM k WINDOW w AS (PARTITION BY label, pool)""",
    "q_pair_topn": f"WITH {_P} SELECT * FROM p ORDER BY weight DESC, u, v LIMIT 2000",
    "q_semantic_edges": f"WITH {_P} SELECT 'A' AS leg, u, v, weight, 'cosine-' || u || '-' || v AS provenance FROM p WHERE (SELECT label FROM e WHERE vec_id = u) <> (SELECT label FROM e WHERE vec_id = p.v)",
    "q_ga_merge": f"WITH {_P}, l AS (SELECT a.label AS x, b.label AS y, weight FROM p JOIN e a ON a.vec_id = p.u JOIN e b ON b.vec_id = p.v) SELECT least(x, y)::BIGINT AS u, greatest(x, y)::BIGINT AS v, max(weight) AS weight FROM l WHERE x <> y GROUP BY 1, 2",
    "q_min_connectivity": f"""WITH {_P}, k AS (SELECT u AS id FROM p UNION SELECT v FROM p), s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id NOT IN (SELECT id FROM k) AND b.vec_id IN (SELECT id FROM k))
      SELECT a, b, score FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1""",
    "q_prereq_candidates": f"WITH {_P}, b AS (SELECT * FROM p ORDER BY weight DESC, u, v LIMIT 256) SELECT * FROM b WHERE weight < 0.45 ORDER BY weight DESC, u, v LIMIT 64",
    "q_components": f"WITH RECURSIVE {_A}, reach AS (SELECT node, node AS other FROM near UNION SELECT r.node, n.near FROM reach r JOIN near n ON r.other = n.node) SELECT node, min(other) AS root FROM reach GROUP BY 1",
    "q_bfs": f"""WITH {_A}, s AS (SELECT vec_id AS node FROM e WHERE label = 0), h1 AS (SELECT DISTINCT near AS node FROM near JOIN s USING (node) WHERE near NOT IN (SELECT node FROM s)),
      h2 AS (SELECT DISTINCT near AS node FROM near JOIN h1 USING (node) WHERE near NOT IN (SELECT node FROM s UNION SELECT node FROM h1)) SELECT node, 1::BIGINT AS hop FROM h1 UNION ALL SELECT node, 2::BIGINT FROM h2""",
    "q_hop_hist": f"""WITH {_A}, s AS (SELECT vec_id AS node FROM e WHERE label = 0), h1 AS (SELECT DISTINCT near AS node FROM near JOIN s USING (node) WHERE near NOT IN (SELECT node FROM s)),
      h2 AS (SELECT DISTINCT near AS node FROM near JOIN h1 USING (node) WHERE near NOT IN (SELECT node FROM s UNION SELECT node FROM h1)), h AS (SELECT 1::BIGINT AS hop FROM h1 UNION ALL SELECT 2::BIGINT FROM h2) SELECT hop, count(*) AS n_nodes FROM h GROUP BY 1""",
    "q_frontier": f"WITH {_A}, s AS (SELECT vec_id AS node FROM e WHERE label = 0) SELECT node FROM s UNION SELECT near FROM near JOIN s USING (node)",
    "q_ranked_expand": f"""WITH {_A}, arcs AS (SELECT u AS a, v AS b, weight FROM p UNION ALL SELECT v, u, weight FROM p), o AS (SELECT x.label, b AS near, max(weight) AS score FROM arcs JOIN e x ON x.vec_id = a JOIN e y ON y.vec_id = b WHERE x.label <> y.label GROUP BY ALL)
      SELECT label, row_number() OVER (PARTITION BY label ORDER BY score DESC, near) AS rank, near, score FROM o QUALIFY rank <= 48""",
    "q_pagerank": f"""WITH {_P}, a0 AS (SELECT u AS src, v AS dst, weight FROM p UNION ALL SELECT v, u, weight FROM p), arcs AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM a0), nodes AS (SELECT DISTINCT src AS node FROM a0), size AS (SELECT count(*) AS n FROM nodes),
      r0 AS (SELECT node, 1::DOUBLE / n AS rank FROM nodes, size), {_RANKS} SELECT node, round(rank, 6) AS rank FROM r10""",
    "q_importance": "SELECT event_id, round(CASE WHEN value > 50 THEN round(value / 100, 6) WHEN event_type = 'click' THEN 1.0 WHEN event_type = 'view' THEN 0.5 ELSE 0.1 END, 6)::DOUBLE AS importance FROM events",
    "q_node_score": f"WITH {_A} SELECT node, round(0.5::DOUBLE + 0.5::DOUBLE * any_value(label) / 10 + 0.3::DOUBLE * count(*), 6) AS score FROM near JOIN e ON e.vec_id = node GROUP BY node",
    "q_dag_check": f"""WITH RECURSIVE {_P}, a AS (SELECT 'forward' AS edges, u AS src, v AS dst FROM p UNION ALL SELECT 'both', u, v FROM p UNION ALL SELECT 'both', v, u FROM p UNION ALL SELECT 'parity', CASE WHEN (u + v) % 2 = 1 THEN v ELSE u END, CASE WHEN (u + v) % 2 = 1 THEN u ELSE v END FROM p
        UNION ALL SELECT 'upper', CASE WHEN u % 100 >= 50 AND v % 100 >= 50 THEN v ELSE u END, CASE WHEN u % 100 >= 50 AND v % 100 >= 50 THEN u ELSE v END FROM p),
      r AS (SELECT edges, src, dst FROM a UNION SELECT r.edges, r.src, a.dst FROM r JOIN a ON r.edges = a.edges AND r.dst = a.src) SELECT k.edges, NOT EXISTS (SELECT 1 FROM r WHERE r.edges = k.edges AND r.src = r.dst) AS acyclic FROM (VALUES ('forward'), ('both'), ('parity'), ('upper')) k(edges)""",
}

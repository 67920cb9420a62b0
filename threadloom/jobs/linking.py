"""Queries over hyperedges from baskets, and over state and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.jobs.tables import baskets, table
from threadloom.operators import edges as ed
from threadloom.operators import graph as gr


def _hyper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.holders(baskets(spark, sf_dir), "l_orderkey", "p_brand", "l_partkey")


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.star(_hyper(spark, sf_dir), ["label"])


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their size as a description."""
    return table(spark, sf_dir, "part").withColumn("p_container", F.concat(F.lit("size "), F.col("p_size").cast("string")))


def q_entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and instance to an id and back."""
    p = table(spark, sf_dir, "part").select("p_partkey", ed.entity_id(F.col("p_brand"), F.col("p_partkey").cast("string")).alias("entity_id"))
    return p.select("p_partkey", "entity_id", F.split("entity_id", ":")[0].alias("class_id"), F.split("entity_id", ":")[1].cast("long").alias("instance_id"))


def q_edge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted members of each label that several instances hold."""
    return _hyper(spark, sf_dir).select("label", F.size("members").cast("long").alias("n_members"), F.array_join("members", ",").alias("members"))


def q_cooccur_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a label, of leg P, with its label as text."""
    h = _hyper(spark, sf_dir)
    return h.select(F.lit("P").alias("leg"), F.col("label").cast("string").alias("label"), F.array_join(F.transform("members", lambda m: F.split(m, ":")[0]), ",").alias("classes"))


def q_star_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    return _star(spark, sf_dir)


def q_oriented_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperedges with three members or more are given their pairs of neighbours, the rest are stars."""
    h = _hyper(spark, sf_dir)
    chain = F.zip_with(F.slice("members", 1, F.size("members") - 1), F.slice("members", 2, F.size("members") - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return ed.oriented(h.withColumn("pairs", F.when(F.size("members") > 2, chain)), ["label"])


def q_unique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges once each, and how many undirected ones there are with their first."""
    s = _star(spark, sf_dir).select("src", "dst")
    directed = s.distinct().groupBy("src").agg(F.count("*").alias("n_edges"), F.min("dst").alias("first_edge"))
    both = ed.undirected(s, "src", "dst").groupBy(F.col("u").alias("src")).agg(F.count("*").alias("n_undirected"))
    return directed.join(both, "src", "left")


def q_leg_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of given types are legs, a missing leg counts as P; only P is asked for."""
    e = table(spark, sf_dir, "events")
    leg = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "P")
    return e.select("event_id", leg.alias("leg")).where(F.coalesce("leg", F.lit("P")).isin("P")).groupBy("leg").agg(F.count("*").alias("n_edges"), F.max("event_id").alias("last_edge"))


def q_edge_leg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs have a row, also without edges."""
    found = _hyper(spark, sf_dir).select(F.lit("P").alias("leg")).groupBy("leg").agg(F.count("*").alias("n"))
    legs = spark.createDataFrame([("P",), ("A",)], "leg string")
    return legs.join(found, "leg", "left").select("leg", F.coalesce("n", F.lit(0)).cast("long").alias("n_edges"))


def q_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, different edges, density, and whether the directed edges have no cycle."""
    arcs = _star(spark, sf_dir).select("src", "dst")
    s = ed.undirected(arcs, "src", "dst")
    nodes = s.select("u").unionAll(s.select("v")).distinct().agg(F.count("*").alias("n_nodes"))
    m = s.agg(F.count("*").alias("n_edges"))
    return nodes.crossJoin(m).withColumn("density", F.coalesce(F.round(2 * F.col("n_edges") / F.nullif(F.col("n_nodes") * (F.col("n_nodes") - 1), F.lit(0)), 8), F.lit(0.0))).withColumn("dag_valid", F.lit(gr.acyclic(arcs)))  # a row each


def q_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of neighbours of each entity, over cliques."""
    return ed.adjacency(_hyper(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("n_near"), F.min("near").alias("first_near"))


def q_cross_class_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, G17."""
    return ed.cross_class_pairs(baskets(spark, sf_dir), "l_orderkey", "p_brand", "l_partkey")


def q_edge_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star edges of the records against an export that lacks labels divisible by seven and has those of one more record; both differences."""
    h = _hyper(spark, sf_dir)
    star = ed.star(h, ["label"]).select("src", "dst").distinct()
    more = h.where("label = 1").select(F.element_at("members", -1).alias("src"), F.lit("class:export").alias("dst"))
    export = ed.star(h.where("label % 7 <> 0"), ["label"]).select("src", "dst").distinct().unionAll(more)
    a, b = ed.differences(star, export, ["src", "dst"])
    return a.agg(F.count("*").alias("only_records")).crossJoin(b.agg(F.count("*").alias("only_export"))).withColumn("consistent", F.col("only_records") + F.col("only_export") == 0)  # a row each


def q_class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: different descriptions of each class, sorted."""
    p = _parts(spark, sf_dir)
    return p.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_container")), "|").alias("containers"), F.count("*").alias("n_instances"))


def q_class_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and each different non-blank description of a class as fragments, in order of type and text."""


    p = _parts(spark, sf_dir).select("p_brand", "p_type", "p_container")
    kinds = [("name", 0, F.col("p_brand")), ("attribute", 1, F.col("p_type")), ("operation", 2, F.col("p_container"))]
    each = p.select("p_brand", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(r).alias("place"), c.alias("text")) for n, r, c in kinds])).alias("f")).select("p_brand", "f.*").where(F.trim("text") != "").distinct()
    return each.select("p_brand", "kind", "text", F.row_number().over(Window.partitionBy("p_brand").orderBy("place", "text")).cast("long").alias("frag_ord"))


def q_instance_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, ``key value description`` of each attribute that has one of the two, and free text."""
    p = _parts(spark, sf_dir)
    attr = lambda k, v, d: F.when((F.coalesce(v, F.lit("")) != "") | (F.coalesce(d, F.lit("")) != ""), F.concat_ws(" ", F.lit(k), v, d))
    parts = F.array(F.col("p_name"), attr("size", F.col("p_size").cast("string"), F.lit(None).cast("string")), attr("type", F.col("p_type"), F.col("p_container")))
    return p.select("p_partkey", F.posexplode(F.filter(parts, lambda x: x.isNotNull() & (F.trim(x) != ""))).alias("frag_ord", "text")).withColumn("frag_ord", F.col("frag_ord").cast("long"))


def q_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of each class as texts with numbered heads and defaults for what is missing, a hundred instances a text, so that no class is gathered whole."""
    p = _parts(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    block = F.concat(F.lit("\n--- instance "), F.col("i").cast("string"), F.lit(": "), F.coalesce("p_name", F.lit("none")), F.lit(" ---\nDescription: "), F.coalesce("p_type", F.lit("no description")), F.lit(";Value: "), F.coalesce(F.col("p_size").cast("string"), F.lit("no value")))
    whole = p.groupBy("p_brand", F.floor((F.col("i") - 1) / 100).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("i", block.alias("t")))).alias("all"))
    return whole.select("p_brand", "chunk", F.sha2(F.array_join(F.transform("all", lambda x: x["t"]), ""), 256).alias("text_sha256"))


def q_serialize_kw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short text of an instance for keyword extraction."""
    p = _parts(spark, sf_dir)
    return p.select("p_partkey", F.concat_ws("", "p_name", F.lit(" "), "p_type", F.lit("; "), F.col("p_size").cast("string"), F.lit("; "), "p_container").alias("text"))


def q_instance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts made by later keys get the next numbers of their class, after those of the first hundred."""


    p = table(spark, sf_dir, "part")
    known = p.where("p_partkey <= 100").groupBy("p_brand").agg(F.count("*").alias("have"))
    new = p.where("p_partkey > 100").withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return new.join(known, "p_brand", "left").select("p_partkey", F.concat(F.lit("instance_"), (F.coalesce("have", F.lit(0)) + F.col("n")).cast("string")).alias("instance_id"))


def q_new_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of user and day of event time that the second half of the events has and the first has not."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    half = e.agg((F.max("event_id") / 2).cast("long").alias("half"))
    tagged = e.crossJoin(F.broadcast(half))  # one row
    before, after = tagged.where("event_id <= half").select("user_id", "day").distinct(), tagged.where("event_id > half")
    return after.join(before, ["user_id", "day"], "left_anti").groupBy("user_id", "day").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n_events"))


def q_snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of a class: instances, first and last key, as JSON."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n_instances"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))
    return p.select("p_brand", F.to_json(F.struct("n_instances", "first", "last")).alias("record"))


def q_entity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export of each entity with its out-edges in order, as JSON."""
    s = _star(spark, sf_dir).select("src", "dst").distinct()
    return s.groupBy("src").agg(F.to_json(F.struct(F.lit("unknown").alias("belief"), F.array_sort(F.collect_list("dst")).alias("edges_p"))).alias("entity"))


def q_merge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of two lists in order, each once: parts of an order by line, then by size of the key."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"), F.array_sort(F.collect_list("l_partkey")).alias("b"))
    ids = F.array_distinct(F.concat(F.transform("a", lambda x: x["l_partkey"]), F.col("b")))
    return g.select("l_orderkey", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


def q_distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without blanks around them, the class where there is none."""
    p = table(spark, sf_dir, "part")
    return p.agg(F.countDistinct("p_brand").alias("n_classes"), F.countDistinct(F.coalesce(F.nullif(F.trim("p_name"), F.lit("")), F.col("p_brand"))).alias("n_names"))


def q_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address and whose number name the same digits."""
    p = table(spark, sf_dir, "pages")
    left = p.select("page_id", F.regexp_extract("url", r"(\d+)", 1).alias("digits")).where("digits <> ''")
    right = p.select(F.col("page_id").alias("other"), F.col("page_id").cast("string").alias("digits"))
    return left.join(right, "digits")


def q_extract_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name out of a persona line."""
    c = table(spark, sf_dir, "customer")
    persona = F.concat(F.lit("Age: 30; Name:  "), "c_name", F.lit("; Gender: unknown"))
    return c.select("c_custkey", F.regexp_extract(persona, r"Name:\s*(.*?); Gender:", 1).alias("name"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_H = """b AS (SELECT DISTINCT l_orderkey AS label, p_brand || ':' || l_partkey AS id FROM lineitem JOIN part ON l_partkey = p_partkey),
  h AS (SELECT label, list(id ORDER BY id) AS members FROM b GROUP BY 1 HAVING count(*) > 1)"""
_S = _H + ", s AS (SELECT label, members[1] AS src, unnest(members[2:]) AS dst FROM h)"

SQL = {
    "q_entity_ids": "SELECT p_partkey, p_brand || ':' || p_partkey AS entity_id, p_brand AS class_id, p_partkey::BIGINT AS instance_id FROM part",
    "q_edge_entities": f"WITH {_H} SELECT label, len(members) AS n_members, array_to_string(members, ',') AS members FROM h",
    "q_cooccur_edges": f"WITH {_H} SELECT 'P' AS leg, label::VARCHAR AS label, array_to_string(list_transform(members, lambda m: string_split(m, ':')[1]), ',') AS classes FROM h",
    "q_star_expand": f"WITH {_S} SELECT * FROM s",
    "q_oriented_pairs": f"WITH {_S} SELECT label, members[i] AS src, members[i + 1] AS dst FROM (SELECT label, members, unnest(range(1, len(members))) AS i FROM h WHERE len(members) > 2) UNION ALL SELECT label, members[1], members[2] FROM h WHERE len(members) = 2",
    "q_unique_edges": f"""WITH {_S}, d AS (SELECT DISTINCT src, dst FROM s), u AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM s)
      SELECT src, count(*) AS n_edges, min(dst) AS first_edge, any_value(n) AS n_undirected FROM d LEFT JOIN (SELECT u AS src, count(*) AS n FROM u GROUP BY 1) USING (src) GROUP BY src""",
    "q_leg_filter": "WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'P' END AS leg FROM events) SELECT leg, count(*) AS n_edges, max(event_id) AS last_edge FROM e WHERE coalesce(leg, 'P') = 'P' GROUP BY leg",
    "q_edge_leg_counts": f"WITH {_H} SELECT leg, CASE leg WHEN 'P' THEN (SELECT count(*) FROM h) ELSE 0 END AS n_edges FROM (VALUES ('P'), ('A')) t(leg)",
    "q_graph_stats": f"WITH {_S}, u AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM s), n AS (SELECT count(DISTINCT x) AS n_nodes FROM (SELECT u AS x FROM u UNION SELECT v FROM u)), m AS (SELECT count(*) AS n_edges FROM u) SELECT n_nodes, n_edges, round(2 * n_edges / (n_nodes * (n_nodes - 1)), 8) AS density, (SELECT count(*) = 0 FROM s WHERE src >= dst) AS dag_valid FROM n, m",
    "q_adjacency": f"WITH {_H}, a AS (SELECT DISTINCT x AS node, y AS near FROM (SELECT x, unnest(members) AS y FROM (SELECT members, unnest(members) AS x FROM h)) WHERE x <> y) SELECT node, count(*) AS n_near, min(near) AS first_near FROM a GROUP BY 1",
    "q_cross_class_sweep": """WITH b AS (SELECT DISTINCT l_orderkey AS label, p_brand AS c, l_partkey AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
      p AS (SELECT a.i AS u, b.i AS v, count(*) AS shared, list(a.label ORDER BY a.label) AS l FROM b a JOIN b USING (label) WHERE a.i < b.i AND a.c <> b.c GROUP BY ALL HAVING count(*) >= 2) SELECT u, v, shared, array_to_string(l[1:3], ',') AS label FROM p""",
    "q_edge_consistency": f"""WITH {_S}, a AS (SELECT DISTINCT src, dst FROM s), e AS (SELECT DISTINCT src, dst FROM s WHERE label % 7 <> 0 UNION ALL SELECT list_max(members), 'class:export' FROM h WHERE label = 1)
      SELECT *, only_records + only_export = 0 AS consistent FROM (SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM e)) AS only_records, (SELECT count(*) FROM (FROM e EXCEPT FROM a)) AS only_export)""",
    "q_class_summary": "SELECT p_brand, string_agg(DISTINCT ('size ' || p_size), '|' ORDER BY ('size ' || p_size)) AS containers, count(*) AS n_instances FROM part GROUP BY 1",
    "q_class_fragments": """WITH f AS (SELECT DISTINCT p_brand, 'name' AS kind, 0 AS place, p_brand AS text FROM part UNION SELECT p_brand, 'attribute', 1, p_type FROM part UNION SELECT p_brand, 'operation', 2, ('size ' || p_size) FROM part)
      SELECT p_brand, kind, text, row_number() OVER (PARTITION BY p_brand ORDER BY place, text) AS frag_ord FROM f WHERE trim(text) <> ''""",
    "q_instance_fragments": """SELECT p_partkey, 0::BIGINT AS frag_ord, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, 'size ' || p_size FROM part UNION ALL SELECT p_partkey, 2, 'type ' || p_type || ' ' || ('size ' || p_size) FROM part""",
    "q_serialize": r"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part)
      SELECT p_brand, (i - 1) // 100 AS chunk, sha256(string_agg(E'\n--- instance ' || i || ': ' || p_name || E' ---\nDescription: ' || p_type || ';Value: ' || p_size, '' ORDER BY i)) AS text_sha256 FROM n GROUP BY 1, 2""",
    "q_serialize_kw": "SELECT p_partkey, p_name || ' ' || p_type || '; ' || p_size || '; ' || ('size ' || p_size) AS text FROM part",
    "q_instance_ids": """WITH k AS (SELECT p_brand, count(*) AS have FROM part WHERE p_partkey <= 100 GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey > 100)
      SELECT p_partkey, 'instance_' || (coalesce(have, 0) + n) AS instance_id FROM n LEFT JOIN k USING (p_brand)""",
    "q_new_instances": """WITH h AS (SELECT max(event_id) // 2 AS half FROM events), e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day FROM events)
      SELECT user_id, day, min(event_id) AS first_event, count(*) AS n_events FROM e, h WHERE event_id > half AND NOT EXISTS (SELECT 1 FROM e o, h WHERE o.user_id = e.user_id AND o.day = e.day AND o.event_id <= half) GROUP BY ALL""",
    "q_snapshot_stats": """SELECT p_brand, '{"n_instances":' || count(*) || ',"first":' || min(p_partkey) || ',"last":' || max(p_partkey) || '}' AS record FROM part GROUP BY 1""",
    "q_entity_graph": f"""WITH {_S}, d AS (SELECT DISTINCT src, dst FROM s) SELECT src, '{{"belief":"unknown","edges_p":["' || string_agg(dst, '","' ORDER BY dst) || '"]}}' AS entity FROM d GROUP BY src""",
    "q_merge_ids": """WITH a AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY n, l_partkey) AS ids FROM a GROUP BY 1""",
    "q_distinct_names": "SELECT count(DISTINCT p_brand) AS n_classes, count(DISTINCT coalesce(nullif(trim(p_name), ''), p_brand)) AS n_names FROM part",
    "q_pairing": r"SELECT a.page_id, b.page_id AS other, b.page_id::VARCHAR AS digits FROM pages a JOIN pages b ON regexp_extract(a.url, '(\d+)', 1) = b.page_id::VARCHAR",
    "q_extract_name": "SELECT c_custkey, c_name AS name FROM customer",
}

"""Queries for lookups, edge records and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.jobs.tables import baskets, table, turns
from threadloom.operators import edges as ed
from threadloom.operators import evaluation as ev
from threadloom.operators import ingest
from threadloom.operators.graph import shared_dir
from threadloom.sources import store


def q_latex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each source as rows of a table in LaTeX."""
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    acc = ev.accuracy(l, ["source"], F.col("quality") == 1)
    return acc.select("source", ev.latex_row(F.col("source"), F.format_string("%.2f", F.col("accuracy") * 100), F.col("n_total").cast("string")).alias("line"))


def q_user_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two kinds are written apart as JSON lines, each kind's finished state is found, merged and removed again."""
    at = f"{shared_dir(spark)}/merge-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for kind in ("click", "view"):
        e.where(F.col("event_type") == kind).write.json(f"{at}/{kind}")
    e.limit(0).write.json(f"{at}/none")
    store.remove(spark, f"{at}/none")
    merged = store.merged_lines(spark, at, "event_id long, user_id long, event_type string")
    return merged.groupBy("user_id").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))


def q_first_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the first three sessions of each dialog, twelve at most."""
    kept = ingest.first_sessions(ingest.label(turns(spark, sf_dir)), 3)
    return ingest.head(kept, 12).select("dialog", "session", "label")


def q_label_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders whose lines hold line number 3, asked for as padded text."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("labels"))
    return lines.where(ed.has_label(F.col("labels"), F.lit(" 3 "))).select("l_orderkey", F.size("labels").cast("long").alias("n_lines"))


def q_keyword_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types and users as keyword lists, with blanks for what joins words."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("u")).distinct()
    made = e.groupBy("u").agg(F.array_sort(F.collect_list(F.concat(F.lit("event_"), "event_type", F.lit("_kind")))).alias("k"))
    return made.select("u", F.array_join(tx.keyword_forms(F.col("k")), "|").alias("keywords"))


def q_edge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-occurrence as records of leg P with oriented pairs, pairs of brands as records of leg A with weight and provenance."""
    h = ed.holders(baskets(spark, sf_dir), "l_orderkey", "p_brand", "l_partkey")
    p = ed.p_record(F.col("label").cast("string"), F.concat(F.lit("order "), F.col("label").cast("string")), F.col("members"))
    b = baskets(spark, sf_dir).select(F.col("l_orderkey").alias("o"), F.col("p_brand").alias("c")).distinct()
    both = b.join(b.select("o", F.col("c").alias("c2")), "o").where("c < c2").groupBy("c", "c2").agg(F.count("*").alias("n"))  # an order has seven lines at most
    a = ed.a_record(F.concat_ws("-", "c", "c2"), F.array("c", "c2"), F.col("n").cast("double"), F.lit("orders"))
    records = h.select(p.alias("r")).unionByName(both.select(a.alias("r")))
    return records.select("r.edge_leg", "r.label", F.array_join("r.connections", ",").alias("connections"), F.size("r.pairs").cast("long").alias("n_pairs"), "r.weight", "r.provenance")


def q_entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts asked for by their ids, some of which there are not."""
    p = table(spark, sf_dir, "part").select(ed.entity_id(F.col("p_brand"), F.col("p_partkey").cast("string")).alias("entity_id"), "p_name")
    asked = table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(ed.entity_id(F.when(F.col("p_partkey") % 10 == 0, "Brand#none").otherwise(F.col("p_brand")), F.col("p_partkey").cast("string")).alias("entity_id"))
    return asked.join(p, "entity_id", "left").select("entity_id", F.coalesce("p_name", F.lit("")).alias("name"), F.col("p_name").isNotNull().alias("known"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

SQL = {
    "q_latex_rows": r"SELECT source, concat_ws(' & ', replace(source, '_', '\_'), printf('%.2f', round(sum(quality) / count(*)::DOUBLE, 6) * 100), count(*)::VARCHAR) || ' \\' AS line FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "q_user_merge": "SELECT user_id, count(*) AS n_events, min(event_id) AS first_event FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
    "q_first_sessions": """WITH t AS (SELECT conv_id // 10 AS dialog, conv_id % 10 AS session, turn FROM conversations), l AS (SELECT *, row_number() OVER (PARTITION BY dialog ORDER BY session, turn) AS label FROM t)
      SELECT dialog, session, label FROM (SELECT *, dense_rank() OVER (PARTITION BY dialog ORDER BY session) AS s FROM l) WHERE s <= 3 QUALIFY row_number() OVER (PARTITION BY dialog ORDER BY label) <= 12""",
    "q_label_member": "SELECT l_orderkey, count(DISTINCT l_linenumber) AS n_lines FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber = 3)",
    "q_keyword_forms": "SELECT user_id % 10 AS u, string_agg(DISTINCT 'event ' || event_type || ' kind', '|' ORDER BY 'event ' || event_type || ' kind') AS keywords FROM events GROUP BY 1",
    "q_edge_records": """WITH b AS (SELECT DISTINCT l_orderkey AS o, p_brand AS c, p_brand || ':' || l_partkey AS id FROM lineitem JOIN part ON l_partkey = p_partkey), h AS (SELECT o, list_sort(list(DISTINCT id)) AS m FROM b GROUP BY 1 HAVING count(DISTINCT id) > 1), d AS (SELECT DISTINCT o, c FROM b)
      SELECT 'P' AS edge_leg, o::VARCHAR AS label, array_to_string(m, ',') AS connections, len(m)::BIGINT - 1 AS n_pairs, NULL::DOUBLE AS weight, NULL::VARCHAR AS provenance FROM h
      UNION ALL SELECT 'A', x.c || '-' || y.c, x.c || ',' || y.c, 0, count(*)::DOUBLE, 'orders' FROM d x JOIN d y USING (o) WHERE x.c < y.c GROUP BY x.c, y.c""",
    "q_entity_lookup": "SELECT CASE WHEN p_partkey % 10 = 0 THEN 'Brand#none' ELSE p_brand END || ':' || p_partkey AS entity_id, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END AS name, p_partkey % 10 <> 0 AS known FROM part WHERE p_partkey % 5 = 0",
}

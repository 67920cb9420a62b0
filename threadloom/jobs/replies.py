"""Queries that read replies of a language model. The replies are made of given tables, in the shapes that models give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import replies as rp
from threadloom.jobs.tables import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("m"))


def q_reply_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: user and assistant turns go to two new classes; fenced, unreadable and nameless replies. Unreadable ones leave all to the fallback."""
    one = lambda role, name: F.struct(F.lit(name).alias("class_name"), F.transform(F.filter("m", lambda x: x["role"] == role), lambda x: F.struct(x["turn"].alias("label"))).alias("related_message"))
    body = F.to_json(F.struct(F.array(one("user", "asked"), one("assistant", "told"), one("system", "")).alias("new_classes")))
    shape = F.col("conv_id") % 4
    reply = F.when(shape == 0, body).when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(shape == 2, F.lit("I cannot say")).otherwise(F.lit('{"new_classes": []}'))
    got = _turns(spark, sf_dir).select("conv_id", "m", rp.new_classes(reply).alias("c"))
    rest = F.array(F.struct(F.lit(rp.FALLBACK).alias("class_name"), F.transform("m", lambda x: x["turn"]).alias("labels")))
    each = got.select("conv_id", F.explode(F.coalesce("c", rest)).alias("c"))
    return each.select("conv_id", "c.class_name", F.array_join(F.transform("c.labels", lambda x: x.cast("string")), ",").alias("labels"))


def q_reply_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances from replies in all shapes (a list with other things in it, ``instances``, one object, one without a name, an empty object), a text instance where none can be read, and facts inferred or not."""
    m = F.transform("m", lambda x: x["text"])
    turns = F.create_map(F.lit("turns"), F.struct(F.lit("how many").alias("description"), F.size("m").cast("string").alias("value"))).alias("attributes")
    made = F.struct(F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("instance_name"), turns)
    shape = F.col("conv_id") % 6
    listed = F.concat(F.lit("["), F.to_json(made), F.lit(', "no object", '), F.to_json(made), F.lit("]"))
    reply = F.when(shape == 0, listed).when(shape == 1, F.to_json(F.struct(F.array(made).alias("instances")))).when(shape == 2, F.to_json(made)).when(shape == 4, F.to_json(F.struct(turns))).when(shape == 5, "{}").otherwise("no JSON here")
    facts = F.when(F.col("conv_id") % 3 == 0, F.to_json(F.struct(F.array(F.lit("one"), F.lit(" "), F.lit("two")).alias("facts")))).otherwise("")
    got = _turns(spark, sf_dir).select("conv_id", rp.instances(reply).alias("i"), rp.text_instance(F.lit("chat"), F.slice(m, F.lit(2), F.size(m)), F.slice(m, 1, 1)).alias("t"), facts.alias("facts"))
    each = got.select("conv_id", "facts", F.posexplode(F.coalesce("i", F.array("t"))).alias("place", "i"))
    text = rp.with_facts(rp.updated_text(F.col("i.uninstance_field"), F.array(F.lit("more"))), F.col("facts"))
    return each.select("conv_id", F.col("place").cast("long").alias("place"), "i.instance_name", F.col("i.attributes")["turns"]["value"].alias("turns"), F.sha2(text, 256).alias("text_sha256"))


def q_reply_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of the user's turns are updated with the others: by a reply that renames them, by one that only has new attributes, or by the texts where it cannot be read."""
    part = lambda user: F.filter("m", lambda x: (x["role"] == "user") == F.lit(user))
    texts, labels = (lambda user, f=f: F.transform(part(user), lambda x: x[f].cast("string")) for f in ("text", "turn"))
    have = F.struct(F.lit("asked").alias("instance_name"), F.lit(None).alias("attributes"), F.lit(None).alias("operations"), F.lit(None).alias("functions"), labels(True).alias("message_labels"), F.array_join(texts(True), "\n").alias("uninstance_field")).cast(rp.INSTANCE)
    told = F.create_map(F.lit("told"), F.struct(F.size(part(False)).cast("string").alias("value"), F.lit("now").alias("recorded_at"))).alias("attributes")
    shape = F.col("conv_id") % 3
    reply = F.when(shape == 0, F.to_json(F.struct(F.lit("renamed").alias("instance_name"), told, F.lit("new").alias("uninstance_field")))).when(shape == 1, F.to_json(F.struct(F.array(F.struct(told)).alias("instances")))).otherwise("cannot")
    i = _turns(spark, sf_dir).select("conv_id", rp.updated(have, reply, texts(False), labels(False)).alias("i"))
    return i.select("conv_id", "i.instance_name", F.col("i.attributes")["told"]["value"].alias("told"), F.col("i.attributes")["told"]["recorded_at"].alias("recorded"), F.array_join("i.message_labels", ",").alias("labels"), F.sha2("i.uninstance_field", 256).alias("text_sha256"))


def q_reply_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts picked of those that a brand has, fifty parts a question: half of the picked ones are offered, one is picked twice, broken replies pick none."""
    chunk = F.floor((F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1) / 50).cast("long")
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", chunk.alias("chunk")).groupBy("p_brand", "chunk").agg(F.array_sort(F.collect_list("p_partkey")).alias("keys"))
    text = F.transform("keys", lambda k: k.cast("string"))
    offered = F.filter(text, lambda k: k.cast("long") % 2 == 0)
    reply = F.when(F.substring("p_brand", -1, 1) == "5", F.lit("{")).otherwise(F.to_json(F.struct(F.concat(text, F.slice(text, 1, 1)).alias("ids"))))
    return p.select("p_brand", "chunk", F.array_join(rp.picks(reply, offered, "ids"), ",").alias("picked"))


def q_reply_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers inside an object, inside parts of a list, and none."""
    b = table(spark, sf_dir, "benchmark").withColumn("text", F.coalesce("text", F.lit("")))
    inner = F.to_json(F.struct(F.substring("text", 1, 50).alias("response")))
    shape = F.col("item_id") % 4
    cut_ = F.floor(F.char_length(inner) / 2).cast("int")
    parts = F.array(F.struct(F.substring(inner, F.lit(1), cut_).alias("text")), F.struct(F.substring(inner, cut_ + 1, F.char_length(inner)).alias("text")))
    raw = F.when(shape == 0, inner).when(shape == 1, F.to_json(F.struct(inner.alias("content")))).when(shape == 2, F.to_json(F.struct(parts.alias("content")))).otherwise("sorry")
    return b.select("item_id", rp.answer(rp.content(raw)).alias("answer"))


def q_reply_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts that replies report for low-quality documents, met with toxic ones as the injected errors by a second reply; how many of each source."""
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    one = F.struct(F.lit("differs").alias("conflict_reason"), F.array(F.col("doc_id").cast("string")).alias("conflict_message_labels"))
    reply = F.when(F.col("quality") == 0, F.to_json(F.struct(F.lit(True).alias("is_conflict"), F.array(one).alias("conflicts")))).when(F.col("doc_id") % 2 == 0, F.lit('{"is_conflict": false, "conflicts": []}')).otherwise("")
    found = l.select("source", "toxic", F.explode(rp.conflicts(reply)).alias("c")).select("source", "toxic", F.col("c.conflict_message_labels")[0].cast("long").alias("doc_id"))
    second = F.when(F.col("toxic") == 1, F.when(F.col("doc_id") % 2 == 0, F.lit('{"match": true}')).otherwise(" Yes ")).otherwise(F.when(F.col("doc_id") % 2 == 0, F.lit('{"match": false}')).otherwise("yes, but no"))
    return found.groupBy("source").agg(F.count("*").alias("n_conflicts"), F.sum(rp.matched(second).cast("long")).alias("n_matched"))


def q_reply_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisite edges of neighbouring parts of a brand from replies to batches of six pairs; a fenced one, one in single quotes, one that decides a pair twice, and one without decisions."""
    by = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.lead("p_partkey").over(by).alias("next"), (F.row_number().over(by) - 1).alias("n")).where("next is not null")
    p = p.withColumns({"batch": F.floor(F.col("n") / 6), "index": F.col("n") % 6})
    kind = F.element_at(F.array(F.lit("u_before_v"), F.lit("v_before_u"), F.lit("none"), F.lit("before?")), (F.col("p_partkey") % 4 + 1).cast("int"))
    made = p.groupBy("p_brand", "batch").agg(F.array_sort(F.collect_list(F.struct("index", kind.alias("relation")))).alias("decisions"))
    shape, body = F.col("batch") % 5, F.to_json(F.struct("decisions"))
    first = F.concat(F.lit('{"decisions": [{"index": 0, "relation": "none"}, '), F.substring(body, 15, 1_000_000))
    reply = F.when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(shape == 2, F.translate(body, '"', "'")).when(shape == 3, first).when(shape == 4, F.lit('{"relation": "u_before_v"}')).otherwise(body)
    said = p.join(made.select("p_brand", "batch", reply.alias("reply")), ["p_brand", "batch"])
    return said.select("p_brand", rp.relation(F.col("reply"), F.col("index"), F.col("p_partkey"), F.col("next")).alias("e")).where("e is not null").select("p_brand", "e.src", "e.dst")


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_M = "m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"

SQL = {
    "q_reply_classes": f"""WITH {_M}, r AS (SELECT conv_id, CASE WHEN role = 'user' THEN 'asked' ELSE 'told' END AS class_name, turn FROM m WHERE conv_id % 4 < 2 AND role IN ('user', 'assistant') UNION ALL SELECT conv_id, 'Unclassified', turn FROM m WHERE conv_id % 4 = 2),
      n AS (SELECT DISTINCT conv_id, c.class_name FROM m, (VALUES ('asked'), ('told')) c(class_name) WHERE conv_id % 4 < 2)
      SELECT conv_id, class_name, coalesce(string_agg(turn, ',' ORDER BY turn), '') AS labels FROM (SELECT conv_id, class_name, turn FROM r UNION ALL SELECT conv_id, class_name, NULL FROM n) GROUP BY ALL""",
    "q_reply_instances": f"""WITH {_M}, g AS (SELECT conv_id, conv_id % 6 AS shape, count(*) AS n, string_agg(text, E'\\n' ORDER BY turn) AS text FROM m GROUP BY ALL), i AS (SELECT *, unnest(range(CASE shape WHEN 0 THEN 2 WHEN 5 THEN 0 ELSE 1 END)) AS place FROM g)
      SELECT conv_id, place, CASE WHEN shape = 3 THEN 'chat instance' WHEN shape <> 4 THEN 'conversation ' || conv_id END AS instance_name, CASE WHEN shape <> 3 THEN n::VARCHAR END AS turns,
        sha256(CASE WHEN shape = 3 AND text <> '' THEN trim(text || E'\\nmore', ' ') ELSE 'more' END || CASE WHEN conv_id % 3 = 0 THEN E'\\n[Inferred] one | two' ELSE '' END) AS text_sha256 FROM i""",
    "q_reply_updates": f"""WITH {_M}, g AS (SELECT conv_id, conv_id % 3 AS shape, count(*) FILTER (role <> 'user') AS told, concat_ws(',', string_agg(turn, ',' ORDER BY turn) FILTER (role = 'user'), string_agg(turn, ',' ORDER BY turn) FILTER (role <> 'user')) AS labels,
        coalesce(string_agg(text, E'\\n' ORDER BY turn) FILTER (role = 'user'), '') AS a, coalesce(string_agg(text, E'\\n' ORDER BY turn) FILTER (role <> 'user'), '') AS b FROM m GROUP BY ALL)
      SELECT conv_id, CASE shape WHEN 0 THEN 'renamed' ELSE 'asked' END AS instance_name, CASE WHEN shape < 2 THEN told::VARCHAR END AS told, CASE WHEN shape < 2 THEN 'now' END AS recorded, labels,
        sha256(CASE shape WHEN 0 THEN 'new' WHEN 1 THEN a ELSE CASE WHEN a = '' THEN b ELSE trim(a || E'\\n' || b, ' ') END END) AS text_sha256 FROM g""",
    "q_reply_picks": """WITH c AS (SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 50 AS chunk FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY p_brand, chunk ORDER BY p_partkey) AS r FROM c WHERE p_partkey % 2 = 0 AND right(p_brand, 1) <> '5'),
      t AS (SELECT p_brand, chunk, string_agg(p_partkey, ',' ORDER BY p_partkey) AS picked FROM o WHERE r <= 10 GROUP BY ALL) SELECT p_brand, chunk, coalesce(picked, '') AS picked FROM (SELECT DISTINCT p_brand, chunk FROM c) LEFT JOIN t USING (p_brand, chunk)""",
    "q_reply_answers": "SELECT item_id, CASE WHEN item_id % 4 = 3 THEN '' ELSE left(coalesce(text, ''), 50) END AS answer FROM benchmark",
    "q_reply_conflicts": "SELECT source, count(*) AS n_conflicts, sum(toxic)::BIGINT AS n_matched FROM labels JOIN documents USING (doc_id) WHERE quality = 0 GROUP BY 1",
    "q_reply_relations": """WITH p AS (SELECT p_brand, p_partkey, lead(p_partkey) OVER w AS next, row_number() OVER w - 1 AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
      SELECT p_brand, CASE WHEN p_partkey % 4 = 0 THEN p_partkey ELSE next END AS src, CASE WHEN p_partkey % 4 = 0 THEN next ELSE p_partkey END AS dst FROM p WHERE next IS NOT NULL AND p_partkey % 4 < 2 AND (n // 6) % 5 < 4""",
}

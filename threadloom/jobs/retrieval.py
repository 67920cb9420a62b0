"""The retrieval job: seeds by class and overall, their neighbours in the graph, and the text for a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.jobs import ranking as rk
from threadloom.jobs.tables import table
from threadloom.operators import expand as ex
from threadloom.operators.graph import stored

HOPS, MOST, CHARS = 2, 6, 4000


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, record): four neighbouring documents of one language share a record."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.concat_ws(":", F.coalesce("lang", F.lit("")), F.floor(F.col("doc_id") / 16).cast("string")).alias("record"))
    return d.where("node is not null")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, record): each document with its record, which is named by its first document."""
    r = _records(spark, sf_dir)
    return r.join(r.groupBy("record").agg(F.min("node").alias("first")), "record").select("node", F.col("first").alias("record"))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, content): the text of a record's first document and its source; what no record is named by is never asked for."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record"), F.concat_ws(" ", F.coalesce("text", F.lit("")), "source").alias("content"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of every pair inside a record, which has sixteen members at most."""
    r = _records(spark, sf_dir)
    return r.join(r.select("record", F.col("node").alias("near")), "record").where("node <> near").select("node", "near").distinct()


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), tx.keywords(F.col("text")).alias("keys"))


def _expanded(spark: SparkSession, sf_dir: str, seeds: DataFrame) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "text")
    keys, members, near = (stored(f(spark, sf_dir))[0] for f in (_keys, _members, _near))  # read on every level
    return ex.ranked(seeds, near, lambda reached: ex.keyword_scores(reached, keys, texts, _contents(spark, sf_dir), members), HOPS, MOST)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the two stages of retrieval find, a table of its own."""
    return stored(rk.q_two_stage(spark, sf_dir))[0]


def q_graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six nodes within two steps of each text's seeds."""
    seeds = _seeds(spark, sf_dir).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("node"))
    return _expanded(spark, sf_dir, seeds).select(F.col("qid").alias("item_id"), F.col("node").alias("doc_id"), "hop", "score", "rank")


def q_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a question is answered from: overall seeds, seeds in the class, neighbours under their head; and how many of each."""
    found = _seeds(spark, sf_dir)
    near = _expanded(spark, sf_dir, found.select(F.col("item_id").alias("qid"), F.col("doc_id").alias("node")))
    near, _, _ = stored(near)
    both = found.select(F.col("item_id").alias("qid"), F.col("doc_id").alias("node"), (2 - F.col("stage")).alias("part"), "rank")
    both = both.unionByName(near.select("qid", "node", F.lit(2).cast("long").alias("part"), "rank"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "source", F.coalesce("text", F.lit("")).alias("text"))
    block = ex.instance_block(F.col("rank"), F.col("source"), F.col("text"))
    blocks = F.broadcast(both).join(d, "node").select("qid", F.struct("part", "rank").alias("place"), block.alias("block"))  # sixteen rows a question at most are sent to the documents
    head = near.groupBy("qid").agg(F.count("*").alias("n")).select("qid", F.struct(F.lit(2).cast("long").alias("part"), F.lit(0).cast("long").alias("rank")).alias("place"), ex.neighbour_header(["P"], HOPS, F.col("n")).alias("block"))
    whole = ex.context(blocks.unionByName(head), CHARS)
    n = lambda p: F.sum((F.col("part") == p).cast("long"))
    counts = both.groupBy("qid").agg(n(0).alias("n_global"), n(1).alias("n_in_class"), n(2).alias("n_near"))
    return whole.join(counts, "qid").select(F.col("qid").alias("item_id"), "n_global", "n_in_class", "n_near", F.char_length("context").cast("long").alias("n_chars"), F.sha2("context", 256).alias("context_sha256"))


def q_class_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as classes with their kinds and the names of all their parts, a hundred parts a line, so that no class is gathered whole."""
    p = table(spark, sf_dir, "part")
    chunk = F.floor((F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1) / 100).cast("long")
    names = p.withColumn("chunk", chunk).groupBy("p_brand", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]).alias("names"))
    kinds = p.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("kinds"))
    return kinds.join(names, "p_brand").select("p_brand", "chunk", F.sha2(ex.class_line(F.lower(F.translate("p_brand", "#", "_")), F.col("p_brand"), F.col("kinds"), F.col("names")), 256).alias("line_sha256"))


def q_prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as lines, with labels where it has an assistant's turn."""
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("m"), F.max((F.col("role") == "assistant").cast("int")).alias("labelled"))
    labels = F.when(F.col("labelled") == 1, F.transform("m", lambda x: x["turn"]))
    return g.select("conv_id", F.sha2(ex.prompt_lines(labels, F.transform("m", lambda x: x["text"])), 256).alias("lines_sha256"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_TWO = rk.SQL["q_two_stage"]
_TWO_CTES, _TWO_LAST = _TWO[: _TWO.rindex("SELECT * FROM a UNION ALL")].rstrip(), _TWO[_TWO.rindex("SELECT * FROM a UNION ALL") :]
_HITS = "len(list_filter(keys, lambda x: contains(regexp_replace(lower({}), '[''’]s\\b', '', 'g'), x)))"


def _level(hop: int, frontier: str, known: str) -> str:
    return f"""r{hop} AS (SELECT DISTINCT f.item_id, near AS doc_id FROM {frontier} f JOIN near USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM {known} v WHERE v.item_id = f.item_id AND v.doc_id = near)),
      l{hop} AS (SELECT item_id, doc_id, {hop}::BIGINT AS hop, round(0.5::DOUBLE * least(any_value({_HITS.format("coalesce(d.text, '')")}) / greatest(any_value(len(keys)), 1), 1) + 0.5::DOUBLE * least(sum({_HITS.format("content")}) / greatest(any_value(len(keys)), 1), 1), 6) AS score
        FROM r{hop} JOIN k USING (item_id) JOIN documents d USING (doc_id) JOIN rec USING (doc_id) JOIN con USING (record) GROUP BY item_id, doc_id)"""


_EXPANDED = f"""{_TWO_CTES}, seeds AS ({_TWO_LAST}), k AS (SELECT item_id, {rk._KEYS} AS keys FROM benchmark),
      rec AS (SELECT doc_id, concat_ws(':', coalesce(lang, ''), (doc_id // 16)::VARCHAR) AS record FROM documents WHERE doc_id IS NOT NULL),
      con AS (SELECT record, concat_ws(' ', coalesce(text, ''), source) AS content FROM (SELECT record, min(doc_id) AS doc_id FROM rec GROUP BY 1) JOIN documents USING (doc_id)),
      near AS (SELECT DISTINCT a.doc_id, b.doc_id AS near FROM rec a JOIN rec b USING (record) WHERE a.doc_id <> b.doc_id),
      {_level(1, 'seeds', 'seeds')}, v1 AS (SELECT item_id, doc_id FROM seeds UNION SELECT item_id, doc_id FROM l1), {_level(2, 'l1', 'v1')},
      c2 AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM (FROM l1 UNION ALL FROM l2)),
      e AS (SELECT item_id, doc_id, hop, score, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN n <= {MOST} THEN score WHEN score > 0 THEN round(score + 0.05::DOUBLE * (hop - 1), 6) ELSE score END DESC, doc_id) AS rank FROM c2 QUALIFY rank <= {MOST})"""

# pieces of a context begin at the heads of instances; whole ones stay while they fit
_CUT = f"""joined AS (SELECT item_id, string_agg(block, E'\\n\\n' ORDER BY part, rank) AS whole FROM blocks GROUP BY 1), pieces AS (SELECT item_id, whole, string_split(whole, E'\\n─── instance ') AS p FROM joined),
      piece AS (SELECT item_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM pieces), fits AS (SELECT item_id, i, piece, sum(length(piece) + CASE WHEN i > 1 THEN {len(ex.INSTANCE_HEAD)} ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i) AS used FROM piece),
      kept AS (SELECT item_id, string_agg(piece, E'\\n─── instance ' ORDER BY i) AS text FROM fits WHERE used <= {CHARS} OR i = 1 GROUP BY 1),
      shown AS (SELECT item_id, CASE WHEN length(whole) <= {CHARS} THEN whole WHEN regexp_replace(text, '\\s', '', 'g') = '' THEN left(whole, {CHARS}) ELSE text END AS context FROM joined JOIN kept USING (item_id))"""

SQL = {
    "q_graph_expand": f"{_EXPANDED} SELECT item_id, doc_id, hop, score, rank FROM e",
    "q_retrieve": f"""{_EXPANDED}, parts AS (SELECT item_id, doc_id, 2 - stage AS part, rank FROM seeds UNION ALL SELECT item_id, doc_id, 2, rank FROM e),
      blocks AS (SELECT item_id, part, rank, E'\\n─── instance ' || rank || ': ' || coalesce(source, 'none') || E' ───\\n' || coalesce(text, '') AS block FROM parts JOIN documents USING (doc_id)
        UNION ALL SELECT item_id, 2, 0, E'\\n─── Graph neighbor context (DualGraph traversal, legs=P, hops≤{HOPS}, max ' || count(*) || E' instances) ───\\n' FROM e GROUP BY item_id),
      {_CUT},
      SELECT item_id, count(*) FILTER (part = 0) AS n_global, count(*) FILTER (part = 1) AS n_in_class, count(*) FILTER (part = 2) AS n_near, length(any_value(context))::BIGINT AS n_chars, sha256(any_value(context)) AS context_sha256 FROM parts JOIN shown USING (item_id) GROUP BY item_id""",
    "q_class_lines": """WITH c AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 100 AS chunk FROM part), n AS (SELECT p_brand, chunk, string_agg(p_name, ', ' ORDER BY p_partkey) AS names FROM c GROUP BY ALL),
      k AS (SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS kinds FROM part GROUP BY 1)
      SELECT p_brand, chunk, sha256(p_brand || ' (' || lower(replace(p_brand, '#', '_')) || '): attributes: ' || kinds || '; instances: ' || names) AS line_sha256 FROM k JOIN n USING (p_brand)""",
    "q_prompt_lines": """SELECT conv_id, sha256(string_agg(CASE WHEN a THEN '标签' || turn || ': ' ELSE '- ' END || coalesce(text, ''), E'\\n' ORDER BY turn)) AS lines_sha256
      FROM (SELECT *, bool_or(role = 'assistant') OVER (PARTITION BY conv_id) AS a FROM conversations) GROUP BY conv_id""",
}

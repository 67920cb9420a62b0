"""Queries that rank documents and their lines for the benchmark's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import best
from threadloom.functions import text as tx
from threadloom.jobs.tables import table
from threadloom.operators import ranking
from threadloom.operators.graph import neighbour_score, stored

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_ASK = ", ".join(f"'{w}'" for w in tx.QUESTION_WORDS)


def _terms_sql(text: str) -> str:
    uni = f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP}))"
    return f"(SELECT list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])) FROM (SELECT {uni} AS u))"


_DOC_TERMS = f"dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms_sql('text')}) AS term FROM documents) GROUP BY ALL)"
_SIZE = "n AS (SELECT count(*) AS n FROM documents)"
_IDF = "i AS (SELECT term, count(*) AS df, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM dt, n GROUP BY term, n HAVING count(*) <= CASE WHEN n * 0.6 < 1 THEN n ELSE 0.6 * n END)"
_W = "w AS (SELECT doc_id, dt.term, tf * idf AS w FROM dt JOIN i USING (term)), nr AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)"
_Q = f"qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_terms_sql('text')}) AS term FROM benchmark) GROUP BY ALL), q AS (SELECT item_id, qt.term, tf * idf AS qw FROM qt JOIN i USING (term)), qn AS (SELECT item_id, sqrt(sum(qw * qw)) AS qnorm FROM q GROUP BY item_id)"
_SCORE = "s AS (SELECT item_id, doc_id, round(sum(qw * w) / any_value(qnorm) / any_value(norm), 6) AS score FROM q JOIN w USING (term) JOIN qn USING (item_id) JOIN nr USING (doc_id) GROUP BY item_id, doc_id)"
_BASE = f"{_DOC_TERMS}, {_SIZE}, {_IDF}, {_W}, {_Q}, {_SCORE}"


def _size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _scores(docs: DataFrame, fragments: DataFrame, asked: DataFrame, sizes: DataFrame, corpus: list[str], fragment: list[str], owner: list[str], k: int | None = None, least: float | None = None) -> DataFrame:
    """Cosines that can decide the ``k`` best owners or are ``least`` or more; ``fragments`` of documents that share an id are brought together first."""
    if best.repeated(docs, "doc_id"):
        return tx.few_cosines(fragments, asked, sizes, corpus, fragment)
    return best.best_cosines(fragments, asked, sizes, corpus, fragment, owner, k, least)


def _doc_scores(spark: SparkSession, sf_dir: str, owner: str = "doc_id", k: int | None = None, least: float | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    scored = _scores(docs, docs, tx.term_counts(_questions(spark, sf_dir), ["qid"]), _size(docs), [], ["doc_id"], [owner], k, least)
    return scored.select(F.col("qid").alias("item_id"), "doc_id", F.round("score", 6).alias("score"))


def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.words(F.coalesce("text", F.lit(""))).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(tx.ngrams(F.col("w"))).cast("long").alias("n_terms"), F.sha2(F.array_join(tx.ngrams(F.col("w")), "|"), 256).alias("terms_sha256"))


def q_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms have which document frequency, and its weight."""
    docs = table(spark, sf_dir, "documents")
    idfs = tx.idf(tx.term_counts(docs, ["doc_id"], hashed=False), _size(docs), [])
    return idfs.groupBy("df").agg(F.count("*").alias("n_terms"), F.round(F.max("idf"), 6).alias("idf"), F.min("term").alias("first_term"))


def q_idf_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: each conversation is a corpus of its turns; single turns keep their terms."""
    c = table(spark, sf_dir, "conversations")
    counts = tx.term_counts(c, ["conv_id", "turn"])
    sizes = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    kept = tx.idf(counts, sizes, ["conv_id"])
    return kept.groupBy("conv_id").agg(F.max("n").alias("n"), F.count("*").alias("n_terms"), F.round(F.sum("idf"), 4).alias("idf"))


def q_tfidf_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3."""
    docs = table(spark, sf_dir, "documents")
    return tx.norms(tx.term_counts(docs, ["doc_id"]), _size(docs), [], ["doc_id"]).select("doc_id", F.round("norm", 5).alias("norm"))


def q_tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 with K1: the ten best documents of each benchmark text."""
    return ranking.top(_doc_scores(spark, sf_dir, k=10), ["item_id"], 10, ["doc_id"]).select("item_id", "rank", "doc_id", "score").withColumn("rank", F.col("rank").cast("long"))


def q_best_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are fragments and documents their owners; the three best owners of each text with their best line."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "text")).where(F.trim("text") != "")
    scored = _scores(docs, lines, tx.term_counts(_questions(spark, sf_dir), ["qid"]), _size(lines), [], ["doc_id", "line"], ["doc_id"], 3)
    owners = ranking.best_fragment(scored, ["qid", "doc_id"], "line")
    return ranking.top(owners, ["qid"], 3, ["doc_id"]).select(F.col("qid").alias("item_id"), F.col("rank").cast("long").alias("rank"), "doc_id", F.col("line").cast("long").alias("line"), "score")


def _class_scores(spark: SparkSession, sf_dir: str, scores: DataFrame) -> DataFrame:
    owner = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return scores.join(owner, "doc_id").groupBy("item_id", "source").agg(F.max("score").alias("score"))


def q_class_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are classes, their documents fragments; the three best, padded from below the threshold."""
    out = ranking.top(_class_scores(spark, sf_dir, _doc_scores(spark, sf_dir, "source", 3)), ["item_id"], 3, ["source"], threshold=0.6, backfill=True)
    return out.select("item_id", F.col("rank").cast("long").alias("rank"), "source", "score", (F.col("score") >= 0.6).alias("above"))


def q_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, F2 without back-fill, J1: only classes at or above the threshold."""
    out = ranking.top(_class_scores(spark, sf_dir, _doc_scores(spark, sf_dir, "source", 3, 0.3)), ["item_id"], 3, ["source"], threshold=0.3, backfill=False)
    return out.select("item_id", F.col("rank").cast("long").alias("rank"), "source", "score")


def q_unclass_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: all documents at a threshold or above for each text; it is low, as no document is much like a benchmark text as a whole."""
    return _doc_scores(spark, sf_dir, least=0.2).where("score >= 0.2")


def q_unclass_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: thirty documents of each text, with those under 0.1 as padding."""
    out = ranking.top(_doc_scores(spark, sf_dir, k=30), ["item_id"], 30, ["doc_id"], threshold=0.1)
    return out.groupBy("item_id").agg(F.count("*").alias("n_found"), F.sum((F.col("score") >= 0.1).cast("long")).alias("n_above"), F.round(F.min("score"), 6).alias("least"))


def q_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best source of each text, five documents in it by weights of that source alone, five more from all others.

    A source is a corpus of its own in the first stage, so its weights are fitted once and shared by all texts
    that pick it. The second stage leaves out what the first has found.
    """
    scores, _, _ = stored(_doc_scores(spark, sf_dir, k=10))  # five of them are left where the first stage takes five
    picked = ranking.top(_class_scores(spark, sf_dir, scores), ["item_id"], 1, ["source"]).select(F.col("item_id").alias("qid"), "source")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    asked, _, _ = stored(tx.term_counts(_questions(spark, sf_dir), ["qid"]).join(picked, "qid"))
    scored = _scores(docs, docs, asked, docs.groupBy("source").agg(F.count("*").alias("n")), ["source"], ["source", "doc_id"], ["doc_id"], 5)
    inside, _, _ = stored(ranking.top(scored, ["qid"], 5, ["doc_id"]))  # read twice
    inside = inside.select(F.col("qid").alias("item_id"), "doc_id", "score", F.lit(1).cast("long").alias("stage"), F.col("rank").cast("long").alias("rank"))
    rest = scores.join(inside, ["item_id", "doc_id"], "left_anti")
    outside = ranking.top(rest, ["item_id"], 5, ["doc_id"]).select("item_id", "doc_id", "score", F.lit(2).cast("long").alias("stage"), F.col("rank").cast("long").alias("rank"))
    return inside.unionByName(outside)


def q_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten heaviest terms of each document."""
    docs = table(spark, sf_dir, "documents")
    weights = tx.weights(tx.term_counts(docs, ["doc_id"], hashed=False), _size(docs), [], ["doc_id"])
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("w", 6)), "term"))
    kept = weights.withColumn("rank", rank).where("rank <= 10")
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), "|").alias("tags"))


def q_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14, U4."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.keywords(F.col("text")), "|").alias("keywords"))


def q_kw_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each keyword as a word."""
    keys = table(spark, sf_dir, "benchmark").select(F.explode(tx.keywords(F.col("text"))).alias("keyword")).distinct()
    held = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tx.words(F.coalesce("text", F.lit(""))))).alias("keyword"))
    return held.join(keys, "keyword").groupBy("keyword").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each text with the keywords that occur in them and in their source's name."""
    top, _, _ = stored(q_tfidf_cosine(spark, sf_dir).select("item_id", "doc_id"))
    keys = table(spark, sf_dir, "benchmark").select("item_id", tx.keywords(F.col("text")).alias("keys"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"), F.concat_ws(" ", "lang", "source").alias("edge"))
    return F.broadcast(top.join(keys, "item_id")).join(docs, "doc_id").select("item_id", "doc_id", F.size("keys").cast("long").alias("n_keys"), tx.keyword_hits(F.col("keys"), F.col("body")).alias("hits"), tx.keyword_hits(F.col("keys"), F.col("edge")).alias("edge_hits"))  # ten rows a text are sent to the documents


def q_kw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15."""
    return _hits(spark, sf_dir).select("item_id", "doc_id", "n_keys", "hits")


def q_neighbor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16."""
    return _hits(spark, sf_dir).select("item_id", "doc_id", F.round(neighbour_score(F.col("hits"), F.col("edge_hits"), F.col("n_keys")), 6).alias("score"))


def q_sense_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns are matched with the user turns of their conversation; the three best at 0.3 or above, a corpus a conversation."""
    c = table(spark, sf_dir, "conversations")
    user, other = c.where("role = 'user'"), c.where("role = 'assistant'")
    counts = tx.term_counts(user, ["conv_id", "turn"])
    idfs = tx.idf(counts, user.groupBy("conv_id").agg(F.count("*").alias("n")), ["conv_id"])
    weights, norms = tx.weigh(counts, idfs, ["conv_id"], ["conv_id", "turn"])
    asked = tx.term_counts(other.withColumn("qid", F.col("turn")), ["conv_id", "qid"])
    scored = tx.cosine(asked, weights, norms, idfs, ["conv_id"], ["conv_id", "turn"])
    out = ranking.top(scored, ["conv_id", "qid"], 3, ["turn"], threshold=0.02, backfill=False)
    return out.select("conv_id", F.col("qid").alias("message"), F.col("turn").alias("matched"), F.col("rank").cast("long").alias("rank"), "score")


def q_entity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of a document (name, attributes, lines) joined, or its name alone if it has none."""
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    parts = F.concat(F.array(F.concat_ws(" ", F.lit("lang"), "lang"), F.concat_ws(" ", F.lit("source"), "source")), lines)
    return d.select("doc_id", F.size(parts).cast("long").alias("n_fragments"), F.sha2(F.array_join(parts, "\n"), 256).alias("text_sha256"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_MARKS = tx.MARKS.replace("'", "''")
_KEYS = f"list_distinct_ordered(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(trim(w, '{_MARKS}'), '[''\u2019]s$', '')), lambda w: length(w) > 2 AND w NOT IN ({_ASK})))"
_KEYS = _KEYS.replace("list_distinct_ordered(", "(SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT ")[:-1] + " AS l))"
_TOP10 = "SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= 10"
_CLASS = "c AS (SELECT item_id, coalesce(source, '') AS source, max(score) AS score FROM s JOIN documents USING (doc_id) GROUP BY 1, 2)"
_HITS = f"""top AS ({_TOP10}), k AS (SELECT item_id, {_KEYS} AS keys FROM benchmark), h AS (SELECT item_id, doc_id, len(keys) AS n_keys,
  len(list_filter(keys, lambda x: contains(regexp_replace(lower(coalesce(text, '')), '[''\u2019]s\\b', '', 'g'), x))) AS hits, len(list_filter(keys, lambda x: contains(lower(concat_ws(' ', lang, source)), x))) AS edge_hits
  FROM top JOIN k USING (item_id) JOIN documents USING (doc_id))"""

SQL = {
    "q_tokens": f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w, {_terms_sql('text')} AS g FROM documents)
      SELECT doc_id, len(w) AS n_words, len(g) AS n_terms, sha256(array_to_string(g, '|')) AS terms_sha256 FROM t""",
    "q_idf": f"WITH {_DOC_TERMS}, {_SIZE}, {_IDF} SELECT df, count(*) AS n_terms, round(max(idf), 6) AS idf, min(term) AS first_term FROM i GROUP BY df",
    "q_idf_guard": f"""WITH dt AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest({_terms_sql('text')}) AS term FROM conversations) GROUP BY ALL), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
      i AS (SELECT conv_id, n, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM dt JOIN n USING (conv_id) GROUP BY conv_id, term, n HAVING count(*) <= CASE WHEN n * 0.6 < 1 THEN n ELSE 0.6 * n END)
      SELECT conv_id, max(n) AS n, count(*) AS n_terms, round(sum(idf), 4) AS idf FROM i GROUP BY 1""",
    "q_tfidf_norms": f"WITH {_DOC_TERMS}, {_SIZE}, {_IDF}, {_W} SELECT doc_id, round(norm, 5) AS norm FROM nr",
    "q_tfidf_cosine": f"WITH {_BASE} {_TOP10}",
    "q_best_fragment": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\\n')) AS text, generate_subscripts(string_split(coalesce(text, ''), E'\\n'), 1) - 1 AS line FROM documents), ln AS (SELECT * FROM l WHERE trim(text) <> ''),
      dt AS (SELECT doc_id, line, term, count(*) AS tf FROM (SELECT doc_id, line, unnest({_terms_sql('text')}) AS term FROM ln) GROUP BY ALL), n AS (SELECT count(*) AS n FROM ln), {_IDF},
      w AS (SELECT doc_id, line, dt.term, tf * idf AS w FROM dt JOIN i USING (term)), nr AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL), {_Q},
      s AS (SELECT item_id, doc_id, line, round(sum(qw * w) / any_value(qnorm) / any_value(norm), 6) AS score FROM q JOIN w USING (term) JOIN qn USING (item_id) JOIN nr USING (doc_id, line) GROUP BY ALL),
      b AS (SELECT item_id, doc_id, max(score) AS score, arg_max(line, (score, -line)) AS line FROM s GROUP BY item_id, doc_id)
      SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, line, score FROM b QUALIFY rank <= 3""",
    "q_class_topk": f"WITH {_BASE}, {_CLASS} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source) AS rank, source, score, score >= 0.6 AS above FROM c QUALIFY rank <= 3",
    "q_threshold_topk": f"WITH {_BASE}, {_CLASS} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source) AS rank, source, score FROM c WHERE score >= 0.3 QUALIFY rank <= 3",
    "q_unclass_match": f"WITH {_BASE} SELECT item_id, doc_id, score FROM s WHERE score >= 0.2",
    "q_unclass_topk": f"WITH {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 30) SELECT item_id, count(*) AS n_found, count(*) FILTER (score >= 0.1) AS n_above, min(score) AS least FROM r GROUP BY 1",
    "q_two_stage": f"""WITH {_BASE}, {_CLASS}, p AS (SELECT item_id, source FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source) = 1),
      st AS (SELECT coalesce(source, '') AS source, doc_id, term, tf FROM dt JOIN documents USING (doc_id)), sn AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
      si AS (SELECT source, term, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM st JOIN sn USING (source) GROUP BY source, term, n HAVING count(*) <= CASE WHEN n * 0.6 < 1 THEN n ELSE 0.6 * n END),
      sw AS (SELECT source, doc_id, term, tf * idf AS w FROM st JOIN si USING (source, term)), snr AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM sw GROUP BY 1),
      sq AS (SELECT item_id, source, term, tf * idf AS qw FROM qt JOIN p USING (item_id) JOIN si USING (source, term)), sqn AS (SELECT item_id, sqrt(sum(qw * qw)) AS qnorm FROM sq GROUP BY 1),
      ss AS (SELECT item_id, doc_id, round(sum(qw * w) / any_value(qnorm) / any_value(norm), 6) AS score FROM sq JOIN sw USING (source, term) JOIN sqn USING (item_id) JOIN snr USING (doc_id) GROUP BY 1, 2),
      a AS (SELECT item_id, doc_id, score, 1::BIGINT AS stage, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ss QUALIFY rank <= 5)
      SELECT * FROM a UNION ALL SELECT item_id, doc_id, score, 2::BIGINT, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s ANTI JOIN a USING (item_id, doc_id) QUALIFY rank <= 5""",
    "q_tags": f"WITH {_DOC_TERMS}, {_SIZE}, {_IDF}, {_W}, r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 6) DESC, term) AS rank FROM w QUALIFY rank <= 10) SELECT doc_id, string_agg(term, '|' ORDER BY rank) AS tags FROM r GROUP BY 1",
    "q_keywords": f"SELECT item_id, array_to_string({_KEYS}, '|') AS keywords FROM benchmark",
    "q_kw_instances": f"""WITH k AS (SELECT DISTINCT unnest({_KEYS}) AS keyword FROM benchmark), h AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})))) AS keyword FROM documents)
      SELECT keyword, count(*) AS n_documents, min(doc_id) AS first_doc FROM h JOIN k USING (keyword) GROUP BY 1""",
    "q_kw_hits": f"WITH {_BASE}, {_HITS} SELECT item_id, doc_id, n_keys, hits FROM h",
    "q_neighbor_score": f"WITH {_BASE}, {_HITS} SELECT item_id, doc_id, round(0.5::DOUBLE * least(hits / greatest(n_keys, 1), 1) + 0.5::DOUBLE * least(edge_hits / greatest(n_keys, 1), 1), 6) AS score FROM h",
    "q_sense_classes": f"""WITH dt AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest({_terms_sql('text')}) AS term FROM conversations WHERE role = 'user') GROUP BY ALL), n AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1),
      i AS (SELECT conv_id, term, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM dt JOIN n USING (conv_id) GROUP BY conv_id, term, n HAVING count(*) <= CASE WHEN n * 0.6 < 1 THEN n ELSE 0.6 * n END),
      w AS (SELECT conv_id, turn, term, tf * idf AS w FROM dt JOIN i USING (conv_id, term)), nr AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
      q AS (SELECT conv_id, message, term, count(*) * any_value(idf) AS qw FROM (SELECT conv_id, turn AS message, unnest({_terms_sql('text')}) AS term FROM conversations WHERE role = 'assistant') JOIN i USING (conv_id, term) GROUP BY ALL), qn AS (SELECT conv_id, message, sqrt(sum(qw * qw)) AS qnorm FROM q GROUP BY ALL),
      s AS (SELECT conv_id, message, turn AS matched, round(sum(qw * w) / any_value(qnorm) / any_value(norm), 6) AS score FROM q JOIN w USING (conv_id, term) JOIN qn USING (conv_id, message) JOIN nr USING (conv_id, turn) GROUP BY ALL)
      SELECT conv_id, message, matched, row_number() OVER (PARTITION BY conv_id, message ORDER BY score DESC, matched) AS rank, score FROM s WHERE score >= 0.02 QUALIFY rank <= 3""",
    "q_entity_texts": """WITH e AS (SELECT doc_id, list_concat(['lang ' || lang, 'source ' || source], list_filter(string_split(coalesce(text, ''), E'\\n'), lambda x: trim(x) <> '')) AS p FROM documents)
      SELECT doc_id, len(p) AS n_fragments, sha256(array_to_string(p, E'\\n')) AS text_sha256 FROM e""",
}

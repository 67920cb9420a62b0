"""Queries over conversations: labels, batches, contexts, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.jobs.tables import table, turns
from threadloom.operators import ingest

_TURNS = "t AS (SELECT conv_id // 10 AS dialog, conv_id % 10 AS session, turn, role AS speaker, text FROM conversations)"
_LABELLED = _TURNS + """, m AS (SELECT *, row_number() OVER (PARTITION BY dialog ORDER BY session, turn) AS label,
  row_number() OVER (PARTITION BY dialog, session ORDER BY turn) AS pos FROM t)"""
_TEXT = """'【' || speaker || ' said: "' || coalesce(text, '') || ' Dialogue time:' || 'session ' || session || '】'"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.label(turns(spark, sf_dir))


def _rendered(df: DataFrame) -> DataFrame:
    return df.withColumn("message", ingest.render(F.col("speaker"), F.col("text"), F.concat(F.lit("session "), F.col("session").cast("string"))))


def q_session_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1."""
    keyed = turns(spark, sf_dir).select("dialog", F.concat(F.lit("session_"), F.col("session").cast("string")).alias("key")).distinct()
    keyed = keyed.unionAll(keyed.select("dialog", F.concat("key", F.lit("_date_time"))))
    return keyed.select("dialog", "key", ingest.session_number(F.col("key")).cast("long").alias("session_no")).where("session_no is not null")


def q_render_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2; the caption of a system message stands in for an image's."""
    t = turns(spark, sf_dir)
    time = F.when(F.col("session") > 0, F.concat(F.lit("session "), F.col("session").cast("string")))
    image = F.when(F.col("speaker") == "system", "image")
    return t.select("dialog", "session", "turn", ingest.render(F.col("speaker"), F.col("text"), time, image, F.lit(None).cast("string"), F.col("speaker")).alias("message"))


def q_label_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, W1."""
    return _rendered(_messages(spark, sf_dir)).select("dialog", "session", "label", "pos", "message")


def q_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, with batches of three so that sessions have several."""
    return ingest.batch(_messages(spark, sf_dir), 3).select("dialog", "session", "label", "batch_no")


def q_batch_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, W2."""
    out = ingest.batch_context(_messages(spark, sf_dir), 3, 3)
    return out.withColumn("context", F.array_join(F.transform("context", lambda x: x.cast("string")), ","))


def q_halumem_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message of context."""
    out = ingest.batch_context(_messages(spark, sf_dir), 4, 1)
    return out.withColumn("context", F.array_join(F.transform("context", lambda x: x.cast("string")), ","))


def q_batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    sizes = ingest.batch(_messages(spark, sf_dir), 3).groupBy("dialog", "session", "batch_no").count()
    return sizes.groupBy(F.col("count").alias("batch_size")).agg(F.count("*").alias("n_batches"), F.sum("count").alias("n_messages"))


def q_truncate_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 20 messages of each dialog; P19 follows from it, sessions beyond are gone."""
    kept = ingest.head(_messages(spark, sf_dir), 20)
    return kept.groupBy("dialog").agg(F.count("*").alias("n_messages"), F.countDistinct("session").alias("n_sessions"), F.max("label").alias("last_label"))


def q_context_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last 12 messages of each dialog."""
    return ingest.tail(_messages(spark, sf_dir), 12, ["dialog"]).select("dialog", "label", "speaker")


def q_truncate_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a dialog up to 2,000 characters."""
    return ingest.within_budget(_rendered(_messages(spark, sf_dir)), "dialog", "label", "message", 2000).select("dialog", "label", F.col("used").cast("long").alias("used"))


def q_sentence_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 over documents, with the full stop as mark."""
    s = ingest.sentences(table(spark, sf_dir, "documents"), "doc_id", "text", r"\.")
    return s.groupBy("doc_id", "group_no").agg(F.count("*").alias("n_sentences"), F.sum(F.char_length("sentence").cast("long")).alias("n_chars"), F.min_by("sentence", "n").alias("first_sentence"))


def q_dedup_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of messages with one label in a batch the first; two turns of a session share a label here."""
    m = ingest.batch(_messages(spark, sf_dir), 5).withColumn("label", F.floor(F.col("turn") / 2).cast("long"))
    return ingest.first_of_label(m, ["dialog", "session", "batch_no"], "label", "pos").select("dialog", "session", "batch_no", "label", "pos", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def q_merge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a session and of the one before it, as text, without repeats."""
    s = turns(spark, sf_dir).groupBy("dialog", "session").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    before = s.select("dialog", (F.col("session") + 1).alias("session"), F.col("turns").alias("earlier"))
    return s.join(before, ["dialog", "session"]).select("dialog", "session", F.array_join(ingest.merge_labels(F.col("earlier"), F.col("turns")), ",").alias("labels"))


def q_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the message three labels on, null where there is none."""
    m = _messages(spark, sf_dir)
    other = m.select("dialog", (F.col("label") - 3).alias("label"), F.col("text").alias("later"))
    return m.select("dialog", "label").join(other, ["dialog", "label"], "left")


def q_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of two neighbouring sessions by place."""
    m = _messages(spark, sf_dir).select("dialog", "session", "pos", "text")
    after = m.select("dialog", (F.col("session") - 1).alias("session"), "pos", F.col("text").alias("other"))
    return m.join(after, ["dialog", "session", "pos"]).select("dialog", "session", "pos", F.sha2(F.concat_ws("|", "text", "other"), 256).alias("both"))


def q_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of 30 characters or more whose text no assistant message of their dialog has."""
    m = _messages(spark, sf_dir)
    covered = m.where("speaker = 'assistant'").select("dialog", "text").distinct()
    return m.where(F.char_length(F.trim("text")) >= 30).join(covered, ["dialog", "text"], "left_anti").select("dialog", "label", "speaker")


def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each dialog's messages in order."""
    m = _messages(spark, sf_dir)
    ordered = m.groupBy("dialog").agg(F.array_sort(F.collect_list(F.struct("label", F.coalesce("text", F.lit("")).alias("text")))).alias("all"))
    return ordered.select("dialog", F.sha2(F.array_join(F.transform("all", lambda x: x["text"]), "\n"), 256).alias("fingerprint"))


def q_hash_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One new instance for each batch and speaker of a dialog: its text, labels and number in its class."""
    m = ingest.batch(_rendered(_messages(spark, sf_dir)), 3)
    made = m.groupBy("dialog", F.col("speaker").alias("class_name"), "session", "batch_no").agg(F.array_sort(F.collect_list(F.struct("label", "message"))).alias("all"))


    number = F.row_number().over(Window.partitionBy("dialog", "class_name").orderBy("session", "batch_no"))
    return made.select("dialog", "class_name", F.concat(F.lit("instance_"), number.cast("string")).alias("instance_id"), F.array_join(F.transform("all", lambda x: x["label"].cast("string")), ",").alias("labels"), F.sha2(F.array_join(F.transform("all", lambda x: x["message"]), "\n"), 256).alias("text_sha256"))


def q_new_class_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new class for each session whose first message is not the user's, numbered in order."""


    first = _messages(spark, sf_dir).where("pos = 1 and speaker <> 'user'").select("dialog", "session")
    return first.withColumn("class_id", F.concat(F.lit("class_"), F.row_number().over(Window.partitionBy("dialog").orderBy("session")).cast("string")))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

SQL = {
    "q_session_keys": f"WITH {_TURNS} SELECT DISTINCT dialog, 'session_' || session AS key, session AS session_no FROM t",
    "q_render_messages": f"""WITH {_TURNS} SELECT dialog, session, turn, CASE WHEN speaker = 'system'
      THEN '【' || speaker || ' sent an image: No description. Image content: ' || speaker || '. Dialogue: ' || coalesce(text, '') || ' Dialogue time:' || CASE WHEN session > 0 THEN 'session ' || session ELSE '未知时间' END || '】'
      ELSE '【' || speaker || ' said: "' || coalesce(text, '') || ' Dialogue time:' || CASE WHEN session > 0 THEN 'session ' || session ELSE '未知时间' END || '】' END AS message FROM t""",
    "q_label_messages": f"WITH {_LABELLED} SELECT dialog, session, label, pos, {_TEXT} AS message FROM m",
    "q_batches": f"WITH {_LABELLED} SELECT dialog, session, label, (pos - 1) // 3 AS batch_no FROM m",
    "q_batch_context": f"""WITH {_LABELLED}, b AS (SELECT *, (pos - 1) // 3 AS batch_no FROM m), g AS (SELECT dialog, session, batch_no, count(*) AS n_messages, min(label) AS first_label, max(label) AS last_label, min(pos) AS p FROM b GROUP BY ALL)
      SELECT g.dialog, g.session, g.batch_no, n_messages, first_label, last_label, coalesce((SELECT string_agg(m.label, ',' ORDER BY m.pos) FROM m WHERE m.dialog = g.dialog AND m.session = g.session AND m.pos BETWEEN g.p - 3 AND g.p - 1), '') AS context FROM g""",
    "q_halumem_batches": f"""WITH {_LABELLED}, b AS (SELECT *, (pos - 1) // 4 AS batch_no FROM m), g AS (SELECT dialog, session, batch_no, count(*) AS n_messages, min(label) AS first_label, max(label) AS last_label, min(pos) AS p FROM b GROUP BY ALL)
      SELECT g.dialog, g.session, g.batch_no, n_messages, first_label, last_label, coalesce((SELECT string_agg(m.label, ',') FROM m WHERE m.dialog = g.dialog AND m.session = g.session AND m.pos = g.p - 1), '') AS context FROM g""",
    "q_batch_sizes": f"WITH {_LABELLED}, s AS (SELECT count(*) AS c FROM m GROUP BY dialog, session, (pos - 1) // 3) SELECT c AS batch_size, count(*) AS n_batches, sum(c)::BIGINT AS n_messages FROM s GROUP BY c",
    "q_truncate_conv": f"WITH {_LABELLED} SELECT dialog, count(*) AS n_messages, count(DISTINCT session) AS n_sessions, max(label) AS last_label FROM m WHERE label <= 20 GROUP BY dialog",
    "q_context_trim": f"WITH {_LABELLED} SELECT dialog, label, speaker FROM m QUALIFY row_number() OVER (PARTITION BY dialog ORDER BY label DESC) <= 12",
    "q_truncate_context": f"WITH {_LABELLED}, r AS (SELECT dialog, label, sum(length({_TEXT})) OVER (PARTITION BY dialog ORDER BY label)::BIGINT AS used FROM m) SELECT * FROM r WHERE used <= 2000",
    "q_sentence_batches": r"""WITH s AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), '.')) AS raw, generate_subscripts(string_split(coalesce(text, ''), '.'), 1) AS place FROM documents),
      k AS (SELECT doc_id, place, trim(raw, E' \n\t') AS sentence FROM s WHERE trim(raw, E' \n\t') <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM k)
      SELECT doc_id, (n - 1) // 5 AS group_no, count(*) AS n_sentences, sum(length(sentence))::BIGINT AS n_chars, arg_min(sentence, n) AS first_sentence FROM n GROUP BY ALL""",
    "q_dedup_labels": f"WITH {_LABELLED}, b AS (SELECT dialog, session, (pos - 1) // 5 AS batch_no, turn // 2 AS label, pos, text FROM m) SELECT dialog, session, batch_no, label, pos, sha256(coalesce(text, '')) AS text_sha256 FROM b QUALIFY row_number() OVER (PARTITION BY dialog, session, batch_no, label ORDER BY pos) = 1",
    "q_merge_labels": f"""WITH {_TURNS}, s AS (SELECT dialog, session, list(turn ORDER BY turn) AS turns FROM t GROUP BY ALL)
      SELECT a.dialog, a.session, array_to_string(list_concat(b.turns, list_filter(a.turns, lambda x: NOT list_contains(b.turns, x))), ',') AS labels FROM s a JOIN s b ON a.dialog = b.dialog AND a.session = b.session + 1""",
    "q_label_lookup": f"WITH {_LABELLED} SELECT a.dialog, a.label, b.text AS later FROM m a LEFT JOIN m b ON a.dialog = b.dialog AND b.label = a.label + 3",
    "q_positional_zip": f"WITH {_LABELLED} SELECT a.dialog, a.session, a.pos, sha256(concat_ws('|', a.text, b.text)) AS \"both\" FROM m a JOIN m b ON a.dialog = b.dialog AND b.session = a.session + 1 AND a.pos = b.pos",
    "q_uncovered": f"WITH {_LABELLED} SELECT dialog, label, speaker FROM m WHERE length(trim(text)) >= 30 AND NOT EXISTS (SELECT 1 FROM m c WHERE c.speaker = 'assistant' AND c.dialog = m.dialog AND c.text = m.text)",
    "q_fingerprint": f"WITH {_LABELLED} SELECT dialog, sha256(string_agg(coalesce(text, ''), E'\\n' ORDER BY label)) AS fingerprint FROM m GROUP BY dialog",
    "q_hash_instances": f"""WITH {_LABELLED}, b AS (SELECT *, {_TEXT} AS message, (pos - 1) // 3 AS batch_no FROM m),
      g AS (SELECT dialog, speaker AS class_name, session, batch_no, string_agg(label, ',' ORDER BY label) AS labels, sha256(string_agg(message, E'\\n' ORDER BY label)) AS text_sha256 FROM b GROUP BY ALL)
      SELECT dialog, class_name, 'instance_' || row_number() OVER (PARTITION BY dialog, class_name ORDER BY session, batch_no) AS instance_id, labels, text_sha256 FROM g""",
    "q_new_class_ids": f"WITH {_LABELLED} SELECT dialog, session, 'class_' || row_number() OVER (PARTITION BY dialog ORDER BY session) AS class_id FROM m WHERE pos = 1 AND speaker <> 'user'",
}

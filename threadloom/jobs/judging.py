"""Queries over judged answers and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.jobs.tables import table
from threadloom.operators import evaluation as ev


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are judged questions: quality is right or wrong, the id gives a category, the source of the text a strategy."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return l.join(d, "doc_id").withColumn("category", F.col("doc_id") % 5 + 1)


def q_qa_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first 300 questions in order those that are not of category 5; the limit comes before the skip."""
    return ev.asked(_judged(spark, sf_dir), "doc_id", 300, skip=5).select("doc_id", "category", F.col("quality").cast("long").alias("quality"))


def q_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return ev.accuracy(_judged(spark, sf_dir), [], F.col("quality") == 1)


def q_category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, B24."""
    return ev.accuracy(_judged(spark, sf_dir).where("category <> 5"), ["category"], F.col("quality") == 1)


def q_strategy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: percentages by strategy and category, by strategy, and over all; D9 applies."""
    r = _judged(spark, sf_dir).rollup("lang", "category").agg(F.count("*").alias("n_total"), F.round(F.avg(F.col("quality").cast("double")) * 100, 2).alias("percent"))
    return r.select(F.coalesce("lang", F.lit("all")).alias("strategy"), F.coalesce(F.col("category").cast("string"), F.lit("all")).alias("category"), "n_total", "percent")


def q_ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are conditions, the first is the control."""
    acc = ev.accuracy(_judged(spark, sf_dir), ["source"], F.col("quality") == 1)
    return ev.delta_to_first(acc.select("source", "accuracy"), "accuracy", "source")


def q_weighted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: sources weigh by their number of answers."""
    acc = ev.accuracy(_judged(spark, sf_dir), ["lang", "source"], F.col("quality") == 1)
    return acc.groupBy("lang").agg(F.sum("n_right").alias("n_right"), F.sum("n_total").alias("n_total")).withColumn("accuracy", F.round(F.col("n_right") / F.col("n_total"), 6))


def q_scalability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by length class, what is missing is skipped."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    size = F.ceil(F.log2(F.greatest(F.col("n_chars"), F.lit(1)).cast("double"))).cast("long")
    return d.groupBy(size.alias("size_class")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("n_chars").cast("double")), 4).alias("mean_chars"), F.round(F.coalesce(F.avg(F.col("quality").cast("double")), F.lit(0.0)), 6).alias("accuracy"))


def q_qa_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose answer is not judged yet."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def q_judge_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of a judge in ten shapes are read back, with fields in single quotes, before a trailing comma and inside a cut-off object among them."""
    l = table(spark, sf_dir, "labels")
    word = F.when(F.col("quality") == 1, "CORRECT").otherwise("WRONG")
    shape = F.col("doc_id") % 10
    said = F.when(shape == 0, F.concat(F.lit('Reason. {"label": "'), word, F.lit('"}'))).when(shape == 1, F.concat(F.lit("Because of this\n"), word))
    said = said.when(shape == 2, F.concat(F.lit("It is "), F.lower(word), F.lit(", I think"))).when(shape == 3, F.concat(F.lit("First\n "), F.lower(word), F.lit(" \nbecause of this")))
    said = said.when(shape == 4, F.concat(F.lit('"LABEL" : "'), F.lower(word), F.lit('" and WRONG'))).when(shape == 5, F.concat(word, F.lit("\r\nWRONG\r\n\r\n")))
    said = said.when(shape == 6, F.concat(F.lit("{'label': '"), word, F.lit("'}"))).when(shape == 7, F.concat(F.lit('```json\n{"label": " '), F.lower(word), F.lit(' ",}\n```\nWRONG')))
    said = said.when(shape == 8, F.concat(F.lit('{"label": "'), word, F.lit('", "why": "it'))).otherwise("")
    return l.select("doc_id", ev.judge_label(said).alias("label"))


def q_conflict_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents found toxic against those of low quality: both, only one, only the other."""
    l = table(spark, sf_dir, "labels")
    a, b = l.where("toxic = 1").select("doc_id").distinct(), l.where("quality = 0").select("doc_id").distinct()
    met = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "doc_id", "full")
    n = lambda c: F.count(F.when(c, 1))
    return met.agg(n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), n(F.col("b").isNull()).alias("n_warning_only"), n(F.col("a").isNull()).alias("n_error_only"))


def q_conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged texts of a class before and in a step, as groups to be checked."""
    j = _judged(spark, sf_dir).withColumn("step", F.when(F.col("category") <= 2, "old").otherwise("new"))
    g = j.groupBy("source").agg(F.sum((F.col("step") == "old").cast("long")).alias("n_old"), F.sum((F.col("step") == "new").cast("long")).alias("n_new"))
    return g.where("n_new > 0")


def q_conflict_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts against each other by different words shared, as far as they share any of three letters or more."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{3,}"), F.lit(0)))).alias("w"))
    met = b.join(b.select(F.col("item_id").alias("other"), "w"), "w").where("item_id < other").groupBy("item_id", "other").agg(F.count("*").alias("n_shared"))
    return met.where("n_shared >= 5")


def q_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's turn against the answer that follows it."""
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(ev.token_f1(F.coalesce("text", F.lit("")), F.coalesce("answer", F.lit(""))), 6).alias("f1"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the answer that follows."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")), ["conv_id", "turn"])


def q_rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest common subsequence of each turn and the answer that follows it."""
    return _answers(spark, sf_dir).select("conv_id", "turn", F.round(ev.rouge_l(F.col("text"), F.col("answer")), 6).alias("rouge_l"))


def q_slot_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of eight letters or more as slots of turns and answers, by the turn's number."""
    slots = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}]{8,}"), F.lit(0))
    return ev.slot_f1(_answers(spark, sf_dir).select("turn", slots("text").alias("a"), slots("answer").alias("b")), ["turn"], "a", "b")


def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of accuracy and of the difference to the toxic marks, by language, 200 replicates."""
    j = _judged(spark, sf_dir).select("doc_id", "lang", F.col("quality").cast("double").alias("right"), (F.col("quality") - F.col("toxic")).cast("double").alias("difference"))
    return ev.bootstrap(j, ["lang"], "doc_id", ["right", "difference"], 200)


def q_llm_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and time by phase."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("n_calls"), F.round(F.sum("value"), 2).alias("ms"))


def q_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of each record's JSON; what does not parse is counted."""
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count_if(F.col("k").isNull()).alias("n_bad"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_J = "j AS (SELECT l.*, source, lang, l.doc_id % 5 + 1 AS category FROM labels l JOIN documents d USING (doc_id))"
_ACC = "sum(quality)::BIGINT AS n_right, count(*) - sum(quality)::BIGINT AS n_wrong, count(*) AS n_total, round(sum(quality) / count(*)::DOUBLE, 6) AS accuracy"

SQL = {
    "q_qa_filter": f"WITH {_J} SELECT doc_id, category, quality::BIGINT AS quality FROM (SELECT * FROM j ORDER BY doc_id LIMIT 300) WHERE category <> 5",
    "q_accuracy": f"WITH {_J} SELECT {_ACC} FROM j",
    "q_category_stats": f"WITH {_J} SELECT category, {_ACC} FROM j WHERE category <> 5 GROUP BY 1",
    "q_strategy_rollup": f"WITH {_J} SELECT coalesce(lang, 'all') AS strategy, coalesce(category::VARCHAR, 'all') AS category, count(*) AS n_total, round(avg(quality) * 100, 2) AS percent FROM j GROUP BY ROLLUP (lang, category)",
    "q_ablation_delta": f"WITH {_J}, a AS (SELECT source, {_ACC} FROM j GROUP BY 1) SELECT source, accuracy, round(accuracy - first_value(accuracy) OVER (ORDER BY source), 6) AS delta FROM a",
    "q_weighted_accuracy": f"WITH {_J} SELECT lang, sum(quality)::BIGINT AS n_right, count(*) AS n_total, round(sum(quality) / count(*)::DOUBLE, 6) AS accuracy FROM j GROUP BY 1",
    "q_scalability": "SELECT ceil(log2(greatest(n_chars, 1)))::BIGINT AS size_class, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, round(coalesce(avg(quality), 0), 6) AS accuracy FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "q_qa_resume": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "q_rouge_l": r"""WITH RECURSIVE p AS (SELECT a.conv_id, a.turn, regexp_extract_all(lower(coalesce(a.text, '')), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(coalesce(b.text, '')), '[\p{L}\p{N}]+') AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
      r AS (SELECT conv_id, turn, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS row FROM p
        UNION ALL SELECT p.conv_id, p.turn, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]), lambda acc, j: list_append(acc, CASE WHEN a[i + 1] = b[j[1]] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], acc[len(acc)]) END)::BIGINT[], [0::BIGINT]) FROM r JOIN p USING (conv_id, turn) WHERE i < len(a))
      SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE 2.0::DOUBLE * row[len(row)] / (len(a) + len(b)) END, 6) AS rouge_l FROM r JOIN p USING (conv_id, turn) WHERE i = len(a)""",
    "q_slot_f1": r"""WITH p AS (SELECT a.turn, list_distinct(regexp_extract_all(lower(coalesce(a.text, '')), '[\p{L}]{8,}')) AS a, list_distinct(regexp_extract_all(lower(coalesce(b.text, '')), '[\p{L}]{8,}')) AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
      s AS (SELECT turn, sum(len(list_intersect(a, b))) AS hit, sum(len(b)) AS said, sum(len(a)) AS gold, avg(CASE WHEN len(list_intersect(a, b)) = len(a) AND len(a) = len(b) THEN 1.0::DOUBLE ELSE 0 END) AS joint FROM p GROUP BY 1)
      SELECT turn, round(coalesce(hit / nullif(said, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(hit / nullif(gold, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * hit / nullif(said + gold, 0)::DOUBLE, 0), 6) AS f1, round(joint, 6) AS joint_goal FROM s""",
    "q_bootstrap": f"""WITH j AS (SELECT doc_id, lang, quality::DOUBLE AS "right", (quality - toxic)::DOUBLE AS difference FROM labels JOIN documents USING (doc_id)), d AS (SELECT lang, "right", difference, i, ('0x' || left(md5(doc_id || '/' || i), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM j, range(200) t(i)),
      w AS (SELECT lang, "right", difference, i, {' + '.join(f'(u >= {p})::INT' for p in ev._POISSON)} AS n FROM d),
      s AS (SELECT lang, i, sum(n * "right") / nullif(sum(n), 0) AS r, sum(n * difference) / nullif(sum(n), 0) AS d FROM w GROUP BY ALL), x AS (SELECT lang, 'right' AS value, r AS mean FROM s UNION ALL SELECT lang, 'difference', d FROM s),
      q AS (SELECT lang, value, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM x GROUP BY ALL), m AS (SELECT lang, 'right' AS value, avg("right") AS mean FROM j GROUP BY 1 UNION ALL SELECT lang, 'difference', avg(difference) FROM j GROUP BY 1)
      SELECT lang, value, round(mean, 6) AS mean, low, high FROM m JOIN q USING (lang, value)""",
    "q_judge_label": "SELECT doc_id, CASE WHEN quality = 1 AND doc_id % 10 IN (0, 1, 3, 4, 6, 7, 8) THEN 'CORRECT' ELSE 'WRONG' END AS label FROM labels",
    "q_conflict_matrix": "SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS n_both, count(*) FILTER (toxic = 1 AND quality <> 0) AS n_warning_only, count(*) FILTER (toxic <> 1 AND quality = 0) AS n_error_only FROM labels",
    "q_conflict_groups": f"WITH {_J} SELECT source, count(*) FILTER (category <= 2) AS n_old, count(*) FILTER (category > 2) AS n_new FROM j GROUP BY 1 HAVING n_new > 0",
    "q_conflict_match": r"WITH b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}]{3,}'))) AS w FROM benchmark) SELECT a.item_id, b.item_id AS other, count(*) AS n_shared FROM b a JOIN b USING (w) WHERE a.item_id < b.item_id GROUP BY ALL HAVING count(*) >= 5",
    "q_token_f1": r"""WITH p AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(lower(coalesce(a.text, '')), '[\p{L}\p{N}]+')) AS x, list_distinct(regexp_extract_all(lower(coalesce(b.text, '')), '[\p{L}\p{N}]+')) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
      SELECT conv_id, turn, CASE WHEN len(x) + len(y) = 0 THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)), 6) END AS f1 FROM p""",
    "q_llm_phase": "SELECT event_type AS phase, count(*) AS n_calls, round(sum(value), 2) AS ms FROM events GROUP BY 1",
    "q_json_parse": "SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS n_bad FROM events GROUP BY 1",
}

"""Greedy cover of a question's keywords by instances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import stored

COMBOS, PICKS, EXTRAS, ENOUGH = 3, 5, 7, 10


def set_cover(held: DataFrame) -> DataFrame:
    """Qid, doc, combo (0 for extras) and place, from rows (qid, doc, keyword).

    Up to three disjoint combinations of up to five instances each: every pick covers the most keywords
    that its combination lacks, the one with fewer keywords among equals, then the smaller id. If fewer than ten are
    picked, up to seven extras go to keywords that nothing covers yet. All questions make a pick a round: instances
    meet their question's state (its keywords and at most 22 picks), and the best one is found by an aggregate with map-side combining, however
    many instances a question has. Rounds are bounded by the picks and the changes of combination. Rows with a null are dropped, repeats are one.
    """
    docs, _, _ = stored(held.select("qid", "doc", "keyword").dropna().groupBy("qid", "doc").agg(F.collect_set("keyword").alias("keys")))
    every = held.dropna(subset=["qid", "doc", "keyword"]).groupBy("qid").agg(F.array_sort(F.collect_set("keyword")).alias("every"))
    none = F.array().cast("array<struct<doc:bigint,combo:bigint,place:bigint>>")
    state, left, _ = stored(every.select("qid", "every", F.col("every").alias("missing"), F.slice("every", 1, 0).alias("covered"), F.lit(1).cast("long").alias("combo"), F.lit(0).cast("long").alias("place"), none.alias("picks")))
    ended = state.limit(0)
    while left:  # a round adds a pick or goes on to the next combination
        gain = F.size(F.array_intersect("keys", "missing"))
        free = docs.join(state, "qid").where(~F.array_contains(F.col("picks.doc"), F.col("doc"))).select("qid", "doc", "keys", gain.alias("gain")).where("gain > 0")
        best = free.groupBy("qid").agg(F.max_by(F.struct("doc", "keys"), F.struct("gain", -F.size("keys"), -F.col("doc"))).alias("best"))
        now = state.join(best, "qid", "left").withColumn("hit", F.col("best").isNotNull())
        now = now.withColumns(
            {
                "place": F.col("place") + F.col("hit").cast("long"),
                "missing": F.when(F.col("hit"), F.array_except("missing", "best.keys")).otherwise(F.col("missing")),
                "covered": F.when(F.col("hit") & (F.col("combo") > 0), F.array_union("covered", "best.keys")).otherwise(F.col("covered")),
                "picks": F.when(F.col("hit"), F.array_append("picks", F.struct(F.col("best.doc").alias("doc"), "combo", (F.col("place") + 1).alias("place")))).otherwise(F.col("picks")),
            }
        )
        full = ~F.col("hit") | (F.size("missing") == 0) | (F.col("place") == F.when(F.col("combo") > 0, PICKS).otherwise(EXTRAS)) | ((F.col("combo") == 0) & (F.size("picks") >= ENOUGH))
        following = F.when(F.col("combo") == 0, -1).when(F.col("combo") < COMBOS, F.col("combo") + 1).otherwise(0).cast("long")
        now = now.withColumn("full", full).withColumn("combo", F.when(F.col("full"), following).otherwise(F.col("combo")))
        rest = F.when(F.col("combo") > 0, F.col("every")).otherwise(F.array_except("every", "covered"))
        now = now.withColumns({"missing": F.when(F.col("full"), rest).otherwise(F.col("missing")), "place": F.when(F.col("full"), F.lit(0).cast("long")).otherwise(F.col("place"))})
        over = (F.col("combo") < 0) | ((F.col("combo") == 0) & ((F.size("picks") >= ENOUGH) | (F.size("missing") == 0)))
        now, _, _ = stored(now.select(*state.columns, over.alias("over")))
        ended = ended.unionAll(now.where("over").drop("over"))
        state, left = now.where("not over").drop("over"), now.where("not over").limit(1).count()
    return ended.select("qid", F.explode("picks").alias("p")).select("qid", "p.doc", "p.combo", "p.place")

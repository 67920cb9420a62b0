"""Questions answered by a client, each once, whatever interrupts the work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import model
from threadloom.functions import replies as rp
from threadloom.sources import store

ANSWERS = "qid bigint, answer string, status string"


def answers(questions: DataFrame, folder: str, source: str, make_client: Callable[[], model.Client], tries: int = 2) -> DataFrame:
    """(qid, answer, status) of all questions (qid, prompt).

    What is answered is written as one more part of ``folder``; a later call asks only what no finished part answers, and a
    folder begun for another ``source`` is refused. A reply's response is the answer; one that cannot be read, or a call that fails
    to the end, answers with an empty text.
    """
    spark = questions.sparkSession
    store.guard(spark, folder, source)
    parts = store.finished(spark, f"{folder}/answers")
    done = spark.read.schema(ANSWERS).parquet(*parts) if parts else spark.createDataFrame([], ANSWERS)
    rest = model.ask(questions.join(done.select("qid"), "qid", "left_anti"), "prompt", make_client, tries)
    made = rest.select("qid", F.when(F.col("status") == "ok", rp.answer(rp.content(F.col("answer")))).otherwise("").alias("answer"), "status")
    made.write.mode("overwrite").parquet(f"{folder}/answers/{len(parts):06d}")
    return spark.read.schema(ANSWERS).parquet(*store.finished(spark, f"{folder}/answers"))

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.jobs import ranking as rk
from threadloom.jobs import retrieval as rt


def written(spark, query):
    """Bytes that go through exchanges while ``query`` runs."""
    seen = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = seen()
    query().write.format("noop").mode("overwrite").save()
    return seen() - before


@pytest.mark.parametrize("query, most", [(rk.q_best_fragment, 4), (rk.q_class_topk, 7), (rt.q_graph_expand, 25)])
def test_terms_of_all_texts_stay_where_they_are(spark, query, most):
    data = "/root/testdata/sf0.01"
    size = os.path.getsize(f"{data}/documents.parquet")
    assert written(spark, lambda: query(spark, data)) < most * size


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        said = " ".join(words[j] for j in np.minimum(rng.zipf(1.5, int(rng.integers(1, 25))), 60) - 1)
        rows.append((i if i != 11 else None, "abc"[i % 3] if i % 7 else "a", said if i % 50 else [None, "", "the of"][i // 50 % 3]))
    rows += [(1000 + i, "b", rows[5][2]) for i in range(30)]  # copies, which are all equal
    asked = [(q, " ".join(words[j] for j in rng.integers(0, 60, 6))) for q in range(8)] + [(8, rows[5][2]), (9, "nothing known"), (10, "")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5).cache(), spark.createDataFrame(asked, "qid long, text string")


def rows_of(scored, by, owner, k, least):
    """What decides the k best owners: of each one that is among them, or equal to the last, all fragments that attain its best."""
    best, out = {}, set()
    for r in scored:
        best[(r["qid"], r[owner])] = max(best.get((r["qid"], r[owner]), 0), r["score"])
    for r in scored:
        own = sorted((s for (q, _), s in best.items() if q == r["qid"]), reverse=True)
        if r["score"] >= least and (k is None or r["score"] >= (own[k - 1] if len(own) >= k else 0) and r["score"] == best[(r["qid"], r[owner])]):
            out.add((r["qid"], *[r[c] for c in by], r["score"]))
    return out


@pytest.mark.parametrize("owner, k, least", [("doc_id", 3, None), ("source", 2, None), ("source", 5, None), ("doc_id", None, 0.3), ("source", 2, 0.4)])
@pytest.mark.parametrize("corpus", [[], ["source"]])
@pytest.mark.parametrize("narrow", [False, True])
def test_best_cosines_are_those_of_all(spark, texts, monkeypatch, owner, k, least, corpus, narrow):
    """The rows that decide are all there and exact, also where counters are few and tasks keep next to nothing."""
    from threadloom.functions import best

    docs, questions = texts
    if narrow:
        for name, value in (("OWNERS", 1), ("EACH", 1), ("CELLS", 300), ("NEAR", 1.0)):
            monkeypatch.setattr(best, name, value)
    asked = tx.term_counts(questions, ["qid"])
    sizes = docs.groupBy(*corpus).agg(F.count("*").alias("n"))
    if corpus:
        asked = asked.withColumn("source", F.when(F.col("qid") % 2 == 0, "a").otherwise("b"))
    by = [*corpus, "doc_id"]
    every = tx.few_cosines(docs, asked, sizes, corpus, by).withColumn("score", F.round("score", 6)).join(docs.select("doc_id", "source"), by).collect()
    found = best.best_cosines(docs, asked, sizes, corpus, by, [owner], k, least).withColumn("score", F.round("score", 6)).collect()
    got = {(r["qid"], *[r[c] for c in by], r["score"]) for r in found}
    assert len(got) == len(found) and got <= {(r["qid"], *[r[c] for c in by], r["score"]) for r in every}
    assert rows_of(every, by, owner, k, least or 0) <= got and every


def test_documents_that_share_an_id_are_one_fragment(spark):
    docs = spark.createDataFrame([(1, "red fox"), (1, "red hen"), (2, "blue fox"), (3, "green cow"), (3, "blue hen")], "doc_id long, text string")
    asked = tx.term_counts(spark.createDataFrame([(1, "red fox hen")], "qid long, text string"), ["qid"])
    sizes = docs.agg(F.count("*").alias("n"))
    found, wanted = (sorted((r.doc_id, round(r.score, 9)) for r in x.collect()) for x in (rk._scores(docs, docs, asked, sizes, [], ["doc_id"], ["doc_id"], 3), tx.few_cosines(docs, asked, sizes, [], ["doc_id"])))
    assert found == wanted and len(found) == 3

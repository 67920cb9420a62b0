"""Measures of answers against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions import vectors as vx
from threadloom.operators import evaluation as ev


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_rouge_l(spark):
    rng = random.Random(2)
    made = [(" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 150))), " ".join(rng.choice("abcdeF") for _ in range(rng.randint(0, 90)))) for _ in range(40)] + [("", ""), (None, "x"), ("x", None), ("É é", "é É")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(made)], "i int, a string, b string").select("i", ev.rouge_l(F.col("a"), F.col("b")).alias("f"))
    for r in rows.collect():
        a, b = ((x or "").lower().split() for x in made[r.i])
        assert r.f == pytest.approx(1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b)))


def test_slots(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["b", "c"]), (1, ["x"], ["x"]), (1, None, []), (2, ["a"], None)], "g int, gold array<string>, said array<string>")
    found = {r.g: (r.precision, r.recall, r.f1, r.joint_goal) for r in ev.slot_f1(rows, ["g"], "gold", "said").collect()}
    assert found == {1: (round(2 / 3, 6), round(2 / 3, 6), round(2 / 3, 6), round(2 / 3, 6)), 2: (0.0, 0.0, 0.0, 0.0)}


def test_draws_are_poisson(spark):
    n = spark.range(40_000).select(ev.draws(F.col("id"), F.lit(3)).alias("n"))
    row = n.agg(F.avg("n").alias("mean"), F.variance("n").alias("var"), F.max("n").alias("most")).first()
    assert abs(row["mean"] - 1) < 0.02 and abs(row["var"] - 1) < 0.04 and row["most"] <= 8


def test_intervals_hold_the_mean_as_often_as_they_say(spark):
    """120 groups of 80 coin throws: intervals at 90 % miss the true mean in about a tenth of the groups."""
    rng = random.Random(5)
    rows = [(g, 1000 * g + i, float(rng.random() < 0.4), float(rng.random() < 0.4)) for g in range(120) for i in range(80)]
    found = ev.bootstrap(spark.createDataFrame(rows, "g int, i bigint, a double, b double").withColumn("d", F.col("a") - F.col("b")), ["g"], "i", ["a", "d"], 120, 0.9).collect()
    for value, true in (("a", 0.4), ("d", 0.0)):
        some = [r for r in found if r.value == value]
        held = sum(r.low <= true <= r.high for r in some) / len(some)
        assert len(some) == 120 and 0.8 <= held <= 0.97, (value, held)
        assert all(r.low <= r.mean <= r.high for r in some)


def test_pair_that_rounds_up_to_the_threshold(spark):
    """0.3999998 is 0.4 at six places, as it is to the queries' SQL; four more of several tiles and blocks."""
    c = 0.3999998
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [c, (1 - c * c) ** 0.5]), (3, [0.0, -2.0]), (4, None)], "k long, e array<double>")
    for blocks in (1, 3):
        assert [(r.u, r.v) for r in vx.similar_pairs(rows, "k", "e", 0.4, blocks).collect()] == [(1, 2)]


def test_pairs_and_nearest_over_several_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((90, 6)).astype("float32")
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, e array<float>")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    monkeypatch.setattr(vx, "TILE", 7)
    for blocks in (1, 4):
        assert sorted((r.u, r.v) for r in vx.similar_pairs(rows, "k", "e", 0.3, blocks).collect()) == [(i, j) for i in range(90) for j in range(i + 1, 90) if score[i, j] >= 0.3]
        near = vx.nearest(rows.where("k < 20"), rows.where("k >= 20"), "k", "e", blocks, 2).collect()
        assert {r.a: r.b for r in near} == {i: int(20 + score[i, 20:].argmax()) for i in range(20)} and len(near) == 20


def test_few_cosines_are_cosines(spark):
    """Scores over the terms that are asked for alone equal those over all terms, in one corpus and in several; counts stay in as many tasks as the session names."""
    texts = ["red fox runs far", "red red hen sits", "blue fox sleeps far", "green hen runs", "", None, "red fox runs far away"]
    rows = spark.createDataFrame([("ab"[i % 2], i, t) for i, t in enumerate(texts)], "c string, d long, text string")
    asked = [(1, "red fox"), (2, "blue hen runs"), (3, "nothing known")]
    for corpus in ([], ["c"]):
        found = [(q, *([c] if corpus else []), t) for q, t in asked for c in "ab"[: 2 if corpus else 1]]
        queries = tx.term_counts(spark.createDataFrame(found, ", ".join(["qid long", *(["c string"] if corpus else []), "text string"])), ["qid", *corpus])
        sizes = rows.groupBy(*corpus).agg(F.count("*").alias("n"))
        counts = tx.term_counts(rows, [*corpus, "d"])
        assert counts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        idfs = tx.idf(counts, sizes, corpus)
        weights, norms = tx.weigh(counts, idfs, corpus, [*corpus, "d"])
        seen = [{(r.qid, r.d): round(r.score, 9) for r in x.collect()} for x in (tx.cosine(queries, weights, norms, idfs, corpus, [*corpus, "d"]), tx.few_cosines(rows, queries, sizes, corpus, [*corpus, "d"]))]
        assert seen[0] and seen[0] == seen[1]
